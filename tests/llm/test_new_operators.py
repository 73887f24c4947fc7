"""Importance resampling, SimHash near-dedup and tokenizer alignment against plain loops, and on odd rows."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers_llm import LOW, ODD_TEXTS, low_words
from tidegauge.llm import align, components, importance, lookups, queries, simhash, wordspans
from tidegauge.llm.textbatch import NOT_SPACE

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def odd_rows(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


# Spans


def test_span_hashes_are_xxh64():
    rng = random.Random(3)
    texts = [None, "", " x", "y " * 3, "z" * 700 + " a b", *(" ".join("é" * rng.randint(1, 20) + str(i) for i in range(rng.randint(0, 50))) for _ in range(50))]
    laid = wordspans.laid_out(pa.array(texts), NOT_SPACE)
    for n in (1, 2, 3):
        starts, ends, bounds = laid.runs(n)
        hashes = wordspans.span_hashes(laid.data, starts, ends, 42)
        for i, text in enumerate(texts):
            words = low_words(text)
            want = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(len(words) - n + 1)]
            assert hashes[bounds[i] : bounds[i + 1]].tolist() == want


# 11: importance resampling


def resampled_plainly(rows, target, max_n=1, buckets=10_000, min_words=20, share=10, seed=2024):
    def features(text):
        words = LETTERS.findall((text or "").translate(LOW))
        return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    source, wanted = collections.Counter(), collections.Counter()
    for counter, texts in ((source, [t for _, t in rows]), (wanted, target)):
        for text in texts:
            counter.update(zlib.crc32(f.encode()) % buckets for f in features(text)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    ranks = {id(r): i for i, r in enumerate(able[: share * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def test_resampling_on_odd_rows(spark, odd, nothing):
    rows = odd_rows(odd)
    target = ["one Two three", None, "", "a b c d", "w1x1 w2x2"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"max_n": 3, "buckets": 97, "min_words": 1, "share": 40}, {"min_words": 0, "share": 100}):
        got = importance.resampled(odd, frame, **options)
        assert sorted((tuple(r) for r in got.collect()), key=str) == resampled_plainly(rows, target, **options)
    assert importance.resampled(nothing, frame).count() == 0
    untargeted = importance.resampled(odd, frame.limit(0), min_words=1, share=50)
    assert sorted((tuple(r) for r in untargeted.collect()), key=str) == resampled_plainly(rows, [], min_words=1, share=50)


def test_draw_prefers_texts_like_the_target(spark):
    rows = [(i, " ".join(f"{'left' if i % 5 else 'right'}{(i * 7 + k) % 40}" for k in range(30))) for i in range(2000)]
    target = spark.createDataFrame([(" ".join(f"right{k}" for k in range(40)),)], "text string")
    drawn = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in drawn] == list(range(1, 201))
    # A fifth of the rows; without a preference about 40 would be drawn.
    assert sum(r.doc_id % 5 == 0 for r in drawn) > 100


def test_interning_tells_equal_hashes_apart(monkeypatch):
    """Even if all hashes were the same, the bytes decide; and the table grows."""
    texts = pa.array([" ".join(f"w{i % 700}" for i in range(3000)), "w1 w2 w1"])
    laid = wordspans.laid_out(texts, NOT_SPACE)
    starts, ends, _ = laid.runs(1)
    for constant in (True, False):
        with monkeypatch.context() as patch:
            if constant:
                patch.setattr(importance, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
            patch.setattr(importance, "BLOCK", 512)
            table = importance.Interned(laid.data, 10_000)
            table._slots = table._slots[:16].copy()
            entries = table.add(starts, ends)
        words = [bytes(laid.data[a:b]) for a, b in zip(starts, ends)]
        assert len({(e, w) for e, w in zip(entries.tolist(), words)}) == 700 == len(table.count)
        assert table.count[entries[0]] == words.count(words[0]) and table.bucket[entries[0]] == zlib.crc32(words[0]) % 10_000


# 12: SimHash


def simhash_plainly(rows, radius=2):
    def fingerprint(text):
        words = low_words(text)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(rows), 2):
        if a is not None and b is not None and (prints[i] ^ prints[j]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(((d, p, None if d is None else find(d)) for (d, _), p in zip(rows, prints)), key=str)


def found_by(frame):
    return sorted(((r.doc_id, r.fingerprint & (2**64 - 1), r.component) for r in frame.collect()), key=str)


def test_simhash_on_odd_rows(spark, odd, nothing):
    rows = odd_rows(odd)
    assert found_by(simhash.near_duplicates(odd)) == simhash_plainly(rows)
    assert simhash.near_duplicates(nothing).count() == 0
    shared = [(1, "a b c d e f"), (1, "totally other words here now"), (2, "TOTALLY other words here now"), (3, "A b c d e f"), (None, "a b c d e f")]
    assert found_by(simhash.near_duplicates(spark.createDataFrame(shared, "doc_id long, text string"))) == simhash_plainly(shared)


def test_simhash_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = [(d, f"{p:016x}", c) for d, p, c in simhash_plainly(rows)]
    got = queries.QUERIES["op12_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_all_close_pairs_at_every_depth(spark):
    """Dense clusters, chains and far fingerprints; buckets so small that they are cut again and again."""
    rng = random.Random(5)
    values = {0, 2**64 - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        values |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
        step = centre
        for _ in range(60):
            step ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(step)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    rng.shuffle(values)
    for radius in (1, 2, 3):
        root = list(range(len(values)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        array = np.array(values, np.uint64)
        for i in range(len(values)):
            for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= radius) + i + 1:
                x, y = find(i), find(int(j))
                root[max(x, y)] = min(x, y)
        whole = simhash.stars(array, np.zeros(len(array), np.uint64), np.array([0, len(array)]), radius)
        small_buckets = simhash.stars(array, np.zeros(len(array), np.uint64), np.array([0, len(array)]), radius, 16)
        assert whole.tolist() == small_buckets.tolist() == [find(i) for i in range(len(values))]
        if radius == 2:
            classes = spark.createDataFrame([(v - 2**64 if v >> 63 else v, i) for i, v in enumerate(values)], "fingerprint bigint, rep bigint")
            for bucket in (8, 4096):
                links = simhash.linked_classes(classes, radius, bucket)
                roots = {r.node: r.root for r in components.components(links).collect()}
                assert [roots.get(i, i) for i in range(len(values))] == [find(i) for i in range(len(values))]


def test_bit_counts_of_long_rows():
    values = np.array([random.Random(i).getrandbits(64) for i in range(1500)], np.uint64)
    bounds = np.array([0, 0, 700, 701, 701, 1500])
    want = [[sum(int(v) >> b & 1 for v in values[i:j]) for b in range(64)] for i, j in zip(bounds[:-1], bounds[1:])]
    assert simhash.bit_counts(values, bounds).tolist() == want


def test_heavy_keys_are_looked_up_by_broadcast(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 9 > 0, F.col("id")).alias("k"), "id")
    table = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.sql("SELECT 7L AS k, 14L AS v"))
    assert [r.k for r in lookups.heavy_keys(rows, "k").collect()] == [7]
    for how in ("inner", "left"):
        got = sorted(map(str, lookups.looked_up(rows, "k", table, how).select("k", "id", "v").collect()))
        assert got == sorted(map(str, rows.join(table, "k", how).select("k", "id", "v").collect()))


# 13: alignment


def aligned_plainly(rows):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    library.no_truncation()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    pairs, documents = collections.Counter(), []
    for doc, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_bytes = [bytes(names[c] for c in library.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            documents.append((doc, [], [], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = list(itertools.accumulate(map(len, parts)))
            spans.append(list(zip([0, *ends], ends)))
        links, j = [], 0
        for i, (first, last) in enumerate(spans[0]):
            while spans[1][j][1] <= first:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < last:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        sides = [collections.defaultdict(list), collections.defaultdict(list)]
        for side, ids, part in zip(sides, (a, b), spans):
            for token, (_, end) in zip(ids, part):
                side[bisect.bisect_left(cuts, end)].append(str(token))
        groups = ["|".join(",".join(side[g]) for side in sides) for g in range(len(cuts))]
        pairs.update(links)
        documents.append((doc, a, b, groups, links))
    most = collections.Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return sorted(
        (
            (d, len(a), len(b), len(g), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, a, b, g, links in documents
        ),
        key=str,
    )


def test_alignment_on_odd_rows(spark, odd, nothing):
    assert sorted((tuple(r) for r in align.aligned(odd, BYTE, PIECE).collect()), key=str) == aligned_plainly(odd_rows(odd))
    assert align.aligned(nothing, BYTE, PIECE).count() == 0


def test_alignment_on_random_texts(spark, small):
    rng = random.Random(11)
    pieces = ["a", "B", " ", "  ", "\n", "\t", "é", "中", "\U0001f600", "▁", "<s>", "<0x41>", "<|endoftext|>", "'s", "123", "the ", " ", "́", "\x00", "\r\n", "..", "Straße", "​"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [" ", "  ", "▁", "a "]
    rows = list(enumerate(texts)) + [(r.doc_id + 10_000, r.text) for r in small.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in align.aligned(frame, BYTE, PIECE).collect()), key=str) == aligned_plainly(rows)


def test_long_texts_are_slices_of_their_own(spark):
    rows = [(1, "ab cd " * 400_000), (2, "ab cd"), (3, "ef" * 3000), (4, ODD_TEXTS[9])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r.doc_id: r for r in align.aligned(frame, BYTE, PIECE).collect()}
    assert {d: (r.n_a, r.n_b) for d, r in got.items() if d in (2, 4)} == {r[0]: r[1:3] for r in aligned_plainly(rows[1:]) if r[0] in (2, 4)}
    assert got[1].n_links >= 800_000 and got[1].n_best == got[1].n_links
