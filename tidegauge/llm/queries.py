"""The registered queries of the dealt operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import align, bloomlm, bpe, chat, decontaminate, idcodes, importance, neardup, rules, secretscan, sharding, simhash, warc
from tidegauge.plans import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Words of SQL texts: A-Z in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS win
  FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM iwin),
dwin AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
hits AS (SELECT d.doc_id, d.i, d.k, x.item FROM dwin d JOIN iwin x ON d.win = x.win AND d.k = x.k),
hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""


@query(_OP1_SQL)
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in benchmark windows."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query()
def op5_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as ids and back."""
    return bpe.encoded(table(spark, folder, "documents"), BYTE_BPE, ids=False)


_OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, CAST((n_words < 10) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 20 * n_words) AS BIGINT)
            + 4 * CAST((word_chars > 20 * n_words) AS BIGINT) + 8 * CAST((word_chars < 2 * n_words) AS BIGINT)
            + 16 * CAST((100 * n_symbols > 10 * n_words) AS BIGINT)
            + 32 * CAST((n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM b"""


@query(_OP6_SQL)
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of every document, judged by the current policy."""
    judged = rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *[F.col(f"ledger.{m}").alias(m) for m in rules.MEASUREMENTS if m != "n_lines"],
        (~rules.passes(rules.POLICIES[0])).alias("base_failed"),
        rules.passes(rules.CURRENT).alias("kept"),
        F.col("ledger.failed").alias("failed"),
    )


def _spans_text(column: str):
    names = F.array(*[F.lit(k) for k in secretscan.KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


@query()
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets: the base patterns, and formats like those they find."""
    spans = secretscan.scanned(table(spark, folder, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_spans_text("base"), 256).alias("base_sha256"),
        _spans_text("spans").alias("spans"),
    )


_OP8_SQL = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM dw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT dw.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, dw.doc_id = component_id AS kept
FROM dw JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query(_OP8_SQL)
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near duplicates over all documents."""
    found = neardup.near_duplicates(table(spark, folder, "documents"))
    return found.withColumnRenamed("component", "component_id")


# A conversation's turns in order, the turn where its rejected twin leaves it, and both sides rendered turn by turn.
_SHOWN = "list_transform({x}, lambda s: '<|im_start|>' || s.r || chr(10) || s.t || '<|im_end|>' || chr(10))"
_MASKED = """array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].r = 'assistant'),
         lambda i: (coalesce(list_sum(list_transform({x}[1:i - 1], lambda s: length(s.r) + length(s.t) + 24)), 0) + 22)::BIGINT || ':'
                || (coalesce(list_sum(list_transform({x}[1:i - 1], lambda s: length(s.r) + length(s.t) + 24)), 0) + 32 + length({x}[i].t))::BIGINT), ',')"""
_OP2_SQL = rf"""
WITH w AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS c
  FROM conversations GROUP BY conv_id),
k AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN len(c) // 2 ELSE len(c) - 1 END AS k FROM w),
p AS (
  SELECT a.conv_id, a.c AS good, list_concat(a.c[1:k], coalesce(b.c[k + 1:], [])) AS bad
  FROM k a LEFT JOIN w b ON b.conv_id = a.conv_id + 1),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(good), len(bad)) + 1), lambda i: good[i] <> bad[i])) - 1, least(len(good), len(bad))) AS n FROM p),
r AS (SELECT conv_id, n, good[1:n] AS same, good[n + 1:] AS good, bad[n + 1:] AS bad FROM n)
SELECT conv_id, CAST(n AS BIGINT) AS prefix_turns, array_to_string({_SHOWN.format(x="same")}, '') AS prompt,
       array_to_string({_SHOWN.format(x="good")}, '') AS chosen_text, {_MASKED.format(x="good")} AS chosen_mask,
       array_to_string({_SHOWN.format(x="bad")}, '') AS rejected_text, {_MASKED.format(x="bad")} AS rejected_mask
FROM r"""


@query(_OP2_SQL)
def op2_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation whole, against one that leaves it at its first, middle or last turn and goes on as the next conversation does."""
    whole = chat.conversations(table(spark, folder, "conversations"))
    following = whole.select((F.col("conv_id") - 1).alias("before"), F.col("turns").alias("others"))
    size = F.size("turns")
    turn = F.when(F.col("conv_id") % 3 == 0, 0).when(F.col("conv_id") % 3 == 1, F.floor(size / 2).cast("int")).otherwise(size - 1)
    other = F.coalesce("others", F.array().cast(f"array<{chat.TURN}>"))
    pairs = whole.join(following, F.col("conv_id") == F.col("before"), "left").select(
        "conv_id",
        F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", 1, turn), F.slice(other, turn + 1, F.size(other))).alias("rejected"),
    )

    def mask(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(column)

    return chat.preference_format(pairs).withColumns({c: mask(c) for c in ("chosen_mask", "rejected_mask")})


# The checksum of a text byte by byte, from the table that its polynomial gives.
_CRC_SQL = r"""
bits AS (
  SELECT list(v ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda k: 0::BIGINT)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)))"""
_OP3_SQL = (
    "WITH "
    + _CRC_SQL
    + r""",
d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS pos, CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
s AS (SELECT *, CAST(pos * 24 // total AS INTEGER) AS shard FROM p),
c AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT))),
         lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, hex(encode(t)) AS x FROM d), bits)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN c USING (doc_id)"""
)


@query(_OP3_SQL)
def op3_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, folder, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query()
def op4_bloom_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents under a model of those outside fold 2."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held_out = bloomlm.fold() == 2
    model = bloomlm.train(documents.where(~held_out))
    total = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    scores = bloomlm.scored(documents, model)
    return scores.withColumns({"held_out": held_out, "train_tokens": F.lit(total).cast("long")})


_URL_SQL = r"""
canonical AS (
  SELECT record_id,
    CASE WHEN host <> '' THEN host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key
  FROM (
    SELECT record_id,
      regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
      regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
      list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept
    FROM (SELECT record_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM records)))"""
_OP10_SQL = (
    r"""
WITH records AS (
  SELECT 2 * page_id AS record_id, url, page_id * 10 AS captured_at, 'response' AS kind, '"' || md5(html) || '"' AS etag,
         CASE WHEN page_id % 4 <> 0 THEN 'day-' || page_id % 30 END AS last_modified, strlen(html) AS size, page_id FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, CASE page_id % 3 WHEN 0 THEN url || '#again'
           WHEN 1 THEN CASE WHEN url LIKE 'https:%' THEN 'http' || substr(url, 6) ELSE 'https' || substr(url, 5) END
           ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=revisit' END,
         page_id * 10 + CASE WHEN page_id % 11 = 0 THEN -5 ELSE 5 END, 'revisit',
         CASE WHEN page_id % 5 = 0 THEN '"stale"' WHEN page_id % 7 = 0 THEN NULL
              WHEN page_id % 13 = 0 THEN 'W/"' || md5(html) || '"' ELSE '"' || md5(html) || '"' END,
         CASE WHEN page_id % 6 <> 0 THEN 'day-' || page_id % 30 END, 0, page_id FROM pages),"""
    + _URL_SQL
    + r""",
k AS (SELECT * FROM records JOIN canonical USING (record_id)),
j AS (
  SELECT v.*, r.record_id AS rid, r.etag AS retag, r.last_modified AS rlm, r.size AS rsize
  FROM (SELECT * FROM k WHERE kind = 'revisit') v
  ASOF LEFT JOIN (SELECT * FROM k WHERE kind = 'response' AND url_key IS NOT NULL) r ON v.url_key = r.url_key AND v.captured_at > r.captured_at),
s AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing'
      WHEN (etag IS NULL OR retag IS NULL) AND (last_modified IS NULL OR rlm IS NULL) THEN 'unverified'
      WHEN etag IS NOT NULL AND retag IS NOT NULL THEN
        CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
      WHEN last_modified = rlm THEN 'resolved' ELSE 'mismatch' END AS state FROM j)
SELECT record_id, url_key, captured_at, CASE WHEN state = 'resolved' THEN rid END AS response_id, state,
  CASE WHEN state = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || rsize || chr(10)
    || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: tick-' || page_id || chr(10) || 'etag: ' || retag END AS headers
FROM s"""
)


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a full response, and a revisit by another spelling of the URL, some with stale or no validators, some too early."""
    page, url = F.col("page_id"), F.col("url")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day-"), page % 30)
    swapped = F.when(url.startswith("https:"), F.concat(F.lit("http"), F.expr("substring(url, 6)"))).otherwise(F.concat(F.lit("https"), F.expr("substring(url, 5)")))
    asked = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_source=revisit"))
    response = pages.select(
        (2 * page).alias("record_id"),
        url,
        (page * 10).alias("captured_at"),
        F.lit("response").alias("record_type"),
        tag.alias("etag"),
        F.when(page % 4 != 0, day).alias("last_modified"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60")
        ).alias("headers"),
    )
    revisit = pages.select(
        (2 * page + 1).alias("record_id"),
        F.when(page % 3 == 0, F.concat(url, F.lit("#again"))).when(page % 3 == 1, swapped).otherwise(asked).alias("url"),
        (page * 10 + F.when(page % 11 == 0, -5).otherwise(5)).alias("captured_at"),
        F.lit("revisit").alias("record_type"),
        F.when(page % 5 == 0, F.lit('"stale"')).when(page % 7 == 0, F.lit(None)).when(page % 13 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag).alias("etag"),
        F.when(page % 6 != 0, day).alias("last_modified"),
        F.create_map(
            F.lit("cache-control"), F.lit("max-age=600"), F.lit("Date"), F.concat(F.lit("tick-"), page), F.lit("Content-Length"), F.lit("0"), F.lit("Set-Cookie"), F.lit("a=b")
        ).alias("headers"),
    )
    return response.unionByName(revisit)


@query(_OP10_SQL)
def op10_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Revisits of all pages, each resolved to the response that it stands for."""
    resolved = warc.resolve(crawl_records(table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return resolved.withColumn("headers", F.array_join(lines, "\n"))


@query()
def op9_direct_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to files of directly addressable codes and read back."""
    path = scratch.new_folder(spark, "ids")
    idcodes.write(table(spark, folder, "documents"), path, WORD_BPE)
    return idcodes.read(spark, path)


_OP11_SQL = (
    "WITH "
    + _CRC_SQL
    + rf""",
dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
df AS (SELECT doc_id, unnest(w) AS f FROM dw),
tf AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
         lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM tf), bits),
sc AS (SELECT bucket, count(*) AS s FROM df JOIN buckets USING (f) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM tf JOIN buckets USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE
                        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tf) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket)),
fg AS (SELECT f, gain FROM buckets JOIN g USING (bucket)),
w AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN fg USING (f) GROUP BY doc_id),
s AS (
  SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_features,
         CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || dw.doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS noise
  FROM dw LEFT JOIN w USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS able FROM s WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, rank
FROM s LEFT JOIN (SELECT doc_id, rank FROM r WHERE rank <= 10 * able // 100) USING (doc_id)"""
)


@query(_OP11_SQL)
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents drawn towards the words of the benchmark."""
    return importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most two bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the tokens of two vocabularies over all documents."""
    return align.aligned(table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE)
