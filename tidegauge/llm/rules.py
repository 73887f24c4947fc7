"""Quality rules as a bitmask ledger: every rule is evaluated once per document.

``ledger`` stores one failure bit per rule next to the measurements.  Versioned
policies are bit masks over those rules, so applying another version, or asking
what a version would keep without one of its rules, reads the small ledger and
never the texts again.  Everything is built-in column functions.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at line feeds and count if
they hold a word.  All comparisons are on whole numbers.

Defined cases: null and empty texts have no words and so fail ``few_words``;
repeated rows are judged each for itself; other columns of the documents are
carried along untouched (the ledger's own columns sit in one struct whose name
the caller may choose).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.lookups import free_name

WINDOW = 5
LEDGER = "ledger"
_SPACES = "[\\x20\\x09-\\x0D]"
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; the rule's place in RULES is its bit, so only append."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """The named rules, any of which rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, rule in enumerate(RULES) if rule.name in self.rules)


#: The rules every policy has, and the policies by version.
BASE = ("few_words", "repeated_windows")
POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "long_words", "short_words", "symbols")),
    Policy("v2", (*BASE, "long_words", "short_words", "symbols", "repeated_lines")),
)
CURRENT = POLICIES[-1]


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a struct ``_m`` of all measurements.

    ``n_repeat_words`` counts the words inside five-word windows that occur
    twice or more in the text.  Hashes tell the many texts that repeat nothing;
    only the others build and sort their windows, and compare them as text.
    The steps are separate projections so that no array is built twice.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, hashes, ordered = F.col("_w"), F.col("_h"), F.col("_o")
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))

    def window(at: Column) -> list[Column]:
        return [F.element_at(words, at + i) for i in range(WINDOW)]

    def twice(x: Column, i: Column) -> Column:
        return (F.get(ordered, i - 1)["s"] == x["s"]) | (F.get(ordered, i + 1)["s"] == x["s"])

    def extended(sofar: Column, at: Column) -> Column:
        end = at + WINDOW
        return F.struct(end.alias("end"), (sofar["n"] + end - F.greatest(at, sofar["end"])).alias("n"))

    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return (
        documents.withColumns({"_w": F.array_remove(F.split(body, _SPACES + "+"), ""), "_l": lines})
        .withColumn("_h", F.when(F.size(words) > WINDOW, F.transform(starts, lambda at: F.xxhash64(*window(at)))))
        .withColumn(
            "_o",
            F.when(
                F.size(F.array_distinct(hashes)) < F.size(hashes),
                F.sort_array(F.transform(starts, lambda at: F.struct(F.concat_ws(" ", *window(at)).alias("s"), at.alias("at")))),
            ),
        )
        .withColumn("_p", F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["at"])))
        .withColumn(
            "_m",
            F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size("_l").cast("long").alias("n_lines"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                F.coalesce(
                    F.aggregate("_p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), extended, lambda done: done["n"]), F.lit(0)
                ).cast("long").alias("n_repeat_words"),
            ),
        )
        .drop("_w", "_l", "_h", "_o", "_p")
    )


def _bits(of: str) -> Column:
    bits = [F.when(F.expr(_qualified(rule.fails, of)), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out.cast("long")


def _qualified(condition: str, of: str) -> str:
    for name in MEASUREMENTS:
        condition = condition.replace(name, f"{of}.{name}")
    return condition


def ledger(documents: DataFrame, text: str = "text", name: str = LEDGER) -> DataFrame:
    """The documents with a struct of all measurements and ``failed``, one bit per rule that a document fails.

    The struct comes out of a one-element ``explode``: a later filter on it then
    stays above it instead of being rewritten in terms of the text, which would
    evaluate every rule again and again.
    """
    columns = [F.col(c) for c in documents.columns]
    return measured(documents.select(F.struct(*columns).alias("_row"), F.col(text).alias("_text")), "_text").select(
        "_row.*", F.explode(F.array(F.struct("_m.*", _bits("_m").alias("failed")))).alias(name)
    )


def passes(policy: Policy, name: str = LEDGER) -> Column:
    return F.col(f"{name}.failed").bitwiseAND(F.lit(policy.mask)) == 0


def accepted(documents: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The documents, with the columns they came with, that the policy keeps."""
    name = free_name("_ledger", documents.columns)
    return ledger(documents, text, name).where(passes(policy, name)).drop(name)


def ablations(ledgers: DataFrame, policies: tuple[Policy, ...] = POLICIES, name: str = LEDGER) -> DataFrame:
    """Per policy and rule: documents kept, failing the rule at all, and failing it alone (kept without it).

    Documents are first counted by failure bits: at most 2^rules rows, whatever
    the number of documents.
    """
    counts = ledgers.groupBy(F.col(f"{name}.failed").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    pairs = [(p.version, p.mask, rule, 1 << i) for p in policies for i, rule in enumerate(r.name for r in RULES) if rule in p.rules]
    asked = F.explode(
        F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).alias("mask"), F.lit(r).alias("rule"), F.lit(b).alias("bit")) for v, m, r, b in pairs])
    )
    return (
        counts.select("bits", "n", asked.alias("q"))
        .select("n", "q.version", "q.rule", "q.bit", F.col("bits").bitwiseAND(F.col("q.mask")).alias("hit"))
        .groupBy("version", "rule")
        .agg(
            F.sum(F.when(F.col("hit") == 0, F.col("n")).otherwise(0)).alias("kept"),
            F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )
