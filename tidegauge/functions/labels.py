"""Label maps: canonical text, hashing, enrichment, matching and templates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def series_key(labels: Column) -> Column:
    """``k=v,`` for every label in key order; maps cannot be grouped, this text can."""
    pairs = F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(k, F.lit("="), labels[k], F.lit(",")))
    return F.array_join(pairs, "")


def labels_hash(labels: Column) -> Column:
    """First eight bytes of SHA-256 over ``k=v`` pairs in key order, as hex; '' if there are none."""
    pairs = F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(k, F.lit("="), labels[k]))
    digest = F.substring(F.sha2(F.array_join(pairs, ","), 256), 1, 16)
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit("")).otherwise(digest)


def with_labels(labels: Column, **added: Column) -> Column:
    """Set labels, replacing any of the same name."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(labels, empty), lambda k, _: ~k.isin(list(added)))
    pairs = [part for name, value in added.items() for part in (F.lit(name), value)]
    return F.map_concat(kept, F.create_map(*pairs))


def label(df: DataFrame, name: str) -> Column:
    """A label's value, '' when absent; a promoted column wins over the map."""
    source = df[name] if name in df.columns else df["labels"][name]
    return F.coalesce(source, F.lit(""))


@dataclass(frozen=True)
class Matcher:
    """One condition on a label: ``=``, ``!=``, ``=~`` or ``!~`` (regex matches the whole value)."""

    label: str
    op: str
    value: str

    def condition(self, df: DataFrame) -> Column:
        absent_matches = {"=": self.value == "", "!=": self.value != ""}
        # A plain comparison on a promoted column reaches the Parquet scan.
        if self.label in df.columns and self.op == "=" and not absent_matches["="]:
            return df[self.label] == self.value
        actual = label(df, self.label)
        whole = f"^(?:{self.value})$"
        match self.op:
            case "=":
                return actual == self.value
            case "!=":
                return actual != self.value
            case "=~":
                return actual.rlike(whole)
            case "!~":
                return ~actual.rlike(whole)
        raise ValueError(f"unknown label operator {self.op!r}")


def matching(df: DataFrame, matchers: list[Matcher]) -> DataFrame:
    return reduce(lambda acc, m: acc.filter(m.condition(acc)), matchers, df)


def render(template: Column, labels: Column, value: Column | None = None) -> Column:
    """Fill ``{{name}}``, ``{{ $labels.name }}`` and ``{{ $value }}``; unknown names become ''."""
    text = F.regexp_replace(template, r"\{\{\s*(?:\$labels\.)?(\$?\w+)\s*\}\}", "{{$1}}")
    filled = F.aggregate(
        F.map_entries(labels),
        text,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]),
    )
    if value is not None:
        filled = F.replace(filled, F.lit("{{$value}}"), value)
    return F.regexp_replace(filled, r"\{\{\$?\w+\}\}", "")


# Enum texts in code order.
METRIC_TYPES = ("gauge", "counter", "histogram", "summary")
NODE_STATUSES = ("unknown", "healthy", "degraded", "unhealthy", "offline")
ALERT_STATES = ("inactive", "pending", "firing", "resolved")


def decode(code: Column, names: tuple[str, ...], fallback: str = "unknown") -> Column:
    """Enum code to its text."""
    known = F.get(F.array(*[F.lit(n) for n in names]), code.cast("int"))
    return F.coalesce(F.when(code >= 0, known), F.lit(fallback))


def metric_type(text: Column) -> Column:
    """Stored type text; anything unrecognised counts as a gauge."""
    return F.when(text.isin(*METRIC_TYPES), text).otherwise(F.lit("gauge"))
