"""Spans of regular-expression matches in code points, by built-in functions.

Spark returns the matched strings but not their places.  The same pattern
splits the text into the gaps between matches; running sums of gap and match
lengths give each match's start and end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: bigint, kind: int, end: bigint, value: string>>"


def matches(text: str, pattern: str, kind: int, keep: str = "true", only_if: str = "true") -> Column:
    """Array of (start, kind, end, value), leftmost non-overlapping.

    ``text`` is a column name; ``keep`` an SQL condition on ``v``, the matched
    string; ``only_if`` a cheap condition without which there is no match."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"""aggregate(
        zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (g, v) -> named_struct('gap', g, 'v', v)),
        named_struct('at', 0L, 'out', cast(array() as {SPAN})),
        (a, z) -> if(z.v is null, a, named_struct(
            'at', a.at + length(z.gap) + length(z.v),
            'out', {"concat(a.out, ITEM)" if keep == "true" else "if(KEEP, concat(a.out, ITEM), a.out)"})),
        a -> a.out)"""
    item = f"array(named_struct('start', a.at + length(z.gap), 'kind', {kind}, 'end', a.at + length(z.gap) + length(z.v), 'value', z.v))"
    found = found.replace("ITEM", item).replace("KEEP", keep.replace("{v}", "z.v"))
    return F.expr(f"if({only_if}, {found}, cast(array() as {SPAN}))")


def quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_order(*arrays: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(F.concat(*arrays))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(found: Column, base: Column) -> Column:
    """The spans of ``found`` that no span of ``base`` overlaps."""
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
