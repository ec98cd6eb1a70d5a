"""Spans of regex matches as DataFrame expressions. Spans count in code points, the end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value), with value made once: what a lambda reads from outside is otherwise made again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: Column | str, kind: Column | str) -> Column:
    """Array of (kind, start, end, found) of all leftmost non-overlapping matches, none of which may be empty.

    The text is split at the matches, and the matches are extracted; adding up the lengths of both gives each match's place.
    They are added up in groups of about the square root of their number, as an array that grows is copied at each step."""
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    kind = (kind if isinstance(kind, Column) else F.lit(kind)).cast("string")
    pairs = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, 0), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("found"))
        return F.when(pair["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["spans"], F.array(item)).alias("spans")))

    def group(members):
        return F.aggregate(members, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def placed(groups):
        offsets = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, g: F.struct((s["at"] + g["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
        moved = F.zip_with(groups, offsets, lambda g, by: F.transform(g["spans"], lambda s: F.struct(kind.alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found"))))
        return F.flatten(moved)

    def grouped(all_pairs):
        size = F.ceil(F.sqrt(F.size(all_pairs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(all_pairs), size), lambda i: group(F.slice(all_pairs, i, size)))

    return bound(bound(pairs, grouped), placed)  # a split text has one part at least


def listed(spans: Column, order: Column | None = None) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
