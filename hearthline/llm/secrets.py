"""Secret scan: three fixed kinds of secrets, and strings of high sliding-window entropy. DataFrame expressions only.

The method's own kind is "entropy". Candidates are runs of at least WINDOW characters of an alphabet (base64 and its URL form)
that hold a digit. For each character class (hex digits, all of base64) the Shannon entropy of every window of WINDOW
characters is known from incremental counts: a character that enters or leaves changes the sum of count * log2(count) by one
step, so a string is read once. A candidate counts if a window reaches the threshold of the narrowest class that holds it,
no allow-list pattern suppresses it, and no fixed span covers it.

Null texts count as empty; empty texts have no spans. Very long texts, candidates and span lists are read whole, in time that
grows as their length. Repeated rows and ids get the same answer each, nulls in the id stay, an empty table gives no rows. Columns
other than the id and the text are ignored (redacted() keeps them, whatever their names).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import text_or_empty
from hearthline.llm.spans import bound, listed, match_spans

WINDOW = 24
#: Candidates hold code points from "+" to "z" only.
LOWEST, CODES = ord("+"), ord("z") - ord("+") + 1
#: Up to so many spans a text is cut without splitting it into characters.
FEW = 64
#: Bits per character that a window must reach, by class.
HEX_BITS, BASE64_BITS = 3.0, 4.0

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"

#: Strings that look random but are no secrets: identifiers of a fixed form, counting or repeated patterns, documented examples, paths.
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9_/=+-]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghij|123456789a",
    r"^(.{1,8})\1+.{0,7}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx",
    r"^(?:[A-Za-z0-9_-]{1,20}/){2,}[A-Za-z0-9_-]{0,20}$",
    r"^(?:[a-z]+[-_]){2,}[a-z0-9]+$",
    r"^[-_=+/]{8,}",
)


def window_bits(string: Column) -> Column:
    """The highest Shannon entropy, in bits a character, of any WINDOW characters in a row.

    Counts are kept by code point from LOWEST on and changed by one as the window moves on; what is summed is count *
    log2(count). The string is split once, and what leaves the window is read from the split by its place."""

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def folded(codes):
        start = F.struct(F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("at"))

        def step(state, code):
            at = state["at"]
            entered = F.element_at(state["counts"], code + 1)
            gone = F.when(at >= WINDOW, F.element_at(codes, F.greatest(at - WINDOW, F.lit(0)) + 1)).otherwise(F.lit(-1))
            left = F.when(gone >= 0, F.element_at(state["counts"], F.greatest(gone, F.lit(0)) + 1)).otherwise(F.lit(0))
            same = gone == code
            total = F.when(same, state["sum"]).otherwise(state["sum"] + weight(entered + 1) - weight(entered) + F.when(gone >= 0, weight(left - 1) - weight(left)).otherwise(F.lit(0.0)))
            counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda n, i: n + F.when(i == code, 1).otherwise(0) - F.when(i == gone, 1).otherwise(0)))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(at >= WINDOW - 1, F.least(state["least"], total)).otherwise(state["least"]).alias("least"), (at + 1).alias("at"))

        return F.aggregate(codes, start, step, lambda s: F.log2(F.lit(float(WINDOW))) - s["least"] / WINDOW)

    return bound(F.transform(F.split(string, ""), lambda c: F.ascii(c) - LOWEST), folded)


def fixed_spans(text: Column) -> Column:
    """assign, access and hex spans by start, then kind as listed."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    assign = F.when(text.rlike(r"(?i)passw|secret|token|api_?key"), match_spans(text, ASSIGN, "assign")).otherwise(none)
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 12)
    # runs of these alphabets are taken whole, so asking for the length at once finds the same spans
    access = F.when(text.contains("AKIA"), match_spans(text, r"AKIA[A-Z0-9]{14,}", "access")).otherwise(none)
    hexes = F.when(text.rlike(r"[0-9a-f]{16}"), match_spans(text, r"[0-9a-f]{16,}", "hex")).otherwise(none)
    return by_place(F.concat(assign, access, hexes))


def by_place(spans: Column) -> Column:
    """By start, then kind as listed: assign, access, hex, entropy."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def entropy_spans(text: Column, fixed: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    found = F.when(text.rlike(CANDIDATE), match_spans(text, CANDIDATE, "entropy")).otherwise(none)
    found = F.filter(found, lambda s: s["found"].rlike("[0-9]") & ~F.exists(fixed, lambda f: (f["start"] <= s["start"]) & (f["end"] >= s["end"])))

    def enough(s):
        allowed = reduce(or_, [s["found"].rlike(p) for p in ALLOWED])
        hexadecimal = s["found"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        return F.when(allowed, F.lit(False)).otherwise(window_bits(s["found"]) >= F.when(hexadecimal, HEX_BITS).otherwise(BASE64_BITS))

    return F.filter(found, enough)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, fixed (the base spans) and found (all spans), arrays of (kind, start, end, found) by place."""
    slim = docs.select(docs[id_column], text_or_empty(text_column).alias("text"))
    based = slim.withColumn("fixed", fixed_spans(F.col("text")))
    more = based.withColumn("own", entropy_spans(F.col("text"), F.col("fixed")))
    return more.select(id_column, "fixed", by_place(F.concat("fixed", "own")).alias("found"))


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    found = scan(docs, id_column, text_column)
    count = lambda kind: F.size(F.filter("fixed", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_column,
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(F.col("fixed")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by the mark, overlapping spans by one; all columns stay, null texts too."""
    text = F.col(text_column)
    fixed, found = (next(f"{name}_{i}" for i in range(len(docs.columns) + 1) if f"{name}_{i}" not in docs.columns) for name in ("fixed", "found"))
    based = docs.withColumn(fixed, fixed_spans(F.coalesce(text, F.lit(""))))
    more = based.withColumn(found, by_place(F.concat(fixed, entropy_spans(F.coalesce(text, F.lit("")), F.col(fixed)))))

    def clean(cut):
        """cut(start, length): a part of the text. The kept parts are gathered and joined once."""

        def step(state, s):
            inside = s["start"] < state["at"]
            parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(cut(state["at"], s["start"] - state["at"]), F.lit(mark))))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(found, start, step, lambda s: F.array_join(F.concat(s["parts"], F.array(cut(s["at"], F.length(text)))), ""))

    # finding a place in a text reads it from the start; where that would be done often, it is split into characters first
    few = clean(lambda at, n: F.substr(text, at + 1, n))
    many = bound(F.split(text, ""), lambda chars: clean(lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")))
    return more.withColumn(text_column, F.when(F.size(found) == 0, text).when(F.size(found) <= FEW, few).otherwise(many)).select(*docs.columns)
