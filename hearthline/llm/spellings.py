"""Spelling variant grouping: words one edit apart, by a rare-first q-gram prefix filter, and the forms that they vary.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts, with A-Z lowered. In one of DROP runs, chosen by a
hash of document id and run, a letter is left out. Those of at least MIN_LENGTH letters that occur at least twice count.

Near words differ by exactly one inserted, deleted or replaced letter. An edit touches two bigrams at most, so of any three
bigrams of a word one is in each near word, moved by one place at most. Bigrams are ordered by how many times words hold them
(their number is bounded by the alphabet's square), a word's equal ones by place; the three rarest of a word are its list
entries, and near words share one, at the same place (equal lengths) or at the same or the next one (lengths that differ by one).
The join is on length, bigram and place, so a list holds only what may be near. One edit also leaves the first or the second half
of the shorter word as it is: a list entry goes out once with the hash of either, which keeps the lists of frequent bigrams short
whatever the corpus. Pairs that meet are verified by their edit distance.

A word's form is its near word with the largest n (ties: the least in code-point order) if that is at least RATIO times the
word's n. Forms are followed to the last by doubling (n grows by RATIO at each step, so chains are short).

Null texts have no words; a null id counts as an empty one in the hash; rows that share an id count one by one, as all rows do.
Very long runs are words as others. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import LOWER, UPPER, forget, loaded, small_batches, text_or_empty, written

MIN_LENGTH, RATIO, DROP, PREFIX = 7, 10, 31, 3
_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_TO_LOWER = str.maketrans(UPPER, LOWER)
#: A task keeps so many distinct words before it hands on their counts.
HELD = 500_000


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text and how many times each occurs. A run shorter than MIN_LENGTH makes no word."""
    runs: Counter = Counter()
    for run, n in Counter(_RUNS.findall(text)).items():
        runs[run.translate(_TO_LOWER)] += n
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        out[run] += n
    return out


def counted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: all words that occur at least twice. Tasks add up before anything is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    held[word] += n
            if len(held) > HELD:
                yield batch_of()
                held.clear()
        yield batch_of()

    slim = docs.select(docs[id_column].alias("doc_id"), text_or_empty(text_column).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


@lru_cache(maxsize=1)
def _order(path: str) -> dict[str, int]:
    """The place of each bigram in the global order: rare first, ties by the bigram."""
    table = loaded(path)
    rows = sorted(zip(table.column("n").to_pylist(), table.column("gram").to_pylist(), strict=True))
    return {gram: i for i, (_, gram) in enumerate(rows)}


def rarest(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(order, place) of the three rarest positional bigrams of a word."""
    return sorted([(order[word[i : i + 2]], i) for i in range(len(word) - 1)])[:PREFIX]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: all pairs of words (column word; a < b or the shorter first) that are one edit apart, each once."""
    def grams(batches):
        held: Counter = Counter()  # at most the alphabet's square
        for batch in batches:
            for word in batch.column(0).to_pylist():
                held.update(map("".join, zip(word, word[1:], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])

    path = written(words.select("word").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "bigrams").stored_at

    def run(batches):
        order = _order(path)  # at most the alphabet's square
        for batch in batches:
            owners, grams, places = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                for gram, place in rarest(word, order):
                    owners.append(i), grams.append(gram), places.append(place)
            rows = batch.column(0).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(grams, pa.int32()), pa.array(places, pa.int32())], ["word", "gram", "place"])

    listed = written(words.select("word").mapInArrow(run, "word string, gram int, place int"), "bigrams")
    length, place = F.length("word"), F.col("place")
    half = lambda n: F.floor(n / 2).cast("int")
    # of a pair of lengths n and n or n + 1: the first half of n, and the rest of n counted from the end
    halves = lambda n: F.array(F.xxhash64(F.lit(0), F.left("word", half(n))), F.xxhash64(F.lit(1), F.right("word", n - half(n))))

    def entries(n, places, kind):
        return listed.select(n.alias("length"), "gram", F.explode(places).alias("place"), halves(n).alias("halves"), "word", F.lit(kind).alias("kind"))

    own = entries(length, F.array(place), "own").select("length", "gram", "place", F.explode("halves").alias("half"), "word")
    longer = entries(length - 1, F.array(place, place - 1), "longer").select("length", "gram", "place", F.explode("halves").alias("half"), "word")
    key = ["length", "gram", "place", "half"]
    close = F.levenshtein("a", "b", 1) == 1
    same = own.withColumnRenamed("word", "a").join(own.withColumnRenamed("word", "b"), key).where("a < b").where(close)
    wider = own.withColumnRenamed("word", "a").join(longer.withColumnRenamed("word", "b"), key).where(close)
    return same.select("a", "b").unionByName(wider.select("a", "b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have forms (word, form), by doubling: what a word points to is replaced by what that points to."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(at)
        at = after
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = written(counted(docs, id_column, text_column), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("word"), F.col("b").alias("near"))
    numbered = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = numbered.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("top"))
    near_n = -F.col("top.minus_n")
    enough = near_n >= RATIO * F.col("n")
    held = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, near_n).alias("form_n")), "variants")
    roots = _roots(held.where("form is not null"))
    return held.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
