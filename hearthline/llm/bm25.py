"""Exact BM25 top-k: an inverted index per shard of documents, read by block-max WAND, merged under global statistics.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A shard's index holds about SHARD_DOCS
documents by falling length in blocks of BLOCK; per word it knows the highest term weight of its list. The longest lists are kept
as dense rows, DENSE of them at most: a group of queries meets these in one matrix product, which gives what frequent words give
to each document, in single precision and so to within SLACK. Their contributions are bounds that hold for a document, not a list.
WAND goes by a threshold, the k-th best score known. Of a query's other lists in ascending order of their highest contributions,
those that together with the most that frequent words give to any document stay below the threshold can't make a document a pivot;
pivots are the documents that what frequent words and the upper lists give them and the highest contributions of the lists below
bring to the threshold. They are taken in bulk, not one by one, as numpy wants it: a block in which the most that frequent words
give and the highest contributions of all other lists stay below the threshold is skipped before its entries are read; the lists
below are read only if that costs less than reading the pivots; pivots are scored in full, in double precision, from the highest
bound down, raising the threshold, until a bound is below it. No document beyond can enter, so the top k is that of scoring
everything. Document frequencies, document count and mean length are those of the whole table, so scores of all shards compare.

Shards are searched in two rounds, one of FIRST parts of the documents and then the others. The k-th best score of the first
round is the threshold from which the second starts, so all shards share it, and how much leaves the second round follows the
number of queries, not that of shards. Queries are a table of their own, written to the shared folder in row groups and streamed
by each shard's task, a group at a time.

score = sum over the query's distinct words of log(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B *
length / mean length)), rounded to six places; ties go to the smaller id. Null texts count as empty. Queries without words have no
rows; null ids are neither searched nor found. Rows that share an id are documents of their own, as queries they are one with the
words of all. Long texts are read whole. Other columns are ignored. An empty table of either kind gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthline.llm.common import forget, shared_folder, small_batches, text_or_empty, word_hashes, written

K1, B = 1.2, 0.75
SHARD_DOCS, BLOCK = 12288, 64
#: Lists of a share of the documents or more become dense rows, so many at most; what these give is known to within SLACK.
DENSE, SHARE, SLACK = 512, 1 / 32, 1e-3
#: An index ends early with so many entries; the first round has one of so many parts of the documents.
SHARD_ENTRIES, FIRST = 4_000_000, 16

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a text and how often each occurs."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    found, n = np.unique(word_hashes(data, _NOT_WORD[data])[0], return_counts=True)
    return found.view(np.int64), n


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - begin
    ends = np.cumsum(size)
    out = np.repeat(begin - ends + size, size)
    out += np.arange(len(out))
    return out


class Index:
    """One shard."""

    def __init__(self, doc_ids: np.ndarray, words: list[np.ndarray], counts: list[np.ndarray], mean_length: float) -> None:
        lengths = np.array([c.sum() for c in counts], np.float64)
        by_length = np.argsort(-lengths, kind="stable")  # so that the highest weights of a block are near those of its documents
        self.doc_ids, lengths = doc_ids[by_length], lengths[by_length]
        words, counts = [words[i] for i in by_length], [counts[i] for i in by_length]
        self.doc_begin = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        doc = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(self.doc_begin))
        tf = np.concatenate(counts).astype(np.float64)
        self.doc_weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean_length)[doc])
        del tf
        self.words, self.doc_word = np.unique(np.concatenate(words), return_inverse=True)
        self.doc_word = self.doc_word.astype(np.int32)
        order = np.argsort(self.doc_word, kind="stable")  # entries by word, documents ascending
        self.doc, self.weight = doc[order], self.doc_weight[order]
        of = self.doc_word[order]
        del doc, order
        self.begin = np.searchsorted(of, np.arange(len(self.words) + 1))
        # runs of entries of one word in one block
        self.blocks = -(-len(words) // BLOCK)
        place = of.astype(np.int64) * self.blocks + self.doc // BLOCK
        self.run_begin = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)])) if len(place) else np.zeros(1, np.int64)
        self.run_block = (place[self.run_begin[:-1]] % self.blocks).astype(np.int32)
        del of, place
        self.word_run = np.searchsorted(self.run_begin, self.begin)
        self.most = np.maximum.reduceat(self.weight, self.begin[:-1]) if len(self.weight) else np.zeros(0)
        self.idf_of = np.zeros(len(self.words))
        size = np.diff(self.begin)
        dense = np.argsort(-size, kind="stable")[:DENSE]
        dense = dense[size[dense] >= SHARE * len(words)]
        self.row_of = np.full(len(self.words), -1)
        self.row_of[dense] = np.arange(len(dense))
        self.rows = np.zeros((len(dense), len(words)), np.float32)
        for row, x, y in zip(self.rows, self.begin[dense].tolist(), self.begin[dense + 1].tolist(), strict=True):
            row[self.doc[x:y]] = self.weight[x:y]
        self.entries_read = self.entries_asked = 0

    def top(self, query: np.ndarray, idf: np.ndarray, k: int, threshold: float = 0.0) -> list[tuple[float, int]]:
        """(score, doc id) of the k best documents with a word of the query and a score of the threshold or more."""
        return self.tops([query], [idf], k, [threshold])[0]

    def tops(self, queries: list[np.ndarray], idfs: list[np.ndarray], k: int, thresholds: list[float]) -> list[list[tuple[float, int]]]:
        """The same of each query of a group."""
        if not len(self.words):
            return [[] for _ in queries]
        words, idf, of = np.concatenate(queries), np.concatenate(idfs), np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        here = self.words[at] == words
        at, idf, of = at[here], idf[here], of[here]
        row = self.row_of[at]
        asked = np.zeros((len(queries), len(self.rows)), np.float32)
        asked[of[row >= 0], row[row >= 0]] = idf[row >= 0]
        common = asked @ self.rows
        self.entries_asked += int((self.begin[at + 1] - self.begin[at]).sum())
        ends = np.searchsorted(of, np.arange(len(queries) + 1))
        return [self._best(at[x:y], idf[x:y], row[x:y] < 0, k, t, c) if x < y else [] for x, y, t, c in zip(ends[:-1].tolist(), ends[1:].tolist(), thresholds, common, strict=True)]

    def _best(self, at: np.ndarray, idf: np.ndarray, other: np.ndarray, k: int, threshold: float, common: np.ndarray) -> list[tuple[float, int]]:
        """common: what frequent words give to each document; other: which of the query's words are not among these."""
        self.idf_of[at] = idf
        all_at = at
        at, idf = at[other], idf[other]
        bound = idf * self.most[at]
        order = np.argsort(bound)
        at, idf = at[order], idf[order]
        below = np.concatenate(([0.0], np.cumsum(bound[order])))
        if threshold <= 0:
            # without a threshold no list is below it, and the k-th of what all lists give is a first one
            lists, blocks = 0, None
        else:
            lists = max(0, int(np.searchsorted(below, threshold - SLACK - float(common.max()))) - 1)
            blocks = np.maximum.reduceat(common, np.arange(0, len(common), BLOCK)) + below[-1] >= threshold - SLACK
        best: list[tuple[float, int]] = []
        if blocks is None or blocks.any():
            best = self._pivots(at, idf, lists, below[lists], k, threshold, common, blocks)
        self.idf_of[all_at] = 0.0
        return best

    def _pivots(self, at, idf, lists: int, lower: float, k: int, threshold: float, common: np.ndarray, blocks: np.ndarray | None) -> list[tuple[float, int]]:
        partial = common + self._given(at[lists:], idf[lists:], blocks)
        if threshold <= 0 and len(partial) > k:
            threshold = max(0.0, float(np.partition(partial, len(partial) - k)[len(partial) - k]) - 2 * SLACK)
        docs = np.flatnonzero((partial > 0) & (partial >= threshold - SLACK)) if not lists else np.flatnonzero(partial >= threshold - SLACK - lower)
        if lists and int((self.doc_begin[docs + 1] - self.doc_begin[docs]).sum()) > int((self.begin[at[:lists] + 1] - self.begin[at[:lists]]).sum()):
            # so many pivots stay that reading the lower lists, in these pivots' blocks, costs less than reading the documents
            wanted = np.zeros(self.blocks, bool)
            wanted[docs // BLOCK] = True
            bound = partial[docs] + self._given(at[:lists], idf[:lists], wanted)[docs]
            keep = bound >= threshold - SLACK
            docs, bound = docs[keep], bound[keep]
        else:
            bound = partial[docs] + lower
        order = np.argsort(-bound)
        docs, bound = docs[order], bound[order]
        best: list[tuple[float, int]] = []
        step, done = 4 * k, 0
        while done < len(docs) and bound[done] >= threshold - SLACK:
            best = self._merged(best, docs[done : done + step], k, threshold)
            if len(best) == k:
                threshold = max(threshold, best[-1][0])
            done, step = done + step, 2 * step
        return best

    def _given(self, at: np.ndarray, idf: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
        """What these lists give to each document, in the blocks wanted at least."""
        if blocks is None or 2 * blocks.sum() > self.blocks:
            begin, end = self.begin[at], self.begin[at + 1]
        else:
            first, last = self.word_run[at], self.word_run[at + 1]
            runs = _ranges(first, last)
            wanted = blocks[self.run_block[runs]]
            idf = np.repeat(idf, last - first)[wanted]
            begin, end = self.run_begin[runs[wanted]], self.run_begin[runs[wanted] + 1]
        if not len(begin):
            return np.zeros(len(self.doc_ids))
        entries = _ranges(begin, end)  # most lists are short by far
        self.entries_read += len(entries)
        return np.bincount(self.doc[entries], self.weight[entries] * np.repeat(idf, end - begin), len(self.doc_ids))

    def _merged(self, best: list, docs: np.ndarray, k: int, threshold: float = 0.0) -> list[tuple[float, int]]:
        """The k best of best and the documents, these scored in full."""
        if not len(docs):
            return best
        begin, end = self.doc_begin[docs], self.doc_begin[docs + 1]
        entries = _ranges(begin, end)
        self.entries_read += len(entries)
        given = np.concatenate(([0.0], np.cumsum(self.idf_of[self.doc_word[entries]] * self.doc_weight[entries])))
        ends = np.cumsum(end - begin)
        scores = (given[ends] - given[ends - (end - begin)]).round(6)
        good = (scores >= threshold - 1e-6) & (scores > 0)
        found = sorted([*best, *zip(scores[good].tolist(), self.doc_ids[docs[good]].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))
        return found[:k]


def _words(slim: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w for w, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))],
                ["doc_id", "words", "counts"],
            )

    return slim.mapInArrow(run, "doc_id long, words array<long>, counts array<int>")


def _counted(slim: DataFrame) -> DataFrame:
    """word, df, length: in how many documents each word is, and, where word is null, how many documents there are and how long they
    are together. Texts are read once for both; one task adds up its own words first, as many as fit."""

    def run(batches):
        words, n, documents, length = [], 0, 0, 0

        def out():
            found, df = np.unique(np.concatenate(words), return_counts=True)
            nothing = pa.nulls(len(found), pa.int64())
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["word", "df", "length"]) for columns in ((found, df, nothing), ([None], [documents], [length]))]

        for batch in batches:
            for text in batch.column(1).to_pylist():
                found, counts = terms(text)
                words.append(found)
                n, documents, length = n + len(found), documents + 1, length + int(counts.sum())
            if n > 4_000_000:
                yield from out()
                words, n, documents, length = [], 0, 0, 0
        if words:
            yield from out()

    return slim.mapInArrow(run, "word long, df long, length long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), doc_id, score. Both tables have an id and a text column of these names."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = lambda df: df.select(df[id_column].cast("long").alias("doc_id"), text_or_empty(text_column).alias("text")).where("doc_id is not null")
    slim, asked = plain(docs), plain(queries)
    counted = written(_counted(slim), "frequencies")
    sizes = counted.where("word IS NULL").first()
    n, mean = (sizes["df"], sizes["length"] / sizes["df"] or 1.0) if sizes else (0, 1.0)
    wanted = _words(asked).select("doc_id", F.explode("words").alias("word")).distinct()
    weights = wanted.join(counted, "word").select("doc_id", "word", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    prepared = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "idf"))).alias("terms")).select(F.col("doc_id").alias("query_id"), F.col("terms.word").alias("words"), F.col("terms.idf").alias("idfs"), F.lit(0.0).alias("least"))
    prepared = _asked(prepared)
    forget(counted)
    shards = max(1, -(-n // SHARD_DOCS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    if shards == 1:
        tops = written(_searched(slim.repartition(1), prepared, k, mean), "tops")
    else:
        in_first = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FIRST)) == 0
        first = written(_searched(slim.where(in_first).repartition(max(1, shards // FIRST)), prepared, k, mean), "tops")
        reached = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        again = _asked(prepared.join(reached, "query_id", "left").select("query_id", "words", "idfs", F.coalesce("reached", "least").alias("least")))
        rest = written(_searched(slim.where(~in_first).repartition(max(1, shards - shards // FIRST)), again, k, mean), "tops")
        forget(again)
        tops = first.unionByName(rest)
    forget(prepared)
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _asked(prepared: DataFrame) -> DataFrame:
    """Queries in row groups small enough to be streamed: query_id, words, idfs, least (the score below which nothing counts)."""
    path = f"{shared_folder(prepared.sparkSession)}/queries-{uuid.uuid4().hex}"
    prepared.write.option("parquet.block.size", 8 << 20).parquet(path)
    table = prepared.sparkSession.read.schema(prepared.schema).parquet(path)
    table.stored_at = path
    return table


def _searched(part: DataFrame, asked: DataFrame, k: int, mean: float) -> DataFrame:
    """query_id, doc_id, score: the k best of each index for each query. A partition of the documents makes an index, or several
    where its texts are long."""
    folder = asked.stored_at

    def queries():
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for info in store.get_file_info(fs.FileSelector(path)):
            if info.base_name.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(batch_size=256)

    def answered(ids, found):
        index = Index(np.array(ids, np.int64), [w for w, _ in found], [c for _, c in found], mean)
        found.clear()  # the index has them
        for batch in queries():
            names, words, idfs, least = (batch.column(i) for i in range(4))
            found = index.tops([w.values.to_numpy() for w in words], [i.values.to_numpy() for i in idfs], k, least.to_pylist())
            out = [(query_id, doc_id, score) for query_id, best in zip(names.to_pylist(), found, strict=True) for score, doc_id in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "doc_id", "score"])

    def run(batches):
        ids, found, entries = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                found.append(terms(text))
                entries += len(found[-1][0])
            if len(ids) >= 2 * SHARD_DOCS or entries >= SHARD_ENTRIES:
                yield from answered(ids, found)
                ids, found, entries = [], [], 0
        if ids:
            yield from answered(ids, found)

    return part.mapInArrow(run, "query_id long, doc_id long, score double")
