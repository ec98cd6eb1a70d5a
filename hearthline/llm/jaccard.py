"""N-gram Jaccard join by a size-aware heavy-light scheme, and the components of its links.

A document's set holds the 64-bit hashes of its distinct shingles of SHINGLE words. Documents with equal sets are one node
from the start. Of the nodes, small sets enumerate all subsets of the sizes at which a partner of their size must agree;
large sets go into inverted lists, each by the first of its shingles in a global order (any pair at the threshold must share
one of those). The boundary is the largest size at which the subsets cost no more than the inverted lists, at the mean length
of a list. Small sets near it also go into the lists, to meet large ones.

The global order puts rare shingles first. Frequencies come from counts of all shingles of all documents in WIDTH counters: an
upper bound for each shingle. What a document has of its own comes first, so documents that only have a passage in common, or
copies that each changed much of one text, share no list at places at which a linked pair must (any order is right; this one
makes lists short). The bound also says into how many parts a list may have to be dealt, so that no task gets an unbounded list.

Members of a list are first compared with its head only, the member with the fewest rarer shingles, each with the one that it meets in most lists before others.
Then, in lists whose members are still in several components, pairs from different components are looked at that meet at places
that leave enough shingles to both, and all of them are compared, so no link that could join two components is missed. Links
within a component are not all listed. Comparisons are exact on the sets, which are rebuilt from the whole texts.

Null and empty texts have empty sets, which link with nothing; a text of fewer than SHINGLE words has one shingle. Null ids
link with nothing and have a null component. Rows that share an id are one node. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthline.llm.common import broadcast_up_to, forget, loaded, mixed, small_batches, text_or_empty, word_hashes, written
from hearthline.llm.components import components

SHINGLE = 5
#: Counters of the frequency bounds, and how far above the mean a counter must be for the lists of its shingles to be dealt in parts.
WIDTH, FREQUENT = 1 << 20, 2000
_SHIFT = np.uint64(64 - 20)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    words = word_hashes(data, _SPACE[data])[0]
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return mixed(np.array([(words * _FACTORS[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    n = len(words) - SHINGLE + 1
    total = words[:n] * _FACTORS[0]
    for k in range(1, SHINGLE):
        total += words[k : k + n] * _FACTORS[k]
    return np.unique(mixed(total))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of at least one shingle reach the threshold: 100 * intersection >= 75 * union."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 4 * small < 3 * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of subsets that a set of n must enumerate to meet sets of up to boundary: a pair whose larger set has m shingles
    has three quarters of m in common at least."""
    return sorted({-(-3 * m // 4) for m in range(n, min(boundary, 4 * n // 3) + 1)} | {-(-3 * n // 4)})


def boundary_by_cost(mean_list: float) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the inverted lists of the prefix. Subsets
    grow faster than prefixes, so the search ends after a few sizes in a row that cost more."""
    best, n = 0, 1
    while n <= best + 4:
        subsets = sum(comb(n, c) for c in subset_sizes(n, n + 1) if c <= n)
        if subsets <= (n - -(-3 * n // 4) + 1) * (1 + mean_list):
            best = n
        n += 1
    return best


class Frequencies:
    """Upper bounds of how many documents have a shingle."""

    def __init__(self, counts: np.ndarray) -> None:
        total = int(counts.sum())
        self.mean = total / WIDTH
        self.frequent = int(2 * self.mean) + FREQUENT
        self.counts = np.minimum(counts, 2**31 - 1).astype(np.int32)
        # prefixes hold the rarest quarter of all entries; what their lists hold beyond what evenly spread entries would
        ascending = np.sort(counts).astype(np.float64)
        held = np.cumsum(ascending)
        rarest = ascending[: int(np.searchsorted(held, held[-1] / 4)) + 1]
        self.mean_list = max(1.0, float((rarest**2).sum() / max(1.0, rarest.sum())) - self.mean)
        self.boundary = boundary_by_cost(self.mean_list)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.counts[(hashes >> _SHIFT).astype(np.int64)]

    def parts(self, bounds: np.ndarray) -> np.ndarray:
        """Into how many parts a list of such a bound is dealt."""
        return np.where(bounds > self.frequent, 1 + bounds // FREQUENT, 1)


def postings(found: np.ndarray, use: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a set: the hashes of its inverted lists, rarest first, those of its subsets, and into how many parts each of both is
    dealt. From list number i on, n - i shingles are left."""
    n = len(found)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lists, subsets = none, none
    if n and 3 * (use.boundary + 1) <= 4 * n:
        bounds = use.of(found)
        first = n - -(-3 * n // 4) + 1
        order = np.argsort(bounds, kind="stable")[:first]  # ties by hash, as the set is sorted
        lists = found[order], use.parts(bounds[order])
    if 0 < n <= use.boundary:
        bounds, keys, parts = use.of(found), [], []
        for size in subset_sizes(n, use.boundary):
            if size <= n:
                rows = np.array(list(combinations(range(n), size)))
                keys.append(mixed(mixed(found[rows] ^ _FACTORS[1]).sum(axis=1, dtype=np.uint64) + np.uint64(size)))
                parts.append(use.parts(bounds[rows].min(axis=1)))
        subsets = np.concatenate(keys), np.concatenate(parts)
    return *lists, *subsets


def _sized(slim: DataFrame) -> DataFrame:
    """Per document: id, n, two hashes of its set; per task a row of its counters, with a null id."""

    def run(batches):
        counts, any_row = np.zeros(WIDTH, np.int32), False
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n.append(len(found))
                first.append(found.sum(dtype=np.uint64))
                second.append(np.bitwise_xor.reduce(mixed(found * _FACTORS[2])) if len(found) else np.uint64(0))
                np.add.at(counts, (found >> _SHIFT).astype(np.int64), 1)
                any_row = True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                ["doc_id", "n", "k1", "k2", "task", "counts"],
            )
        if any_row:
            nothing = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([counts.astype("<i4").tobytes()])], ["doc_id", "n", "k1", "k2", "task", "counts"])

    return slim.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, task int, counts binary")


def _frequencies(sized: DataFrame) -> str:
    """Where the counters of all tasks lie, added up in levels of sixteen; they don't pass the driver."""
    parts = sized.where("counts is not null").select("task", "counts")

    def added(frame):
        total = np.zeros(WIDTH, np.int64)
        for row in frame["counts"]:
            total += np.frombuffer(row, "<i4")
        return frame.iloc[:1].assign(task=frame["group"].iloc[0], counts=[np.minimum(total, 2**31 - 1).astype("<i4").tobytes()])[["task", "counts"]]

    n = parts.count()
    while True:
        n = -(-n // 16)
        parts = written(parts.withColumn("group", F.pmod("task", F.lit(max(1, n))).cast("int")).groupBy("group").applyInPandas(added, "task int, counts binary"), "counts")
        if n <= 1:
            return parts.stored_at


@lru_cache(maxsize=1)
def _use(path: str) -> Frequencies:
    rows = loaded(path).column("counts").to_pylist()
    return Frequencies(np.frombuffer(rows[0], "<i4").astype(np.int64) if rows else np.zeros(WIDTH, np.int64))


def _lists(slim: DataFrame, nodes: DataFrame, counters: str) -> DataFrame:
    """List entries of the nodes, of lists that have several: key, part, node, n, rest, and the part's head."""

    def run(batches):
        use = _use(counters)  # WIDTH counters, whatever the corpus
        for batch in batches:
            keys, subsets, parts, n = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                k, p, sub, q = postings(found, use)
                both = np.concatenate([p, q]).astype(np.int32)
                keys.append(k.view(np.int64)), subsets.append(sub.view(np.int64)), parts.append(both if (both > 1).any() else None), n.append(len(found))
            lists = lambda x, kind: pa.array(x, pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), lists(keys, pa.int64()), lists(subsets, pa.int64()), lists(parts, pa.int32())], ["doc_id", "n", "keys", "subsets", "parts"])

    entries = slim.mapInArrow(run, "doc_id long, n int, keys array<long>, subsets array<long>, parts array<int>")
    entries = entries.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    flat = entries.select(F.col("doc_id").alias("node"), "n", "parts", F.size("keys").alias("first"), F.posexplode(F.concat("keys", "subsets")).alias("i", "key"))
    parts = F.coalesce(F.get("parts", F.col("i")), F.lit(1))
    place = F.when(F.col("i") < F.col("first"), F.col("i")).otherwise(0)
    part = F.when(parts > 1, 1 + F.pmod(F.xxhash64("node"), parts.cast("long"))).otherwise(F.lit(0)).cast("int")
    # few and narrow columns are shuffled: the place in the upper half, n in the lower
    dealt = flat.select("key", part.alias("part"), "node", (F.shiftleft(place.cast("long"), 32) + F.col("n")).alias("at"))
    # the head of a list is the entry with the fewest rarer shingles before it: of copies, one that changed least
    one = Window.partitionBy("key", "part")
    headed = dealt.select("*", F.min(F.struct("at", "node")).over(one).alias("first"), F.min("node").over(one).alias("low"), F.max("node").over(one).alias("high"))
    several = headed.where((F.col("low") < F.col("high")) | (F.col("part") > 0))
    n = lambda at: at.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    rest = lambda at: (n(at) - F.shiftright(at, 32)).cast("int")
    head = F.struct(F.shiftright("first.at", 32).alias("place"), F.col("first.node").alias("node"), n(F.col("first.at")).alias("n"), rest(F.col("first.at")).alias("rest"))
    return several.select("key", "part", "node", n(F.col("at")).alias("n"), rest(F.col("at")).alias("rest"), head.alias("head"))


#: Sizes are classed by powers of this.
CLASS = 1.05


def _class(n):
    return F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")


def _partners(n, rest):
    """The classes of sizes that a partner of an entry may have: near enough, and small enough for what is left from the entry on."""
    low, high = _class(0.75 * n), _class(F.least(n / 0.75, 7 * rest / 3 - n))
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _close(a, b):
    """What a pair that meets in a list must fulfil: sizes near enough, and enough shingles left from the first common one on."""
    return 7 * F.least(a["rest"], b["rest"]) >= 3 * (a["n"] + b["n"])


#: So many likely partners of a node are compared before all that remain.
FEW = 8
#: So many shingles of compared documents are kept by a task.
KNOWN = 1_000_000
#: The ids of documents whose texts are compared are broadcast up to so many, and joined beyond.
BROADCAST_ROWS = 500_000


def _verified(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold."""
    pairs = written(pairs.select("a", "b"), "pairs")
    wanted = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    texts = slim.join(broadcast_up_to(wanted, BROADCAST_ROWS), "doc_id", "left_semi")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        known: dict[str, np.ndarray] = {}  # sets of the last texts (an id may have several); rows come sorted by one of both ids
        room = KNOWN

        def of(text):
            nonlocal room
            if text not in known:
                if room < 0:
                    known.clear()
                    room = KNOWN
                known[text] = shingles(text)
                room -= len(known[text])
            return known[text]

        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([linked(of(s), of(t)) for s, t in zip(x, y, strict=True)], pa.bool_()))

    out = written(both.mapInArrow(run, "a long, b long"), "links")
    forget(pairs, wanted)
    return out


def links_and_nodes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with the hashes of their sets; sets and their nodes; links between nodes, enough for all components; components)."""
    small_batches(docs.sparkSession)
    slim = docs.select(docs[id_column].cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    sized = written(_sized(slim), "sized")
    real = sized.where("n is not null").select("doc_id", "n", "k1", "k2")
    sets = written(real.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")), "sets")
    lists = written(_lists(slim.where("doc_id is not null"), sets, _frequencies(sized)), "lists")

    entry = F.struct("node", "n", "rest")
    to_head = lambda rows: rows.where("head.node <> node").where(_close(F.col("head"), entry)).select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    # the heads of the parts of a list that was dealt
    heads = lists.where("part > 0 and node = head.node").select("key", "node", "n", "rest").distinct()
    main = heads.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("place"), "node", "n", "rest")).alias("head"))
    first = written(to_head(lists).unionByName(to_head(heads.join(main, "key"))).groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
    same = real.where("n > 0 and doc_id is not null").join(sets.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    several = same.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least <> most")
    shared_ids = same.join(several, "a").where("b <> least").select(F.col("least").alias("a"), "b").distinct()
    # each node with the one that it meets as the head of most lists
    best = written(first.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("top")).select("top.a", "b"), "best")
    links = written(_verified(best, slim).unionByName(shared_ids), "links")
    found = written(components(links), "components")

    open_lists = lists.join(broadcast_up_to(found, BROADCAST_ROWS), "node", "left").select("key", "node", "n", "rest", F.coalesce("component", "node").alias("component"))
    sizes = open_lists.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("several")).where("several > 1").select("key", F.col("top.component").alias("main"))
    members = written(open_lists.join(main, "key").withColumn("in_main", F.col("component") == F.col("main")).drop("main"), "members")
    forget(lists)
    # a list is joined by the sizes that a pair may have, so entries that are too different, or too late in their sets, never meet
    sized_members = members.withColumn("class", _class(F.col("n")))
    x, y = members.where("not in_main").withColumn("class", F.explode(_partners(F.col("n"), F.col("rest")))).alias("x"), sized_members.alias("y")
    once = F.col("y.in_main") | (F.col("x.node") < F.col("y.node"))
    x_y = lambda kind, column: kind(f"x.{column}", f"y.{column}")
    near_places = 7 * x_y(F.least, "rest") >= 3 * (F.col("x.n") + F.col("y.n"))
    crossed = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & once & near_places)
    counted = crossed.groupBy(x_y(F.least, "node").alias("a"), x_y(F.greatest, "node").alias("b")).agg(F.count("*").alias("shared"), F.min("x.node").alias("of"))
    second = written(counted.join(best, ["a", "b"], "left_anti"), "pairs")
    forget(members, first, best)
    links, found = _settled(second, links, found, slim)
    return real, sets, links, found


def _settled(pairs: DataFrame, links: DataFrame, found: DataFrame, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components after the pairs (a, b, shared, of): first for each node of the smaller side the few that it
    shares most lists with, then all pairs that are still apart."""
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("shared"), "a", "b"))
    for few in (FEW, None):
        of = broadcast_up_to(found, BROADCAST_ROWS)
        side = lambda column: of.select(F.col("node").alias(column), F.col("component").alias(f"of_{column}"))  # noqa: B023, E731
        apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        apart = written(apart.select("a", "b", "shared", "of"), "pairs")
        if few is None:
            links, found = _joined(links, found, _verified(apart, slim))
            forget(pairs, apart)
            return links, found
        some = written(apart.withColumn("rank", rank).where(F.col("rank") <= few).select("a", "b"), "best")
        links, found = _joined(links, found, _verified(some, slim))
        forget(pairs)
        pairs = written(apart.join(some, ["a", "b"], "left_anti"), "pairs")
        forget(apart, some)
    return links, found


def _joined(links: DataFrame, found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    if more.isEmpty():
        return links, found
    links = links.unionByName(more)
    again = written(components(links), "components")
    forget(found)
    return links, again


def clustered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, n_shingles, component_id (the least id reachable by links)."""
    real, sets, _, found = links_and_nodes(docs, id_column, text_column)
    named = sets.join(found, "node", "left").select("k1", "k2", F.col("n").alias("of"), F.coalesce("component", "node").alias("component"))
    linked_rows = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = real.where(linked_rows).join(named.withColumnRenamed("of", "n"), ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rest = real.where(~linked_rows).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    both = out.unionByName(rest)
    return both if id_column == "doc_id" else both.withColumnRenamed("doc_id", id_column)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of their component, one row for each id; rows with null ids stay."""
    found = written(clustered(docs, id_column, text_column), "clustered")
    same = F.col(id_column) == F.col("component_id")
    gone = written(found.where(~same).select(F.col(id_column).cast(docs.schema[id_column].dataType)).distinct(), "gone")  # fewer than stay
    stay = docs.where(F.col(id_column).isNotNull()).join(broadcast_up_to(gone, BROADCAST_ROWS), id_column, "left_anti")
    if not found.where(same).groupBy(id_column).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        stay = stay.dropDuplicates([id_column])
    return stay.select(*docs.columns).unionByName(docs.where(F.col(id_column).isNull()))
