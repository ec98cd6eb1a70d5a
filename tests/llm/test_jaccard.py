import random
import re

import numpy as np

from hearthline.llm import jaccard as J
from hearthline.llm.components import components


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(ids, texts):
    sets = [sets_of(t) for t in texts]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in zip(ids, sets, strict=True):
        if i is not None:
            find(i)
    for k, (i, a) in enumerate(zip(ids, sets, strict=True)):
        for j, b in zip(ids[:k], sets[:k], strict=True):
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((-1 if i is None else i), len(s), -1 if i is None else find(i)) for i, s in zip(ids, sets, strict=True))


def near_copies(rng, words, n_groups, longest):
    texts = []
    for _ in range(n_groups):
        body = [rng.choice(words) for _ in range(rng.randint(1, longest))]
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            copy = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[rng.choice(words)], [], [copy[k], rng.choice(words)]])
                if not copy:
                    copy = ["x"]
            texts.append(rng.choice([" ", "\n", " \t "]).join(copy))
    return texts


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert sorted(map(tuple, rows)) == sorted((x, find(x)) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_all_pairs(spark, docs_of, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 6)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)] + ["É", "Th", "th"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n", "one", "ONE", "one two", "x " * 30_000, "x y " * 9_000] + near_copies(rng, words, 60, 90) + near_copies(rng, words, 40, 14)
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    ids = rng.sample(range(10_000), len(texts))
    ids[9] = ids[10]
    ids[11] = None
    want = expected(ids, texts)
    docs = docs_of(texts, ids).repartition(3)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in J.clustered(docs).collect())
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 40
    assert J.clustered(docs_of([])).count() == 0


def test_candidates_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    for boundary in (0, 5, 8, 12):
        use = J.Frequencies(rng.integers(0, 9000, J.WIDTH))
        use.boundary = boundary
        for _ in range(400):
            common = J.mixed(rng.integers(1, 1 << 60, rng.integers(1, 30)).astype(np.uint64))
            extra = J.mixed(rng.integers(1, 1 << 60, rng.integers(0, len(common) // 3 + 1)).astype(np.uint64))
            cut = rng.integers(0, len(extra) + 1)
            a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
            if not J.linked(a, b):
                continue
            met = []
            (ka, pa, sa, qa), (kb, pb, sb, qb) = J.postings(a, use), J.postings(b, use)
            for i, k in enumerate(ka):
                met += [7 * min(len(a) - i, len(b) - j) >= 3 * (len(a) + len(b)) and pa[i] == pb[j] for j in np.flatnonzero(kb == k)]
            for i, k in enumerate(sa):
                met += [qa[i] == qb[j] for j in np.flatnonzero(sb == k)]
            assert any(met)


def test_ids_with_several_texts_in_any_order(spark, docs_of):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    a, b, c = ([rng.choice(words) for _ in range(60)] for _ in range(3))
    near = lambda t, i: " ".join(t[:-i] + [f"new{i}"] * i)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(b, 1)), (11, near(a, 2)), (5, " ".join(c)), (20, near(c, 1)), (21, near(c, 1)), (30, "apart " * 3)]
    for some in (rows, rows[::-1], rows[3:] + rows[:3]):
        ids, texts = zip(*some, strict=True)
        got = {(r.doc_id, r.component_id) for r in J.clustered(docs_of(texts, ids)).collect()}
        assert got == {(5, 5), (9, 5), (11, 5), (20, 5), (21, 5), (30, 30)}


def test_shared_ids_against_all_pairs(spark, docs_of):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(200)]
    texts = near_copies(rng, words, 40, 50)
    ids = [rng.randint(0, len(texts) // 2) for _ in texts]
    got = sorted(tuple(r) for r in J.clustered(docs_of(texts, ids).repartition(3)).collect())
    assert got == expected(ids, texts)


def test_partner_classes_hold_all_that_may_link(spark):
    entries = spark.range(1, 90).selectExpr("cast(id AS int) AS n").selectExpr("n", "explode(sequence(0, n - cast(ceil(0.75 * n) AS int))) AS place").selectExpr("n", "n - place AS rest")
    classes = {(r.n, r.rest): set(r.c) for r in entries.select("n", "rest", J._partners(J.F.col("n"), J.F.col("rest")).alias("c")).collect()}
    own = {r.n: r.c for r in entries.select("n", J._class(J.F.col("n")).alias("c")).distinct().collect()}
    for (n, rest), found in classes.items():
        for m in own:
            if 4 * min(n, m) >= 3 * max(n, m) and 7 * min(rest, m) >= 3 * (n + m):
                assert own[m] in found


def test_documents_of_one_template(spark, docs_of):
    """A long passage in common, too little to link: none of the pairs that share it is compared."""
    rng = random.Random(6)
    template = " ".join(f"t{rng.randint(0, 999)}" for _ in range(200))
    texts = [template + " " + " ".join(f"own{i}x{k}" for k in range(75)) for i in range(300)] + [template + " own0x0 own0x1"] * 2
    got = {r.doc_id: r.component_id for r in J.clustered(docs_of(texts)).collect()}
    assert [got[i] for i in range(300)] == list(range(300)) and got[300] == got[301] == 300
