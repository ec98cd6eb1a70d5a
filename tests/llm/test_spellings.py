import random
import re
import zlib
from collections import Counter

from hearthline.llm import queries
from hearthline.llm.spellings import counted, near_pairs, rarest, variants


def near(a, b):
    """One inserted, deleted or replaced letter, by trying."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deletions(word):
    return {word[:i] + "\0" + word[i + 1 :] for i in range(len(word))} | {word[:i] + "\0" + word[i:] for i in range(len(word) + 1)}


def brute_force(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                words[run] += 1
    words = {w: n for w, n in words.items() if n >= 2}
    pools = {}
    for w in words:
        for key in deletions(w):
            pools.setdefault(key, []).append(w)
    close = {w: {v for key in deletions(w) for v in pools[key] if v != w and near(v, w)} for w in words}
    form = {}
    for w, found in close.items():
        top = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 10 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, words[w], len(close[w]), form[w], words[form[w]] if form[w] else None, root))
    return rows


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def answer(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_cases(spark, docs_of):
    texts = [
        "Letters " * 300, "LETTERS lettters letterz xletters " * 3, "lettter lettters " * 2, None, "", "short word", "étéétéété " * 40,
        "étéétéét étééteété " * 2, "a" * 500 + " " + "a" * 500 + " " + "a" * 501 + " " + "a" * 501, "banananana bananana banananna " * 2,
        "x" * 40_000 + " " + "x" * 40_000, "abcdefg bcdefgh " * 2, "abcdefg abcdeft " * 2, "ÉTÉ Éclairs éclairs " * 2, "don't hyphen-ated under_scores digits9digits " * 2,
    ]
    ids = [*range(len(texts) - 2), None, 3]
    docs = docs_of(texts, ids).withColumnRenamed("score", "word").repartition(3)
    assert answer(variants(docs)) == brute_force(list(zip(ids, texts, strict=True)))
    assert variants(docs.limit(0)).collect() == []


def test_chains_and_ties(spark, docs_of):
    chain = {"abcdefgh": 2, "abcdefghi": 30, "abcdefghij": 400, "abcdefghijk": 6000, "zbcdefghijk": 6000, "abcdefghijz": 6000, "qwertyui": 20, "qwertyuo": 20, "qwertyup": 2}
    texts = [f"{w} " * n for w, n in chain.items()]
    docs = docs_of(texts)
    rows = answer(variants(docs))
    assert rows == brute_force(list(enumerate(texts)))
    assert {r[0]: r[5] for r in rows}["abcdefgh"] in {"abcdefghijk", "abcdefghijz"}


def test_prefix_filter_on_few_letters(spark):
    """Repeated bigrams, all edits, all places: no pair may be lost and none may come twice."""
    random.seed(5)
    words = {"".join(random.choice("ab") for _ in range(random.randint(7, 10))) for _ in range(400)}
    words |= {"".join(random.choice("abcé") for _ in range(7)) for _ in range(300)}
    got = [frozenset((r.a, r.b)) for r in near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    listed = sorted(words)
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[i + 1 :] if near(a, b)}


def test_rarest_first():
    assert rarest("banana", {"ba": 0, "an": 1, "na": 2}) == [(0, 0), (1, 1), (1, 3)]


def test_counts_add_up_over_tasks(spark, docs_of):
    docs = docs_of(["commonword " * 5] * 50).repartition(10)
    assert sum(r.n for r in counted(docs).collect()) == sum(n for _, n, *_ in brute_force([(i, "commonword " * 5) for i in range(50)]))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert answer(queries.op13_spellings(spark, "/root/testdata/sf0.001")) == brute_force(docs)
