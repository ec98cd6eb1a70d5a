import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402
from hearthline.llm.common import written  # noqa: E402


def corpus(rng):
    words = ["".join(rng.choice(["an", "the", "or", "in", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        body = [rng.choice(words) for _ in range(rng.randint(8, 80))]
        if not good:
            body = [w + "***" for w in body]
        if i % 10 == 9:
            body = rows[i - 8][1].split() if rows[i - 8][1] else body
            good = (i - 8) % 4 != 0
        if i % 50 == 2:
            body.insert(3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')
        rows.append((i, " ".join(body), "en", "src0", 0))
        labels.append((i, int(good), 0))
    return rows + [(None, "one two three four five six seven", "en", "src0", 0), (900, None, None, None, None)], labels


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = corpus(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = {i for i, q, _ in labels if q}
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, str(tmp_path)))
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        seen.append(out.collect())
    first, second, third, packed = seen
    kept = {r.doc_id for r in first if r.doc_id is not None and r.doc_id < 900}
    assert len(kept ^ good) < 10
    texts = {r.text for r in first if r.doc_id is not None}
    ids = [r.doc_id for r in second]
    assert len(ids) == len(set(ids)) and None in ids and 900 in ids
    assert {r.text for r in second if r.doc_id is not None} == texts
    assert {r.doc_id for r in third} == set(ids)
    assert not any("04dbebab" in (r.text or "") for r in third) and any("[SECRET]" in (r.text or "") for r in third)
    assert all(r.text is None or r.n_chars == len(r.text) for r in third)
    assert {r.doc_id for r in packed} == set(ids)
    whole = P.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in whole) == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in packed)


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def test_against_brute_force(spark, tmp_path):
    """Every stage by plain Python on what the stage before kept: scores one by one, all pairs of sets, the secrets' patterns, and the
    pieces of each document; with null ids and texts, empty and long texts, repeated rows and an extra column."""
    from tokenizers import Tokenizer

    import test_secrets as plain
    from hearthline.llm import quality
    from hearthline.llm.queries import tokenizer_file

    rng = random.Random(7)
    rows, labels = corpus(rng)
    rows = rows[:240] + rows[-2:] + [rows[3], (901, "", "en", "s", 0), (902, "long " + " ".join(rng.choice(["an", "or", "the"]) + str(i) for i in range(6000)), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("rows", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).load()
    kept = [r for r in rows if model.score(r[1] or "") >= 0.5]
    found = {}
    for r in kept:
        if r[0] is not None:
            found.setdefault(r[0], r)
    ids, sets = sorted(found), {i: sets_of(found[i][1]) for i in found}
    least = {i: i for i in ids}
    for _ in ids:  # least reachable id, by passing it on along links
        before = dict(least)
        for i in ids:
            for j in ids:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
        if before == least:
            break
    single = [found[i] for i in ids if least[i] == i] + [r for r in kept if r[0] is None]
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for r in single:
        text, at, out = r[1] or "", 0, ""
        for _, start, end in plain.everything(text):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        n = len(tokenizer.encode(out + text[at:], add_special_tokens=False).ids) + 1
        want += [(str(r[0]), k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    packed = P.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in packed) == sorted(want)
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
