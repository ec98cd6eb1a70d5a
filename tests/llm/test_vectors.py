import numpy as np
import pytest

from hearthline.llm import vectors as V


def expected(rows, threshold=0.98):
    ok = [i for i, (vec_id, v, label) in enumerate(rows) if vec_id is not None and label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(range(len(rows)), 0)
    for k, i in enumerate(ok):
        for j in ok[:k]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted((-1 if r[0] is None else r[0], links[i], -1 if r[0] is None else least[find(i)] if i in ok else r[0]) for i, r in enumerate(rows))


def make(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")


@pytest.mark.parametrize("tile, block", [(1024, 512), (16, 8)])
def test_against_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "RECALL", 1 - 1e-9)
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(40):
        center = rng.standard_normal(32)
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            vectors.append((center + rng.uniform(0, 0.15) * rng.standard_normal(32)) * rng.uniform(0.1, 9))
    vectors += [vectors[0]] * 30
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))) for i, v in zip(rng.permutation(5000)[: len(vectors)].tolist(), vectors)]
    rows += [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [None] + [1.0] * 31, 1), (9005, [float("inf")] * 32, 0), (9006, rows[0][1], None), (None, rows[0][1], 1), (9007, [1.0], 1), (9008, [2.0], 1), (9009, [], 1), (9010, rows[5][1], rows[5][2]), (9010, rows[5][1], rows[5][2])]
    out = V.near_duplicates(make(spark, rows)).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == expected(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    assert V.near_duplicates(make(spark, rows).limit(0)).count() == 0


def test_estimate_is_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = V.unit(rng.standard_normal((300, 64))), V.unit(rng.standard_normal((300, 64)))
    turn = V.rotations(64, 1)[0].T
    code = np.sign(x @ turn) / 8
    estimate = (code @ (y @ turn).T) / np.abs(x @ turn).sum(axis=1, keepdims=True) * 8
    assert abs((estimate - x @ y.T).mean()) < 0.003
    near = V.unit(x + 0.02 * rng.standard_normal(x.shape))
    assert V.possible(x, near, 0.98).diagonal()[np.einsum("ij,ij->i", x, near) >= 0.98].all()
    assert V.possible(x, y, 0.98).mean() < 0.01


def test_bands_meet_the_recall():
    for n in (100, 10_000, 10**9):
        bits, bands = V.plan(n, 0.98)
        if bits:
            meets = (1 - np.arccos(0.98) / np.pi) ** bits
            assert 1 - (1 - meets) ** bands >= V.RECALL


def test_recall_of_planted_pairs_at_production_settings(spark):
    rng = np.random.default_rng(4)
    dim, n = 64, 6000
    x = V.unit(rng.standard_normal((n, dim)))
    planted = 1500
    for k in range(planted):  # rows 2k and 2k + 1 at a cosine from 0.9801 to 0.999
        other = rng.standard_normal(dim)
        other -= (other @ x[2 * k]) * x[2 * k]
        cosine = rng.uniform(0.9801, 0.999)
        x[2 * k + 1] = cosine * x[2 * k] + np.sqrt(1 - cosine**2) * other / np.sqrt(other @ other)
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    similar = np.einsum("ij,kj->ik", x, x) >= 0.98
    np.fill_diagonal(similar, False)
    got = {r.vec_id: r.n_links for r in V.near_duplicates(rows).collect()}
    found = sum(got.values())
    assert all(got[i] <= similar[i].sum() for i in range(n))
    assert similar.sum() >= 2 * planted and found >= 0.998 * similar.sum()


@pytest.mark.parametrize("dim", [1, 3, 64, 100, 130])
def test_stored_codes_say_what_the_turned_vectors_say(dim):
    rng = np.random.default_rng(dim)
    x, y = V.unit(rng.standard_normal((40, dim))), V.unit(rng.standard_normal((30, dim)))
    a, b = V.encoded(x), V.encoded(y)
    turn = V.rotations(dim, 1)[0].T
    level = sum((np.unpackbits(b.planes[:, p].copy().view(np.uint8), axis=1, bitorder="little")[:, :dim].astype(int) << p) for p in range(V.PLANES))
    rounded = b.stats[:, 1:2] + b.stats[:, 2:3] * level
    assert np.allclose(np.linalg.norm(rounded - y @ turn, axis=1), b.stats[:, 3])
    code = np.where(x @ turn >= 0, 1, -1) / np.sqrt(dim)
    assert np.allclose((code * (x @ turn)).sum(axis=1), a.stats[:, 0])
    for threshold in (-0.5, 0.0, 0.5, 0.9):
        factor = a.stats[:, :1]
        bound = V.EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1))) + b.stats[:, 3] / factor
        assert (V.open_pairs(a, b, threshold) == (code @ rounded.T / factor + bound >= threshold - 1e-6)).mean() > 0.999
        assert V.open_pairs(a, b, threshold)[x @ y.T >= threshold].all()
    assert len(a.signs[0].tobytes() + a.planes[0].tobytes() + a.stats[0].tobytes()) == (1 + V.PLANES) * 8 * -(-dim // 64) + 32
