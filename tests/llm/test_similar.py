import numpy as np
import pytest

from folioforge.llm.similar import most_similar, similar_pairs


def planted(n=3000, dim=64, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 600, 3):  # near copies
        y = x[i] + rng.normal(size=dim) * 0.04
        x[i + 1] = y / np.linalg.norm(y)
    return x * rng.choice([1.0, 1.0, 3.5], (n, 1))


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "n") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, neighbour string")


def test_recall_against_brute_force(spark):
    x = planted()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    true = {(min(a, b), max(a, b)) for a, b in zip(*np.nonzero(s >= 0.9))}
    extra = [(9000, None, "n"), (9001, [0.0] * 64, "n"), (9002, [float("nan")] + [1.0] * 63, "n"), (9003, [1.0] * 32, "n"), (0, [float(v) for v in x[0]], "n")]
    # Small cells make the forest work as it does on large collections.
    found = most_similar(frame(spark, x, extra), "chunk_id", "embedding", min_similarity=0.9, cell=500, candidates=200).collect()
    got = {(min(r[0], r[1]), max(r[0], r[1])) for r in found}
    assert len(got & true) / len(true) >= 0.9 and got <= true
    pairs = {tuple(r) for r in similar_pairs(frame(spark, x, extra), "chunk_id", "embedding", 0.9).collect()}
    assert len(pairs & true) / len(true) >= 0.99 and pairs <= true


def test_k_ties_and_equal_vectors(spark):
    x = np.tile(np.eye(64)[0], (40, 1))
    out = most_similar(frame(spark, x), "chunk_id", "embedding", k=5).collect()
    assert len(out) == 200 and all(r["similarity"] == pytest.approx(1.0) for r in out)
    assert sorted(r["neighbour"] for r in out if r["chunk_id"] == 39) == [0, 1, 2, 3, 4]


def test_empty(spark):
    assert most_similar(frame(spark, np.zeros((0, 64))), "chunk_id", "embedding").count() == 0
    assert most_similar(frame(spark, np.zeros((3, 64))), "chunk_id", "embedding").count() == 0


def test_a_third_of_all_rows_near_equal(spark):
    """Near-equal rows are cut by their own differences: neighbours among them are found."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=32)
    hot = base + 0.02 * rng.normal(size=(3000, 32))
    x = np.concatenate((hot, rng.normal(size=(3000, 32))))
    x[1:3000:2] = x[0:3000:2] + 0.001 * rng.normal(size=(1500, 32))  # each has a twin
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    found = most_similar(df, "id", "v", k=3, cell=300)
    near = {(r["id"], r["neighbour"]) for r in found.collect()}
    twins = [(i, i ^ 1) in near for i in range(3000)]
    assert np.mean(twins) > 0.9


def test_a_crowd_of_equal_rows(spark):
    """Each of 1,500 equal rows gets the smallest keys; so does a row close to them; repeated rows and another crowd do not matter."""
    rng = np.random.default_rng(7)
    one, two = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, one.tolist()) for i in range(100, 1600)] + [(150, one.tolist())] + [(i, two.tolist()) for i in range(2000, 3200)]
    rows += [(9000, (one + 0.01 * two).tolist()), (9001, None), (9002, [0.0] * 16)] + [(9100 + i, [0.0] * 16) for i in range(1100)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = {}
    for r in most_similar(df, "id", "v", k=3, dim=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert len(got) == 1500 + 1200 + 1
    for i in [*range(100, 1600), *range(2000, 3200)]:
        low = 100 if i < 2000 else 2000
        assert [n for _, n in sorted(got[i])] == [j for j in range(low, low + 4) if j != i][:3]
    assert [n for _, n in sorted(got[9000])] == [100, 101, 102]


def test_recall_at_the_defaults_over_many_cells(spark):
    """No neighbour stands out, and the collection is cut into cells: nearly all are found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    s = x[::50] @ x.T
    s[np.arange(120), np.arange(0, 6000, 50)] = -9
    true = {(50 * a, int(b)) for a, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for b in row}
    found = most_similar(df, "id", "v", cell=1000)
    got = {(r["id"], r["neighbour"]) for r in found.filter("id % 50 = 0").collect()}
    assert len(got & true) / len(true) >= 0.95
    assert found.count() == 60_000
