import itertools
import random

import numpy as np

from folioforge.llm.packing import fill_containers, pack, token_sizes


def least_bins(sizes, capacity):
    """Brute force over all assignments."""
    best = len(sizes)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity:
                go(i + 1, loads[:k] + [loads[k] + sizes[i]] + loads[k + 1 :])
        go(i + 1, loads + [sizes[i]])

    go(0, [])
    return best


def test_against_brute_force():
    rng = random.Random(1)
    worse = 0
    for _ in range(150):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        bins = pack(np.array(sizes), 30)
        loads = np.bincount(bins, weights=sizes)
        assert loads.max() <= 30 and bins.min() == 0 and len(set(bins)) == bins.max() + 1
        worse += bins.max() + 1 - least_bins(sizes, 30)
    assert worse <= 5


def test_large_items_are_paired_as_well_as_can_be():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(11, 30) for _ in range(rng.randint(1, 9))]
        assert pack(np.array(sizes), 30).max() + 1 == least_bins(sizes, 30)


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 5000, "a"), (4, "short text", "a"), (4, "short text", "a"), (5, "naïve слово", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    sizes = token_sizes(df, "doc_id", "text")
    assert {r["doc_id"]: r["tokens"] for r in sizes.collect()}[2] == 0 and sizes.count() == 5
    out = fill_containers(sizes, "doc_id", "tokens", capacity=1000).collect()
    load = {}
    for r in out:
        load[r["shard"], r["container"]] = load.get((r["shard"], r["container"]), 0) + r["token_end"] - r["token_begin"]
    assert max(load.values()) <= 1000
    cut = sorted((r["piece_no"], r["token_begin"], r["token_end"]) for r in out if r["doc_id"] == 3)
    assert [c[0] for c in cut] == list(range(len(cut))) and all(a[2] == b[1] for a, b in itertools.pairwise(cut)) and len(cut) > 1
    assert all(r["piece_no"] == 0 for r in out if r["doc_id"] != 3)
    assert fill_containers(sizes.limit(0), "doc_id", "tokens").count() == 0


def test_containers_are_full(spark):
    """Sizes skewed like those of texts: nearly no space is left over, however the items are dealt to shards."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(np.maximum(rng.lognormal(4.6, 1.1, 6000).astype(int), 1), 9000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "id bigint, tokens int")
    for per_shard in (100_000, 1_500):
        out = fill_containers(df, "id", "tokens", capacity=2048, items_per_shard=per_shard)
        used = out.select("shard", "container").distinct().count()
        assert sizes.sum() / (2048 * used) > 0.98
        assert out.groupBy("id").sum("token_begin").count() == 6000
