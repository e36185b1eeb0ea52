"""Most similar vectors for every vector (problem 1).

A hash-prefix forest: each tree holds the vectors as a sorted array of long hash
strings (signs of projections).  Some trees order the whole collection and cut
it, at quantiles, into cells of about ``CELL`` vectors; inside a cell a worker
grows further trees, descends to the longest matching prefixes and ascends all
trees at once, one letter at a time, until a vector has enough candidates, which are
compared exactly.

The cuts and the centre are fitted on a bounded sample (``SAMPLE`` rows); every
row is indexed.  ``min_similarity`` leaves out neighbours below it.

A cell that the sample shows to hold far more than its share (near-equal vectors)
is cut further by hash strings about its own centre.  Of more than ``CROWD`` equal
vectors the k + 1 smallest keys stand for all; the others' neighbours are the
smallest keys of their crowd, as ties go to the smaller key.

Defined results: null, zero, NaN-holding vectors and those of another length than
``dim`` are no members; repeated rows of a key count once; equal vectors are
neighbours of similarity 1, ties go to the smaller key; an empty table gives an
empty result; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.shared import cut
from folioforge.shared import spread as dealt

K = 10
ORDERINGS = 6  # trees that order the whole collection
TREES = 8  # trees grown in each cell
BITS = 24
CELL = 32_768
CANDIDATES = 1_500  # where only neighbours of a high similarity are asked for
SAMPLE = 20_000
PROBES = 2  # further cells of each ordering that the rows which ask are sent to
SEED = 5
CROWD = 1_000  # equal vectors above which a few stand for all
CROWDS_SENT = 100_000  # crowds sent to every task; more are joined by shuffle
CELLS_PER_TASK = 1


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    """Random directions, orthogonal within each block of ``dim``."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(blocks, axis=1)[:, :count].astype(np.float32)


def codes(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hash strings as numbers, first letter highest."""
    bits = (x @ directions > 0).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(directions.shape[1] - 1, -1, -1, dtype=np.int64))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are valid, and those as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    ok = (sizes == dim) & np.asarray(column.is_valid())
    starts = column.offsets.to_numpy()[:-1][ok]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat[starts[:, None] + np.arange(dim)] if len(starts) else np.zeros((0, dim), dtype=np.float32)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    rows = np.flatnonzero(ok)[good]
    return rows, (x[good] / norm[good][:, None]).astype(np.float32)


def forest_pairs(
    keys: np.ndarray, x: np.ndarray, centre: np.ndarray, k: int, min_similarity: float | None, trees: int, candidates: int, seed: int,
    asks: np.ndarray | None = None, stored: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour row, similarity) of the k most similar candidates of each row that asks, among the stored ones."""
    n = len(x)
    asks = np.ones(n, dtype=bool) if asks is None else asks
    stored = np.ones(n, dtype=bool) if stored is None else stored
    bits = min(BITS, max(1, int(np.ceil(np.log2(max(2, n)))) + 4))
    shifted = x - centre
    orders, sorted_codes = [], []
    for t in range(trees):
        c = codes(shifted, planes(x.shape[1], bits, seed + 31 * t))
        order = np.argsort(c, kind="stable")
        orders.append(order)
        sorted_codes.append(c[order])
    # Synchronous ascent: the longest prefix length at which a row has enough candidates in all trees together.
    level = np.full(n, -1, dtype=np.int64)
    for length in range(bits, -1, -1):
        total = np.zeros(n, dtype=np.int64)
        for order, c in zip(orders, sorted_codes):
            p = c >> (bits - length)
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            sizes = np.diff(np.append(first, n))
            total[order] += np.repeat(sizes, sizes)
        level[(level < 0) & ((total >= candidates) | (length == 0))] = length
        if (level >= 0).all():
            break
    found_a, found_b, found_s = [], [], []
    for order, c in zip(orders, sorted_codes):
        of = level[order]
        for length in np.unique(of):
            p = c >> (bits - int(length))
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            ends = np.append(first[1:], n)
            wanted = np.add.reduceat(((of == length) & asks[order]).astype(np.int64), first)
            for g in np.flatnonzero(wanted):
                low, high = first[g], ends[g]
                members = order[low:high]
                queries = members[(of[low:high] == length) & asks[members]]
                members = members[stored[members]]
                for q0 in range(0, len(queries), 2048):
                    q = queries[q0 : q0 + 2048]
                    for m0 in range(0, len(members), 8192):
                        m = members[m0 : m0 + 8192]
                        s = x[q] @ x[m].T
                        if min_similarity is not None:
                            a, b = np.nonzero(s >= min_similarity)
                        else:
                            take = min(k + 1, len(m))
                            b = np.argpartition(-s, take - 1, axis=1)[:, :take].ravel()
                            a = np.repeat(np.arange(len(q)), take)
                        v = s[a, b]
                        a, b = q[a], m[b]
                        keep = keys[a] != keys[b]
                        found_a.append(a[keep])
                        found_b.append(b[keep])
                        found_s.append(v[keep])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    a, b, s = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_s)
    _, once = np.unique(a * n + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    order = np.lexsort((keys[b], -np.round(s, 5), a))
    a, b, s = a[order], b[order], s[order]
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return a[rank < k], b[rank < k], s[rank < k]


class Layout:
    """Centre and cell boundaries of each ordering, from a sample."""

    def __init__(self, sample: np.ndarray, rows: int, dim: int, orderings: int, cell: int):
        self.dim, self.orderings = dim, orderings
        self.centre = sample.mean(0) if len(sample) else np.zeros(dim, dtype=np.float32)
        self.directions = [planes(dim, 48, SEED + 1000 * t) for t in range(orderings)]
        self.bounds: list[np.ndarray] = []
        self.finer: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = []  # centre, directions and cuts of overfull cells
        cells = max(1, -(-rows // cell))
        for t, d in enumerate(self.directions):
            c = codes(sample - self.centre, d) if len(sample) else np.zeros(0, np.int64)
            cuts = self._cuts(c, cells)
            self.bounds.append(cuts)
            at = np.searchsorted(cuts, c, side="right")
            held = np.bincount(at, minlength=len(cuts) + 1)
            self.finer.append({})
            for full in np.flatnonzero(held * rows > 4 * cell * max(1, len(c))):
                own = sample[at == full]
                centre, further = own.mean(0), planes(dim, 48, SEED + 1000 * t + 500)
                parts = min(1 << 15, int(held[full] * rows / (cell * len(c))))
                self.finer[t][int(full)] = (centre, further, self._cuts(codes(own - centre, further), parts))

    @staticmethod
    def _cuts(c: np.ndarray, cells: int) -> np.ndarray:
        c = np.sort(c)
        return np.unique(c[(np.arange(1, cells) * len(c)) // cells]) if len(c) and cells > 1 else np.zeros(0, np.int64)

    def cells(self) -> int:
        return sum(len(b) + 1 + sum(len(f[2]) for f in finer.values()) for b, finer in zip(self.bounds, self.finer))

    def near(self, x: np.ndarray, t: int, probes: int) -> list[np.ndarray]:
        """Up to ``probes`` further cells of each row in one ordering: those reached by turning its least certain letters; -1 for none."""
        letters = min(48, max(1, int(np.ceil(np.log2(len(self.bounds[t]) + 1))) + 1))
        d = self.directions[t]
        margin = (x - self.centre) @ d
        own = codes(x - self.centre, d)
        doubt = np.argsort(np.abs(margin[:, :letters]), axis=1)
        seen = [np.searchsorted(self.bounds[t], own, side="right")]
        out = []
        for pick in range(1, 1 << min(letters, 6)):
            turned = own.copy()
            for j in range(min(letters, 6)):
                if pick >> j & 1:
                    turned ^= np.int64(1) << (47 - doubt[:, j])
            cell = np.searchsorted(self.bounds[t], turned, side="right")
            fresh = np.all([cell != s for s in seen], axis=0)
            if len(out) < probes:
                out.append(np.where(fresh, cell, -1))
                seen.append(cell)
            else:
                for o in out:
                    late = fresh & (o < 0)
                    o[late] = cell[late]
                    fresh &= ~late
                seen.append(cell)
        return out

    def parts(self, x: np.ndarray, t: int, cell: np.ndarray) -> np.ndarray:
        """The part of its cell that each row is in: 0 but in overfull cells."""
        out = np.zeros(len(x), dtype=np.int64)
        for full, (centre, further, cuts) in self.finer[t].items():
            here = np.flatnonzero(cell == full)
            if len(here):
                out[here] = np.searchsorted(cuts, codes(x[here] - centre, further), side="right")
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row in each ordering: one number, rows x orderings."""
        out = np.empty((len(x), self.orderings), dtype=np.int64)
        shifted = x - self.centre
        for t in range(self.orderings):
            cell = np.searchsorted(self.bounds[t], codes(shifted, self.directions[t]), side="right")
            out[:, t] = (t << 44) + (cell.astype(np.int64) << 16) + self.parts(x, t, cell)
        return out


def _crowds(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows that stand for themselves, and (id, firsts) of the others; None where no vector is held by many."""
    hashed = rows.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b")))
    often = hashed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("h")
    often = cut(often, "crowds")
    many = often.count()
    if not many:
        return None
    send = F.broadcast if many <= CROWDS_SENT else lambda d: d
    members = hashed.select("h", "id").join(send(often), "h").distinct()
    order = Window.partitionBy("h").orderBy("id")
    first = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    first = cut(first.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("firsts")), "crowd-firsts")
    placed = hashed.join(send(first), "h", "left")
    follows = F.col("firsts").isNotNull() & (F.col("id") > F.element_at("firsts", -1))
    alone = placed.filter(~F.coalesce(follows, F.lit(False))).select(*rows.columns)
    return alone, placed.filter(follows & F.col("ask")).select("id", "firsts").distinct()


def most_similar(
    df: DataFrame, key: str, vector: str, k: int = K, min_similarity: float | None = None, dim: int | None = None, orderings: int = ORDERINGS, trees: int = TREES, candidates: int = CELL, cell: int = CELL,
    asking: Column | None = None, probes: int = PROBES,
) -> DataFrame:
    """key, neighbour, similarity, rank: the k most similar other keys of every key found by the forest.

    ``asking``: only rows for which it holds ask for neighbours (all rows are
    stored).  Rows that ask are also sent to ``probes`` further cells of each ordering,
    and compared with ``candidates`` rows of each cell.  The defaults find nearly all of
    the ten most similar even where these are hardly more similar than any others;
    fewer candidates and no probes are enough for neighbours that stand out.
    """
    spark = df.sparkSession
    rows = df.count()
    share = min(1.0, 1.5 * SAMPLE / max(1, rows))
    ask = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    narrow = dealt(df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"), ask.alias("ask")).filter("v IS NOT NULL"))
    picked = narrow.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    if dim is None:
        sizes = np.array([len(v) for v in picked.column("v").to_pylist()] or [1])
        dim = int(np.bincount(sizes).argmax())
    layout = Layout(unit_rows(picked.column("v"), dim)[1], rows, dim, orderings, cell)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column("v"), dim)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[at].astype(np.int64)
            asks = batch.column("ask").to_numpy(zero_copy_only=False)[at].astype(bool)
            half = x.astype(np.float16)

            def rows(which: np.ndarray, cells: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(which), [None, pa.py_buffer(np.ascontiguousarray(half[which]))])
                return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(ids[which]), pa.array(role.astype(np.int8)), raw.cast(pa.binary())], ["cell", "id", "role", "x"])

            every = np.arange(len(ids))
            for t, cells in enumerate(layout.place(x).T):
                yield rows(every, cells, asks)
                if probes and asks.any():
                    who = np.flatnonzero(asks)
                    for c in layout.near(x[who], t, probes):
                        to = c >= 0
                        yield rows(who[to], (t << 44) + (c[to].astype(np.int64) << 16) + layout.parts(x[who[to]], t, c[to]), np.full(int(to.sum()), 2))

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, role = table.column("id").to_numpy(), table.column("role").to_numpy()
        _, once = np.unique(ids, return_index=True)
        raw = b"".join(table.column("x").take(pa.array(once)).to_pylist())
        x = np.frombuffer(raw, dtype=np.float16).reshape(-1, dim).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, role = ids[once], role[once]
        seed = SEED + 7 * int(table.column("cell")[0].as_py() >> 44)
        a, b, s = forest_pairs(ids, x, layout.centre, k, min_similarity, trees, candidates, seed, role > 0, role < 2)
        return pa.table([pa.array(ids[a]), pa.array(ids[b]), pa.array(s.astype(np.float32))], names=["id", "neighbour", "similarity"])

    valid = F.expr(f"size(v) = {dim} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('Infinity')) AND exists(v, x -> x != 0)")
    crowds = _crowds(narrow.filter(valid), k)
    members = narrow if crowds is None else crowds[0]
    cells = members.mapInArrow(spread, "cell bigint, id bigint, role tinyint, x binary").repartition(max(1, -(-layout.cells() // CELLS_PER_TASK)), "cell")
    found = cells.groupBy("cell").applyInArrow(grow, "id bigint, neighbour bigint, similarity float")
    best = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    if crowds is not None:
        best = best.unionByName(crowds[1].select("id", F.explode(F.slice("firsts", 1, k)).alias("neighbour"), F.lit(1.0).cast("float").alias("similarity")))
    order = Window.partitionBy("id").orderBy(F.round("similarity", 5).desc(), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", "similarity", "rank")


def similar_pairs(df: DataFrame, key: str, vector: str, min_similarity: float, k: int = K) -> DataFrame:
    """Pairs of keys of at least the similarity of which one is among the other's k most similar; the smaller key first.

    For similarities of 0.85 or more: neighbours so near share long prefixes in some tree.
    """
    found = most_similar(df, key, vector, k, min_similarity, candidates=CANDIDATES, probes=0)
    return found.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()
