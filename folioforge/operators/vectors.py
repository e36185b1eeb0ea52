"""Cosine top-k over stored vectors: one query as an expression, many in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioforge.functions import text as T

QUERY_BLOCK = 20_000
NO_SCORE = np.iinfo(np.int64).min


def valid(vector: str, dim: int | None = None) -> Column:
    """Not null, of the given length, finite and not all zero."""
    ok = F.col(vector).isNotNull() & F.expr(f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('Infinity')) AND exists({vector}, x -> x != 0)")
    return ok & (F.size(vector) == dim) if dim else ok


def cosine(vector: str, query: list[float]) -> Column:
    """Cosine similarity with a literal query vector, in doubles."""
    q = [float(x) for x in query]
    norm = float(np.sqrt(np.dot(q, q)))
    dot = F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(x) for x in q]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(F.transform(F.col(vector), lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return dot / (own * norm)


def _rounded(s: np.ndarray) -> np.ndarray:
    """Scores in units of the fourth decimal place, halves up."""
    return np.floor(np.round(s, 12) * 1e4 + 0.5).astype(np.int64)


def top_k(df: DataFrame, vector: str, query: list[float], k: int, keys: list[str], where: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The k most similar rows: filters first, then score, then rank; equal rows count once, ties go by key.

    Every task keeps k rows at most, so what is shuffled is tasks x k rows.
    """
    if where is not None:
        df = df.filter(where)
    q = np.array(query, dtype=np.float64)
    q /= np.linalg.norm(q)
    columns = keep or keys
    order = [("score", "descending"), *[(c, "ascending") for c in keys]]
    narrow = df.filter(valid(vector, len(query))).select(*columns, F.col(vector).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("_v").to_numpy(zero_copy_only=False)).astype(np.float64)
            units = _rounded(x @ q / np.linalg.norm(x, axis=1))
            least = best.column("score")[-1].as_py() * 1e4 - 0.5 if best is not None and best.num_rows == k else -np.inf
            at = np.flatnonzero(units >= least)
            if not len(at):
                continue
            rows = pa.Table.from_batches([batch.select(columns).take(pa.array(at))]).append_column("score", pa.array(units[at] / 1e4))
            rows = rows if best is None else pa.concat_tables([best, rows])
            best = rows.group_by(rows.column_names).aggregate([]).select(rows.column_names).sort_by(order).slice(0, k)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    fields = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in columns)
    best = narrow.mapInArrow(run, fields + ", score double").distinct().orderBy(F.desc("score"), *keys).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)))


class _Best:
    """The k best different keys of every query, ties to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.q, self.units, self.keys = k, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.least = np.full(queries, NO_SCORE)  # what a row must reach once a query has k keys

    def add(self, q: np.ndarray, units: np.ndarray, keys: np.ndarray) -> None:
        if self.keys is not None:
            q, units, keys = np.concatenate((self.q, q)), np.concatenate((self.units, units)), np.concatenate((self.keys, keys))
        order = np.lexsort((-units, keys, q))
        q, units, keys = q[order], units[order], keys[order]
        once = np.concatenate(([True], (q[1:] != q[:-1]) | (keys[1:] != keys[:-1])))
        q, units, keys = q[once], units[once], keys[once]
        order = np.lexsort((keys, -units, q))
        q, units, keys = q[order], units[order], keys[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        self.q, self.units, self.keys = q[rank < self.k], units[rank < self.k], keys[rank < self.k]
        last = rank == self.k - 1
        self.least[q[last]] = units[last]

    def meet(self, q: np.ndarray, near: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        """Rows ``x`` of keys ``own`` against the queries ``q``, all of length one; ``near`` are the queries in single precision.

        Products in single precision leave out rows that cannot reach a query's k
        best, by more than their error; what is left is scored in doubles.
        """
        order = np.argsort(own, kind="stable")
        own, x = own[order], x[order]
        _, once = np.unique(own, return_index=True) if len(np.unique(own)) < len(own) else (None, None)
        keys, n, x_near, error = own if once is None else own[once], len(own), x.astype(np.float32).T, (x.shape[1] + 8) * 2.0**-24
        found = []
        for low in range(0, len(q), 500):
            part, least = q[low : low + 500], self.least[low : low + 500]
            if least.min() > NO_SCORE:
                floor = ((least - 0.5) / 1e4 - 1e-11 - error).astype(np.float32)
                at = np.flatnonzero(near[low : low + 500] @ x_near >= floor[:, None])
                if len(at) <= 4 * self.k * len(part):
                    who, at = np.divmod(at, n)
                    units = _rounded(np.einsum("ij,ij->i", part[who], x[at]))
                    enough = units >= least[who]
                    found.append((who[enough] + low, units[enough], own[at[enough]]))
                    continue
            units = _rounded(part @ x.T)
            # A repeated key counts once, with its best score.
            if once is not None:
                units = np.maximum.reduceat(units, once, axis=1)
            m = units.shape[1]
            take = min(self.k, m)
            mixed = units * n + (n - 1 - np.arange(m))  # equal scores: the smaller key first
            at = np.argpartition(-mixed, take - 1, axis=1)[:, :take]
            found.append((np.repeat(np.arange(low, low + len(units)), take), np.take_along_axis(units, at, 1).ravel(), keys[at.ravel()]))
        who, units, keys = (np.concatenate(f) for f in zip(*found))
        if len(who):
            self.add(who, units, keys)


def batch_top_k(df: DataFrame, vector: str, key: str, queries: DataFrame, query_key: str, query_vector: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_key, key, score, rank: the k most similar keys of every query, among the vectors of its length.

    One pass over the table serves ``block`` queries of one length, sent to the
    tasks as a broadcast of that size; every task scores its rows against them by
    matrix products and keeps k of them for each query, so what is shuffled is
    queries x tasks x k rows.
    """
    rows = queries.filter(valid(query_vector)).select(query_key, query_vector).dropDuplicates([query_key]).orderBy(F.size(query_vector), query_key).toLocalIterator()
    key_kind, query_kind = df.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    spark, sent, ids, data = df.sparkSession, [], [], []

    def send() -> None:
        q = np.array(data, dtype=np.float64)
        sent.append((q.shape[1], spark.sparkContext.broadcast((list(ids), q / np.linalg.norm(q, axis=1, keepdims=True)))))
        ids.clear()
        data.clear()

    for row in rows:
        if ids and (len(ids) == block or len(row[1]) != len(data[0])):
            send()
        ids.append(row[0])
        data.append(row[1])
    if ids:
        send()
    schema = f"q {query_kind}, id {key_kind}, score double"
    query_type, key_type = to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(df.schema[key].dataType)
    result = spark.createDataFrame([], schema)
    for dim, shared in sent:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best, near, seen = _Best(len(names), k), q.astype(np.float32), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.array(batch.column("id").to_pylist())
                x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                low = 0
                while low < len(own):  # as many rows at once as were seen before: few of them are new among the best
                    high = min(len(own), low + max(500, seen))
                    best.meet(q, near, x[low:high], own[low:high])
                    low, seen = high, seen + high - low
            if best.keys is not None:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in best.q], query_type), pa.array(best.keys, key_type), pa.array(best.units / 1e4)], ["q", "id", "score"])

        narrow = df.filter(valid(vector, dim)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
        result = result.unionByName(narrow.mapInArrow(run, schema))
    once = result.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_key), F.col("id").alias(key if key != query_key else "neighbour"), "score", "rank")


def embedding_tokens(text: Column, prefix: str = "passage: ", special: int = 2, size=T.token_count) -> Column:
    """Tokens that reach a model: those of the text with its prefix and the model's own marks."""
    return size(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))) + special


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """Deterministic unit vector of a text's words, where no model is at hand."""
    v = np.zeros(dim, dtype=np.float32)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(df: DataFrame, text: str, prefix: str = "passage: ", dim: int = 64, model=None) -> DataFrame:
    """``df`` with column ``embedding``; ``model`` maps a list of texts to vectors, once per batch."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [prefix + (t or "") for t in batch.column(text).to_pylist()]
            vectors = model(texts) if model else [hashed_vector(t, dim) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    return df.mapInArrow(run, fields + ", embedding array<float>")
