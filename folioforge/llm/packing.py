"""Filling fixed-capacity containers with items (problem 8).

Sizes are tokens of a public tokenizer whose vocabulary file is a parameter.
Items are dealt to shards by a hash, each shard is packed on its own: of items
above a third of the capacity at most two share a container, found by greedy
matching (the largest takes the largest partner that still fits); smaller items
go, largest first, to the container whose gap fits best.

Defined results: null text is no item; an empty text has size 0 and joins a
container; an item larger than the capacity alone is cut into full containers
and a rest, nothing else is ever cut; repeated rows are packed one by one; ties
are broken by key; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.shared import cut, spread

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-splitting pattern published with that vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ITEMS_PER_SHARD = 20_000

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` file, one per worker process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, tokens: the size of every text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32())], ["id", "tokens"])

    narrow = spread(df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("t IS NOT NULL"))
    kind = df.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, tokens int").withColumnRenamed("id", key)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, none larger than ``capacity``."""
    bins = np.full(len(sizes), -1, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = [int(i) for i in order if 3 * sizes[i] > capacity]
    gaps: list[int] = []
    # Large items, ascending, with links over those already taken.
    asc = large[::-1]
    weights = np.array([sizes[i] for i in asc], dtype=np.int64)
    link = list(range(len(asc)))  # position -> itself or an earlier free one

    def free(p: int) -> int:
        root = p
        while root >= 0 and link[root] != root:
            root = link[root]
        while p >= 0 and link[p] != root and link[p] != p:
            link[p], p = root, link[p]
        return root

    for p in range(len(asc) - 1, -1, -1):
        if bins[asc[p]] >= 0:
            continue
        number = len(gaps)
        bins[asc[p]] = number
        link[p] = p - 1
        gap = capacity - int(weights[p])
        mate = free(min(p - 1, int(np.searchsorted(weights, gap, side="right")) - 1)) if p else -1
        if mate >= 0:
            bins[asc[mate]] = number
            link[mate] = mate - 1
            gap -= int(weights[mate])
        gaps.append(gap)
    at_gap: dict[int, list[int]] = {}
    mask = 0
    for number, gap in enumerate(gaps):
        at_gap.setdefault(gap, []).append(number)
        mask |= 1 << gap
    for i in order[len(large):]:
        size = int(sizes[i])
        over = mask >> size
        if over:
            gap = size + (over & -over).bit_length() - 1
            number = at_gap[gap].pop()
            if not at_gap[gap]:
                mask &= ~(1 << gap)
        else:
            number, gap = len(gaps), capacity
            gaps.append(gap)
        bins[i] = number
        rest = gap - size
        at_gap.setdefault(rest, []).append(number)
        mask |= 1 << rest
    return bins


def fill_containers(df: DataFrame, key: str, tokens: str, capacity: int = CAPACITY, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """key, piece_no, token_begin, token_end, shard, container, of every item."""
    kind = df.schema[key].dataType.simpleString()
    items = cut(df.select(F.col(key).alias("id"), F.col(tokens).cast("bigint").alias("n")), "sizes")
    shards = max(1, -(-items.count() // items_per_shard))
    full = F.expr(f"sequence(0, greatest(0, cast((n - 1) div {capacity} as int)))")
    pieces = items.select("id", "n", F.explode(full).alias("piece_no")).select(
        "id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_begin"),
        F.least(F.col("n"), (F.col("piece_no") + 1).cast("bigint") * capacity).alias("token_end"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no"), F.lit(shards)).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "piece_no"], kind="stable")
        part["container"] = pack((part["token_end"] - part["token_begin"]).to_numpy(), capacity)
        return part

    schema = f"id {kind}, piece_no int, token_begin bigint, token_end bigint, shard int, container bigint"
    return pieces.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", key)
