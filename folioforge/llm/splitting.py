"""Splitting oversized items at natural boundaries (problem 5).

A text is never loaded whole by one worker: it is cut into ranges, each worker
sees one range with halos, finds the natural boundaries in it and an *anchor* -
the first boundary at or after the range's start.  The stretch between two
anchors is cut independently of every other one; piece numbers come from prefix
sums over the boundary table, so even a giant file needs no sequential pass.

Defined results: null text gives no piece; text within the limit gives one piece
equal to it (an empty one too); pieces are in order, cover the text, are never
longer than ``limit`` characters, and each but the first repeats at least
``overlap`` characters of its predecessor's end where a word boundary allows it,
never fewer; pages out of order are put in order, missing ones stay missing;
a section opened in one range holds for the ranges after it; repeated ids are told
apart by nothing, so ids must be unique; columns that are not named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.chunking import forward_fill
from folioforge.shared import cut as cut_lineage

LIMIT = 4000
OVERLAP = 200
RANGE = 65536
LOOK = 8  # characters of context a boundary needs on its left
SLACK = 80  # how far back an overlap may reach for the start of a word

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
SENTENCE = re.compile(r"[.!?…][)\]\"'»”]*\s+(?=[\[(\"'«„“¿¡—–-]*[^\W\d_]|\d)")
LINE = re.compile(r"\n\s*")
CLAUSE = re.compile(r"[;:,|]\s+")
WORD = re.compile(r"\s+")
HEADING = re.compile(r"(?:^|\n)[^\S\n]*((?:\d{1,2}(?:\.\d{1,2})*[.)]?[^\S\n]+)?[^\W\d_][^\n.!?;:,|\t]{2,60})[^\S\n]*\n[^\S\n]*\n")
OPENED = -1  # number of the row that tells a range's last heading
LEVELS = (PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD)


def boundary_table(text: str) -> list[np.ndarray]:
    """For each kind of boundary, strongest first, the offsets at which a piece may begin."""
    table = []
    for kind in LEVELS:
        ends = [m.end() for m in kind.finditer(text)]
        if kind is SENTENCE:
            ends = [e for e in ends if not text[e].islower()]
        table.append(np.array(ends, dtype=np.int64))
    return table


def anchor(left: str, right: str) -> int:
    """Offset in ``right`` of the first natural boundary, 0 where there is none."""
    context = left[-LOOK:]
    both, shift = context + right, len(context)
    for kind in (PARAGRAPH, SENTENCE, LINE, WORD):
        for m in kind.finditer(both):
            if shift <= m.end() < len(both) and (kind is not SENTENCE or not both[m.end()].islower()):
                return m.end() - shift
    return 0


def _last(ends: np.ndarray, low: int, high: int) -> int:
    """The largest boundary in (low, high], or -1."""
    i = int(np.searchsorted(ends, high, side="right")) - 1
    return int(ends[i]) if i >= 0 and ends[i] > low else -1


def cut_stretch(window: str, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cut ``window[begin:end]``; pieces may reach back before ``begin`` for their overlap.

    No piece but a whole stretch is so short that the next one's overlap would hold it all.
    """
    table = boundary_table(window)
    slack = min(SLACK, limit // 8)
    least = overlap + slack + 1

    def back(at: int, floor: int) -> int:
        want = at - overlap
        if overlap <= 0 or want <= floor:
            return at if overlap <= 0 else floor
        low = max(floor, want - slack) - 1
        word = max(_last(table[4], low, want), _last(table[1], low, want))
        return word if word >= 0 else want

    pieces, start, fresh = [], (back(begin, 0) if begin else 0), begin
    while end - start > limit:
        at, high = -1, min(start + limit, end - least)
        for level in table:
            at = _last(level, max(fresh, start + limit // 2), high)
            if at > 0:
                break
        if at <= fresh:
            at = high
        pieces.append((start, at))
        start, fresh = back(at, start + 1), at
    pieces.append((start, end))
    return pieces


def _stretch_pieces(left: str, mid: str, right: str, first: bool, limit: int, overlap: int) -> tuple[list[tuple[int, int]], str]:
    """Offsets of the pieces, in characters of ``left + mid + right``, of one range."""
    window = left + mid + right
    begin = 0 if first else len(left) + anchor(left, mid[:limit])
    end = len(left) + len(mid) + (anchor(mid, right[:limit]) if right else 0)
    if end <= begin:
        return [], window
    return cut_stretch(window[:end], begin, end, limit, overlap), window


def headings_of(window: str) -> list[tuple[int, str]]:
    return [(m.start(1), m.group(1).strip()) for m in HEADING.finditer(window)]


def _before(heads: list[tuple[int, str]], at: int) -> str | None:
    return next((h for begin, h in reversed(heads) if begin <= at), None)


def _cut_ranges(limit: int, overlap: int, with_headings: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, no, base, left, mid, right in zip(part["id"], part["range_no"], part["base"], part["left"], part["mid"], part["right"]):
                pieces, window = _stretch_pieces(left, mid, right, no == 0, limit, overlap)
                shift = base - len(left)
                heads = headings_of(window) if with_headings else []
                rows += [(key, no, k, a + shift, b + shift, _before(heads, a)) for k, (a, b) in enumerate(pieces)]
                if head := _before(heads, len(left) + len(mid) - 1):
                    rows.append((key, no, OPENED, 0, 0, head))
            yield pd.DataFrame(rows, columns=["id", "range_no", "k", "begin", "end", "heading"])

    return run


def _numbered(table: DataFrame) -> DataFrame:
    """Piece numbers by prefix sums over the ranges of each item, in two levels, and the headings of earlier ranges."""
    cuts = table.filter(F.col("k") != OPENED)
    counts = cuts.groupBy("id", "range_no").agg(F.count("*").alias("n")).withColumn("g", F.expr("range_no div 1024"))
    inner = Window.partitionBy("id", "g").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("id", "g").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(outer), F.lit(0)))
    before = (
        counts.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(groups.select("id", "g", "before"), ["id", "g"])
        .select("id", "range_no", (F.col("within") + F.col("before")).alias("offset"))
    )
    opened = table.filter(F.col("k") == OPENED).select("id", "range_no", F.col("heading").alias("opened"))
    last = before.select("id", "range_no").join(opened, ["id", "range_no"], "full_outer")
    carried = forward_fill(last, "id", "range_no", "opened", "carried").select("id", (F.col("range_no") + 1).alias("range_no"), "carried")
    # A range that no piece begins in passes on what it was given.
    carried = forward_fill(before.select("id", "range_no").join(carried, ["id", "range_no"], "full_outer"), "id", "range_no", "carried", "earlier").select("id", "range_no", "earlier")
    return (
        cuts.join(before, ["id", "range_no"]).join(carried, ["id", "range_no"], "left")
        .withColumn("piece_no", (F.col("offset") + F.col("k")).cast("int")).withColumn("heading", F.coalesce("heading", "earlier")).drop("offset", "earlier"))


def boundary_cuts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, with_headings: bool = True) -> DataFrame:
    """The boundary table of every text longer than ``limit``, without text: id, range_no, k, begin, end, heading.

    A row with k = ``OPENED`` tells the last heading of a range that has one.
    """
    if not 0 <= overlap < limit * 3 // 8:
        raise ValueError("overlap must be below three eighths of the limit")
    if range_chars < 2 * limit:
        raise ValueError("a range must hold at least two pieces")
    halo = overlap + SLACK + LOOK
    big = df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter(F.length("t") > limit)
    blocks = big.select("id", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{range_chars}}}"), F.lit(0)).alias("b"))
    ranges = blocks.select("id", F.posexplode(F.expr(
        f"transform(b, (x, i) -> struct(if(i > 0, right(b[i - 1], {halo}), '') AS left, x AS mid,"
        f" if(i + 1 < size(b), left(b[i + 1], {limit}), '') AS right))")).alias("range_no", "r"))
    ranges = ranges.select("id", "range_no", (F.col("range_no").cast("bigint") * range_chars).alias("base"), "r.left", "r.mid", "r.right")
    kind = df.schema[key].dataType.simpleString()
    return ranges.mapInPandas(_cut_ranges(limit, overlap, with_headings), f"id {kind}, range_no int, k int, begin bigint, end bigint, heading string")


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> DataFrame:
    """Pieces of every item: key, piece_no, begin, end, piece, page_first, page_last, section.

    ``df`` has, besides key and text, page_start, page_end and section.  A piece's
    pages are the part of the item's page range that its characters cover; its
    section is the last heading before it in the text, else the item's section.
    """
    about = [
        F.length(text).alias("n"), F.least("page_start", "page_end").alias("p0"), F.greatest("page_start", "page_end").alias("p1"), F.expr("nullif(trim(section), '')").alias("sec")]
    items = df.select(F.col(key).alias("id"), F.col(text).alias("t"), *about)
    small = items.filter(F.col("n") <= limit).select(
        "id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("begin"), F.col("n").cast("bigint").alias("end"), F.col("t").alias("piece"),
        F.col("p0").alias("page_first"), F.col("p1").alias("page_last"), F.col("sec").alias("section"))
    # The pieces of an item are cut out of it by the offsets of the stitched table.
    table = _numbered(cut_lineage(boundary_cuts(df, key, text, limit, overlap, range_chars), "cuts"))
    own = table.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "begin", "end", "heading"))).alias("own"))
    pieces = items.filter(F.col("n") > limit).join(own, "id").withColumn("span", F.col("p1") - F.col("p0") + 1).select("*", F.explode("own").alias("x")).select("*", "x.*")
    first = F.least(F.col("p1"), F.col("p0") + F.floor(F.col("begin") * F.col("span") / F.col("n")))
    last = F.least(F.col("p1"), F.col("p0") + F.floor((F.col("end") - 1) * F.col("span") / F.col("n")))
    piece = F.substr("t", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    long = pieces.select("id", "piece_no", "begin", "end", piece.alias("piece"), first.cast("int").alias("page_first"), last.cast("int").alias("page_last"), F.coalesce("heading", "sec").alias("section"))
    return small.unionByName(long).withColumnRenamed("id", key)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> DataFrame:
    """Keys of the items that had to be cut, from the boundary table alone."""
    cuts = boundary_cuts(df, key, text, limit, overlap, range_chars, with_headings=False)
    return cuts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias(key))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 22) -> DataFrame:
    """Pieces of UTF-8 text files on shared storage, read by byte range: path, piece_no, begin, end, piece, section.

    ``paths`` are plain paths or URIs of any file system that Arrow opens (file,
    hdfs, s3, gs).  ``begin`` and ``end`` are byte offsets.  A worker opens the
    file, reads its range with halos and never the whole file.
    """
    def opened(path: str):
        return arrow_fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (arrow_fs.LocalFileSystem(), path)

    rows = []
    for p in paths:
        system, plain = opened(p)
        rows.append((p, system.get_file_info(plain).size))
    halo, ahead = 4 * (overlap + SLACK + LOOK), 4 * limit
    ranges = (
        spark.createDataFrame(rows, "path string, size bigint").filter("size > 0")
        .withColumn("range_no", F.explode(F.expr(f"sequence(0, cast((size - 1) div {range_bytes} as int))")))
        .repartition(max(1, min(4096, sum(-(-n // range_bytes) for _, n in rows))), "path", "range_no"))

    def whole(data: bytes, at_start: bool) -> bytes:
        """Without the bytes of a character that began earlier."""
        k = 0
        while not at_start and k < min(4, len(data)) and data[k] & 0xC0 == 0x80:
            k += 1
        return data[k:]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, size, no in zip(part["path"], part["size"], part["range_no"]):
                low, high = no * range_bytes, min(size, (no + 1) * range_bytes)
                system, plain = opened(path)
                with system.open_input_file(plain) as f:
                    f.seek(max(0, low - halo))
                    data = f.read(high - max(0, low - halo) + ahead)
                cut0, cut1 = low - max(0, low - halo), high - max(0, low - halo)
                while cut0 < len(data) and data[cut0] & 0xC0 == 0x80:
                    cut0 += 1
                while cut1 < len(data) and data[cut1] & 0xC0 == 0x80:
                    cut1 += 1
                left = whole(data[:cut0], low == 0)
                shift = max(0, low - halo) + cut0 - len(left)
                mid, right = data[cut0:cut1].decode("utf-8", "replace"), data[cut1:].decode("utf-8", "ignore")
                pieces, window = _stretch_pieces(left.decode("utf-8", "replace"), mid, right[:limit], no == 0, limit, overlap)
                marks = sorted({x for p in pieces for x in p})
                sizes = {m: len(window[a:m].encode()) for a, m in zip([0, *marks], marks)}
                total, at = 0, {}
                for m in marks:
                    total += sizes[m]
                    at[m] = total
                heads = headings_of(window)
                out += [(path, no, k, at[a] + shift, at[b] + shift, _before(heads, a)) for k, (a, b) in enumerate(pieces)]
                if head := _before(heads, len(window) - len(right[:limit]) - 1):
                    out.append((path, no, OPENED, 0, 0, head))
            yield pd.DataFrame(out, columns=["id", "range_no", "k", "begin", "end", "heading"])

    # The boundary table holds offsets only; the pieces of each range are then read by them.
    cuts = cut_lineage(ranges.mapInPandas(run, "id string, range_no int, k int, begin bigint, end bigint, heading string"), "file-cuts")
    table = _numbered(cuts).groupBy("id", "range_no").agg(F.sort_array(F.collect_list(F.struct("piece_no", "begin", "end", "heading"))).alias("own"))

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, own in zip(part["id"], part["own"]):
                low = own[0]["begin"]
                system, plain = opened(path)
                with system.open_input_file(plain) as f:
                    f.seek(low)
                    data = f.read(own[-1]["end"] - low)
                rows = [(path, p["piece_no"], p["begin"], p["end"], data[p["begin"] - low : p["end"] - low].decode("utf-8", "replace"), p["heading"]) for p in own]
                yield pd.DataFrame(rows, columns=["path", "piece_no", "begin", "end", "piece", "section"])

    return table.mapInPandas(emit, "path string, piece_no int, begin bigint, end bigint, piece string, section string")
