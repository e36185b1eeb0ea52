import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm.splitting import _stretch_pieces, oversized, split_files, split_items

SCHEMA = "chunk_id bigint, text string, page_start int, page_end int, section string, piece string"


def whole(text, limit, overlap, size):
    """Pieces over all ranges, as global offsets."""
    halo, out = overlap + 88, []
    blocks = [text[i : i + size] for i in range(0, len(text), size)]
    for i, b in enumerate(blocks):
        left = blocks[i - 1][-halo:] if i else ""
        right = blocks[i + 1][:limit] if i + 1 < len(blocks) else ""
        pieces, _ = _stretch_pieces(left, b, right, i == 0, limit, overlap)
        out += [(a + i * size - len(left), e + i * size - len(left)) for a, e in pieces]
    return out


def make(words, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["ab", "word", "Term", "x" * rng.randint(1, 30)]) + rng.choice([" ", " ", ". ", "\n", "\n\n", "; ", ""]) for _ in range(words))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900), st.integers(0, 10**6), st.sampled_from([(40, 0), (60, 12), (100, 30)]), st.sampled_from([200, 333, 5000]))
def test_cover_order_limit_overlap(words, seed, sizes, block):
    limit, overlap = sizes
    text = make(words, seed)
    pieces = whole(text, limit, overlap, block)
    if not text:
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, e in pieces:
        assert 0 < e - a <= limit
    for (a, e), (b, f) in zip(pieces, pieces[1:]):
        assert a < b <= e < f or (overlap == 0 and b == e)
        assert e - b >= min(overlap, e - a - 1) or b - a <= 1


def test_natural_places():
    text = "First part ends here. Second part goes on for a while.\n\nThird part is a paragraph of its own. Fourth."
    assert [text[a:b] for a, b in whole(text, 60, 0, 10_000)] == ["First part ends here. Second part goes on for a while.\n\n", "Third part is a paragraph of its own. Fourth."]


def test_rows(spark):
    long = "Sentence number one is here. " * 300
    rows = [(1, None, 1, 2, "A", "x"), (2, "", None, None, None, "x"), (3, "short", 5, 3, " ", "x"), (4, long, 2, 5, "Body", "x"), (5, "z" * 9000, 1, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = split_items(df, "chunk_id", "text", limit=1000, overlap=100, range_chars=2000).orderBy("chunk_id", "piece_no").collect()
    by = {}
    for r in out:
        by.setdefault(r["chunk_id"], []).append(r)
    assert 1 not in by and by[2][0]["piece"] == "" and by[3][0]["page_first"] == 3 and by[3][0]["page_last"] == 5 and by[3][0]["section"] is None
    assert [r["piece_no"] for r in by[4]] == list(range(len(by[4]))) and all(len(r["piece"]) <= 1000 and r["piece"] == long[r["begin"] : r["end"]] for r in by[4])
    assert by[4][0]["page_first"] == 2 and by[4][-1]["page_last"] == 5 and by[4][0]["section"] == "Body"
    assert {r[0] for r in oversized(df, "chunk_id", "text", 1000, 100, 2000).collect()} == {4, 5}
    assert split_items(df.limit(0), "chunk_id", "text").count() == 0
    with pytest.raises(ValueError):
        oversized(df, "chunk_id", "text", 100, 60)


def test_files_by_byte_ranges(spark, tmp_path):
    text = ("Первая часть кончается здесь. " * 50 + "\n\n") * 40
    path = tmp_path / "giant.txt"
    path.write_bytes(text.encode())
    rows = split_files(spark, [str(path)], limit=700, overlap=50, range_bytes=10_001).orderBy("piece_no").collect()
    data = text.encode()
    assert rows[0]["begin"] == 0 and rows[-1]["end"] == len(data) and [r["piece_no"] for r in rows] == list(range(len(rows)))
    for r, s in zip(rows, rows[1:]):
        assert s["begin"] <= r["end"] and s["end"] > r["end"]
    for r in rows:
        assert data[r["begin"] : r["end"]].decode() == r["piece"] and len(r["piece"]) <= 700


def test_sections_hold_over_ranges(spark, tmp_path):
    """The section of a piece is the last heading before it, however many ranges lie between."""
    body = "Some sentence without any heading goes on here. " * 160
    text = "Methods\n\n" + body + "\n\nResults\n\n" + body * 3 + "\n\nOutlook\n\n" + body
    rows = [(1, text, 1, 9, "Intro", None), (2, body * 2, 1, 2, "Own", None)]
    out = split_items(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", limit=1000, overlap=100, range_chars=2500).collect()
    opened = {h: text.index(h) for h in ("Methods", "Results", "Outlook")}
    for r in out:
        if r["chunk_id"] == 2:
            assert r["section"] == "Own"
        else:
            assert r["section"] == max((h for h in opened if opened[h] <= r["begin"]), key=opened.get)
    path = tmp_path / "giant.txt"
    path.write_text(text)
    for r in split_files(spark, [str(path)], limit=1000, overlap=100, range_bytes=5000).collect():
        assert r["section"] == max((h for h in opened if opened[h] <= r["begin"]), key=opened.get)
    assert split_files(spark, [f"file://{path}"], limit=1000, overlap=100, range_bytes=5000).count() > 40
