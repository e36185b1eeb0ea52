import random

import pytest

from folioforge.llm.scan_repair import PAGE, Mender, damaged_texts, repaired_texts, shingles, skeleton

WORDS = "the boiler holds water until pressure reaches seven bars and stokers carry charcoal through narrow corridors toward furnaces below".split()
SCHEMA = "doc_id bigint, chunk_index int, text string, repaired string"


def sentence(rng):
    return " ".join(rng.sample(WORDS, 10)).capitalize() + "."


def corpus():
    rng = random.Random(3)
    rows = [(i, 0, " ".join(sentence(rng) for _ in range(6)), "x") for i in range(300)]
    rows += [(400 + i, 0, f"The boiler holds\n\nLetters on Steam Craft 20{10 + i}, {i + 3}, {700 + i}\n\nwater until pressure reaches seven bars.", "x") for i in range(6)]
    rows += [(410 + i, 0, f"The boiler holds\n{200 + i} | Труды отдела котлов\nwater until pressure reaches seven bars.", "x") for i in range(4)]
    rows += [
        (500, 0, "The boiler holds water until pres-\nsure reaches seven bars.", "x"), (501, 0, "The b0iler ho1ds water until pressure reaches seven bars.", "x"),
        (502, 0, "The boiler holds water until\n- 353 -\npressure reaches seven bars.", "x"), (503, 0, "The boiler holds water until\nxxi\npressure reaches seven bars.", "x"),
        (504, 0, "The boiler holds water until pres- sure reaches seven bars.", "x"), (505, 0, "The boiler holds water until pres¬ \n  sure reaches seven bars.", "x"),
        (506, 0, "The boiler holds water until 922    KOLBERG pressure reaches seven bars.", "x"),
        (507, 0, "The boiler holds water until 863 | Труды отдела котлов pressure reaches seven bars.", "x"),
        (600, 0, "High- and low-pressure boilers hold water.\n\n1) charcoal;\n2) water;\n\n3. Results\n\nS1\t45.2\t7.1\nS2\t3.0\t9.9", "x"), (601, 0, "The boiler holds water until\npressure reaches seven bars.", "x"),
        (602, 0, None, "x"), (603, 0, "", "x"), (604, 0, "Zorkmid ganustol bavuxyl were new here.", "x"),
    ]
    return rows


DAMAGED = {400 + i for i in range(6)} | {410 + i for i in range(4)} | set(range(500, 508))


@pytest.mark.parametrize("shipped", [400_000, 0])
def test_found(spark, shipped):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert {r["doc_id"] for r in damaged_texts(df, "text", ["doc_id", "chunk_index"], shipped).collect()} == DAMAGED


def test_repaired(spark):
    out = {r["doc_id"]: r for r in repaired_texts(spark.createDataFrame(corpus(), SCHEMA), "text", ["doc_id"]).collect()}
    whole = "The boiler holds water until pressure reaches seven bars."
    for i in DAMAGED - {503}:
        assert out[i]["repaired"] == whole, i
    assert out[602]["repaired"] is None and out[603]["repaired"] == "" and not out[600]["damaged"]


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "x" * 200_000 + " - " * 1000, "y")], SCHEMA)
    assert damaged_texts(df, "text", ["doc_id"]).count() == 0 and damaged_texts(df.limit(0), "text", ["doc_id"]).count() == 0


def test_forms():
    assert skeleton("b0iler") == skeleton("boiler") and skeleton("irnage") == skeleton("image") and skeleton("темперагура") == skeleton("температура")
    assert skeleton("s3") is None and skeleton("mixтure") is None and skeleton("45") is None
    for line in ("353", "- 353 -", "· 48 ·", "[269]", "стр. 648", "p. 752", "Page 731 of 813", "802/842", "xxi"):
        assert PAGE.fullmatch(line), line
    for line in ("5. Methods", "S1 4.2", "12345", "1) straw;", "mix of two"):
        assert not PAGE.fullmatch(line), line


def test_headers_inside_a_line():
    lines = ("951 | Archive of Colloid Measurements", "Letters on Steam Craft 2025, 78, 576", "— Kolb · Letters on Steam Craft —", "Kolb et al. / Letters on Steam Craft 27 (2023) 427–434")
    m = Mender({}, {x: "header" for line in lines for x in shingles(line) if "kolb" not in x})
    for given, plain in (
        ("was regenerated 951 | Archive of Colloid Measurements 8 times", "was regenerated 8 times"),
        ("boilers Letters on Steam Craft Letters on Steam Craft 2025, 78, 576 2025, 78, 576 hold water", "boilers hold water"),
        ("they hold — Kolb · Letters on Steam Craft — water of wells", "they hold water of wells"),
        ("they hold Kolb et al. / Letters on Steam Craft 27 (2023) 427–434 water", "they hold water"),
        ("[3] Kolb A. Letters on Steam Craft, 2005", "[3] Kolb A. Letters on Steam Craft, 2005"),
    ):
        assert m._inline(given).replace("Kolb ", "") == plain.replace("Kolb ", "") or m._inline(given) == plain, given


def test_lines_of_every_text_are_joined(spark):
    rows = [(1, "The boiler holds\nwater until pressure\nreaches seven bars.\n\n1) coal;\n2) oil;"), (2, "One line.")]
    out = {r["doc_id"]: r for r in repaired_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", ["doc_id"]).collect()}
    assert out[1]["repaired"] == "The boiler holds water until pressure reaches seven bars.\n\n1) coal;\n2) oil;" and not out[1]["damaged"]
    assert out[2]["repaired"] == "One line."


def test_planted_damage_is_taken_back(spark):
    """Of texts damaged in several ways at once, nearly all come back letter by letter."""
    rng = random.Random(9)
    clean, rows = {}, [(i, " ".join(sentence(rng) for _ in range(6))) for i in range(400)]
    for i in range(1000, 1200):
        words = " ".join(sentence(rng) for _ in range(5)).split(" ")
        clean[i] = " ".join(words)
        lines = [words[k : k + 9] for k in range(0, len(words), 9)]
        long = [(a, k) for a, line in enumerate(lines[:-1]) for k, w in enumerate(line) if len(w) > 7 and w.isalpha() and k == len(line) - 1]
        text = [" ".join(line) for line in lines]
        if long:
            a, k = rng.choice(long)
            w = lines[a][k]
            text[a] = text[a][: -len(w)] + w[:4] + "-"
            text[a + 1] = w[4:] + " " + text[a + 1]
        if i % 12 == 0:  # each misreading is rare
            right, wrong = rng.choice([("boiler", "b0iler"), ("corridors", "c0rridors"), ("pressure", "prcssure"), ("through", "tbrough"), ("narrow", "narr0w"), ("charcoal", "charc0al"), ("until", "unti1")])
            text = [t.replace(right, wrong, 1) for t in text]
        at = rng.randrange(1, len(text))
        if not text[at - 1].endswith((".", "-")):
            text.insert(at, rng.choice([f"Letters on Steam Craft {1990 + i % 30}, {i % 50}, {i % 700}", f"- {i % 900} -"]))
        rows.append((i, "\n".join(text)))
    out = {r["doc_id"]: r["repaired"] for r in repaired_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", ["doc_id"]).collect()}
    assert sum(out[i] == clean[i] for i in clean) >= 0.97 * len(clean)
    assert all(out[i] == t for i, t in rows[:400])
