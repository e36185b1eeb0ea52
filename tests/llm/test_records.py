import datetime as dt
import itertools

from folioforge.llm import records
from folioforge.llm.records import best_records, choose, duplicate_groups, duplicate_pairs

SCHEMA = "doc_id bigint, doi string, sha256 string, title string, authors string, year int, text string, status string, added_at timestamp, group string"
T0 = dt.datetime(2024, 1, 1)


def row(i, doi=None, sha=None, title=None, authors=None, year=None, text=None, status="ok"):
    return (i, doi, sha or f"sha{i}", title, authors, year, text, status, T0 + dt.timedelta(days=i), "x")


LONG = "The yield was {a} percent after {b} hours of heating. A second run gave {b} percent at {a} degrees."
ROWS = [
    row(1, "10.1234/ab.5", title="Ash of straw in small boilers (AB-1)", authors="Kolb, N.; Sundt, A.", year=2019, text=LONG.format(a=11, b=12)),
    row(2, "https://doi.org/10.1234/AB.5)", title="ASH OF STRAW IN SMALL BOILERS (AB-1)", authors="unknown", year=2020),
    row(3, None, title="Ash of straw in smal boilers (AB-1)", authors="N. Kolb", text=LONG.format(a=11, b=12) + " More.", status="error"),
    row(4, None, sha="sha1", title=None),
    row(5, "10.1234/ab.6", title="Erratum to: Ash of straw in small boilers (AB-1)", authors="Kolb, N.; Sundt, A.", year=2019, text=LONG.format(a=31, b=77)),
    row(6, "10.1234/p.1", title="Oils of the coast. Part 1", authors="Lund, B.", year=2001, text=LONG.format(a=1, b=2)),
    row(7, "10.1234/p.2", title="Oils of the coast. Part 2", authors="Lund, B.", year=2002, text=LONG.format(a=3, b=4)),
    row(8, "10.00000/unassigned", title="Preface to this issue", authors="", year=1999, text=LONG.format(a=5, b=6)),
    row(9, "10.00000/unassigned", title="Preface to this issue", authors=None, year=2011, text=LONG.format(a=7, b=8)),
    row(10, "10.1234/z.1", title="Preface to this issue", year=2003), row(11, "10.1234/z.2", title="Preface to this issue", year=2004),
    row(12), row(13, text="", title=""), row(14, title="Lonely work on kilns and pipes"),
]
PAPER = [1, 2, 3, 4]


def test_pairs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {tuple(r) for r in duplicate_pairs(df).collect()}
    assert got == set(itertools.combinations(PAPER, 2))
    assert duplicate_pairs(df.limit(0)).count() == 0


def test_many_copies_cost_no_more(spark):
    many = [row(1000 + i, "10.1234/hot", sha="hot", title="A hot paper on everything at once", year=2020, text=LONG.format(a=1, b=i % 3)) for i in range(400)]
    groups = duplicate_groups(spark.createDataFrame([*ROWS, *many], SCHEMA)).collect()
    assert len(groups) == len(ROWS) + 400 and len({r["group"] for r in groups if r["doc_id"] >= 1000}) == 1


def test_every_pair_of_a_mixed_block_is_compared(spark, monkeypatch):
    monkeypatch.setattr(records, "SIDE", 16, raising=False)
    rows, names = [], ["".join(chr(97 + ord(d) - 48) * 6 for d in f"{i:02d}") for i in range(40)]
    for i, w in enumerate(names):  # one sentence holds figures, and all papers share it
        told = "All samples were dried at 105 degrees for 24 hours. " + " ".join(f"The {w} furnace of the {k} works was never {w} again." for k in ("upper", "lower", "outer"))
        rows += [row(2 * i, f"10.1234/{w}", title=f"Works on {w} ovens", authors="Kolb, N.", year=2019, text=told), row(2 * i + 1, None, title=f"Works on {w} oven", authors="Kolb, N.", year=2019, text=told)]
    got = {tuple(r) for r in duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)}


def test_records(spark):
    out = best_records(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sum(r["n_rows"] for r in out) == len(ROWS) and len(out) == len(ROWS) - 3
    best = next(r for r in out if r["n_rows"] == 4)
    assert (best["doi"], best["year"], best["authors"]) == ("10.1234/ab.5", 2019, "Kolb, N.; Sundt, A.") and best["title"] == "Ash of straw in small boilers (AB-1)"
    assert all(r["doi"] is None or "unassigned" not in r["doi"] for r in out)


def test_choice_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(300):
        pools = {k: [((f"{k}{i}",) if k != "identity" else (f"d{i}", rng.choice([1, 2])), rng.random(), frozenset(rng.sample(range(4), rng.randint(1, 3)))) for i in range(rng.randint(0, 4))] for k in ("identity", "title", "authors")}
        fixed = {f"d{i}": 1 for i in range(4)}

        def value(picked):
            return sum(c[1] for c in picked) + sum(0.25 * min(a[1], b[1]) for a, b in itertools.combinations(picked, 2) if a[2] & b[2])

        options = [[c for c in pools[k] if k != "identity" or c[0][1] == 1] for k in pools]
        options = [o for o in options if o]
        best = max((value(p) for p in itertools.product(*options)), default=0) if options else 0
        chosen = choose(pools, fixed)
        picked = [next(c for c in pools[k] if c[0] == v) for k, v in chosen.items()]
        assert abs(value(picked) - best) < 1e-6


def test_a_chain_is_one_group(spark):
    """Forty rows of which each shares a sentence with the next only."""
    told = [f"The {w} sample gave {100 + i} grams of tar after drying." for i, w in enumerate(["".join(chr(97 + int(d)) * 4 for d in f"{k:02d}") for k in range(41)])]
    rows = [row(i, None, title=f"Short {i}", authors="Kolb, N.", year=2019, text=told[i] + " " + told[i + 1]) for i in range(40)]
    rows = [(*r[:3], None, *r[4:]) for r in rows]
    groups = {r["group"] for r in duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(groups) == 1


def test_records_of_known_papers(spark):
    """Copies with gaps, other cases and wrong years: every paper gives one record with its own values."""
    import random

    rng = random.Random(12)
    rows, truth, i = [], {}, 0
    for p in range(60):
        word = "".join(chr(97 + int(d)) * 5 for d in f"{p:02d}")
        doi, title, authors, year = f"10.5555/{word}", f"Yields of {word} kilns in winter", f"{word.capitalize()}, Ann; Lund, Bo", 1980 + p % 40
        text = " ".join(f"Run {k} of the {word} kiln gave {p}{k} percent of {word} tar in {k + 3} hours." for k in range(4))
        n = rng.randint(2, 6)
        truth[doi] = (n, title, authors, year)
        for c in range(n):
            i += 1
            whole = c < 2
            rows.append(row(
                i, doi if whole or rng.random() < 0.5 else rng.choice([None, "10.00000/unassigned"]), title=title if whole else rng.choice([title, title.upper(), None]), authors=authors if whole else rng.choice([None, "unknown", f"A. {word}"]),
                year=year if whole else rng.choice([None, year, 3000]), text=text, status="ok" if whole else "partial"))
    got = {r["doi"]: (r["n_rows"], r["title"], r["authors"], r["year"]) for r in best_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == truth


def test_texts_without_figures_and_excerpts(spark):
    """Copies of texts without figures that differ in a sentence, excerpts of long texts; stock sentences of many papers link none."""
    word = lambda p, k: "".join(chr(97 + (int(d) + p) % 26) * 2 for d in f"{p:02d}{k:03d}")
    told = lambda p, n: [f"The {word(p, k)} furnace of the {word(p, k + 500)} works was closed." for k in range(n)]
    stock = ["No such change was seen for straw of any kind.", "We thank the staff of the workshop for their help.", "All data can be had from the authors on request."]
    rows, want = [], set()
    for p in range(12):
        text = told(p, 80 if p % 2 else 5)
        copy = text[30:42] if p % 2 else [*text[:4], f"An odd remark on {word(p, 7)} was added here by someone else."]
        rows += [row(2 * p, f"10.1234/{word(p, 1)}", title=f"Works on {word(p, 2)} ovens", authors="Kolb, N.", year=2019, text=" ".join([*text, *stock])), row(2 * p + 1, None, authors="Kolb, N.", year=2019, text=" ".join(copy))]
        want.add((2 * p, 2 * p + 1))
    rows.append(row(100, None, text=" ".join([*stock, "The last word on this was never said by anyone."])))
    assert {tuple(r) for r in duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_candidates_hold_every_link(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(7), []
    pool = ["The {} kiln of the {} works was never lit again.".format(*("".join(chr(97 + int(d)) * 4 for d in f"{k + j:03d}") for j in (0, 300))) for k in range(40)]
    for i in range(120):
        text = " ".join(rng.sample(pool[i % 8 * 4 : i % 8 * 4 + 12], rng.randint(1, 8)))
        rows.append(row(i, rng.choice([None, None, f"10.1234/{i % 9}"]), authors=rng.choice([None, "Kolb, N.", "Lund, B."]), year=rng.choice([None, 2001]), text=text))
    table = records._with_evidence(spark.createDataFrame(rows, SCHEMA)).withColumn("c", F.xxhash64("doc_id")).cache()
    pairs, stock = records._candidates(table)
    every = table.select(F.col("c").alias("a")).join(table.select(F.col("c").alias("b")), F.expr("a < b"))
    links = lambda p: {tuple(r) for r in records._links(table, p, stock).filter("score < 1000").collect()}
    whole = links(every)
    assert whole and links(pairs) == whole
