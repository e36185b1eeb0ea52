import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import markup as M
from folioforge.operators import analysis as A
from folioforge.operators import ingest as I
from folioforge.operators import journal as J
from folioforge.operators import questions as Q
from folioforge.operators import search as S
from folioforge.operators import vectors as V


def test_top_k_and_batches_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).round(1)
    x[5] = x[9]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (7, [float(v) for v in x[7]])]
    df = spark.createDataFrame(rows, "id int, e array<float>")
    f = x.astype(np.float32).astype(float)
    unit = f / np.linalg.norm(f, axis=1, keepdims=True)
    s = (unit @ unit.T).round(4)
    want = sorted(range(200), key=lambda i: (-s[3, i], i))[:10]
    got = V.top_k(df, "e", [float(v) for v in f[3]], 10, ["id"]).orderBy("rank").collect()
    assert [r["id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, 11))
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("q"), F.col("e").alias("v"))
    out = V.batch_top_k(df, "e", "id", queries, "q", "v", 5, block=4).collect()
    for q in range(0, 200, 20):
        assert [r["id"] for r in sorted((r for r in out if r["q"] == q), key=lambda r: r["rank"])] == sorted(range(200), key=lambda i: (-s[q, i], i))[:5]
    assert V.batch_top_k(df, "e", "id", queries.limit(0), "q", "v", 5).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, 0, "Ash_2020.pdf"), (2, 2015, "oil.PDF"), (3, None, "x1.txt")], "id int, year int, filename string")
    ids = lambda c: {r["id"] for r in df.filter(c).collect()}
    assert ids(S.year_filter("year", high=2000)) == {1, 3} and ids(S.year_filter("year", low=2000)) == {2}
    assert ids(S.paper_filter(F.col("filename"), "*.pdf")) == {1, 2} and ids(S.paper_filter(F.col("filename"), "ASH")) == {1} and ids(S.paper_filter(F.col("filename"), "x[0-9].t?t")) == {3}
    assert S.paper_filter(F.col("filename"), "") is None and S.year_filter("year") is None


@pytest.mark.parametrize("given, pages", [("3-7", (3, 7)), ("4", (4, 4)), ("-5", (1, 5)), ("3-", (3, 3)), ("1-3-5", (1, 3))])
def test_page_range(given, pages):
    assert S.page_range(given) == pages


def test_keyword_ignores_case_in_any_script(spark):
    docs = spark.createDataFrame([(1, "a", "a.pdf", 2000, "t"), (2, "b", "b.pdf", None, "t")], "doc_id int, cite_key string, filename string, year int, title string")
    chunks = spark.createDataFrame([(1, 0, "нет", 4), (1, 1, "КАТАЛИЗ здесь", 5), (1, 2, "Катализ", 6), (2, 0, "катализ и катализ", None), (2, 1, None, 1)], "doc_id int, chunk_index int, text string, page_start int")
    out = S.keyword_search(chunks, docs, "Катализ").collect()
    assert [(r["doc_id"], r["hits"], r["page"]) for r in out] == [(1, 2, 5), (2, 1, None)] and out[0]["snippet"] == "КАТАЛИЗ здесь"
    assert S.keyword_search(chunks, docs, "катализ", paper="b.*").count() == 1 and S.keyword_total(chunks, "катализ").first().asDict() == {"documents": 2, "chunks": 3}


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = S.numbered(df, [F.asc("k")], "n").collect()
    assert sorted((r["k"], r["n"]) for r in out) == [(i, i + 1) for i in range(1000)] and S.numbered(df.limit(0), [F.asc("k")], "n").count() == 0


def test_resolve(spark):
    docs = spark.createDataFrame([(1, "one.pdf", "Smith2020", "Ash"), (2, "two.pdf", None, "Smith2020 and others")], "doc_id bigint, filename string, cite_key string, title string")
    out = {(r["ref"], r["doc_id"], r["tier"]) for r in S.resolve(docs, spark.createDataFrame([("1",), ("99",), ("Smith2020",), ("SMITH",), ("zzz",)], "ref string")).collect()}
    assert out == {("1", 1, 1), ("Smith2020", 1, 2), ("SMITH", 1, 3), ("SMITH", 2, 3)}


def test_keys_skip_those_taken(spark):
    docs = spark.createDataFrame([(i, f"/p{i:02}", "Lee, A.", 2000, "t", "f.pdf") for i in range(30)], "doc_id int, path string, authors string, year int, title string, filename string")
    keys = [r["cite_key"] for r in I.disambiguated_keys(docs).orderBy("doc_id").collect()]
    assert keys[:3] == ["Lee2000", "Lee2000a", "Lee2000b"] and keys[26] == "Lee2000z" and keys[27] == "Lee2000_27" and len(set(keys)) == 30
    taken = spark.createDataFrame([("Lee2000",), ("Lee2000b",)], "cite_key string")
    assert [r["cite_key"] for r in I.disambiguated_keys(docs, taken).orderBy("doc_id").collect()][:3] == ["Lee2000a", "Lee2000c", "Lee2000d"]


def test_file_sets(spark):
    known = spark.createDataFrame([(1, "/a", "s1", "ok"), (2, "/b", "s2", "error"), (3, "/c", "s3", "ok")], "doc_id int, path string, sha256 string, status string")
    files = spark.createDataFrame([("/a", "s1"), ("/b", "s2"), ("/c", "s9"), ("/d", "s9"), ("/e", "s1")], "path string, sha256 string")
    assert {tuple(r) for r in I.new_files(files, known).select("path", "sha256").collect()} == {("/b", "s2"), ("/c", "s9")}
    assert {r["doc_id"] for r in I.replaced(known, files).collect()} == {3} and {r["doc_id"] for r in I.missing_files(known, files.filter("path != '/a'")).collect()} == {1}


def test_digest_quota_and_coverage(spark):
    rows = [(1, 0, 10 + i, 0.9 - i / 100, i + 1, "a.pdf", i) for i in range(6)] + [(1, 1, 30, 0.6, 1, "b.pdf", 1), (1, 0, 31, 0.5, 7, "b.pdf", 1), (2, 0, 40, -0.1, 1, "c.pdf", 1)]
    hits = spark.createDataFrame(rows, "topic bigint, variant int, chunk_id int, score double, rank int, filename string, page_start int")
    out = A.digest(hits).orderBy("topic", "place").collect()
    assert [(r["topic"], r["chunk_id"]) for r in out] == [(1, 10), (1, 11), (1, 12), (1, 30)]
    keys = spark.createDataFrame([(1, "x"), (2, "y")], "topic bigint, keyword string")
    verdicts = {r["topic"]: (r["verdict"], r["best"]) for r in A.coverage(hits, keys, spark.createDataFrame([("y", 60)], "keyword string, documents bigint")).collect()}
    assert verdicts == {1: ("partial", 0.9), 2: ("partial", 0.0)}


def test_keywords_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "Gasification"), (2, "ASH gas"), (3, None)], "d int, text string")
    out = A.documents_with_keywords(docs, "d", "text", spark.createDataFrame([("gas",), ("ash",), ("gasific",), ("zz",)], "k string")).collect()
    assert {tuple(r) for r in out} == {("gas", 2), ("ash", 1), ("gasific", 1)}


def test_journal(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t + dt.timedelta(minutes=m), "s", "scan", lv, "f", f"m{m}", t + dt.timedelta(minutes=m + late)) for m, lv, late in ((0, "INFO", 0), (10, "warn", 0), (45, "Error", 90), (46, None, 0), (46, "TRACE", 0))]
    j = spark.createDataFrame(rows, "ts timestamp, session string, stage string, level string, source string, message string, received_at timestamp")
    assert J.counts(j).first().asDict() == {"info": 1, "warn": 1, "error": 1} and J.at_least(j, "warn").count() == 2
    assert sorted((r["n"], r["late"]) for r in J.sessions(j.filter("level IS NOT NULL")).collect()) == [(2, 0), (2, 1)] and J.tail(j, 2).count() == 2


def test_formulas_and_rtf():
    assert M.formula(r"\frac{a+b}{c}") == "(a+b)/c" and M.formula(r"\sqrt{x}_{1}^{2}") == "√(x)₁²" and M.formula(r"\mu_{max}\cdot S^*") == "μₘₐₓ· S*"
    assert M.formula(r"109{,}2 \xrightarrow{heat} y") == "109,2 —(heat)→ y" and M.formula("{open") == "open"
    assert M.formulas("a $$x^{2}$$ b") == "a x² b" and M.formulas(None) is None
    assert M.rtf_text("{\\rtf1 \\'ef\\'f0\\par x\\" + "u1078?}").split() == ["пр", "xж"]


def test_questions(spark):
    text = "P\n### Вопрос 1. A\n**Развёрнуто.** x\n**Источники.** S.\n### Вопрос 2. B\n**Развёрнуто.** y\n**Sub.**\nz\n**Источники.** T\n"
    rows = Q.split(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t")
    assert [(r["number"], r["title"]) for r in rows.orderBy("ord").collect()] == [("1", "A"), ("2", "B")]
    merged = Q.merge(rows, "2", "1", "More").collect()
    assert len(merged) == 1 and "**More.**\n\ny\n**Sub.**\nz" in merged[0]["body"] and "S; T" in merged[0]["body"]
    cut = Q.split_at(rows, "2", "**Sub", "2a", "New").collect()
    assert [r["number"] for r in cut if r["ord"] == 2] == ["2", "2a"] and all("**Источники.** T" in r["body"] for r in cut if r["ord"] == 2)


def test_hits_shuffle_no_table(spark, tmp_path):
    """Documents and texts are read by key; no join of theirs sorts or shuffles."""
    rng = np.random.default_rng(1)
    rows = [(i, i % 5, rng.normal(size=8).tolist(), "K", f"f{i}.pdf", 2000 + i % 20, 1, 2, "s") for i in range(500)]
    spark.createDataFrame(rows, "doc_id bigint, chunk_index int, embedding array<float>, cite_key string, filename string, year int, page_start int, page_end int, section string").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(i, f"t{i}", "A") for i in range(500)], "doc_id bigint, title string, authors string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(i, i % 5, "x" * 50) for i in range(500)], "doc_id bigint, chunk_index int, text string").write.parquet(str(tmp_path / "c"))
    v, d, c = (spark.read.parquet(str(tmp_path / n)) for n in "vdc")
    out = S.hits(v, d, c, rows[3][2], 4, year_max=2010)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("In(doc_id") >= 2 and "BroadcastHashJoin" in plan
    assert [r["rank"] for r in out.orderBy("rank").collect()] == [1, 2, 3, 4] and out.orderBy("rank").first()["doc_id"] == 3
    best = V.top_k(v, "embedding", rows[3][2], 4, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in best


def test_crowds_of_equal_scores(spark):
    """Of many equal vectors the smallest keys come first, in one question and in many, each key once."""
    rows = [(i % 700, [1.0, 0.0]) for i in range(2100)] + [(5000 + i, [0.6, 0.8]) for i in range(3)] + [(6000, None), (6001, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(7)
    assert [(r["id"], r["rank"]) for r in V.top_k(df, "v", [2.0, 0.0], 5, ["id"]).orderBy("rank").collect()] == [(i, i + 1) for i in range(5)]
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "q string, e array<float>")
    for block in (1, 20_000):
        got = [(r["q"], r["id"], r["score"]) for r in V.batch_top_k(df, "v", "id", q, "q", "e", 3, block).orderBy("q", "rank").collect()]
        assert got == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 5000, 0.8), ("b", 5001, 0.8), ("b", 5002, 0.8)]


def test_batches_over_vectors_of_several_lengths(spark, tmp_path):
    """Every query meets the vectors of its own length, in any block, and the named query asks with whole vectors only."""
    import duckdb

    from folioforge.plans import search

    rng = np.random.default_rng(3)
    x = {n: rng.normal(size=(3000 if n == 64 else 40, n)).astype(np.float32) for n in (32, 64)}
    rows = [(10 * i, x[64][i % 2900].tolist()) for i in range(3000)] + [(10 * i + 5, v.tolist()) for i, v in enumerate(x[32])]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    queries = df.filter("chunk_id % 50 IN (0, 5)").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("q"))
    want = {}
    for q in unit:
        if q % 50 in (0, 5):
            scores = {i: np.floor(np.round(unit[q] @ v, 12) * 1e4 + 0.5) / 1e4 for i, v in unit.items() if len(v) == len(unit[q])}
            want[q] = sorted((-s, i) for i, s in scores.items())[:10]
    for block, most in ((3, 300), (20_000, 30_000)):
        got = {}
        for r in V.batch_top_k(df.coalesce(2), "embedding", "chunk_id", queries.filter(F.col("query") < most), "query", "q", 10, block).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((-r["score"], r["chunk_id"]))
        assert got == {q: w for q, w in want.items() if q < most}
    df.write.parquet(str(tmp_path / "vectors.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW vectors AS SELECT * FROM '{tmp_path}/vectors.parquet/*.parquet'")
    told = lambda rows: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in rows)
    assert told(search.batch_knn(spark, str(tmp_path)).collect()) == told(duckdb.sql(search.ORACLE["batch_knn"]).fetchall())
