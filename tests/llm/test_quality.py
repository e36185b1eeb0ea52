import numpy as np
import pytest

from folioforge.llm.quality import Mixture, statistics, text_kinds
from folioforge.llm.quality_examples import EXAMPLES

COMMON = "the of and to in a is that for was и в на при с для что не der die und von la le les et el los y en que".split()
SCHEMA = "doc_id bigint, text string, kind string"


def test_statistics_of_a_small_text(spark):
    df = spark.createDataFrame([(1, "The cat sat.\nOn 12 mats!\n\n- a list", "x"), (2, None, "x"), (3, " \n ", "x"), (4, "", "x"), (5, "\u00a0\u2007", "x")], SCHEMA)
    rows = statistics(df, "doc_id", "text", COMMON).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["n_chars"], r["n_words"], r["n_lines"]) == (34, 7, 3) and r["ended_line_share"] == pytest.approx(2 / 3) and r["symbol_ratio"] == pytest.approx(3 / 34)
    assert r["mean_word_length"] == pytest.approx(20 / 7) and r["common_word_share"] == pytest.approx(2 / 7)


def test_responsibilities_against_the_formula():
    rng = np.random.default_rng(1)
    centres, spreads = rng.normal(size=(2, 3)), np.stack([np.eye(3) * 2, np.diag([1.0, 2.0, 0.5])])
    m = Mixture(np.zeros(3), np.ones(3), np.array([0.3, 0.7]), centres, spreads)
    x = rng.normal(size=(5, 3))
    p = np.array([[w * np.exp(-0.5 * (v - c) @ np.linalg.inv(s) @ (v - c)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(s)) for w, c, s in zip(m.weights, centres, spreads)] for v in x])
    r, ll = m.responsibilities(x)
    assert np.allclose(r, p / p.sum(1, keepdims=True)) and np.allclose(ll, np.log(p.sum(1)))


def test_held_out_kinds(spark):
    rows, i = [], 0
    want = {}
    for kind, groups in EXAMPLES.items():
        for group in groups:
            for t in group:
                for k in range(8 if kind == "prose" else 2):  # other words and figures, same build
                    i += 1
                    rows.append((i, t.translate(str.maketrans("13579", "79135")) + (" And so on until the evening came." if kind == "prose" and k % 2 else ""), "x"))
                    want[i] = kind
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "A very long text of prose. " * 20_000, "x"), (1, rows[0][1], "x")]
    out = text_kinds(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", COMMON).collect()
    got = {r["doc_id"]: r["kind"] for r in out}
    assert 5000 not in got and 5001 not in got and 5002 in got and len(out) == len(rows) - 2
    assert np.mean([(got[i] == "prose") == (w == "prose") for i, w in want.items()]) >= 0.95
    assert text_kinds(spark.createDataFrame([], SCHEMA), "doc_id", "text", COMMON).count() == 0
