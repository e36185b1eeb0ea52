import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.llm.lookalikes import consistent_sql, consistent_text


def fixed(values, names=False):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return [(r[1], r[2]) for r in con.execute(f"SELECT * FROM ({consistent_sql('t', 'k', 's', names)}) ORDER BY k").fetchall()]


@pytest.mark.parametrize("given, plain", [
    ("Ｐｕｃｋ ﬁjo", "Puck fijo"), ("Glаszellе wаr", "Glaszelle war"), ("активaции тeчeниe", "активации течение"), ("\u0438\u0306 e\u0301", "\u0439 \u00e9"),
    ("a\u200bb\u00a0c\u2009d", "ab c d"), ("после c ростом", "после с ростом"), ("a cаt sat", "a cat sat"), ("a hat оf а kind", "a hat of a kind"), ("Aktivkοhle", "Aktivkohle"),
])
def test_changed(given, plain):
    assert fixed([given]) == [(plain, True)]


@pytest.mark.parametrize("given", ["pH-метром α-олефинов 22 °C на", "μm and ν", "при 20 °C на 5 K", "Étude – «ça» · °\n\tx", "", "C12–C18 olefins"])
def test_ordinary(given):
    assert fixed([given]) == [(given, False)]


def test_names_are_of_one_script():
    out = fixed(["Lаrа Ζatlirzytseν; Т. Keshunev; H. Жявусовец", "Бетещев Олег; B. Nozeölo; et al."], names=True)
    assert out[0] == ("Lara Zatlirzytsev; T. Keshunev; Н. Жявусовец", True)
    assert out[1][1] is False


def test_rows_nulls_long_texts_and_extra_columns(spark):
    rows = [(1, 0, None, "x"), (2, 0, "", "x"), (3, 0, "теxт " * 20_000, "x"), (3, 0, "теxт " * 20_000, "x"), (4, 0, "plain", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, text string, fixed string")
    out = {(r["doc_id"], r["changed"]): r["fixed"] for r in consistent_text(df, "text", ["doc_id", "chunk_index"]).collect()}
    assert out[1, False] is None and out[2, False] == "" and out[3, True] == "техт " * 20_000 and out[4, False] == "plain"
    assert consistent_text(df, "text", ["doc_id"], only_changed=True).filter(F.col("doc_id") == 3).count() == 2
    assert consistent_text(df.limit(0), "text", ["doc_id"]).count() == 0


def test_planted_forms_are_taken_back(spark):
    """Every kind of disguise of random words comes back letter by letter, undisguised text stays as it is."""
    import random
    import unicodedata

    rng = random.Random(11)
    latin = "catalyst répété prüfung kohle ash yield of seeds and pyrolysis à été señal über biomass".split()
    cyrillic = "выход смолы и зола жмыха были измерены ещё при нагреве його вміст єдиний йод".split()
    to_cyrillic, to_latin = dict(zip("aceopxyHKMT", "асеорхуНКМТ")), dict(zip("асеорху", "aceopxy"))

    def one_letter(word, table):
        at = [i for i, c in enumerate(word) if c in table]
        k = rng.choice(at)
        return word[:k] + table[word[k]] + word[k + 1 :]

    rows, want = [], {}
    for i in range(400):
        words = [rng.choice(latin if i % 2 else cyrillic) for _ in range(12)]
        plain = " ".join(words)
        kind = rng.randrange(7)
        k = rng.randrange(12)
        if kind == 1:
            definite = [j for j, w in enumerate(words) if len(w) > 4 and any(c in (to_cyrillic if i % 2 else to_latin) for c in w) and (any(c in "lnbrdtsfgké" for c in w) if i % 2 else any(c in "вдлмжызтнкйш" for c in w))]
            k = rng.choice(definite) if definite else None
            if k is not None:
                words[k] = one_letter(words[k], to_cyrillic if i % 2 else to_latin)
        elif kind == 2:
            words[k] = words[k][:1] + rng.choice("​⁠­﻿") + words[k][1:]
        elif kind == 3:
            words = [" ".join(words[:k]) + rng.choice("   ") + " ".join(words[k:])] if k else [" ".join(words)]
        elif kind == 4:
            words = [unicodedata.normalize("NFD", w) for w in words]
        elif kind == 5 and i % 2:
            words[k] = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in words[k])
        elif kind == 6 and i % 2:
            words[k] = "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in words[k])
        text = " ".join(words)
        rows.append((i, text))
        want[i] = (plain, text != plain)
    rows += [(1000, "no change: mm² ½ № 5 … µm → α-olefins"), (1001, "Ⅳ. Ⅻ"), (1002, None), (1003, "")]
    out = {r["id"]: r for r in consistent_text(spark.createDataFrame(rows, "id int, text string"), "text", ["id"]).collect()}
    for i, (plain, changed) in want.items():
        assert (out[i]["fixed"], out[i]["changed"]) == (plain, changed), (i, rows[i])
    assert not out[1000]["changed"] and out[1001]["fixed"].startswith("IV. ") and out[1002]["fixed"] is None and out[1003]["fixed"] == ""
