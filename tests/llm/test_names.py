import itertools
import random

import pytest

from folioforge.llm.names import fold, near, neighbours, organisation_words, organisations_of, parse, people, same_organisation, shard_keys, trie_join, trie_of, variant_pairs


def distance(a, b):
    """Optimal string alignment, the plain way."""
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_against_brute_force():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    trie = trie_of(words)
    for w in words:
        for k in (0, 1, 2):
            got = neighbours(trie, w, k)
            assert {x for x in words if distance(w, x) <= k} == got if k < 2 else got >= {x for x in words if distance(w, x) < 2}
    pairs = {(a, b) for a in words for b in words if a != b and distance(a, b) == 1}
    assert set(trie_join(words)) == pairs == set(trie_join(words, 1, backwards=True))
    assert all(near(a, b) == (distance(a, b) <= 1) for a in words[:60] for b in words)


@pytest.mark.parametrize("name, folded", [("Бетещев Олег", "beteshchev oleg"), ("Ю. Дясдиев", "y. dyasdiev"), ("Klöwick, T.", "klowick, t."), ("Ｐuckt, M.", "puckt, m."), ("Lаrа Ζat", "lara zat")])
def test_fold(name, folded):
    assert fold(name) == folded


def test_parse():
    known = {"oleg"}
    assert parse("Beteshchev, Oleg", known) == [("beteshchev", "oleg", "")] == parse("Oleg Beteshchev", known) == parse("Beteshchev Oleg", known)
    assert parse("O.P. Beteshchev", known) == [("beteshchev", "", "op")] == parse("BETESHCHEV, O. P.", known) == parse("Beteshchev O.P.", known)
    assert len(parse("Mara Nolan", known)) == 2 and parse("...", known) == []


def test_people():
    rows = [("Kolb, Nikolai", "nikolai", "", 5), ("Kolb, N.", "", "n", 2), ("Kolya Kolb", "kolya", "", 1), ("Kolb, Irina", "irina", "", 3), ("I. Kolb", "", "i", 1), ("Kolb, B.", "", "b", 1)]
    assert sorted(map(sorted, people(rows))) == [["I. Kolb", "Kolb, Irina"], ["Kolb, B."], ["Kolb, N.", "Kolb, Nikolai", "Kolya Kolb"]]
    ambiguous = [("Kolb, Nikolai", "nikolai", "", 5), ("Kolb, Nestor", "nestor", "", 5), ("Kolb, N.", "", "n", 2)]
    assert all(len(p) == 1 for p in people(ambiguous))


def test_organisations():
    words = [organisation_words(fold(n)) for n in ("Veltan Academy of Porous Materials", "Acad. Porous Mater., Veltan", "VELTAN ACADEMY OF POROUS MATERIALS (VAPM)", "Morask Academy of Porous Materials")]
    assert same_organisation(words[0], words[1]) and same_organisation(words[0], words[2]) and not same_organisation(words[0], words[3])
    assert organisation_words("kolb, nikolai") is None


def test_rows(spark):
    lists = ["Kolbenko, Nikolai; Sundt, A.", " N. Kolbenko ;et al.;;unknown", "Nikolai Kolbenko; Kolbenk, Nikolai", "Kolbenko, Irina", None, "", "Kolbenko, Nikolai; Sundt, A.", "Колбенко, Н.", "n/a", "Zhirkhotsyan, Boris", "Jirhocian, Boris", "Jirhocin, B."]
    lists += [f"Other{c}man, Nikolai; Irina Other{c}man" for c in "abc"]
    df = spark.createDataFrame([(a, "x") for a in lists], "authors string, name_a string")
    got = {tuple(r) for r in variant_pairs(df, "authors").collect()}
    same = sorted(["Kolbenko, Nikolai", "N. Kolbenko", "Nikolai Kolbenko", "Kolbenk, Nikolai", "Колбенко, Н."])
    assert {p for p in got if "olbenk" in p[0].lower() or "олбенк" in p[1]} == set(itertools.combinations(same, 2))
    assert set(itertools.combinations(["Jirhocian, Boris", "Jirhocin, B.", "Zhirkhotsyan, Boris"], 2)) <= got
    assert all(a < b for a, b in got) and not any("unknown" in p or "et al." in p for p in got)
    assert variant_pairs(df.limit(0), "authors").count() == 0


def test_any_two_near_words_share_a_shard():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(260)})
    for k in (1, 2):
        keys = {w: set(shard_keys(w, k)) for w in words}
        for a, b in itertools.combinations(words, 2):
            if distance(a, b) <= k:
                assert keys[a] & keys[b], (a, b, k)


def test_errors_anywhere_in_short_and_chained_families(spark):
    lists = ["Kotov, Ivan"] * 3 + ["Kodov, Ivan", "Ktov, Ivan", "Petrovsky, Olga", "Petrovsky, Olga", "Petrovzky, Olga", "abdcef, Ivan", "abcdef, Ivan", "abcdef, Ivan"]
    # Each spelling of a chain is one error from the next and more frequent than the one before.
    chain = ["Aaaaaaa", "Baaaaaa", "Bbaaaaa", "Bbbaaaa", "Bbbbaaa", "Bbbbbaa", "Bbbbbba"]
    lists += [f"{w}, Zoya" for i, w in enumerate(chain) for _ in range(i + 1)]
    got = {tuple(r) for r in variant_pairs(spark.createDataFrame([(a,) for a in lists], "authors string"), "authors").collect()}
    for a, b in (("Kodov, Ivan", "Kotov, Ivan"), ("Kotov, Ivan", "Ktov, Ivan"), ("Petrovsky, Olga", "Petrovzky, Olga"), ("abcdef, Ivan", "abdcef, Ivan")):
        assert (a, b) in got
    assert ("Aaaaaaa, Zoya", "Bbbbbba, Zoya") in got


def test_organisations_against_all_comparisons():
    rng = random.Random(3)
    stock = ["institute", "fuels", "catalysis", "academy", "biomass", "regional", "centre", "kiln", "oils"]
    spelled = {}
    for i in range(120):
        words = sorted(rng.sample(stock, rng.randint(3, 5)))
        k = rng.randrange(len(words))
        words[k] = rng.choice([words[k], words[k][:4], words[k][:2] + words[k][3:]])
        spelled.setdefault(tuple(sorted(words)), set()).add(f"n{i}")
    sets, kept = [], []
    for words, names in sorted(spelled.items()):
        at = next((i for i, w in enumerate(kept) if same_organisation(list(words), w)), None)
        if at is None:
            sets.append(set(names))
            kept.append(list(words))
        else:
            sets[at] |= names
    assert organisations_of(spelled) == sets
