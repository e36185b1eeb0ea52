import numpy as np
import pytest

from folioforge.llm.gru import BiGRU, encode, points
from folioforge.llm.languages import LANGUAGES, OTHER, Sentences, document_languages, document_segments, label_of, segments_of, train, unnamed_languages

TEXTS = {
    "en": ["the river was low that summer and the boats stayed in the harbour", "when the mill closed most of the people moved to the city by the sea", "it is known that the bridge was built for the market and not for the army"],
    "de": ["der fluss war in diesem sommer niedrig und die boote blieben im hafen", "als die mühle schloss zogen die meisten leute in die stadt am meer", "es ist bekannt dass die brücke für den markt gebaut wurde und nicht für das heer"],
    "fr": ["la rivière était basse cet été et les bateaux sont restés dans le port", "quand le moulin a fermé la plupart des gens sont partis dans la ville", "on sait que le pont a été construit pour le marché et non pour les soldats"],
    "es": ["el río estaba bajo ese verano y los barcos se quedaron en el puerto", "cuando cerró el molino la mayor parte de la gente se fue a la ciudad", "se sabe que el puente fue construido para el mercado y no para los soldados"],
    "ru": ["река в это лето была мелкой и лодки не выходили из гавани на запад", "когда мельница закрылась почти все люди уехали из села в город", "известно что мост был построен для рынка и не для войска или флота"],
    "uk": ["річка цього літа була мілкою і човни не виходили із гавані на захід", "коли млин зачинився майже всі люди поїхали із села до міста", "відомо що міст був збудований для ринку і не для війська чи флоту"],
}
COMMON = [("en", w) for w in "the was and that it is to of for when in".split()] + [("de", w) for w in "der die und in das war es ist im für nicht".split()]
COMMON += [("fr", w) for w in "la le les et dans que des était pour on a".split()] + [("es", w) for w in "el la los y en que se no de fue para".split()]
COMMON += [("ru", w) for w in "и в не для что из на была был все это или".split()] + [("uk", w) for w in "і не для що із на була був всі до цього чи".split()]


def many(lang):
    rng = np.random.default_rng(1)
    words = [w for t in TEXTS[lang] for w in t.split()]
    return [". ".join(" ".join(rng.choice(words, 12)).capitalize() for _ in range(6)) + "." for _ in range(25)]


@pytest.fixture(scope="module")
def model():
    return train([(lang, t) for lang in LANGUAGES for t in many(lang)], COMMON, rounds=260)


def test_gradients():
    net = BiGRU(3, 4, 1)
    rng = np.random.default_rng(2)
    a, b, y = rng.integers(0, 20, (5, 6)), rng.integers(0, 20, (5, 6)), rng.integers(0, 4, 6)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, grad = net.step(a, b, y)
    for k in net.w:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        keep = net.w[k][at]
        net.w[k][at] = keep + 1e-3
        up = net.step(a, b, y)[0]
        net.w[k][at] = keep - 1e-3
        down = net.step(a, b, y)[0]
        net.w[k][at] = keep
        assert grad[k][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-5), k


def test_held_out_accuracy(model):
    right = total = 0
    for lang, texts in TEXTS.items():
        p = model.label([encode(points(t)) for t in texts])
        right += int((p.argmax(1) == LANGUAGES.index(lang)).sum())
        total += len(texts)
    assert right / total >= 0.9
    assert (model.label([encode(points("$#%&{}[]|<>?+-*/=" * 8))]).argmax(1) == OTHER).all()


def test_batches_do_not_matter(model):
    pieces = [encode(points(t)) for ts in TEXTS.values() for t in ts] + [np.zeros(0, dtype=np.uint8)]
    assert np.allclose(model.label(pieces, 512)[:-1], [model.label([p])[0] for p in pieces[:-1]], atol=0.03)


def test_sentences():
    s = Sentences(["First whole sentence of the text stands here. Second one follows it and is as long.\n\nHeading\n\n1) straw;\n2) ash;", None, "", "S1 | 4.5 | 6.7 | 8.9", "Annals of Fuel Studies 2016, 5, 12"])
    assert s.rows == [0, 0]


def test_labels(spark):
    rows = [("en",), ("ENG",), ("English",), ("en-US",), ("русский",), ("UK",), ("xx",), (None,), ("",), ("fr_FR",)]
    out = [r[0] for r in spark.createDataFrame(rows, "lang string").select(label_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("lang"))).collect()]
    assert out == ["en", "en", "en", "en", "ru", "uk", None, None, None, "fr"]


def test_rows(spark):
    docs, chunks, i = [], [], 0
    for lang in LANGUAGES:
        for t in many(lang):
            i += 1
            docs.append((i, t, lang, "Short", "x"))
            chunks.append((i, t))
    docs += [(900, many("ru")[0], "en", None, "x"), (901, many("en")[0], None, "", "x"), (902, None, None, None, "x"), (903, many("fr")[0], "fr", None, "x")]
    chunks += [(903, many("de")[0]), (904, None), (903, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, title string, confidence string")
    c = spark.createDataFrame(chunks, "doc_id bigint, text string")
    w = spark.createDataFrame(COMMON, "lang string, word string")
    got = {tuple(r) for r in unnamed_languages(d, c, w).collect()}
    assert {(900, "ru"), (901, "en"), (903, "de")} <= got and len(got) <= 6
    assert unnamed_languages(d.limit(0), c.limit(0), w).count() == 0


def test_segments(model):
    """Several languages in one text, also within one sentence; offsets are those of the text."""
    de, ru, en = many("de")[0], many("ru")[1], many("en")[2]
    texts = [None, "", "12 | 34 | --", de + "\n\n" + ru + " " + en, de]
    found = segments_of(texts, model)
    assert {f[0] for f in found} == {3, 4} or {f[0] for f in found} == {2, 3, 4}
    own = [f for f in found if f[0] == 3]
    for lang, part in (("de", de), ("ru", ru), ("en", en)):
        at = texts[3].index(part)
        held = sum(min(e, at + len(part)) - max(b, at) for _, b, e, k, _ in own if LANGUAGES[k] == lang and b < at + len(part) and e > at)
        assert held > 0.9 * len(part), (lang, own)
    assert all(0 <= f[4] <= 1.0001 for f in found) and all(a[2] <= b[1] for a, b in zip(own, own[1:]))
    mixed = many("ru")[3].rstrip(".") + " " + many("en")[4].lower()
    kinds = [LANGUAGES[f[3]] for f in segments_of([mixed], model) if f[2] - f[1] > 40]
    assert kinds[0] == "ru" and kinds[-1] == "en"


def test_every_document_has_a_language(spark):
    docs, chunks, i = [], [], 0
    for lang in LANGUAGES:
        for t in many(lang):
            i += 1
            docs.append((i, t, lang, "Short", "x"))
            chunks.append((i, 0, t))
    docs += [(900, "und das Heer zog", None, None, "x"), (901, None, "de", None, "x"), (902, "1 2 3 !!", None, "", "x"), (903, None, None, "что мост был для рынка", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, title string, begin string")
    c = spark.createDataFrame(chunks, "doc_id bigint, chunk_index int, text string")
    w = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r["doc_id"]: r["lang"] for r in document_languages(d, c, w).collect()}
    assert len(got) == i + 2 and got[900] == "de" and got[903] == "ru"
    assert sum(got[k + 1] == docs[k][2] for k in range(i)) > 0.97 * i
    rows = document_segments(d, c, w).filter("doc_id >= 900").collect()
    assert {(r["doc_id"], r["chunk_index"]) for r in rows} == {(900, -1), (903, -2)}
    assert document_languages(d.limit(0), c.limit(0), w).count() == 0 == document_segments(d.limit(0), c.limit(0), w).count()
