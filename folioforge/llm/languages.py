"""Missing or wrong document language labels (problem 7).

A bidirectional gated recurrent network over bytes, trained here in numpy, labels
every position; the labels of a sentence's positions are pooled, and a
document's languages are those of its whole sentences (in its text, its chunks
and the halves of its title) with the pooled probability as confidence.
``language_segments`` cuts every text where the labels of its positions change,
``document_languages`` pools all positions of a document, however short it is.

The network is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``); a
training window must agree with its label in the frequent words it holds.
Everything else reads every row whole.

Defined results: null and empty texts hold no sentence; a label that is null,
empty or names no known language names none; repeated rows change nothing; an
empty table gives an empty result; columns that are not named are not read.  A text
without a letter of the code page has no segment, a document without one no language.
"""

from __future__ import annotations

import base64
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.gru import BLANK, DIGIT, SIGN, BiGRU, encode, points
from folioforge.shared import spread

LANGUAGES = ("en", "ru", "uk", "de", "fr", "es")
# Names under which languages are delivered.
NAMES = {
    "en": ("en", "eng", "english", "английский", "англійська", "englisch", "anglais", "inglés"),
    "ru": ("ru", "rus", "russian", "русский", "російська", "russisch", "russe", "ruso"),
    "uk": ("uk", "ukr", "ukrainian", "украинский", "українська", "ukrainisch", "ukrainien", "ucraniano"),
    "de": ("de", "deu", "ger", "german", "немецкий", "німецька", "deutsch", "allemand", "alemán"),
    "fr": ("fr", "fra", "fre", "french", "французский", "французька", "französisch", "français", "francés"),
    "es": ("es", "spa", "spanish", "испанский", "іспанська", "spanisch", "espagnol", "español", "castellano"),
}
TRAIN_ROWS = 3_000
WINDOW = 96
HIDDEN = 16
CONFIDENCE = 0.92
SWITCH = 9.0  # log-odds that a change of language within a piece must make up for
LONGEST = 1_000  # characters that are labelled at once
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
ODD = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufb00-\ufb06\ufeff\uff01-\uff5e]")
TITLE_BREAK = re.compile(r"\s+(?:=|//?)\s+")
OTHER = len(LANGUAGES)

#: Ends of sentences: a full stop before a capital, an empty line, a line that begins anew.
BREAK = re.compile(r"(?<=[.!?…])[)\"»”]*\s+(?=[\"«„“(¿¡]*[A-ZÀ-ÞА-ЯЁЄІЇҐΑ-Ω\d])|\n\s*\n\s*|\n\s*(?=[A-ZÀ-ÞА-ЯЁЄІЇҐ\[•*+\-–—|]|\d+[.)]\s)")


def label_of(lang: Column) -> Column:
    """The language a delivered label names, or null."""
    plain = F.lower(F.trim(lang))
    short = F.regexp_extract(plain, r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(short.isin(*names), F.lit(code)).otherwise(out)
    return out


class Sentences:
    """Whole sentences of a batch of texts, as bytes, with the row each is from."""

    def __init__(self, texts: list[str | None], title: bool = False):
        self.rows: list[int] = []
        self.pieces: list[np.ndarray] = []
        parts, rows = [], []
        for row, text in enumerate(texts):
            if text:
                if not text.isascii() and ODD.search(text):
                    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
                split = TITLE_BREAK.split(text) if title else BREAK.split(text)
                parts += split
                rows += [row] * len(split)
        if not parts:
            return
        lengths = np.array([len(p) + 1 for p in parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        cp = points("\n".join(parts) + "\n")
        code = encode(cp)
        letter = code > 2
        word = letter & ~np.concatenate(([False], letter[:-1]))
        small = np.minimum(cp, 0xFFFF)
        capital = word & _CAPITAL[small]

        def total(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask.astype(np.int32), starts)

        n = lengths - 1
        letters, words, capitals, upper = total(letter), total(word), total(capital), total(letter & _CAPITAL[small])
        digits, semicolons, commas = total(code == DIGIT), total(small == ord(";")), total((small == ord(",")) | (small == ord("|")) | ((small == 9) & np.concatenate((code[1:] == DIGIT, [False]))))
        dots, numeric_commas = total(small == ord(".")), total((small == ord(",")) & np.concatenate((code[1:] == DIGIT, [False])))
        commas = commas - np.minimum(numeric_commas, digits)
        shouted = upper > 0.8 * letters
        first = small[starts]
        least = 4 if title else 6
        good = (
            (words >= least) & (letters >= 20) & (letters >= 0.5 * n) & (letters <= 14 * words)
            & (shouted | (capitals <= 0.6 * words)) & (words - capitals >= np.where(shouted, 0, 2 if title else 5))
            & (words >= 4 * (semicolons + 1) - 1) & (words >= 2 * (commas + 1)) & (dots <= words) & ~np.isin(first, _LISTED)
        )
        if title:
            good |= (words >= 4) & shouted & (letters >= 20)
        else:
            good &= ~shouted | (words >= 8)
        for k in np.flatnonzero(good):
            if " et al. / " in parts[k]:  # a running header
                continue
            self.rows.append(rows[k])
            self.pieces.append(code[starts[k] : ends[k] - 1])


_CAPITAL = np.array([chr(p).isupper() for p in range(0x10000)])
_LISTED = [ord(c) for c in "[•*+|"]


def _votes(words: list[str], common: dict[str, set[str]]) -> dict[str, int]:
    return {lang: sum(w in known for w in words) for lang, known in common.items()}


def _other_windows(rng: random.Random, sample: list[str], count: int) -> list[np.ndarray]:
    """Windows of no language: noise, wrongly decoded text, tables, names."""
    out = []
    for i in range(count):
        kind = i % 5
        if kind == 0:
            s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ,.'") for _ in range(WINDOW))
        elif kind == 1:
            s = base64.b64encode(rng.randbytes(WINDOW)).decode()
        elif kind == 2:
            s = rng.choice(sample).encode("utf-8").decode("latin-1") if sample else "?" * WINDOW
        elif kind == 3:
            s = "".join(rng.choice("!#$%*+,-./:;<=>?@[]^_{|}~ 0123456789") for _ in range(WINDOW))
        else:
            s = " ".join(rng.choice("ABCDEFGKLMNPRSTV") + "".join(rng.choice("bdklmnrstvz") + rng.choice("aeiouy") for _ in range(rng.randint(2, 4))) + "," for _ in range(20))
        c = encode(points(s))
        if len(c) >= WINDOW:
            at = rng.randint(0, len(c) - WINDOW)
            out.append(c[at : at + WINDOW])
    return out


def train(labelled: list[tuple[str, str]], common: list[tuple[str, str]], seed: int = 7, rounds: int = 450, hidden: int = HIDDEN) -> BiGRU:
    """Fit the network to (language, text) rows, leaving out windows whose frequent words disagree."""
    rng = random.Random(seed)
    known: dict[str, set[str]] = {lang: set() for lang in LANGUAGES}
    for lang, w in common:
        if lang in known:
            known[lang].add(w.lower())
    windows, labels, cyrillic = [], [], []
    per: dict[str, int] = dict.fromkeys(LANGUAGES, 0)
    for lang, text in labelled:
        picks = 0
        for part in BREAK.split(text or ""):
            if picks >= 40 or len(part) < WINDOW // 3:
                continue
            votes = _votes(re.findall(r"[^\W\d_]+", part.lower()), known)
            best = max(votes.values(), default=0)
            if best < 2 or votes.get(lang, 0) < best or sum(v == best for v in votes.values()) > 1:
                continue
            c = encode(points(part))
            if len(c) < WINDOW:
                c = np.concatenate((c, np.full(WINDOW - len(c), BLANK, dtype=np.uint8)))
            at = rng.randint(0, len(c) - WINDOW)
            windows.append(c[at : at + WINDOW])
            labels.append(LANGUAGES.index(lang))
            per[lang] += 1
            picks += 1
            if lang in ("ru", "uk") and len(cyrillic) < 200:
                cyrillic.append(part)
    model = BiGRU(hidden, len(LANGUAGES) + 1, seed)
    if not windows:
        return model
    noise = _other_windows(rng, cyrillic, max(200, len(windows) // 8))
    x, y = np.stack(windows + noise), np.array(labels + [OTHER] * len(noise))
    # Every class is drawn equally often.
    index = np.concatenate([np.resize(np.flatnonzero(y == c), 4000) for c in np.unique(y)])
    model.fit(x[index], y[index], rounds=rounds)
    return model


def fit_on(documents: DataFrame, text: str, title: str, lang: str, key: str, common: DataFrame, rows: int = TRAIN_ROWS) -> BiGRU:
    """Train on at most ``rows`` labelled documents, evenly over the languages, picked by a hash of the key."""
    from pyspark.sql import Window

    picked = (
        documents.select(label_of(F.col(lang)).alias("l"), F.concat_ws("\n\n", F.regexp_replace(title, r"\s+(=|//?)\s+", "\n\n"), F.col(text)).alias("t"), F.xxhash64(F.col(key)).alias("h"))
        .filter("l IS NOT NULL AND length(t) BETWEEN 100 AND 20000"))
    # A first, loose cut by the hash keeps the window small.
    total = documents.count()
    share = min(1.0, 12 * rows / max(1, total))
    picked = picked.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share))
    order = Window.partitionBy("l").orderBy("h")
    sample = picked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows // len(LANGUAGES)).select("l", "t").collect()
    sample = sorted((r["l"], r["t"]) for r in sample)
    return train(sample, sorted((r[0], r[1]) for r in common.select("lang", "word").collect()))


def sentence_languages(df: DataFrame, key: str, text: str, model: BiGRU, title: bool = False) -> DataFrame:
    """key, lang, sentences, confidence: the languages of each row's whole sentences."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            texts = batch.column("t").to_pylist()
            found: dict[tuple, list] = {}
            low = 0
            while low < len(texts):  # about two million characters at a time
                high, size = low, 0
                while high < len(texts) and (high == low or size < 2_000_000):
                    size += len(texts[high] or "")
                    high += 1
                s = Sentences(texts[low:high], title)
                if s.pieces:
                    p = model.label(s.pieces)
                    best = p.argmax(1)
                    sure = p[np.arange(len(p)), best]
                    for row, b, c in zip(s.rows, best.tolist(), sure.tolist()):
                        if b != OTHER and c >= CONFIDENCE:
                            e = found.setdefault((ids[low + row], b), [0, 0.0])
                            e[0] += 1
                            e[1] += c
                low = high
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], key_type), pa.array([LANGUAGES[k[1]] for k in found], pa.string()),
                 pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.float64())],
                [key, "lang", "sentences", "weight"])

    narrow = spread(df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("length(t) >= 20"))
    return narrow.mapInArrow(run, f"{key} {kind.simpleString()}, lang string, sentences bigint, weight double")


def _spans(text: str) -> list[tuple[int, int]]:
    """Where the pieces of a text stand: its sentences and lines, long ones in parts."""
    ends = [(m.start(), m.end()) for m in BREAK.finditer(text)]
    spans = []
    for low, high in zip([0, *(e for _, e in ends)], [*(b for b, _ in ends), len(text)]):
        while high - low > LONGEST:
            at = text.rfind(" ", low + LONGEST // 2, low + LONGEST)
            at = at if at > 0 else low + LONGEST
            spans.append((low, at))
            low = at
        if high > low:
            spans.append((low, high))
    return spans


def _paths(posterior: np.ndarray) -> np.ndarray:
    """The best sequence of labels of every piece when each change costs ``SWITCH``: (steps, pieces)."""
    classes, t, b = posterior.shape
    gain = np.log(np.maximum(posterior, 1e-6)).transpose(1, 2, 0)
    score = gain[0].copy()
    came = np.empty((t, b, classes), dtype=np.int8)
    own = np.arange(classes, dtype=np.int8)
    for i in range(1, t):
        top = score.argmax(1)
        other = score[np.arange(b), top] - SWITCH
        stay = score >= other[:, None]
        came[i] = np.where(stay, own, top[:, None])
        score = np.where(stay, score, other[:, None]) + gain[i]
    path = np.empty((t, b), dtype=np.int8)
    path[-1] = score.argmax(1)
    for i in range(t - 1, 0, -1):
        path[i - 1] = came[i][np.arange(b), path[i]]
    return path


def segments_of(texts: list[str | None], model: BiGRU) -> list[tuple[int, int, int, int, float]]:
    """(row, begin, end, language, confidence) of every stretch of one language, in order."""
    rows, spans, pieces = [], [], []
    for row, text in enumerate(texts):
        if not text:
            continue
        code = encode(points(text))
        for a, b in _spans(text):
            if (code[a:b] > SIGN).any():
                rows.append(row)
                spans.append((a, b))
                pieces.append(code[a:b])
    found: list[list] = [[] for _ in pieces]
    for part, posterior in model.batches(pieces):
        path = _paths(posterior)
        for j, k in enumerate(part):
            a, b = spans[k]
            steps = (len(pieces[k]) + 1) // 2
            own = path[:steps, j]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            low, begin = 0, a
            for high in [*cuts.tolist(), steps]:
                end = b
                if high < steps:  # a change is put before the word it is found in
                    end = texts[rows[k]].rfind(" ", begin, a + 2 * high) + 1 or a + 2 * high
                if own[low] != OTHER and end > begin:
                    found[k].append((rows[k], begin, end, int(own[low]), float(posterior[own[low], low:high, j].mean())))
                low, begin = high, max(begin, end)
    out: list[tuple[int, int, int, int, float]] = []
    for k, own in enumerate(found):
        for row, begin, end, lang, sure in own:
            # Successive pieces of one language are one segment.
            if out and out[-1][0] == row and out[-1][3] == lang and not texts[row][out[-1][2] : begin].strip(" \t\r\n\"»”)"):
                _, b0, e0, _, s0 = out.pop()
                sure = (s0 * (e0 - b0) + sure * (end - begin)) / (e0 - b0 + end - begin)
                begin = b0
            out.append((row, begin, end, lang, sure))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about two million characters of column ``t``."""
    for batch in batches:
        low = size = 0
        for i, t in enumerate(batch.column("t").to_pylist()):
            size += len(t or "")
            if size > 2_000_000:
                yield batch.slice(low, i + 1 - low)
                low, size = i + 1, 0
        if low < batch.num_rows:
            yield batch.slice(low)


def language_segments(df: DataFrame, keys: list[str], text: str, model: BiGRU) -> DataFrame:
    """keys, begin, end, lang, confidence: every stretch of one language in every text, as offsets of characters."""
    narrow = spread(df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).filter("t IS NOT NULL"))
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            found = segments_of(batch.column("t").to_pylist(), model)
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n).take(at) for n in names], pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()),
                 pa.array([LANGUAGES[f[3]] for f in found], pa.string()), pa.array([f[4] for f in found], pa.float64())],
                [*names, "begin", "end", "lang", "confidence"])

    fields = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    out = narrow.mapInArrow(run, fields + ", begin int, end int, lang string, confidence double")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "begin", "end", "lang", "confidence")


def pooled_labels(df: DataFrame, key: str, text: str, model: BiGRU) -> DataFrame:
    """key and the sums of the posteriors of each language, over all positions of each text."""
    narrow = spread(df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("t IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            rows, pieces = [], []
            for row, t in enumerate(batch.column("t").to_pylist()):
                code = encode(points(t))
                if (code > SIGN).any():
                    own = [code[a:b] for a, b in _spans(t)]
                    rows += [row] * len(own)
                    pieces += own
            if not pieces:
                continue
            weight = np.array([(len(p) + 1) // 2 for p in pieces], dtype=np.float64)
            p = model.label(pieces) * weight[:, None]
            total = np.zeros((batch.num_rows, len(LANGUAGES) + 1))
            np.add.at(total, np.array(rows), p)
            held = np.flatnonzero(total.sum(1) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(held)), *[pa.array(total[held, i]) for i in range(len(LANGUAGES) + 1)]], ["id", *LANGUAGES, "other"])

    sums = ", ".join(f"{lang} double" for lang in (*LANGUAGES, "other"))
    return narrow.mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, {sums}").withColumnRenamed("id", key)


def document_languages(documents: DataFrame, chunks: DataFrame, common: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, lang, confidence: the most probable language of every document with a letter in its text, chunks or title.

    The confidence is the share of the document's positions that are labelled so.
    """
    model = fit_on(documents, "text", "title", "lang", "doc_id", common, rows)
    parts = pooled_labels(documents, "doc_id", "text", model).unionByName(pooled_labels(chunks, "doc_id", "text", model)).unionByName(pooled_labels(documents, "doc_id", "title", model))
    sums = parts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in (*LANGUAGES, "other")])
    best = F.greatest(*[F.col(c) for c in LANGUAGES])
    lang = F.coalesce(*[F.when(F.col(c) == best, c) for c in LANGUAGES])
    return sums.select("doc_id", lang.alias("lang"), (best / sum(F.col(c) for c in (*LANGUAGES, "other"))).alias("confidence"))


def document_segments(documents: DataFrame, chunks: DataFrame, common: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, chunk_index (-1: the text, -2: the title), begin, end, lang, confidence of every segment."""
    model = fit_on(documents, "text", "title", "lang", "doc_id", common, rows)
    texts = chunks.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    for place, column in ((-1, "text"), (-2, "title")):
        texts = texts.unionByName(documents.select("doc_id", F.lit(place).alias("chunk_index"), F.col(column).alias("text")))
    return language_segments(texts, ["doc_id", "chunk_index"], "text", model)


def sentence_totals(documents: DataFrame, chunks: DataFrame, common: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, lang, sentences, confidence: every language a document has a whole sentence or title in."""
    model = fit_on(documents, "text", "title", "lang", "doc_id", common, rows)
    parts = (
        sentence_languages(documents, "doc_id", "text", model)
        .unionByName(sentence_languages(chunks, "doc_id", "text", model))
        .unionByName(sentence_languages(documents, "doc_id", "title", model, title=True)))
    return parts.groupBy("doc_id", "lang").agg(F.sum("sentences").alias("sentences"), (F.sum("weight") / F.sum("sentences")).alias("confidence"))


def unnamed_languages(documents: DataFrame, chunks: DataFrame, common: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, lang: the languages of a document that its label does not name."""
    labels = documents.select("doc_id", label_of(F.col("lang")).alias("named"))
    found = sentence_totals(documents, chunks, common, rows).select("doc_id", "lang")
    return found.join(labels, "doc_id").filter("named IS NULL OR named != lang").select("doc_id", "lang").distinct()
