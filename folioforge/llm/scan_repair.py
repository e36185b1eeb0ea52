"""Noise in text from scanned pages (problem 2).

Two passes over all texts.  The first counts, per text once: words, hyphenated
compounds, pairs of fragments around a broken word, and the shingles (two
successive words or signs, figures masked) of lines that stand, unfinished, inside a
sentence - page edges, where headers and footers repeat with other numbers and
names.  From the counts follow, word by word and never text by text:

* misread words: rare words with the skeleton (letters that scanners confuse
  taken as one) of a word that is far more frequent;
* broken words: pairs whose parts make a word of the corpus, not a compound;
* header shingles: those that repeat at page edges, and stand there for a good
  part of the texts that hold their words.

A line is a header if half of its shingles are such: it is like many other edge
lines without being equal to any.  A page number is a line of its own, or set off
by a wide gap from a name or title in capitals; numbers need not rise from one
text to the next, as texts are pieces.

The second pass removes headers and page numbers, joins broken words, joins the
lines of every text, damaged or not, and mends misread words.

Defined results: null gives null and no damage; an empty text stays empty; texts
are read whole; repeated rows count as often as they occur and get equal results;
ties between equally frequent words go to the first in code-point order; an
empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.shared import cut, spread

TIMES = 10  # a misread word is so many times rarer than the word meant
SHARE = 0.002  # and stands in no more than this share of all texts
LEAST = 4  # texts that hold a word of the corpus
HEADER_TEXTS = 3  # whose edge lines share a shingle
HEADER_SHARE = 0.05  # of the texts that hold the rarest word of a header shingle
SHIPPED_ENTRIES = 400_000  # dictionaries above this are joined, not shipped
FLUSH = 200_000

INVISIBLE = re.compile("[͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
TOKEN = re.compile(r"!?[^\W_]++(?:![^\W_]++)*+")
COMPOUND = re.compile(r"(?<![^\W_])([^\W\d_]++)-([^\W\d_]++)(?![^\W_]|-)")
#: A word broken by a mark at a line's end, or by a hyphen and a blank.
BROKEN = re.compile(r"(?<![^\W_])([^\W_]++)([-¬@=\xad])(?:[^\S\n]*+(\n)\s*+| )([^\W_]++)")
SOFT = set("¬@=­")
PAGE = re.compile(
    r"\s*(?:[-–—·•|*\[(]+\s*)?(?:(?:page|p\.|pp\.|seite|s\.|pág\.|стр\.|с\.|сторінка|страница)\s*)?\d{1,4}"
    r"(?:\s*(?:/|of|von|de|sur|из|з)\s*\d{1,4})?\s*(?:[-–—·•|*\])]+)?\s*|\s*[ivxlc]{1,7}\s*", re.IGNORECASE)
DECIMAL = re.compile(r"\d[.,]\d|[%°]")
EDGE = re.compile(r"\d|[/·|—]")
ENDED = re.compile(r"[.!?:;…][)\"»”']*\s*$")
SHOUTED = re.compile(r"\s*(?:\d{1,4}\s{2,}[^a-zа-яёіїє\d\n]{3,}|[^a-zа-яёіїє\d\n]{3,}\s{2,}\d{1,4})\s*")
#: The same run into a line of small letters: a number and a shouted name, or a shouted title and a number.
RUN_IN = re.compile(r"(?:(?<=[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁІЇЄ] )|(?<=[\d%.,°] ))(?:\d{1,4}\s{2,}[A-ZÀ-ÖØ-ÞА-ЯЁІЇЄ][A-ZÀ-ÖØ-ÞА-ЯЁІЇЄ'-]{3,}|[A-ZÀ-ÖØ-ÞА-ЯЁІЇЄ][A-ZÀ-ÖØ-ÞА-ЯЁІЇЄ' ,:()-]{11,}\s{2,}\d{1,4})(?=\s|$)")
CAPITALISED = re.compile(r"[^\W\d_a-zà-öø-ÿа-яёіїє][^\W\d_]{2,}")
LINKING = re.compile(r"on|of|and|the|et|al\.|in|[\d,.()–-]+|[/·|—]")
FIGURE = re.compile(r"\(?\d{1,4}(?:[–-]\d{1,4})?\)?,?")
MARK = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
SIGNS = {"/", "·", "|", "—", "–"}
REFERENCE = re.compile(r"\s*(?:\[\d+\]|\d+\.\s+[^\W\d_]+ [A-ZА-Я]\.)")

# What scanners take for one another, longer forms first.
LATIN_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ü", "ti"), ("ii", "u"))
CYRILLIC_PAIRS = (("ь1", "ы"), ("ьl", "ы"), ("ь!", "ы"))
LATIN_LIKE = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "8": "b", "!": "i", "c": "e", "h": "b", "f": "t", "v": "y", "í": "i", "4": "a", "3": "e", "7": "t", "2": "z"})
CYRILLIC_LIKE = str.maketrans({"0": "о", "г": "т", "п": "л", "н": "л", "и": "л", "й": "л", "8": "в", "6": "б", "4": "ч", "3": "з", "э": "з", "с": "е", "щ": "ш", "1": "і", "!": "і"})
_LATIN_LETTER = re.compile(r"[a-zß-öø-ÿœ]")
_CYRILLIC_LETTER = re.compile(r"[а-яёіїєґ]")


def clean(text: str) -> str:
    """Without invisible characters and with accents composed; unlike text is problem 3's matter."""
    if text.isascii():
        return text
    if INVISIBLE.search(text):
        text = INVISIBLE.sub("", text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def skeleton(word: str) -> str | None:
    """The form that a word shares with its misreadings, None for what is no word of one script."""
    latin, cyrillic = bool(_LATIN_LETTER.search(word)), bool(_CYRILLIC_LETTER.search(word))
    if latin == cyrillic or sum(map(str.isalpha, word)) < 2:
        return None
    # Misreadings hold only letters of the script, digits and "!".
    for ch in word:
        if not ("0" <= ch <= "9" or ch == "!" or (_LATIN_LETTER if latin else _CYRILLIC_LETTER).match(ch)):
            return None
    for a, b in LATIN_PAIRS if latin else CYRILLIC_PAIRS:
        word = word.replace(a, b)
    return word.translate(LATIN_LIKE if latin else CYRILLIC_LIKE)


def edges(lines: list[str]) -> list[tuple[int, bool]]:
    """Lines that may stand at a page's edge, and whether they interrupt a sentence."""
    found = []
    full = [i for i, line in enumerate(lines) if line.strip()]
    for at, i in enumerate(full):
        line = lines[i].strip()
        if len(line) > 110 or not PAGE.fullmatch(line) and (line[0].islower() or not EDGE.search(line)):
            continue
        before = lines[full[at - 1]].strip() if at else ""
        after = lines[full[at + 1]].strip() if at + 1 < len(full) else ""
        # Of several edge lines in a row, the text lies beyond them.
        k = at - 1
        while k > 0 and len(before) < 110 and (PAGE.fullmatch(before) or SHOUTED.fullmatch(before)):
            k -= 1
            before = lines[full[k]].strip()
        found.append((i, bool(before) and not ENDED.search(before) and bool(after)))
    return found


def shingles(line: str) -> list[str]:
    """Pairs of successive words and signs, figures masked, that hold a word of three letters."""
    marks = ["#" if t.isdigit() else t for t in MARK.findall(line.lower())]
    return [f"{a} {b}" for a, b in zip(marks, marks[1:]) if len(a) > 2 or len(b) > 2]


def _count(texts: list[str | None], into: Counter) -> None:
    for text in texts:
        if not text:
            continue
        text = clean(text)
        into["n"] += 1
        low = text.lower()
        keys = {"w" + w for w in TOKEN.findall(low)}
        if "-" in low:
            keys |= {f"k{a}-{b}" for a, b in COMPOUND.findall(low)}
        if "\n" in text or "- " in text or "@" in text or "¬" in text or "=" in text:
            for m in BROKEN.finditer(low):
                a, mark, b = m.group(1, 2, 4)
                keys.add(f"h{a}\t{mark}\t{b}")
        if "\n" in text:
            lines = text.split("\n")
            for i, inside in edges(lines):
                if inside and not DECIMAL.search(lines[i]) and not ENDED.search(lines[i]):
                    keys |= {"e" + x for x in shingles(lines[i])}
        into.update(keys)


def corpus_counts(texts: DataFrame, column: str) -> DataFrame:
    """key, n: in how many texts each word, compound, broken pair and page-edge shingle stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.int64())], ["key", "n"])
            into.clear()
            return out

        for batch in batches:
            _count(batch.column("t").to_pylist(), into)
            if len(into) > FLUSH:
                yield flush()
        yield flush()

    parts = texts.select(F.col(column).alias("t")).mapInArrow(run, "key string, n bigint")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def _with_skeleton(df: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([skeleton(w) if w else None for w in batch.column(column).to_pylist()], pa.string())],
                [*batch.schema.names, "skel"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, fields + ", skel string")


def dictionaries(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, meant) of misread words and (pair, action) of broken ones, with header shingles as action 'header'."""
    total = counts.filter("key = 'n'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind = lambda k: counts.filter(F.substring("key", 1, 1) == k).select(F.expr("substring(key, 2)").alias("x"), "n")
    words = cut(_with_skeleton(kind("w").filter("x != ''"), "x"), "words")
    best = words.filter("skel IS NOT NULL AND NOT x rlike '[0-9!]'").groupBy("skel").agg(
        F.max(F.struct(F.col("n"), F.col("x"))).alias("b")).select("skel", F.col("b.n").alias("bn"), F.col("b.x").alias("bx"))
    best = best.filter(F.col("bn") >= LEAST)
    misread = words.join(best, "skel").filter(
        (F.col("x") != F.col("bx")) & (F.col("bn") >= TIMES * F.col("n")) & (F.col("n") <= F.greatest(F.lit(3.0), F.lit(SHARE * total)))
    ).select(F.col("x").alias("word"), F.col("bx").alias("meant"))
    parts = F.split("x", "\t")
    pairs = kind("h").select(F.col("x").alias("pair"), parts[0].alias("a"), parts[1].alias("mark"), parts[2].alias("b"))
    pairs = _with_skeleton(pairs.withColumn("ab", F.concat("a", "b")), "ab")
    known = words.select(F.col("x").alias("ab"), F.col("n").alias("n_ab"))
    compounds = kind("k").select(F.col("x").alias("compound"), F.col("n").alias("n_k"))
    decided = (
        pairs.withColumn("compound", F.concat_ws("-", "a", "b"))
        .join(known, "ab", "left").join(compounds, "compound", "left").join(best, "skel", "left"))
    n_k, n_ab = F.coalesce("n_k", F.lit(0)), F.coalesce("n_ab", F.lit(0))
    join = (
        F.col("mark").isin(*SOFT)
        | ((n_ab >= 2) & (n_ab > n_k))
        | (F.col("bn").isNotNull() & (F.length("ab") >= 5) & (F.col("bn") > n_k)))
    broken = decided.filter(join).select("pair", F.lit("join").alias("action"))
    stray = compounds.select(F.regexp_replace("compound", "-", "").alias("ab"), "compound", "n_k").join(known, "ab").filter(
        (F.col("n_ab") >= TIMES * F.col("n_k")) & (F.col("n_ab") >= LEAST) & (F.length("ab") >= 5)).select(F.col("compound").alias("pair"), F.lit("join").alias("action"))
    edge = kind("e").filter(F.col("n") >= HEADER_TEXTS).withColumnRenamed("n", "n_e")
    held = edge.select("x", "n_e", F.explode(F.filter(F.split("x", " "), lambda w: F.length(w) > 2)).alias("word")).join(words.select(F.col("x").alias("word"), "n"), "word")
    header = held.groupBy("x", "n_e").agg(F.min("n").alias("n")).filter(F.col("n_e") >= HEADER_SHARE * F.col("n")).select(F.col("x").alias("pair"), F.lit("header").alias("action"))
    return misread, broken.unionByName(stray).unionByName(header)


class Mender:
    """Finds and mends the damage of one text at a time."""

    def __init__(self, misread: dict[str, str], actions: dict[str, str]):
        self.misread = misread
        self.header = {k for k, a in actions.items() if a == "header"}
        self.join = {k for k, a in actions.items() if a == "join"}
        self.bad = set(misread)
        self.header_words = {w for x in self.header for w in x.split(" ") if len(w) > 2}

    def _head_words(self, words: list[str]) -> list[int]:
        """Which words of a line stand in runs of header shingles that hold a word with a capital."""
        if not any(w.lower() in self.header_words for word in words for w in CAPITALISED.findall(word)):
            return []
        marks = [(i, "#" if t.isdigit() else t.lower(), bool(CAPITALISED.fullmatch(t))) for i, word in enumerate(words) for t in MARK.findall(word)]
        found: set[int] = set()
        run = marks[:1]
        for a, b in zip(marks, [*marks[1:], (0, "", False)]):
            if f"{a[1]} {b[1]}" in self.header:
                run.append(b)
                continue
            if len(run) > 1 and any(m[2] for m in run):
                found.update(m[0] for m in run if len(m[1]) > 2)
            run = [b]
        return sorted(found)

    def _edge_lines(self, lines: list[str]) -> set[int]:
        out = set()
        for i, inside in edges(lines):
            line = lines[i]
            if PAGE.fullmatch(line):
                near = [x for x in (lines[i - 1 :: -1] if i else []) if x.strip()][:1] + [x for x in lines[i + 1 :] if x.strip()][:1]
                if inside or (near and all(len(re.findall(r"[^\W\d_]{2,}", x)) >= 3 for x in near)):
                    out.add(i)
            elif inside and SHOUTED.fullmatch(line):
                out.add(i)
            elif not DECIMAL.search(line) and not REFERENCE.match(line):
                own = shingles(line)
                alike = sum(x in self.header for x in own)
                if own and 2 * alike >= len(own) and (inside or alike > 1):
                    out.add(i)
        return out

    def damaged(self, text: str | None) -> bool:
        if not text:
            return False
        text = clean(text)
        low = text.lower()
        words = set(TOKEN.findall(low))
        if not self.bad.isdisjoint(words):
            return True
        for m in BROKEN.finditer(low):
            a, mark, b = m.group(1, 2, 4)
            if f"{a}\t{mark}\t{b}" in self.join:
                return True
        if "-" in low and any(f"{a}-{b}" in self.join for a, b in COMPOUND.findall(low)):
            return True
        lines = text.split("\n")
        if len(lines) > 1 and self._edge_lines(lines):
            return True
        if "  " in text and RUN_IN.search(text):
            return True
        if not self.header_words.isdisjoint(words):
            for line in lines:
                if not REFERENCE.match(line) and len(self._head_words(line.split())) >= 2:
                    return True
        return False

    def _mend_word(self, m: re.Match) -> str:
        word = m.group(0)
        meant = self.misread.get(word.lower())
        if meant is None:
            return word
        if len(word) > 1 and sum(c.isupper() for c in word) > len(word) // 2:
            return meant.upper()
        return meant[:1].upper() + meant[1:] if word[:1].isupper() else meant

    def _inline(self, line: str) -> str:
        """Without headers that ran into the line: runs of words in header shingles with the numbers and signs that belong to them."""
        if REFERENCE.match(line):
            return line
        if "  " in line:
            line = RUN_IN.sub("", line)
        if not self.header:
            return line
        parts = re.split(r"(\s+)", line)
        words = parts[0::2]
        at = self._head_words(words)
        if len(at) < 2:
            return line
        runs: list[list[int]] = []
        for i in at:
            if runs and all(LINKING.fullmatch(t) for t in words[runs[-1][1] + 1 : i]):
                runs[-1][1] = i
            else:
                runs.append([i, i])
        gone: set[int] = set()
        for low, high in runs:
            while high + 1 < len(words) and FIGURE.fullmatch(words[high + 1]):
                own = words[high + 1]
                follows = words[high].endswith(",") or re.search(r"[,)–-]", own) or (high + 2 < len(words) and words[high + 2].startswith("("))
                if not follows or DECIMAL.search(own):
                    break
                high += 1
            while high + 1 < len(words) and words[high + 1] in SIGNS:
                high += 1
            while low > 0 and (words[low - 1] in SIGNS or words[low] in SIGNS and (FIGURE.fullmatch(words[low - 1]) or words[low - 1] == "al." or words[low - 1][:1].isupper() and low > 1 and words[low - 2] in SIGNS)
                               or words[low] == "al." and words[low - 1] == "et" or words[low] == "et"):
                low -= 1
            gone.update(range(low, high + 1))
        return " ".join(t for i, t in enumerate(words) if i not in gone) if not line[:1].isspace() else parts[1] + " ".join(t for i, t in enumerate(words) if i not in gone and t)

    def mend(self, text: str | None) -> str | None:
        if not text:
            return text
        text = clean(text)
        lines = text.split("\n")
        gone = self._edge_lines(lines) if len(lines) > 1 else set()
        kept: list[str] = []
        open_ = False  # the text so far ends inside a sentence that an edge line broke
        for i, line in enumerate(lines):
            if i in gone:
                while kept and not kept[-1].strip():
                    kept.pop()
                open_ = bool(kept) and not ENDED.search(kept[-1])
                continue
            if open_ and not line.strip():
                continue
            open_ = False
            kept.append(self._inline(line))
        text = "\n".join(kept)

        text = BROKEN.sub(self._rejoin, text)
        text = COMPOUND.sub(lambda m: m.group(1) + m.group(2) if m.group(0).lower() in self.join else m.group(0), text)
        return self._paragraphs(TOKEN.sub(self._mend_word, text))

    def _rejoin(self, m: re.Match) -> str:
        a, mark, line_end, b = m.groups()
        if f"{a}\t{mark}\t{b}".lower() in self.join:
            return a + b
        return f"{a}{'' if mark in SOFT else '-'}{b}" if line_end else m.group(0)

    @staticmethod
    def _paragraphs(text: str) -> str:
        """Lines joined to paragraphs, but for those of lists and tables."""
        out = []
        for p in re.split(r"\n[^\S\n]*\n\s*", text):
            p = re.sub(r"[^\S\n]*\n[^\S\n]*(?![-–—*•+] |\d{1,3}[.)]\s|\[\d|\S+\t|[^\n]*\|)", " ", p.strip())
            if p:
                out.append(re.sub(r"[^\S\n\t]{2,}", " ", p))
        return "\n\n".join(out)

    def joined(self, text: str | None) -> str | None:
        """A text without damage as paragraphs; the same as ``mend`` gives of it."""
        if not text:
            return text
        text = clean(text)
        if "\n" in text:
            text = BROKEN.sub(self._rejoin, text)
        return self._paragraphs(text)


def _entries(text: str) -> set[str]:
    """Everything of a text that a dictionary may hold."""
    text = clean(text)
    low = text.lower()
    found = set(TOKEN.findall(low)) | {f"{a}-{b}" for a, b in COMPOUND.findall(low)}
    found |= {x for line in text.split("\n") for x in shingles(line)}
    return found | {f"{m.group(1)}\t{m.group(2)}\t{m.group(4)}" for m in BROKEN.finditer(low)}


def _apply(df: DataFrame, column: str, keys: list[str], work, schema: str, shipped: int) -> DataFrame:
    """Run ``work(mender, batch columns)`` over all texts, the dictionaries shipped or, if large, joined."""
    narrow = spread(df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(column).cast("string").alias("t")))
    misread, actions = dictionaries(cut(corpus_counts(narrow, "t"), "counts"))
    every = misread.select(F.col("word").alias("entry"), F.col("meant")).unionByName(
        actions.select(F.col("pair").alias("entry"), F.concat(F.lit("\t"), "action").alias("meant")))
    entries = cut(every, "entries")

    def mender(pairs: list) -> Mender:
        return Mender({a: b for a, b in pairs if b[0] != "\t"}, {a: b[1:] for a, b in pairs if b[0] == "\t"})

    if entries.count() <= shipped:
        shared = mender([(r[0], r[1]) for r in entries.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield work([shared] * batch.num_rows, batch)

        return narrow.mapInArrow(run, schema)
    row = F.xxhash64(*[f"k{i}" for i in range(len(keys))], "t")
    numbered = narrow.withColumn("row", row)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for r, t in zip(batch.column("row").to_pylist(), batch.column("t").to_pylist()):
                if t:
                    own = _entries(t)
                    rows += [r] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], ["row", "entry"])

    own = numbered.select("row", "t").mapInArrow(explode, "row bigint, entry string").join(entries, "entry").distinct()
    own = own.groupBy("row").agg(F.collect_list(F.struct("entry", "meant")).alias("own"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work([mender([(e["entry"], e["meant"]) for e in o or []]) for o in batch.column("own").to_pylist()], batch)

    return numbered.join(own, "row", "left").drop("row").mapInArrow(run_joined, schema)


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))


def damaged_texts(df: DataFrame, column: str, keys: list[str], shipped: int = SHIPPED_ENTRIES) -> DataFrame:
    """keys of the rows whose text holds scan damage."""

    def work(menders: list[Mender], batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [m.damaged(t) for m, t in zip(menders, batch.column("t").to_pylist())]
        return batch.select([f"k{i}" for i in range(len(keys))]).filter(pa.array(hit, pa.bool_()))

    out = _apply(df, column, keys, work, _key_fields(df, keys), shipped)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)])


def repaired_texts(df: DataFrame, column: str, keys: list[str], shipped: int = SHIPPED_ENTRIES) -> DataFrame:
    """keys, repaired: every text as continuous paragraphs, and whether it was damaged."""

    def work(menders: list[Mender], batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t").to_pylist()
        hit = [m.damaged(t) for m, t in zip(menders, texts)]
        mended = [m.mend(t) if h else m.joined(t) for m, t, h in zip(menders, texts, hit)]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(f"k{i}") for i in range(len(keys))], pa.array(mended, pa.string()), pa.array(hit, pa.bool_())],
            [*[f"k{i}" for i in range(len(keys))], "repaired", "damaged"])

    out = _apply(df, column, keys, work, _key_fields(df, keys) + ", repaired string, damaged boolean", shipped)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "repaired", "damaged")
