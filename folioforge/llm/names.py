"""Variant spellings of names typed by people (problem 6).

Names are folded (look-alikes, accents, romanised Cyrillic) and parsed into
family name, given name and initials; where the order of two words is open, both
permutations stand.  Distinct family names are sharded into tries by halves that no
single error touches both of (see ``shard_keys``), and a Levenshtein automaton walks
each trie to enumerate the neighbours within the bounded distance.  Spellings
gather round the most frequent neighbour; within such a family, a trie of given
names, nicknames and initials decide who is who.  Organisations of the same
initials are compared word by word where a trie of their words lets them meet.

Defined results: null lists name nobody, nor do empty parts, ``et al.``,
``unknown`` and ``n/a``; a name listed often counts once per list; initials that
fit several people of a family are linked to none of them; an empty table gives
an empty result; columns that are not named are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import lookalikes as look
from folioforge.shared import cut

DISTANCE = 1
SHORTEST = 5  # letters of the longer of two family names that differ by a typing error
FAMILIES_PER_BUCKET = 2_000
NOBODY = ("et al.", "et al", "unknown", "n/a", "na", "-")

# Romanisation of Cyrillic letters.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
}
# Letters that ways of romanising write differently, as one of them writes them.
WAYS = (("shch", "sch"), ("zh", "j"), ("kh", "h"), ("ts", "c"), ("ya", "ia"), ("yu", "iu"), ("ye", "e"), ("yo", "io"))
# Familiar forms of given names.
FAMILIAR = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "al": "albert alexander", "bella": "isabella", "bob": "robert", "rob": "robert", "borya": "boris",
    "bill": "william", "will": "william", "chris": "christophe christopher christian christina", "dima": "dmitry", "mitya": "dmitry", "fedya": "fyodor", "fritz": "friedrich",
    "gabe": "gabriel", "galya": "galina", "heinz": "heinrich", "ira": "irina", "jim": "james", "joe": "joseph", "kate": "katherine ekaterina", "katya": "ekaterina",
    "kolya": "nikolai", "lara": "larisa", "larry": "lawrence", "liz": "elizabeth", "beth": "elizabeth", "misha": "mikhail", "mike": "michael", "nick": "nicholas nikolai",
    "ollie": "oliver", "paco": "francisco", "pancho": "francisco", "pasha": "pavel", "peggy": "margaret", "maggie": "margaret", "pepa": "josefina", "roma": "roman",
    "serge": "sergey", "seryozha": "sergey", "tanya": "tatiana", "thea": "dorothea", "tom": "thomas", "uschi": "ursula", "vicky": "victoria", "vika": "victoria",
    "volodya": "vladimir", "vova": "vladimir", "yura": "yuri", "zach": "zacharias zachary", "dick": "richard", "ed": "edward", "tony": "anthony", "sue": "susan",
}
ORGANISATION = ("inst", "lab", "acad", "centre", "center", "ctr", "bureau", "bur", "univ", "dept", "depart", "school", "society", "soc", "group", "college", "ministry", "company")
SHORTENED = {"ctr": "centre", "center": "centre", "dept": "department", "natl": "national", "intl": "international"}
SMALL_WORDS = {"of", "for", "the", "and", "de", "la", "le", "du", "des", "für", "der", "fur"}

_definite_cyrillic, _definite_latin = re.compile(look.DEFINITE_CYRILLIC), re.compile(look.DEFINITE_LATIN)
_to_cyrillic = str.maketrans(look.LATIN_LOOK + look.GREEK_LOOK_CYR, look.LATIN_AS_CYRILLIC + look.GREEK_AS_CYRILLIC)
_to_latin = str.maketrans(look.CYRILLIC_LOOK + look.GREEK_LOOK, look.CYRILLIC_AS_LATIN + look.GREEK_AS_LATIN)
_invisible = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")


_initial = re.compile(r"(?<![^\W\d_])([" + "".join(c for c in ROMAN if ROMAN[c]) + r"])\.")


def fold(name: str) -> str:
    """Small Latin letters without accents, in one script."""
    name = _invisible.sub("", unicodedata.normalize("NFKC", name))
    cyrillic, latin = bool(_definite_cyrillic.search(name)), bool(_definite_latin.search(name))
    if cyrillic and not latin:
        name = name.translate(_to_cyrillic)
    elif latin and not cyrillic:
        name = name.translate(_to_latin)
    name = _initial.sub(lambda m: ROMAN[m.group(1)][:1] + ".", name.lower())
    name = "".join(ROMAN.get(c, c) for c in name)
    name = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", name.replace("ß", "ss").replace("ø", "o").replace("’", "'")).strip()


def _letters(s: str) -> str:
    return re.sub(r"[^a-z]", "", s)


def given_forms(given: str) -> tuple[str, ...]:
    """The formal given names that a written one may stand for, in one spelling."""
    return tuple(sorted({re.sub(r"ii+", "i", g.replace("ks", "x").replace("y", "i")) for g in FAMILIAR.get(given, given).split()}))


def organisation_words(folded: str) -> list[str] | None:
    """Words of an organisation's name, None for a person's."""
    bare = re.sub(r"\([^)]*\)", " ", folded)
    words = [w for w in re.findall(r"[a-z]+", bare) if w not in SMALL_WORDS]
    long = [w for w in words if len(w) > 1]
    if len(long) >= 3 and any(w.startswith(ORGANISATION) for w in long) or len(long) >= 4:
        return sorted(SHORTENED.get(w, w) for w in words)
    return None


def parse(name: str, known_given: frozenset | set) -> list[tuple[str, str, str]]:
    """(family, given, initials) in each permutation that is possible."""
    folded = fold(name)
    if "," in folded:
        family, _, rest = folded.partition(",")
        tokens = re.findall(r"[a-z'-]+\.?", rest)
        return [(_letters(family), *_given(tokens))] if _letters(family) else []
    tokens = re.findall(r"[a-z'-]+\.?", folded)
    initials = [t for t in tokens if len(t.rstrip(".")) == 1]
    words = [t for t in tokens if len(t.rstrip(".")) > 1]
    if not words:
        return []
    if initials:
        if len(words) == 1:
            return [(_letters(words[0]), "", "".join(t[0] for t in initials))]
        words = words[:2]
        return [(_letters(words[1]), _letters(words[0]), "".join(t[0] for t in initials)), (_letters(words[0]), _letters(words[1]), "".join(t[0] for t in initials))]
    if len(words) == 1:
        return [(_letters(words[0]), "", "")]
    a, b = _letters(words[0]), _letters("".join(words[1:]))
    first, last = a in known_given or a in FAMILIAR, b in known_given or b in FAMILIAR
    if first and not last:
        return [(b, a, "")]
    if last and not first:
        return [(a, b, "")]
    return [(b, a, ""), (a, b, "")]


def _given(tokens: list[str]) -> tuple[str, str]:
    words = [_letters(t) for t in tokens if len(t.rstrip(".")) > 1]
    initials = "".join(t[0] for t in tokens if len(t.rstrip(".")) == 1)
    return (words[0] if words else "", initials)


def near(a: str, b: str) -> bool:
    """Equal, or one letter typed wrong, left out, doubled or two exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


END = ""


def trie_of(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[END] = w
    return root


def neighbours(trie: dict, word: str, distance: int) -> set[str]:
    """Words of the trie within ``distance`` errors: the automaton's states are (node, place, errors left)."""
    found, seen = set(), set()
    stack = [(trie, 0, distance)]
    n = len(word)
    while stack:
        node, i, left = stack.pop()
        state = (id(node), i, left)
        if state in seen:
            continue
        seen.add(state)
        if i == n and END in node:
            found.add(node[END])
        if i < n and word[i] in node:
            stack.append((node[word[i]], i + 1, left))
        if left:
            for c, child in node.items():
                if c == END:
                    continue
                stack.append((child, i, left - 1))
                if i < n:
                    stack.append((child, i + 1, left - 1))
                    if i + 1 < n and c == word[i + 1] and word[i] in child:
                        stack.append((child[word[i]], i + 2, left - 1))
            if i < n:
                stack.append((node, i + 1, left - 1))
    return found


def trie_join(words: list[str], distance: int = DISTANCE, backwards: bool = False) -> list[tuple[str, str]]:
    """Pairs of different words within the distance."""
    if backwards:
        return [(a[::-1], b[::-1]) for a, b in trie_join([w[::-1] for w in words], distance)]
    trie = trie_of(words)
    return [(w, other) for w in words for other in neighbours(trie, w, distance) if other != w]


def shard_keys(word: str, distance: int = DISTANCE) -> list[str]:
    """Shards of a word: any two words within the distance share one.

    For one error, the longer word's letters but one are parted into a head and a
    tail; an error, or an exchange of two letters, touches one of them only.  The
    word may be the longer one or miss a letter of it, so both lengths count.  For
    more errors, what is left after leaving out up to so many letters.
    """
    if distance == 1:
        keys = []
        for longest in (len(word), len(word) + 1):
            head = (longest - 1) // 2
            tail = longest - 1 - head
            keys += [f"f{longest}:{word[:head]}", f"b{longest}:{word[len(word) - tail:]}"]
        return keys
    left = {word}
    for _ in range(distance):
        left |= {w[:i] + w[i + 1 :] for w in left for i in range(len(w))}
    return [f"d:{w}" for w in left]


class _Forms:
    """Groups of given names, found by the forms in them: equal, or within one error by the trie."""

    def __init__(self) -> None:
        self.trie: dict = {}
        self.groups: dict[str, list[int]] = defaultdict(list)

    def add(self, form: str, group: int) -> None:
        if group not in self.groups[form]:
            self.groups[form].append(group)
            node = self.trie
            for c in form:
                node = node.setdefault(c, {})
            node[END] = form

    def fitting(self, forms: tuple[str, ...]) -> list[int]:
        found: set[int] = set()
        for f in forms:
            found.update(self.groups.get(f, ()))
            if len(f) > 3:
                found.update(g for other in neighbours(self.trie, f, 1) if len(other) > 3 for g in self.groups[other])
        return sorted(found)


def people(records: list[tuple[str, str, str, int]]) -> list[set[str]]:
    """Names of each person of one family, from (name, given, initials, lists) records."""
    groups: list[tuple[set[str], set[str], set[str]]] = []  # formal given names, names, first letters
    known = _Forms()
    for name, given, _, n in sorted((r for r in records if r[1]), key=lambda r: (-r[3], r[0])):
        forms = given_forms(given)
        first = {given[0]} | {f[0] for f in FAMILIAR.get(given, given).split()}
        fit = known.fitting(forms)
        if len(forms) > 1 and len(fit) != 1:  # a familiar form of several of them
            fit = [g for g in fit if name in groups[g][1]][:1]
        at = fit[0] if fit else len(groups)
        if not fit:
            groups.append((set(), set(), set()))
        if not fit or len(forms) == 1 and n:
            groups[at][0].update(forms)
            for f in forms:
                known.add(f, at)
        groups[at][1].add(name)
        groups[at][2].update(first)
    loose: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for name, given, initials, _ in records:
        if not given and initials:
            loose[initials[0]].append((name, initials[1:2]))
    out = [g[1] for g in groups]
    for first, members in loose.items():
        fit = [g for g in groups if first in g[2]]
        middles = sorted({m for _, m in members if m})
        if len(fit) == 1 and len(middles) <= 1:
            fit[0][1].update(name for name, _ in members)
        elif len(middles) <= 1 and not fit:
            out.append({name for name, _ in members})
        else:
            by_middle: dict[str, set[str]] = defaultdict(set)
            for name, m in members:
                by_middle[m].add(name)
            out += list(by_middle.values())
    return out


def same_organisation(a: list[str], b: list[str]) -> bool:
    """Word by word equal, shortened or with a typing error; at most one word wrong."""
    if len(a) != len(b):
        return False
    left, wrong = list(b), 0
    for w in a:
        hit = next((x for x in left if x == w), None) or next((x for x in left if min(len(x), len(w)) >= 3 and (x.startswith(w) or w.startswith(x))), None)
        if hit is None:
            hit = next((x for x in left if min(len(x), len(w)) >= 5 and near(x, w)), None)
            wrong += 1
        if hit is None or wrong > 2:
            return False
        left.remove(hit)
    return True


def organisations_of(spelled: dict[tuple, set[str]]) -> list[set[str]]:
    """Names of each organisation, from the words of each spelling.

    Of three words or more, all but two are equal or shortened, so two spellings of
    one organisation have a word with the same first three letters (or a shorter
    one) in common; only those are compared.
    """
    sets: list[set[str]] = []
    kept: list[list[str]] = []
    by_word: dict[str, list[int]] = defaultdict(list)
    for words, names in sorted(spelled.items()):
        beginnings = {w[:3] for w in words}
        beside = sorted({i for b in beginnings for i in by_word[b]})
        at = next((i for i in beside if same_organisation(list(words), kept[i])), None)
        if at is not None:
            sets[at] |= names
            continue
        for b in beginnings:
            by_word[b].append(len(sets))
        sets.append(set(names))
        kept.append(list(words))
    return sets


def listed_names(df: DataFrame, authors: str) -> DataFrame:
    """name, n: the different names of the lists and in how many lists each stands."""
    edge = r"(?U)^\s+|\s+$"
    parts = df.select(F.explode(F.array_distinct(F.transform(F.split(F.col(authors), ";"), lambda x: F.regexp_replace(x, edge, "")))).alias("name"))
    return parts.filter((F.col("name") != "") & ~F.lower("name").isin(*NOBODY)).groupBy("name").agg(F.count("*").alias("n"))


def _map(df: DataFrame, work, schema: str) -> DataFrame:
    """Rows of ``work(name, n)`` for every name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(_parse_datatype_string(schema))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for name, n in zip(batch.column("name").to_pylist(), batch.column("n").to_pylist()) for r in work(name, n)]
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _given_of_lists(name: str, n: int) -> list[tuple]:
    if organisation_words(fold(name)) is None and "," in fold(name):
        return [(given, family) for family, given, _ in parse(name, frozenset()) if given]
    return []


def variant_pairs(df: DataFrame, authors: str, distance: int = DISTANCE) -> DataFrame:
    """name_a, name_b: different spellings of one person or organisation, the smaller first."""
    spark = df.sparkSession
    names = cut(listed_names(df, authors), "names")
    given = _map(names, _given_of_lists, "given string, family string").distinct().groupBy("given").count().filter("count >= 3")
    known = frozenset(r["given"] for r in given.collect())

    def record(name: str, n: int) -> list[tuple]:
        words = organisation_words(fold(name))
        if words is not None:
            return [(name, n, "o", "".join(sorted(w[0] for w in words)), "", "", words)]
        return [(name, n, "p", family, given, initials, None) for family, given, initials in parse(name, known)]

    records = cut(_map(names, record, "name string, n bigint, kind string, family string, given string, initials string, words array<string>"), "name-records")
    persons = records.filter("kind = 'p'")
    written = F.col("family")
    for way, other in WAYS:
        written = F.replace(written, F.lit(way), F.lit(other))
    families = cut(persons.groupBy("family").agg(F.sum("n").alias("w")).withColumn("way", written), "families")
    # The most frequent family of each romanised form stands for it among the forms.
    leading = families.groupBy("way").agg(F.max(F.struct("w", "family")).alias("m")).select("way", F.col("m.family").alias("lead"))

    # Shards and families are dealt to tasks by the bucket; one call serves all of a bucket's.
    buckets = max(spark.sparkContext.defaultParallelism, families.count() // FAMILIES_PER_BUCKET)

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets))).repartition(buckets, "bucket")

    def join_shard(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        for shard, own in part.groupby("shard"):
            if len(own) > 1:
                of = dict(zip(own["word"], own["family"]))
                pairs = trie_join(sorted(of), distance, shard[1] == "b")
                out += [(of[a], of[b]) for a, b in pairs if max(len(a), len(b)) >= SHORTEST and of[a] != of[b]]
        return pd.DataFrame(out, columns=["a", "b"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, words, of = (batch.column(c).to_pylist() for c in ("kind", "word", "family"))
            rows = [(k + key, w, f) for k, w, f in zip(kind, words, of) if len(w) >= SHORTEST - distance for key in shard_keys(w, distance)]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["shard", "word", "family"])

    # Families as written, and their romanised forms, are shards of their own.
    words = families.select(F.lit("w").alias("kind"), F.col("family").alias("word"), "family").unionByName(
        leading.select(F.lit("r").alias("kind"), F.col("way").alias("word"), F.col("lead").alias("family")))
    shards = words.mapInArrow(keyed, "shard string, word string, family string")
    to_lead = families.join(leading, "way").filter("family != lead").select(F.col("family").alias("a"), F.col("lead").alias("b"))
    near_families = dealt(shards, "shard").groupBy("bucket").applyInPandas(join_shard, "a string, b string").unionByName(to_lead).distinct()
    weight = families.select(F.col("family").alias("b"), F.col("w").alias("wb"))
    up = (
        near_families.join(weight, "b").join(families.select(F.col("family").alias("a"), F.col("w").alias("wa")), "a")
        .filter("wb > wa OR (wb = wa AND b > a)").groupBy("a").agg(F.max(F.struct("wb", "b")).alias("m")).select("a", F.col("m.b").alias("h")))
    hub = cut(up, "up")
    while True:  # every jump halves what is left of a chain; a hub is always more frequent, so there are no rings
        further = hub.select(F.col("a").alias("h"), F.col("h").alias("hh"))
        hub = cut(hub.join(further, "h", "left").select("a", F.coalesce("hh", "h").alias("h"), F.col("hh").isNotNull().alias("moved")), "hub")
        moved = hub.filter("moved").limit(1).count()
        hub = hub.drop("moved")
        if not moved:
            break
    placed = persons.join(hub.withColumnRenamed("a", "family"), "family", "left").withColumn("h", F.coalesce("h", "family"))

    def pairs_of(sets: list[set[str]]) -> list[tuple[str, str]]:
        out = set()
        for s in sets:
            s = sorted(s)
            out.update((a, b) for i, a in enumerate(s) for b in s[i + 1 :])
        return sorted(out)

    def link_people(part: pd.DataFrame) -> pd.DataFrame:
        families_: dict[str, list] = defaultdict(list)
        for h, *row in part[["h", "name", "given", "initials", "n"]].itertuples(index=False, name=None):
            families_[h].append(tuple(row))
        out: list[tuple[str, str]] = []
        for rows in families_.values():
            if len(rows) > 1:
                out += pairs_of(people(rows))
        return pd.DataFrame(out, columns=["name_a", "name_b"])

    def link_organisations(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        for _, own in part.groupby("family"):
            spelled: dict[tuple, set[str]] = defaultdict(set)
            for name, words in zip(own["name"], own["words"]):
                spelled[tuple(words)].add(name)
            out += pairs_of(organisations_of(spelled))
        return pd.DataFrame(out, columns=["name_a", "name_b"])

    found = dealt(placed, "h").groupBy("bucket").applyInPandas(link_people, "name_a string, name_b string")
    organisations = dealt(records.filter("kind = 'o'"), "family").groupBy("bucket").applyInPandas(link_organisations, "name_a string, name_b string")
    return found.unionByName(organisations).distinct()
