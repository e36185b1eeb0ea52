"""Text functions as Spark columns: cleaning, bibliographic fields, labels.

Blanks are spelled out (``W``) so that every engine that reads the patterns
means the same characters by them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks of Unicode as a character class.
W = "[\\t-\\r \\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NAME_LETTERS = "A-Za-zА-Яа-яЁё"
MAX_YEAR = 2027
YEAR = "19[0-9]{2}|20[0-2][0-9]"
DOI = "(10[.][0-9]{4,9}/[^ \\t\\r\\n\"'<>]+)"
DOI_TAIL = "[.,;)\\]}»”’]+$"

# Headings of scientific papers.
SECTION_WORDS = (
    "abstract|introduction|background|literature review|materials?\\s+and\\s+methods?|methodology|methods?|experimental(?:\\s+setup|\\s+section)?|"
    "results?\\s+and\\s+discussions?|results?|discussions?|conclusions?(?:\\s+and\\s+future\\s+work)?|acknowledg(?:e)?ments?|references|bibliography|nomenclature|appendix|"
    "аннотация|введение|обзор литературы|материалы и методы|методика|методы|экспериментальная часть|результаты и обсуждение|результаты|обсуждение|"
    "заключение|выводы|благодарности|список литературы|литература|приложение"
)
HEADING = f"^(?:[0-9]+(?:[.][0-9]+)*[.]?\\s+)?({SECTION_WORDS})\\s*[.]?$"
NUMBERED = "^[0-9]+(?:[.][0-9]+)*[.]?\\s+"
NUMBERED_HEADING = NUMBERED + "[A-ZА-ЯЁ][^.]{2,80}$"

# Words that tell nothing about a topic.
STOP_WORDS = (
    "основные", "процессы", "процесс", "получение", "методы", "понятия", "принципы", "принцип", "особенности", "классификация", "различия", "система", "системе", "систем",
    "биотехнологии", "биотехнология", "биотехнологических", "микроорганизмов", "используемых", "который",
)


def strip(x: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(x, f"^{W}+|{W}+$", "")


def capitalise(x: Column) -> Column:
    """First letter large, the others small (unlike initcap, over the whole string)."""
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1_000_000)))


def clean_block(x: Column) -> Column:
    """One paragraph out of a block: broken words joined, lines joined, blanks squeezed."""
    x = F.regexp_replace(x, f"[-\\x{{00AD}}@]{W}*\\n{W}*", "")
    x = F.regexp_replace(x, "([а-яёА-ЯЁ])@([а-яёА-ЯЁ])", "$1-$2")
    x = F.regexp_replace(x, f"{W}*\\n{W}*", " ")
    return strip(F.regexp_replace(x, "[ \\t]{2,}", " "))


def find_doi(x: Column) -> Column:
    """The first DOI in a text, without closing punctuation; null if none."""
    doi = F.regexp_extract(x, f"(?i){DOI}", 1)
    return F.nullif(F.regexp_replace(doi, DOI_TAIL, ""), F.lit(""))


def stem(filename: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(filename, "(?<=.)[.][^.]*$", "")


def _years(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(f"(?U)\\b({YEAR})\\b"), F.lit(1)), lambda y: y.cast("int"))


def find_year(text: Column, filename: Column) -> Column:
    """Largest year of the file name if plausible, else the largest plausible one of the text."""
    named = F.array_max(_years(stem(filename)))
    told = F.array_max(F.filter(_years(text), lambda y: y <= MAX_YEAR))
    return F.when(named <= MAX_YEAR, named).otherwise(told)


def find_abstract(text: Column) -> Column:
    """Up to 2000 characters after the word for abstract; empty if there is none."""
    latin = F.regexp_extract(text, "(?isU)\\babstract\\b[:\\s]*(.+?)(?:\\bkeywords?\\b|\\b1\\.?\\s+introduction\\b|\\z)", 1)
    cyrillic = F.regexp_extract(text, "(?isU)\\bаннотация\\b[:\\s]*(.+?)(?:\\bключевые слова\\b|\\z)", 1)
    found = F.when(latin != "", latin).otherwise(cyrillic)
    return F.left(strip(F.regexp_replace(found, f"{W}+", " ")), F.lit(2000))


def first_author(authors: Column) -> Column:
    """Family name of the first author; empty if there is none."""
    first = strip(F.split(F.coalesce(authors, F.lit("")), "[;]|(?<!,)\\s+and\\s+")[0])
    words = F.regexp_extract_all(first, F.lit(f"[{NAME_LETTERS}\\-']{{2,}}"), F.lit(0))
    named = F.when(F.contains(first, F.lit(",")), strip(F.substring_index(first, ",", 1))).otherwise(F.try_element_at(words, F.lit(-1)))
    return F.coalesce(F.regexp_replace(named, f"[^{NAME_LETTERS}\\-']", ""), F.lit(""))


def citation(authors: Column, year: Column, filename: Column) -> Column:
    """Label in brackets style: family name, ``et al.`` for several, year."""
    several = (F.regexp_count(authors, F.lit(";")) >= 1) | (F.regexp_count(authors, F.lit(",")) >= 2)
    name = first_author(authors)
    label = F.when(name != "", F.concat(name, F.when(several, F.lit(" et al.")).otherwise(""))).otherwise(F.concat(F.lit("["), filename, F.lit("]")))
    return F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(label, F.lit(", "), year.cast("string"))).otherwise(label)


def cite_key(authors: Column, year: Column, title: Column, filename: Column) -> Column:
    """Key before disambiguation: family name, else a word of the title, else the file's name, with the year or ND."""
    when = F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("ND"))
    word = F.regexp_extract(F.coalesce(title, F.lit("")), f"[{NAME_LETTERS}]{{4,}}", 0)
    plain = F.left(F.regexp_replace(stem(filename), f"[^{NAME_LETTERS}0-9]", ""), F.lit(20))
    name = first_author(authors)
    base = F.when(name != "", capitalise(name)).when(word != "", capitalise(word)).when(plain != "", plain).otherwise("Doc")
    return F.concat(base, when)


def detect_section(x: Column) -> Column:
    """Name of the section that a line opens, null if it opens none."""
    line = strip(x)
    known = F.regexp_extract(line, f"(?iu){HEADING}", 1)
    numbered = line.rlike(NUMBERED_HEADING) & (F.size(F.split(line, "\\s+")) <= 10)
    return (
        F.when(F.length(line) > 90, F.lit(None).cast("string"))
        .when(known != "", capitalise(strip(known)))
        .when(numbered, capitalise(strip(F.regexp_replace(line, NUMBERED, "")))))


def sentences(x: Column) -> Column:
    return F.split(x, f"(?<=[.!?]){W}+")


def token_count(x: Column) -> Column:
    """Number of words between blanks."""
    return F.when(strip(x) == "", 0).otherwise(F.size(F.split(strip(x), f"{W}+")))


def topic_variants(topic: Column) -> Column:
    """Ways to ask for a topic: whole, before and after a colon, parts between commas and conjunctions."""
    colon = F.contains(topic, F.lit(":"))
    head, tail = strip(F.substring_index(topic, ":", 1)), strip(F.substring(topic, F.instr(topic, ":") + F.lit(1), F.length(topic)))
    parts = F.concat(F.split(topic, "[,;]"), F.split(topic, "\\s+и\\s+"))
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[ .,;:]+|[ .,;:]+$", "")), lambda p: F.length(p) >= 12)
    every = F.concat(F.array(topic), F.when(colon, F.array(head, tail)).otherwise(F.array().cast("array<string>")), parts)
    lows = F.transform(every, lambda v: F.lower(v))
    return F.filter(F.transform(every, lambda v, i: F.when(F.array_position(lows, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())


def topic_keywords(topic: Column) -> Column:
    """At most four stems of long words that are no stop words."""
    words = F.transform(F.regexp_extract_all(topic, F.lit(f"[{NAME_LETTERS}]{{6,}}"), F.lit(0)), lambda w: F.lower(w))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.slice(F.transform(kept, lambda w: F.left(w, F.lit(7))), 1, 4)


def page_label(first: Column, last: Column) -> Column:
    return (
        F.when(first.isNull(), F.lit("стр. ?"))
        .when(last.isNull() | (first == last), F.concat(F.lit("стр. "), first.cast("string")))
        .otherwise(F.concat(F.lit("стр. "), first.cast("string"), F.lit("–"), last.cast("string"))))


def source_label(filename: Column, longest: int = 52, aliases: dict[str, str] | None = None) -> Column:
    """Readable name of a file: blanks for underscores, no copy numbers, cut with an ellipsis.

    ``aliases``: names for files whose name holds a part; the first that fits counts.
    """
    if aliases:
        named = [F.when(F.contains(F.lower(stem(filename)), F.lit(part.lower())), F.lit(name)) for part, name in aliases.items()]
        return F.coalesce(*named, source_label(filename, longest))
    x = F.regexp_replace(stem(filename), "_+", " ")
    x = F.regexp_replace(x, "\\s*\\([0-9]+\\)\\s*$", "")
    x = F.regexp_replace(x, "(?iu)\\s*-\\s*(копия|copy)\\s*$", "")
    x = F.regexp_replace(F.regexp_replace(x, "\\s{2,}", " "), "^[ .-]+|[ .-]+$", "")
    return F.when(F.length(x) > longest, F.concat(F.regexp_replace(F.left(x, F.lit(longest - 3)), "\\s+$", ""), F.lit("…"))).otherwise(x)


def slug(x: Column, default: str = "corpus") -> Column:
    s = F.regexp_replace(F.regexp_replace(x, "[^\\p{L}\\p{N}]", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def snippet(text: Column, term: str, around: int = 80) -> Column:
    """The term's first place with ``around`` characters on each side; the text's start if it is not there."""
    at = F.instr(F.lower(text), term.lower())
    first = F.greatest(F.when(at == 0, F.lit(1)).otherwise(at) - around, F.lit(1))
    last = F.least(F.when(at == 0, F.lit(0)).otherwise(at) + F.lit(len(term) + around - 1), F.length(text))
    cut = strip(F.regexp_replace(F.substr(text, first, last - first + 1), f"{W}+", " "))
    return F.concat(F.when(first > 1, F.lit("…")).otherwise(""), cut, F.when(last < F.length(text), F.lit("…")).otherwise(""))


def verdict(best: Column, strong: Column, docs: Column, keyword_docs: Column) -> Column:
    """Whether the corpus covers a topic. Thresholds 0.58 and 0.52, two strong hits, three and two documents."""
    return (
        F.when((best >= 0.58) & (strong >= 2) & (docs >= 2) | (best >= 0.58) & (keyword_docs >= 3), "covered")
        .when((best >= 0.52) | (keyword_docs >= 2), "partial").otherwise("gap"))


def fragment(text: Column, chars: int = 700, boilerplate: tuple[str, ...] = ()) -> Column:
    """A passage for a digest: without boilerplate, blanks squeezed, cut, with an ellipsis."""
    for pattern in boilerplate:
        text = F.regexp_replace(text, pattern, " ")
    return F.concat(F.left(strip(F.regexp_replace(text, f"{W}+", " ")), F.lit(chars)), F.lit("…"))


#: Ways in which spoken or hastily typed queries go wrong.
CORRUPTIONS = ("split word", "endings lost", "word lost", "like letters")
LIKE_LETTERS = ("оаиебвпдтгкзcieo", "аоеипфбтдкгсkaia")


def corrupted(query: Column, kind: str) -> Column:
    """A query with one kind of damage."""
    words = F.split(strip(query), f"{W}+")
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))
    at = -longest["i"]
    if kind == "split word":
        half = lambda w: F.concat(F.left(w, F.floor(F.length(w) / 2).cast("int")), F.lit(" "), F.substr(w, F.floor(F.length(w) / 2).cast("int") + 1))
        return F.array_join(F.transform(words, lambda w, i: F.when(i == at, half(w)).otherwise(w)), " ")
    if kind == "endings lost":
        return F.array_join(F.transform(words, lambda w: F.when(F.length(w) >= 5, F.left(w, F.length(w) - 2)).otherwise(w)), " ")
    if kind == "word lost":
        return F.array_join(F.filter(words, lambda w, i: (i != at) | (F.size(words) == 1)), " ")
    if kind == "like letters":
        return F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.translate(w, *LIKE_LETTERS)).otherwise(w)), " ")
    raise ValueError(f"unknown corruption {kind}")


def result_line(rank: Column, score: Column, citation_: Column, filename: Column, first: Column, last: Column) -> Column:
    """A hit as a line to read."""
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] "), F.round(score * 100).cast("int").cast("string"), F.lit(" % "), citation_, F.lit(", "), filename, F.lit(", "), page_label(first, last))
