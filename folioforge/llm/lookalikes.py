"""Visually identical text with different characters (problem 3).

Every Arrow batch is handed to an embedded DuckDB, whose SQL expressions bring
text to one form: invisible characters vanish, unusual blanks become a space,
compatibility forms (full width, ligatures, styled letters) become the plain
letter, separate accents are composed (``nfc_normalize``) and look-alike letters
of another script are exchanged for those of the word they stand in.

Defined results: null stays null and is not changed; an empty string stays
empty; text of any length is handled whole; repeated rows give repeated rows;
an empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of one script drawn like letters of another, pairwise in order.
CYRILLIC_LOOK = "АВЕКМНОРСТУХаеорсухіјѕІЈЅ"
CYRILLIC_AS_LATIN = "ABEKMHOPCTYXaeopcyxijsIJS"
GREEK_LOOK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορικυχ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXvopikux"
LATIN_LOOK = "ABEKMHOPCTYXaeopcyxiI"
LATIN_AS_CYRILLIC = "АВЕКМНОРСТУХаеорсухіІ"
GREEK_LOOK_CYR = "ΑΒΕΚΜΗΟΡΤΧορ"
GREEK_AS_CYRILLIC = "АВЕКМНОРТХор"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix"}

# Character classes of the RE2 syntax.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}]"
BLANKS = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
MARKS = r"[\x{0300}-\x{036F}]"
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
CYRILLIC = r"\x{0400}-\x{052F}"


def _styled() -> tuple[str, str]:
    """Full-width, half-width, small and mathematical forms and Roman numerals of one letter with the plain one of each, by rule."""
    pairs = []
    for low, high, more in ((0xFF01, 0xFF9F, ""), (0x1D400, 0x1D7FF, ""), (0x2100, 0x214F, ""), (0xFE50, 0xFE6B, "<small>"), (0x2160, 0x217F, "<compat>")):
        for point in range(low, high + 1):
            c = chr(point)
            if unicodedata.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>", "<font>", more):
                plain = unicodedata.normalize("NFKC", c)
                if len(plain) == 1:
                    pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


STYLED, PLAIN = _styled()
_ranges = r"[\x{FF01}-\x{FF9F}\x{1D400}-\x{1D7FF}\x{2100}-\x{214F}\x{2160}-\x{217F}\x{FB00}-\x{FB06}\x{FE50}-\x{FE6B}]"


def _own(look: str, every: str) -> str:
    return "".join(c for c in every if c not in look)


_CYR_ALL = "".join(map(chr, range(0x400, 0x530)))
_LAT_ALL = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]) if c not in "×÷")
DEFINITE_CYRILLIC = "[" + _own(CYRILLIC_LOOK, _CYR_ALL) + "]"
DEFINITE_LATIN = "[" + _own(LATIN_LOOK + "jsS", _LAT_ALL) + "]"
MIXED = (
    f"[{LATIN}][{GREEK_LOOK}{CYRILLIC}]|[{GREEK_LOOK}{CYRILLIC}][{LATIN}]"
    f"|[{GREEK_LOOK}][{CYRILLIC}]|[{CYRILLIC}][{GREEK_LOOK}]"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _to_latin(x: str) -> str:
    return f"translate({x}, {q(CYRILLIC_LOOK + GREEK_LOOK)}, {q(CYRILLIC_AS_LATIN + GREEK_AS_LATIN)})"


def _to_cyrillic(x: str) -> str:
    return f"translate({x}, {q(LATIN_LOOK + GREEK_LOOK_CYR)}, {q(LATIN_AS_CYRILLIC + GREEK_AS_CYRILLIC)})"


def _plain(x: str) -> str:
    """Invisible characters, blanks, compatibility forms and accents."""
    lig = f"translate({x}, {q(STYLED)}, {q(PLAIN)})"
    for c, plain in LIGATURES.items():
        lig = f"replace({lig}, {q(c)}, {q(plain)})"
    x = f"CASE WHEN regexp_matches({x}, {q(_ranges)}) THEN {lig} ELSE {x} END"
    x = f"regexp_replace({x}, {q(INVISIBLE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(BLANKS)}, ' ', 'g')"
    return f"nfc_normalize({x})"


def _word(w: str, whole: str) -> str:
    return (
        f"CASE WHEN NOT regexp_matches({w}, {q('[' + CYRILLIC + GREEK_LOOK + ']')}) OR NOT regexp_matches({w}, {q(MIXED)}) THEN {w}"
        f" WHEN regexp_matches({w}, {q(DEFINITE_CYRILLIC)}) THEN {_to_cyrillic(w)}"
        f" WHEN regexp_matches({w}, {q(DEFINITE_LATIN)}) THEN {_to_latin(w)}"
        f" WHEN length(regexp_replace({whole}, {q('[^' + CYRILLIC + ']+')}, '', 'g')) > length({whole}) / 3 THEN {_to_cyrillic(w)}"
        f" ELSE {_to_latin(w)} END"
    )


def _text(p: str) -> str:
    """Look-alikes of running text: word by word, then lone letters between words of the other script."""
    words = f"array_to_string(list_transform(regexp_extract_all({p}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda w: {_word('w', p)}), '')"
    lone = "x"
    for a, b in zip("acoy", "асоу"):
        lone = f"regexp_replace({lone}, '([а-яёіїє] ){a}( [а-яёіїє])', '\\1{b}\\2', 'g')"
        lone = f"regexp_replace({lone}, '([a-zß-ÿ] ){b}( [a-zß-ÿ])', '\\1{a}\\2', 'g')"
    for a, b in zip("ACO", "АСО"):
        lone = f"regexp_replace({lone}, '(^|[.!?] |\\n){a}( [а-яёіїє])', '\\1{b}\\2', 'g')"
        lone = f"regexp_replace({lone}, '(^|[.!?] |\\n){b}( [a-zß-ÿ])', '\\1{a}\\2', 'g')"
    is_lone = (
        "[а-яёіїє] [acoy] [а-яёіїє]|[a-zß-ÿ] [асоу] [a-zß-ÿ]|(^|[.!?] |\\n)[ACO] [а-яёіїє]|(^|[.!?] |\\n)[АСО] [a-zß-ÿ]"
    )
    worded = f"CASE WHEN regexp_matches({p}, {q(MIXED)}) THEN {words} ELSE {p} END"
    return (
        f"CASE WHEN NOT regexp_matches({p}, {q('[' + CYRILLIC + GREEK_LOOK + ']')}) THEN {p}"
        f" WHEN regexp_matches({p}, {q(DEFINITE_LATIN)}) AND NOT regexp_matches({p}, {q(DEFINITE_CYRILLIC)})"
        f" AND regexp_matches({p}, {q('[' + CYRILLIC + ']')}) THEN {_to_latin(p)}"
        f" WHEN NOT regexp_matches({p}, {q(MIXED + '|' + is_lone)}) THEN {p}"
        f" ELSE list_transform([{worded}], lambda x: {lone})[1] END"
    )


def _names(p: str) -> str:
    """Look-alikes of a list of names: each name is of one script as a whole."""
    one = (
        f"CASE WHEN regexp_matches(w, {q(DEFINITE_CYRILLIC)}) AND NOT regexp_matches(w, {q(DEFINITE_LATIN)}) THEN {_to_cyrillic('w')}"
        f" WHEN regexp_matches(w, {q(DEFINITE_LATIN)}) AND NOT regexp_matches(w, {q(DEFINITE_CYRILLIC)}) THEN {_to_latin('w')}"
        " ELSE w END"
    )
    mixed = f"array_to_string(list_transform(string_split({p}, ';'), lambda w: {one}), ';')"
    return f"CASE WHEN regexp_matches({p}, {q('[' + CYRILLIC + GREEK_LOOK + ']')}) THEN {mixed} ELSE {p} END"


def consistent_sql(source: str, keys: str, text: str, names: bool) -> str:
    """SQL giving ``keys``, the consistent form ``fixed`` and whether it differs: ``changed``."""
    fix = _names("plain") if names else _text("plain")
    return (
        f"SELECT {keys}, fixed, COALESCE(fixed IS DISTINCT FROM stored OR regexp_matches(stored, {q(MARKS)}), false) AS changed"
        f" FROM (SELECT {keys}, stored, {fix} AS fixed FROM"
        f" (SELECT {keys}, {text} AS stored, {_plain(text)} AS plain FROM {source}))"
    )


def _run(sql: str, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
        con.execute("SET enable_progress_bar = false")
        for batch in batches:
            if batch.num_rows:
                con.register("part", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("part")


def consistent_text(df: DataFrame, text: str, keys: list[str], names: bool = False, only_changed: bool = False) -> DataFrame:
    """``keys``, the consistent form of column ``text`` as ``fixed``, and ``changed``.

    ``names``: the column is a list of names between semicolons.
    ``only_changed``: leave out rows that need no change, and the text.
    """
    narrow = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("t"))
    cols = ", ".join(f"k{i}" for i in range(len(keys)))
    sql = consistent_sql("part", cols, "t", names)
    if only_changed:
        sql = f"SELECT {cols} FROM ({sql}) WHERE changed"
    kinds = [(f"k{i}", narrow.schema[i].dataType.simpleString()) for i in range(len(keys))]
    fields = kinds if only_changed else [*kinds, ("fixed", "string"), ("changed", "boolean")]
    out_schema = ", ".join(f"{a} {b}" for a, b in fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out_schema))
    arrow = pa.schema([pa.field(f.name, f.type) for f in arrow])
    out = narrow.mapInArrow(lambda batches: _run(sql, batches, arrow), out_schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[a for a, _ in fields[len(keys):]])
