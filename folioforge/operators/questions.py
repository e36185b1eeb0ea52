"""Question documents in markdown: split into questions, take and move their blocks, merge two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blocks of a question, in the order they stand in.
BLOCKS = ("**Коротко.**", "**Развёрнуто.**", "**Ключевые цифры и имена.**", "**Уточняющие вопросы.**", "**Источники.**")
SHORT, LONG, FACTS, FOLLOW_UPS, SOURCES = BLOCKS
OPENING = "### Вопрос "


def split(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, number, title, body: one row per question; what precedes the first is left out."""
    parts = F.slice(F.split(text, f"(?m)^{OPENING}(?=\\S+[.] .)"), 2, 1_000_000)
    rows = df.select(key, F.posexplode(parts).alias("ord", "p"))
    head = F.substring_index("p", "\n", 1)
    return rows.select(
        key, (F.col("ord") + 1).alias("ord"), F.substring_index(head, ". ", 1).alias("number"), F.substr(head, F.instr(head, ". ") + F.lit(2)).alias("title"),
        F.substr("p", F.length(head) + F.lit(1)).alias("body"))


def block_end(body: Column, name: str) -> Column:
    """1-based place after a block: the next block, the question's rule or the end; null where it is absent."""
    at = F.instr(body, name)
    next_ = [F.nullif(F.instr(F.substr(body, at + F.lit(len(name))), m), F.lit(0)) + at + len(name) - 1 for m in (*BLOCKS, "\n---")]
    return F.when(at > 0, F.coalesce(F.least(*next_, F.length(body) + 1), F.length(body) + 1))


def block(body: Column, name: str) -> Column:
    """Text of a block without blanks at its ends; empty where it is absent."""
    at = F.instr(body, name)
    inner = F.substr(body, at + F.lit(len(name)), F.greatest(block_end(body, name) - at - len(name), F.lit(0)))
    return F.coalesce(F.regexp_replace(inner, "^\\s+|\\s+$", ""), F.lit(""))


def table_rows(text: Column) -> Column:
    """Rows of a markdown table without its head and rule."""
    return F.filter(F.split(text, "\n"), lambda r: F.trim(r).startswith("|") & ~F.trim(r).rlike("^\\|[\\s:-]+\\|") & ~F.trim(r).rlike("^\\|\\s*(Факт|Параметр|Признак)\\s*\\|"))


def bullets(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda r: F.trim(r).startswith("- *"))


def _insert(body: Column, name: str, what: Column) -> Column:
    """``what`` after a block's last line, where the block is there and something is to be put."""
    end = block_end(body, name)
    kept = F.regexp_replace(F.substr(body, F.lit(1), end - 1), "\\s+$", "")
    rest = F.regexp_replace(F.substr(body, end), "^\\n+", "")
    return F.when(end.isNotNull() & (what != ""), F.concat(kept, F.lit("\n"), what, F.lit("\n\n"), rest)).otherwise(body)


def merge(questions: DataFrame, source: str, target: str, title: str) -> DataFrame:
    """The questions with ``source`` moved into ``target``: its long part under a heading, table rows, follow-ups and sources appended."""
    given = questions.filter(F.col("number") == source).select(F.col("body").alias("given")).limit(1)
    rows = questions.filter(F.col("number") != source).join(F.broadcast(given), F.col("number") == target, "left")
    s = F.coalesce("given", F.lit(""))
    end = block_end(F.col("body"), LONG)
    longer = F.concat(F.substr("body", F.lit(1), end - 1), F.lit(f"\n\n**{title}.**\n\n"), block(s, LONG), F.lit("\n\n"), F.substr("body", end))
    body = F.when(end.isNotNull() & (block(s, LONG) != ""), longer).otherwise(F.col("body"))
    rows = rows.withColumn("moved", F.when(F.col("given").isNotNull(), body).otherwise(F.col("body")))
    for name, parts in ((FACTS, table_rows(block(s, FACTS))), (FOLLOW_UPS, bullets(block(s, FOLLOW_UPS)))):
        rows = rows.withColumn("moved", _insert(F.col("moved"), name, F.array_join(parts, "\n")))
    at = F.instr("moved", SOURCES)
    joined = F.concat(F.regexp_replace(block(F.col("moved"), SOURCES), "[.\\s]+$", ""), F.lit("; "), block(s, SOURCES))
    with_sources = F.concat(F.substr("moved", F.lit(1), at + F.lit(len(SOURCES) - 1)), F.lit(" "), joined, F.lit("\n\n"), F.regexp_replace(F.substr("moved", block_end(F.col("moved"), SOURCES)), "^\\n+", ""))
    rows = rows.withColumn("moved", F.when((at > 0) & (block(s, SOURCES) != ""), with_sources).otherwise(F.col("moved")))
    return rows.withColumn("body", F.col("moved")).drop("moved", "given")


def split_at(questions: DataFrame, number: str, heading: str, new_number: str, new_title: str, new_short: str = "") -> DataFrame:
    """The questions with one of them cut at a sub-heading: what follows it, up to its facts, follow-ups and sources, becomes a question of its own.

    Those blocks stay in both questions.
    """
    at = F.instr("body", heading)
    cut = (F.col("number") == number) & (at > 0)
    ends = [F.nullif(F.instr(F.substr("body", at), m), F.lit(0)) + at - 1 for m in (FACTS, FOLLOW_UPS, SOURCES, "\n---")]
    end = F.coalesce(F.least(*ends), F.length("body") + 1)
    bare = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    moved, tail = bare(F.substr("body", at, end - at)), F.regexp_replace(F.substr("body", end), "^\\s+", "")
    kept = F.concat(F.regexp_replace(F.substr("body", F.lit(1), at - 1), "\\s+$", ""), F.lit("\n\n"), tail)
    fresh = F.concat(F.lit(f"\n{SHORT} {new_short}\n\n{LONG}\n\n"), moved, F.lit("\n\n"), tail)
    first = F.struct("number", "title", F.when(cut, kept).otherwise(F.col("body")).alias("body"), F.lit(0).alias("place"))
    second = F.when(cut, F.struct(F.lit(new_number).alias("number"), F.lit(new_title).alias("title"), fresh.alias("body"), F.lit(1).alias("place")))
    others = [c for c in questions.columns if c not in ("number", "title", "body")]
    rows = questions.select(*others, F.explode(F.array_compact(F.array(first, second))).alias("q"))
    return rows.select(*others, "q.number", "q.title", "q.body", "q.place")
