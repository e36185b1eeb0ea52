"""Best representative of each duplicate group (problem 4).

Rows that tell of one paper are linked by identifiers (DOI, content hash), by the
sentences of their whole text (all are compared, with figures or without, but for
those that ``STOCK`` DOIs share) and by title with authors; each group gets one record.  Fields that depend on one another form
*bundles* (a DOI fixes its year); whole bundles are chosen by branch-and-bound,
maximising the trust of the rows behind them, and bonds between bundles that
stand in one row, under the functional dependencies.

Defined results: null, empty and placeholder values are no evidence and are never
chosen; rows with no evidence are groups of one; equal rows (all fields but the
key) are one class before any comparison, so a paper delivered very often costs
no more than its variants; ties go to the smaller value; an empty table gives an
empty result; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.shared import cut, spread

WEIGHED = 16  # shared sentences that add to a link's score
STOCK = 3  # DOIs that share a sentence make it a stock sentence, which tells of no paper
SIDE = 500  # rows of a block that meet as many others in one task

# Openings of errata and names of parts, in the corpus languages.
ERRATUM = r"^(erratum|corrigendum|correction|retraction|addendum|berichtigung|korrektur|fe de erratas|поправка|исправлени|опечатк|виправленн|errata)"
PART = r"(?:part|teil|partie|parte|часть|частина) ([0-9]+|[ivx]+)$"
NO_DOI = r"^10[.]0+/|unassigned|unknown|n/a"


def _with_evidence(df: DataFrame) -> DataFrame:
    """What can be compared of each row."""
    doi = F.expr(r"regexp_replace(regexp_extract(replace(lower(doi), '%2f', '/'), '(10[.]\\d{4,9}/\\S+)', 1), '[.,;)\\]}»”’]+$', '')")
    sentences = F.expr(
        r"array_distinct(filter(transform(split(lower(text), '[.!?…\\n]+(?=\\s|$)'), s -> regexp_replace(s, '[^\\p{L}\\p{N}]+', '')), s -> length(s) >= 20))")
    title = F.expr(r"trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' '))")
    out = df.select(
        "doc_id", F.when((doi != "") & ~doi.rlike(NO_DOI), doi).alias("doi"), F.expr("nullif(sha256, '')").alias("sha"),
        F.when(F.length(title) >= 6, title).alias("title"), F.col("title").rlike(r"([.]{3}|…)\s*$").alias("open_title"),
        F.expr(r"array_distinct(regexp_extract_all(lower(authors), '[\\p{L}]{4,}', 0))").alias("authors"),
        F.when(F.col("year").between(1500, 2100), F.col("year")).alias("year"),
        sentences.alias("told"))
    out = out.withColumn("hashes", F.array_sort(F.expr("transform(told, s -> xxhash64(s))")))
    return out.select(
        "doc_id", "doi", "sha", "title", F.coalesce("open_title", F.lit(False)).alias("open_title"), "authors", "year", "hashes",
        F.coalesce(F.col("title").rlike(ERRATUM), F.lit(False)).alias("erratum"), F.regexp_extract(F.coalesce("title", F.lit("")), PART, 1).alias("part"))


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes that share a key; the stock sentences of each class.

    Classes of one DOI are one paper whatever else they hold, so each is tied to
    the first of them; two DOIs never link.  What is left are the pairs in which
    one class has no DOI: all of them are made, a block in squares of ``SIDE``.
    Texts link only if they are equal or half the sentences of the smaller, stock
    sentences apart, stand in the other: one of any half and one more of its
    sentences must, and the rarest are asked for.
    """
    by_doi = classes.filter("doi IS NOT NULL").select("c", "doi").distinct()
    first = by_doi.groupBy("doi").agg(F.count("*").alias("n"), F.min("c").alias("a")).filter("n > 1")
    ties = by_doi.join(first, "doi").filter("a != c").select("a", F.col("c").alias("b"))
    # k, size: every sentence with the number of them, or a name or whole text with 0.
    names = F.array(
        F.concat(F.lit("s"), "sha"), F.when((F.length("title") >= 20) & ~F.col("open_title"), F.concat(F.lit("t"), "title")),
        F.when(F.size("hashes") > 0, F.concat(F.lit("w"), F.xxhash64("hashes").cast("string"))))
    keys = classes.select("c", F.xxhash64("doi").alias("d"), F.col("doi").isNull().alias("asks"), F.explode(F.concat(
        F.transform(F.array_compact(names), lambda n: F.struct(F.xxhash64(n).alias("k"), F.lit(0).alias("size"))),
        F.transform(F.coalesce("hashes", F.expr("array()")), lambda h: F.struct(h.alias("k"), F.size("hashes").alias("size"))))).alias("k")).select("c", "d", "asks", "k.k", "k.size").distinct()
    of_doi = keys.groupBy("k", "asks", "d").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    blocks = of_doi.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.expr("if(asks, n, 0)")).alias("m"), ((F.count_if(~F.col("asks")) >= STOCK) & (F.max("size") > 0)).alias("stock")).filter("n > 1 AND (m > 0 OR stock)")
    # What no partner can hold comes first among a text's rarest sentences.
    shared = cut(keys.drop("d").join(blocks.drop("m"), "k"), "shared")
    own = Window.partitionBy("c", "size")
    held = shared.withColumn("all", F.col("size") - F.count_if("stock").over(own)).filter("NOT stock").withColumn("held", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("n", "k"))).withColumn("size", F.col("all"))
    placed = cut(held.select("k", "c", "asks", "size", F.expr("if(size = 0, asks, r + size - held <= size div 2 + 1)").alias("probes")), "blocks")
    squares = placed.groupBy("k").agg(F.ceil(F.count_if("probes") / SIDE).alias("rows"), F.ceil(F.count("*") / SIDE).alias("columns")).filter("rows > 0")
    placed = placed.join(squares, "k")
    asking = placed.filter("probes").select("k", F.col("c").alias("x"), "asks", F.col("size").alias("least"), F.expr("pmod(xxhash64(c), rows)").alias("i"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("j"))
    # Of two classes one has no DOI: a class that has one asks only those without.
    asked = placed.select("k", F.col("c").alias("y"), F.explode(F.expr("if(asks, array(true, false), array(true))")).alias("asks"), "size", F.expr("pmod(xxhash64(c), columns)").alias("j"), "rows")
    asked = asked.select("k", "y", "asks", "size", "j", F.explode(F.expr("sequence(0L, rows - 1)")).alias("i"))
    pairs = asking.join(asked, ["k", "asks", "i", "j"]).filter("x != y AND least <= size").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return ties.unionByName(pairs).distinct(), shared.filter("stock").groupBy("c").agg(F.collect_list("k").alias("stock"))


def _links(rows: DataFrame, pairs: DataFrame, stock: DataFrame) -> DataFrame:
    """a, b, score of the pairs that tell of one paper."""
    headings = rows.filter("doi IS NOT NULL AND title IS NOT NULL").select(F.xxhash64("title").alias("t"), F.xxhash64("doi").alias("d")).distinct()
    general = headings.groupBy("t").count().filter("count > 1").select("t", F.lit(True).alias("general"))
    # Only rows that stand in a pair travel with what is compared.
    named = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    classes = rows.join(named, "c", "left_semi").dropDuplicates(["c"]).withColumn("t", F.xxhash64("title"))
    classes = classes.join(stock, "c", "left").withColumn("telling", F.array_except("hashes", F.coalesce("stock", F.expr("array()")))).drop("stock")
    told = cut(classes.join(general, "t", "left").withColumn("general", F.coalesce("general", F.lit(False))).drop("t"), "compared")
    side = lambda s: told.select(*[F.col(c).alias(c if c == "c" else f"{c}_{s}") for c in told.columns if c != "doc_id"]).withColumnRenamed("c", s)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    e = F.expr
    both = both.select(
        "a", "b",
        e("coalesce(doi_a = doi_b, false)").alias("same_doi"), e("doi_a IS NOT NULL AND doi_b IS NOT NULL AND doi_a != doi_b").alias("other_doi"),
        e("coalesce(sha_a = sha_b, false)").alias("same_sha"),
        e("coalesce(size(array_intersect(hashes_a, hashes_b)), 0)").alias("shared"),
        e("coalesce(least(size(hashes_a), size(hashes_b)), 0)").alias("least"),
        e("coalesce(if(hashes_a = hashes_b, size(hashes_a), size(array_intersect(telling_a, telling_b))), 0)").alias("told"),
        e("coalesce(if(hashes_a = hashes_b, size(hashes_a), least(size(telling_a), size(telling_b))), 0)").alias("least_told"),
        e("coalesce(title_a = title_b, false) AND NOT general_a").alias("same_title"),
        e("title_a IS NOT NULL AND title_b IS NOT NULL").alias("titled"),
        e("""CASE WHEN title_a IS NULL OR title_b IS NULL THEN true
             WHEN open_title_a OR open_title_b THEN levenshtein(left(title_a, least(length(title_a), length(title_b)) - 2), left(title_b, least(length(title_a), length(title_b)) - 2)) <= 0.25 * least(length(title_a), length(title_b))
             WHEN contains(title_a, title_b) OR contains(title_b, title_a) THEN true
             ELSE levenshtein(title_a, title_b) <= 0.25 * greatest(length(title_a), length(title_b)) END""").alias("like_title"),
        e("erratum_a != erratum_b AND title_a IS NOT NULL AND title_b IS NOT NULL OR (part_a != part_b AND part_a != '' AND part_b != '')").alias("apart"),
        e("coalesce(arrays_overlap(authors_a, authors_b), true) OR coalesce(size(authors_a), 0) = 0 OR coalesce(size(authors_b), 0) = 0").alias("like_authors"),
        e("coalesce(arrays_overlap(authors_a, authors_b), false)").alias("same_authors"), e("coalesce(hashes_a = hashes_b, false)").alias("same_text"),
        e("coalesce(abs(year_a - year_b) <= 1, true)").alias("like_year"))
    return both.filter(
        "NOT other_doi AND (same_doi OR NOT apart AND like_title AND (same_sha AND like_year OR told >= 1 AND if(like_authors, 2, 1.3) * shared >= least AND if(like_authors, 2, 1.3) * told >= least_told AND (shared >= 2 OR same_title OR (same_authors OR same_text AND like_authors) AND like_year)"
        " OR same_title AND like_authors AND like_year))"
    ).select("a", "b", e(f"if(same_doi, 1000, 0) + if(same_sha, 100, 0) + if(same_title, 30, 0) + least(shared, {WEIGHED})").alias("score"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """doc_id, group: the group (its smallest class) of every row."""
    rows = cut(_with_evidence(spread(df.select("doc_id", "doi", "sha256", "title", "authors", "year", "text"))).withColumn("c", F.xxhash64("doi", "sha", "title", "open_title", "authors", "year", "hashes")), "evidence")
    pairs, stock = _candidates(rows)
    links = _links(rows, cut(pairs, "pairs"), stock)
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")), "links")
    nodes = rows.select("c", "doi").distinct().join(links.select(F.col("a").alias("c")).distinct(), "c")
    # Classes with a DOI are grouped by it; the others take the group of their best neighbour, or the smallest among themselves.
    by_doi = nodes.filter("doi IS NOT NULL").select("c", F.xxhash64("doi").alias("g"), F.lit(True).alias("fixed"))
    labels = cut(by_doi.unionByName(nodes.filter("doi IS NULL").select("c", F.col("c").alias("g"), F.lit(False).alias("fixed"))), "labels")
    while True:  # a label only falls or becomes fixed
        beside = links.join(labels.select(F.col("c").alias("b"), F.col("g").alias("gb"), F.col("fixed").alias("fb")), "b").groupBy("a").agg(
            F.max(F.when(F.col("fb"), F.struct("score", "gb"))).alias("known"), F.min(F.when(~F.col("fb"), F.col("gb"))).alias("low"))
        new = labels.join(beside.withColumnRenamed("a", "c"), "c", "left").select(
            "c",
            F.when(F.col("fixed"), F.col("g")).when(F.col("known").isNotNull(), F.col("known.gb")).otherwise(F.least("g", F.coalesce("low", F.col("g")))).alias("g"),
            (F.col("fixed") | F.col("known").isNotNull()).alias("fixed"), (F.col("g")).alias("was"), F.col("fixed").alias("before"))
        new = cut(new, "labels")
        changed = new.filter("g != was OR fixed != before").limit(1).count()
        labels = new.select("c", "g", "fixed")
        if not changed:
            break
    return rows.join(labels.select("c", "g"), "c", "left").select("doc_id", F.coalesce("g", "c").alias("group"))


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b: rows of one paper, the smaller key first."""
    groups = duplicate_groups(df).distinct()
    several = cut(groups.join(groups.groupBy("group").count().filter("count > 1").select("group"), "group"), "groups")
    a, b = several.select("group", F.col("doc_id").alias("doc_id_a")), several.select("group", F.col("doc_id").alias("doc_id_b"))
    return a.join(b, "group").filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


#: Which bundle a value belongs to; a DOI fixes its year.
BUNDLES = ("identity", "title", "authors")
BOND = 0.25  # of the smaller trust, for two bundles that stand in one row


def choose(candidates: dict[str, list[tuple[tuple, float, frozenset]]], fixed: dict) -> dict[str, tuple]:
    """The best whole bundle of each kind by branch-and-bound.

    ``candidates``: kind -> (value, trust, rows).  ``fixed``: what a value of the
    first field of a bundle determines of its second (functional dependency); a
    candidate that breaks it is no candidate.
    """
    kinds = [k for k in BUNDLES if candidates.get(k)]
    options = {
        k: sorted((c for c in candidates[k] if k != "identity" or c[0][0] is None or c[0][1] == fixed.get(c[0][0], c[0][1])), key=lambda c: (-c[1], str(c[0])))
        for k in kinds}
    kinds = [k for k in kinds if options[k]]
    best: tuple[float, list] = (-1.0, [])
    ahead = [0.0]
    for i, k in enumerate(reversed(kinds)):  # most that the remaining kinds can add, bonds included
        top = options[k][0][1]
        ahead.append(ahead[-1] + top * (1 + BOND * (len(kinds) - 1 - i)))
    ahead.reverse()

    def go(i: int, taken: list, value: float) -> None:
        nonlocal best
        if i == len(kinds):
            if value > best[0] + 1e-9:
                best = (value, list(taken))
            return
        for c in options[kinds[i]]:
            gain = c[1] + sum(BOND * min(c[1], t[1]) for t in taken if c[2] & t[2])
            if value + c[1] * (1 + BOND * len(taken)) + ahead[i + 1] <= best[0] + 1e-9:
                break
            go(i + 1, [*taken, c], value + gain)

    go(0, [], 0.0)
    return {k: c[0] for k, c in zip(kinds, best[1])}


def best_records(df: DataFrame) -> DataFrame:
    """group, n_rows, doi, title, authors, year: one record per paper."""
    groups = duplicate_groups(df)
    told = df.select(
        "doc_id",
        F.expr(r"nullif(regexp_replace(regexp_extract(replace(lower(doi), '%2f', '/'), '(10[.]\\d{4,9}/\\S+)', 1), '[.,;)\\]}»”’]+$', ''), '')").alias("doi"),
        F.expr(r"nullif(trim(regexp_replace(title, '\\s+', ' ')), '')").alias("title"), F.expr(r"nullif(trim(regexp_replace(authors, '\\s+', ' ')), '')").alias("authors"),
        F.when(F.col("year").between(1500, 2100), F.col("year")).alias("year"),
        F.expr("CASE status WHEN 'ok' THEN 1.0D WHEN 'partial' THEN 0.7D WHEN 'ocr_skipped' THEN 0.5D ELSE 0.3D END").alias("trust"), "added_at")
    told = told.withColumn("doi", F.when(~F.col("doi").rlike(NO_DOI), F.col("doi"))).withColumn("authors", F.when(~F.lower("authors").isin("unknown", "n/a", "et al."), F.col("authors")))
    # Rows with the same values are counted before they meet: a group's size is that of its variants.
    told = cut(told.join(groups, "doc_id"), "told")
    variants = told.groupBy("group", "doi", "title", "authors", "year").agg(F.count("*").alias("n"), F.sum("trust").alias("trust"), F.max("added_at").alias("latest"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        newest = part["latest"].max()
        rows = [
            {k: None if pd.isna(v) else v for k, v in zip(("doi", "title", "authors", "year"), r[:4])} | {"trust": float(r[4]) * (1.1 if r[5] == newest else 1.0)}
            for r in zip(part["doi"], part["title"], part["authors"], part["year"], part["trust"], part["latest"])]
        years: dict = {}
        for r in rows:
            if r["doi"] and r["year"]:
                years.setdefault(r["doi"], {}).setdefault(int(r["year"]), 0.0)
                years[r["doi"]][int(r["year"])] += r["trust"]
        fixed = {d: min(y, key=lambda v: (-y[v], v)) for d, y in years.items()}
        pools: dict[str, dict] = {k: {} for k in BUNDLES}
        for i, r in enumerate(rows):
            year = int(r["year"]) if r["year"] else fixed.get(r["doi"])
            full = {"identity": (r["doi"], year) if r["doi"] or year else None, "title": (r["title"],) if r["title"] else None, "authors": (r["authors"],) if r["authors"] else None}
            for kind, value in full.items():
                if value is None:
                    continue
                worth = r["trust"]
                if kind == "identity":
                    worth *= 1.0 if value[0] and value[1] else 0.5
                elif kind == "title":
                    t = value[0]
                    worth *= 0.2 if t.endswith(("...", "…")) else 0.6 if t in (t.upper(), t.lower()) else 1.0
                else:
                    worth *= 0.7 if "et al" in value[0].lower() else 1.0
                    worth *= 1 + 0.1 * min(10, value[0].count(";"))
                trust, who = pools[kind].get(value, (0.0, frozenset()))
                pools[kind][value] = (trust + worth, who | {i})
        chosen = choose({k: [(v, t, w) for v, (t, w) in pool.items()] for k, pool in pools.items()}, fixed)
        doi, year = chosen.get("identity", (None, None))
        return pd.DataFrame([(int(part["group"].iloc[0]), int(part["n"].sum()), doi, chosen.get("title", (None,))[0], chosen.get("authors", (None,))[0], year)],
                            columns=["group", "n_rows", "doi", "title", "authors", "year"])

    variants = variants.withColumn("m", F.count("*").over(Window.partitionBy("group")))
    alone = variants.filter("m = 1").select("group", F.col("n").alias("n_rows"), "doi", "title", "authors", "year")
    several = variants.filter("m > 1").drop("m")
    return alone.unionByName(several.groupBy("group").applyInPandas(run, "group bigint, n_rows bigint, doi string, title string, authors string, year int"))
