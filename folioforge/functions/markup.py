"""Markdown, LaTeX and RTF: scalar converters for pandas UDFs and column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lower and upper forms, letters and operators of formulas.
LOWER = dict(zip("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ"))
UPPER = dict(zip("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"))
SYMBOLS = {
    "mu": "μ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Delta": "Δ", "sigma": "σ", "omega": "ω", "lambda": "λ", "rho": "ρ", "tau": "τ", "phi": "φ", "pi": "π",
    "epsilon": "ε", "theta": "θ", "rightarrow": "→", "to": "→", "leftarrow": "←", "Rightarrow": "⇒", "leftrightarrow": "↔", "cdot": "·", "times": "×", "approx": "≈", "neq": "≠",
    "leq": "≤", "geq": "≥", "ll": "≪", "gg": "≫", "pm": "±", "infty": "∞", "partial": "∂", "sum": "Σ",
}
PLAIN = {"text", "textit", "textbf", "textrm", "mathrm"}
_token = re.compile(r"\\(begin|end)\{cases\}|\\([A-Za-z]+)|\\(.)|([{}_^&])|([^\\{}_^&]+)", re.DOTALL)


class _Formula:
    """Recursive descent over a LaTeX expression; unclosed groups end with it."""

    def __init__(self, source: str):
        self.tokens = [m for m in _token.finditer(source)]
        self.at = 0

    def group(self) -> str:
        """A braced group, or nothing where none stands."""
        if self.at < len(self.tokens) and self.tokens[self.at].group(4) == "{":
            self.at += 1
            return self.until("}")
        return ""

    def script(self, table: dict[str, str], mark: str) -> str:
        """What follows an index or power mark."""
        if self.at >= len(self.tokens):
            return ""
        t = self.tokens[self.at]
        if t.group(4) == "{":
            body = self.group()
        elif t.group(5):
            body, rest = t.group(5)[:1], t.group(5)[1:]
            self.tokens[self.at : self.at + 1] = [*_token.finditer(rest)]
            if mark == "^" and body == "*":
                return "*"
        else:
            return ""
        raised = "".join(table.get(c, c) for c in body)
        return mark + body if raised == body and body.isalpha() else raised

    def until(self, stop: str | None) -> str:
        out = []
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            self.at += 1
            cases, name, escaped, sign, run = t.group(1), t.group(2), t.group(3), t.group(4), t.group(5)
            if sign == "}":
                if stop == "}":
                    break
            elif sign == "{":
                out.append(self.until("}"))
            elif sign in ("_", "^"):
                out.append(self.script(LOWER if sign == "_" else UPPER, sign))
            elif cases or sign == "&":
                continue
            elif name == "frac":
                parts = [self.group().strip() for _ in range(2)]
                out.append("/".join(f"({p})" if re.search(r"[+\-−]", p) and not (p.startswith("(") and p.endswith(")")) else p for p in parts))
            elif name == "sqrt":
                out.append(f"√({self.group().strip()})")
            elif name == "xrightarrow":
                out.append(f" —({self.group().strip()})→ ")
            elif name in PLAIN:
                out.append(self.group())
            elif name in ("quad", "qquad"):
                out.append("   ")
            elif name:
                out.append(SYMBOLS.get(name, name))
            elif escaped == "\\":
                out.append(";  ")
            elif escaped:
                out.append(" " if escaped in ",;! " else escaped)
            elif run:
                out.append(run)
        return "".join(out)


def formula(source: str) -> str:
    """A LaTeX expression in plain characters."""
    text = _Formula(source.strip().replace("{,}", ",")).until(None)
    return re.sub(r"\s{2,}", " ", text).strip()


def formulas(text: str | None) -> str | None:
    """Every ``$$...$$`` of a text in plain characters, one paragraph per line of it."""
    if text is None:
        return None
    return re.sub(r"\$\$(.+?)\$\$", lambda m: "\n\n".join(formula(p) for p in m.group(1).split("\n") if p.strip()), text, flags=re.DOTALL)


_rtf = re.compile(r"\\u(-?\d+)\??|\\'([0-9a-fA-F]{2})|\\(par)d?\b|\\([A-Za-z]+)-?\d* ?|\\([^A-Za-z])|([{}])")


def rtf_text(raw: str | None) -> str | None:
    """Text of an RTF document, best effort: code points, cp1251 bytes, paragraphs."""
    if raw is None:
        return None

    def put(m: re.Match) -> str:
        if m.group(1):
            return chr(int(m.group(1)) % 0x10000)
        if m.group(2):
            return bytes([int(m.group(2), 16)]).decode("cp1251", "ignore")
        return "\n\n" if m.group(3) else " " if m.group(4) else ""

    return _rtf.sub(put, raw)


@F.pandas_udf(StringType())
def formulas_udf(s: pd.Series) -> pd.Series:
    return s.map(formulas, na_action="ignore")


@F.pandas_udf(StringType())
def rtf_udf(s: pd.Series) -> pd.Series:
    return s.map(rtf_text, na_action="ignore")


def captions(text: Column, most: int = 3) -> Column:
    """The first figure, scheme and table captions of a page, cut to 95 characters."""
    pattern = "(?iu)(?:Рису?н?о?к|Рис\\.|Схема|Таблица)\\s*№?\\s*[0-9]+\\s*[–—.-]?\\s*.{0,90}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(F.transform(found, lambda c: F.left(F.trim(c), F.lit(95))), 1, most)


def numbered_captions(text: Column) -> Column:
    """Captions of a document numbered in the order they stand in."""
    parts = F.split(text, "(?m)^(?=\\*{1,3}Рисунок)")
    opening = "^(\\*{1,3})Рисунок(?:\\s+[0-9]+)?\\.?\\s*"
    first = F.when(F.element_at(parts, 1).rlike(opening), 1).otherwise(0)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(
            p.rlike(opening),
            F.concat(F.regexp_extract(p, opening, 1), F.lit("Рисунок "), (i + first).cast("string"), F.lit("."), F.when(p.rlike("^\\*{3}"), F.lit("**")).otherwise(""), F.lit(" "), F.regexp_replace(p, opening, ""))
        ).otherwise(p)), "")


def block_kind(line: Column) -> Column:
    """Kind of a markdown line."""
    s = F.trim(line)
    return (
        F.when(s == "", "blank").when(s.rlike("^#{1,6} "), "heading").when(s.rlike("^(-{3,}|\\*{3,}|_{3,})$"), "rule").when(s.rlike("^!\\[[^\\]]*\\]\\([^)]+\\)"), "image")
        .when(s.rlike("^\\|"), "table").when(s.rlike("^>"), "quote").when(s.rlike("^[-*+] "), "bullet").when(s.rlike("^[0-9]+[.)] "), "number").otherwise("paragraph"))


def bookmark(text: Column) -> Column:
    """Name of a place in a document: letters, digits and underscores, 40 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^\\p{L}\\p{N}_]+", "_"), "^_+|_+$", "")
    return F.left(F.concat(F.lit("bm_"), plain), F.lit(40))


def contents(text: Column) -> Column:
    """Headings of the first three levels in order: array of (level, title, anchor)."""
    head = "^(#{1,3})\\s+(.*)$"
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(head))

    def entry(x: Column) -> Column:
        title = F.regexp_replace(F.trim(F.regexp_extract(x, head, 2)), "[*`]", "")
        return F.struct(F.length(F.regexp_extract(x, head, 1)).alias("level"), title.alias("title"), bookmark(title).alias("anchor"))

    return F.transform(lines, entry)


_SPAN = "\\*\\*.+?\\*\\*|\\*[^*\\n]+?\\*|`[^`\\n]+?`"


def inline_runs(text: Column) -> Column:
    """Runs of a line in order: array of (kind, text), kind plain, bold, italic or code."""
    parts = F.regexp_extract_all(text, F.lit(f"({_SPAN}|(?:(?!{_SPAN})[\\s\\S])+)"), F.lit(1))

    def run(x: Column) -> Column:
        n = F.length(x)
        inner = lambda k: F.substr(x, F.lit(k + 1), n - 2 * k)
        return (
            F.when(x.rlike("^\\*\\*") & x.rlike("\\*\\*$") & (n > 4), F.struct(F.lit("bold").alias("kind"), inner(2).alias("text")))
            .when(x.rlike("^\\*[^*]+\\*$") & (n > 2), F.struct(F.lit("italic").alias("kind"), inner(1).alias("text")))
            .when(x.rlike("^`[^`]+`$") & (n > 2), F.struct(F.lit("code").alias("kind"), inner(1).alias("text")))
            .otherwise(F.struct(F.lit("plain").alias("kind"), x.alias("text"))))

    return F.transform(parts, run)


def table_cells(line: Column) -> Column:
    """Cells of a markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), "^[|]+|[|]+$", ""), "[|]"), lambda c: F.trim(c))


def is_rule_row(line: Column) -> Column:
    """Whether a row is the rule below a table's head."""
    bare = F.regexp_replace(F.trim(line), "^[|]+|[|]+$", "")
    return (bare != "") & F.forall(F.split(bare, "[|]"), lambda c: F.trim(c).rlike("^:?-{2,}:?$"))


def markdown_blocks(lines: DataFrame, doc: str, number: str, line: str) -> DataFrame:
    """doc, block, kind, level, text of markdown lines: what belongs together is glued.

    Paragraphs and list items run on to the next line that opens a block; a table is
    a row of bars above a rule row with all rows of bars after it, its cells parted
    by tabs and its rows by line ends, without the rule.
    """
    whole = Window.partitionBy(doc).orderBy(number)
    s = F.trim(line)
    opens = (s == "") | s.rlike("^[#>|]") | s.rlike("^[-*+]\\s+") | s.rlike("^[0-9]+[.)]\\s+") | s.rlike("^(-{3,}|\\*{3,})$")
    rows = lines.select(doc, number, s.alias("s"), opens.alias("opens"), s.startswith("|").alias("bar"), is_rule_row(F.col(line)).alias("rule"))
    rows = rows.withColumn("_run", F.sum((~F.col("bar")).cast("int")).over(whole)).withColumn("_next", F.lead("rule", 1, False).over(whole) & F.lead("bar", 1, False).over(whole))
    run = Window.partitionBy(doc, "_run", "bar")
    rows = rows.withColumn("_head", F.min(F.when(F.col("bar") & F.col("_next"), F.col(number))).over(run))
    in_table = F.col("bar") & (F.col(number) >= F.coalesce("_head", F.col(number) + 1))
    kind = (
        F.when(F.col("s") == "", "blank").when(in_table, "table").when(F.col("s").rlike("^(-{3,}|\\*{3,})$"), "rule").when(F.col("s").rlike("^#{1,4}\\s+"), "heading")
        .when(F.col("s").startswith(">"), "quote").when(F.col("s").rlike("^[-*+]\\s+"), "bullet").when(F.col("s").rlike("^[0-9]+[.)]\\s+"), "number")
        .when(F.col("opens"), "paragraph").when(F.col("s").rlike("^!\\[[^\\]]*\\]\\([^)]+\\)$"), "image").otherwise("text"))
    rows = rows.withColumn("kind", kind)
    # Lines that open nothing go on with a paragraph or item before them; after anything else images stand alone until a text begins.
    rows = rows.withColumn("_open", F.sum(F.col("opens").cast("int")).over(whole)).withColumn("_before", F.lag("kind", 1, "blank").over(whole)).withColumn("_at", F.lag(number).over(whole))
    stretch = Window.partitionBy(doc, "_open")
    rows = rows.withColumn("_opener", F.max(F.when(F.col("opens"), F.col("kind"))).over(stretch)).withColumn("_text", F.min(F.when(F.col("kind") == "text", F.col(number))).over(stretch))
    loose = F.col("kind").isin("text", "image")
    goes_on = loose & (F.coalesce(F.col("_opener").isin("bullet", "number", "paragraph"), F.lit(False)) | (F.col(number) > F.coalesce("_text", F.col(number))))
    begins = (
        F.when((F.col("kind") == "blank") | goes_on, False)
        .when(F.col("kind") == "table", F.col(number) == F.col("_head")).when(F.col("kind") == "quote", F.col("_before") != "quote").otherwise(True))
    rule = (F.col("kind") == "table") & F.coalesce(F.col("_at") == F.col("_head"), F.lit(False))
    rows = rows.withColumn("block", F.sum(begins.cast("int")).over(whole)).filter((F.col("kind") != "blank") & ~rule)
    bare = (
        F.when(F.col("kind") == "heading", F.regexp_replace("s", "^#{1,4}\\s+", "")).when(F.col("kind") == "bullet", F.regexp_replace("s", "^[-*+]\\s+", ""))
        .when(F.col("kind") == "number", F.regexp_replace("s", "^[0-9]+[.)]\\s+", "")).when(F.col("kind") == "quote", F.regexp_replace("s", "^[> ]+", ""))
        .when(F.col("kind") == "table", F.array_join(table_cells(F.col("s")), "\t")).otherwise(F.col("s")))
    parts = rows.withColumn("bare", F.trim(bare)).groupBy(doc, "block").agg(
        F.min_by("kind", number).alias("kind"), F.min_by(F.length(F.regexp_extract("s", "^(#*)", 1)), number).alias("level"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), "bare"))), lambda x: x["bare"]).alias("t"))
    return parts.select(
        doc, "block", F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "heading", F.col("level")).alias("level"),
        F.when(F.col("kind") == "table", F.array_join("t", "\n")).otherwise(F.array_join(F.filter("t", lambda x: x != ""), " ")).alias("text"))
