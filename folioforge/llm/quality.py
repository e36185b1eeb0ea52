"""Per-document text quality statistics and the kind of text they tell (problem 10).

The statistics are built-in Spark expressions.  A Gaussian mixture is fitted to
the standardised statistics of *all* documents by expectation-maximisation; each
round is one pass over the statistics table that sums responsibilities per
partition, so only sums travel.  Components get the class - prose, list, table
or junk - of the inspected examples they answer for.

Defined results: null and empty texts (and such as hold only blanks) have no
statistics and no class; texts are read whole at any length; repeated rows count
as often as they occur and get the same class; an empty table gives an empty
result; columns that are not named are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.quality_examples import EXAMPLES
from folioforge.shared import cut, spread

KINDS = list(EXAMPLES)
ROUNDS = 100  # at most; told if not settled by then
FLOOR = 0.02  # added to each variance of the standardised statistics
TOLERANCE = 1e-3


def _quoted(common: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "").replace("'", "\\'") + "'" for w in sorted(set(common))) or "''"


def statistics(df: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """Counts and shares of every text, as it is stored, that is neither null nor blank.

    A word is a run of letters; a line is one that holds more than blanks, ended
    if its last sign is one of ``. ! ? …``, closing signs after it aside.
    """
    base = spread(df.select(F.col(key).alias("id"), F.col(text).alias("t"))).filter(r"t rlike '[^\\s\\p{Z}]'")
    counted = base.selectExpr(
        "id", "length(t) AS n_chars", r"filter(split(lower(t), '[^\\p{L}\\p{M}]+'), x -> x != '') AS w",
        r"regexp_count(t, '[^\\p{L}\\p{M}\\p{Nd}\\s\\p{Z}]') AS symbols", r"regexp_count(t, '\\p{Nd}') AS digits",
        r"regexp_count(t, '[^\\n]*[^\\s\\p{Z}][^\\n]*') AS n_lines", r"regexp_count(t, '[.!?…][)\"»”]*[ \\t\\r]*(?:\\n|$)') AS ended")
    return counted.selectExpr(
        "id", "n_chars", "size(w) AS n_words", "n_lines", "if(size(w) = 0, 0d, length(array_join(w, '')) / size(w)) AS mean_word_length",
        "symbols / n_chars AS symbol_ratio", "digits / n_chars AS digit_ratio", "least(1d, ended / n_lines) AS ended_line_share",
        f"if(size(w) = 0, 0d, size(filter(w, x -> x IN ({_quoted(common)}))) / size(w)) AS common_word_share").withColumnRenamed("id", key)


def statistics_sql(source: str, key: str, text: str, common: str) -> str:
    """The same as SQL; ``common`` is a query of one column of words."""
    return rf"""WITH k AS (SELECT list(DISTINCT word) AS ks FROM ({common}) q(word)),
 b AS (SELECT {key}, {text} AS t, list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}]+'), lambda x: x <> '') AS w FROM {source} WHERE regexp_matches({text}, '[^\s\p{{Z}}]')),
 c AS (SELECT {key}, w, length(t) AS n_chars, len(w) AS n_words, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}]'))) AS n_lines,
  len(regexp_extract_all(t, '[^\p{{L}}\p{{M}}\p{{Nd}}\s\p{{Z}}]')) AS symbols, len(regexp_extract_all(t, '\p{{Nd}}')) AS digits,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[.!?…][)"»”]*[ \t\r]*$'))) AS ended, len(list_filter(w, lambda x: list_contains(ks, x))) AS n_common FROM b, k)
 SELECT {key}, CAST(n_chars AS INTEGER) AS n_chars, CAST(n_words AS INTEGER) AS n_words, CAST(n_lines AS INTEGER) AS n_lines,
  CASE WHEN n_words = 0 THEN 0 ELSE length(array_to_string(w, '')) / n_words END AS mean_word_length, symbols / n_chars AS symbol_ratio, digits / n_chars AS digit_ratio,
  least(1.0, ended / n_lines) AS ended_line_share, CASE WHEN n_words = 0 THEN 0 ELSE n_common / n_words END AS common_word_share FROM c"""


def shape(df: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """What tells the kinds of text apart, of texts with blanks and line ends set alike."""
    words = _quoted(common)
    # Blanks of any kind are blanks, and words set wide apart or one to a line are still running text.
    blank = r"\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
    one_to_a_line = r"\\n(?=[\\p{Ll}\\p{Nd}%°(][^\\s;,|]*(?:\\n|$))"
    wide = rf"(?=[ \\t\\n{blank}])(?:[{blank}]| {{2,}}(?=\\p{{Ll}})|\\t[ \\t]*(?=\\p{{Ll}})|\\n(?=\\p{{Ll}})(?<=[^\\n]{{40}}[\\p{{L}},]\\n)|{one_to_a_line})"
    base = spread(df.select(F.col(key).alias("id"), F.col(text).alias("t"))).filter(f"t rlike '[^\\\\s{blank}]'")
    base = base.selectExpr("id", f"regexp_replace(t, '{wide}', ' ') AS t")
    counted = base.selectExpr(
        "id", "length(t) AS n_chars",
        r"regexp_count(t, '[^\\p{L}\\p{M}\\p{Nd}\\s]') AS symbols",
        r"regexp_count(t, '\\p{Nd}') AS digits",
        r"regexp_count(t, '\\S+') AS n_tokens",
        r"split(lower(t), '[^\\p{L}\\p{M}]+') AS w",
        r"regexp_count(t, '[^\\n]*[^\\s][^\\n]*') AS n_lines",
        r"regexp_count(t, '[.!?…:][\\)\"»”]*[^\\S\\n]*(?:\\n|$)') AS ended_lines",
        r"regexp_count(t, '(?m)^[^\\S\\n]*(?:[-–—*•·+]|\\(?\\d{1,3}[.\\)]|\\[\\d+\\]|\\p{L}\\))[^\\S\\n]') AS marked_lines",
        r"regexp_count(t, '[.!?…][\\)\"»”]*(?:\\s|$)') AS sentence_ends",
        r"regexp_count(t, '(?=[|\\t;,. ])(?:[|\\t;]|,(?=[^\\s\\d])|,(?=\\d+[.])| {2,}(?=\\S)|[.] ?[.] ?[.]| , )') AS separators",
        r"regexp_count(t, '\\p{Nd}(?:(?=\\p{L})|(?<=\\p{L}\\p{Nd}))') AS mixed",
        r"regexp_count(t, '[\\x{0080}-\\x{009F}\\x{00A1}-\\x{00A9}\\x{00AC}-\\x{00AF}\\x{00B1}-\\x{00B6}\\x{00B8}-\\x{00BA}\\x{00BC}-\\x{00BE}ÐÑÃÂâ€]') AS odd",
        r"regexp_count(t, '(?m)^[^\\S\\n]*\\S+(?:[^\\S\\n]+\\S+){0,2}[^\\S\\n]*$') AS brief_lines",
    )
    full = counted.selectExpr(
        "*", "filter(w, x -> x != '') AS ws").selectExpr(
        "id", "n_chars", "length(array_join(ws, '')) AS letters", "digits", "symbols", "n_tokens", "size(ws) AS n_words",
        f"size(filter(ws, x -> x IN ({words}))) AS n_common", "size(array_distinct(ws)) AS n_distinct",
        "greatest(n_lines, 1) AS n_lines", "ended_lines", "marked_lines", "sentence_ends", "separators", "mixed", "odd", "brief_lines")
    return full.selectExpr(
        "id", "n_chars", "n_words", "n_lines",
        "if(n_words = 0, 0d, letters / n_words) AS mean_word_length",
        "symbols / n_chars AS symbol_ratio", "digits / n_chars AS digit_ratio",
        "least(1d, ended_lines / n_lines) AS ended_line_share",
        "if(n_words = 0, 0d, n_common / n_words) AS common_word_share",
        "least(1d, marked_lines / n_lines) AS marked_line_share",
        "n_tokens / n_lines AS tokens_per_line",
        "n_tokens / (sentence_ends + 1) AS tokens_per_sentence",
        "separators / n_tokens AS separator_ratio",
        "mixed / n_tokens AS mixed_ratio", "odd / n_chars AS odd_ratio",
        "least(1d, brief_lines / n_lines) AS brief_line_share",
        # New words get rarer the longer a text is: its length counts less and less, towards 400.
        "if(n_words = 0, 1d, least(1d, ln(1 + n_distinct) / ln(1 + n_words / (1 + n_words / 400d)))) AS variety")


#: What the mixture sees.
FEATURES = (
    "ln(1 + mean_word_length)", "sqrt(symbol_ratio)", "sqrt(digit_ratio)", "ended_line_share", "sqrt(common_word_share)",
    "marked_line_share", "ln(1 + tokens_per_line)", "ln(1 + tokens_per_sentence)", "sqrt(least(2d, separator_ratio))",
    "sqrt(least(1d, mixed_ratio))", "sqrt(odd_ratio)", "brief_line_share", "variety",
)


class Mixture:
    """Full-covariance Gaussian components over standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, centres: np.ndarray, spreads: np.ndarray):
        self.mean, self.scale = mean, scale
        self.set(weights, centres, spreads)

    def set(self, weights: np.ndarray, centres: np.ndarray, spreads: np.ndarray) -> None:
        self.weights, self.centres, self.spreads = weights, centres, spreads
        self.roots = np.linalg.inv(np.linalg.cholesky(spreads))
        self.logs = np.log(weights) + np.log(np.abs(np.diagonal(self.roots, axis1=1, axis2=2))).sum(1) - 0.5 * centres.shape[1] * np.log(2 * np.pi)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each component for each standardised row, and the rows' log-likelihood."""
        logs = np.empty((len(x), len(self.weights)))
        for k, root in enumerate(self.roots):
            z = (x - self.centres[k]) @ root.T
            logs[:, k] = self.logs[k] - 0.5 * (z * z).sum(1)
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        return np.exp(logs - total[:, None]), total

    def standard(self, batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("f").flatten().to_numpy(zero_copy_only=False)
        return np.clip((flat.reshape(-1, len(self.mean)) - self.mean) / self.scale, -8, 8)


def _features(stats: DataFrame) -> DataFrame:
    return stats.selectExpr("id", "array(" + ", ".join(f"cast({f} as double)" for f in FEATURES) + ") AS f")


def _moments(model: Mixture, table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """One pass: per component the weight, sum and sum of products; log-likelihood and rows."""
    d, k = len(model.mean), len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (1 + d + d * d) + 2)
        for batch in batches:
            if batch.num_rows:
                x = model.standard(batch)
                r, ll = model.responsibilities(x)
                total[:k] += r.sum(0)
                total[k : k + k * d] += (r.T @ x).ravel()
                for c in range(k):
                    at = k + k * d + c * d * d
                    total[at : at + d * d] += ((x * r[:, c : c + 1]).T @ x).ravel()
                total[-2] += ll.sum()
                total[-1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["slot", "v"])

    rows = table.mapInArrow(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k * (1 + d + d * d) + 2)
    for row in rows:
        flat[row["slot"]] = row["v"]
    n, s, p = flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : -2].reshape(k, d, d)
    return n, s, p, float(flat[-2]), float(flat[-1])


def fit_mixture(table: DataFrame, examples: DataFrame, groups: list[int], rounds: int = ROUNDS) -> Mixture | None:
    """Expectation-maximisation from one component per group of examples; None for an empty table."""
    d = len(FEATURES)
    aggs = [f(F.col("f")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    row = table.agg(*aggs).first()
    if row[0] is None:
        return None
    mean = np.array(row[0::2], dtype=float)
    scale = np.maximum(np.array(row[1::2], dtype=float), 1e-3)
    x0 = np.clip((np.array([r["f"] for r in examples.orderBy("id").collect()]) - mean) / scale, -8, 8)
    k = max(groups) + 1
    g = np.array(groups)
    centres = np.array([x0[g == c].mean(0) for c in range(k)])
    spreads = np.array([np.cov(x0[g == c].T, bias=True) * 0.5 + np.eye(d) * 0.3 for c in range(k)])
    model = Mixture(mean, scale, np.full(k, 1 / k), centres, spreads)
    before = -np.inf
    for _ in range(rounds):
        n, s, p, ll, rows = _moments(model, table)
        # The examples count as ten rows each: a component never loses them altogether.
        r, _ = model.responsibilities(x0)
        own = np.where(np.arange(k)[None, :] == g[:, None], 0.5, 0.0) + 0.5 * r
        own *= 10
        n = n + own.sum(0)
        s = s + own.T @ x0
        p = p + np.einsum("ic,ij,ik->cjk", own, x0, x0)
        centres = s / n[:, None]
        spreads = p / n[:, None, None] - np.einsum("ci,cj->cij", centres, centres) + np.eye(d) * FLOOR
        model.set(n / n.sum(), centres, spreads)
        if abs(ll / rows - before) < TOLERANCE:
            break
        before = ll / rows
    else:
        warnings.warn(f"the mixture has not settled after {rounds} rounds", stacklevel=2)
    return model


def text_kinds(df: DataFrame, key: str, text: str, common: list[str], rounds: int = ROUNDS) -> DataFrame:
    """key, kind (prose, list, table or junk) and confidence of every text that is not blank."""
    spark = df.sparkSession
    kind_type = df.schema[key].dataType.simpleString()
    rows, groups, of_group = [], [], []
    for kind, sets in EXAMPLES.items():
        for group in sets:
            for t in group:
                rows.append((len(rows), t))
                groups.append(len(of_group))
            of_group.append(KINDS.index(kind))
    examples = _features(shape(spark.createDataFrame(rows, "id int, t string"), "id", "t", common))
    table = cut(_features(shape(df, key, text, common)), "quality")
    model = fit_mixture(table, examples, groups, rounds)
    if model is None:
        return spark.createDataFrame([], f"{key} {kind_type}, kind string, confidence double")
    # A component's class: that of the examples it answers for most.
    x0 = np.array([r["f"] for r in examples.orderBy("id").collect()])
    r, _ = model.responsibilities(np.clip((x0 - model.mean) / model.scale, -8, 8))
    votes = np.zeros((len(of_group), len(KINDS)))
    for i, g in enumerate(groups):
        votes[:, of_group[g]] += r[i] / groups.count(g)
    meaning = np.where(votes.sum(1) > 0.05, votes.argmax(1), np.array(of_group))
    to_kind = np.eye(len(KINDS))[meaning]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = model.responsibilities(model.standard(batch))[0] @ to_kind
                best = share.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([KINDS[b] for b in best]), pa.array(share.max(1))], ["id", "kind", "confidence"])

    return table.mapInArrow(run, f"id {kind_type}, kind string, confidence double").withColumnRenamed("id", key)
