"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose measure lies beyond a cutoff. A path, fixed beforehand, leads from
no rule to all rules at their strictest, tightening one rule a step by turns. Per stratum (language)
it is walked against labelled good documents as long as, at the level left by Bonferroni's
correction over strata, an exact binomial test shows that all rules together reject less than
max_risk of good documents; the first step that fails ends the walk (fixed-sequence testing), so
that trying many steps costs nothing, and neither risk nor error is split over rules. With too few
labels nothing is rejected. What the base rules reject is given and not within the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm.common import WORD_BREAK, written

_SPACE = " \t\n\x0b\f\r"
_WINDOW = 8
#: Measure (numerator, denominator) of each rule, and cutoffs from lenient to strict, in thousandths.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", (2000, 1500, 1000, 800, 600, 500, 400, 300, 200)),
    "shouting": ("n_shouts", "n_words", (1500, 1000, 800, 600, 500)),
    "same_lines": ("n_dup_lines", "n_lines", (800, 700, 600, 500, 400)),
    "repeats": ("n_repeat_words", "n_words", (300, 250, 200)),
    "long_words": ("word_chars", "n_words", (40_000, 30_000, 25_000, 20_000)),
}

#: The path: what each step tightens to which cutoff.
PATH: list[tuple[str, int]] = [(rule, grid[k]) for k in range(max(len(g) for _, _, g in RULES.values())) for rule, (_, _, grid) in RULES.items() if k < len(grid)]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts that the rules compare. A null text has no words.

    Windows are compared by 64-bit hashes within their document.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    bare = F.btrim("text", F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    split = base.select("doc_id", "stratum", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    hashes = F.when(n >= _WINDOW, F.transform(F.sequence(F.lit(1), n - _WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, _WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "stratum", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"), (F.length("text") - _without(F.col("text"), "!")).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("h"),
    )
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    sorted_ = counted.withColumn("pairs", pairs).drop("h")
    twin = F.filter("pairs", lambda e, i: F.coalesce(e["h"] == F.get("pairs", i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("pairs", i + 1)["h"], F.lit(False)))
    spots = sorted_.withColumn("spots", F.array_sort(F.transform(twin, lambda e: e["p"]))).drop("pairs")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spots", start, lambda a, p: F.struct((a["n"] + p + _WINDOW - F.greatest(p, a["end"])).alias("n"), (p + _WINDOW).alias("end")), lambda a: a["n"])
    return spots.withColumn("n_repeat_words", covered.cast("long")).drop("spots")


def _beyond(rule: str, cutoff: Column) -> Column:
    over, under, _ = RULES[rule]
    return (F.col(under) > 0) & (F.col(over) * 1000 > cutoff * F.col(under))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), term by term in logarithms; 1 where k is over n * p anyway."""
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))
    step = lambda a, j: a["t"] + F.log(((n - j + 1) / j) * F.lit(p / (1 - p)))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, lambda a, j: F.struct(step(a, j).alias("t"), (a["s"] + F.exp(step(a, j))).alias("s")), lambda a: a["s"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def reject_step() -> Column:
    """The first step of the path (from 1) that rejects a document; null if none does."""
    by_rule = []
    for rule in RULES:
        found = F.lit(None).cast("int")
        for step in reversed([k + 1 for k, (r, _) in enumerate(PATH) if r == rule]):
            found = F.when(_beyond(rule, F.lit(PATH[step - 1][1])), step).otherwise(found)
        by_rule.append(found)
    return F.least(*by_rule)


def proven_steps(found: DataFrame, labels: DataFrame, max_risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """One row per stratum with labels: stratum, n (good documents) and proven, the last step of the path that is proven, or 0.

    labels: doc_id, quality (1: good). The chance that in any stratum the rules as of its proven
    step reject max_risk or more of all good documents is at most error.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = found.join(good, "doc_id", "left_semi").select("stratum", reject_step().alias("step"))
    counts = written(held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("step") <= k + 1, 1)).alias(f"bad{k + 1}") for k in range(len(PATH))]), "quality-counts")
    level = error / max(1, counts.count())
    failed = F.lit(None).cast("int")
    for k in range(len(PATH), 0, -1):
        failed = F.when(binomial_tail(F.col("n"), F.col(f"bad{k}"), max_risk) > level, k).otherwise(failed)
    return counts.select("stratum", "n", (F.coalesce(failed, F.lit(len(PATH) + 1)) - 1).alias("proven"))


def cutoffs_at(step: int) -> dict[str, int]:
    """The rules' cutoffs as of a step of the path."""
    return dict(PATH[:step])


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ....

    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. Documents of a
    stratum without labels, null strata included, are judged by the base rules alone. Null and empty
    texts have no words; rows that repeat an id each give a row; an empty table gives no rows; texts
    are read whole, and other columns ignored.
    """
    found = written(measures(docs, id_col, text_col, stratum_col), "quality-measures")
    chosen = written(proven_steps(found, labels, max_risk, error), "quality-steps")
    joined = found.alias("d").join(chosen.alias("c"), F.col("d.stratum").eqNullSafe(F.col("c.stratum")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.coalesce(reject_step() <= F.col("proven"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), "d.stratum", "n_lines", "n_shouts")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, by the labels that there are."""
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_GRID = ", ".join(f"({k + 1}, '{rule}', {c})" for k, (rule, c) in enumerate(PATH))
_LONG = " UNION ALL ".join(f"SELECT rid, doc_id, stratum, '{rule}' AS rule, {over} AS over, {under} AS under FROM measured" for rule, (over, under, _) in RULES.items())
OP9_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM base, unnest(range(1, len(w) - 6)) t(i)
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY rid
), measured AS (
  SELECT rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_shouts,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)
), long AS (
  {_LONG}
), grid AS (
  SELECT * FROM (VALUES {_GRID}) g(step, rule, c)
), steps AS (
  SELECT rid, any_value(doc_id) AS doc_id, any_value(stratum) AS stratum, min(step) FILTER (under > 0 AND over * 1000 > c * under) AS first_step FROM long JOIN grid USING (rule) GROUP BY rid
), good AS (
  SELECT stratum, first_step FROM steps WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), counts AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER (first_step <= step) AS bad FROM good, grid GROUP BY stratum, step
), tails AS (
  SELECT *, CASE WHEN bad > n * 0.05 THEN 1.0 ELSE list_sum(list_transform(range(bad + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(0.95)))) END AS tail FROM counts
), chosen AS (
  SELECT stratum, coalesce(min(step) FILTER (tail > 0.05 / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM counts))), {len(PATH)} + 1) - 1 AS proven FROM tails GROUP BY stratum
), verdicts AS (
  SELECT rid, coalesce(first_step <= proven, FALSE) AS rejected FROM steps s LEFT JOIN chosen c ON s.stratum IS NOT DISTINCT FROM c.stratum
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured JOIN verdicts USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept, stratum, n_lines, n_shouts FROM judged
"""
