"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target in tokens and exceed no cap, those
nearest to the prior rates in relative entropy, sum(rate * log(rate / prior) - rate), are
prior * exp(lambda * size), cut at the cap, with one multiplier lambda for each source. It is the
root of the convex dual's gradient, target - sum(size * rate), which Newton's method finds from
sums over the documents. The rates are then rounded into copies: whole copies first, then one more
in the order of a hash divided by what is left of the rate, as far as the source's target reaches;
what is still missing is filled with the largest documents that fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.llm.common import WORD_BREAK, join_groups, written

#: The state of so many sources is broadcast; that of more is joined.
BROADCAST_SOURCES = 50_000
#: A source's documents are put into so many bins by their keys (in bits) to find where its target is reached.
_RADIX = 14
_HASH_BITS = 48
#: Significant digits of lambda that count, so that the order of summation changes no rate.
_DIGITS = 11


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_BREAK))).cast("long")


def hash_order(id_column: Column, seed: str = "mix") -> Column:
    """48 bits of the md5 of seed and id, the order in which documents get another copy."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_column.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size and more, a row each) with target, the tokens that each is to give.

    Sources by code point, null last, take the weights in turn; they divide share of all sizes. No
    target exceeds cap times its source's size; what is cut off is divided again by weight: those
    with the least cap for their weight are cut first. One row per source passes a window.
    """
    last = F.col("source").asc_nulls_last()
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy(last)) - 1) % len(weights)
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("__cap", cap * F.col("source_size"))
    budget = share * F.sum("source_size").over(everything)
    before = Window.orderBy(F.col("__cap") / F.col("__w"), last).rowsBetween(Window.unboundedPreceding, -1)
    rest = budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    open_weight = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    judged = weighed.withColumns({"__budget": budget, "__over": rest * F.col("__w") / open_weight > F.col("__cap")})
    left = F.col("__budget") - F.coalesce(F.sum(F.when(F.col("__over"), F.col("__cap"))).over(everything), F.lit(0.0))
    left_weight = F.sum(F.when(~F.col("__over"), F.col("__w"))).over(everything)
    return judged.withColumn("target", F.when(F.col("__over"), F.col("__cap")).otherwise(left * F.col("__w") / left_weight)).select(*sources.columns, "target")


@dataclass(frozen=True)
class Extent:
    """How many sources and documents there are."""

    sources: int
    docs: int

    def attach(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """rows with their source's state. state: a written row for each source, with docs, its rows."""
        if self.sources <= BROADCAST_SOURCES:
            return rows.join(F.broadcast(state), "skey")
        return join_groups(rows, state, "skey", "docs", self.docs, "inner")


def _rate(cap: float, tilt: Column) -> Column:
    return F.when(F.col("prior") > 0, F.least(F.col("prior") * F.exp(tilt * F.col("size")), F.lit(cap))).otherwise(0.0)


def newton_tilts(moments: DataFrame, sources: DataFrame, cap: float, steps: int = 200) -> tuple[DataFrame, Extent]:
    """sources with tilt, the lambda of each, and their extent. RuntimeError if one is not found in so many steps.

    moments: skey, size, prior, n (documents alike), written; sources: skey, target and more. A step
    is one job: sums by source, a step of Newton's method on the logarithm of what the source
    gives, halved into the interval known to hold the root where it leaves it. A target beyond
    cap times what has a prior is cut to that.
    """
    weight = F.col("n") * F.col("size")
    can = moments.where("size > 0 AND prior > 0").groupBy("skey").agg((cap * F.sum(weight)).alias("most"), (F.sum(weight * F.col("size")) / F.sum(weight)).alias("mean"), F.min("prior").alias("least"))
    high = F.greatest(F.log(cap / F.col("least")), F.lit(0.0))
    begun = sources.join(can, "skey", "left").withColumns({"goal": F.least("target", F.coalesce("most", F.lit(0.0))), "high": F.coalesce(high, F.lit(0.0))})
    # no document gives anything, or each gives all that it may
    fixed = F.when(F.col("goal") <= 0, F.lit(-1e9)).when(F.col("goal") >= F.col("most") * (1 - 1e-12), F.col("high"))
    names = [*sources.columns, "goal", "mean", "low", "high", "tilt", "done"]
    state = written(begun.withColumns({"tilt": F.coalesce(fixed, F.lit(0.0)), "done": fixed.isNotNull(), "low": F.lit(float("-inf"))}).select(*names), "mix-tilts")
    extent = Extent(*state.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first())
    for _ in range(steps):
        rate = _rate(cap, F.col("tilt"))
        sums = extent.attach(moments.where("size > 0"), state.select("skey", "tilt", "done", "docs")).where("NOT done").groupBy("skey").agg(F.sum(weight * rate).alias("given"), F.sum(F.when(rate < cap, weight * F.col("size") * rate).otherwise(0.0)).alias("slope"))
        at, given, slope = F.col("tilt"), F.col("given"), F.col("slope")
        low, up = F.when(given < F.col("goal"), at).otherwise(F.col("low")), F.when(given < F.col("goal"), F.col("high")).otherwise(at)
        step = at + F.when((slope > 0) & (given > 0), F.log(F.col("goal") / given) * given / slope).otherwise(float("-inf"))
        floor = at - F.greatest(10 / F.col("mean"), F.abs(at))
        inside = F.when((step > low) & (step < up) & (step >= F.when(low > float("-inf"), low).otherwise(floor)), step).when(low > float("-inf"), (low + up) / 2).otherwise(floor)
        near = (F.abs(given - F.col("goal")) <= 1e-9 * F.col("goal")) | ((up - low) <= 1e-15 * F.abs(at))
        moved = state.join(sums, "skey", "left").withColumns({"__tilt": F.when(F.col("done"), at).otherwise(F.when(near & ~((step > low) & (step < up)), at).otherwise(inside)), "__low": low, "__high": up, "__done": F.col("done") | near})
        seen = Observation()
        moved = moved.withColumns({"tilt": F.col("__tilt"), "low": F.when(F.col("done"), F.col("low")).otherwise(F.col("__low")), "high": F.when(F.col("done"), F.col("high")).otherwise(F.col("__high")), "done": F.col("__done")}).select(*names)
        state = written(moved.observe(seen, F.count(F.when(~F.col("done"), 1)).alias("apart")), "mix-tilts")
        if not seen.get["apart"]:
            break
    else:
        raise RuntimeError(f"rates did not settle in {steps} steps")
    scale = F.pow(F.lit(10.0), _DIGITS - F.floor(F.log10(F.abs("tilt"))))
    return state.withColumn("tilt", F.when(F.abs("tilt") > 1e-100, F.rint(F.col("tilt") * scale) / scale).otherwise(0.0)).select(*sources.columns, "tilt"), extent


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, prior_col: str | None, *more: Column) -> DataFrame:
    prior = F.lit(1.0) if prior_col is None else F.coalesce(F.col(prior_col).cast("double"), F.lit(0.0))
    source = F.col(source_col).cast("string")
    skey = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return docs.select(*more, F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), skey.alias("skey"), word_count(F.col(text_col)).alias("size"), prior.alias("prior"), hash_order(F.col(id_col)).alias("u"))


def mix_rates(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prior_col: str | None = None) -> tuple[DataFrame, DataFrame, Extent]:
    """The documents' written sizes, what each source's mix is (one written row per source), and how many there are.

    Sizes: doc_id, source, skey, size, prior, u. Sources: skey, source_size, docs, target, tilt,
    cap, last (the largest key that gets one more copy) and fill (sizes, and up to which hash
    further documents of that size get one).
    """
    table = written(_sized(docs, id_col, text_col, source_col, prior_col), "mix-sizes")
    moments = written(table.groupBy("skey", "source", "size", "prior").agg(F.count("*").alias("n")), "mix-moments")
    sources = moments.groupBy("skey", "source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    tilts, extent = newton_tilts(moments, source_targets(sources, weights, share, cap), cap)
    state = tilts.drop("source").withColumn("cap", F.lit(float(cap)))
    keyed = written(_keyed(table, state, extent).select("skey", "size", "copies", "may", "key", "u"), "mix-keys")
    base = keyed.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("base"))
    start = state.join(base, "skey", "left").withColumn("room", F.col("target") - F.coalesce("base", F.lit(0)))
    start = written(start.drop("base"), "mix-room")
    open_ = keyed.where("may AND size > 0").select("skey", "size", "key", "u")
    reached = written(start.join(_last_key(open_, start, extent), "skey", "left").withColumn("last", F.coalesce("last", F.lit((1 << 61)))), "mix-last")
    fill = _fill(open_, reached, extent)
    return table, written(reached.join(fill, "skey", "left").withColumn("fill", F.coalesce("fill", F.array().cast("array<struct<size:bigint,u:bigint>>"))).drop("room"), "mix-fill"), extent


def _last_key(open_: DataFrame, start: DataFrame, extent: Extent) -> DataFrame:
    """skey and last: how far the order of keys goes within the room; no row where all fit.

    The bin of the keys' leading bits where the sum passes the room is found first, then the key in it.
    """
    bin_ = F.shiftright("key", _HASH_BITS + 4 - _RADIX)
    bins = open_.groupBy("skey", bin_.alias("bin")).agg(F.sum("size").alias("size"))
    upto = bins.withColumn("upto", F.sum("size").over(Window.partitionBy("skey").orderBy("bin"))).join(start.select("skey", "docs", "room"), "skey")
    hit = upto.where("upto > room").groupBy("skey").agg(F.first("docs").alias("docs"), F.min(F.struct("bin", (F.col("room") - F.col("upto") + F.col("size")).alias("room"))).alias("h"))
    level = written(hit.select("skey", "docs", F.col("h.bin").alias("bin"), F.col("h.room").alias("room")), "mix-bins")
    runs = extent.attach(open_, level.select("skey", "docs", "bin")).where(bin_ == F.col("bin")).groupBy("skey", "key").agg(F.sum("size").alias("size"))
    within = runs.withColumn("upto", F.sum("size").over(Window.partitionBy("skey").orderBy("key"))).join(level.select("skey", "room"), "skey").where("upto <= room").groupBy("skey").agg(F.max("key").alias("key"))
    return level.join(within, "skey", "left").select("skey", F.coalesce("key", F.shiftleft("bin", _HASH_BITS + 4 - _RADIX) - 1).alias("last"))


def _fill(open_: DataFrame, reached: DataFrame, extent: Extent) -> DataFrame:
    """skey and fill: the sizes that fill what is missing, largest first, and the hash up to which they do.

    When nothing fits any more, the smallest document left is added if that comes nearer.
    """
    marked = extent.attach(open_, reached.select("skey", "docs", "room", "last"))
    given = marked.where("key <= last").groupBy("skey").agg(F.sum("size").alias("given"))
    lack = written(reached.join(given, "skey", "left").select("skey", "docs", "last", (F.col("room") - F.coalesce("given", F.lit(0))).alias("lack")), "mix-lack")
    free = extent.attach(open_, lack).where("key > last AND size < 2 * lack").select("skey", "size", "u", "lack")
    sizes = free.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("lack").alias("lack"))
    # as many entries as there are sizes below the longest text's, in a row for each source
    lists = sizes.groupBy("skey").agg(F.first("lack").alias("lack"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    none = F.array().cast("array<struct<size:bigint,k:bigint>>")

    def take(a: Column, e: Column) -> Column:
        k = F.least(e["n"], F.floor(a["lack"] / e["size"]).cast("long"))
        picks = F.when(k > 0, F.concat(a["picks"], F.array(F.struct(e["size"].alias("size"), k.alias("k"))))).otherwise(a["picks"])
        return F.struct((a["lack"] - k * e["size"]).alias("lack"), picks.alias("picks"), F.when(e["n"] > k, e["size"]).otherwise(a["next"]).alias("next"))

    def close(a: Column) -> Column:
        return F.when(a["next"] < 2 * a["lack"], F.concat(a["picks"], F.array(F.struct(a["next"].alias("size"), F.lit(1).cast("long").alias("k"))))).otherwise(a["picks"])

    folded = F.aggregate("sizes", F.struct(F.col("lack").alias("lack"), none.alias("picks"), F.lit(None).cast("long").alias("next")), take, close)
    picks = written(lists.select("skey", F.explode(folded).alias("p")).groupBy("skey", "p.size").agg(F.sum("p.k").alias("k")), "mix-picks")
    # the k least hashes of a size: first in parts of it, then among what they leave
    pool = free.select("skey", "size", "u").join(picks, ["skey", "size"]).withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(64)))
    ranked = lambda rows, *by: rows.withColumn("__n", F.count("*").over(Window.partitionBy("skey", "size", *by).orderBy("u"))).where("__n <= k")
    ends = ranked(ranked(pool, "salt")).groupBy("skey", "size").agg(F.max("u").alias("u"))
    return ends.groupBy("skey").agg(F.collect_list(F.struct("size", "u")).alias("fill"))


def _keyed(rows: DataFrame, state: DataFrame, extent: Extent) -> DataFrame:
    """rows with their source's state, whole copies, and the key that orders the further ones."""
    rate = F.when(F.col("prior") > 0, F.least(F.col("prior") * F.exp(F.col("tilt") * F.col("size")), F.col("cap"))).otherwise(0.0)
    part = F.col("rate") - F.col("copies")
    joined = extent.attach(rows, state).withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long"))
    return joined.withColumn("may", (part > 0) & (F.col("copies") + 1 <= F.col("cap"))).withColumn("key", F.when(F.col("may"), F.least(F.floor(F.col("u") / part), F.lit(1 << 60) - 1)).cast("long"))


def _copies(rows: DataFrame, state: DataFrame, extent: Extent) -> DataFrame:
    """rows with copies as the mix has them."""
    filled = F.exists("fill", lambda f: (f["size"] == F.col("size")) & (F.col("u") <= f["u"]))
    extra = F.col("may") & ((F.col("key") <= F.col("last")) | ((F.col("size") > 0) & filled))
    return _keyed(rows, state, extent).withColumn("copies", F.col("copies") + F.coalesce(extra, F.lit(False)).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate.

    Sizes are words; a null text has none, and is taken as rates have it at no cost. A source of
    null is a source. Rows of one id and size in a source, repeated ones too, share their hash and
    are rounded alike, so a source may miss its target by as much as they hold. An empty table
    gives no rows; columns that are not named are ignored. Reruns give the same copies.
    """
    table, state, extent = mix_rates(docs, **options)
    return _copies(table, state, extent).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prior_col: str | None = None, **options) -> DataFrame:
    """docs, each row as often as mix() takes it, with all its columns. Texts are not shuffled while a state of all sources can be broadcast."""
    _, state, extent = mix_rates(docs, id_col=id_col, text_col=text_col, source_col=source_col, prior_col=prior_col, **options)
    rows = _sized(docs, id_col, text_col, source_col, prior_col, F.struct("*").alias("__row"))
    taken = _copies(rows, state, extent).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies", "rate")


OP7_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS u
  FROM documents
), moments AS MATERIALIZED (
  SELECT source, size, count(*) AS n FROM sized GROUP BY source, size
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE AS budget FROM sources
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2 * source_size) OVER below, 0)::DOUBLE AS capped, coalesce(sum(w) OVER below, 0) AS capped_w, sum(w) OVER () AS all_w
  FROM weighed WINDOW below AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, (budget - capped) * w / (all_w - capped_w) > cap AS over FROM ranked
), rest AS (
  SELECT any_value(budget) - coalesce(sum(cap) FILTER (over), 0) AS left_over, sum(w) FILTER (NOT over) AS left_w FROM stopped
), targets AS MATERIALIZED (
  SELECT source, source_size, over, CASE WHEN over THEN cap ELSE left_over * w / left_w END AS target FROM stopped, rest
), halved AS (
  SELECT source, target, 0 AS step, -40.0::DOUBLE AS low, ln(2.0::DOUBLE) AS high FROM targets
  UNION ALL
  SELECT source, any_value(target), any_value(step) + 1, CASE WHEN sum(given) < any_value(target) THEN any_value(mid) ELSE any_value(low) END, CASE WHEN sum(given) < any_value(target) THEN any_value(high) ELSE any_value(mid) END
  FROM (SELECT h.*, (low + high) / 2 AS mid, n * size * least(2.0::DOUBLE, exp(least((low + high) / 2 * size, 1.0::DOUBLE))) AS given FROM halved h JOIN moments m ON h.source IS NOT DISTINCT FROM m.source WHERE step < 100)
  GROUP BY source
), tilts AS (
  SELECT h.source, CASE WHEN over THEN ln(2.0::DOUBLE) ELSE (low + high) / 2 END AS raw FROM halved h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source WHERE step = 100
), rounded AS (
  SELECT source, CASE WHEN abs(raw) > 1e-100 THEN round(raw * pow(10.0::DOUBLE, 11 - floor(log10(abs(raw))))) / pow(10.0::DOUBLE, 11 - floor(log10(abs(raw)))) ELSE 0 END AS tilt FROM tilts
), rated AS (
  SELECT d.*, t.source_size, t.target, least(exp(least(tilt * size, 1.0::DOUBLE)), 2.0::DOUBLE) AS rate FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN rounded r ON d.source IS NOT DISTINCT FROM r.source
), based AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS base, rate > floor(rate) AND floor(rate) + 1 <= 2 AND size > 0 AS may FROM rated
), keyed AS MATERIALIZED (
  SELECT *, CASE WHEN may THEN least(floor(u / (rate - base)), 1152921504606846975) END AS key, target - sum(base * size) OVER (PARTITION BY source) AS room FROM based
), first_round AS MATERIALIZED (
  SELECT *, may AND sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key NULLS LAST RANGE UNBOUNDED PRECEDING) <= room AS extra FROM keyed
), lacks AS (
  SELECT source, any_value(room) - coalesce(sum(size) FILTER (extra), 0) AS lack FROM first_round GROUP BY source
), free AS MATERIALIZED (
  SELECT source, size, count(*) AS n FROM first_round WHERE may AND NOT extra GROUP BY source, size
), picking AS (
  SELECT source, lack, NULL::BIGINT AS size, 0::BIGINT AS k FROM lacks
  UNION ALL
  SELECT p.source, any_value(lack) - max(f.size) * least(max_by(f.n, f.size), CAST(floor(any_value(lack) / max(f.size)) AS BIGINT)), max(f.size), least(max_by(f.n, f.size), CAST(floor(any_value(lack) / max(f.size)) AS BIGINT))
  FROM picking p JOIN free f ON p.source IS NOT DISTINCT FROM f.source AND f.size <= p.lack AND (p.size IS NULL OR f.size < p.size) GROUP BY p.source
), ends AS (
  SELECT source, min(lack) AS lack FROM picking GROUP BY source
), last_one AS (
  SELECT f.source, min(f.size) AS size, 1 AS k FROM free f JOIN ends e ON f.source IS NOT DISTINCT FROM e.source LEFT JOIN picking p ON p.source IS NOT DISTINCT FROM f.source AND p.size = f.size
  WHERE f.n > coalesce(p.k, 0) GROUP BY f.source, e.lack HAVING min(f.size) < 2 * e.lack
), picks AS (
  SELECT source, size, sum(k) AS k FROM (SELECT source, size, k FROM picking WHERE k > 0 UNION ALL SELECT * FROM last_one) GROUP BY source, size
), second_round AS (
  SELECT r.*, coalesce(may AND NOT extra AND count(*) FILTER (may AND NOT extra) OVER (PARTITION BY r.source, r.size ORDER BY u) <= k, FALSE) AS filled
  FROM first_round r LEFT JOIN picks p ON r.source IS NOT DISTINCT FROM p.source AND r.size = p.size
)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN extra OR filled THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM second_round
"""
