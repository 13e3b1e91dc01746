"""Mixing sources to target weights along a training curriculum, in DataFrame operations only.

Each source has a weight and a linear weight schedule over the curriculum's time t in [0, 1]. The
schedule's integral is the source's target, so its cumulative token demand is a quadratic in t,
which has a closed-form inverse. The documents of a source stand in a fixed pseudo-random order
(md5 of doc_id) and form its token stream, repeated as often as the target asks. The token
offset at which a document begins, put through the inverse demand, is its time. The demands of all
sources together are a quadratic in t as well; its share at that time is the document's training
position, so that a position is the share of the mix's tokens that come before it, and a source's
weight at a position is its demand there divided by that of all. A range sort by position gives the order.

Running sums come in two levels so that no source has to fit in one task: sums per
(source, hash bucket), offsets of the buckets, then running sums inside a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import aside, materialize, table

MADE = ["size", "source_size", "weight", "target", "taken", "position"]

WORD = r"[^\x20\x09-\x0D]+"
#: A source is taken at most so often; weights repeat along the sorted sources.
MOST, WEIGHTS = 3, 3
#: Leading hex digits of the order key that make a bucket: 16**3 buckets for each source.
BUCKET_DIGITS = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target, drift) from (source, source_size); drift is the tilt of all demands together.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... Targets share the total by weight and
    stop at most * source_size; what is above goes to the others by weight until none is above.
    With the caps sorted by cap/weight, that level is the largest of the levels that would hold
    if exactly the first k sources were capped. One row per source: a small table.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * most)
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.sum("source_size").over(every) - capped).cast("double") / open_weight.cast("double"))
    targets = level.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")).alias("target"))
    budget = F.floor(F.col("target") + 0.5)
    return targets.withColumn("drift", F.coalesce(F.sum(budget * _tilt(F.col("weight"))).over(every) / F.sum(budget).over(every), F.lit(0.0)))


def _tilt(weight: Column) -> Column:
    """Slope of a source's schedule: its demand at time t is target * ((1 - tilt) + 2 * tilt * t)."""
    return (weight - 2) / 2.0


def _position(offset: Column, weight: Column, budget: Column, drift: Column) -> Column:
    """Share of all sources' demand up to the time at which a source's own reaches the token offset of its repeated stream."""
    tilt = _tilt(weight)
    share = offset.cast("double") / budget.cast("double")
    time = 2 * share / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share))
    return let(time, lambda t: (1 - drift) * t + drift * t * t)


def mix_sources(docs: DataFrame, most: int = MOST, digits: int = BUCKET_DIGITS, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, weight, target, taken, position.

    size is the number of words (null text: 0), or what the column given says. taken is how many words the mix takes of the
    row: the first floor(target + 0.5) words of the source's repeated stream, so whole copies
    except for one document of the source, and at most `most` times the size. position in
    [0, 1) is where the row's first copy starts in training; null if nothing is taken. The
    order depends on doc_id alone, so reruns agree. A text of any length is one row and is counted whole.

    A null source is a source of its own; null doc_ids and repeated rows are ordinary rows.
    Sources without words get target 0. An empty table gives an empty result. Columns of docs
    with the names above are replaced.
    """
    return _mixed(docs, most, digits, size).select("row.*", *MADE)


def _mixed(docs: DataFrame, most: int, digits: int = BUCKET_DIGITS, size: Column | None = None) -> DataFrame:
    """(row, ...MADE, first, drift): row has the columns of docs, first is the token offset at which it begins in its source's stream."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE]).alias("row"), "source", "doc_id",
        (word_count(F.col("text")) if size is None else size).alias("size"), key.alias("key"), F.substring(key, 1, digits).alias("bucket"),
    )
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "bucket", "offset", "source_size", "weight", "target", "drift")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("upto", F.sum("size").over(inside) - F.col("size")).alias("r")
    joined = run.join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    first = F.col("offset") + F.col("upto")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.greatest(rest - first, F.lit(0)), F.col("size"))
    return joined.select(
        "row", "size", "source_size", "weight", "target", taken.cast("long").alias("taken"),
        F.when(taken > 0, _position(first, F.col("weight"), budget, F.col("drift"))).alias("position"), first.alias("first"), "drift",
    )


def training_order(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mix itself: a row of docs for each copy that is taken, range-sorted by training position.

    A document that is taken n times (the last perhaps in part) comes n times, whole; one of which
    nothing is taken goes, as do rows without words. Columns are those of docs with their own values,
    whatever their names. Null doc_ids and sources and repeated rows are ordinary rows; an empty table
    gives an empty result.
    """
    safe, back = aside(docs, MADE)
    return back(_copies(safe, most).orderBy("place", "row.doc_id").select("row.*"))


def _copies(docs: DataFrame, most: int) -> DataFrame:
    """Each copy with lap and place in [0, 1), where it starts in training: its own token offset goes through the inverse demand."""
    copies = F.ceil(F.col("taken") / F.col("size"))
    laps = _mixed(docs, most).where("taken > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    return laps.withColumn("place", _position(F.col("first") + F.col("lap") * F.col("source_size"), F.col("weight"), F.floor(F.col("target") + 0.5), F.col("drift")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each, in training order (see mix_sources)."""
    # words are counted once: the plan reads the sizes twice
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words")))
    return mix_sources(docs, size=F.col("n_words")).orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sources
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
           ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, weight, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels
), drifting AS (
  SELECT *, coalesce(sum(floor(target + 0.5) * ((weight - 2) / 2.0::DOUBLE)) OVER () / sum(floor(target + 0.5)) OVER (), 0) AS drift FROM targets
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.weight, t.target, t.drift, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS first
  FROM sized s JOIN drifting t ON s.source IS NOT DISTINCT FROM t.source
), taking AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM placed
), result AS (
  SELECT *, whole * size + least(greatest(budget - whole * source_size - first, 0), size) AS taken,
         (weight - 2) / 2.0::DOUBLE AS tilt, CAST(first AS DOUBLE) / CAST(budget AS DOUBLE) AS share FROM taking
), timed AS (
  SELECT *, CASE WHEN taken > 0 THEN 2 * share / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)) END AS t FROM result
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, (1 - drift) * t + drift * t * t AS position
FROM timed
"""
