"""As-of and interval joins on time.

A match within a tolerance lies in the same time bucket or the one beside it. So rows are dealt by
(key, bucket), the searched side to two buckets, and one window per bucket finds the match:
one shuffle, no range join, and a key with very many rows is still spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(stamp) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros((F.col(stamp) if isinstance(stamp, str) else stamp).cast("timestamp"))


def _asof(left: DataFrame, right: DataFrame, by: str, tolerance_s: float, columns: dict[str, str], tie: str, sign: int) -> DataFrame:
    """Adds for each left row the columns of the nearest right row at or before it in time * sign."""
    width = max(1, int(tolerance_s * 1e6))
    kept = [c for c in left.columns]
    l = left.select(F.struct(*kept).alias("l"), F.col(by).alias("key"), (sign * micros("stamp")).alias("t"), F.lit(None).cast("long").alias("tie"), F.lit(1).alias("side")).withColumn("bucket", F.floor(F.col("t") / width))
    r = right.select(F.struct(micros("stamp").alias("at"), *[F.col(c).alias(n) for n, c in columns.items()]).alias("r"), F.col(by).alias("key"), (sign * micros("stamp")).alias("t"), F.col(tie).cast("long").alias("tie"), F.lit(0).alias("side"))
    r = r.withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1)))
    both = l.unionByName(r, allowMissingColumns=True)
    upto = Window.partitionBy("key", "bucket").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("m", F.last("r", ignorenulls=True).over(upto)).where("side = 1")
    near = F.col("t") - sign * F.col("m.at") <= width
    return found.select("l.*", *[F.when(near, F.col(f"m.{n}")).alias(n) for n in columns], F.when(near, F.col("m.at")).alias("matched_at"))


def asof_backward(left: DataFrame, right: DataFrame, by: str, tolerance_s: float, columns: dict[str, str], tie: str = "event_id") -> DataFrame:
    """Latest right row at or before each left row, within the tolerance; nulls where there is none. Equal stamps: the largest tie."""
    return _asof(left, right, by, tolerance_s, columns, tie, 1)


def asof_forward(left: DataFrame, right: DataFrame, by: str, tolerance_s: float, columns: dict[str, str], tie: str = "event_id") -> DataFrame:
    """Earliest right row at or after each left row, within the tolerance."""
    return _asof(left, right, by, tolerance_s, columns, tie, -1)


def asof_nearest(left: DataFrame, right: DataFrame, by: str, tolerance_s: float, columns: dict[str, str], tie: str = "event_id") -> DataFrame:
    """Nearest right row in either direction; the earlier one if both are as near."""
    names = list(columns)
    back = asof_backward(left, right, by, tolerance_s, columns, tie).withColumnsRenamed({n: f"b_{n}" for n in names} | {"matched_at": "b_at"})
    both = asof_forward(back, right, by, tolerance_s, columns, tie)
    t = micros("stamp")
    earlier = F.col("b_at").isNotNull() & (F.col("matched_at").isNull() | (t - F.col("b_at") <= F.col("matched_at") - t))
    return both.select(*left.columns, *[F.when(earlier, F.col(f"b_{n}")).otherwise(F.col(n)).alias(n) for n in names], F.when(earlier, F.col("b_at")).otherwise(F.col("matched_at")).alias("matched_at"))


def samples_between(frames: DataFrame, samples: DataFrame, by: str, delay_s: float = 0.0) -> DataFrame:
    """samples with frame_id of the frame whose interval [previous frame, frame) holds stamp + delay.

    Samples before a key's first frame go to that frame; those at or after its last go nowhere.
    """
    t = micros("stamp")
    f = frames.select(F.col(by).alias("key"), t.alias("t"), F.lit(0).alias("side"), "frame_id")
    s = samples.select(F.col(by).alias("key"), (t + int(delay_s * 1e6)).alias("t"), F.lit(1).alias("side"), F.struct(*samples.columns).alias("s"))
    # going back in time, the next frame is the last one seen; a frame comes after samples of its own stamp
    later = Window.partitionBy("key").orderBy(F.col("t").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return f.unionByName(s, allowMissingColumns=True).withColumn("frame_id", F.last("frame_id", ignorenulls=True).over(later)).where("side = 1 and frame_id is not null").select("s.*", "frame_id")


def guess_sources(frames: DataFrame, imu: DataFrame, odom: DataFrame, by: str, tolerance_s: float, use_imu: bool = True, use_odom: bool = True) -> DataFrame:
    """frames with `source`, what a scan's initial guess comes from: `imu` if the robot uses one and has a sample within the tolerance before the scan, else
    `odom` likewise, else `velocity` (the two scans before)."""
    out = frames.withColumn("source", F.lit("velocity"))
    for wanted, samples, name in ((use_odom, odom, "odom"), (use_imu, imu, "imu")):  # the last one holds
        if wanted:
            near = asof_backward(out, samples, by, tolerance_s, {"_sample": "event_id"})
            out = near.withColumn("source", F.when(F.col("_sample").isNotNull(), name).otherwise(F.col("source"))).drop("_sample", "matched_at")
    return out


def topic_scan(messages: DataFrame, topics: list[str], begin_s: float = 0.0, duration_s: float = -1.0) -> DataFrame:
    """Messages of the topics from begin_s after the first message on, for duration_s (to the end if negative)."""
    start = messages.agg(F.min("stamp").alias("t0"))
    t, t0 = micros("stamp"), micros("t0")
    inside = t >= t0 + int(begin_s * 1e6)
    if duration_s >= 0:
        inside = inside & (t <= t0 + int((begin_s + duration_s) * 1e6))
    return messages.where(F.col("topic").isin(topics)).join(F.broadcast(start), F.lit(True)).where(inside).drop("t0")


def asof_last(left: DataFrame, right: DataFrame, by: str, columns: dict[str, str], tie: str = "event_id", bucket_s: float = 86400) -> DataFrame:
    """Adds for each left row the columns of the latest right row at or before it, however old. Equal stamps: the largest tie.

    Rows are dealt by (key, bucket) of time, each to one; what earlier buckets carry over comes from one row per bucket.
    """
    width = int(bucket_s * 1e6)
    l = left.select(F.struct(*left.columns).alias("l"), F.col(by).alias("key"), micros("stamp").alias("t"), F.lit(None).cast("long").alias("tie"), F.lit(1).alias("side"))
    r = right.where(F.col(by).isNotNull() & F.col("stamp").isNotNull()).select(
        F.struct(micros("stamp").alias("at"), *[F.col(c).alias(n) for n, c in columns.items()]).alias("r"), F.col(by).alias("key"), micros("stamp").alias("t"), F.col(tie).cast("long").alias("tie"), F.lit(0).alias("side"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("t") / width))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    newest = both.groupBy("key", "bucket").agg(F.max_by("r", F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("r"))
    carried = newest.select("key", "bucket", F.last("r", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    upto = Window.partitionBy("key", "bucket").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("m", F.last("r", ignorenulls=True).over(upto)).where("side = 1").join(carried, ["key", "bucket"], "left").withColumn("m", F.coalesce("m", "carried"))
    return found.select("l.*", *[F.col(f"m.{n}").alias(n) for n in columns], F.col("m.at").alias("matched_at"))


def gps_to_frames(frames: DataFrame, fixes: DataFrame, by: str, unit: str = "second") -> DataFrame:
    """Last fix received for each frame, however old, with status 1 if it is of the same whole unit of time."""
    out = asof_last(frames, fixes, by, {"easting": "easting", "northing": "northing", "fix_stamp": "stamp"})
    same = F.date_trunc(unit, "stamp") == F.date_trunc(unit, "fix_stamp")
    return out.withColumn("status", F.coalesce(same.cast("int"), F.lit(0)))


def merge_trajectory(trajectory: DataFrame, submaps: DataFrame, by: str, tolerance_s: float = 1.0) -> DataFrame:
    """One-to-one match in time order: each trajectory row takes the first submap not more than the tolerance before it,
    if that is within the tolerance; each submap keeps its first row."""
    shifted = trajectory.withColumn("stamp", F.col("stamp") - F.expr(f"interval {int(tolerance_s)} seconds"))
    found = asof_forward(shifted, submaps, by, 2 * tolerance_s, {"kf_id": "kf_id"}, tie="kf_id").where("kf_id is not null")
    first = Window.partitionBy(by, "kf_id").orderBy("stamp", "event_id")
    back = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "matched_at")
    return back.withColumn("stamp", F.col("stamp") + F.expr(f"interval {int(tolerance_s)} seconds"))
