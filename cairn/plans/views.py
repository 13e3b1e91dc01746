"""Domain views over the given tables: the same definitions for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import pose as P


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> Column:
    """Rounded to six digits; the sum with 0.0 turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(7)]
    norm = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
    static = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + e[6]))
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"),
        (10 * e[0]).alias("x"), (10 * e[1]).alias("y"), (10 * e[2]).alias("z"),
        (e[3] / norm).alias("nx"), (e[4] / norm).alias("ny"), (e[5] / norm).alias("nz"),
        static.alias("p_static"), (1 - static).alias("p_dynamic"),
    )


def poses(spark: SparkSession) -> DataFrame:
    """Ten submap poses: yaw 0.1 * cloud_id, translation (5 * cloud_id, 0, 0)."""
    yaw = 0.1 * F.col("cloud_id")
    c, s = F.cos(yaw), F.sin(yaw)
    zero, one = F.lit(0.0), F.lit(1.0)
    cells = [c, -s, zero, 5.0 * F.col("cloud_id"), s, c, zero, zero, zero, zero, one, zero, zero, zero, zero, one]
    return spark.range(10).withColumnRenamed("id", "cloud_id").select("cloud_id", F.array(*cells).alias("pose"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("stamp"), F.col("user_id").alias("robot_id"), F.col("event_type").alias("topic"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def topic(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return messages(spark, sf_dir).where(F.col("topic") == name).drop("topic")


def scan_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("robot_id").orderBy("stamp", "event_id")
    return topic(spark, sf_dir, "click").select("robot_id", F.row_number().over(by).cast("long").alias("frame_id"), "stamp", (F.col("value") / 10).alias("x"), (F.col("k") / 10).alias("y"))


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic(spark, sf_dir, "view").select("robot_id", "event_id", "stamp", F.col("value").alias("easting"), F.col("k").cast("double").alias("northing"))


def odom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic(spark, sf_dir, "purchase").select("robot_id", "event_id", "stamp", (F.col("value") / 100).alias("vx"), ((F.col("k") - 50) / 100).alias("wz"))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic(spark, sf_dir, "signup").select("robot_id", "event_id", "stamp", (F.col("value") / 100).alias("ax"), ((F.col("k") - 50) / 1000).alias("gz"))


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic(spark, sf_dir, "error").select("robot_id", "event_id", "stamp", F.col("value").alias("tx"), F.col("k").cast("double").alias("ty"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_frames(spark, sf_dir).select("robot_id", (F.col("frame_id") - 1).alias("kf_id"), "stamp", "x", "y", ((F.col("y") - 5) * 0.6).alias("yaw"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes as nodes of a graph, turned by their yaw."""
    return keyframes(spark, sf_dir).select("robot_id", F.col("kf_id").alias("node"), P.from_yaw(F.col("yaw"), F.col("x"), F.col("y")).alias("pose"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions between consecutive keyframes, with rotations; only the forward one is reachable. Poses are columns of their own, so that who doesn't ask for them has them pruned."""
    by = Window.partitionBy("robot_id").orderBy("node")
    ahead = nodes(spark, sf_dir).select("robot_id", F.col("node").alias("src"), F.lead("node").over(by).alias("dst"), "pose", F.lead("pose").over(by).alias("next")).where("dst is not null")
    steps = ahead.select("robot_id", "src", "dst", P.relative(F.col("pose"), F.col("next")).alias("step"))
    both = steps.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    way = lambda forth, back: F.when(F.col("back"), back).otherwise(forth)
    return both.select("robot_id", way(F.col("src"), F.col("dst")).alias("src"), way(F.col("dst"), F.col("src")).alias("dst"), way(F.col("step"), P.inverse(F.col("step"))).alias("pose"), (~F.col("back")).alias("reachable"))


def planar(pose: Column = None) -> list[Column]:
    """x, y, c, s of a pose about the z axis, rounded."""
    pose = F.col("pose") if pose is None else pose
    return [r6(pose[i]).alias(n) for i, n in ((3, "x"), (7, "y"), (0, "c"), (4, "s"))]


def wgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (60 + (F.col("o_orderkey") % 900) / 10.0).alias("lon"), (1 + (F.col("o_custkey") % 540) / 10.0).alias("lat")
    )


SQL = """
points AS (
  SELECT CAST(label AS BIGINT) AS cloud_id, vec_id AS point_id,
         10 * embedding[1]::DOUBLE AS x, 10 * embedding[2]::DOUBLE AS y, 10 * embedding[3]::DOUBLE AS z,
         embedding[4]::DOUBLE / n AS nx, embedding[5]::DOUBLE / n AS ny, embedding[6]::DOUBLE / n AS nz,
         p_static, 1 - p_static AS p_dynamic
  FROM (SELECT *, sqrt(embedding[4]::DOUBLE * embedding[4]::DOUBLE + embedding[5]::DOUBLE * embedding[5]::DOUBLE + embedding[6]::DOUBLE * embedding[6]::DOUBLE) AS n,
               least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + embedding[7]::DOUBLE)) AS p_static FROM embeddings)
), poses AS (
  SELECT i AS cloud_id, cos(0.1::DOUBLE * i) AS c, sin(0.1::DOUBLE * i) AS s, 5.0::DOUBLE * i AS t FROM range(10) AS g(i)
), messages AS (
  SELECT event_id, ts AS stamp, user_id AS robot_id, event_type AS topic, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), scan_frames AS (
  SELECT robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY stamp, event_id) AS frame_id, stamp, value / 10 AS x, k / 10.0::DOUBLE AS y FROM messages WHERE topic = 'click'
), gps AS (
  SELECT robot_id, event_id, stamp, value AS easting, k::DOUBLE AS northing FROM messages WHERE topic = 'view'
), odom AS (
  SELECT robot_id, event_id, stamp, value / 100 AS vx, (k - 50) / 100.0::DOUBLE AS wz FROM messages WHERE topic = 'purchase'
), imu AS (
  SELECT robot_id, event_id, stamp, value / 100 AS ax, (k - 50) / 1000.0::DOUBLE AS gz FROM messages WHERE topic = 'signup'
), tf AS (
  SELECT robot_id, event_id, stamp, value AS tx, k::DOUBLE AS ty FROM messages WHERE topic = 'error'
), keyframes AS (
  SELECT robot_id, frame_id - 1 AS kf_id, stamp, x, y, (y - 5) * 0.6::DOUBLE AS yaw FROM scan_frames
), ends AS (
  SELECT a.robot_id, a.kf_id AS src, b.kf_id AS dst, b.kf_id > a.kf_id AS reachable FROM keyframes a JOIN keyframes b ON a.robot_id = b.robot_id AND abs(a.kf_id - b.kf_id) = 1
), edges AS (
  SELECT e.robot_id, src, dst, cos(a.yaw) * (b.x - a.x) + sin(a.yaw) * (b.y - a.y) AS x, cos(a.yaw) * (b.y - a.y) - sin(a.yaw) * (b.x - a.x) AS y, b.yaw - a.yaw AS yaw, reachable
  FROM ends e JOIN keyframes a ON a.robot_id = e.robot_id AND a.kf_id = src JOIN keyframes b ON b.robot_id = e.robot_id AND b.kf_id = dst
), wgs AS (
  SELECT o_orderkey AS id, 60 + (o_orderkey % 900) / 10.0::DOUBLE AS lon, 1 + (o_custkey % 540) / 10.0::DOUBLE AS lat FROM orders
)
"""


#: x, y, c, s of a relation that has x, y and yaw.
PLANAR_SQL = "round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(cos(yaw), 6) + 0.0 AS c, round(sin(yaw), 6) + 0.0 AS s"


def planar_relative(a: str, b: str) -> str:
    """x, y, yaw of b as a sees it."""
    return f"cos({a}.yaw) * ({b}.x - {a}.x) + sin({a}.yaw) * ({b}.y - {a}.y) AS x, cos({a}.yaw) * ({b}.y - {a}.y) - sin({a}.yaw) * ({b}.x - {a}.x) AS y, {b}.yaw - {a}.yaw AS yaw"


def planar_product(a: str, b: str) -> str:
    """x, y, yaw of b, given as a sees it, in a's own frame."""
    return f"{a}.x + cos({a}.yaw) * {b}.x - sin({a}.yaw) * {b}.y AS x, {a}.y + sin({a}.yaw) * {b}.x + cos({a}.yaw) * {b}.y AS y, {a}.yaw + {b}.yaw AS yaw"


def with_views(sql: str, recursive: bool = False) -> str:
    """The query's text behind the views; text that starts with a comma adds views of its own."""
    sql = sql.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{'' if sql.startswith(',') else chr(10)}{sql}"
