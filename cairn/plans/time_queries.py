"""Queries on time: scans, as-of joins, intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import temporal as T

from .views import gps, imu, keyframes, messages, odom, r6, scan_frames, tf, with_views


def topic_time_scan(spark, d):
    return T.topic_scan(messages(spark, d), ["click", "view"], 3600, 5 * 86400).select("event_id", "stamp", "robot_id", "topic", "value")


def demux_topics(spark, d):
    m = messages(spark, d)
    order = F.struct("stamp", "event_id")
    return m.groupBy("topic").agg(F.count("*").alias("n"), F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"))


def asof_nav(spark, d):
    """Latest odometry within a day before each scan, and before the previous scan."""
    by = Window.partitionBy("robot_id").orderBy("frame_id")
    out = T.asof_backward(scan_frames(spark, d), odom(spark, d), "robot_id", 86400, {"odom_id": "event_id", "vx": "vx"})
    out = out.withColumns({"before_id": F.lag("odom_id").over(by), "before_vx": F.lag("vx").over(by)})
    return out.select("robot_id", "frame_id", "odom_id", r6("vx").alias("vx"), "before_id", r6("before_vx").alias("before_vx"))


def asof_tolerance(spark, d):
    """Scans with odometry within two hours before; others are skipped."""
    out = T.asof_backward(scan_frames(spark, d), odom(spark, d), "robot_id", 7200, {"odom_id": "event_id"})
    return out.where("odom_id is not null").select("robot_id", "frame_id", "odom_id")


def scan_guess_source(spark, d):
    """Which sensor each scan's initial guess comes from: samples of twelve hours before count."""
    return T.guess_sources(scan_frames(spark, d), imu(spark, d), odom(spark, d), "robot_id", 12 * 3600).select("robot_id", "frame_id", "source")


def gps_same_hour(spark, d):
    out = T.gps_to_frames(scan_frames(spark, d), gps(spark, d), "robot_id", "hour")
    return out.select("robot_id", "frame_id", r6("easting").alias("easting"), r6("northing").alias("northing"), "status")


def gps_same_second(spark, d):
    out = T.gps_to_frames(scan_frames(spark, d), gps(spark, d), "robot_id", "second")
    return out.select("robot_id", "frame_id", r6("easting").alias("easting"), "status")


def imu_interval_collect(spark, d):
    s = T.samples_between(scan_frames(spark, d), imu(spark, d), "robot_id")
    order = F.struct("stamp", "event_id")
    return s.groupBy("robot_id", "frame_id").agg(F.count("*").alias("n"), F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"), r6(F.sum("ax")).alias("ax"))


def odom_interval_slice(spark, d):
    s = T.samples_between(scan_frames(spark, d), odom(spark, d), "robot_id", delay_s=300)
    return s.select("robot_id", "frame_id", "event_id", r6("vx").alias("vx"))


def tf_align(spark, d):
    out = T.asof_backward(scan_frames(spark, d), tf(spark, d), "robot_id", 12 * 3600, {"tx": "tx", "ty": "ty"}).where("tx is not null")
    return out.select("robot_id", "frame_id", r6(F.col("x") + F.col("tx")).alias("x"), r6(F.col("y") + F.col("ty")).alias("y"))


def sync3_nearest(spark, d):
    a = T.asof_nearest(scan_frames(spark, d), gps(spark, d), "robot_id", 43200, {"gps_id": "event_id"}).drop("matched_at")
    b = T.asof_nearest(a, imu(spark, d), "robot_id", 43200, {"imu_id": "event_id"})
    return b.where("gps_id is not null and imu_id is not null").select("robot_id", "frame_id", "gps_id", "imu_id")


def traj_submap_merge(spark, d):
    submaps = keyframes(spark, d).where("kf_id % 3 = 0")
    return T.merge_trajectory(odom(spark, d), submaps, "robot_id", 7200).select("robot_id", "kf_id", "event_id")


QUERIES = {f.__name__: f for f in (topic_time_scan, demux_topics, asof_nav, asof_tolerance, scan_guess_source, gps_same_hour, gps_same_second, imu_interval_collect, odom_interval_slice, tf_align, sync3_nearest, traj_submap_merge)}

_BACK = "ASOF LEFT JOIN {r} r ON l.robot_id = r.robot_id AND l.stamp >= r.stamp"
_NEXT = "SELECT s.*, f.frame_id FROM (SELECT *, stamp + INTERVAL {delay} SECOND AS t FROM {s}) s ASOF JOIN scan_frames f ON s.robot_id = f.robot_id AND s.t < f.stamp"


def _nearest(right: str, name: str) -> str:
    return f"""SELECT l.*, CASE WHEN b_at IS NOT NULL AND (f.stamp IS NULL OR f.stamp - l.stamp > INTERVAL 12 HOUR OR l.stamp - b_at <= f.stamp - l.stamp) THEN b_id
      WHEN f.stamp - l.stamp <= INTERVAL 12 HOUR THEN f.event_id END AS {name}
    FROM (SELECT l.*, CASE WHEN l.stamp - r.stamp <= INTERVAL 12 HOUR THEN r.stamp END AS b_at, CASE WHEN l.stamp - r.stamp <= INTERVAL 12 HOUR THEN r.event_id END AS b_id
          FROM synced l {_BACK.format(r=right)}) l
    ASOF LEFT JOIN {right} f ON l.robot_id = f.robot_id AND l.stamp <= f.stamp"""


SQL = {
    "topic_time_scan": with_views("""SELECT event_id, stamp, robot_id, topic, value FROM messages, (SELECT min(stamp) AS t0 FROM messages)
  WHERE topic IN ('click', 'view') AND stamp >= t0 + INTERVAL 1 HOUR AND stamp <= t0 + INTERVAL 121 HOUR"""),
    "demux_topics": with_views("SELECT topic, count(*) AS n, min_by(event_id, (stamp, event_id)) AS first_id, max_by(event_id, (stamp, event_id)) AS last_id FROM messages GROUP BY 1"),
    "asof_nav": with_views(f""", found AS (SELECT l.robot_id, frame_id, CASE WHEN l.stamp - r.stamp <= INTERVAL 1 DAY THEN r.event_id END AS odom_id,
  CASE WHEN l.stamp - r.stamp <= INTERVAL 1 DAY THEN round(vx, 6) + 0.0 END AS vx FROM scan_frames l {_BACK.format(r='odom')})
SELECT *, lag(odom_id) OVER w AS before_id, lag(vx) OVER w AS before_vx FROM found WINDOW w AS (PARTITION BY robot_id ORDER BY frame_id)"""),
    "scan_guess_source": with_views("""SELECT f.robot_id, f.frame_id, CASE WHEN f.stamp - i.stamp <= INTERVAL 12 HOUR THEN 'imu' WHEN f.stamp - o.stamp <= INTERVAL 12 HOUR THEN 'odom' ELSE 'velocity' END AS source
  FROM scan_frames f ASOF LEFT JOIN imu i ON i.robot_id = f.robot_id AND i.stamp <= f.stamp ASOF LEFT JOIN odom o ON o.robot_id = f.robot_id AND o.stamp <= f.stamp"""),
    "asof_tolerance": with_views(f"SELECT l.robot_id, frame_id, r.event_id AS odom_id FROM scan_frames l {_BACK.format(r='odom')} WHERE l.stamp - r.stamp <= INTERVAL 2 HOUR"),
    "gps_same_hour": with_views(f"""SELECT l.robot_id, frame_id, round(easting, 6) + 0.0 AS easting, round(northing, 6) + 0.0 AS northing,
  CASE WHEN date_trunc('hour', l.stamp) = date_trunc('hour', r.stamp) THEN 1 ELSE 0 END AS status FROM scan_frames l {_BACK.format(r='gps')}"""),
    "gps_same_second": with_views(f"""SELECT l.robot_id, frame_id, round(easting, 6) + 0.0 AS easting,
  CASE WHEN date_trunc('second', l.stamp) = date_trunc('second', r.stamp) THEN 1 ELSE 0 END AS status FROM scan_frames l {_BACK.format(r='gps')}"""),
    "imu_interval_collect": with_views(f"""SELECT robot_id, frame_id, count(*) AS n, min_by(event_id, (stamp, event_id)) AS first_id, max_by(event_id, (stamp, event_id)) AS last_id, round(sum(ax), 6) + 0.0 AS ax
  FROM ({_NEXT.format(s='imu', delay=0)}) GROUP BY 1, 2"""),
    "odom_interval_slice": with_views(f"SELECT robot_id, frame_id, event_id, round(vx, 6) + 0.0 AS vx FROM ({_NEXT.format(s='odom', delay=300)})"),
    "tf_align": with_views(f"SELECT l.robot_id, frame_id, round(x + tx, 6) + 0.0 AS x, round(y + ty, 6) + 0.0 AS y FROM scan_frames l {_BACK.format(r='tf')} WHERE l.stamp - r.stamp <= INTERVAL 12 HOUR"),
    "sync3_nearest": with_views(f""", g AS (WITH synced AS (FROM scan_frames) {_nearest('gps', 'gps_id')}), i AS (WITH synced AS (FROM scan_frames) {_nearest('imu', 'imu_id')})
SELECT g.robot_id, g.frame_id, gps_id, imu_id FROM g JOIN i ON g.robot_id = i.robot_id AND g.frame_id = i.frame_id WHERE gps_id IS NOT NULL AND imu_id IS NOT NULL"""),
    "traj_submap_merge": with_views(""", m AS (
  SELECT l.robot_id, r.kf_id, l.event_id, row_number() OVER (PARTITION BY l.robot_id, r.kf_id ORDER BY l.stamp, l.event_id) AS n
  FROM (SELECT *, stamp - INTERVAL 2 HOUR AS t FROM odom) l ASOF JOIN (FROM keyframes WHERE kf_id % 3 = 0) r ON l.robot_id = r.robot_id AND l.t <= r.stamp
  WHERE r.stamp - l.t <= INTERVAL 4 HOUR)
SELECT robot_id, kf_id, event_id FROM m WHERE n = 1"""),
}
