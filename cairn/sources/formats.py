"""Readers and writers of the map, trajectory and pose formats.

XML is read with explicit schemas: inference would turn a single neighbour into a struct and an
empty list into a list of null.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.operators import graph
from cairn.operators.groups import whole_groups

from .shared import plain_path

NODE_SCHEMA = "id long, inMap boolean, neighbour_list struct<neighbour: array<struct<id: long, transform: string, reachable: boolean>>>"
GPS_FIELDS = "timestamp double, northing double, easting double, altitude double, latitude double, longitude double, roll double, pitch double, yaw double"
FRAMES_SCHEMA = (
    "keyframe_id long, keyframe_frame_id long, neighbor_frame_list struct<neighbour_frame: array<struct<id: long, time: double, transform: string, "
    "gps: struct<timestamp: double, northing: double, easting: double, altitude: double, latitude: double, longitude: double, roll: double, pitch: double, yaw: double, satellites_used: int, status: int>>>>"
)
TUM_SCHEMA = "time double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


#: What Spark calls a file that isn't the XML it should be.
MALFORMED = ("MALFORMED_RECORD", "MALFORMED_XML", "XMLStreamException", "Malformed")


def write_topology(edges: DataFrame, nodes: DataFrame, path: str, force_reachable: bool = False, in_map: bool | None = True) -> None:
    """nodes(id), edges(src, dst, pose array<double>, reachable) as <map><node>..., a node without edges with an empty list.
    Maps for driving have all edges reachable; the others keep what holds. in_map: the nodes' mark; None leaves it out, as for new ones."""
    if force_reachable:
        edges = edges.withColumn("reachable", F.lit(True))
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("id"), P.pack(F.col("pose")).alias("transform"), "reachable"))).alias("neighbour"))
    rows = nodes.select("id").join(lists, "id", "left").select("id", F.lit(in_map).cast("boolean").alias("inMap"), F.struct(F.coalesce("neighbour", F.array().cast("array<struct<id: bigint, transform: string, reachable: boolean>>")).alias("neighbour")).alias("neighbour_list"))
    rows.write.format("xml").option("rootTag", "map").option("rowTag", "node").mode("overwrite").save(path)


def read_topology(spark: SparkSession, path: str, force_reachable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, in_map), edges(src, dst, pose, reachable))."""
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(path)
    nodes = rows.select("id", F.coalesce("inMap", F.lit(False)).alias("in_map"))
    links = rows.select(F.col("id").alias("src"), F.explode("neighbour_list.neighbour").alias("n")).where("n.id is not null")
    reachable = F.lit(True) if force_reachable else F.coalesce("n.reachable", F.lit(False))
    return nodes, links.select("src", F.col("n.id").alias("dst"), P.unpack(F.col("n.transform")).alias("pose"), reachable.alias("reachable"))


def write_closed_map(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """The topology of one map, nodes(id, pose), with its first and last node joined where they end a path, all edges reachable."""
    one = lambda df: df.withColumn("robot_id", F.lit(0).cast("long"))
    closed = graph.close_circle(one(edges).select("robot_id", "src", "dst", "pose", "reachable"), one(nodes).select("robot_id", F.col("id").alias("node"), "pose"))
    write_topology(closed, nodes, path, force_reachable=True)


def write_circle_map(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """The topology of one map whose first node is its origin, with first and last node joined where they end a path; edges stay as reachable as they are."""
    one = lambda df: df.withColumn("robot_id", F.lit(0).cast("long"))
    closed = graph.close_circle(one(edges).select("robot_id", "src", "dst", "pose", "reachable"), one(nodes).select("robot_id", F.col("id").alias("node"), "pose"), from_origin=True)
    write_topology(closed, nodes, path)


def topology_or_none(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """read_topology, or None if the file is no well-formed map. One pass reads it all; errors that aren't about its form are raised."""
    rows = spark.read.format("xml").option("rowTag", "node").option("mode", "FAILFAST").schema(NODE_SCHEMA).load(path)
    try:
        seen = rows.agg(F.count("*").alias("n"), F.count("id").alias("named"), F.sum(F.size("neighbour_list.neighbour"))).first()
    except Exception as error:
        if not any(word in str(error) for word in MALFORMED):
            raise
        return None
    return read_topology(spark, path) if seen.n and seen.n == seen.named else None


def read_map(spark: SparkSession, topology: str, poses: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, in_map, pose), edges): nodes in the order of their ids take their pose from the first neighbour read before; the
    others from their file of `poses` (see write_poses). A map's points are read by id as they are needed (read_points)."""
    nodes, edges = read_topology(spark, topology)
    one = lambda df: df.withColumn("robot_id", F.lit(0).cast("long"))
    own = nodes.join(read_node_poses(spark, poses), "id", "left").select(F.col("id").alias("node"), "pose")
    placed = graph.pose_by_scan(one(edges), one(own)).select(F.col("node").alias("id"), "pose")
    return nodes.join(placed, "id", "left"), edges


def read_map_poses(spark: SparkSession, topology: str, poses: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, in_map, pose), edges) with the poses of the files alone; null where a node has none."""
    nodes, edges = read_topology(spark, topology)
    return nodes.join(read_node_poses(spark, poses), "id", "left"), edges


def read_sessions(spark: SparkSession, topology: str, fixed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known(id, pose), new(id), edges): nodes that were in the map are posed from the fixed node over edges between them; those
    without the mark are new, and their points are still to be loaded."""
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(topology)
    _, edges = read_topology(spark, topology)
    known, new = rows.where("inMap is not null").select("id"), rows.where("inMap is null").select("id")
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(known.select(F.col("id").alias(end)), end, "left_semi")
    one = lambda df: df.withColumn("robot_id", F.lit(0).cast("long"))
    posed = graph.link_nodes(one(inside), one(known.select(F.col("id").alias("node"))), fixed)
    return posed.select(F.col("node").alias("id"), "pose"), new, edges


def write_frames(frames: DataFrame, path: str) -> None:
    """frames(keyframe_id, keyframe_frame_id, id, time, pose, gps struct) nested by keyframe."""
    groups = frames.groupBy("keyframe_id", "keyframe_frame_id").agg(F.sort_array(F.collect_list(F.struct("id", "time", P.pack(F.col("pose")).alias("transform"), "gps"))).alias("f"))
    groups.select("keyframe_id", "keyframe_frame_id", F.struct(F.col("f").alias("neighbour_frame")).alias("neighbor_frame_list")).write.format("xml").option("rootTag", "map").option("rowTag", "keyframes").mode("overwrite").save(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame: (keyframe_id, keyframe_frame_id, id, time, pose, gps)."""
    rows = spark.read.format("xml").option("rowTag", "keyframes").schema(FRAMES_SCHEMA).load(path)
    f = rows.select("keyframe_id", "keyframe_frame_id", F.explode("neighbor_frame_list.neighbour_frame").alias("f")).where("f.id is not null")
    return f.select("keyframe_id", "keyframe_frame_id", "f.id", "f.time", P.unpack(F.col("f.transform")).alias("pose"), "f.gps")


def read_node_gps(spark: SparkSession, path: str) -> DataFrame:
    """gps.xml of each node's folder: (node, fields of the fix); the node's id is the folder's name."""
    fixes = _texts(spark, path).select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<gps(?:\s[^>]*)?>.*?</gps>"), F.lit(0))).alias("fix"))
    rows = fixes.select(_folder_id(F.col("file")).alias("node"), F.from_xml("fix", GPS_FIELDS + ", status struct<status: int, satellites_used: int>").alias("g"))
    return rows.select("node", *[f"g.{f.split()[0]}" for f in GPS_FIELDS.split(", ")], "g.status.status", "g.status.satellites_used")


def _write_folders(rows: DataFrame, path: str, head: str = "", tail: str = "") -> None:
    """rows(id, value): a text in a folder for each id, with head and tail about it. All tasks make files, however few bytes they have. Where tasks can open the path they
    make them by themselves: Hadoop's local file system starts a process for each file and folder whose rights it sets."""
    spark = rows.sparkSession
    spread = rows.repartition(4 * spark.sparkContext.defaultParallelism, "id")
    folder = plain_path(path)
    if folder is None:  # each task moves its own files to their place; by the other way of committing the driver would move every file
        texts = spread.groupBy("id").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit(f"\n{tail}" if tail else "")).alias("value"))
        texts.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("id").mode("overwrite").text(path)
        return
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        for frame in whole_groups(batches, ["id"]):
            for key, values in frame.groupby("id", sort=False)["value"]:
                at, made = f"{folder}/id={key}", f".{uuid.uuid4().hex}"
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/{made}", "w", encoding="utf-8", newline="") as file:
                    file.write(head + "\n".join(values) + "\n" + tail)
                os.replace(f"{at}/{made}", f"{at}/{name}")  # the same, whole, whichever attempt comes last
            yield pd.DataFrame({"n": [len(frame)]})

    named = spread.select(F.coalesce(F.col("id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("id"), "value")
    os.makedirs(folder, exist_ok=True)
    named.sortWithinPartitions("id", "value").mapInPandas(write, "n long").agg(F.sum("n")).first()


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of all files below a folder, whole. Where tasks can open it, they list it too, each what is its own: else the driver holds a list of all files."""
    folder = plain_path(path)
    if folder is None or not os.path.isdir(folder):
        return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    tasks = 4 * spark.sparkContext.defaultParallelism
    seen = lambda name: not name.startswith(("_", "."))

    def below(at: str) -> Iterator[str]:
        for where, inner, files in os.walk(at):
            inner[:] = filter(seen, inner)
            yield from (f"{where}/{name}" for name in filter(seen, files))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for rows in batches for p in rows["id"]):
            out = []
            with os.scandir(folder) as top:
                own = [e for e in top if seen(e.name) and zlib.crc32(e.name.encode()) % tasks == part]
            for file in (f for e in own for f in (below(e.path) if e.is_dir() else [e.path])):
                with open(file, encoding="utf-8", errors="replace") as text:
                    out.append((file, text.read()))
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=["file", "value"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["file", "value"])

    return spark.range(0, tasks, 1, tasks).mapInPandas(read, "file string, value string")


def _folder_id(file):
    return F.regexp_extract(file, r"/(?:id=)?(\d+)/[^/]*$", 1).cast("long")


def write_node_gps(fixes: DataFrame, path: str) -> None:
    """fixes(id, fields of the fix, status, satellites_used): a gps.xml in a folder for each id."""
    fields = [f.split()[0] for f in GPS_FIELDS.split(", ")]
    fix = F.struct(*fields, F.struct("status", "satellites_used").alias("status"))
    _write_folders(fixes.select("id", F.to_xml(fix, {"rowTag": "gps"}).alias("value")), path, "<root>\n", "</root>\n")


def read_node_poses(spark: SparkSession, path: str) -> DataFrame:
    """(id, pose) of the text matrices in each id's folder."""
    return _matrices(_texts(spark, path)).select(_folder_id(F.col("file")).alias("id"), "pose")


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    """4 x 4 or 3 x 4 text matrices: (file, pose), the last row filled in where it lacks."""
    return _matrices(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def _matrices(texts: DataFrame) -> DataFrame:
    rows = texts.select("file", F.transform(F.filter(F.split("value", r"\s+"), lambda v: v != ""), lambda v: v.cast("double")).alias("c"))
    bottom = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return rows.select("file", F.when(F.size("c") == 16, F.col("c")).when(F.size("c") == 12, F.concat("c", bottom)).alias("pose"))


def write_poses(nodes: DataFrame, path: str, offset: int = 0) -> None:
    """nodes(id, pose): a text matrix in a folder for each id; ids go up by the offset, as when a second session joins a map."""
    nodes = nodes.withColumn("id", F.col("id") + offset)
    line = lambda r: F.concat_ws(" ", *[F.col("pose")[4 * r + c].cast("string") for c in range(4)])
    _write_folders(nodes.select("id", F.concat_ws("\n", *[line(r) for r in range(4)]).alias("value")), path)


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory text, with the quaternion's real part last: (time, pose)."""
    q = spark.read.csv(path, sep=" ", schema=TUM_SCHEMA)
    return q.select("time", P.from_quaternion(*[F.col(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]).alias("pose"))


def write_tum(rows: DataFrame, path: str) -> None:
    """rows(time, pose), in time order."""
    q = P.to_quaternion(F.col("pose"))
    rows.orderBy("time").select("time", *[F.col("pose")[i].alias(n) for i, n in ((3, "tx"), (7, "ty"), (11, "tz"))], *[q[n].alias(f"q{n}") for n in "xyzw"]).write.mode("overwrite").csv(path, sep=" ")


GPS_LINE = "time double, longitude double, latitude double, altitude double, roll double, pitch double, yaw double, satellites_used int"


def write_gps_trajectory(rows: DataFrame, path: str) -> None:
    """rows(time, gps struct), in time order: `time lon lat alt roll pitch yaw satellites`; rows without a fix are left out."""
    names = [f.split()[0] for f in GPS_LINE.split(", ")][1:]
    rows.where("gps is not null").orderBy("time").select("time", *[F.col(f"gps.{n}").alias(n) for n in names]).write.mode("overwrite").csv(path, sep=" ")


def read_gps_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=GPS_LINE)


STAMP_LINE = "time double, keyframe_id long"


def write_trajectories(nodes: DataFrame, frames: DataFrame, fixes: DataFrame, folder: str) -> None:
    """Three texts of a map's path: folder/trajectory (`time x y z qx qy qz qw`), folder/gps_trajectory and folder/keyframe_timestamp (`time id`).

    nodes(id, pose), frames(keyframe_id, id, time, pose in the keyframe's frame, gps), fixes(id, time, gps) of the keyframes. Each keyframe comes with the time
    of its fix, then its frames in order; keyframes without a fix and frames of absent keyframes are left out, and fixes that frames lack.
    """
    own = nodes.join(fixes, "id").select(F.col("id").alias("keyframe_id"), F.lit(-1).cast("long").alias("frame_id"), "time", "pose", "gps")
    at = nodes.join(fixes.select("id"), "id", "left_semi").select(F.col("id").alias("keyframe_id"), F.col("pose").alias("base"))
    inner = frames.join(at, "keyframe_id").select("keyframe_id", F.col("id").alias("frame_id"), "time", P.product(F.col("base"), F.col("pose")).alias("pose"), "gps")
    rows = own.unionByName(inner).orderBy("keyframe_id", "frame_id")
    write = lambda df, name: df.write.mode("overwrite").csv(f"{folder}/{name}", sep=" ")
    write(rows.select("time", *[c.alias(f"c{i}") for i, c in enumerate(_quaternion_text(F.col("pose")))]), "trajectory")
    write(rows.where("gps is not null").select("time", *[F.col(f"gps.{f.split()[0]}") for f in GPS_LINE.split(", ")[1:]]), "gps_trajectory")
    write(own.orderBy("keyframe_id").select("time", "keyframe_id"), "keyframe_timestamp")


def read_keyframe_stamps(spark: SparkSession, path: str) -> DataFrame:
    """(time, keyframe_id) of a keyframe_timestamp text."""
    return spark.read.csv(path, sep=" ", schema=STAMP_LINE)


def _quaternion_text(pose) -> list:
    """tx ty tz qx qy qz qw as columns."""
    q = P.to_quaternion(pose)
    return [*(pose[i] for i in (3, 7, 11)), *(q[n] for n in "xyzw")]


def dump_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A pose graph as text, one line for each vertex (id, pose) and edge (src, dst, pose): a snapshot before or after an optimization."""
    line = lambda head, pose: F.concat_ws(" ", *head, *[c.cast("string") for c in _quaternion_text(pose)]).alias("value")
    pose = F.col("pose")
    lines = nodes.select(line([F.lit("VERTEX_SE3:QUAT"), F.col("id").cast("string")], pose)).unionByName(
        edges.select(line([F.lit("EDGE_SE3:QUAT"), F.col("src").cast("string"), F.col("dst").cast("string")], pose)))
    lines.write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, pose), edges(src, dst, pose)) of a dumped pose graph."""
    cells = spark.read.text(path).select(F.split("value", " ").alias("c"))

    def pose(at: int):
        v = [F.col("c")[at + i].cast("double") for i in range(7)]
        return P.from_quaternion(v[6], v[3], v[4], v[5], v[0], v[1], v[2]).alias("pose")

    number = lambda i: F.col("c")[i].cast("long")
    vertices, links = cells.where("c[0] = 'VERTEX_SE3:QUAT'"), cells.where("c[0] = 'EDGE_SE3:QUAT'")
    return vertices.select(number(1).alias("id"), pose(2)), links.select(number(1).alias("src"), number(2).alias("dst"), pose(3))


def write_whole_map(points: DataFrame, path: str) -> None:
    """A whole map as one table, with its points near each other in space in the same files."""
    points.repartitionByRange(F.floor(F.col("x") / 50), F.floor(F.col("y") / 50)).write.mode("overwrite").parquet(path)


def write_points(points: DataFrame, path: str) -> None:
    """Submaps as Parquet, a folder for each cloud_id."""
    points.write.partitionBy("cloud_id").mode("overwrite").parquet(path)


def read_points(spark: SparkSession, path: str, clouds: list[int] | None = None) -> DataFrame:
    """Submaps by id: only their folders are read."""
    rows = spark.read.parquet(path)
    return rows if clouds is None else rows.where(F.col("cloud_id").isin(clouds))


def parse_chain(text: str) -> list[tuple[str, dict]]:
    """A filter chain's configuration: `- Name`, or `- Name:` with indented `key: value` lines; # starts a comment."""
    chain: list[tuple[str, dict]] = []
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip()
        if not line.strip():
            continue
        item = line.strip()
        if item.startswith("- "):
            chain.append((item[2:].rstrip(":").strip(), {}))
        elif chain and ":" in item:
            key, value = (s.strip() for s in item.split(":", 1))
            chain[-1][1][key] = float(value) if value.replace(".", "").replace("-", "").isdigit() else value
        else:
            raise ValueError(f"not a filter chain: {raw!r}")
    return chain


def parse_sections(text: str) -> dict[str, list[tuple[str, dict]]]:
    """A registration's configuration: sections at the margin, each with a list of parts, or one part, with or without parameters."""
    sections: dict[str, list[str]] = {}
    name = None
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip()
        if not line.strip():
            continue
        if not line[0].isspace():
            name = line.rstrip(":").strip()
            sections[name] = []
        elif name is None:
            raise ValueError(f"not in a section: {raw!r}")
        else:
            sections[name].append(line)
    out = {}
    for name, lines in sections.items():
        if lines and not lines[0].strip().startswith("- "):  # a part without a dash: the least indented line
            lines = ["- " + lines[0].strip(), *lines[1:]]
        out[name] = parse_chain("\n".join(lines))
    return out
