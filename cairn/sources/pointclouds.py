"""Point-cloud messages: fixed-width records in a binary field, with named fields at offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Numbers of the field types in such messages.
TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
MESSAGE = "cloud_id long, fields array<struct<name: string, offset: int, datatype: int>>, point_step int, data binary"


def decode_clouds(messages: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(cloud_id, nth, columns as double): a row for each record of messages(cloud_id, fields, point_step, data, first). A message without one
    of the columns gives nulls there; points with a coordinate that isn't a number are left out. Records are numbered from `first`, the
    number of the cloud's records in messages before, or from 0 if there is no such column."""
    if "first" not in messages.columns:
        messages = messages.withColumn("first", F.lit(0).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch.itertuples():
                at = {f["name"]: (f["offset"], TYPES[f["datatype"]]) for f in m.fields if f["datatype"] in TYPES}
                known = [c for c in columns if c in at]
                kind = np.dtype({"names": known, "formats": [at[c][1] for c in known], "offsets": [at[c][0] for c in known], "itemsize": m.point_step})
                records = np.frombuffer(m.data, kind, count=len(m.data) // m.point_step)
                out = pd.DataFrame({"cloud_id": m.cloud_id, "nth": m.first + np.arange(len(records)), **{c: records[c].astype(float) if c in known else None for c in columns}})
                yield out[np.isfinite(out[[c for c in "xyz" if c in known]].to_numpy(float)).all(axis=1)]

    return messages.select("cloud_id", "fields", "point_step", "data", "first").mapInPandas(run, "cloud_id long, nth long, " + ", ".join(f"{c} double" for c in columns))


def encode_clouds(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), most: int = 100_000) -> DataFrame:
    """Messages of points(cloud_id, point_id, columns), 4-byte floats in the order of point_id, at most `most` ids to a message; `first` counts the cloud's points in messages before."""
    part = F.floor(F.col("point_id") / most).alias("part")
    before = Window.partitionBy("cloud_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = points.groupBy("cloud_id", part).count().select(F.col("cloud_id").alias("_cloud"), F.col("part").alias("_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        data = np.ascontiguousarray(pdf[list(columns)].to_numpy("<f4")).tobytes()
        fields = [{"name": c, "offset": 4 * i, "datatype": 7} for i, c in enumerate(columns)]
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "fields": [fields], "point_step": [4 * len(columns)], "data": [data], "part": [pdf["part"].iloc[0]]})

    rows = points.select("cloud_id", "point_id", *columns, part)
    messages = rows.groupBy("cloud_id", "part").applyInPandas(run, MESSAGE + ", part long")
    return messages.join(sizes, F.col("cloud_id").eqNullSafe(F.col("_cloud")) & F.col("part").eqNullSafe(F.col("_part"))).drop("part", "_cloud", "_part")


def guess_source(use_imu: bool, use_odom: bool) -> str:
    """What a scan's initial guess comes from: inertial samples before wheels before constant velocity."""
    return "imu" if use_imu else "odom" if use_odom else "velocity"
