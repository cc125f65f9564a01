"""Recorded data sets as frame tables: lists of pictures, recordings with a manifest, and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof_nearest
from ..operators.pairing import one_to_one
from ..operators.sampling import numbered
from .io import strided, timestamp_text

FRAME = "frame long, t double, rgb string, depth string, pose array<double>, depth_scale double, error string"
#: Depth units in a metre of each layout.
LIST_SCALE, RECORDING_SCALE = 5000.0, 1000.0


def listed_frames(spark: SparkSession, path: str, tolerance: float = 0.02, stride: int = 1, offset: int = 0, limit: int | None = None) -> DataFrame:
    """FRAME rows of a folder with rgb.txt, depth.txt and groundtruth.txt (time, then fields).

    Pictures pair one to one, nearest first, within tolerance; pose is the
    nearest reference (x, y, z and a quaternion) within it, or null. A line
    whose time or fields don't parse is a row with error and without a number.
    """
    def lines(name: str, fields: int) -> DataFrame:
        got = timestamp_text(spark, f"{path}/{name}").withColumn("file", F.lit(name))
        return got.withColumn("error", F.when(F.col("t").isNull() | (F.size("fields") < fields), F.concat(F.lit("broken line in "), F.col("file"))))

    rgb, depth, truth = (lines(n, k) for n, k in (("rgb.txt", 1), ("depth.txt", 1), ("groundtruth.txt", 7)))
    sides = [numbered(x.where("error is null").select("t", F.col("fields")[0].alias("name")), ["t", "name"], "id").withColumn("key", F.lit(0)) for x in (rgb, depth)]
    pairs = one_to_one(*(s.select("key", "id", "t") for s in sides), tolerance, "key", "greedy")
    named = pairs.join(sides[0].select(F.col("id").alias("a_id"), F.col("name").alias("rgb")), "a_id").join(sides[1].select(F.col("id").alias("b_id"), F.col("name").alias("depth")), "b_id")
    poses = truth.where("error is null").select("t", F.transform(F.slice("fields", 1, 7), lambda x: x.try_cast("double")).alias("pose")).where("forall(pose, x -> x is not null)")
    met = asof_nearest(named.select(F.col("a_t").alias("t"), "rgb", "depth"), poses, tolerance, how="left")
    frames = numbered(met, ["t", "rgb"], "n").select((F.col("n") - 1).alias("frame"), "t", "rgb", "depth", F.col("ref_pose").alias("pose"), F.lit(LIST_SCALE).alias("depth_scale"), F.lit(None).cast("string").alias("error"))
    broken = rgb.unionByName(depth).unionByName(truth).where("error is not null").select("error")
    return strided(frames, "frame", stride, offset, limit).unionByName(broken, allowMissingColumns=True)


def recorded_frames(spark: SparkSession, path: str, stride: int = 1, offset: int = 0, limit: int | None = None) -> DataFrame:
    """FRAME rows of recordings (folders with manifest.json); a frame without its time or a picture is a row with error."""
    frame = "struct<timestamp_s double, rgb string, depth string, reference_pose array<array<double>>>"
    said = spark.read.schema(f"frames array<{frame}>").option("multiLine", True).json(f"{path}/manifest.json")
    rows = said.select(F.posexplode("frames").alias("frame", "f"))
    error = F.when(F.col("f.timestamp_s").isNull() | F.col("f.rgb").isNull() | F.col("f.depth").isNull(), "frame without time or pictures")
    out = rows.select(F.col("frame").cast("long"), F.col("f.timestamp_s").alias("t"), F.col("f.rgb").alias("rgb"), F.col("f.depth").alias("depth"), F.flatten("f.reference_pose").alias("pose"), F.lit(RECORDING_SCALE).alias("depth_scale"), error.alias("error"))
    return strided(out, "frame", stride, offset, limit)


def trajectory(spark: SparkSession, path: str, fps: float = 30.0) -> DataFrame:
    """(frame, t, pose, error) of trajectory logs: for each frame a line of numbers and four rows of a pose. A pose of other than 16 numbers is an error row."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\r?\n")).alias("line", "said"))
    rows = lines.where("line % 5 > 0").select(F.floor(F.col("line") / 5).alias("frame"), "line", F.transform(F.split(F.trim("said"), r"\s+"), lambda x: x.try_cast("double")).alias("row"))
    poses = rows.groupBy("frame").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"])).alias("pose"))
    whole = (F.size("pose") == 16) & F.forall("pose", lambda x: x.isNotNull())
    return poses.select("frame", (F.col("frame") / fps).alias("t"), F.when(whole, F.col("pose")).alias("pose"), F.when(~whole, "broken pose").alias("error"))
