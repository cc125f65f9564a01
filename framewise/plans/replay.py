"""A recorded session rebuilt from its raw streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, pairing, sequence


def replay(colours: DataFrame, depths: DataFrame, samples: DataFrame, modes: DataFrame, segment: str, tolerance: float, fresh: float, chunk: float, gap: float = 0.25, tau: float = 0.12, default: str = "auto") -> DataFrame:
    """One row a pair of pictures: segment, a_id, b_id, sample, valid, up_x, up_y, up_z and mode.

    colours and depths hold (segment, id, t), samples also ax, ay and az,
    modes (segment, t, mode). Pictures pair one to one; a pair takes the
    gravity of the sample nearest to its depth (null beyond `fresh`) and the
    last mode set before the later of its pictures. Ids are unique over all
    segments. All joins are by segment
    and time, in pieces of a segment.
    """
    pairs = pairing.one_to_one(colours, depths, tolerance, segment).withColumn("_late", F.greatest("a_t", "b_t"))
    pairs = pairs.join(depths.select(segment, F.col("id").alias("b_id")), "b_id")
    gravity = sequence.gravity_filter(samples, segment, gap=gap, tau=tau).select(segment, "id", "valid", "up_x", "up_y", "up_z")
    felt = samples.select(segment, "id", "t").join(gravity, [segment, "id"])
    near = asof.asof_nearest(pairs.withColumn("t", F.col("b_t")), felt, fresh, (segment,), how="left")
    names = {c: F.col(f"ref_{c}") for c in ("valid", "up_x", "up_y", "up_z")}
    near = near.select(segment, "a_id", "b_id", F.col("_late").alias("t"), F.col("ref_id").alias("sample"), *(v.alias(n) for n, v in names.items()))
    held = asof.asof_backward(near, modes, (segment,), chunk, how="left")
    return held.select(segment, "a_id", "b_id", "sample", F.coalesce("valid", F.lit(False)).alias("valid"), "up_x", "up_y", "up_z", F.coalesce("ref_mode", F.lit(default)).alias("mode"))
