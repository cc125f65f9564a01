"""Small dense fits over distributed sums: rigid motions, planes, calibrations, observability.

Sums of products come from aggregations that combine before the shuffle; only
matrices of a few numbers per key are solved in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P, Q = ("px", "py", "pz"), ("qx", "qy", "qz")


def cross_sums(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Per key the sums that a rigid fit of points p to q needs."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w).alias("n")] + [F.sum(w * F.col(c)).alias(f"s_{c}") for c in (*P, *Q)]
    return df.groupBy(*keys).agg(*sums, *(F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a in P for b in Q))


def rigid_from_sums(sums: pd.DataFrame) -> np.ndarray:
    """The poses (16 numbers a row) that carry p to q with least squares, of all rows at once."""
    n = sums["n"].to_numpy(float)[:, None]
    p, q = sums[[f"s_{c}" for c in P]].to_numpy(float) / n, sums[[f"s_{c}" for c in Q]].to_numpy(float) / n
    h = sums[[f"s_{a}_{b}" for a in P for b in Q]].to_numpy(float).reshape(-1, 3, 3) / n[:, None] - p[:, :, None] * q[:, None, :]
    u, _, vt = np.linalg.svd(h)
    v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
    sign = np.sign(np.linalg.det(v @ ut))
    last = np.where(sign == 0, 1.0, sign)[:, None] * v[:, :, 2]
    turn = np.concatenate([v[:, :, :2], last[:, :, None]], axis=2) @ ut
    pose = np.tile(np.eye(4), (len(sums), 1, 1))
    pose[:, :3, :3], pose[:, :3, 3] = turn, q - (turn @ p[:, :, None])[:, :, 0]
    return pose.reshape(-1, 16)


def rigid_fit(df: DataFrame, keys: list[str], weight: str | None = None, least: int = 3) -> DataFrame:
    """(keys, n, pose): a rigid motion per key from corresponding points px..qz."""
    sums = cross_sums(df, keys, weight).where(F.col("n") >= least)
    kinds = dict(sums.dtypes)

    def solve(batches):
        for b in batches:
            yield pd.DataFrame({**{k: b[k] for k in keys}, "n": b["n"], "pose": list(rigid_from_sums(b))})

    return sums.mapInPandas(solve, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["n double", "pose array<double>"]))


def residuals(df: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """df with residual: the distance of q from p under the key's pose."""
    from ..functions.geometry import transform

    joined = df.join(poses.select(*keys, "pose"), keys).withColumn("_t", transform(F.col("pose"), *(F.col(c) for c in P)))
    gap = [F.pow(F.col("_t")[a] - F.col(b), 2) for a, b in zip("xyz", Q, strict=True)]
    return joined.withColumn("residual", F.sqrt(gap[0] + gap[1] + gap[2])).drop("_t", "pose")


def trimmed_fit(df: DataFrame, keys: list[str], limit: float = 0.025, rounds: int = 4) -> DataFrame:
    """A rigid fit repeated over the points within max(limit, three depth sigmas) of the last one."""
    from ..functions.geometry import depth_sigma

    poses = rigid_fit(df, keys)
    for _ in range(rounds - 1):
        near = residuals(df, poses, keys).where(F.col("residual") < F.greatest(F.lit(limit), 3 * depth_sigma(F.col("pz"))))
        poses = rigid_fit(near, keys)
    return poses


def plane(points: np.ndarray, rounds: int = 4) -> tuple[list[float], float, float]:
    """Unit normal, offset and robust scatter: median centre, then points within three scaled median deviations."""
    keep = np.ones(len(points), bool)
    normal, at, scatter = np.array([0.0, 0.0, 1.0]), np.zeros(3), 0.0
    for _ in range(rounds):
        at = np.median(points[keep], axis=0)
        _, axes = np.linalg.eigh((points[keep] - at).T @ (points[keep] - at))
        normal = axes[:, 0] * (np.sign(axes[np.argmax(np.abs(axes[:, 0])), 0]) or 1)
        off = (points - at) @ normal
        middle = np.median(off[keep])
        scatter = float(1.4826 * np.median(np.abs(off[keep] - middle)))
        new = np.abs(off - middle) <= max(3 * scatter, 1e-9)
        if new.sum() < 3:
            break
        keep = new
    return normal.tolist(), float(normal @ at), scatter


def plane_fit(df: DataFrame, key: str, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(key, nx, ny, nz, offset, scatter): a robust plane per key (one view or patch)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, d, s = plane(group[list(axes)].to_numpy(float))
        return pd.DataFrame([(group[key].iloc[0], *n, d, s)], columns=[key, "nx", "ny", "nz", "offset", "scatter"])

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, nx double, ny double, nz double, offset double, scatter double")


def condition(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """(keys, least, most): the extreme eigenvalues of the axes' covariance, for tests of observability."""
    from .robust import moments

    own = moments(df, keys, axes)
    kinds = dict(own.dtypes)
    pairs = [(i, j) for i in range(len(axes)) for j in range(i, len(axes))]

    def solve(batches):
        for b in batches:
            m = np.zeros((len(b), len(axes), len(axes)))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = b[f"cov_{axes[i]}_{axes[j]}"]
            e = np.linalg.eigvalsh(m) if len(b) else np.zeros((0, len(axes)))
            yield pd.DataFrame({**{k: b[k] for k in keys}, "least": e[:, 0], "most": e[:, -1]})

    return own.mapInPandas(solve, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["least double", "most double"]))


def point_to_plane_step(pairs: DataFrame, huber: float = 0.03) -> np.ndarray:
    """The twist (rx, ry, rz, tx, ty, tz) of one weighted point-to-plane step over pairs (px..qz, nx, ny, nz): 27 sums come to the driver."""
    from .robust import normal_equations

    p, q, n = ([F.col(c) for c in cs] for cs in (P, Q, ("nx", "ny", "nz")))
    r = sum(((q[k] - p[k]) * n[k] for k in (1, 2)), (q[0] - p[0]) * n[0])
    turn = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0]]
    weight = F.when(F.abs(r) <= huber, 1.0).otherwise(huber / F.abs(r))
    s = normal_equations(pairs, [], [*turn, *n], r, weight).first().asDict()
    a = np.zeros((6, 6))
    for i in range(6):
        for j in range(i, 6):
            a[i, j] = a[j, i] = s[f"jj_{i}_{j}"] or 0.0
    return np.linalg.lstsq(a, np.array([s[f"jr_{i}"] or 0.0 for i in range(6)]), rcond=None)[0]


def twist_pose(x: np.ndarray) -> np.ndarray:
    """The rigid 4 x 4 matrix of a twist."""
    angle = float(np.linalg.norm(x[:3]))
    k = np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]])
    a, b = (np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2) if angle > 1e-12 else (1.0, 0.5)
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = np.eye(3) + a * k + b * k @ k, x[3:]
    return pose


def icp(source: DataFrame, target: DataFrame, radii: tuple[float, ...] = (0.12, 0.06, 0.03), rounds: tuple[int, ...] = (4, 3, 2)) -> np.ndarray:
    """Coarse-to-fine point-to-plane registration: source (id, x, y, z) onto target (id, x, y, z, nx, ny, nz). Each step is a bucketed radius join and one aggregation."""
    from .knn import radius_nearest

    pose = np.eye(4)
    for radius, n in zip(radii, rounds, strict=True):
        for _ in range(n):
            row = [F.lit(float(v)) for v in pose.ravel()]
            moved = source.select("id", *((row[4 * k] * F.col("x") + row[4 * k + 1] * F.col("y") + row[4 * k + 2] * F.col("z") + row[4 * k + 3]).alias(a) for k, a in enumerate("xyz")))
            near = radius_nearest(moved, target, ("x", "y", "z"), radius, "id")
            pairs = near.join(moved.select(F.col("id").alias("a_id"), *(F.col(a).alias(f"p{a}") for a in "xyz")), "a_id").join(target.select(F.col("id").alias("b_id"), *(F.col(a).alias(f"q{a}") for a in "xyz"), "nx", "ny", "nz"), "b_id")
            step = point_to_plane_step(pairs, radius / 4)
            pose = twist_pose(step) @ pose
            if np.abs(step).max() < 1e-7:
                break
    return pose


def affine_calibration(samples: DataFrame, axes: tuple[str, str, str] = ("ax", "ay", "az"), wanted: tuple[str, str, str] = ("ux", "uy", "uz"), g: float = 9.80665) -> tuple[np.ndarray, float]:
    """The 3 x 4 affine map from raw accelerations to known directions times g, and its RMSE. Sums of a 4 x 7 table come to the driver."""
    x, y = [*(F.col(a) for a in axes), F.lit(1.0)], [F.col(w) * g for w in wanted]
    cols = [F.sum(a * b).alias(f"m_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate([*x, *y])] + [F.sum(b * b).alias(f"y_{j}") for j, b in enumerate(y)]
    row = samples.agg(*cols, F.count(F.lit(1)).alias("n")).first()
    m = np.array([[row[f"m_{i}_{j}"] for j in range(7)] for i in range(4)])
    a = np.linalg.lstsq(m[:, :4], m[:, 4:], rcond=None)[0]
    left = sum(row[f"y_{j}"] for j in range(3)) - 2 * np.sum(a * m[:, 4:]) + np.sum(a * (m[:, :4] @ a))
    return a.T, float(np.sqrt(max(left, 0) / max(row["n"], 1)))


def reciprocal(forward: str, backward: str, metres: float = 0.01, degrees: float = 2.0):
    """Whether one pose undoes the other within limits."""
    from ..functions.geometry import compose, travel, turn_degrees

    both = compose(F.col(forward), F.col(backward))
    return (travel(both) <= metres) & (turn_degrees(both) <= degrees)


def descriptor_summary(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, summary): quartiles of each dimension over a key's vectors, scaled to length 1."""
    each = df.select(key, F.posexplode(vector).alias("d", "v")).groupBy(key, "d").agg(*(F.percentile("v", F.lit(p)).alias(f"q{k}") for k, p in enumerate((0.25, 0.5, 0.75))))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", F.array("q0", "q1", "q2").alias("q")))).alias("_a"))
    flat = F.flatten(F.transform("_a", lambda x: x["q"]))
    length = F.sqrt(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v * v))
    return rows.select(key, F.transform(flat, lambda v: v / F.when(length > 0, length).otherwise(1.0)).alias("summary"))


def place_votes(matches: DataFrame, query: str, label: str) -> DataFrame:
    """How many distinct queries vote for each label."""
    return matches.select(query, label).dropDuplicates().groupBy(label).agg(F.count(F.lit(1)).alias("votes"))


def independent_supports(supports: DataFrame, bridge: str, a: str, b: str) -> DataFrame:
    """Bridges with two supports that share neither camera.

    Supports of which any two share an end all share one, so there are two
    apart just where both ends take more than one value: one aggregation.
    """
    known = supports.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(bridge).isNotNull())
    ends = known.groupBy(bridge).agg(*(f(c).alias(f"_{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k, c in enumerate((a, b))))
    return ends.where("_lo0 <> _hi0 and _lo1 <> _hi1").select(bridge)
