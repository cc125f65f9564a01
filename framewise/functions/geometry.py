"""Column expressions for clocks, points, poses and observation weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = 1 << 32


def wrap_delta(a: Column, b: Column, ticks_per_ms: float | None = None) -> Column:
    """Signed difference of wrapping 32-bit ticks; in milliseconds with ticks_per_ms (60,000 for a 60 MHz clock)."""
    ticks = F.pmod(a - b + F.lit(WRAP // 2), F.lit(WRAP)) - F.lit(WRAP // 2)
    return ticks if ticks_per_ms is None else ticks / ticks_per_ms


def cell(value: Column, size: float) -> Column:
    """The number of the grid cell that holds a value."""
    return F.floor(value / F.lit(float(size))).cast("long")


def grid_cell(x: Column, y: Column, width: float, height: float, columns: int = 8, rows: int = 6) -> Column:
    """The cell of an image grid, clamped to its borders."""
    bound = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1))
    return (bound(x * columns / width, columns) + columns * bound(y * rows / height, rows)).cast("long")


def half_away(value: Column) -> Column:
    """Rounds halves away from zero, as the folds do."""
    return F.round(value, 0)


def half_even(value: Column) -> Column:
    """Rounds halves to even, as the visibility tests do."""
    return F.rint(value)


def back_project(px: Column, py: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pixel and depth to a camera-space point."""
    return F.struct(((px - cx) / fx * depth).alias("x"), ((py - cy) / fy * depth).alias("y"), depth.alias("z"))


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, lens: tuple[float, ...] = (0, 0, 0, 0, 0)) -> Column:
    """Point to pixel with lens coefficients k1, k2, p1, p2, k3; null behind the camera."""
    k1, k2, p1, p2, k3 = lens
    a, b = x / z, y / z
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    u = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
    v = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
    return F.when(z > 0, F.struct((fx * u + cx).alias("px"), (fy * v + cy).alias("py")))


def transform(pose: Column, x: Column, y: Column, z: Column) -> Column:
    """A point under a pose of 16 numbers, row by row."""
    row = lambda k: pose[4 * k] * x + pose[4 * k + 1] * y + pose[4 * k + 2] * z + pose[4 * k + 3]
    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def compose(a: Column, b: Column) -> Column:
    """The product of two poses."""
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def inverse(pose: Column) -> Column:
    """The inverse of a rigid pose."""
    out = []
    for i in range(3):
        out += [pose[4 * j + i] for j in range(3)]
        out.append(-(pose[i] * pose[3] + pose[4 + i] * pose[7] + pose[8 + i] * pose[11]))
    return F.array(*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def travel(pose: Column) -> Column:
    """The length of a pose's translation."""
    return F.sqrt(pose[3] * pose[3] + pose[7] * pose[7] + pose[11] * pose[11])


def turn_degrees(pose: Column) -> Column:
    """The angle of a pose's rotation, from its trace."""
    cosine = (pose[0] + pose[5] + pose[10] - 1) / 2
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def is_rigid(pose: Column, tolerance: float = 1e-5) -> Column:
    """16 finite numbers whose rotation is orthonormal and right-handed, with 0 0 0 1 below."""
    near = lambda c, v: F.abs(c - v) <= tolerance
    ok = (F.size(pose) == 16) & F.forall(pose, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    for i in range(3):
        for j in range(i, 3):
            ok = ok & near(sum((pose[4 * i + k] * pose[4 * j + k] for k in range(1, 3)), pose[4 * i] * pose[4 * j]), float(i == j))
    m = lambda i, j: pose[4 * i + j]
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    ok = ok & near(det, 1.0) & near(pose[12], 0.0) & near(pose[13], 0.0) & near(pose[14], 0.0) & near(pose[15], 1.0)
    return F.coalesce(ok, F.lit(False))


def depth_sigma(z: Column, base: float = 0.001) -> Column:
    """The depth noise model: base + 0.002 z^2, in metres."""
    return base + 0.002 * z * z


def observation_weight(z: Column, cosine: Column, edge: Column, fitted: Column | None = None) -> Column:
    """Relative inverse variance by the squared cosine of incidence; 0 at edges, without depth and at grazing angles."""
    weight = F.least(F.greatest(F.pow(0.003 / depth_sigma(z), 2), F.lit(0.05)), F.lit(1.0)) * cosine * cosine
    gone = z.isNull() | F.isnan(z) | (z <= 0) | edge | (cosine < 0.25 if fitted is None else fitted & (cosine < 0.25))
    return F.when(F.coalesce(gone, F.lit(True)), 0.0).otherwise(weight)


def texture_weight(cosine: Column, z: Column) -> Column:
    """Weight of a view for a texel."""
    return cosine * cosine / F.greatest(z * z, F.lit(0.1))


def pair_score(overlap: Column, rmse: Column) -> Column:
    """Overlap over rmse, with rmse held at 5 mm at least."""
    return overlap / F.greatest(rmse, F.lit(0.005))


def distance_weight(distance: Column, angle: Column, distance_scale: float, angle_scale: float) -> Column:
    return 1 / (1 + F.pow(distance / distance_scale, 2) + F.pow(angle / angle_scale, 2))


def pose_uncertainty(steps: Column, missed: Column) -> Column:
    """Growth of position uncertainty over tracked steps and missed ones."""
    return 0.004 + 0.004 * F.sqrt(steps.cast("double")) + 0.008 * missed


def gravity_confidence(norm: Column, scatter: Column, samples: Column, g: float = 9.80665) -> Column:
    """Confidence of a gravity estimate from its norm, its scatter and its number of samples."""
    return F.exp(-F.pow((norm - g) / (0.07 * g), 2) - F.pow(scatter / (0.08 * g), 2)) * F.least(F.lit(1.0), samples / 5.0)


def affine(sample: Column, bias: tuple[float, ...], scale: tuple[float, ...], rotation: tuple[float, ...] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> Column:
    """rotation ((sample - bias) * scale) for a vector of three."""
    v = [(sample[k] - bias[k]) * scale[k] for k in range(3)]
    return F.array(*(v[0] * rotation[3 * i] + v[1] * rotation[3 * i + 1] + v[2] * rotation[3 * i + 2] for i in range(3)))


def timely(lag_ms: Column, limit: float = 20.0) -> Column:
    """A missing lag passes; one that isn't finite fails."""
    return lag_ms.isNull() | (~F.isnan(lag_ms) & (F.abs(lag_ms) <= limit))


def barycentric(a: Column, b: Column, c: Column, wa: Column, wb: Column, wc: Column) -> Column:
    """Interpolation with weights cut at 0 and made to sum to 1."""
    wa, wb, wc = (F.greatest(w, F.lit(0.0)) for w in (wa, wb, wc))
    return (a * wa + b * wb + c * wc) / (wa + wb + wc)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Between unit quaternions (arrays of four) along the shorter arc."""
    dot = sum((a[k] * b[k] for k in range(1, 4)), a[0] * b[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = F.abs(dot) > 1 - 1e-9
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))
    return F.array(*(wa * a[k] + wb * sign * b[k] for k in range(4)))


def rotation_vector_angle(x: Column, y: Column, z: Column) -> Column:
    """Degrees turned by an axis-angle vector."""
    return F.sqrt(x * x + y * y + z * z) * (180 / math.pi)


def canonical_digest(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two lists of parts run together."""
    said = [F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in (F.coalesce(q.cast("string"), F.lit("")) for q in parts)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def middle_eigenvalue(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """The second of the three eigenvalues of a symmetric matrix, in closed form."""
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    size = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    turn = F.acos(F.least(F.greatest(det / (2 * size * size * size), F.lit(-1.0)), F.lit(1.0))) / 3
    return F.when(size > 0, mean + 2 * size * F.cos(turn - 2 * math.pi / 3)).otherwise(mean)


def log_gains(target: tuple[Column, ...], source: tuple[Column, ...], most: float = 2.0) -> list[Column]:
    """Per channel the log gain that brings source to target, within 1 / most and most. Dark channels say little and follow the luminance."""
    luma = (0.2126, 0.7152, 0.0722)  # fixed values: shares of red, green and blue
    light = lambda rgb: F.greatest(sum((w * v for w, v in zip(luma[1:], rgb[1:], strict=True)), luma[0] * rgb[0]), F.lit(0.02))
    whole = F.ln(light(target) / light(source))
    out = []
    for t, s in zip(target, source, strict=True):
        dark = F.least(t, s) * F.least(t, s)
        own = F.ln(F.greatest(t, F.lit(0.01)) / F.greatest(s, F.lit(0.01)))
        gain = whole + dark / (dark + 0.0036) * (own - whole)
        out.append(F.least(F.greatest(gain, F.lit(-math.log(most))), F.lit(math.log(most))))
    return out


def turned_pixel(x: Column, y: Column, width: int, height: int, degrees: int) -> Column:
    """Where a pixel lies after the picture is turned clockwise by a number of quarter turns."""
    places = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}
    return F.struct(places[degrees][0].alias("x"), places[degrees][1].alias("y"))


def gravity_blend(seen: Column, held: Column, sure: Column, verified: Column, lag_ms: Column, limit: float = 3.0) -> Column:
    """How far a predicted pose is turned towards gravity: (disagreement, weight, correction) in degrees; null where it isn't.

    seen and held: unit directions of gravity by the prediction and by the
    pose before. Half of the confidence (0.4 to 1) is the weight, a quarter of
    that without a verified calibration; stale samples (150 ms) and
    disagreements over 25 degrees give no correction, none exceeds limit.
    """
    dot = sum((seen[i] * held[i] for i in (1, 2)), seen[0] * held[0])
    cross = [seen[i] * held[j] - seen[j] * held[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    angle = F.degrees(F.atan2(F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]), F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))
    weight = 0.5 * sure * F.when(verified, 1.0).otherwise(0.25)
    usable = sure.between(0.4, 1.0) & (F.abs(lag_ms) <= 150) & (angle <= 25)
    return F.when(usable, F.struct(angle.alias("disagreement"), weight.alias("weight"), F.least(angle * weight, F.lit(limit)).alias("correction")))
