"""Rigid transforms as Column expressions: array<double> of 16 cells, row by row, and quaternions (w, x, y, z)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this angle (radians) a rotation counts as none.
SMALL_ANGLE = 1e-5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: without it, nested matrix expressions grow with every use."""
    return F.transform(F.array(value), body)[0]


def identity() -> Column:
    return F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])


def transform(pose: Column, x, y, z) -> tuple[Column, Column, Column]:
    """R p + t."""
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    return tuple(pose[4 * r] * x + pose[4 * r + 1] * y + pose[4 * r + 2] * z + pose[4 * r + 3] for r in range(3))


def rotate(pose: Column, x, y, z) -> tuple[Column, Column, Column]:
    """R v, for normals."""
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    return tuple(pose[4 * r] * x + pose[4 * r + 1] * y + pose[4 * r + 2] * z for r in range(3))


def inverse(pose: Column) -> Column:
    """Inverse of a rigid transform: R', -R' t."""

    def cells(m: Column) -> Column:
        rows = [[m[r], m[4 + r], m[8 + r], -(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11])] for r in range(3)]
        return F.array(*[c for row in rows for c in row], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    return let(pose, cells)


def product(a: Column, b: Column) -> Column:
    return let(a, lambda m: let(b, lambda n: F.array(*[m[4 * r] * n[c] + m[4 * r + 1] * n[4 + c] + m[4 * r + 2] * n[8 + c] + m[4 * r + 3] * n[12 + c] for r in range(4) for c in range(4)])))


def relative(a: Column, b: Column) -> Column:
    """a^-1 b."""
    return product(inverse(a), b)


def rotation_angle(pose: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (pose[0] + pose[5] + pose[10] - 1) / 2)))


def orthonormalize(pose: Column) -> Column:
    """The pose with its rotation made exact again, by way of a unit quaternion."""
    return let(pose, lambda m: let(to_quaternion(m), lambda q: from_quaternion(q["w"], q["x"], q["y"], q["z"], m[3], m[7], m[11])))


def nav_of_laser(laser: Column, body_laser: Column) -> Column:
    """Pose of the body from the laser's: laser * body_laser^-1."""
    return product(laser, inverse(body_laser))


def laser_of_nav(body: Column, body_laser: Column) -> Column:
    return product(body, body_laser)


def turn_velocity(before: Column, after: Column, v: list[Column]) -> tuple[Column, Column, Column]:
    """A velocity that stays the same in the body's frame while its pose changes: R2 R1' v."""
    return rotate(product(after, inverse(before)), *v)


def from_yaw(yaw: Column, tx, ty, tz=0.0) -> Column:
    c, s = F.cos(yaw), F.sin(yaw)
    lit = lambda v: F.lit(v) if isinstance(v, float) else v
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, lit(tx), s, c, zero, lit(ty), zero, zero, one, lit(tz), zero, zero, zero, one)


def from_roll_pitch_yaw(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rotation Z(yaw) Y(pitch) X(roll), without translation."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, zero,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, zero,
        -sp, cp * sr, cp * cr, zero, zero, zero, zero, one,
    )


def from_quaternion(w, x, y, z, tx=None, ty=None, tz=None) -> Column:
    """The quaternion is normalized first."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), zero if tx is None else tx,
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), zero if ty is None else ty,
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), zero if tz is None else tz,
        zero, zero, zero, one,
    )


def to_quaternion(pose: Column) -> Column:
    """struct(w, x, y, z) of unit length with w >= 0; the largest component is taken first, for accuracy."""
    return let(pose, _quaternion)


def _quaternion(pose: Column) -> Column:
    m = [[pose[4 * r + c] for c in range(3)] for r in range(3)]
    squares = [1 + m[0][0] + m[1][1] + m[2][2], 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2]]
    pair = {(0, 1): m[2][1] - m[1][2], (0, 2): m[0][2] - m[2][0], (0, 3): m[1][0] - m[0][1], (1, 2): m[0][1] + m[1][0], (1, 3): m[0][2] + m[2][0], (2, 3): m[1][2] + m[2][1]}

    def branch(k: int) -> Column:
        big = F.sqrt(F.greatest(squares[k], F.lit(0.0))) / 2
        cells = [big if i == k else pair[min(i, k), max(i, k)] / (4 * big) for i in range(4)]
        sign = F.when(cells[0] < 0, -1.0).otherwise(1.0)
        return F.struct(*[(c * sign).alias(n) for c, n in zip(cells, "wxyz", strict=True)])

    top = F.greatest(*squares)
    return F.when(squares[0] == top, branch(0)).when(squares[1] == top, branch(1)).when(squares[2] == top, branch(2)).otherwise(branch(3))


def pack(pose: Column) -> Column:
    """Text form "tx ty tz qw qx qy qz"."""
    return let(to_quaternion(pose), lambda q: F.concat_ws(" ", *[c.cast("string") for c in (pose[3], pose[7], pose[11], q["w"], q["x"], q["y"], q["z"])]))


def unpack(text: Column) -> Column:
    cells = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.cast("double"))
    return let(cells, lambda c: from_quaternion(c[3], c[4], c[5], c[6], c[0], c[1], c[2]))


def so3_exp(x: Column, y: Column, z: Column) -> Column:
    """Rotation of a rotation vector, without translation."""
    angle = F.sqrt(x * x + y * y + z * z)
    small = angle < SMALL_ANGLE
    safe = F.when(small, 1.0).otherwise(angle)
    half = F.when(small, 0.5).otherwise(F.sin(angle / 2) / safe)
    return let(F.array(F.cos(angle / 2), half * x, half * y, half * z), lambda q: from_quaternion(q[0], q[1], q[2], q[3]))


def so3_log(pose: Column) -> Column:
    """Rotation vector of the pose's rotation, as an array."""

    def vector(q: Column) -> Column:
        n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
        small = n < SMALL_ANGLE
        scale = F.when(small, 2.0).otherwise(2 * F.atan2(n, q["w"]) / F.when(small, 1.0).otherwise(n))
        return F.array(q["x"] * scale, q["y"] * scale, q["z"] * scale)

    return let(to_quaternion(pose), vector)


def so3_jacobian(x: Column, y: Column, z: Column, left: bool = False, inverse: bool = False) -> Column:
    """Right (or left) Jacobian of a rotation vector, or its inverse, as an array of 9 cells; the identity below SMALL_ANGLE."""
    a = F.sqrt(x * x + y * y + z * z)
    small = a < SMALL_ANGLE
    safe = F.when(small, 1.0).otherwise(a)
    sign = 1.0 if left != inverse else -1.0
    if inverse:
        one, two = F.lit(0.5 * sign), 1 / (safe * safe) - (1 + F.cos(safe)) / (2 * safe * F.sin(safe))
    else:
        one, two = sign * (1 - F.cos(safe)) / (safe * safe), (safe - F.sin(safe)) / (safe * safe * safe)

    def cells(c: Column) -> Column:
        one, two, v, a2 = c[0], c[1], (c[2], c[3], c[4]), c[2] * c[2] + c[3] * c[3] + c[4] * c[4]
        skew = [[None, -v[2], v[1]], [v[2], None, -v[0]], [-v[1], v[0], None]]
        return F.array(*[1 + two * (v[r] * v[r] - a2) if r == k else one * skew[r][k] + two * v[r] * v[k] for r in range(3) for k in range(3)])

    return let(F.array(F.when(small, 0.0).otherwise(one), F.when(small, 0.0).otherwise(two), x, y, z), cells)


def wrap_angle(angle: Column, half_turn: float = 3.1416) -> Column:
    """Into [-half_turn, half_turn)."""
    return F.pmod(angle + half_turn, F.lit(2 * half_turn)) - half_turn
