"""Crystal orientations as Columns: rotation matrices are arrays of nine doubles, by row."""

from __future__ import annotations

from itertools import permutations, product
from math import pi, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CONVENTIONS = ("bunge", "kocks", "roe")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_bunge(a, b, c, convention: str) -> tuple[Column, Column, Column]:
    """Angles in radians of a convention as Bunge angles."""
    a, b, c = _c(a), _c(b), _c(c)
    if convention == "bunge":
        return a, b, c
    if convention == "kocks":
        return a + pi / 2, b, F.lit(pi / 2) - c
    if convention == "roe":
        return a + pi / 2, b, c - pi / 2
    raise ValueError(f"unknown convention {convention!r}; known: {CONVENTIONS}")


def from_bunge(a, b, c, convention: str) -> tuple[Column, Column, Column]:
    a, b, c = _c(a), _c(b), _c(c)
    if convention == "bunge":
        return a, b, c
    if convention == "kocks":
        return a - pi / 2, b, F.lit(pi / 2) - c
    if convention == "roe":
        return a - pi / 2, b, c + pi / 2
    raise ValueError(f"unknown convention {convention!r}; known: {CONVENTIONS}")


def euler_to_matrix(e0, e1, e2, convention: str = "kocks", degrees_in: bool = True) -> Column:
    """The passive Bunge matrix of three Euler angles."""
    angles = [F.radians(_c(e)) if degrees_in else _c(e) for e in (e0, e1, e2)]
    a, b, c = to_bunge(*angles, convention)
    c1, s1, cb, sb, c2, s2 = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return F.array(
        c1 * c2 - s1 * s2 * cb, s1 * c2 + c1 * s2 * cb, s2 * sb,
        -c1 * s2 - s1 * c2 * cb, -s1 * s2 + c1 * c2 * cb, c2 * sb,
        s1 * sb, -c1 * sb, cb,
    )


def matrix_to_euler(m, convention: str = "kocks", degrees_out: bool = True) -> Column:
    """Three Euler angles of a passive matrix; where the middle angle is 0 or pi, all rotation is in the first."""
    m = _c(m)
    g = lambda i: F.get(m, F.lit(i))
    b = F.acos(_clamp(g(8)))
    flat = F.abs(F.sin(b)) < 1e-8
    a = F.when(flat, F.atan2(g(1), g(0))).otherwise(F.atan2(g(6), -g(7)))
    c = F.when(flat, F.lit(0.0)).otherwise(F.atan2(g(2), g(5)))
    out = from_bunge(a, b, c, convention)
    return F.array(*[F.degrees(x) if degrees_out else x for x in out])


def _clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def multiply(a, b) -> Column:
    """The product of two matrices."""
    a, b = _c(a), _c(b)
    return F.array(*[sum((F.get(a, F.lit(3 * i + k)) * F.get(b, F.lit(3 * k + j)) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])


def transpose(m) -> Column:
    m = _c(m)
    return F.array(*[F.get(m, F.lit(3 * j + i)) for i in range(3) for j in range(3)])


def symmetry_operators(symmetry: str = "432") -> list[list[float]]:
    """The rotations of a point group: 432 has the 24 proper signed permutations, 222 four, 1 the identity."""
    if symmetry == "1":
        return [[1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]]
    out = []
    for perm in permutations(range(3)):
        for signs in product((1.0, -1.0), repeat=3):
            m = np.zeros((3, 3))
            for i, (p, s) in enumerate(zip(perm, signs, strict=True)):
                m[i, p] = s
            if np.linalg.det(m) > 0:
                out.append(m)
    if symmetry == "222":
        out = [m for m in out if np.count_nonzero(np.diag(m)) == 3]
    elif symmetry != "432":
        raise ValueError(f"unknown symmetry {symmetry!r}; known: 1, 222, 432")
    out.sort(key=lambda m: (-np.trace(m), m.tolist()))
    return [m.reshape(-1).tolist() for m in out]


def _op_traces(d: Column, symmetry: str) -> list[Column]:
    """The trace of O d for each operator; operators of signed unit entries make it a sum of three entries."""
    out = []
    for o in symmetry_operators(symmetry):
        t = F.lit(0.0)
        for i in range(3):
            for k in range(3):
                if o[3 * i + k]:
                    t = t + F.get(d, F.lit(3 * k + i)) * o[3 * i + k]
        out.append(t)
    return out


def misorientation(m1, m2, symmetry: str = "432") -> Column:
    """The least rotation angle, in degrees, between two orientations up to crystal symmetry."""
    traces = _op_traces(multiply(m1, transpose(m2)), symmetry)
    best = F.greatest(*traces) if len(traces) > 1 else traces[0]
    return F.degrees(F.acos(_clamp((best - 1.0) / 2.0)))


def euler_misorientation(e1, e2, convention: str = "kocks", symmetry: str = "432", degrees_in: bool = True) -> Column:
    return misorientation(euler_to_matrix(*e1, convention, degrees_in), euler_to_matrix(*e2, convention, degrees_in), symmetry)


def fundamental_zone(m, symmetry: str = "432") -> Column:
    """The symmetric equivalent O R with the smallest rotation angle; ties go to the first operator."""
    m = _c(m)
    ops = symmetry_operators(symmetry)
    best = F.array_max(F.array(*[F.struct(t.alias("t"), F.lit(-k).alias("k")) for k, t in enumerate(_op_traces(m, symmetry))]))["k"]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in o]) for o in ops])
    return let(F.get(table, -best), lambda o: multiply(o, m))


def quaternion_to_matrix(q) -> Column:
    """The active rotation matrix of (w, x, y, z)."""
    q = _c(q)
    w, x, y, z = (F.get(q, F.lit(i)) for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def matrix_to_quaternion(m) -> Column:
    """The quaternion (w, x, y, z) of an active rotation matrix, w at least 0."""
    m = _c(m)
    g = lambda i: F.get(m, F.lit(i))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0))) / 2
    w, x, y, z = (root(1 + a * g(0) + b * g(4) + c * g(8)) for a, b, c in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)))
    sx, sy, sz = g(7) - g(5), g(2) - g(6), g(3) - g(1)
    sign = lambda v, s: F.when(s < 0, -v).otherwise(v)
    # at half turns the differences vanish: signs then follow from the off-diagonal products
    half = w < 1e-7
    hy = F.when(x >= 1e-7, sign(y, g(1) + g(3))).otherwise(y)
    hz = F.when(x >= 1e-7, sign(z, g(2) + g(6))).otherwise(F.when(y >= 1e-7, sign(z, g(5) + g(7))).otherwise(z))
    return F.when(half, F.array(F.lit(0.0), x, hy, hz)).otherwise(F.array(w, sign(x, sx), sign(y, sy), sign(z, sz)))


def quaternion_to_mrp(q) -> Column:
    """Modified Rodrigues parameters, axis * tan(angle / 4)."""
    q = _c(q)
    return F.array(*[F.get(q, F.lit(i)) / (1 + F.get(q, F.lit(0))) for i in (1, 2, 3)])


def mrp_to_quaternion(p) -> Column:
    p = _c(p)
    x = [F.get(p, F.lit(i)) for i in range(3)]
    s = x[0] * x[0] + x[1] * x[1] + x[2] * x[2]
    return F.array((1 - s) / (1 + s), *[2 * v / (1 + s) for v in x])


def mrp_to_matrix(p) -> Column:
    return let(mrp_to_quaternion(p), quaternion_to_matrix)


def matrix_to_mrp(m) -> Column:
    return let(matrix_to_quaternion(m), quaternion_to_mrp)


def euler_to_mrp(e0, e1, e2, convention: str = "kocks", degrees_in: bool = True) -> Column:
    return let(transpose(euler_to_matrix(e0, e1, e2, convention, degrees_in)), matrix_to_mrp)


def mrp_to_euler(p, convention: str = "kocks", degrees_out: bool = True) -> Column:
    return let(transpose(mrp_to_matrix(p)), lambda m: matrix_to_euler(m, convention, degrees_out))


def descriptor_to_mrp(descriptor: str, values) -> Column:
    """A tessellation file's orientation descriptor as MRP; other descriptors give the first three values."""
    v = _c(values)
    three = [F.get(v, F.lit(i)) for i in range(3)]
    if descriptor == "rotmat":
        return let(transpose(v), matrix_to_mrp)
    if descriptor == "rodrigues":
        w = 1 / F.sqrt(1 + three[0] * three[0] + three[1] * three[1] + three[2] * three[2])
        return let(F.array(w, *[w * t for t in three]), quaternion_to_mrp)
    if descriptor.startswith("euler-"):
        return euler_to_mrp(*three, convention=descriptor.split("-", 1)[1])
    if descriptor == "quaternion":
        return quaternion_to_mrp(v)
    return F.array(*three)


def rotate_about_axis(axis, degrees) -> Column:
    """Rodrigues' formula: the active rotation about a unit axis."""
    axis = _c(axis)
    x, y, z = (F.get(axis, F.lit(i)) for i in range(3))
    t = F.radians(_c(degrees) if not isinstance(degrees, (int, float)) else F.lit(float(degrees)))
    c, s = F.cos(t), F.sin(t)
    k = 1 - c
    return F.array(c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k)


def perturb(m, sigma: float, seed: int = 0) -> Column:
    """An orientation turned about a uniform axis by an angle of N(0, sigma) degrees."""
    if sigma <= 0:
        return _c(m)
    g = [F.randn(seed + k) for k in range(3)]
    unit = let(F.array(*g), lambda axis: F.transform(axis, lambda x: x / F.sqrt(F.aggregate(axis, F.lit(0.0), lambda acc, y: acc + y * y))))
    return let(F.struct(unit.alias("u"), (F.randn(seed + 3) * sigma).alias("t")), lambda s: let(rotate_about_axis(s["u"], s["t"]), lambda r: multiply(r, m)))


def ipf_direction(m, sample: tuple[float, float, float] = (0.0, 0.0, 1.0), symmetry: str = "432") -> Column:
    """The crystal direction of a sample axis, reduced to the cubic sector 0 <= y <= x <= z."""
    m = _c(m)
    v = [sum((F.get(m, F.lit(3 * i + k)) * sample[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    if symmetry != "432":
        return F.array(*v)
    s = F.array_sort(F.array(*[F.abs(x) for x in v]))
    return F.array(F.get(s, F.lit(1)), F.get(s, F.lit(0)), F.get(s, F.lit(2)))


def ipf_color(direction) -> Column:
    """Red, green and blue in [0, 1] by closeness to the sector's corners 001, 101 and 111."""
    d = _c(direction)
    corners = [(0.0, 0.0, 1.0), (1 / sqrt(2), 0.0, 1 / sqrt(2)), (1 / sqrt(3),) * 3]
    out = []
    for k, c in enumerate(corners):
        others = [o for j, o in enumerate(corners) if j != k]
        least = min(sum(a * b for a, b in zip(c, o, strict=True)) for o in others)
        dot = sum((F.get(d, F.lit(i)) * c[i] for i in range(3)), F.lit(0.0))
        out.append(F.greatest(F.least((dot - least) / (1 - least), F.lit(1.0)), F.lit(0.0)))
    return F.array(*out)


def weighted_means(first: np.ndarray, second: np.ndarray, share: np.ndarray, symmetry: str = "432") -> np.ndarray:
    """The weighted means of pairs of orientations (n, 3, 3): the lighter one is brought next to the heavier, the matrices are averaged, and the nearest rotation is taken."""
    ops = np.array(symmetry_operators(symmetry)).reshape(-1, 3, 3)
    swap = share < 0.5
    heavy = np.where(swap[:, None, None], second, first)
    light = np.where(swap[:, None, None], first, second)
    traces = np.einsum("oij,njk,nik->no", ops, light, heavy)
    near = np.einsum("nij,njk->nik", ops[traces.argmax(axis=1)], light)
    w = np.maximum(share, 1 - share)[:, None, None]
    u, _, vt = np.linalg.svd(w * heavy + (1 - w) * near)
    turn = np.sign(np.linalg.det(u @ vt))
    u[:, :, 2] *= turn[:, None]
    return u @ vt
