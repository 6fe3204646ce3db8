"""Distances between field values, and weights made from them, as Column builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rarefield.functions import orientation as rot

EPS = 1e-8
STRESS = ("sxx", "syy", "szz", "sxy", "syz", "sxz")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def von_mises(xx, yy, zz, xy, yz, xz) -> Column:
    """The von Mises equivalent of a symmetric tensor."""
    xx, yy, zz, xy, yz, xz = map(col, (xx, yy, zz, xy, yz, xz))
    normal = (xx - yy) ** 2 + (yy - zz) ** 2 + (zz - xx) ** 2
    return F.sqrt(normal * 0.5 + (xy * xy + yz * yz + xz * xz) * 3.0)


def relative_difference(a, b) -> Column:
    """|a - b| / (|a| + |b| + 1e-8)."""
    a, b = col(a), col(b)
    return F.abs(a - b) / (F.abs(a) + F.abs(b) + EPS)


def frobenius_difference(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """The Frobenius norm of the difference of two tensors given by components."""
    return norm([col(x) - col(y) for x, y in zip(a, b, strict=True)])


def norm(components: Sequence[Column | str]) -> Column:
    total = F.lit(0.0)
    for c in map(col, components):
        total = total + c * c
    return F.sqrt(total)


def array_l2(u, v) -> Column:
    """The squared Euclidean distance of two array columns."""
    return F.aggregate(F.zip_with(col(u), col(v), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


@dataclass(frozen=True)
class Metric:
    """A distance of two nodes: per-node columns are made once, before the edge join, then compared."""

    name: str
    node: Callable[[], list[Column]]
    distance: Callable[[list[Column], list[Column]], Column]


def von_mises_metric(cols: Sequence[str] = STRESS) -> Metric:
    return Metric("von_mises_stress", lambda: [von_mises(*cols)], lambda u, v: relative_difference(u[0], v[0]))


def tensor_norm_metric(cols: Sequence[str]) -> Metric:
    """The Frobenius distance over the given components, all of which count."""
    return Metric("nye_tensor_norm", lambda: [col(c) for c in cols], frobenius_difference)


def misorientation_metric(cols: Sequence[str], convention: str = "bunge", degrees_in: bool = True, symmetry: str = "432") -> Metric:
    if len(cols) != 3:
        raise ValueError("misorientation needs exactly three angle columns")
    return Metric(
        "misorientation",
        lambda: [rot.euler_to_matrix(*cols, convention=convention, degrees_in=degrees_in)],
        lambda u, v: rot.misorientation(u[0], v[0], symmetry),
    )


def metric(name: str, **options) -> Metric:
    """The metric of a name."""
    makers = {"von_mises_stress": von_mises_metric, "misorientation": misorientation_metric, "nye_tensor_norm": tensor_norm_metric}
    if name not in makers:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(makers)}")
    if name == "nye_tensor_norm":
        options.setdefault("cols", [f"nye_tensor_{i}{j}" for i in "123" for j in "123"])
    if name == "misorientation":
        options.setdefault("cols", ["Eul0", "Eul1", "Eul2"])
    return makers[name](**options)


def weight(distance, mode: str, sigma: float | None = None, power: float = 2.0, eps: float = 1e-12) -> Column:
    """An edge weight from a distance: inverse, rbf, exp, log_inv or identity."""
    d = col(distance)
    if mode in ("rbf", "exp") and not (sigma and sigma > 0):
        raise ValueError(f"weight mode {mode!r} needs a positive sigma")
    if mode == "inverse":
        return F.lit(1.0) / (d + eps)
    if mode == "rbf":
        return F.exp(-F.pow(d / sigma, power))
    if mode == "exp":
        return F.exp(-d / sigma)
    if mode == "log_inv":
        return -F.log(d + eps)
    if mode == "identity":
        return d
    raise ValueError(f"unknown weight mode {mode!r}")


def candidate_cost(terms: Sequence[tuple[float, Column | str, float]]) -> Column:
    """The sum of weight * difference / tolerance; a tolerance of 0 or less counts as 1."""
    total = F.lit(0.0)
    for w, diff, tol in terms:
        total = total + col(diff) * (w / (tol if tol > 0 else 1.0))
    return total


def relative_radius(a, b) -> Column:
    """|b - a| / max(a, 1e-14)."""
    return F.abs(col(b) - col(a)) / F.greatest(col(a), F.lit(1e-14))


def gates(checks: Sequence[tuple[Column | str, float]]) -> Column:
    """All differences within their tolerances; a tolerance of -1 is no gate."""
    ok = F.lit(True)
    for diff, tol in checks:
        if tol != -1:
            ok = ok & (col(diff) <= tol)
    return ok
