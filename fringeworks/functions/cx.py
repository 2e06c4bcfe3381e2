"""Complex numbers and 2 x 2 complex matrices as pairs of double columns; all stays within generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Cx:
    re: Column
    im: Column

    def __mul__(self, o: Cx) -> Cx:
        return Cx(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __add__(self, o: Cx) -> Cx:
        return Cx(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Cx) -> Cx:
        return Cx(self.re - o.re, self.im - o.im)

    def __neg__(self) -> Cx:
        return Cx(-self.re, -self.im)

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def arg(self) -> Column:
        return F.atan2(self.im, self.re)

    def over(self, o: Cx) -> Cx:
        n = o.abs2()
        p = self * o.conj()
        return Cx(p.re / n, p.im / n)

    def scaled(self, k: Column) -> Cx:
        return Cx(self.re * k, self.im * k)


def cx(re: str | Column, im: str | Column) -> Cx:
    return Cx(F.col(re) if isinstance(re, str) else re, F.col(im) if isinstance(im, str) else im)


def polar(phase: Column) -> Cx:
    return Cx(F.cos(phase), F.sin(phase))


Mat = tuple[tuple[Cx, Cx], tuple[Cx, Cx]]


def mat_mul(a: Mat, b: Mat) -> Mat:
    return tuple(tuple(a[i][0] * b[0][j] + a[i][1] * b[1][j] for j in (0, 1)) for i in (0, 1))


def mat_h(a: Mat) -> Mat:
    return tuple(tuple(a[j][i].conj() for j in (0, 1)) for i in (0, 1))


def sandwich(p: Mat, v: Mat, q: Mat) -> Mat:
    """p v q^H"""
    return mat_mul(mat_mul(p, v), mat_h(q))


def mat_inverse(a: Mat, eps: float) -> tuple[Mat, Column]:
    """The inverse, all zero where |det|^2 <= eps^2, and whether that is so."""
    det = a[0][0] * a[1][1] - a[0][1] * a[1][0]
    bad = det.abs2() <= eps * eps
    zero = lambda x: Cx(F.when(bad, 0.0).otherwise(x.re), F.when(bad, 0.0).otherwise(x.im))
    return ((zero(a[1][1].over(det)), zero((-a[0][1]).over(det))), (zero((-a[1][0]).over(det)), zero(a[0][0].over(det)))), bad


def diagonal_inverse(a: Cx, b: Cx, eps: float) -> tuple[Cx, Cx, Column]:
    """Reciprocals of a diagonal's elements, zero where the square of their product's size is within eps^2, and whether that is so."""
    bad = (a * b).abs2() <= eps * eps
    one = lambda x: Cx(F.when(bad, 0.0).otherwise(x.re / F.when(~bad, x.abs2())), F.when(bad, 0.0).otherwise(-x.im / F.when(~bad, x.abs2())))
    return one(a), one(b), bad


def rotated_hands(vis: DataFrame, sign: int) -> DataFrame:
    """P_p V P_q^H for circular hands, as rows by corr (0 to 3): P is diag(exp(i a), exp(-i a)) with the angles a1 and a2 of both ends, times sign."""
    p, q = F.col("a1") * sign, F.col("a2") * sign
    phase = F.when(F.col("corr") == 0, p - q).when(F.col("corr") == 1, p + q).when(F.col("corr") == 2, -p - q).otherwise(q - p)
    out = cx("re", "im") * polar(phase)
    return vis.withColumns({"re": out.re, "im": out.im})
