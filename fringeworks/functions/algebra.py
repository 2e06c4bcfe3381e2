"""Model expressions as text: 'A+-B:C,1' are two models, the first with two directions; +- subtracts, 1 is a unit model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cx import Cx


def parse_models(spec: str) -> list[list[list[tuple[int, str]]]]:
    """Models, their directions, and the signed components of each."""
    models = []
    for model in spec.split(","):
        directions = []
        for direction in model.split(":"):
            parts = [p.strip() for p in direction.split("+") if p.strip()]
            if not parts:
                raise ValueError(f"an empty direction in {spec!r}")
            directions.append([(-1, p[1:].strip()) if p.startswith("-") else (1, p) for p in parts])
        models.append(directions)
    return models


def evaluated(vis: DataFrame, spec: str, components: dict[str, Cx], keep: list[str]) -> DataFrame:
    """One row a sample, model and direction: keep, model, dir, m_re, m_im. The rows multiply within a task, without a shuffle."""
    unit = Cx(F.lit(1.0), F.lit(0.0))
    cells: list[Column] = []
    for k, directions in enumerate(parse_models(spec)):
        for d, parts in enumerate(directions):
            total = Cx(F.lit(0.0), F.lit(0.0))
            for sign, name in parts:
                c = unit if name == "1" else components[name]
                total = total + c if sign > 0 else total - c
            cells.append(F.struct(F.lit(k).cast("bigint").alias("model"), F.lit(d).cast("bigint").alias("dir"), total.re.alias("m_re"), total.im.alias("m_im")))
    return vis.select(*keep, F.explode(F.array(*cells)).alias("_m")).select(*keep, "_m.*")


def weights(vis: DataFrame, spec: str, sample: list[str]) -> Column:
    """A product of weight columns, 'A*B~': a name with ~ stands for the mean over a sample's correlations."""
    from pyspark.sql.window import Window

    out = F.lit(1.0)
    for name in spec.split("*"):
        column = name.strip().rstrip("~")
        if column not in vis.columns:
            raise ValueError(f"no column {column!r} of {spec!r}")
        out = out * (F.avg(column).over(Window.partitionBy(*sample)) if name.strip().endswith("~") else F.col(column))
    return out
