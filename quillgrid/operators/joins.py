"""Joins of boxes by containment, overlap and distance.

Every join has the equality keys of its page or table first, so Spark shuffles or broadcasts on those
and the geometric condition is checked within; the pairs of one table stay in its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

c = F.col


def containment(text: DataFrame, cells: DataFrame, keys: list[str], tol: float = 2) -> DataFrame:
    """Texts (t_*) whose centre lies in a cell (c_*): all pairs."""
    t, cl = _prefixed(text, "t_", keys), _prefixed(cells, "c_", keys)
    x, y = (c("t_x1") + c("t_x2")) / 2, (c("t_y1") + c("t_y2")) / 2
    hit = x.between(c("c_x1") - tol, c("c_x2") + tol) & y.between(c("c_y1") - tol, c("c_y2") + tol)
    return t.join(cl, keys).filter(hit)


def best_cell(text: DataFrame, cells: DataFrame, keys: list[str], tol: float = 2) -> DataFrame:
    """For each text its cell: the first that holds its centre, else the one of largest IoU, then of least corner distance.

    The choice is one aggregate over the pairs of a table (no window), so partial results shrink before the shuffle.
    """
    t, cl = _prefixed(text, "t_", keys), _prefixed(cells, "c_", keys)
    tb, cb = _box("t_"), _box("c_")
    x, y = (c("t_x1") + c("t_x2")) / 2, (c("t_y1") + c("t_y2")) / 2
    inside = x.between(c("c_x1") - tol, c("c_x2") + tol) & y.between(c("c_y1") - tol, c("c_y2") + tol)
    order = F.struct(
        F.when(inside, 0).otherwise(1).alias("o"), F.when(inside, 0.0).otherwise(1 - g.iou(tb, cb)).alias("far"),
        F.when(inside, 0.0).otherwise(g.corner_distance(tb, cb)).alias("dist"), c("c_seq").alias("cell"),
    )
    return t.join(cl, keys).groupBy(*keys, "t_seq").agg(F.min(order).alias("m")).select(*keys, c("t_seq").alias("seq"), c("m.cell").alias("cell"), (c("m.o") == 0).alias("inside"))


def _prefixed(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[c(x).alias(p + x) for x in df.columns if x not in keys])


def _box(p: str) -> tuple[Column, ...]:
    return tuple(c(p + n) for n in ("x1", "y1", "x2", "y2"))


def first_match(gt: DataFrame, pred: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Each expected box with the first predicted box of enough IoU (null without one); a prediction may serve several."""
    a, b = _prefixed(gt, "g_", keys), _prefixed(pred, "p_", keys)
    hit = g.iou(_box("g_"), _box("p_")) >= least
    m = a.join(b, keys).filter(hit).groupBy(*keys, "g_seq").agg(F.min("p_seq").alias("pred"))
    return gt.select(*keys, c("seq").alias("g_seq")).join(m, [*keys, "g_seq"], "left").select(*keys, c("g_seq").alias("seq"), "pred")


def cascade(text: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cell of each text in three stages and virtual cells for what is left.

    1 the centre lies in the cell (all such pairs), 2 the cell of largest overlap with the hull, 3 each
    cell without text takes the nearest text without cell, 4 new cells in reading order.
    """
    t, cl = _prefixed(text, "t_", keys), _prefixed(cells, "c_", keys)
    tb, cb = _box("t_"), _box("c_")
    x, y = (c("t_x1") + c("t_x2")) / 2, (c("t_y1") + c("t_y2")) / 2
    inside = (x > c("c_x1")) & (x < c("c_x2")) & (y > c("c_y1")) & (y < c("c_y2"))
    pairs = t.join(cl, keys)
    one = pairs.filter(inside).select(*keys, "t_seq", "c_seq", F.lit(1).alias("stage"))
    left = t.join(one.select(*keys, "t_seq").distinct(), [*keys, "t_seq"], "left_anti")
    h = g.hull_iou(tb, cb)
    two = (
        left.join(cl, keys).withColumn("h", F.round(h, 9)).filter("h > 0").groupBy(*keys, "t_seq")
        .agg(F.min(F.struct((-c("h")).alias("h"), c("c_seq"))).alias("m")).select(*keys, "t_seq", c("m.c_seq").alias("c_seq"), F.lit(2).alias("stage"))
    )
    done = one.unionByName(two)
    left = left.join(two.select(*keys, "t_seq"), [*keys, "t_seq"], "left_anti")
    bare = cl.join(done.select(*keys, "c_seq").distinct(), [*keys, "c_seq"], "left_anti")
    three = (
        bare.join(left, keys).groupBy(*keys, "c_seq").agg(F.min(F.struct(g.corner_distance(tb, cb).alias("d"), c("t_seq"))).alias("m"))
        .select(*keys, c("m.t_seq").alias("t_seq"), "c_seq", F.lit(3).alias("stage"))
    )
    left = left.join(three.select(*keys, "t_seq").distinct(), [*keys, "t_seq"], "left_anti")
    size = cl.groupBy(*keys).agg(F.max("c_seq").alias("n"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("t_y1", "t_x1", "t_seq"))
    four = left.withColumn("r", order).join(size, keys).select(*keys, "t_seq", (c("n") + c("r")).alias("c_seq"), F.lit(4).alias("stage"))
    return done.unionByName(three).unionByName(four)
