"""Grids of cells from lines, and the shapes that detectors give: one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, scalar
from .relations import relation

c = F.col
_DX, _DY = "(bx1 - ax1)", "(by1 - ay1)"


def _angle():
    dx, dy = c("bx1") - c("ax1"), c("by1") - c("ay1")
    return F.when(dx == 0, F.lit(90.0)).when(dy == 0, F.lit(0.0)).otherwise(F.round(F.atan(dy / dx) * 57.29577, 6))


scalar("calculate_angle", "RAS-05", "boxes", "id", _angle, f"CASE WHEN {_DX} = 0 THEN 90e0 WHEN {_DY} = 0 THEN 0e0 ELSE round(atan({_DY} / {_DX}) * 57.29577e0, 6) END")


@query("tiny_image_points", "RAS-12", "SELECT id, (ax1 + ax2) / 2 AS x, (ay1 + ay2) / 2 AS y FROM boxes WHERE (ax2 - ax1) * (ay2 - ay1) < 60", uses="boxes")
def tiny_image_points(spark, sf):
    b = relation(spark, sf, "boxes").filter((c("ax2") - c("ax1")) * (c("ay2") - c("ay1")) < 60)
    return b.select("id", ((c("ax1") + c("ax2")) / 2).alias("x"), ((c("ay1") + c("ay2")) / 2).alias("y"))


_SIDES = {"top": ("ax1", "ay1 - 0.5", "ax2", "ay1 + 0.5"), "bottom": ("ax1", "ay2 - 0.5", "ax2", "ay2 + 0.5"), "left": ("ax1 - 0.5", "ay1", "ax1 + 0.5", "ay2"), "right": ("ax2 - 0.5", "ay1", "ax2 + 0.5", "ay2")}


@query("box_line_rects", "RAS-21 RAS-33", " UNION ALL ".join(f"SELECT id, '{k}' AS side, {a} AS x0, {b} AS y0, {x} AS x1, {y} AS y1 FROM boxes" for k, (a, b, x, y) in _SIDES.items()), uses="boxes")
def box_line_rects(spark, sf):
    """Thin rectangles along the four sides of each box, in one pass."""
    each = F.array(*[F.struct(F.lit(k).alias("side"), *[F.expr(e).cast("double").alias(n) for e, n in zip(v, ("x0", "y0", "x1", "y1"))]) for k, v in _SIDES.items()])
    return relation(spark, sf, "boxes").select("id", F.explode(each).alias("s")).select("id", "s.*")


@query("generate_table_grid", "RAS-18 RAS-20 RAS-22..27 RAS-29..31 RAS-39", """WITH xs AS (SELECT table_id, x, lead(x) OVER (PARTITION BY table_id ORDER BY x) AS nx FROM (SELECT table_id, x0 AS x FROM fx_seg UNION SELECT table_id, x1 FROM fx_seg)),
ys AS (SELECT table_id, y, lead(y) OVER (PARTITION BY table_id ORDER BY y) AS ny FROM (SELECT DISTINCT table_id, y FROM fx_seg)),
g AS (SELECT xs.table_id, row_number() OVER (PARTITION BY xs.table_id ORDER BY y, x) AS cell, x, nx, y, ny FROM xs JOIN ys ON ys.table_id = xs.table_id WHERE nx IS NOT NULL AND ny IS NOT NULL)
SELECT g.table_id, g.cell, count(t.seq) AS n FROM g LEFT JOIN fx_text t ON t.table_id = g.table_id AND (t.x0 + t.x1) / 2e0 >= x AND (t.x0 + t.x1) / 2e0 < nx AND (t.y0 + t.y1) / 2e0 >= y AND (t.y0 + t.y1) / 2e0 < ny GROUP BY g.table_id, g.cell""", uses="fx_seg fx_text")
def generate_table_grid(spark, sf):
    """Cells between neighbouring vertical and horizontal lines, and how many texts each holds."""
    s = relation(spark, sf, "fx_seg")
    nxt = lambda v: F.lead(v).over(Window.partitionBy("table_id").orderBy(v))
    xs = s.select("table_id", F.explode(F.array("x0", "x1")).alias("x")).distinct().withColumn("nx", nxt("x")).filter("nx IS NOT NULL")
    ys = s.select("table_id", "y").distinct().withColumn("ny", nxt("y")).filter("ny IS NOT NULL")
    g = xs.join(ys, "table_id").withColumn("cell", F.row_number().over(Window.partitionBy("table_id").orderBy("y", "x")))
    t = relation(spark, sf, "fx_text").select("table_id", "seq", ((c("x0") + c("x1")) / 2.0).alias("tx"), ((c("y0") + c("y1")) / 2.0).alias("ty"))
    g, t = g.alias("g"), t.alias("t")
    on = (c("g.table_id") == c("t.table_id")) & (c("tx") >= c("x")) & (c("tx") < c("nx")) & (c("ty") >= c("y")) & (c("ty") < c("ny"))
    return g.join(t, on, "left").groupBy("g.table_id", "g.cell").agg(F.count("t.seq").alias("n"))


@query("snap_to_grid", "RAS-32", "SELECT table_id, count(*) FILTER (abs(x1 - round_even(x1 / 100e0, 0) * 100) > 3) AS moved_x, count(*) FILTER (round_even(x1 / 100e0, 0) <> c0) AS wrong_col FROM fx_pred GROUP BY table_id", uses="fx_pred")
def snap_to_grid(spark, sf):
    """Cells snapped to the nearest grid line: how many moved and how many land in another column."""
    at = F.bround(c("x1") / 100.0, 0)
    return relation(spark, sf, "fx_pred").groupBy("table_id").agg(F.count_if(F.abs(c("x1") - at * 100) > 3).alias("moved_x"), F.count_if(at != c("c0")).alias("wrong_col"))


@query("json_fields", "", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_fields(spark, sf):
    """Fields of JSON rows by a given schema."""
    return relation(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
