"""Predicates: one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import box, d
from ..registry import query, scalar
from .relations import Layout, relation

A, B = (lambda: box("a")), (lambda: box("b"))
c = F.col


def _s(name, ids, column, sql, base="boxes", keys="id"):
    scalar(name, ids, base, keys, column, sql)


_s("equal_within", "FIL-01 FIL-26", lambda: g.near(c("ax1"), c("bx1"), 2), "abs(ax1 - bx1) < 2")
_XS = ("ax1", "ax2", "bx2")
_s("equal_in", "FIL-02", lambda: F.exists(F.array(*_XS), lambda v: F.abs(v - c("bx1")) < 2), "abs(ax1 - bx1) < 2 OR abs(ax2 - bx1) < 2 OR abs(bx2 - bx1) < 2")
_s("equal_point", "FIL-03", lambda: g.near(c("ax1"), c("bx1"), 2) & g.near(c("ay1"), c("by1"), 2), "abs(ax1 - bx1) < 2 AND abs(ay1 - by1) < 2")
_PTS = (("ax1", "ay1"), ("ax2", "ay1"), ("ax2", "ay2"), ("ax1", "ay2"))
_corners = lambda: F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in _PTS])
_AT = " OR ".join(f"(abs({x} - bx1) < 4 AND abs({y} - by1) < 4)" for x, y in _PTS)
_s("cell_equal_in", "FIL-04 FIL-59..61", lambda: F.exists(_corners(), lambda p: (F.abs(p["x"] - c("bx1")) < 4) & (F.abs(p["y"] - c("by1")) < 4)), _AT)


@query("point_equal_in", "FIL-05", """
SELECT b.id, exists(SELECT 1 FROM boxes p WHERE p.grp = b.grp AND p.id <> b.id AND abs(p.ax1 - b.bx1) < 2 AND abs(p.ay1 - b.by1) < 2) AS v FROM boxes b""", uses="boxes")
def point_equal_in(spark, sf_dir):
    """Points of the same group within the tolerance: cells of its size, joined with their neighbours by equality.

    The tolerance is the reference's 2; coordinates are whole, so with 1 only equal points would do.
    Of equal points only the least and the greatest id go on, as one of them is another id if there is any.
    """
    b, tol = relation(spark, sf_dir, "boxes"), 2
    cell = lambda x: F.floor(c(x) / tol)
    pts = b.groupBy("grp", c("ax1").alias("px"), c("ay1").alias("py")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    around = lambda x: F.explode(F.array(cell(x) - 1, cell(x), cell(x) + 1))
    pts = pts.withColumn("cx", around("px")).withColumn("cy", around("py"))
    places = b.select("grp", "bx1", "by1").distinct().withColumn("cx", cell("bx1")).withColumn("cy", cell("by1"))
    near = places.join(pts, ["grp", "cx", "cy"])
    near = near.filter(g.near(c("px"), c("bx1"), tol) & g.near(c("py"), c("by1"), tol)).groupBy("grp", "bx1", "by1").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    other = (c("lo") != c("id")) | (c("hi") != c("id"))
    return b.select("id", "grp", "bx1", "by1").join(near, ["grp", "bx1", "by1"], "left").select("id", F.coalesce(other, F.lit(False)).alias("v"))


@query("cell_equal_in_list", "FIL-06", """
SELECT g.table_id, g.seq FROM fx_gt g WHERE exists(SELECT 1 FROM fx_pred p WHERE p.table_id = g.table_id AND abs(p.x1 - g.x1) < 2 AND abs(p.y2 - g.y2) < 2 AND abs(p.x2 - g.x2) < 2 AND abs(p.y1 - g.y1) < 2)""", uses="fx_gt fx_pred")
def cell_equal_in_list(spark, sf_dir):
    gt, p = relation(spark, sf_dir, "fx_gt").alias("g"), relation(spark, sf_dir, "fx_pred").alias("p")
    on = c("g.table_id") == c("p.table_id")
    for n in ("x1", "y1", "x2", "y2"):
        on = on & (F.abs(c(f"p.{n}") - c(f"g.{n}")) < 2)
    return gt.join(p, on, "left_semi").select("table_id", "seq")


_s("cell_all_in_points", "FIL-07", lambda: F.forall(_corners(), lambda p: F.exists(F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x in ("bx1", "bx2") for y in ("by1", "by2")]), lambda q: (F.abs(p["x"] - q["x"]) < 6) & (F.abs(p["y"] - q["y"]) < 6))),
   " AND ".join("(" + " OR ".join(f"(abs({x} - {u}) < 6 AND abs({y} - {v}) < 6)" for u in ("bx1", "bx2") for v in ("by1", "by2")) + ")" for x, y in _PTS))
_s("point_in_bbox", "FIL-08 FIL-25", lambda: g.point_inside(c("bx1"), c("by1"), A()), "bx1 BETWEEN ax1 - 2 AND ax2 + 2 AND by1 BETWEEN least(ay1, ay2) - 2 AND greatest(ay1, ay2) + 2")


@query("point_in_bbox_list", "FIL-09 FIL-17", """
SELECT t.table_id, t.seq FROM fx_text t WHERE exists(SELECT 1 FROM fx_seg s WHERE s.table_id = t.table_id AND (t.x0 + t.x1) / 2 BETWEEN s.x0 - 2 AND s.x1 + 2 AND (t.y0 + t.y1) / 2 BETWEEN s.y - 2 AND s.y + 22)""", uses="fx_text fx_seg")
def point_in_bbox_list(spark, sf_dir):
    t, s = relation(spark, sf_dir, "fx_text").alias("t"), relation(spark, sf_dir, "fx_seg").alias("s")
    x, y = (c("t.x0") + c("t.x1")) / 2, (c("t.y0") + c("t.y1")) / 2
    return t.join(s, (c("t.table_id") == c("s.table_id")) & x.between(c("s.x0") - 2, c("s.x1") + 2) & y.between(c("s.y") - 2, c("s.y") + 22), "left_semi").select("table_id", "seq")


_s("box_in_other_box", "FIL-10", lambda: g.box_inside(A(), B()), "bx1 >= ax1 - 2 AND bx2 <= ax2 + 2 AND least(by1, by2) >= least(ay1, ay2) - 2 AND greatest(by1, by2) <= greatest(ay1, ay2) + 2")
_s("two_line_intersect", "FIL-11", lambda: g.intervals_match(c("ax1"), c("ax2"), c("bx1"), c("bx2")),
   "CASE WHEN ax1 >= bx1 - 2 AND ax2 <= bx2 + 2 THEN true WHEN least(ax2, bx2) - greatest(ax1, bx1) <= 0 THEN false ELSE (least(ax2, bx2) - greatest(ax1, bx1)) / (bx2 - bx1) >= 0.8 END")
_s("line_in_line_pair", "FIL-12", lambda: F.exists(F.array(F.struct(c("ax1").alias("a"), c("ax2").alias("b")), F.struct(c("ay1").alias("a"), c("ay2").alias("b"))), lambda p: (F.abs(p["a"] - c("bx1")) < 5) & (F.abs(p["b"] - c("bx2")) < 5)),
   "(abs(ax1 - bx1) < 5 AND abs(ax2 - bx2) < 5) OR (abs(ay1 - bx1) < 5 AND abs(ay2 - bx2) < 5)")


def _edges(spark, sf_dir, tol, ratio):
    """Whether a segment of the table runs along the top or the bottom of each cell."""
    cells, seg = relation(spark, sf_dir, "fx_cells"), relation(spark, sf_dir, "fx_seg").select("table_id", c("x0").alias("sx0"), c("x1").alias("sx1"), c("y").alias("sy"))
    j = cells.join(seg, "table_id", "left")
    spans = g.intervals_match(c("x1"), c("x2"), c("sx0"), c("sx1"), 2, ratio) if ratio else (c("sx0") <= c("x1") + tol) & (c("sx1") >= c("x2") - tol)
    top, bottom = spans & (F.abs(c("sy") - c("y1")) < tol), spans & (F.abs(c("sy") - c("y2")) < tol)
    return j.groupBy("table_id", "cell_id").agg(F.coalesce(F.bool_or(top), F.lit(False)).alias("top"), F.coalesce(F.bool_or(bottom), F.lit(False)).alias("bottom"))


def _edges_sql(tol, ratio):
    o = "(least(c.x2, s.x1) - greatest(c.x1, s.x0))"
    spans = f"CASE WHEN c.x1 >= s.x0 - 2 AND c.x2 <= s.x1 + 2 THEN true WHEN {o} <= 0 THEN false ELSE {o} / (s.x1 - s.x0) >= {ratio} END" if ratio else f"(s.x0 <= c.x1 + {tol} AND s.x1 >= c.x2 - {tol})"
    return f"""SELECT c.table_id, cell_id, coalesce(bool_or(({spans}) AND abs(s.y - c.y1) < {tol}), false) AS top, coalesce(bool_or(({spans}) AND abs(s.y - c.y2) < {tol}), false) AS bottom
FROM fx_cells c LEFT JOIN fx_seg s ON s.table_id = c.table_id GROUP BY c.table_id, cell_id"""


@query("cell_horizontal_line_exists", "FIL-13 JOI-49..50", _edges_sql(2, None), uses="fx_cells fx_seg")
def cell_horizontal_line_exists(spark, sf_dir):
    return _edges(spark, sf_dir, 2, None)


@query("cell_horizontal_line_exists_v2", "FIL-14 JOI-45 JOI-47", _edges_sql(3, 0.8), uses="fx_cells fx_seg")
def cell_horizontal_line_exists_v2(spark, sf_dir):
    return _edges(spark, sf_dir, 3, 0.8)


@query("cell_vertical_line_exists", "FIL-15..16", """
SELECT c.table_id, c.cell_id, coalesce(bool_or(abs(t.x0 - c.x1) < 4 AND t.y0 <= c.y2 AND t.y1 >= c.y1), false) AS is_left, coalesce(bool_or(abs(t.x1 - c.x2) < 4 AND t.y0 <= c.y2 AND t.y1 >= c.y1), false) AS is_right
FROM fx_cells c LEFT JOIN fx_text t ON t.table_id = c.table_id GROUP BY c.table_id, c.cell_id""", uses="fx_cells fx_text")
def cell_vertical_line_exists(spark, sf_dir):
    """Text edges stand for vertical lines here."""
    cells = relation(spark, sf_dir, "fx_cells")
    t = relation(spark, sf_dir, "fx_text").select("table_id", c("x0").alias("tx0"), c("x1").alias("tx1"), c("y0").alias("ty0"), c("y1").alias("ty1"))
    meets = (c("ty0") <= c("y2")) & (c("ty1") >= c("y1"))
    flag = lambda p: F.coalesce(F.bool_or(p & meets), F.lit(False))
    return cells.join(t, "table_id", "left").groupBy("table_id", "cell_id").agg(flag(F.abs(c("tx0") - c("x1")) < 4).alias("is_left"), flag(F.abs(c("tx1") - c("x2")) < 4).alias("is_right"))


@query("check_table_match_images", "FIL-18", """
SELECT page, tab, img FROM (SELECT t.page, t.seq AS tab, i.seq AS img, row_number() OVER (PARTITION BY t.page, t.seq ORDER BY i.seq) AS rn FROM fx_layout t JOIN fx_layout i ON i.page = t.page AND t.label = 'table' AND i.label = 'figure'
 AND t.x1 >= i.x1 - 60 AND t.x2 <= i.x2 + 60 AND t.y1 >= i.y1 - 60 AND t.y2 <= i.y2 + 60) WHERE rn = 1""", uses="fx_layout")
def check_table_match_images(spark, sf_dir):
    """The first figure around each table."""
    lay = Layout(spark, sf_dir)
    return lay.on_pages(_figure_of(lay.once, "label = 'figure'", F.min("seq"), F.min("fig")))


def _figure_of(lay, which, of_box, choose):
    """A figure for each table that lies in some: figures and tables that share a box are compared once."""
    side = ["page", "x1", "y1", "x2", "y2"]
    figs = lay.filter(which).groupBy(*side).agg(of_box.alias("fig")).alias("i")
    tables = lay.filter("label = 'table'")
    inside = (c("t.x1") >= c("i.x1") - 60) & (c("t.x2") <= c("i.x2") + 60) & (c("t.y1") >= c("i.y1") - 60) & (c("t.y2") <= c("i.y2") + 60)
    boxes = tables.select(*side).distinct().alias("t")
    found = boxes.join(figs, (c("t.page") == c("i.page")) & inside).groupBy(*[c(f"t.{n}") for n in side]).agg(choose.alias("fig"))
    return tables.join(found, side).groupBy("page", c("seq").alias("tab")).agg(choose.alias("img"))


@query("filter_layout_figure", "FIL-19", """
SELECT t.page, t.seq AS tab, max_by(i.seq, i.y1 * 100000 + i.seq) AS img FROM fx_layout t JOIN fx_layout i ON i.page = t.page AND t.label = 'table' AND i.label = 'figure' AND i.score_pct >= 40
 AND t.x1 >= i.x1 - 60 AND t.x2 <= i.x2 + 60 AND t.y1 >= i.y1 - 60 AND t.y2 <= i.y2 + 60 GROUP BY t.page, t.seq""", uses="fx_layout")
def filter_layout_figure(spark, sf_dir):
    """The last figure by y that holds the table."""
    lay = Layout(spark, sf_dir)
    last = F.max(F.struct((c("y1") * 100000 + c("seq")).alias("key"), "seq"))
    return lay.on_pages(_figure_of(lay.once, "label = 'figure' AND score_pct >= 40", last, F.max("fig")).select("page", "tab", c("img.seq").alias("img")))


@query("layout_by_type", "FIL-20", """
SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY y1, seq) AS pos FROM fx_layout WHERE lower(label) = lower('Figure') AND score_pct >= 80""", uses="fx_layout")
def layout_by_type(spark, sf_dir):
    lay = relation(spark, sf_dir, "fx_layout").filter((F.lower("label") == "figure") & (c("score_pct") >= 80))
    return lay.select("page", "seq", F.row_number().over(Window.partitionBy("page").orderBy("y1", "seq")).alias("pos"))


@query("table_bbox_regions", "FIL-21", """
WITH r AS (SELECT * FROM fx_layout WHERE (label = 'table' AND score_pct >= 20) OR (label = 'figure' AND score_pct >= 70)), w AS (SELECT page, min(x1) AS lo, max(x2) AS hi FROM fx_layout WHERE label = 'text' AND score_pct >= 70 GROUP BY page)
SELECT r.page, r.seq, least(r.x1, coalesce(w.lo, r.x1)) - 5 AS x1, r.y1 - 5 AS y1, greatest(r.x2, coalesce(w.hi, r.x2)) + 5 AS x2, r.y2 + 5 AS y2 FROM r LEFT JOIN w ON r.page = w.page""", uses="fx_layout")
def table_bbox_regions(spark, sf_dir):
    """Table and figure regions widened to the x range of the page's text."""
    lay = relation(spark, sf_dir, "fx_layout")
    text = lay.filter("label = 'text' AND score_pct >= 70").groupBy("page").agg(F.min("x1").alias("lo"), F.max("x2").alias("hi"))
    r = lay.filter("(label = 'table' AND score_pct >= 20) OR (label = 'figure' AND score_pct >= 70)").join(text, "page", "left")
    lo, hi = F.least("x1", F.coalesce("lo", "x1")), F.greatest("x2", F.coalesce("hi", "x2"))
    return r.select("page", "seq", (lo - 5).alias("x1"), (c("y1") - 5).alias("y1"), (hi + 5).alias("x2"), (c("y2") + 5).alias("y2"))


_s("rect_inter", "FIL-22", lambda: ((c("bx1").between(c("ax1"), c("ax2"))) | (c("bx2").between(c("ax1"), c("ax2")))) & ((c("by1").between(c("ay1"), c("ay2"))) | (c("by2").between(c("ay1"), c("ay2")))),
   "(bx1 BETWEEN ax1 AND ax2 OR bx2 BETWEEN ax1 AND ax2) AND (by1 BETWEEN ay1 AND ay2 OR by2 BETWEEN ay1 AND ay2)")


def _in_polygon():
    """A point lies in a convex quad if it is on one side of all its edges."""
    pts = [("ax1", "ay1"), ("ax2", "by1"), ("ax2", "ay2"), ("ax1", "by2")]
    px, py = (c("bx1") + c("bx2")) / 2, (c("by1") + c("by2")) / 2
    side = [(c(v[0]) - c(u[0])) * (py - c(u[1])) - (c(v[1]) - c(u[1])) * (px - c(u[0])) for u, v in zip(pts, pts[1:] + pts[:1])]
    return F.least(*side) >= 0


_PG = [("ax1", "ay1"), ("ax2", "by1"), ("ax2", "ay2"), ("ax1", "by2")]
_s("point_in_polygon", "FIL-23", _in_polygon, "least(" + ", ".join(f"({v[0]} - {u[0]}) * ((by1 + by2) / 2 - {u[1]}) - ({v[1]} - {u[1]}) * ((bx1 + bx2) / 2 - {u[0]})" for u, v in zip(_PG, _PG[1:] + _PG[:1])) + ") >= 0")


@query("filter_top_scores", "FIL-24", """
SELECT id FROM (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY id) AS pos, count(*) FILTER (score_pct >= 15) OVER (PARTITION BY grp) AS n FROM boxes) WHERE pos <= n""", uses="boxes")
def filter_top_scores(spark, sf_dir):
    """The first n rows of each image, n being the number of rows that score enough."""
    b = relation(spark, sf_dir, "boxes")
    n = F.count_if(c("score_pct") >= 15).over(Window.partitionBy("grp"))
    return b.withColumns({"pos": F.row_number().over(Window.partitionBy("grp").orderBy("id")), "n": n}).filter("pos <= n").select("id")


_s("remove_empty_bboxes", "FIL-27", lambda: F.aggregate(F.array("ax1", "ay1", c("row_idx") - 1.0), d(0), lambda a, v: a + v) != 0, "ax1 + ay1 + (row_idx - 1) <> 0")


@query("filter_ocr_result", "FIL-28", """
SELECT t.table_id, t.seq FROM fx_text t JOIN (SELECT table_id, min(y1) AS top FROM fx_pred GROUP BY table_id) p ON p.table_id = t.table_id WHERE t.y1 >= p.top""", uses="fx_text fx_pred")
def filter_ocr_result(spark, sf_dir):
    top = relation(spark, sf_dir, "fx_pred").groupBy("table_id").agg(F.min("y1").alias("top"))
    return relation(spark, sf_dir, "fx_text").join(top, "table_id").filter("y1 >= top").select("table_id", "seq")


_s("bbox_intersect", "FIL-29", lambda: (c("ax2") >= c("bx1")) & (c("bx2") >= c("ax1")) & (c("ay2") >= c("by1")) & (c("by2") >= c("ay1")), "ax2 >= bx1 AND bx2 >= ax1 AND ay2 >= by1 AND by2 >= ay1")
_s("bbox_longer", "FIL-30", lambda: (c("ax2") - c("ax1")) >= (c("bx2") - c("bx1")), "ax2 - ax1 >= bx2 - bx1")


@query("segments_in_bbox", "FIL-31..32 JOI-41..44", """
SELECT s.table_id, s.seq, c.cell_id FROM fx_seg s JOIN fx_cells c ON c.table_id = s.table_id AND s.x0 > c.x1 - 2 AND s.x1 < c.x2 + 2 AND s.y BETWEEN c.y1 AND c.y2""", uses="fx_seg fx_cells")
def segments_in_bbox(spark, sf_dir):
    s, cl = relation(spark, sf_dir, "fx_seg").alias("s"), relation(spark, sf_dir, "fx_cells").alias("c")
    on = (c("s.table_id") == c("c.table_id")) & (c("s.x0") > c("c.x1") - 2) & (c("s.x1") < c("c.x2") + 2) & c("s.y").between(c("c.y1"), c("c.y2"))
    return s.join(cl, on).select("s.table_id", "s.seq", "c.cell_id")


_s("line_in_box", "FIL-33", lambda: (c("bx1") >= c("ax1") - 2) & (c("bx2") <= c("ax2") + 2) & (c("by1") >= c("ay1") - 2) & (c("by1") <= c("ay2") + 2), "bx1 >= ax1 - 2 AND bx2 <= ax2 + 2 AND by1 >= ay1 - 2 AND by1 <= ay2 + 2")
_s("filter_image", "FIL-34", lambda: {"small": g.area(A()) < 200, "kept": g.area(A()) >= 200}, {"small": "(ax2 - ax1) * (ay2 - ay1) < 200", "kept": "(ax2 - ax1) * (ay2 - ay1) >= 200"})
_s("filter_image_page", "FIL-35", lambda: (g.area(A()) < 100) | (F.least(c("ax2") - c("ax1"), c("ay2") - c("ay1")) <= 8), "(ax2 - ax1) * (ay2 - ay1) < 100 OR least(ax2 - ax1, ay2 - ay1) <= 8")
_s("lines_by_y", "FIL-36..37", lambda: (c("by1") > c("ay1") - 2) & (c("by1") < c("ay2") + 2), "by1 > ay1 - 2 AND by1 < ay2 + 2")


def _table_line():
    w, h = c("ax2") - c("ax1"), c("by2") - c("by1")
    return F.when((h < 8) & (w > 8), F.concat(F.lit("H"), ((c("by1") + c("by2")) / 2).cast("string"))).when((w < 8) & (h > 8), F.concat(F.lit("V"), ((c("ax1") + c("ax2")) / 2).cast("string")))


_s("extract_table_line", "FIL-38 SRC-18", _table_line, "CASE WHEN by2 - by1 < 8 AND ax2 - ax1 > 8 THEN concat('H', CAST((by1 + by2) / 2 AS VARCHAR)) WHEN ax2 - ax1 < 8 AND by2 - by1 > 8 THEN concat('V', CAST((ax1 + ax2) / 2 AS VARCHAR)) END")


@query("table_joint_points", "FIL-39", """
SELECT id, x, y FROM (SELECT id, grp, (ax1 + ax2) / 2 AS x, (ay1 + ay2) / 2 AS y, row_number() OVER (PARTITION BY grp, round_even((ax1 + ax2) / 2, 0), round_even((ay1 + ay2) / 2, 0) ORDER BY id) AS rn FROM boxes WHERE ax2 - ax1 < 12 AND ay2 - ay1 < 12) WHERE rn = 1""", uses="boxes")
def table_joint_points(spark, sf_dir):
    """Centres of small rectangles; of those with one rounded key the first."""
    x, y = g.centre(A())
    b = relation(spark, sf_dir, "boxes").filter((c("ax2") - c("ax1") < 12) & (c("ay2") - c("ay1") < 12)).select("id", "grp", x.alias("x"), y.alias("y"))
    w = Window.partitionBy("grp", F.bround("x", 0), F.bround("y", 0)).orderBy("id")
    return b.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "x", "y")


@query("joint_points_outside_images", "FIL-40..41", """
SELECT t.page, t.seq FROM fx_layout t WHERE t.label = 'title' AND NOT exists(SELECT 1 FROM fx_layout i WHERE i.page = t.page AND i.label = 'figure' AND t.x1 BETWEEN i.x1 - 2 AND i.x2 + 2 AND t.y1 BETWEEN i.y1 - 2 AND i.y2 + 2)""", uses="fx_layout")
def joint_points_outside_images(spark, sf_dir):
    """Titles that start in no figure; points and figures that occur often are compared once."""
    lay = Layout(spark, sf_dir)
    titles = lay.once.filter("label = 'title'")
    t = titles.select("page", "x1", "y1").distinct().alias("t")
    i = lay.once.filter("label = 'figure'").select("page", "x1", "y1", "x2", "y2").distinct().alias("i")
    on = (c("t.page") == c("i.page")) & c("t.x1").between(c("i.x1") - 2, c("i.x2") + 2) & c("t.y1").between(c("i.y1") - 2, c("i.y2") + 2)
    return lay.on_pages(titles.join(t.join(i, on, "left_anti"), ["page", "x1", "y1"], "left_semi").select("page", "seq"))


_s("filter_tag_det_res", "FIL-42", lambda: (g.clip(c("bx2"), 0, 119) - g.clip(c("bx1"), 0, 119) > 3) & (g.clip(c("by2"), 0, 99) - g.clip(c("by1"), 0, 99) > 3),
   "least(greatest(bx2, 0), 119) - least(greatest(bx1, 0), 119) > 3 AND least(greatest(by2, 0), 99) - least(greatest(by1, 0), 99) > 3")
_s("judge_quad", "FIL-43", lambda: (F.size(F.array_distinct(F.array("ax1", "bx1", "ax2", "bx2"))) >= 2) & (F.size(F.array_distinct(F.array("ay1", "by1", "ay2", "by2"))) >= 2), "len(list_distinct([ax1, bx1, ax2, bx2])) >= 2 AND len(list_distinct([ay1, by1, ay2, by2])) >= 2")
_s("check_rotate", "FIL-44", lambda: (c("score_pct") > 60) & (c("grp").cast("string") != "0"), "score_pct > 60 AND CAST(grp AS VARCHAR) <> '0'")
_s("line_can_merge", "FIL-45..47", lambda: F.when(c("grp") % 2 == 0, (c("bx1") <= c("ax2") + 2) & (c("ax1") <= c("bx2") + 2)).otherwise((c("by1") <= c("ay2") + 2) & (c("ay1") <= c("by2") + 2)),
   "CASE WHEN grp % 2 = 0 THEN bx1 <= ax2 + 2 AND ax1 <= bx2 + 2 ELSE by1 <= ay2 + 2 AND ay1 <= by2 + 2 END")
_s("have_interaction", "FIL-48", lambda: F.greatest("ax1", "bx1") <= F.least("ax2", "bx2"), "greatest(ax1, bx1) <= least(ax2, bx2)")


@query("check_line_exist", "FIL-49", """
WITH o AS (SELECT table_id, x0, x1, max(x1) OVER (PARTITION BY table_id ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM fx_seg)
SELECT table_id, sum(greatest(x1 - greatest(x0, coalesce(far, x0)), 0)) / 400e0 >= 0.7 AS v FROM o GROUP BY table_id""", uses="fx_seg")
def check_line_exist(spark, sf_dir):
    """The union of the segments covers 0.7 of the line."""
    w = Window.partitionBy("table_id").orderBy("x0", "x1", "seq").rowsBetween(Window.unboundedPreceding, -1)
    far = F.max("x1").over(w)
    s = relation(spark, sf_dir, "fx_seg").withColumn("new", F.greatest(c("x1") - F.greatest("x0", F.coalesce(far, "x0")), F.lit(0)))
    return s.groupBy("table_id").agg((F.sum("new") / d(400) >= 0.7).alias("v"))


_NUM = lambda: F.concat_ws(".", (c("k") % 7).cast("string"), c("grp").cast("string"), F.when(c("row_idx") > 3, F.lit("5")))
_NUMQ = "concat_ws('.', CAST(k % 7 AS VARCHAR), CAST(grp AS VARCHAR), CASE WHEN row_idx > 3 THEN '5' END)"
_s("is_ocr_number", "FIL-50", lambda: _NUM().rlike("^[-0-9.,]*$") & (F.length(_NUM()) - F.length(F.replace(_NUM(), F.lit("."), F.lit(""))) > 1),
   f"regexp_matches({_NUMQ}, '^[-0-9.,]*$') AND length({_NUMQ}) - length(replace({_NUMQ}, '.', '')) > 1")
_s("match_none_zh", "FIL-51", lambda: F.concat(F.lit("中文"), F.when(c("p_size") % 2 == 0, F.substring("p_name", 1, 1)).otherwise("")).rlike("[^一-龥]"),
   "regexp_matches(concat('中文', CASE WHEN p_size % 2 = 0 THEN substr(p_name, 1, 1) ELSE '' END), '[^一-龥]')", base="part", keys="p_partkey")
_s("match_pattern_flag", "FIL-52", lambda: c("p_name").rlike("a.*e"), "regexp_matches(p_name, 'a.*e')", base="part", keys="p_partkey")
_FN = "concat('m', p_partkey, CASE p_size % 4 WHEN 0 THEN '.pth' WHEN 1 THEN '.onnx' WHEN 2 THEN '.txt' ELSE '.bin' END)"
_s("is_model_weight_file", "FIL-53", lambda: F.expr(_FN).rlike(r"\.(pth|pt|onnx|bin|pdparams|safetensors)$"), f"regexp_matches({_FN}, '\\.(pth|pt|onnx|bin|pdparams|safetensors)$')", base="part", keys="p_partkey")
_s("ids_greater_than", "FIL-54", lambda: F.array_join(F.transform(F.filter(F.transform(F.array(c("ax1"), c("ay1"), c("bx1"), c("by1")), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["v"] > 90), lambda s: s["i"].cast("string")), ","),
   "concat_ws(',', CASE WHEN ax1 > 90 THEN 0 END, CASE WHEN ay1 > 90 THEN 1 END, CASE WHEN bx1 > 90 THEN 2 END, CASE WHEN by1 > 90 THEN 3 END)")


def _in_rbox():
    """In the box's own axes the point is nearer to its centre than half its sides."""
    t = c("score_pct") * d(0.03)
    dx, dy = c("bx1") - (c("ax1") + c("ax2")) / 2, c("by1") - (c("ay1") + c("ay2")) / 2
    u, v = F.round(dx * F.cos(t) + dy * F.sin(t), 6), F.round(dy * F.cos(t) - dx * F.sin(t), 6)
    return (F.abs(u) < (c("ax2") - c("ax1")) / 2) & (F.abs(v) < (c("ay2") - c("ay1")) / 2)


_U = "(bx1 - (ax1 + ax2) / 2)"
_V = "(by1 - (ay1 + ay2) / 2)"
_s("point_in_rbox", "FIL-55", _in_rbox, f"abs(round({_U} * cos(score_pct * 0.03e0) + {_V} * sin(score_pct * 0.03e0), 6)) < (ax2 - ax1) / 2 AND abs(round({_V} * cos(score_pct * 0.03e0) - {_U} * sin(score_pct * 0.03e0), 6)) < (ay2 - ay1) / 2")
_s("is_text_cell", "FIL-56", lambda: c("label") == "text", "label = 'text'", base="fx_layout", keys="page seq")
_s("is_line_cell_model", "FIL-57", lambda: c("p_type").isin("LineCell", "LineCellPdf"), "p_type IN ('LineCell', 'LineCellPdf')", base="part", keys="p_partkey")
_s("add_box_to_image", "FIL-58", lambda: {"x1": F.when((c("by1") >= c("ay1") - 3) & (c("by2") <= c("ay2") + 3) & (c("bx1") < c("ax1")) & (c("bx2") > c("ax1") - 10), c("ax1")).when((c("bx1") >= c("ax1") - 10) & (c("bx2") <= c("ax2") + 10) & (c("by1") >= c("ay1") - 3) & (c("by2") <= c("ay2") + 3), c("bx1"))},
   {"x1": "CASE WHEN by1 >= ay1 - 3 AND by2 <= ay2 + 3 AND bx1 < ax1 AND bx2 > ax1 - 10 THEN ax1 WHEN bx1 >= ax1 - 10 AND bx2 <= ax2 + 10 AND by1 >= ay1 - 3 AND by2 <= ay2 + 3 THEN bx1 END"})
_s("cells_to_merge", "", lambda: {"by_column": ~((c("score_pct") % 2 == 0) & (c("score_pct") % 3 == 0)), "by_row": ~((c("score_pct") % 5 == 0) & (c("score_pct") % 7 == 0))},
   {"by_column": "NOT (score_pct % 2 = 0 AND score_pct % 3 = 0)", "by_row": "NOT (score_pct % 5 = 0 AND score_pct % 7 = 0)"})
