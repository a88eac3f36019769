"""Joins of texts, cells, segments and layout: one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins as j
from ..registry import query
from .relations import relation

c = F.col
K = ["table_id"]


def _text(spark, d):
    return relation(spark, d, "fx_text").select("table_id", "seq", c("x0").alias("x1"), c("y0").alias("y1"), c("x1").alias("x2"), c("y1").alias("y2"), "text")


def _cells(spark, d):
    return relation(spark, d, "fx_cells").select("table_id", c("cell_id").alias("seq"), "x1", "y1", "x2", "y2")


_IN = "(t.x0 + t.x1) / 2 BETWEEN c.x1 - 2 AND c.x2 + 2 AND (t.y0 + t.y1) / 2 BETWEEN c.y1 - 2 AND c.y2 + 2"
_OV = "(CASE WHEN least(t.x1, c.x2) > greatest(t.x0, c.x1) AND least(t.y1, c.y2) > greatest(t.y0, c.y1) THEN CAST((least(t.x1, c.x2) - greatest(t.x0, c.x1)) * (least(t.y1, c.y2) - greatest(t.y0, c.y1)) AS DOUBLE) ELSE 0e0 END)"
_IOU = f"({_OV} / ((t.x1 - t.x0) * (t.y1 - t.y0) + (c.x2 - c.x1) * (c.y2 - c.y1) - {_OV}))"
_L1 = "(abs(c.x1 - t.x0) + abs(c.y1 - t.y0) + abs(c.x2 - t.x1) + abs(c.y2 - t.y1) + least(abs(c.x1 - t.x0) + abs(c.y1 - t.y0), abs(c.x2 - t.x1) + abs(c.y2 - t.y1)))"


@query("text_in_table_bbox", "JOI-01..03", f"SELECT t.table_id, t.seq, c.cell_id AS cell FROM fx_text t JOIN fx_cells c ON t.table_id = c.table_id AND {_IN}", uses="fx_text fx_cells")
def text_in_table_bbox(spark, d):
    return j.containment(_text(spark, d), _cells(spark, d), K).select("table_id", c("t_seq").alias("seq"), c("c_seq").alias("cell"))


@query("text_left_over", "JOI-15 FIL-59", f"SELECT t.table_id, t.seq FROM fx_text t WHERE NOT exists(SELECT 1 FROM fx_cells c WHERE t.table_id = c.table_id AND {_IN})", uses="fx_text fx_cells")
def text_left_over(spark, d):
    t = _text(spark, d)
    hit = j.containment(t, _cells(spark, d), K).select("table_id", c("t_seq").alias("seq")).distinct()
    return t.join(hit, ["table_id", "seq"], "left_anti").select("table_id", "seq")


_BEST = f"""best AS (SELECT table_id, seq, cell_id AS cell, inside, text FROM (SELECT t.table_id, t.seq, t.text, c.cell_id, {_IN} AS inside,
 row_number() OVER (PARTITION BY t.table_id, t.seq ORDER BY CASE WHEN {_IN} THEN 0 ELSE 1 END, CASE WHEN {_IN} THEN 0 ELSE 1 - {_IOU} END, CASE WHEN {_IN} THEN 0 ELSE {_L1} END, c.cell_id) AS rn
 FROM fx_text t JOIN fx_cells c ON t.table_id = c.table_id) WHERE rn = 1)"""


@query("find_top1_mach_box", "JOI-04..05", f"WITH {_BEST} SELECT table_id, seq, cell, inside FROM best", uses="fx_text fx_cells")
def find_top1_mach_box(spark, d):
    return j.best_cell(_text(spark, d), _cells(spark, d), K)


@query("match_table_cell_and_text_cell", "JOI-06..09 WIN-24", f"""WITH {_BEST}, m AS (SELECT b.table_id, b.cell, string_agg(b.text, ' ' ORDER BY t.y0, t.x0, t.seq) AS text FROM best b JOIN fx_text t ON t.table_id = b.table_id AND t.seq = b.seq GROUP BY b.table_id, b.cell)
SELECT c.table_id, c.cell_id AS cell, coalesce(m.text, '') AS text FROM fx_cells c LEFT JOIN m ON m.table_id = c.table_id AND m.cell = c.cell_id""", uses="fx_text fx_cells")
def match_table_cell_and_text_cell(spark, d):
    """Texts of each cell in reading order; cells without text stay."""
    t, cells = _text(spark, d), _cells(spark, d)
    best = j.best_cell(t, cells, K).join(t, ["table_id", "seq"])
    words = F.array_sort(F.collect_list(F.struct("y1", "x1", "seq", "text")))
    m = best.groupBy("table_id", "cell").agg(F.array_join(F.transform(words, lambda s: s["text"]), " ").alias("text"))
    return cells.select("table_id", c("seq").alias("cell")).join(m, ["table_id", "cell"], "left").select("table_id", "cell", F.coalesce("text", F.lit("")).alias("text"))


@query("text_to_cell_html", "STR-15..18 JOI-75 JOI-76 STR-99 SRT-46", f"""WITH {_BEST}, m AS (SELECT b.table_id, b.cell, string_agg(b.text, ' ' ORDER BY t.y0, t.x0, t.seq) AS text FROM best b JOIN fx_text t ON t.table_id = b.table_id AND t.seq = b.seq GROUP BY b.table_id, b.cell),
r AS (SELECT c.table_id, c.row_idx, concat('<tr>', string_agg(concat('<td>', coalesce(m.text, ''), '</td>'), '' ORDER BY c.col_idx), '</tr>') AS tr FROM fx_cells c LEFT JOIN m ON m.table_id = c.table_id AND m.cell = c.cell_id GROUP BY c.table_id, c.row_idx)
SELECT table_id, concat('<table>', string_agg(tr, '' ORDER BY row_idx), '</table>') AS html FROM r GROUP BY table_id""", uses="fx_text fx_cells")
def text_to_cell_html(spark, d):
    """Table HTML from texts and cells: top-1 join, reading order, rows, table."""
    cells = relation(spark, d, "fx_cells").select("table_id", c("cell_id").alias("cell"), "row_idx", "col_idx")
    filled = match_table_cell_and_text_cell(spark, d).join(cells, ["table_id", "cell"])
    td = F.concat(F.lit("<td>"), "text", F.lit("</td>"))
    rows = F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", td.alias("td"))))
    per = filled.groupBy("table_id").agg(rows.alias("cells"))
    opened = F.transform("cells", lambda s, i: F.concat(F.when((s["col_idx"] == 0) & (i > 0), "</tr><tr>").when(i == 0, "<tr>").otherwise(""), s["td"]))
    return per.select("table_id", F.concat(F.lit("<table>"), F.array_join(opened, ""), F.lit("</tr></table>")).alias("html"))


@query("match_result", "JOI-10..11", f"""SELECT table_id, seq, cell_id AS cell FROM (SELECT t.table_id, t.seq, c.cell_id, row_number() OVER (PARTITION BY t.table_id, t.seq ORDER BY 1 - {_IOU}, {_L1}, c.cell_id) AS rn FROM fx_text t JOIN fx_cells c ON t.table_id = c.table_id) WHERE rn = 1""", uses="fx_text fx_cells")
def match_result(spark, d):
    """Nearest cell by IoU, then distance."""
    t, cl = j._prefixed(_text(spark, d), "t_", K), j._prefixed(_cells(spark, d), "c_", K)
    tb, cb = j._box("t_"), j._box("c_")
    key = F.struct((1 - g.iou(tb, cb)).alias("a"), g.corner_distance(tb, cb).alias("b"), c("c_seq").alias("cell"))
    return t.join(cl, K).groupBy("table_id", "t_seq").agg(F.min(key).alias("m")).select("table_id", c("t_seq").alias("seq"), c("m.cell").alias("cell"))


_CIN = "(t.x0 + t.x1) / 2 > c.x1 AND (t.x0 + t.x1) / 2 < c.x2 AND (t.y0 + t.y1) / 2 > c.y1 AND (t.y0 + t.y1) / 2 < c.y2"
_F = "(greatest(t.x1, c.x2) - least(t.x0, c.x1)) * (greatest(t.y1, c.y2) - least(t.y0, c.y1))"
_CUT = " + ".join(f"CASE WHEN (t.{tx} = {f}(t.{tx}, c.{cx}) AND t.{ty} = {h}(t.{ty}, c.{cy})) OR (c.{cx} = {f}(t.{tx}, c.{cx}) AND c.{cy} = {h}(t.{ty}, c.{cy})) THEN 0e0 ELSE abs(t.{tx} - c.{cx}) * abs(t.{ty} - c.{cy}) / 2 END"
                  for tx, ty, cx, cy, f, h in (("x0", "y0", "x1", "y1", "least", "least"), ("x1", "y0", "x2", "y1", "greatest", "least"), ("x1", "y1", "x2", "y2", "greatest", "greatest"), ("x0", "y1", "x1", "y2", "least", "greatest")))
_CASCADE = f"""WITH one AS (SELECT t.table_id, t.seq AS t_seq, c.cell_id AS c_seq, 1 AS stage FROM fx_text t JOIN fx_cells c ON t.table_id = c.table_id AND {_CIN}),
l1 AS (SELECT * FROM fx_text t WHERE NOT exists(SELECT 1 FROM one o WHERE o.table_id = t.table_id AND o.t_seq = t.seq)),
h AS (SELECT t.table_id, t.seq AS t_seq, c.cell_id AS c_seq, round({_OV} / ({_F} - ({_CUT})), 9) AS h FROM l1 t JOIN fx_cells c ON t.table_id = c.table_id),
two AS (SELECT table_id, t_seq, c_seq, 2 AS stage FROM (SELECT *, row_number() OVER (PARTITION BY table_id, t_seq ORDER BY h DESC, c_seq) AS rn FROM h WHERE h > 0) WHERE rn = 1),
l2 AS (SELECT * FROM l1 t WHERE NOT exists(SELECT 1 FROM two o WHERE o.table_id = t.table_id AND o.t_seq = t.seq)),
done AS (SELECT * FROM one UNION ALL SELECT * FROM two),
bare AS (SELECT * FROM fx_cells c WHERE NOT exists(SELECT 1 FROM done o WHERE o.table_id = c.table_id AND o.c_seq = c.cell_id)),
three AS (SELECT table_id, t_seq, c_seq, 3 AS stage FROM (SELECT c.table_id, t.seq AS t_seq, c.cell_id AS c_seq, row_number() OVER (PARTITION BY c.table_id, c.cell_id ORDER BY {_L1}, t.seq) AS rn FROM bare c JOIN l2 t ON t.table_id = c.table_id) WHERE rn = 1),
l3 AS (SELECT * FROM l2 t WHERE NOT exists(SELECT 1 FROM three o WHERE o.table_id = t.table_id AND o.t_seq = t.seq)),
four AS (SELECT l3.table_id, l3.seq AS t_seq, n + row_number() OVER (PARTITION BY l3.table_id ORDER BY y0, x0, seq) AS c_seq, 4 AS stage FROM l3 JOIN (SELECT table_id, max(cell_id) AS n FROM fx_cells GROUP BY table_id) s ON s.table_id = l3.table_id)
"""


def _staged(spark, d):
    return j.cascade(_text(spark, d), _cells(spark, d), K)


@query("matcher_match", "JOI-18..19", _CASCADE + "SELECT * FROM done UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four", uses="fx_text fx_cells")
def matcher_match(spark, d):
    return _staged(spark, d)


@query("center_rule_match", "JOI-12", _CASCADE + "SELECT * FROM one", uses="fx_text fx_cells")
def center_rule_match(spark, d):
    return _staged(spark, d).filter("stage = 1")


@query("iou_rule_match", "JOI-13", _CASCADE + "SELECT * FROM two", uses="fx_text fx_cells")
def iou_rule_match(spark, d):
    return _staged(spark, d).filter("stage = 2")


@query("distance_rule_match", "JOI-14", _CASCADE + "SELECT * FROM three", uses="fx_text fx_cells")
def distance_rule_match(spark, d):
    return _staged(spark, d).filter("stage = 3")


@query("extra_match", "JOI-16", """WITH b AS (SELECT table_id, seq, y0, x0 FROM fx_text WHERE x0 < 0)
SELECT b.table_id, b.seq, n + row_number() OVER (PARTITION BY b.table_id ORDER BY y0, x0, seq) - 1 AS cell FROM b JOIN (SELECT table_id, count(*) AS n FROM fx_cells GROUP BY table_id) s ON s.table_id = b.table_id""", uses="fx_text fx_cells")
def extra_match(spark, d):
    """Texts left of their table get new cells after the last, in reading order."""
    n = relation(spark, d, "fx_cells").groupBy("table_id").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("table_id").orderBy("y0", "x0", "seq"))
    return relation(spark, d, "fx_text").filter("x0 < 0").withColumn("r", r).join(n, "table_id").select("table_id", "seq", (c("n") + c("r") - 1).alias("cell"))


@query("match_dict", "JOI-17", _CASCADE + "SELECT table_id, c_seq AS cell, string_agg(CAST(t_seq AS VARCHAR), ',' ORDER BY stage, t_seq) AS texts FROM (SELECT * FROM done UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four) GROUP BY table_id, c_seq", uses="fx_text fx_cells")
def match_dict(spark, d):
    s = F.array_sort(F.collect_list(F.struct("stage", "t_seq")))
    return _staged(spark, d).groupBy("table_id", c("c_seq").alias("cell")).agg(F.array_join(F.transform(s, lambda x: x["t_seq"].cast("string")), ",").alias("texts"))


@query("ocr_result_matching", "JOI-20", f"""SELECT c.table_id, c.cell_id AS cell, string_agg(t.text, ' ' ORDER BY t.y0, t.seq) AS text FROM fx_cells c JOIN fx_text t ON t.table_id = c.table_id AND {_OV} / least((t.x1 - t.x0) * (t.y1 - t.y0), (c.x2 - c.x1) * (c.y2 - c.y1)) >= 0.75 GROUP BY c.table_id, c.cell_id""", uses="fx_text fx_cells")
def ocr_result_matching(spark, d):
    t, cl = j._prefixed(_text(spark, d), "t_", K), j._prefixed(_cells(spark, d), "c_", K)
    hit = t.join(cl, K).filter(g.overlap_of_smaller(j._box("t_"), j._box("c_")) >= 0.75)
    s = F.array_sort(F.collect_list(F.struct("t_y1", "t_seq", "t_text")))
    return hit.groupBy("table_id", c("c_seq").alias("cell")).agg(F.array_join(F.transform(s, lambda x: x["t_text"]), " ").alias("text"))


_GP = "(CASE WHEN least(g.x2, p.x2) > greatest(g.x1, p.x1) AND least(g.y2, p.y2) > greatest(g.y1, p.y1) THEN CAST((least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS DOUBLE) ELSE 0e0 END)"
_GPIOU = f"{_GP} / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - {_GP})"


@query("pair_table_matching", "JOI-21", f"""SELECT g.table_id, g.seq, min(p.seq) AS pred FROM fx_gt g LEFT JOIN fx_pred p ON p.table_id = g.table_id AND {_GPIOU} >= 0.5 GROUP BY g.table_id, g.seq""", uses="fx_gt fx_pred")
def pair_table_matching(spark, d):
    return j.first_match(relation(spark, d, "fx_gt"), relation(spark, d, "fx_pred"), K)


@query("find_char_belong_cell", "JOI-25..27", """WITH ch AS (SELECT table_id, seq, i, x0 + i * (x1 - x0) / CAST(length(text) AS DOUBLE) AS l, x0 + (i + 1) * (x1 - x0) / CAST(length(text) AS DOUBLE) AS r, y0, y1 FROM fx_text, unnest(range(length(text))) u(i))
SELECT ch.table_id, ch.seq, CAST(ch.i AS INT) AS i, min(c.cell_id) AS cell FROM ch JOIN fx_cells c ON c.table_id = ch.table_id AND (ch.y0 + ch.y1) / 2 BETWEEN c.y1 AND c.y2 AND ((l >= c.x1 - 2 AND r <= c.x2 + 2) OR (l < c.x1 AND r > c.x1 AND (r - c.x1) > 0.3 * (r - l))) GROUP BY ch.table_id, ch.seq, ch.i""", uses="fx_text fx_cells")
def find_char_belong_cell(spark, d):
    """Characters of equal width; the first cell that holds one, or that it overhangs to the left by under 0.7 of its width."""
    t = relation(spark, d, "fx_text")
    n = F.length("text").cast("double")
    ch = t.select("table_id", "seq", "y0", "y1", "x0", "x1", n.alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("i"))
    ch = ch.select("table_id", "seq", "i", "y0", "y1", (c("x0") + c("i") * (c("x1") - c("x0")) / c("n")).alias("l"), (c("x0") + (c("i") + 1) * (c("x1") - c("x0")) / c("n")).alias("r"))
    cl = _cells(spark, d).select("table_id", c("seq").alias("cell"), *[c(x).alias("c" + x) for x in ("x1", "y1", "x2", "y2")])
    row = ((c("y0") + c("y1")) / 2).between(c("cy1"), c("cy2"))
    held = (c("l") >= c("cx1") - 2) & (c("r") <= c("cx2") + 2) | (c("l") < c("cx1")) & (c("r") > c("cx1")) & (c("r") - c("cx1") > 0.3 * (c("r") - c("l")))
    return ch.join(cl, "table_id").filter(row & held).groupBy("table_id", "seq", "i").agg(F.min("cell").alias("cell"))


@query("cell_cross_text_cell", "JOI-28..30", """SELECT t.table_id, t.seq, string_agg(CAST(c.cell_id AS VARCHAR), ',' ORDER BY c.x1, c.cell_id) AS cells FROM fx_text t JOIN fx_cells c ON c.table_id = t.table_id AND (t.y0 + t.y1) / 2 BETWEEN c.y1 - 2 AND c.y2 + 2 AND NOT (t.x1 < c.x1 - 2 OR t.x0 > c.x2 - 2) GROUP BY t.table_id, t.seq""", uses="fx_text fx_cells")
def cell_cross_text_cell(spark, d):
    """Cells of the text's row that are not apart from it in x; the tolerance is subtracted on both sides."""
    t, cl = j._prefixed(_text(spark, d), "t_", K), j._prefixed(_cells(spark, d), "c_", K)
    hit = ((c("t_y1") + c("t_y2")) / 2).between(c("c_y1") - 2, c("c_y2") + 2) & ~((c("t_x2") < c("c_x1") - 2) | (c("t_x1") > c("c_x2") - 2))
    s = F.array_sort(F.collect_list(F.struct("c_x1", "c_seq")))
    return t.join(cl, K).filter(hit).groupBy("table_id", c("t_seq").alias("seq")).agg(F.array_join(F.transform(s, lambda x: x["c_seq"].cast("string")), ",").alias("cells"))


@query("cells_in_line_pair", "JOI-31 JOI-51..53", """SELECT table_id, cell_id, row_number() OVER (PARTITION BY table_id ORDER BY x1, y1, cell_id) AS pos FROM fx_cells WHERE x1 >= 100 - 2 AND x2 <= 300 + 2""", uses="fx_cells")
def cells_in_line_pair(spark, d):
    r = F.row_number().over(Window.partitionBy("table_id").orderBy("x1", "y1", "cell_id"))
    return relation(spark, d, "fx_cells").filter("x1 >= 98 AND x2 <= 302").select("table_id", "cell_id", r.alias("pos"))


@query("split_text_cell", "", """WITH ch AS (SELECT table_id, seq, i, substr(text, i + 1, 1) AS ch, CAST(floor((x0 + (i + 0.5e0) * (x1 - x0) / CAST(length(text) AS DOUBLE)) / 100) AS BIGINT) AS col FROM fx_text, unnest(range(length(text))) u(i)),
f AS (SELECT *, CASE WHEN col BETWEEN 0 AND 3 THEN col END AS own FROM ch),
g AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY table_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cell FROM f)
SELECT table_id, seq, cell, string_agg(ch, '' ORDER BY i) AS text FROM g GROUP BY table_id, seq, cell""", uses="fx_text")
def split_text_cell(spark, d):
    """Each character goes to the column that holds its centre, one without to the one before it (the first to column 0)."""
    t = relation(spark, d, "fx_text")
    ch = t.select("table_id", "seq", "x0", "x1", F.posexplode(F.split("text", "")).alias("i", "ch"), F.length("text").cast("double").alias("n"))
    col = F.floor((c("x0") + (c("i") + 0.5) * (c("x1") - c("x0")) / c("n")) / 100)
    own = F.when(col.between(0, 3), col)
    w = Window.partitionBy("table_id", "seq").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = F.array_sort(F.collect_list(F.struct("i", "ch")))
    g_ = ch.withColumn("own", own).withColumn("cell", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit(0).cast("long")))
    return g_.groupBy("table_id", "seq", "cell").agg(F.array_join(F.transform(s, lambda x: x["ch"]), "").alias("text"))


@query("table_index", "JOI-40", """WITH o AS (SELECT t.table_id, t.seq, CAST(floor((t.y0 + t.y1) / 2e0 / 20) AS BIGINT) AS row_idx, c.col, greatest(least(t.x1, c.col * 100 + 100) - greatest(t.x0, c.col * 100), 0) / 100e0 AS share FROM fx_text t, (VALUES (0), (1), (2), (3)) c(col))
SELECT table_id, seq, row_idx, col, share FROM (SELECT *, row_number() OVER (PARTITION BY table_id, seq ORDER BY share DESC, col) AS rn FROM o) WHERE rn = 1""", uses="fx_text")
def table_index(spark, d):
    """Row by the centre, column by the largest share of the column's width."""
    t = relation(spark, d, "fx_text")
    share = lambda k: F.greatest(F.least("x1", k * 100 + 100) - F.greatest("x0", k * 100), F.lit(0)) / 100.0
    best = F.array_sort(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda k: F.struct((-share(k)).alias("s"), k.alias("col"))))[0]
    return t.select("table_id", "seq", F.floor((c("y0") + c("y1")) / 2.0 / 20).alias("row_idx"), best["col"].alias("col"), (-best["s"] + 0.0).alias("share"))


@query("cell_line_mark", "", """WITH m AS (SELECT table_id, max(row_idx) AS r FROM fx_cells GROUP BY table_id)
SELECT c.table_id, c.cell_id, c.row_idx = 0 OR pk % 3 = 0 AS top, c.row_idx = m.r OR sk % 3 = 0 AS bottom, c.col_idx = 0 OR pk % 2 = 0 AS is_left, c.col_idx = 3 OR sk % 2 = 0 AS is_right FROM fx_cells c JOIN m ON m.table_id = c.table_id""", uses="fx_cells")
def cell_line_mark(spark, d):
    """The outer border of the table is always there."""
    last = F.max("row_idx").over(Window.partitionBy("table_id"))
    cl = relation(spark, d, "fx_cells").withColumn("r", last)
    return cl.select("table_id", "cell_id", ((c("row_idx") == 0) | (c("pk") % 3 == 0)).alias("top"), ((c("row_idx") == c("r")) | (c("sk") % 3 == 0)).alias("bottom"),
                     ((c("col_idx") == 0) | (c("pk") % 2 == 0)).alias("is_left"), ((c("col_idx") == 3) | (c("sk") % 2 == 0)).alias("is_right"))


@query("page_blocks", "JOI-54..55 SET-02", """SELECT t.table_id, concat('TXT', t.seq) AS block, t.y0 AS y FROM fx_text t WHERE NOT exists(SELECT 1 FROM fx_seg s WHERE s.table_id = t.table_id AND s.x0 <= t.x0 AND s.x1 >= t.x1)
UNION ALL SELECT table_id, concat('TABLE', seq) AS block, y FROM fx_seg""", uses="fx_text fx_seg")
def page_blocks(spark, d):
    """Text that no table covers, and the tables."""
    t, s = relation(spark, d, "fx_text").alias("t"), relation(spark, d, "fx_seg").alias("s")
    free = t.join(s, (c("t.table_id") == c("s.table_id")) & (c("s.x0") <= c("t.x0")) & (c("s.x1") >= c("t.x1")), "left_anti")
    a = free.select("table_id", F.concat(F.lit("TXT"), c("seq").cast("string")).alias("block"), c("y0").alias("y"))
    return a.unionByName(relation(spark, d, "fx_seg").select("table_id", F.concat(F.lit("TABLE"), c("seq").cast("string")).alias("block"), "y"))


@query("batch_evaluate_pairs", "JOI-57 JOI-77", """SELECT g.table_id, g.seq, coalesce(concat_ws(',', p.x1, p.y1, p.x2, p.y2), '') AS pred FROM fx_gt g LEFT JOIN fx_pred p ON p.table_id = g.table_id AND p.seq = g.seq""", uses="fx_gt fx_pred")
def batch_evaluate_pairs(spark, d):
    """Every label with its prediction, empty if there is none."""
    p = relation(spark, d, "fx_pred").select("table_id", "seq", F.concat_ws(",", "x1", "y1", "x2", "y2").alias("pred"))
    return relation(spark, d, "fx_gt").select("table_id", "seq").join(p, ["table_id", "seq"], "left").select("table_id", "seq", F.coalesce("pred", F.lit("")).alias("pred"))


@query("zip_by_position", "JOI-58 SRC-41", """WITH a AS (SELECT table_id, seq, row_number() OVER (PARTITION BY table_id ORDER BY seq) AS i FROM fx_gt), b AS (SELECT table_id, seq, row_number() OVER (PARTITION BY table_id ORDER BY seq) AS i FROM fx_pred)
SELECT a.table_id, a.i, a.seq AS gt, b.seq AS pred FROM a JOIN b ON a.table_id = b.table_id AND a.i = b.i""", uses="fx_gt fx_pred")
def zip_by_position(spark, d):
    r = F.row_number().over(Window.partitionBy("table_id").orderBy("seq"))
    a = relation(spark, d, "fx_gt").select("table_id", r.alias("i"), c("seq").alias("gt"))
    return a.join(relation(spark, d, "fx_pred").select("table_id", r.alias("i"), c("seq").alias("pred")), ["table_id", "i"])


@query("boxes_adjacent", "JOI-74", """SELECT a.table_id, a.seq, count(*) FILTER ((a.y1 + a.y2) / 2e0 > b.y1 AND (a.y1 + a.y2) / 2e0 < b.y2) AS in_row, count(*) FILTER ((a.x1 + a.x2) / 2e0 > b.x1 AND (a.x1 + a.x2) / 2e0 < b.x2) AS in_col
FROM fx_pred a JOIN fx_pred b ON a.table_id = b.table_id AND a.seq <> b.seq GROUP BY a.table_id, a.seq""", uses="fx_pred")
def boxes_adjacent(spark, d):
    """How many boxes hold the centre of a box in their row, and in their column."""
    p = relation(spark, d, "fx_pred")
    a, b = j._prefixed(p, "a_", K), j._prefixed(p, "b_", K)
    y, x = (c("a_y1") + c("a_y2")) / 2.0, (c("a_x1") + c("a_x2")) / 2.0
    row, col = (y > c("b_y1")) & (y < c("b_y2")), (x > c("b_x1")) & (x < c("b_x2"))
    pairs = a.join(b, K).filter(c("a_seq") != c("b_seq"))
    return pairs.groupBy("table_id", c("a_seq").alias("seq")).agg(F.count_if(row).alias("in_row"), F.count_if(col).alias("in_col"))
