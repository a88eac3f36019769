"""Aggregations and evaluation measures: one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import d
from ..operators.joins import first_match
from ..registry import query, scalar
from .joins import _GPIOU, K
from .relations import relation

c = F.col


@query("compute_accuracy", "AGG-01", """SELECT page, coalesce(60 * avg(1 - score_pct / 100e0) FILTER (label = 'text'), 0) + coalesce(40 * avg(1 - score_pct / 100e0) FILTER (label <> 'text'), 0) AS v FROM fx_layout GROUP BY page""", uses="fx_layout")
def compute_accuracy(spark, sf):
    """Weighted means of one less the errors; a group without errors gives 0."""
    part = lambda w, on: F.coalesce(w * F.avg(F.when(on, 1 - c("score_pct") / 100.0)), d(0))
    out = relation(spark, sf, "fx_layout").groupBy("page").agg((part(60, c("label") == "text") + part(40, c("label") != "text")).alias("v"))
    return out


@query("compute_whitespace", "AGG-02", """SELECT c.table_id, 100e0 * avg(CASE WHEN t.text IS NULL OR trim(t.text) = '' THEN 1e0 ELSE 0e0 END) AS v FROM fx_cells c LEFT JOIN fx_text t ON t.table_id = c.table_id AND t.seq = c.cell_id GROUP BY c.table_id""", uses="fx_cells fx_text")
def compute_whitespace(spark, sf):
    t = relation(spark, sf, "fx_text").select("table_id", c("seq").alias("cell_id"), "text")
    j = relation(spark, sf, "fx_cells").join(t, ["table_id", "cell_id"], "left")
    return j.groupBy("table_id").agg((d(100) * F.avg(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1.0).otherwise(0.0))).alias("v"))


@query("text_bbox", "AGG-03", "SELECT table_id, min(x0) AS x1, min(y0) AS y1, max(x1) AS x2, max(y1) AS y2 FROM fx_text GROUP BY table_id", uses="fx_text")
def text_bbox(spark, sf):
    return relation(spark, sf, "fx_text").groupBy("table_id").agg(F.min("x0").alias("x1"), F.min("y0").alias("y1"), F.max("x1").alias("x2"), F.max("y1").alias("y2"))


scalar("parsing_report", "AGG-04", "boxes", "id", lambda: {"accuracy": F.bround(c("frac"), 2), "whitespace": F.bround(c("score_pct") / 8.0, 2)}, {"accuracy": "round_even(frac, 2)", "whitespace": "round_even(score_pct / 8e0, 2)"})


@query("calc_cell_width", "AGG-05", "SELECT grp, avg(round_even(abs(ax2 - bx1) / 2, 0)) FILTER (round_even(abs(ax2 - bx1) / 2, 0) >= 4) AS v FROM boxes GROUP BY grp", uses="boxes")
def calc_cell_width(spark, sf):
    w = F.bround(F.abs(c("ax2") - c("bx1")) / 2, 0)
    return relation(spark, sf, "boxes").groupBy("grp").agg(F.avg(F.when(w >= 4, w)).alias("v"))


_TP = f"""WITH m AS (SELECT g.table_id, g.seq, g.c0, g.c1, g.r0, g.r1, min(p.seq) AS pred FROM fx_gt g LEFT JOIN fx_pred p ON p.table_id = g.table_id AND {_GPIOU} >= 0.5 GROUP BY ALL),
n AS (SELECT table_id, count(*) AS n_pred FROM fx_pred GROUP BY table_id),
t AS (SELECT m.table_id, count(*) AS n_gt, count(m.pred) AS tp, coalesce(max(n.n_pred), 0) AS n_pred, count(*) FILTER (p.c0 = m.c0 AND p.c1 = m.c1 AND p.r0 = m.r0 AND p.r1 = m.r1) AS ok FROM m LEFT JOIN fx_pred p ON p.table_id = m.table_id AND p.seq = m.pred LEFT JOIN n ON n.table_id = m.table_id GROUP BY m.table_id),
e AS (SELECT table_id, n_gt, tp, n_pred, ok, tp / nullif(n_pred, 0) AS precision, tp / nullif(n_gt, 0) AS recall, n_pred - tp AS fp, n_gt - tp AS fn, ok / nullif(tp, 0) AS acc FROM t)
"""


def per_table(spark, sf):
    """Matches, precision, recall and correct logical places of each table."""
    gt, pred = relation(spark, sf, "fx_gt"), relation(spark, sf, "fx_pred")
    m = first_match(gt, pred, K).join(gt.select("table_id", "seq", "c0", "c1", "r0", "r1"), ["table_id", "seq"])
    p = pred.select("table_id", c("seq").alias("pred"), F.struct("c0", "c1", "r0", "r1").alias("p"))
    n = pred.groupBy("table_id").agg(F.count("*").alias("n_pred"))
    j = m.join(p, ["table_id", "pred"], "left")
    t = j.groupBy("table_id").agg(F.count("*").alias("n_gt"), F.count("pred").alias("tp"), F.count_if(c("p") == F.struct("c0", "c1", "r0", "r1")).alias("ok"))
    t = t.join(n, "table_id", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    share = lambda a, b: c(a) / F.nullif(c(b), F.lit(0))
    return t.select("table_id", "n_gt", "tp", "n_pred", "ok", share("tp", "n_pred").alias("precision"), share("tp", "n_gt").alias("recall"),
                    (c("n_pred") - c("tp")).alias("fp"), (c("n_gt") - c("tp")).alias("fn"), share("ok", "tp").alias("acc"))


@query("box_match_total", "AGG-06", _TP + "SELECT table_id, tp FROM e", uses="fx_gt fx_pred")
def box_match_total(spark, sf):
    return per_table(spark, sf).select("table_id", "tp")


@query("eval_bbox", "AGG-07", _TP + "SELECT table_id, precision, recall, fp, fn FROM e", uses="fx_gt fx_pred")
def eval_bbox(spark, sf):
    return per_table(spark, sf).select("table_id", "precision", "recall", "fp", "fn")


@query("eval_axis", "AGG-09", _TP + "SELECT table_id, acc FROM e", uses="fx_gt fx_pred")
def eval_axis(spark, sf):
    return per_table(spark, sf).select("table_id", "acc")


_F1 = "2 * avg(precision) * avg(recall) / nullif(avg(precision) + avg(recall), 0)"


@query("eval_table", "AGG-10..11", _TP + f"SELECT round(avg(acc), 9) AS acc, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round({_F1}, 9) AS f1, avg(CASE WHEN ok = n_gt AND fp = 0 THEN 1e0 ELSE 0e0 END) AS exact, count(*) FILTER (acc IS NULL) AS null_acc FROM e", uses="fx_gt fx_pred")
def eval_table(spark, sf):
    """Means over the tables that have a value, F1 of the means, share of tables that are wholly right."""
    e = per_table(spark, sf)
    p, r = F.avg("precision"), F.avg("recall")
    r9 = lambda x: F.round(x, 9)
    return e.agg(r9(F.avg("acc")).alias("acc"), r9(p).alias("precision"), r9(r).alias("recall"), r9(2 * p * r / F.nullif(p + r, d(0))).alias("f1"),
                 F.avg(F.when((c("ok") == c("n_gt")) & (c("fp") == 0), 1.0).otherwise(0.0)).alias("exact"), F.count_if(c("acc").isNull()).alias("null_acc"))


@query("eval_histograms", "AGG-10", _TP + "SELECT 'fp' AS kind, fp AS value, count(*) AS n FROM e GROUP BY fp UNION ALL SELECT 'fn' AS kind, fn AS value, count(*) AS n FROM e GROUP BY fn", uses="fx_gt fx_pred")
def eval_histograms(spark, sf):
    e = per_table(spark, sf).select(F.explode(F.array(F.struct(F.lit("fp").alias("kind"), c("fp").alias("value")), F.struct(F.lit("fn").alias("kind"), c("fn").alias("value")))).alias("s"))
    return e.groupBy("s.kind", "s.value").agg(F.count("*").alias("n"))


@query("calc_f1", "AGG-12", """WITH t AS (SELECT d.lang, count(*) FILTER (d.n_chars > 1000 AND l.quality = 1) AS tp, count(*) FILTER (d.n_chars > 1000) AS total, count(*) FILTER (l.quality = 1) AS total_label FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang)
SELECT lang, tp / nullif(total, 0) AS precision, tp / nullif(total_label, 0) AS recall, 2 * (tp / nullif(total, 0)) * (tp / nullif(total_label, 0)) / nullif(tp / nullif(total, 0) + tp / nullif(total_label, 0), 0) AS f1 FROM t""")
def calc_f1(spark, sf):
    j = relation(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(relation(spark, sf, "labels"), "doc_id")
    said, real = c("n_chars") > 1000, c("quality") == 1
    t = j.groupBy("lang").agg(F.count_if(said & real).alias("tp"), F.count_if(said).alias("total"), F.count_if(real).alias("total_label"))
    p, r = F.try_divide("tp", "total"), F.try_divide("tp", "total_label")
    return t.select("lang", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


@query("print_timings", "AGG-15 AGG-17..18", """SELECT event_type AS stage, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(sum(value) / 1000, 6) AS total FROM events GROUP BY event_type""")
def print_timings(spark, sf):
    r6 = lambda x, n: F.round(x, 6).alias(n)
    q = lambda p: F.percentile("value", F.lit(p))
    return relation(spark, sf, "events").groupBy(c("event_type").alias("stage")).agg(r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "sd"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        r6(q(0.5), "p50"), r6(q(0.95), "p95"), r6(q(0.99), "p99"), r6(F.sum("value") / 1000, "total"))


@query("timer_cumsum", "AGG-19", "SELECT event_id, event_type, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events")
def timer_cumsum(spark, sf):
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return relation(spark, sf, "events").select("event_id", "event_type", F.sum(F.floor(c("value") * 100)).over(w).alias("v"))


@query("stage_shares", "AGG-20", "WITH s AS (SELECT event_type AS stage, sum(CAST(floor(value * 100) AS BIGINT)) AS t FROM events GROUP BY event_type) SELECT stage, CAST(t AS BIGINT) AS t, round(CAST(t AS DOUBLE) / CAST(sum(t) OVER () AS DOUBLE), 9) AS share FROM s")
def stage_shares(spark, sf):
    s = relation(spark, sf, "events").groupBy(c("event_type").alias("stage")).agg(F.sum(F.floor(c("value") * 100)).alias("t"))
    return s.crossJoin(s.agg(F.sum("t").alias("all"))).select("stage", "t", F.round(c("t").cast("double") / c("all").cast("double"), 9).alias("share"))


@query("sort_dict", "AGG-21", """WITH ch AS (SELECT p_brand AS k, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT k, ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY k, ch)
SELECT k, ch, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, ch) AS pos FROM n""")
def sort_dict(spark, sf):
    ch = relation(spark, sf, "part").select(c("p_brand").alias("k"), F.explode(F.split("p_name", "")).alias("ch")).filter("ch <> ''")
    n = ch.groupBy("k", "ch").agg(F.count("*").alias("n"))
    return n.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "ch")))


@query("calc_pair_sentences_diff", "AGG-22", """WITH a AS (SELECT item_id, ch, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark) WHERE ch <> '' GROUP BY item_id, ch),
b AS (SELECT doc_id AS item_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch),
i AS (SELECT b.* FROM b JOIN benchmark k ON k.item_id = b.item_id)
SELECT coalesce(a.item_id, i.item_id) AS item_id, coalesce(a.ch, i.ch) AS ch, coalesce(a.n, 0) - coalesce(i.n, 0) AS diff FROM a FULL JOIN i ON a.item_id = i.item_id AND a.ch = i.ch WHERE coalesce(a.n, 0) <> coalesce(i.n, 0)""")
def calc_pair_sentences_diff(spark, sf):
    """Signed difference of the character counts of two texts."""
    count = lambda df, k: df.select(c(k).alias("item_id"), F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("item_id", "ch").agg(F.count("*").alias("n"))
    bench = relation(spark, sf, "benchmark")
    docs = relation(spark, sf, "documents").join(bench.select(c("item_id").alias("doc_id")), "doc_id", "left_semi")
    a, b = count(bench, "item_id"), count(docs, "doc_id").withColumnRenamed("n", "m")
    diff = F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))
    return a.join(b, ["item_id", "ch"], "full").select("item_id", "ch", diff.alias("diff")).filter("diff <> 0")


@query("calc_diff_structure_cell", "AGG-23", """WITH p AS (SELECT table_id, count(*) AS cells, count(DISTINCT r0) AS n_rows FROM fx_pred GROUP BY table_id), g AS (SELECT table_id, count(*) AS cells, count(DISTINCT r0) AS n_rows FROM fx_gt GROUP BY table_id)
SELECT g.table_id, CASE WHEN coalesce(p.n_rows, 0) <> g.n_rows THEN 'DIFF_CELL_DIFF_ROW' WHEN p.cells <> g.cells THEN 'DIFF' ELSE 'SAME' END AS kind FROM g LEFT JOIN p ON p.table_id = g.table_id""", uses="fx_gt fx_pred")
def calc_diff_structure_cell(spark, sf):
    total = lambda n: relation(spark, sf, n).groupBy("table_id").agg(F.count("*").alias("cells"), F.count_distinct("r0").alias("n_rows"))
    g, p = total("fx_gt"), total("fx_pred").select("table_id", c("cells").alias("pc"), c("n_rows").alias("pr"))
    kind = F.when(F.coalesce("pr", F.lit(0)) != c("n_rows"), "DIFF_CELL_DIFF_ROW").when(c("pc") != c("cells"), "DIFF").otherwise("SAME")
    return g.join(p, "table_id", "left").select("table_id", kind.alias("kind"))


@query("text_needs_rotation_90", "AGG-25", "SELECT grp, sum(ax2 - ax1) / nullif(sum(ay2 - ay1), 0) < 1 AS by_box, sum(bx2 - bx1) / nullif(sum(by2 - by1), 0) < 1 AS by_other FROM boxes GROUP BY grp", uses="boxes")
def text_needs_rotation_90(spark, sf):
    r = lambda p: F.sum(c(p + "x2") - c(p + "x1")) / F.nullif(F.sum(c(p + "y2") - c(p + "y1")), d(0)) < 1
    return relation(spark, sf, "boxes").groupBy("grp").agg(r("a").alias("by_box"), r("b").alias("by_other"))


@query("get_rotation", "AGG-27", """SELECT grp, CASE WHEN count(*) FILTER (ax2 - ax1 > ay2 - ay1) >= count(*) FILTER (score_pct < 60) THEN '' WHEN count(*) FILTER (frac > 10) > count(*) FILTER (frac <= 10) THEN 'anticlockwise' ELSE 'clockwise' END AS v FROM boxes GROUP BY grp""", uses="boxes")
def get_rotation(spark, sf):
    """None unless fewer lines are level than upright; then the sign of most characters, a tie is clockwise."""
    level, upright, up, down = (F.count_if(x) for x in (c("ax2") - c("ax1") > c("ay2") - c("ay1"), c("score_pct") < 60, c("frac") > 10, c("frac") <= 10))
    return relation(spark, sf, "boxes").groupBy("grp").agg(F.when(level >= upright, "").when(up > down, "anticlockwise").otherwise("clockwise").alias("v"))


@query("text_line_orientation", "AGG-28", """SELECT grp, count(*) FILTER (k % 2 = 0 AND score_pct > 90) >= count(*) FILTER (k % 2 = 1 AND score_pct > 90) AS upright, count(*) FILTER (k % 2 = 0 AND score_pct > 90) > count(*) FILTER (k % 2 = 1 AND score_pct > 90) AS upright_compat FROM boxes GROUP BY grp""", uses="boxes")
def text_line_orientation(spark, sf):
    """A tie keeps the page; the compatible column turns it."""
    a, b = F.count_if((c("k") % 2 == 0) & (c("score_pct") > 90)), F.count_if((c("k") % 2 == 1) & (c("score_pct") > 90))
    return relation(spark, sf, "boxes").groupBy("grp").agg((a >= b).alias("upright"), (a > b).alias("upright_compat"))


_MODES = """WITH n AS (SELECT grp, CAST(round_even(ax1 / 4, 0) AS BIGINT) AS x, count(*) AS n, min(id) AS f FROM boxes GROUP BY grp, CAST(round_even(ax1 / 4, 0) AS BIGINT)),
r AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS rn FROM n) """


def _modes(spark, sf):
    n = relation(spark, sf, "boxes").groupBy("grp", F.bround(c("ax1") / 4, 0).cast("long").alias("x")).agg(F.count("*").alias("n"), F.min("id").alias("f"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "f")))


@query("block_line_start", "AGG-29", _MODES + "SELECT grp, x FROM r WHERE rn = 1", uses="boxes")
def block_line_start(spark, sf):
    """Most frequent rounded start; of equal ones the first seen."""
    return _modes(spark, sf).filter("rn = 1").select("grp", "x")


@query("line_begin_x", "AGG-30", _MODES + "SELECT a.grp, CASE WHEN b.x < a.x AND abs(a.x - b.x - 2 * 10) < 10 * 0.3 THEN b.x ELSE a.x END AS v FROM r a LEFT JOIN r b ON b.grp = a.grp AND b.rn = 2 WHERE a.rn = 1", uses="boxes")
def line_begin_x(spark, sf):
    """The second most frequent start if it lies about two characters left of the first."""
    top = _modes(spark, sf).filter("rn <= 2").groupBy("grp").agg(F.max(F.when(c("rn") == 1, c("x"))).alias("a"), F.max(F.when(c("rn") == 2, c("x"))).alias("b"))
    return top.select("grp", F.when((c("b") < c("a")) & (F.abs(c("a") - c("b") - 20) < 3.0), c("b")).otherwise(c("a")).alias("v"))


@query("average_angle", "AGG-31", "SELECT grp, avg(CAST(score_pct % 45 * 2 AS DOUBLE)) FILTER (score_pct % 45 * 2 NOT IN (0, 90)) AS v FROM boxes GROUP BY grp", uses="boxes")
def average_angle(spark, sf):
    a = (c("score_pct") % 45 * 2).cast("double")
    return relation(spark, sf, "boxes").groupBy("grp").agg(F.avg(F.when(~a.isin(0.0, 90.0), a)).alias("v"))


scalar("str_count", "AGG-32", "part", "p_partkey", lambda: (F.length("p_name") - F.ceil((F.length("p_name") - F.length(F.regexp_replace("p_name", "[a-zA-Z0-9 ]", ""))) / 2.0)).cast("int"),
       "CAST(length(p_name) - ceil((length(p_name) - length(regexp_replace(p_name, '[a-zA-Z0-9 ]', '', 'g'))) / 2e0) AS INT)")


@query("horizontal_range", "AGG-33", """SELECT c.table_id, c.cell_id, coalesce(min(s.x0), 10000000000) AS lo, greatest(0, coalesce(max(s.x1), 0)) AS hi FROM fx_cells c LEFT JOIN fx_seg s ON s.table_id = c.table_id AND s.y > c.y1 - 2 AND s.y < c.y2 + 2 GROUP BY c.table_id, c.cell_id""", uses="fx_cells fx_seg")
def horizontal_range(spark, sf):
    cl, s = relation(spark, sf, "fx_cells").alias("c"), relation(spark, sf, "fx_seg").alias("s")
    on = (c("s.table_id") == c("c.table_id")) & (c("s.y") > c("c.y1") - 2) & (c("s.y") < c("c.y2") + 2)
    return cl.join(s, on, "left").groupBy("c.table_id", "c.cell_id").agg(F.coalesce(F.min("s.x0"), F.lit(10000000000)).alias("lo"), F.greatest(F.lit(0), F.coalesce(F.max("s.x1"), F.lit(0))).alias("hi"))


@query("main_angle", "AGG-34", """WITH w AS (SELECT grp, frac, ax2 - ax1 > 3 * (ay2 - ay1) AS wide FROM boxes), s AS (SELECT grp, list_sort(list(frac) FILTER (wide)) AS a, list_sort(list(frac) FILTER (NOT wide)) AS b FROM w GROUP BY grp)
SELECT grp, CASE WHEN len(a) > 0 THEN a[len(a) // 2 + 1] ELSE b[len(b) // 2 + 1] END AS v FROM s""", uses="boxes")
def main_angle(spark, sf):
    """Upper median of the angles of wide blocks, of the others without those: by rank, not by collecting a group."""
    b = relation(spark, sf, "boxes").withColumn("wide", c("ax2") - c("ax1") > 3 * (c("ay2") - c("ay1")))
    w = Window.partitionBy("grp", "wide")
    r = b.withColumns({"i": F.row_number().over(w.orderBy("frac", "id")) - 1, "n": F.count("*").over(w)}).filter(c("i") == F.floor(c("n") / 2))
    return r.groupBy("grp").agg(F.max_by("frac", F.col("wide").cast("int")).alias("v"))


@query("file_line_count", "AGG-35 SRC-29..31", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS v FROM documents")
def file_line_count(spark, sf):
    return relation(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("v"))


@query("speed", "AGG-37", "SELECT event_type, round(count(*) / nullif(sum(value), 0), 6) AS v FROM events GROUP BY event_type")
def speed(spark, sf):
    return relation(spark, sf, "events").groupBy("event_type").agg(F.round(F.count("*") / F.nullif(F.sum("value"), d(0)), 6).alias("v"))
