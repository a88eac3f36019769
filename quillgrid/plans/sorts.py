"""Orders, top-k, set operations: one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, scalar
from .relations import Layout, relation

c = F.col
d = lambda v: F.lit(float(v))


@query("reading_order", "SRT-01", "SELECT id, row_number() OVER (PARTITION BY grp ORDER BY 0.01e0 * ((ax1 + ax2 + bx1 + bx2) / 4) + (ay1 + ay2 + by1 + by2) / 4, id) AS pos FROM boxes", uses="boxes")
def reading_order(spark, sf):
    key = d(0.01) * ((c("ax1") + c("ax2") + c("bx1") + c("bx2")) / 4) + (c("ay1") + c("ay2") + c("by1") + c("by2")) / 4
    return relation(spark, sf, "boxes").select("id", F.row_number().over(Window.partitionBy("grp").orderBy(key, "id")).alias("pos"))


@query("order_units", "SRT-03..05", "SELECT table_id, seq, row_number() OVER (PARTITION BY table_id ORDER BY y1, x1, y2, x2, seq) AS pos FROM fx_pred", uses="fx_pred")
def order_units(spark, sf):
    """By top, left, bottom, right."""
    return relation(spark, sf, "fx_pred").select("table_id", "seq", F.row_number().over(Window.partitionBy("table_id").orderBy("y1", "x1", "y2", "x2", "seq")).alias("pos"))


def interval_kind(a0, a1, b0, b1):
    """How one interval lies to another: 1 before, 2 behind, 3 ahead, 4 late, 5 around, 6 inside, 0 none of these."""
    return (
        F.when((a1 < b0 + 1e-4) & (a1 < b1 - 1e-4), 1).when((a0 > b1 - 1e-4) & (a0 > b0 + 1e-4), 2).when((a0 < b0) & (a1 < b1), 3)
        .when((a0 > b0) & (a1 > b1), 4).when((a0 <= b0) & (a1 >= b1), 5).when((a0 >= b0) & (a1 <= b1), 6).otherwise(0)
    )


_KIND = lambda a0, a1, b0, b1: f"CASE WHEN {a1} < {b0} + 1e-4 AND {a1} < {b1} - 1e-4 THEN 1 WHEN {a0} > {b1} - 1e-4 AND {a0} > {b0} + 1e-4 THEN 2 WHEN {a0} < {b0} AND {a1} < {b1} THEN 3 WHEN {a0} > {b0} AND {a1} > {b1} THEN 4 WHEN {a0} <= {b0} AND {a1} >= {b1} THEN 5 WHEN {a0} >= {b0} AND {a1} <= {b1} THEN 6 ELSE 0 END"
scalar("calc_x_type", "SRT-07", "boxes", "id", lambda: interval_kind(c("ax1"), c("ax2"), c("bx1"), c("bx2")), _KIND("ax1", "ax2", "bx1", "bx2"))
scalar("calc_y_type", "SRT-08", "boxes", "id", lambda: interval_kind(c("ay1"), c("ay2"), c("by1"), c("by2")), _KIND("ay1", "ay2", "by1", "by2"))


@query("top_contours", "SRT-09", "SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY (ax2 - ax1) * (ay2 - ay1) DESC, id) AS rn FROM boxes) WHERE rn <= 10", uses="boxes")
def top_contours(spark, sf):
    """Ten largest by area of each page: a limit within groups, which Spark applies before the shuffle."""
    w = Window.partitionBy("grp").orderBy(F.desc((c("ax2") - c("ax1")) * (c("ay2") - c("ay1"))), "id")
    return relation(spark, sf, "boxes").withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("grp", "id")


@query("sorted_dict", "SRT-10", "WITH n AS (SELECT grp, k % 7 AS k, count(*) AS n FROM boxes GROUP BY grp, k % 7) SELECT grp, string_agg(concat(k, ':', n), ',' ORDER BY n DESC, k) AS v FROM n GROUP BY grp", uses="boxes")
def sorted_dict(spark, sf):
    n = relation(spark, sf, "boxes").groupBy("grp", (c("k") % 7).alias("k")).agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-c("n")).alias("m"), "k", F.concat_ws(":", "k", "n").alias("x"))))
    return n.groupBy("grp").agg(F.array_join(F.transform(s, lambda e: e["x"]), ",").alias("v"))


@query("topk_softmax", "SRT-11", """WITH s AS (SELECT id, grp, exp(frac / 4) AS e FROM boxes), t AS (SELECT grp, sum(e) AS t FROM s GROUP BY grp)
SELECT grp, id, score FROM (SELECT s.grp, id, round(e / t, 5) AS score, row_number() OVER (PARTITION BY s.grp ORDER BY e DESC, id) AS rn FROM s JOIN t ON t.grp = s.grp) WHERE rn <= 5""", uses="boxes")
def topk_softmax(spark, sf):
    s = relation(spark, sf, "boxes").select("id", "grp", F.exp(c("frac") / 4).alias("e"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("e"), "id"))).filter("rn <= 5")
    return top.join(s.groupBy("grp").agg(F.sum("e").alias("t")), "grp").select("grp", "id", F.round(c("e") / c("t"), 5).alias("score"))


scalar("table_attributes", "SRT-12", "boxes", "id", lambda: {"source": F.when(c("score_pct") >= 50, "Scanned").otherwise("Photo"), "number": F.when(c("ax1") >= 90, "Numerous").otherwise("Little"), "obstruction": F.when(c("ay1") >= 90, "Yes").otherwise("No")},
       {"source": "CASE WHEN score_pct >= 50 THEN 'Scanned' ELSE 'Photo' END", "number": "CASE WHEN ax1 >= 90 THEN 'Numerous' ELSE 'Little' END", "obstruction": "CASE WHEN ay1 >= 90 THEN 'Yes' ELSE 'No' END"})


@query("topk_by_class", "SRT-13 SRT-17 SRT-22", "WITH a AS (SELECT id, grp, k % 4 AS cls, frac, row_number() OVER (PARTITION BY grp, k % 4 ORDER BY frac DESC, id) AS r FROM boxes), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY frac DESC, id) AS rn FROM a WHERE r <= 40) SELECT id, grp, cls FROM b WHERE rn <= 40", uses="boxes")
def topk_by_class(spark, sf):
    """The best of each class, then of these the best of the image."""
    a = relation(spark, sf, "boxes").select("id", "grp", (c("k") % 4).alias("cls"), "frac")
    best = lambda df, *keys: df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("frac"), "id"))).filter("rn <= 40").drop("rn")
    return best(best(a, "grp", "cls"), "grp").select("id", "grp", "cls")


@query("heatmap_peaks", "SRT-14 SRT-18 SRT-23", """WITH h AS (SELECT grp, CAST(ax1 / 3 AS BIGINT) AS x, CAST(ay1 / 2 AS BIGINT) AS y, max(frac) AS v FROM boxes GROUP BY ALL)
SELECT a.grp, a.x, a.y, a.v FROM h a JOIN h b ON a.grp = b.grp AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.grp, a.x, a.y, a.v HAVING a.v = max(b.v)""", uses="boxes")
def heatmap_peaks(spark, sf):
    """Cells that are the largest of their 3 x 3 surroundings: each value is sent to nine places, no range join."""
    h = relation(spark, sf, "boxes").groupBy("grp", (c("ax1") / 3).cast("long").alias("x"), (c("ay1") / 2).cast("long").alias("y")).agg(F.max("frac").alias("v"))
    around = lambda x: F.explode(F.array(c(x) - 1, c(x), c(x) + 1)).alias(x)
    near = h.select("grp", around("x"), "y", "v").select("grp", "x", around("y"), c("v").alias("w"))
    top = near.groupBy("grp", "x", "y").agg(F.max("w").alias("w"))
    return h.join(top, ["grp", "x", "y"]).filter("v = w").select("grp", "x", "y", "v")


@query("merge_outputs", "SRT-15 SRT-25", "SELECT id FROM (SELECT id, rank() OVER (PARTITION BY grp ORDER BY frac DESC) AS rk FROM boxes) WHERE rk <= 30", uses="boxes")
def merge_outputs(spark, sf):
    """Rows that score at least as much as the 30th of their image; ties stay."""
    w = Window.partitionBy("grp").orderBy(F.desc("frac"))
    return relation(spark, sf, "boxes").withColumn("rk", F.rank().over(w)).filter("rk <= 30").select("id")


_CENTRE_IN = "(i.x1 + i.x2) / 2e0 > j.x1 AND (i.x1 + i.x2) / 2e0 < j.x2 AND (i.y1 + i.y2) / 2e0 > j.y1 AND (i.y1 + i.y2) / 2e0 < j.y2"


def _not_in_better(spark, sf, earlier):
    """Boxes whose centre lies in no box of a higher score, or none before them.

    Boxes of one place, size and score are compared once: of those that hold a centre the first one's seq is kept.
    """
    lay = Layout(spark, sf)
    side = ["page", "x1", "y1", "x2", "y2", "score_pct"]
    boxes = lay.once.groupBy(*side).agg(F.min("seq").alias("first"))
    i, j = boxes.alias("i"), boxes.alias("j")
    x, y = (c("i.x1") + c("i.x2")) / 2.0, (c("i.y1") + c("i.y2")) / 2.0
    on = (c("i.page") == c("j.page")) & (x > c("j.x1")) & (x < c("j.x2")) & (y > c("j.y1")) & (y < c("j.y2")) & (c("j.score_pct") > c("i.score_pct"))
    held = i.join(j, on).groupBy(*[c(f"i.{n}") for n in side]).agg(F.min("j.first").alias("better"))
    hit = (c("better") < c("seq")) if earlier else c("better").isNotNull()
    return lay.on_pages(lay.once.join(held, side, "left").filter(~F.coalesce(hit, F.lit(False))).select("page", "seq"))


@query("suppress_by_earlier", "SRT-19", f"SELECT page, seq FROM fx_layout i WHERE NOT exists(SELECT 1 FROM fx_layout j WHERE j.page = i.page AND j.seq < i.seq AND j.score_pct > i.score_pct AND {_CENTRE_IN})", uses="fx_layout")
def suppress_by_earlier(spark, sf):
    """Only earlier boxes are compared."""
    return _not_in_better(spark, sf, True)


@query("suppress_by_score", "SRT-21", f"SELECT page, seq FROM fx_layout i WHERE NOT exists(SELECT 1 FROM fx_layout j WHERE j.page = i.page AND j.score_pct > i.score_pct AND {_CENTRE_IN})", uses="fx_layout")
def suppress_by_score(spark, sf):
    return _not_in_better(spark, sf, False)


@query("score_filter_default", "SRT-24", "SELECT grp, id FROM boxes WHERE score_pct > 95 UNION ALL SELECT grp, 0 AS id FROM (SELECT DISTINCT grp FROM boxes) g WHERE NOT exists(SELECT 1 FROM boxes b WHERE b.grp = g.grp AND b.score_pct > 95)", uses="boxes")
def score_filter_default(spark, sf):
    """Rows above the threshold; an image without any gets a row of zeros."""
    b = relation(spark, sf, "boxes").select("grp", "id", "score_pct")
    hit = b.filter("score_pct > 95").select("grp", "id")
    bare = b.select("grp").distinct().join(hit.select("grp").distinct(), "grp", "left_anti")
    return hit.unionByName(bare.select("grp", F.lit(0).cast("long").alias("id")))


scalar("convert_eval_format", "SRT-26", "boxes", "id", lambda: {"list": F.when(c("score_pct") >= 15, F.when(c("grp").isin(11, 12), "subfield").otherwise("layout")), "x": F.when(c("score_pct") >= 15, F.bround(c("ax1") / 8, 0)), "score": F.when(c("score_pct") >= 15, F.bround(c("frac"), 2))},
       {"list": "CASE WHEN score_pct >= 15 THEN CASE WHEN grp IN (11, 12) THEN 'subfield' ELSE 'layout' END END", "x": "CASE WHEN score_pct >= 15 THEN round_even(ax1 / 8, 0) END", "score": "CASE WHEN score_pct >= 15 THEN round_even(frac, 2) END"})
scalar("infer_results", "SRT-34..36", "boxes", "id", lambda: {"category": c("grp") + 1, "bbox": F.concat_ws(",", *[v.cast("long") for v in (c("ax1"), c("ay1"), c("ax2") - c("ax1") + 1, c("ay2") - c("ay1") + 1)]), "score": c("frac")},
       {"category": "grp + 1", "bbox": "concat_ws(',', CAST(ax1 AS BIGINT), CAST(ay1 AS BIGINT), CAST(ax2 - ax1 + 1 AS BIGINT), CAST(ay2 - ay1 + 1 AS BIGINT))", "score": "frac"})


@query("tables_to_page", "SET-01", "SELECT s.table_id, c.cell_id, c.x1 + s.x0 AS x1, c.y1 + s.y AS y1 FROM fx_seg s JOIN fx_cells c ON c.table_id = s.table_id AND c.row_idx = s.seq", uses="fx_seg fx_cells")
def tables_to_page(spark, sf):
    """Cells of each table moved by its origin, in one relation."""
    s = relation(spark, sf, "fx_seg").select("table_id", c("seq").alias("row_idx"), "x0", "y")
    return relation(spark, sf, "fx_cells").join(s, ["table_id", "row_idx"]).select("table_id", "cell_id", (c("x1") + c("x0")).alias("x1"), (c("y1") + c("y")).alias("y1"))


@query("edit_distance_word", "SET-03", """SELECT DISTINCT p_partkey, w FROM (SELECT p_partkey, concat(substr(p_brand, 1, CAST(i AS INT)), substr(p_brand, CAST(i AS INT) + 2, 1), substr(p_brand, CAST(i AS INT) + 1, 1), substr(p_brand, CAST(i AS INT) + 3)) AS w FROM part, unnest(range(length(p_brand) - 1)) u(i)
UNION ALL SELECT p_partkey, concat(substr(p_brand, 1, CAST(i AS INT)), ch, substr(p_brand, CAST(i AS INT) + 2)) AS w FROM part, unnest(range(length(p_brand))) u(i), (VALUES ('a'), ('b')) v(ch))""")
def edit_distance_word(spark, sf):
    """Words at one swap of neighbours or one replacement by a letter of the set."""
    w = c("p_brand")
    n = F.length(w)
    swap = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.lit(1)), F.substring(w, i + 1, F.lit(1)), F.substring(w, i + 3, n)))
    put = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.array(F.lit("a"), F.lit("b")), lambda ch: F.concat(F.substring(w, F.lit(1), i), ch, F.substring(w, i + 2, n)))))
    return relation(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.concat(swap, put))).alias("w"))


scalar("find_all_idx", "SET-04..05", "part", "p_partkey", lambda: F.array_join(F.transform(F.filter(F.transform(F.split("p_name", ""), lambda ch, i: F.struct(i.alias("i"), ch.alias("ch"))), lambda s: s["ch"] == "e"), lambda s: s["i"].cast("string")), ","),
       "array_to_string(list_filter(list_transform(range(length(p_name)), lambda i: CASE WHEN substr(p_name, CAST(i AS INT) + 1, 1) = 'e' THEN CAST(i AS VARCHAR) END), lambda x: x IS NOT NULL), ',')")


@query("load_set_file", "SET-06", "SELECT DISTINCT lang, trim(line) AS line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND NOT starts_with(line, '#')")
def load_set_file(spark, sf):
    """Distinct lines without blanks and comments."""
    l = relation(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("raw"))
    return l.filter((F.trim("raw") != "") & ~c("raw").startswith("#")).select("lang", F.trim("raw").alias("line")).distinct()


@query("tag_ids", "SET-07 SRC-34..35 SRC-51", "SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS id FROM (SELECT DISTINCT p_type AS tag FROM part)")
def tag_ids(spark, sf):
    """Tags in order with ids from 0; as many rows as there are tags."""
    tags = relation(spark, sf, "part").select(c("p_type").alias("tag")).distinct()
    return tags.select("tag", (F.row_number().over(Window.orderBy("tag")) - 1).alias("id"))


@query("get_span", "SET-08", """WITH s AS (SELECT grp, id, score_pct < 30 AS st, score_pct > 60 AS en FROM boxes), w AS (SELECT grp, id, en, max(CASE WHEN st THEN id END) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls, max(CASE WHEN en THEN id END) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM s)
SELECT grp, ls AS span_start, id AS span_end FROM w WHERE en AND ls IS NOT NULL AND (le IS NULL OR ls > le)""", uses="boxes")
def get_span(spark, sf):
    """Each end with the last start before it, if that lies behind the end before."""
    w = Window.partitionBy("grp").orderBy("id")
    start, end = F.when(c("score_pct") < 30, c("id")), F.when(c("score_pct") > 60, c("id"))
    s = relation(spark, sf, "boxes").select("grp", "id", (c("score_pct") > 60).alias("en"), F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ls"), F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("le"))
    return s.filter(c("en") & c("ls").isNotNull() & (c("le").isNull() | (c("ls") > c("le")))).select("grp", c("ls").alias("span_start"), c("id").alias("span_end"))


@query("span_probabilities", "SET-09", "SELECT a.id, a.frac * b.frac AS prob FROM boxes a JOIN boxes b ON b.id = a.id + 1", uses="boxes")
def span_probabilities(spark, sf):
    b = relation(spark, sf, "boxes")
    return b.select("id", "frac").join(b.select((c("id") - 1).alias("id"), c("frac").alias("g")), "id").select("id", (c("frac") * c("g")).alias("prob"))


@query("map_offset", "SET-10", "SELECT t.table_id, t.seq, coalesce(min(c.cell_id), -1) AS v FROM fx_text t LEFT JOIN fx_cells c ON c.table_id = t.table_id AND t.x0 >= c.x1 AND t.x0 < c.x2 AND t.y0 >= c.y1 AND t.y0 < c.y2 GROUP BY t.table_id, t.seq", uses="fx_text fx_cells")
def map_offset(spark, sf):
    """The first span that holds an offset, -1 without one."""
    t, cl = relation(spark, sf, "fx_text").alias("t"), relation(spark, sf, "fx_cells").alias("c")
    on = (c("t.table_id") == c("c.table_id")) & (c("t.x0") >= c("c.x1")) & (c("t.x0") < c("c.x2")) & (c("t.y0") >= c("c.y1")) & (c("t.y0") < c("c.y2"))
    return t.join(cl, on, "left").groupBy("t.table_id", "t.seq").agg(F.coalesce(F.min("c.cell_id"), F.lit(-1).cast("long")).alias("v"))
