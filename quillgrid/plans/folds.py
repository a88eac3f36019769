"""Ordered folds: merging lines, grouping rows, spans, decoding; one query for each operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, scalar
from .relations import relation

c = F.col


def sorted_values(col: Column) -> Column:
    """Values of a group in ascending order, as doubles."""
    return F.array_sort(F.collect_list(col.cast("double")))


def merge_close(values: Column, tol: float) -> Column:
    """Fold of sorted values: one close to the last is averaged with it, any other begins anew."""
    close = lambda last, a: F.abs(last - a) <= tol + 1e-5 * F.abs(a)
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        values,
        F.array().cast("array<double>"),
        lambda acc, a: F.when((F.size(acc) > 0) & close(last(acc), a), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array((last(acc) + a) / 2.0))).otherwise(F.concat(acc, F.array(a))),
    )


_MERGED = """s AS (SELECT table_id, CAST(y0 AS DOUBLE) AS y, row_number() OVER (PARTITION BY table_id ORDER BY y0, seq) AS rn FROM fx_text),
r AS (SELECT table_id, rn, y AS cur, 1 AS grp FROM s WHERE rn = 1 UNION ALL SELECT s.table_id, s.rn, CASE WHEN abs(r.cur - s.y) <= 2 + 1e-5 * abs(s.y) THEN (r.cur + s.y) / 2.0e0 ELSE s.y END, CASE WHEN abs(r.cur - s.y) <= 2 + 1e-5 * abs(s.y) THEN r.grp ELSE r.grp + 1 END FROM r JOIN s ON s.table_id = r.table_id AND s.rn = r.rn + 1),
m AS (SELECT table_id, grp, arg_max(cur, rn) AS y FROM r GROUP BY table_id, grp)
"""


def _recursive(sql: str) -> str:
    """An oracle with a recursive view; the relations before it need the keyword too."""
    from .relations import cte

    return cte("fx_text").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _MERGED + sql


def merged_lines(spark, sf) -> DataFrame:
    g = relation(spark, sf, "fx_text").groupBy("table_id").agg(sorted_values(c("y0")).alias("ys"))
    return g.select("table_id", merge_close(c("ys"), 2).alias("ys"))


@query("merge_close_lines", "WIN-01", _recursive("SELECT table_id, CAST(grp AS INT) AS grp, y FROM m"))
def merge_close_lines(spark, sf):
    return merged_lines(spark, sf).select("table_id", F.posexplode("ys").alias("grp", "y")).select("table_id", (c("grp") + 1).alias("grp"), "y")


@query("gen_lines", "WIN-02", _recursive("SELECT table_id, y AS lo, nxt AS hi FROM (SELECT table_id, y, lead(y) OVER (PARTITION BY table_id ORDER BY grp) AS nxt FROM m) WHERE nxt IS NOT NULL"))
def gen_lines(spark, sf):
    """Neighbouring pairs of the merged lines."""
    y = merged_lines(spark, sf).filter(F.size("ys") > 1)
    pairs = F.transform(F.slice("ys", F.lit(2), F.size("ys") - 1), lambda v, i: F.struct(F.get("ys", i).alias("lo"), v.alias("hi")))
    return y.select("table_id", F.explode(pairs).alias("p")).select("table_id", "p.lo", "p.hi")


@query("find_close_norm_x", "WIN-34", _recursive("SELECT t.table_id, t.seq, coalesce(min_by(m.y, m.grp), CAST(t.y0 AS DOUBLE)) AS y FROM fx_text t LEFT JOIN m ON m.table_id = t.table_id AND abs(t.y0 - m.y) <= 2 + 1e-5 * abs(m.y) GROUP BY t.table_id, t.seq, t.y0"))
def find_close_norm_x(spark, sf):
    """The first merged line close to the value, else the value."""
    t = relation(spark, sf, "fx_text").join(merged_lines(spark, sf), "table_id")
    near = F.filter("ys", lambda m: F.abs(c("y0") - m) <= 2 + 1e-5 * F.abs(m))
    return t.select("table_id", "seq", F.coalesce(F.get(near, F.lit(0)), c("y0").cast("double")).alias("y"))


def anchored(elements: Column, tol: float) -> Column:
    """Row number of each element (structs k, x, s in order of k): a new row where k is not close to the row's first k."""
    zero = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0).alias("n"), F.array().cast("array<struct<s:bigint,g:int>>").alias("g"))

    def step(acc, e):
        same = acc["a"].isNotNull() & (F.abs(acc["a"] - e["k"]) <= tol + 1e-5 * F.abs(e["k"]))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(same, acc["a"]).otherwise(e["k"]).alias("a"), n.alias("n"), F.concat(acc["g"], F.array(F.struct(e["s"].cast("long").alias("s"), n.alias("g")))).alias("g"))

    return F.aggregate(elements, zero, step, lambda acc: acc["g"])


def _rows(spark, sf) -> DataFrame:
    t = relation(spark, sf, "fx_text")
    e = F.array_sort(F.collect_list(F.struct((-c("y0")).cast("double").alias("k"), c("x0").alias("x"), c("seq").alias("s"))))
    return t.groupBy("table_id").agg(e.alias("e")).select("table_id", F.explode(anchored(c("e"), 2)).alias("p")).select("table_id", c("p.s").alias("seq"), c("p.g").alias("row_no"))


_ROWS = """q AS (SELECT table_id, seq, CAST(-y0 AS DOUBLE) AS k, row_number() OVER (PARTITION BY table_id ORDER BY -y0, x0, seq) AS rn FROM fx_text),
w AS (SELECT table_id, seq, rn, k AS anchor, 1 AS row_no FROM q WHERE rn = 1 UNION ALL SELECT q.table_id, q.seq, q.rn, CASE WHEN abs(w.anchor - q.k) <= 2 + 1e-5 * abs(q.k) THEN w.anchor ELSE q.k END, CASE WHEN abs(w.anchor - q.k) <= 2 + 1e-5 * abs(q.k) THEN w.row_no ELSE w.row_no + 1 END FROM w JOIN q ON q.table_id = w.table_id AND q.rn = w.rn + 1)
"""


def _rows_sql(sql: str) -> str:
    from .relations import cte

    return cte("fx_text").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _ROWS + sql


@query("group_rows", "WIN-03 WIN-29..31", _rows_sql("SELECT table_id, seq, CAST(row_no AS INT) AS row_no FROM w"))
def group_rows(spark, sf):
    """Rows of text by the y of the row's first text."""
    return _rows(spark, sf)


@query("join_rows", "WIN-04", _rows_sql(""", b AS (SELECT w.table_id, w.row_no, avg((t.y0 + t.y1) / 2e0) AS mid FROM w JOIN fx_text t ON t.table_id = w.table_id AND t.seq = w.seq GROUP BY w.table_id, w.row_no), e AS (SELECT table_id, max(y1) AS hi, min(y0) AS lo FROM fx_text GROUP BY table_id)
SELECT b.table_id, CAST(row_no AS INT) AS row_no, round(coalesce((mid + lag(mid) OVER (PARTITION BY b.table_id ORDER BY row_no)) / 2, e.hi), 6) AS top, round(coalesce((mid + lead(mid) OVER (PARTITION BY b.table_id ORDER BY row_no)) / 2, e.lo), 6) AS bottom FROM b JOIN e ON e.table_id = b.table_id"""))
def join_rows(spark, sf):
    """Bounds of rows halfway between the means of neighbours; the ends at the text's box."""
    t = relation(spark, sf, "fx_text")
    b = _rows(spark, sf).join(t, ["table_id", "seq"]).groupBy("table_id", "row_no").agg(F.avg((c("y0") + c("y1")) / 2.0).alias("mid"))
    w = Window.partitionBy("table_id").orderBy("row_no")
    j = b.join(t.groupBy("table_id").agg(F.max("y1").alias("hi"), F.min("y0").alias("lo")), "table_id")
    return j.select("table_id", "row_no", F.round(F.coalesce((c("mid") + F.lag("mid").over(w)) / 2, c("hi")), 6).alias("top"), F.round(F.coalesce((c("mid") + F.lead("mid").over(w)) / 2, c("lo")), 6).alias("bottom"))


def islands(df: DataFrame, keys: list[str], lo: str, hi: str, tie: str, gap: float = 0) -> DataFrame:
    """Union of touching intervals of each group: a running maximum opens a new one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi, tie)
    far = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("new", F.when(far.isNull() | (c(lo) > far + gap), 1).otherwise(0))
    return new.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("island")


def _islands_sql(rel, keys, lo, hi, tie, gap=0):
    return f"""WITH f AS (SELECT *, max({hi}) OVER (PARTITION BY {keys} ORDER BY {lo}, {hi}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {rel}),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR {lo} > far + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {lo}, {hi}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT {keys}, min({lo}) AS {lo}, max({hi}) AS {hi} FROM i GROUP BY {keys}, island"""


@query("merge_columns", "WIN-05 WIN-16", _islands_sql("fx_text", "table_id", "x0", "x1", "seq"), uses="fx_text")
def merge_columns(spark, sf):
    return islands(relation(spark, sf, "fx_text"), ["table_id"], "x0", "x1", "seq")


@query("merge_lines", "WIN-17..20", _islands_sql("fx_seg", "table_id, y", "x0", "x1", "seq", 2), uses="fx_seg")
def merge_lines(spark, sf):
    """Segments of one height that touch within the tolerance; the longer end is kept."""
    return islands(relation(spark, sf, "fx_seg"), ["table_id", "y"], "x0", "x1", "seq", 2)


@query("join_columns", "WIN-06", f"""WITH u AS ({_islands_sql("fx_text", "table_id", "x0", "x1", "seq")}), e AS (SELECT table_id, min(x0) AS lo, max(x1) AS hi FROM fx_text GROUP BY table_id)
SELECT u.table_id, coalesce((u.x0 + lag(u.x1) OVER (PARTITION BY u.table_id ORDER BY u.x0)) / 2e0, e.lo) AS x0, coalesce((u.x1 + lead(u.x0) OVER (PARTITION BY u.table_id ORDER BY u.x0)) / 2e0, e.hi) AS x1 FROM u JOIN e ON e.table_id = u.table_id""", uses="fx_text")
def join_columns(spark, sf):
    t = relation(spark, sf, "fx_text")
    w = Window.partitionBy("table_id").orderBy("x0")
    j = islands(t, ["table_id"], "x0", "x1", "seq").join(t.groupBy("table_id").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi")), "table_id")
    return j.select("table_id", F.coalesce((c("x0") + F.lag("x1").over(w)) / 2.0, c("lo")).alias("a"), F.coalesce((c("x1") + F.lead("x0").over(w)) / 2.0, c("hi")).alias("b")).toDF("table_id", "x0", "x1")


@query("column_count", "WIN-07..08", _rows_sql(""", n AS (SELECT table_id, row_no, count(*) AS k FROM w GROUP BY table_id, row_no), f AS (SELECT table_id, k, count(*) AS m FROM n GROUP BY table_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY m DESC, k) AS a, row_number() OVER (PARTITION BY table_id, k = 1 ORDER BY m DESC, k) AS b FROM f)
SELECT table_id, coalesce(max(k) FILTER (a = 1 AND k > 1), max(k) FILTER (k > 1 AND b = 1), 1) AS v FROM r GROUP BY table_id"""))
def column_count(spark, sf):
    """Most frequent number of texts in a row, other than 1 if there is another; of equal ones the smallest."""
    n = _rows(spark, sf).groupBy("table_id", "row_no").agg(F.count("*").alias("k")).groupBy("table_id", "k").agg(F.count("*").alias("m"))
    order = F.struct((-c("m")).alias("m"), c("k"))
    many = F.min(F.when(c("k") > 1, order))
    return n.groupBy("table_id").agg(F.coalesce(many["k"], F.lit(1)).alias("v"))


@query("table_bbox_merge", "WIN-21..22", """WITH o AS (SELECT *, lag(y) OVER (PARTITION BY table_id, x0, x1 ORDER BY y, seq) AS prev FROM fx_seg),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR y - prev > 22 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, x0, x1 ORDER BY y, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM o)
SELECT table_id, x0, x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM g GROUP BY table_id, x0, x1, grp""", uses="fx_seg")
def table_bbox_merge(spark, sf):
    """Boxes of one width that stand on each other become one."""
    w = Window.partitionBy("table_id", "x0", "x1").orderBy("y", "seq")
    o = relation(spark, sf, "fx_seg").withColumn("prev", F.lag("y").over(w))
    g = o.withColumn("grp", F.sum(F.when(c("prev").isNull() | (c("y") - c("prev") > 22), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("table_id", "x0", "x1", "grp").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).drop("grp")


_PARA = """WITH l AS (SELECT doc_id, ord AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
p AS (SELECT *, sum(CASE WHEN pos = 1 OR length(line) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS para FROM l)
"""


@query("merge_text_paragraph", "WIN-23 WIN-26", _PARA + "SELECT doc_id, CAST(para AS BIGINT) AS para, md5(string_agg(line, '' ORDER BY pos)) AS digest, min(pos) AS first_pos, max(pos) AS last_pos FROM p GROUP BY doc_id, para")
def merge_text_paragraph(spark, sf):
    """A paragraph starts at the first line and at each that is marked as a start (here: long ones)."""
    l = relation(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (c("pos") + 1).cast("long"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = l.withColumn("para", F.sum(F.when((c("pos") == 1) | (F.length("line") > 200), 1).otherwise(0)).over(w))
    s = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return p.groupBy("doc_id", "para").agg(F.md5(F.array_join(F.transform(s, lambda x: x["line"]), "")).alias("digest"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def line_type(start: Column, end: Column, font: float, least: float) -> Column:
    """Start, end or middle of a paragraph from the indents at both ends."""
    a, b = start / font, end / font
    return (
        F.when((start >= least) & (a >= 1), "START").when((start < least) & (least < end) & (b >= 1), "END")
        .when((start < least) & (end < least) | (a < 1) & (b < 1), "MIDDLE").when((start >= least) & (a > 2) & (end > least) & (b > 2), "START").otherwise("NONE")
    )


_A, _B = "abs(ax1 - 100)", "abs(ax2 - 200)"
scalar("parse_line_type", "WIN-25 AGG-29", "boxes", "id", lambda: line_type(F.abs(c("ax1") - 100), F.abs(c("ax2") - 200), 12.0, 10.0),
       f"CASE WHEN {_A} >= 10 AND {_A} / 12 >= 1 THEN 'START' WHEN {_A} < 10 AND 10 < {_B} AND {_B} / 12 >= 1 THEN 'END' WHEN ({_A} < 10 AND {_B} < 10) OR ({_A} / 12 < 1 AND {_B} / 12 < 1) THEN 'MIDDLE' WHEN {_A} >= 10 AND {_A} / 12 > 2 AND {_B} > 10 AND {_B} / 12 > 2 THEN 'START' ELSE 'NONE' END")
_RUNS = """WITH v AS (SELECT DISTINCT grp, k % 400 AS v FROM boxes), g AS (SELECT grp, v, v - row_number() OVER (PARTITION BY grp ORDER BY v) AS run FROM v), r AS (SELECT grp, min(v) AS lo, max(v) + 1 AS hi FROM g GROUP BY grp, run) """


def _runs(spark, sf):
    v = relation(spark, sf, "boxes").select("grp", (c("k") % 400).alias("v")).distinct()
    g = v.withColumn("run", c("v") - F.row_number().over(Window.partitionBy("grp").orderBy("v")))
    return g.groupBy("grp", "run").agg(F.min("v").alias("lo"), (F.max("v") + 1).alias("hi")).drop("run")


@query("sub_array", "WIN-27", _RUNS + "SELECT grp, lo, hi FROM r", uses="boxes")
def sub_array(spark, sf):
    """Runs of consecutive numbers, the end one past the last."""
    return _runs(spark, sf)


@query("sub_array_short", "WIN-28", _RUNS + "SELECT grp, lo, hi - 1 AS hi FROM r WHERE hi - lo BETWEEN 2 AND 3", uses="boxes")
def sub_array_short(spark, sf):
    return _runs(spark, sf).filter((c("hi") - c("lo")).between(2, 3)).withColumn("hi", c("hi") - 1)


@query("mask_projection", "WIN-64", """WITH n AS (SELECT grp, CAST(ay1 AS BIGINT) AS y, count(*) AS n FROM boxes GROUP BY grp, CAST(ay1 AS BIGINT)), k AS (SELECT grp, y, y - 2 * row_number() OVER (PARTITION BY grp ORDER BY y) AS run FROM n WHERE n > 3)
SELECT grp, min(y) AS lo, max(y) + 1 AS hi FROM k GROUP BY grp, run HAVING count(*) > 2""", uses="boxes")
def mask_projection(spark, sf):
    """Runs of rows whose profile exceeds the threshold; short runs are dropped (rows stand two apart here)."""
    n = relation(spark, sf, "boxes").groupBy("grp", c("ay1").cast("long").alias("y")).agg(F.count("*").alias("n")).filter("n > 3")
    k = n.withColumn("run", c("y") - 2 * F.row_number().over(Window.partitionBy("grp").orderBy("y")))
    return k.groupBy("grp", "run").agg(F.min("y").alias("lo"), (F.max("y") + 1).alias("hi"), F.count("*").alias("m")).filter("m > 2").select("grp", "lo", "hi")


@query("one_cell_text", "WIN-32..33", _recursive(""", x AS (SELECT t.table_id, t.seq, t.text, t.x0, coalesce(min_by(m.y, m.grp), CAST(t.y0 AS DOUBLE)) AS y FROM fx_text t LEFT JOIN m ON m.table_id = t.table_id AND abs(t.y0 - m.y) <= 2 + 1e-5 * abs(m.y) GROUP BY t.table_id, t.seq, t.text, t.x0, t.y0)
SELECT table_id, md5(string_agg(text, '' ORDER BY y, x0, seq)) AS digest FROM x GROUP BY table_id"""))
def one_cell_text(spark, sf):
    """Texts in reading order: by merged line, then x."""
    lines = find_close_norm_x(spark, sf).join(relation(spark, sf, "fx_text").select("table_id", "seq", "x0", "text"), ["table_id", "seq"])
    s = F.array_sort(F.collect_list(F.struct("y", "x0", "seq", "text")))
    return lines.groupBy("table_id").agg(F.md5(F.array_join(F.transform(s, lambda v: v["text"]), "")).alias("digest"))


@query("set_edges", "WIN-35", """SELECT c.table_id, c.cell_id, coalesce(bool_or(s.x0 <= c.x1 AND s.x1 >= c.x2 AND abs(s.y - c.y1) <= 2), false) AS top, coalesce(bool_or(s.x0 <= c.x1 AND s.x1 >= c.x2 AND abs(s.y - c.y2) <= 2), false) AS bottom FROM fx_cells c LEFT JOIN fx_seg s ON s.table_id = c.table_id GROUP BY c.table_id, c.cell_id""", uses="fx_cells fx_seg")
def set_edges(spark, sf):
    """A line marks the edges of all cells between its ends."""
    cl, s = relation(spark, sf, "fx_cells").alias("c"), relation(spark, sf, "fx_seg").alias("s")
    over = (c("s.x0") <= c("c.x1")) & (c("s.x1") >= c("c.x2"))
    flag = lambda y: F.coalesce(F.bool_or(over & (F.abs(c("s.y") - c(y)) <= 2)), F.lit(False))
    return cl.join(s, c("s.table_id") == c("c.table_id"), "left").groupBy("c.table_id", "c.cell_id").agg(flag("c.y1").alias("top"), flag("c.y2").alias("bottom"))


scalar("set_all_edges", "WIN-36", "fx_cells", "table_id cell_id", lambda: {k: F.lit(True) for k in ("top", "bottom", "is_left", "is_right")}, {k: "true" for k in ("top", "bottom", "is_left", "is_right")})


def spans(left: Column, right: Column, top: Column, bottom: Column) -> dict[str, Column]:
    """Whether a cell spans its neighbours, from its four edges."""
    n = sum((x.cast("int") for x in (left, right, top, bottom)), F.lit(0))
    h = (n == 3) & ((~left) | (~right)) | (n == 2) & top & bottom | (n <= 1)
    v = (n == 3) & ((~top) | (~bottom)) | (n == 2) & left & right | (n <= 1)
    return {"hspan": h, "vspan": v}


_E = {"l": "pk % 2 = 0", "r": "sk % 2 = 0", "t": "pk % 3 > 0", "b": "sk % 3 > 0"}
_N = " + ".join(f"CAST({v} AS INT)" for v in _E.values())
scalar("set_span", "WIN-38", "fx_cells", "table_id cell_id", lambda: spans(c("pk") % 2 == 0, c("sk") % 2 == 0, c("pk") % 3 > 0, c("sk") % 3 > 0),
       {"hspan": f"CASE WHEN {_N} = 4 THEN false WHEN {_N} = 3 THEN NOT ({_E['l']}) OR NOT ({_E['r']}) WHEN {_N} = 2 THEN ({_E['t']}) AND ({_E['b']}) ELSE true END",
        "vspan": f"CASE WHEN {_N} = 4 THEN false WHEN {_N} = 3 THEN NOT ({_E['t']}) OR NOT ({_E['b']}) WHEN {_N} = 2 THEN ({_E['l']}) AND ({_E['r']}) ELSE true END"})


@query("reduce_index", "WIN-39 WIN-41", "SELECT table_id, cell_id, coalesce(last_value(CASE WHEN pk % 2 = 0 THEN col_idx END IGNORE NULLS) OVER (PARTITION BY table_id, row_idx ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM fx_cells", uses="fx_cells")
def reduce_index(spark, sf):
    """Left until a cell that is bounded on the left."""
    w = Window.partitionBy("table_id", "row_idx").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    cl = relation(spark, sf, "fx_cells")
    return cl.select("table_id", "cell_id", F.coalesce(F.last(F.when((c("pk") + 0) % 2 == 0, c("col_idx")), ignorenulls=True).over(w), F.lit(0)).alias("v"))


@query("copy_spanning_text", "WIN-40 WIN-42", "SELECT table_id, cell_id, last_value(CASE WHEN (pk + col_idx) % 3 > 0 THEN concat('t', sk) END IGNORE NULLS) OVER (PARTITION BY table_id, row_idx ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS text FROM fx_cells", uses="fx_cells")
def copy_spanning_text(spark, sf):
    """An empty cell takes the text of the nearest filled one on its left."""
    w = Window.partitionBy("table_id", "row_idx").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    text = F.when((c("pk") + c("col_idx")) % 3 > 0, F.concat(F.lit("t"), c("sk").cast("string")))
    return relation(spark, sf, "fx_cells").select("table_id", "cell_id", F.last(text, ignorenulls=True).over(w).alias("text"))


@query("one_column_cells_merge", "WIN-54", """WITH o AS (SELECT table_id, row_idx, (pk + col_idx) % 2 = 0 AS l, (sk + col_idx) % 2 = 0 AS r, col_idx AS i FROM fx_cells)
SELECT table_id, row_idx, bool_and(CASE WHEN i = 0 THEN l AND NOT r WHEN i = 3 THEN r AND NOT l ELSE NOT l AND NOT r END) AS v FROM o GROUP BY table_id, row_idx""", uses="fx_cells")
def one_column_cells_merge(spark, sf):
    """The cells of a row form one: the first is closed on the left only, the last on the right only, the others not at all."""
    l, r, i = (c("pk") + c("col_idx")) % 2 == 0, (c("sk") + c("col_idx")) % 2 == 0, c("col_idx")
    ok = F.when(i == 0, l & ~r).when(i == 3, r & ~l).otherwise(~l & ~r)
    return relation(spark, sf, "fx_cells").groupBy("table_id", "row_idx").agg(F.bool_and(ok).alias("v"))


_CH = "WITH ch AS (SELECT p_partkey, substr(p_type, CAST(i AS INT), 1) AS ch, CAST(i AS INT) AS i FROM part, unnest(range(1, length(p_type) + 1)) u(i))"


def _chars(spark, sf):
    return relation(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_type", "")).alias("i", "ch")).filter("ch <> ''").withColumn("i", c("i") + 1)


@query("word_info", "WIN-56", _CH + """, s AS (SELECT *, CASE WHEN regexp_matches(ch, '[a-zA-Z0-9]') THEN 'en' ELSE 'sep' END AS st FROM ch), g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, st ORDER BY i) AS run FROM s)
SELECT p_partkey, min(i) AS at, string_agg(ch, '' ORDER BY i) AS word FROM g WHERE st = 'en' GROUP BY p_partkey, run""")
def word_info(spark, sf):
    """Runs of letters and digits; other characters divide them."""
    s = _chars(spark, sf).filter(c("ch").rlike("[a-zA-Z0-9]"))
    g = s.withColumn("run", c("i") - F.row_number().over(Window.partitionBy("p_partkey").orderBy("i")))
    a = F.array_sort(F.collect_list(F.struct("i", "ch")))
    return g.groupBy("p_partkey", "run").agg(F.min("i").alias("at"), F.array_join(F.transform(a, lambda x: x["ch"]), "").alias("word")).drop("run")


_SEQ = "WITH t AS (SELECT id, grp, k % 5 AS tok, score_pct, lag(k % 5) OVER (PARTITION BY grp ORDER BY id) AS prev FROM boxes)"


@query("ctc_decode", "WIN-57 WIN-59..60", _SEQ + " SELECT grp, count(*) FILTER (keep) AS n, md5(coalesce(string_agg(CAST(tok AS VARCHAR), '' ORDER BY id) FILTER (keep), '')) AS digest, round(coalesce(avg(score_pct / 100e0) FILTER (keep), 0), 9) AS conf FROM (SELECT *, tok <> 0 AND (prev IS NULL OR prev <> tok) AS keep FROM t) GROUP BY grp", uses="boxes")
def ctc_decode(spark, sf):
    """Repeats and then blanks are dropped; the confidence is the mean of what stays."""
    t = relation(spark, sf, "boxes").select("id", "grp", (c("k") % 5).alias("tok"), "score_pct")
    prev = F.lag("tok").over(Window.partitionBy("grp").orderBy("id"))
    kept = t.withColumn("keep", (c("tok") != 0) & (prev.isNull() | (prev != c("tok"))))
    a = F.array_sort(F.collect_list(F.when(c("keep"), F.struct("id", "tok"))))
    text = F.array_join(F.transform(a, lambda x: x["tok"].cast("string")), "")
    return kept.groupBy("grp").agg(F.count_if("keep").alias("n"), F.md5(text).alias("digest"), F.round(F.coalesce(F.avg(F.when(c("keep"), c("score_pct") / 100.0)), F.lit(0.0)), 9).alias("conf"))


@query("pred_reverse", "WIN-58", _CH + """, s AS (SELECT *, CASE WHEN regexp_matches(ch, '[a-zA-Z0-9 :*./%+-]') THEN 1 ELSE 0 END AS st FROM ch), b AS (SELECT *, CASE WHEN st = 1 AND lag(st) OVER (PARTITION BY p_partkey ORDER BY i) = 1 THEN 0 ELSE 1 END AS nw FROM s), r AS (SELECT *, sum(nw) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT p_partkey, string_agg(ch, '' ORDER BY run DESC, i) AS v FROM r GROUP BY p_partkey""")
def pred_reverse(spark, sf):
    """The order of runs is reversed; runs of plain characters keep their own order."""
    w = Window.partitionBy("p_partkey").orderBy("i")
    s = _chars(spark, sf).withColumn("st", c("ch").rlike("[a-zA-Z0-9 :*./%+-]").cast("int"))
    b = s.withColumn("nw", F.when((c("st") == 1) & (F.lag("st").over(w) == 1), 0).otherwise(1))
    r = b.withColumn("run", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = F.array_sort(F.collect_list(F.struct((-c("run")).alias("r"), c("i"), c("ch"))))
    return r.groupBy("p_partkey").agg(F.array_join(F.transform(a, lambda x: x["ch"]), "").alias("v"))


@query("table_label_decode", "WIN-61..63", _SEQ + ", e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS i FROM t), s AS (SELECT grp, min(i) FILTER (tok = 4 AND i > 0) AS stop FROM e GROUP BY grp) SELECT e.grp, count(*) FILTER (tok <> 3) AS n, round(avg(score_pct / 100e0) FILTER (tok <> 3), 9) AS score FROM e JOIN s ON s.grp = e.grp WHERE stop IS NULL OR i < stop GROUP BY e.grp", uses="boxes")
def table_label_decode(spark, sf):
    """Up to the first end token (not at the start), without ignored tokens."""
    w = Window.partitionBy("grp").orderBy("id")
    e = relation(spark, sf, "boxes").select("grp", "id", (c("k") % 5).alias("tok"), "score_pct").withColumn("i", F.row_number().over(w) - 1)
    stop = e.groupBy("grp").agg(F.min(F.when((c("tok") == 4) & (c("i") > 0), c("i"))).alias("stop"))
    kept = e.join(stop, "grp").filter(c("stop").isNull() | (c("i") < c("stop")))
    return kept.groupBy("grp").agg(F.count_if(c("tok") != 3).alias("n"), F.round(F.avg(F.when(c("tok") != 3, c("score_pct") / 100.0)), 9).alias("score"))
