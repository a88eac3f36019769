"""Order-dependent kernels against naive versions, and worked examples."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.functions import geometry as g
from quillgrid.functions import text as t
from quillgrid.operators import kernels as k
from quillgrid.plans.folds import merge_close
from quillgrid.sources import readers, writers


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], list(cols) or ["x"])
    return df.select(column.alias("v")).first().v


def test_worked_examples(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    a, b = lit(0, 0, 10, 10), lit(5, 0, 15, 10)
    assert value(spark, g.iou(a, b)) == pytest.approx(50 / 150)
    assert value(spark, g.iou_eps(a, b)) == pytest.approx(50 / (150 + 1e-6))
    assert value(spark, g.overlap_of_smaller(a, b)) == 0.5
    assert value(spark, g.corner_distance(a, b)) == 15
    assert value(spark, F.array(*g.scale_to_image(lit(10, 90, 20, 70), 2, 2, 100))) == [20, 20, 40, 60]
    assert value(spark, merge_close(F.array(*lit(0, 1, 2.5, 9)), 2)) == [1.5, 9]
    assert value(spark, readers.page_numbers(F.lit("1,4-end"), F.lit(6))) == [1, 4, 5, 6]
    assert value(spark, t.chinese_number(F.lit("十三"))) == 13
    assert value(spark, t.chinese_number(F.lit("二百五"))) == 205
    assert value(spark, t.ocr_post_process(F.lit("O"))) == "0"
    assert value(spark, t.ocr_post_process(F.lit("1.234.56"))) == "1,234.56"
    assert value(spark, t.empty_box_tokens(F.lit("<eb2></eb2>"))) == "<td><b> </b></td>"
    assert value(spark, F.array(t.span_of(F.lit('<td colspan="2"></td>'), "colspan"), t.span_of(F.lit('<td colspan="2"></td>'), "rowspan"))) == [2, 1]
    assert value(spark, t.one_bold(F.array(F.lit("<b>a</b>"), F.lit("<b>b</b>")), " ")) == "<b>a b</b>"


def naive_nms(boxes, scores, threshold):
    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        o = max(w, 0) * max(h, 0)
        return o / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - o)

    kept = []
    for i in sorted(range(len(boxes)), key=lambda i: (-scores[i], i)):
        if all(iou(boxes[i], boxes[j]) <= threshold for j in kept):
            kept.append(i)
    return kept


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(1, 30), st.integers(1, 30), st.integers(0, 9)), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_greedy_nms(items):
    b = np.array([(x, y, x + w, y + h) for x, y, w, h, _ in items], float)
    s = np.array([i[4] for i in items], float)
    assert k.greedy_nms(b, s, 0.3) == naive_nms(b.tolist(), s.tolist(), 0.3)
    one = k.multiclass_nms(b, s, np.zeros(len(b)), -1, 0.3)
    assert sorted(one) == sorted(k.greedy_nms(b, s, 0.3))


def test_cliques():
    rng = random.Random(3)
    for _ in range(20):
        n = 7
        edges = {(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        full = lambda q: all((i, j) in edges for i, j in itertools.combinations(q, 2))
        sets = [set(q) for r in range(1, n + 1) for q in itertools.combinations(range(n), r) if full(q)]
        want = sorted(sorted(q) for q in sets if not any(q < p for p in sets))
        assert k.cliques(n, edges) == want


def test_teds():
    a = "<table><tr><td>ab</td><td>c</td></tr></table>"
    assert k.teds(a, a) == 1.0
    assert k.teds(a, "") == 0.0
    # one of the two letters of one cell differs: half a rename among four nodes
    assert k.teds(a, a.replace(">ab<", ">ax<")) == pytest.approx(1 - 0.5 / 4)
    assert k.teds(a, a.replace(">ab<", ">ax<"), structure_only=True) == 1.0
    # a cell more: one insertion among five nodes
    assert k.teds(a, a.replace("</tr>", "<td>d</td></tr>")) == pytest.approx(1 - 1 / 5)
    assert k.bracket(k.table_tree("<table><tr></tr></table>")) == '{"tag": table{"tag": tr}}'


def test_small_kernels():
    assert k.occupied_places([[(2, 1), (1, 1)], [(1, 1)]]) == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]
    assert k.covered_share([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (6, 0), (6, 4), (2, 4)]) == pytest.approx(0.5)
    assert [k.digits_to_chinese(n) for n in (0, 10, 13, 105, 205, 1010, 20300)] == ["零", "十", "十三", "一百零五", "二百零五", "一千零一十", "二万零三百"]
    assert k.html_text("<p>a<script>x</script>b&amp;c</p>") == "ab&c"
    assert k.mark_cells("<table><tr><td>a</td><td>b</td></tr></table>", {(0, 1)}) == '<table><tr><td>a</td><td style="background-color:yellow">b</td></tr></table>'
    cells = [{"l": True, "r": False, "x1": 0, "x2": 1}, {"l": False, "r": True, "x1": 1, "x2": 2}, {"l": False, "r": True, "x1": 2, "x2": 3}]
    merged, dropped = k.merge_open_cells(cells, "l", "r", "x1", "x2")
    assert [(m["x1"], m["x2"]) for m in merged] == [(0, 2)] and dropped == 1
    assert k.sorted_boxes(np.array([[50, 0, 60, 5], [0, 3, 10, 9], [0, 40, 5, 45]])) == [1, 0, 2]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "label.txt").write_text("a.png\t<table>1</table>\nb.png\t<x/>\na.png\t<table>2</table>\n")
    got = {r.img_name: r.html for r in readers.label_html(spark, str(tmp_path / "label.txt")).collect()}
    assert got == {"a.png": "<table>2</table>", "b.png": "<x/>"}
    for d, text in (("boxes", "0,0;1,0;1,1;0,1\nbad\n"), ("logic", "0,0,1,1\n2,2,3,3\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "t.txt").write_text(text)
    r = readers.quads(spark, str(tmp_path / "boxes"), str(tmp_path / "logic")).collect()
    assert [(x.file, x.pos, list(x.quad), list(x.axis)) for x in r] == [("t.txt", 0, [0, 0, 1, 0, 1, 1, 0, 1], [0, 0, 1, 1])]
    (tmp_path / "vocab.txt").write_text("x\ny\nOTHER\n")
    assert {(v.token, v.id) for v in readers.vocabulary(spark, str(tmp_path / "vocab.txt"), 1).collect()} == {("x", 1), ("y", 2), ("OTHER", 3)}
    assert {(v.label, v.id) for v in readers.bio_labels(spark, str(tmp_path / "vocab.txt")).collect()} == {("O", 0), ("B-X", 1), ("I-X", 2), ("B-Y", 3), ("I-Y", 4)}
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a"}], "annotations": [{"id": 5, "image_id": 1, "segmentation": [[0,0,1,0,1,1,0,1]], "logic_axis": [[0,0,1,1]], "bbox": [0,0,1,1], "category_id": 1}]}')
    c = readers.coco(spark, str(tmp_path / "c.json")).first()
    assert (c.file_name, c.pos, list(c.axis)) == ("a", 5, [0, 0, 1, 1])
    rows = readers.table_rows(spark, str(tmp_path / "label.txt"), [1], skip_first=1).collect()
    assert [x.c1 for x in sorted(rows, key=lambda x: x.pos)] == ["<x/>", "<table>2</table>"]
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "ü|")], "t int, i int, v string")
    writers.csv(df, str(tmp_path / "csv"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "csv")).collect()) == ['"1","0","a"', '"1","1","ü|"']
    assert writers.markdown(df, ["t"], "i", ["v"]).first().markdown == "| v |\n|---|\n| a |\n| ü\\| |"
    assert writers.sqlite(df, str(tmp_path / "x.db"), "page-1-table-0") == 2
    assert {f.size for f in readers.files(spark, str(tmp_path), "vocab.txt").collect()} == {10}


def test_seam_keeps_errors(spark):
    from quillgrid.operators.seam import register, run_stage
    from quillgrid.session import ensure_workers

    ensure_workers(spark)
    register("bad", lambda rows: 1 / 0)
    r = run_stage(spark.range(2), "bad", "id long, score double").collect()
    assert r and all("division" in x.error for x in r)


def test_seam_keeps_rows(spark):
    """One failing row of ten, a stage that makes two rows of one, and a factory that a worker calls once."""
    from quillgrid.operators.seam import register, register_factory, run_stage
    from quillgrid.session import ensure_workers

    ensure_workers(spark)
    register("odd", lambda rows: [(i, 1.0 / (i - 4)) for (i,) in rows])
    r = {x.id: x for x in run_stage(spark.range(10).coalesce(1), "odd", "id long, score double").collect()}
    assert sorted(r) == list(range(10)) and [i for i in r if r[i].error] == [4]
    assert r[4].score is None and "division" in r[4].error and r[5].score == 1.0

    def load():
        calls = {"n": 0}

        def stage(rows):
            calls["n"] += 1
            return [[(i, calls["n"])] * 2 for (i,) in rows]

        return stage

    register_factory("twice", load)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = run_stage(spark.range(20).coalesce(1), "twice", "id long, call long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 40 and {x.call for x in out} == {1, 2, 3, 4}


def test_reading_order_is_one_pass():
    box = lambda x, y: (x, y, x + 5, y + 5)
    assert k.sorted_boxes(np.array([box(50, 0), box(40, 3), box(10, 6)])) == [1, 2, 0]
    assert k.sorted_boxes(np.array([box(0, 30), box(9, 0), box(1, 2)])) == [2, 1, 0]


def test_deep_and_malformed_tables():
    deep = "<table>" + "<tr><table>" * 3000 + "<td>x</td>"
    assert k.teds(deep, deep.replace("x", "x "), structure_only=True) == 1.0 and k.count_nodes(k.table_tree(deep)) > 6000
    assert k.bracket(k.table_tree("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>")).count("{") == 6
    one = "<table><![foo[x]]><tr><td colspan='\u00b2'>a</td></tr></table>"
    assert k.teds(one, one) == 1.0 and k.html_text("<p>a</p><![foo[x]]>") == "a"


def test_every_supplier_is_a_page(spark):
    from quillgrid import registry
    from quillgrid.session import ensure_workers

    ensure_workers(spark)
    sf = "/root/testdata/sf0.01"
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").distinct().count()
    for name in ("hard_nms", "multiclass_nms", "nms_inter_classes", "rotated_nms", "sorted_boxes"):
        assert registry.queries()[name](spark, sf).select("page").distinct().count() == suppliers
    # pages where a box of another label starts near a corner of a table
    lay = registry.relation(spark, sf, "fx_layout")
    t, o = lay.filter("label = 'table'").alias("t"), lay.filter("label <> 'table'").alias("o")
    gap = lambda a, b: F.least(F.abs(F.col(f"t.{a}1") - F.col(f"o.{b}1")), F.abs(F.col(f"t.{a}2") - F.col(f"o.{b}1")))
    near = t.join(o, (F.col("t.page") == F.col("o.page")) & (gap("x", "x") + gap("y", "y") <= 40)).select("t.page").distinct().count()
    assert near > 20 and registry.queries()["snap_corners"](spark, sf).select("page").distinct().count() == near
