"""Box and coordinate algebra: one query for each operator, over the ``boxes`` relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import box, d
from ..registry import query, scalar
from .relations import relation

A, B = (lambda: box("a")), (lambda: box("b"))
K = "id"
SX, SY, H = 1.5, 0.75, 250.0


def _s(name, ids, column, sql, base="boxes", keys=K):
    scalar(name, ids, base, keys, column, sql)


def _named(b, names="x1 y1 x2 y2"):
    return dict(zip(names.split(), b))


c = F.col
_s("translate", "PRJ-01", lambda: c("bx1") + c("ax1"), "bx1 + ax1")
_s("scale", "PRJ-02", lambda: c("ax1") * d(SX), "ax1 * CAST(1.5 AS DOUBLE)")
_SCALED = {"x1": "round_even(ax1 * 1.5e0, 0)", "y1": "round_even(abs(ay1 - 250e0) * 0.75e0, 0)", "x2": "round_even(ax2 * 1.5e0, 0)", "y2": "round_even(abs(ay2 - 250e0) * 0.75e0, 0)"}
_s("scale_pdf", "PRJ-03 PRJ-08..09 PRJ-37", lambda: _named(g.scale_to_image(A(), SX, SY, H)), _SCALED)
_s("scale_point", "PRJ-04", lambda: dict(zip(("x", "y"), g.scale_to_image(A(), SX, SY, H))), {"x": _SCALED["x1"], "y": _SCALED["y1"]})
_PLAIN = {"x1": "ax1 * 1.5e0", "y1": "abs(ay1 - 250e0) * 0.75e0", "x2": "ax2 * 1.5e0", "y2": "abs(ay2 - 250e0) * 0.75e0"}
_s("scale_image", "PRJ-05", lambda: _named(g.scale_unrounded(A(), SX, SY, H)), _PLAIN)
_s("scale_image_bbox", "PRJ-06 PRJ-38", lambda: _named(g.scale_unrounded(B(), SX, SY, H)), {k: v.replace("ax", "bx").replace("ay", "by") for k, v in _PLAIN.items()})
_s("pdf_scaler", "PRJ-07", lambda: {"to_image_x": (c("ax2") + 1) / (c("bx2") + 20), "to_image_y": (c("ay2") + 1) / (c("by2") + 20), "to_page_x": (c("bx2") + 20) / (c("ax2") + 1), "to_page_y": (c("by2") + 20) / (c("ay2") + 1)},
   {"to_image_x": "(ax2 + 1) / (bx2 + 20)", "to_image_y": "(ay2 + 1) / (by2 + 20)", "to_page_x": "(bx2 + 20) / (ax2 + 1)", "to_page_y": "(by2 + 20) / (ay2 + 1)"})
_s("point_scale", "PRJ-11", lambda: {"x": c("ax1") * d(SX), "y": c("ay1") * d(SY), "y_compat": c("ay1") * d(SX)}, {"x": "ax1 * 1.5e0", "y": "ay1 * 0.75e0", "y_compat": "ay1 * 1.5e0"})
_s("line_scale", "PRJ-12", lambda: {"x1": c("ax1") * d(SX), "y1": c("ay1") * d(SY), "x2": c("ax2") * d(SX), "y2": c("ay2") * d(SY)}, {"x1": "ax1 * 1.5e0", "y1": "ay1 * 0.75e0", "x2": "ax2 * 1.5e0", "y2": "ay2 * 0.75e0"})
_s("point_key", "PRJ-13", lambda: F.concat_ws("_", F.bround(c("ax1") / 2, 0).cast("long"), F.bround(c("ay1") / 2, 0).cast("long")), "concat_ws('_', CAST(round_even(ax1 / 2, 0) AS BIGINT), CAST(round_even(ay1 / 2, 0) AS BIGINT))")
_s("quad_to_box", "PRJ-14 PRJ-50", lambda: {"x1": F.array_min(F.array("ax1", "ax2", "bx1", "bx2")), "y1": F.array_min(F.array("ay1", "ay2", "by1", "by2")), "x2": F.array_max(F.array("ax1", "ax2", "bx1", "bx2")), "y2": F.array_max(F.array("ay1", "ay2", "by1", "by2"))},
   {"x1": "least(ax1, ax2, bx1, bx2)", "y1": "least(ay1, ay2, by1, by2)", "x2": "greatest(ax1, ax2, bx1, bx2)", "y2": "greatest(ay1, ay2, by1, by2)"})
_s("center_point", "PRJ-15", lambda: {"x": F.bround((c("ax1") + c("ax2")) / 2, 0), "y": F.bround((c("ay1") + c("ay2")) / 2, 0)}, {"x": "round_even((ax1 + ax2) / 2, 0)", "y": "round_even((ay1 + ay2) / 2, 0)"})
_L = ("ax1", "ay1", "ax2", "ay2")
_s("box_key", "PRJ-16", lambda: F.concat_ws("_", *[c(x).cast("long") for x in _L]), "concat_ws('_', " + ", ".join(f"CAST({x} AS BIGINT)" for x in _L) + ")")
_s("computing_span", "PRJ-18 PRJ-67 JOI-69", lambda: g.euclid(c("ax1"), c("ay1"), c("bx2"), c("by2")), "sqrt((ax1 - bx2) * (ax1 - bx2) + (ay1 - by2) * (ay1 - by2))")
_DIST = lambda p, q: f"sqrt(({p}x - {q}x) * ({p}x - {q}x) + ({p}y - {q}y) * ({p}y - {q}y))"


def _sides(first):
    pts = [("ax1", "ay1"), ("ax2", "by1"), ("bx2", "by2"), ("bx1", "ay2")]
    (p, q), (r, s) = ((pts[0], pts[1]), (pts[3], pts[2])) if first else ((pts[0], pts[3]), (pts[1], pts[2]))
    return p, q, r, s


def _mean_side(first):
    p, q, r, s = _sides(first)
    return (g.euclid(c(p[0]), c(p[1]), c(q[0]), c(q[1])) + g.euclid(c(r[0]), c(r[1]), c(s[0]), c(s[1]))) / 2


def _mean_side_sql(first):
    p, q, r, s = _sides(first)
    e = lambda u, v: f"sqrt(({u[0]} - {v[0]}) * ({u[0]} - {v[0]}) + ({u[1]} - {v[1]}) * ({u[1]} - {v[1]}))"
    return f"({e(p, q)} + {e(r, s)}) / 2"


_s("col_span_length", "PRJ-19 PRJ-68", lambda: _mean_side(True), _mean_side_sql(True))
_s("row_span_length", "PRJ-20", lambda: _mean_side(False), _mean_side_sql(False))
_s("pred_logit", "PRJ-21", lambda: F.array_join(F.array(*[x.cast("string") for x in (c("col_idx") - 1, c("col_idx") - 2 + c("col_span"), c("row_idx") - 1, c("row_idx") - 2 + c("row_span"))]), ","),
   "concat_ws(',', col_idx - 1, col_idx - 2 + col_span, row_idx - 1, row_idx - 2 + row_span)")
_s("check_pred_logit", "PRJ-22 AGG-08", lambda: F.array(c("col_idx") - 1, c("col_idx") - 2 + c("col_span"), c("row_idx") - 1, c("row_idx") - 2 + c("row_span")) == F.array(c("col_idx") - 1, c("col_idx") - 1, c("row_idx") - 1, c("row_idx")),
   "[col_idx - 1, col_idx - 2 + col_span, row_idx - 1, row_idx - 2 + row_span] = [col_idx - 1, col_idx - 1, row_idx - 1, row_idx]")
_QUAD = "concat_ws(',', CAST(ax1 AS BIGINT), CAST(ay1 AS BIGINT), CAST(ax2 AS BIGINT), CAST(ay1 AS BIGINT), CAST(ax2 AS BIGINT), CAST(ay2 AS BIGINT), CAST(ax1 AS BIGINT), CAST(ay2 AS BIGINT))"
_ints = lambda arr: F.array_join(F.transform(arr, lambda v: v.cast("long").cast("string")), ",")
_s("point_array", "PRJ-10 PRJ-23 PRJ-28..30", lambda: _ints(g.quad(A())), _QUAD)
_FLAGS = lambda: (c("score_pct") % 2 == 0, c("score_pct") % 3 == 0, c("score_pct") % 5 == 0, c("score_pct") % 7 == 0)
_s("show_lines", "PRJ-24", lambda: F.array_join(F.filter(F.array(*[F.when(f, F.lit(n)) for f, n in zip(_FLAGS(), ("left", "right", "top", "bottom"))]), lambda x: x.isNotNull()), ";"),
   "concat_ws(';', CASE WHEN score_pct % 2 = 0 THEN 'left' END, CASE WHEN score_pct % 3 = 0 THEN 'right' END, CASE WHEN score_pct % 5 = 0 THEN 'top' END, CASE WHEN score_pct % 7 = 0 THEN 'bottom' END)")
_s("bound", "PRJ-25", lambda: sum((f.cast("int") for f in _FLAGS()), F.lit(0)), "CAST(score_pct % 2 = 0 AS INT) + CAST(score_pct % 3 = 0 AS INT) + CAST(score_pct % 5 = 0 AS INT) + CAST(score_pct % 7 = 0 AS INT)")
_s("xywh2xyxy", "PRJ-26", lambda: {"x1": c("ax1") - c("ax2") / 2, "y1": c("ay1") - c("ay2") / 2, "x2": c("ax1") + c("ax2") / 2, "y2": c("ay1") + c("ay2") / 2}, {"x1": "ax1 - ax2 / 2", "y1": "ay1 - ay2 / 2", "x2": "ax1 + ax2 / 2", "y2": "ay1 + ay2 / 2"})
_s("xyxy2xywh", "PRJ-27", lambda: {"cx": (c("ax1") + c("ax2")) / 2, "cy": (c("ay1") + c("ay2")) / 2, "w": c("ax2") - c("ax1"), "h": c("ay2") - c("ay1")}, {"cx": "(ax1 + ax2) / 2", "cy": "(ay1 + ay2) / 2", "w": "ax2 - ax1", "h": "ay2 - ay1"})
_s("box_move_point", "PRJ-31..32", lambda: _ints(F.transform(g.quad(A()), lambda v, i: v + F.when(i % 2 == 0, d(3)).otherwise(d(-4)))),
   "concat_ws(',', CAST(ax1 + 3 AS BIGINT), CAST(ay1 - 4 AS BIGINT), CAST(ax2 + 3 AS BIGINT), CAST(ay1 - 4 AS BIGINT), CAST(ax2 + 3 AS BIGINT), CAST(ay2 - 4 AS BIGINT), CAST(ax1 + 3 AS BIGINT), CAST(ay2 - 4 AS BIGINT))")


def _clockwise():
    """Top left, top right, bottom right, bottom left: the two leftmost by y, then the two rightmost by y."""
    pts = F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("ax1", "by2"), ("bx2", "ay1"), ("ax2", "by1"), ("bx1", "ay2"))])
    by_x = F.array_sort(pts)
    by_y = lambda part: F.array_sort(F.transform(part, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    left, right = by_y(F.slice(by_x, 1, 2)), by_y(F.slice(by_x, 3, 2))
    o = F.array(left[0], right[0], right[1], left[1])
    return F.array_join(F.transform(o, lambda p: F.concat_ws(":", p["x"].cast("long"), p["y"].cast("long"))), ",")


@query("order_points_clockwise", "PRJ-34", """
WITH p AS (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY x, y) AS rx FROM (SELECT id, unnest([{'x': ax1, 'y': by2}, {'x': bx2, 'y': ay1}, {'x': ax2, 'y': by1}, {'x': bx1, 'y': ay2}], recursive := true) FROM boxes)),
q AS (SELECT id, x, y, rx > 2 AS is_right, row_number() OVER (PARTITION BY id, rx > 2 ORDER BY y, x) AS ry FROM p)
SELECT id, string_agg(concat(CAST(x AS BIGINT), ':', CAST(y AS BIGINT)), ',' ORDER BY CASE WHEN NOT is_right AND ry = 1 THEN 1 WHEN is_right AND ry = 1 THEN 2 WHEN is_right THEN 3 ELSE 4 END) AS v FROM q GROUP BY id""", uses="boxes")
def order_points_clockwise(spark, sf_dir):
    return relation(spark, sf_dir, "boxes").select("id", _clockwise().alias("v"))


@query("order_point", "PRJ-33", """
WITH p AS (SELECT id, unnest([{'x': ax1, 'y': ay1}, {'x': bx2, 'y': ay1}, {'x': ax2, 'y': by2}, {'x': bx1, 'y': ay2}], recursive := true) FROM boxes),
m AS (SELECT id, x, y, avg(x) OVER (PARTITION BY id) AS mx, avg(y) OVER (PARTITION BY id) AS my FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(atan2(y - my, x - mx), 9), x, y) - 1 AS i FROM m),
f AS (SELECT *, first_value(x) OVER (PARTITION BY id ORDER BY i) > mx AS turn FROM r)
SELECT id, string_agg(concat(CAST(x AS BIGINT), ':', CAST(y AS BIGINT)), ',' ORDER BY CASE WHEN turn THEN (i + 1) % 4 ELSE i END) AS v FROM f GROUP BY id""", uses="boxes")
def order_point(spark, sf_dir):
    """Corners by their angle around the centroid; turned by one if the first lies right of it."""
    xs, ys = ("ax1", "bx2", "ax2", "bx1"), ("ay1", "ay1", "by2", "ay2")
    mean = lambda cs: sum((c(x) for x in cs[1:]), c(cs[0])) / 4
    df = relation(spark, sf_dir, "boxes").withColumns({"mx": mean(xs), "my": mean(ys)})
    pts = F.array(*[F.struct(F.round(F.atan2(c(y) - c("my"), c(x) - c("mx")), 9).alias("t"), c(x).alias("x"), c(y).alias("y")) for x, y in zip(xs, ys)])
    df = df.withColumn("o", F.array_sort(pts))
    o = F.when(c("o")[0]["x"] > c("mx"), F.concat(F.slice("o", 4, 1), F.slice("o", 1, 3))).otherwise(c("o"))
    return df.select("id", F.array_join(F.transform(o, lambda p: F.concat_ws(":", p["x"].cast("long"), p["y"].cast("long"))), ",").alias("v"))


_s("clip_det_res", "PRJ-35", lambda: {"x": g.clip(c("bx1"), 0, 119).cast("int"), "y": g.clip(c("by1"), 0, 99).cast("int")}, {"x": "CAST(least(greatest(bx1, 0), 119) AS INT)", "y": "CAST(least(greatest(by1, 0), 99) AS INT)"})
_s("warp_boxes", "PRJ-36", lambda: _named([g.clip(v, 0, m) for v, m in zip(B(), (120, 100, 120, 100))]), {"x1": "least(greatest(bx1, 0e0), 120e0)", "y1": "least(greatest(by1, 0e0), 100e0)", "x2": "least(greatest(bx2, 0e0), 120e0)", "y2": "least(greatest(by2, 0e0), 100e0)"})
_s("box_corners", "PRJ-39", lambda: F.array_join(F.array(*[F.concat_ws(":", c(x).cast("long"), c(y).cast("long")) for x, y in (("ax1", "ay1"), ("ax2", "ay1"), ("ax2", "ay2"), ("ax1", "ay2"))]), ","),
   "concat_ws(',', " + ", ".join(f"concat(CAST({x} AS BIGINT), ':', CAST({y} AS BIGINT))" for x, y in (("ax1", "ay1"), ("ax2", "ay1"), ("ax2", "ay2"), ("ax1", "ay2"))) + ")")
_M = (0.5, -0.25, 10.0, 0.125, 2.0, -3.0)
_s("affine_transform", "PRJ-40 PRJ-43 PRJ-51 PRJ-73..76 PRJ-79..81", lambda: {"x": d(_M[0]) * c("ax1") + d(_M[1]) * c("ay1") + d(_M[2]), "y": d(_M[3]) * c("ax1") + d(_M[4]) * c("ay1") + d(_M[5])},
   {"x": "0.5e0 * ax1 + -0.25e0 * ay1 + 10e0", "y": "0.125e0 * ax1 + 2e0 * ay1 + -3e0"})


def _affine():
    """Matrix of the affine map that takes a centre to the middle of the output, scale to its width, after a turn by ``rot`` degrees.

    Closed form of the three-point solution: a turn and the one scale w / s.
    """
    rot, cx, cy, s, w, h = c("score_pct") * d(3.141592653589793) / 180, c("ax1"), c("ay1"), c("ax2") + 50, d(128), d(96)
    k, co, si = w / s, F.cos(rot), F.sin(rot)
    m = {"m00": k * co, "m01": k * si, "m10": -k * si, "m11": k * co}
    m["m02"], m["m12"] = w / 2 - m["m00"] * cx - m["m01"] * cy, h / 2 - m["m10"] * cx - m["m11"] * cy
    return {n: F.round(v, 6) for n, v in m.items()}


_K, _R = "(128e0 / (ax2 + 50))", "(score_pct * 3.141592653589793e0 / 180)"
_s("affine_matrix", "PRJ-41", _affine, {
    "m00": f"round({_K} * cos({_R}), 6)", "m01": f"round({_K} * sin({_R}), 6)", "m10": f"round(-{_K} * sin({_R}), 6) + 0e0", "m11": f"round({_K} * cos({_R}), 6)",
    "m02": f"round(64e0 - {_K} * cos({_R}) * ax1 - {_K} * sin({_R}) * ay1, 6)", "m12": f"round(48e0 - -{_K} * sin({_R}) * ax1 - {_K} * cos({_R}) * ay1, 6)"})
_s("affine_matrix_upper_left", "PRJ-42", lambda: {"m00": d(128) / (c("ax2") + 50), "m02": -(d(128) / (c("ax2") + 50)) * c("ax1")}, {"m00": "128e0 / (ax2 + 50)", "m02": "-(128e0 / (ax2 + 50)) * ax1"})
_T = "(score_pct * 0.05e0)"
_s("get_dir", "PRJ-44", lambda: {"x": F.round(c("ax1") * F.cos(c("score_pct") * d(0.05)) - c("ay1") * F.sin(c("score_pct") * d(0.05)), 6), "y": F.round(c("ax1") * F.sin(c("score_pct") * d(0.05)) + c("ay1") * F.cos(c("score_pct") * d(0.05)), 6)},
   {"x": f"round(ax1 * cos({_T}) - ay1 * sin({_T}), 6) + 0e0", "y": f"round(ax1 * sin({_T}) + ay1 * cos({_T}), 6) + 0e0"})
_s("third_point", "PRJ-45", lambda: {"x": c("bx1") - (c("ay1") - c("by1")), "y": c("by1") + (c("ax1") - c("bx1"))}, {"x": "bx1 - (ay1 - by1)", "y": "by1 + (ax1 - bx1)"})
_s("dist", "PRJ-46", lambda: (c("ax1") - c("bx1")) * (c("ax1") - c("bx1")) + (c("ay1") - c("by1")) * (c("ay1") - c("by1")), "(ax1 - bx1) * (ax1 - bx1) + (ay1 - by1) * (ay1 - by1)")
_CORNERS = (("ax1", "ay1"), ("ax2", "ay1"), ("ax2", "ay2"), ("ax1", "ay2"))


def _nearest_corner():
    sq = F.array(*[(c(x) - c("bx1")) * (c(x) - c("bx1")) + (c(y) - c("by1")) * (c(y) - c("by1")) for x, y in _CORNERS])
    return (F.array_position(sq, F.array_min(sq)) - 1).cast("int")


_SQ = "[" + ", ".join(f"({x} - bx1) * ({x} - bx1) + ({y} - by1) * ({y} - by1)" for x, y in _CORNERS) + "]"
_s("nearest_corner", "PRJ-47", _nearest_corner, f"CAST(list_position({_SQ}, list_min({_SQ})) - 1 AS INT)")
_s("normalized_ps", "PRJ-48 PRJ-78", lambda: g.clip(F.bround(c("frac"), 0), 0, 15).cast("int"), "CAST(least(greatest(round_even(frac, 0), 0), 15) AS INT)")
_s("process_logic_output", "PRJ-49", lambda: g.half_down(c("frac")), "CASE WHEN frac - floor(frac) > 0.5 THEN floor(frac) + 1 ELSE floor(frac) END")
_s("bbox_decode", "PRJ-52", lambda: _named([c("ax1") / 512 * d(640), c("ay1") / 512 * d(480), c("ax2") / 512 * d(640), c("ay2") / 512 * d(480)]), {"x1": "ax1 / 512 * 640", "y1": "ay1 / 512 * 480", "x2": "ax2 / 512 * 640", "y2": "ay2 / 512 * 480"})
_s("bbox_decode_master", "PRJ-53", lambda: _named([c("ax1") - F.floor(c("ax2") / 2), c("ay1") - F.floor(c("ay2") / 2), c("ax1") + F.floor(c("ax2") / 2), c("ay1") + F.floor(c("ay2") / 2)]),
   {"x1": "ax1 - floor(ax2 / 2)", "y1": "ay1 - floor(ay2 / 2)", "x2": "ax1 + floor(ax2 / 2)", "y2": "ay1 + floor(ay2 / 2)"})
_s("box_transform_int", "PRJ-54", lambda: _named([v.cast("int") for v in (c("ax1") - c("bx2") / 2, c("ay1") - c("by2") / 2, c("ax1") + c("bx2") / 2, c("ay1") + c("by2") / 2)]),
   {"x1": "CAST(trunc(ax1 - bx2 / 2) AS INT)", "y1": "CAST(trunc(ay1 - by2 / 2) AS INT)", "x2": "CAST(trunc(ax1 + bx2 / 2) AS INT)", "y2": "CAST(trunc(ay1 + by2 / 2) AS INT)"})
_s("coco_box_to_bbox", "PRJ-55", lambda: {"x2": c("ax1") + c("ax2"), "y2": c("ay1") + c("ay2")}, {"x2": "ax1 + ax2", "y2": "ay1 + ay2"})


def _diagonals():
    """Where the diagonals of the quad (a1, b..., a2, ...) meet; null for parallel ones."""
    x1, y1, x2, y2, x3, y3, x4, y4 = c("ax1"), c("ay1"), c("bx2"), c("by1"), c("ax2"), c("ay2"), c("bx1"), c("by2")
    den = (x1 - x3) * (y2 - y4) - (y1 - y3) * (x2 - x4)
    p, q = x1 * y3 - y1 * x3, x2 * y4 - y2 * x4
    return {"x": F.when(den != 0, (p * (x2 - x4) - (x1 - x3) * q) / den), "y": F.when(den != 0, (p * (y2 - y4) - (y1 - y3) * q) / den)}


_DEN, _P, _Q = "((ax1 - ax2) * (by1 - by2) - (ay1 - ay2) * (bx2 - bx1))", "(ax1 * ay2 - ay1 * ax2)", "(bx2 * by2 - by1 * bx1)"
_s("quad_center", "PRJ-56", _diagonals, {"x": f"CASE WHEN {_DEN} <> 0 THEN ({_P} * (bx2 - bx1) - (ax1 - ax2) * {_Q}) / {_DEN} END", "y": f"CASE WHEN {_DEN} <> 0 THEN ({_P} * (by1 - by2) - (ay1 - ay2) * {_Q}) / {_DEN} END"})


def _rank():
    """The quad's points turned so that the first is the one left of and above the centre (else as they are)."""
    pts = F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("ax2", "ay1"), ("ax2", "ay2"), ("ax1", "ay2"), ("ax1", "ay1"))])
    inside = F.transform(pts, lambda p: (p["x"] < (c("ax1") + c("ax2")) / 2) & (p["y"] < (c("ay1") + c("ay2")) / 2))
    at = F.greatest(F.array_position(inside, F.lit(True)).cast("int"), F.lit(1))
    turned = F.concat(F.slice(pts, at, F.lit(5) - at), F.slice(pts, F.lit(1), at - 1))
    return F.array_join(F.transform(turned, lambda p: F.concat_ws(":", p["x"].cast("long"), p["y"].cast("long"))), ",")


_s("rank_corners", "PRJ-57", _rank, "concat_ws(',', " + ", ".join(f"concat(CAST({x} AS BIGINT), ':', CAST({y} AS BIGINT))" for x, y in (("ax1", "ay1"), ("ax2", "ay1"), ("ax2", "ay2"), ("ax1", "ay2"))) + ")")


def _gaussian_radius(o=0.7):
    h, w = c("ay2") - c("ay1"), c("ax2") - c("ax1")
    b1, c1 = h + w, w * h * d(1 - o) / d(1 + o)
    r1 = (b1 + F.sqrt(b1 * b1 - 4 * c1)) / 2
    b2, c2 = 2 * (h + w), d(1 - o) * w * h
    r2 = (b2 + F.sqrt(b2 * b2 - 16 * c2)) / 2
    a3, b3, c3 = 4 * o, d(-2 * o) * (h + w), d(o - 1) * w * h
    r3 = (b3 + F.sqrt(b3 * b3 - d(4 * a3) * c3)) / 2
    return F.round(F.least(r1, r2, r3), 6)


_W_, _H_ = "(ax2 - ax1)", "(ay2 - ay1)"
_s("gaussian_radius", "PRJ-58", _gaussian_radius, f"""round(least(
 (({_H_} + {_W_}) + sqrt(({_H_} + {_W_}) * ({_H_} + {_W_}) - 4 * ({_W_} * {_H_} * 0.3e0 / 1.7e0))) / 2,
 ((2 * ({_H_} + {_W_})) + sqrt((2 * ({_H_} + {_W_})) * (2 * ({_H_} + {_W_})) - 16 * (0.3e0 * {_W_} * {_H_}))) / 2,
 ((-1.4e0 * ({_H_} + {_W_})) + sqrt((-1.4e0 * ({_H_} + {_W_})) * (-1.4e0 * ({_H_} + {_W_})) - 11.2e0 * (-0.3e0 * {_W_} * {_H_}))) / 2), 6)""")
_s("image_key", "PRJ-59", lambda: F.concat(F.lit("im"), c("grp").cast("string"), F.lit("_"), F.concat_ws(",", *[(c(x) / 4).cast("int") for x in ("bx1", "by1", "bx2", "by2")])),
   "concat('im', grp, '_', concat_ws(',', " + ", ".join(f"CAST(trunc({x} / 4) AS INT)" for x in ("bx1", "by1", "bx2", "by2")) + "))")
_s("x_coord", "PRJ-61", lambda: {"left": c("ax1"), "middle": c("ax1") + (c("ax2") - c("ax1")) / 2, "right": c("ax2")}, {"left": "ax1", "middle": "ax1 + (ax2 - ax1) / 2", "right": "ax2"})
_s("span_label", "PRJ-62", lambda: F.concat_ws(",", "row_idx", "col_idx", "row_span", "col_span", F.concat(F.lit("k"), c("k").cast("string"))), "concat_ws(',', row_idx, col_idx, row_span, col_span, concat('k', k))")
_s("both_box_formats", "PRJ-63", lambda: {"cx": (c("ax1") + c("ax2")) / 2, "cy": (c("ay1") + c("ay2")) / 2, "w": c("ax2") - c("ax1"), "h": c("ay2") - c("ay1"), "x1": c("ax1"), "y1": c("ay1"), "x2": c("ax2"), "y2": c("ay2")},
   {"cx": "(ax1 + ax2) / 2", "cy": "(ay1 + ay2) / 2", "w": "ax2 - ax1", "h": "ay2 - ay1", "x1": "ax1", "y1": "ay1", "x2": "ax2", "y2": "ay2"})
_s("rboxes_to_polygons", "PRJ-64", lambda: {f"p{i}": F.round(v, 6) for i, v in enumerate(g.rotated_corners(c("ax1"), c("ay1"), c("ax2") - c("ax1"), c("ay2") - c("ay1"), c("score_pct") * d(0.03)))},
   {f"p{i}": (f"round(ax1 + cos(score_pct * 0.03e0) * ((ax2 - ax1) * {sx}) - sin(score_pct * 0.03e0) * ((ay2 - ay1) * {sy}), 6)" if i % 2 == 0 else f"round(ay1 + sin(score_pct * 0.03e0) * ((ax2 - ax1) * {sx}) + cos(score_pct * 0.03e0) * ((ay2 - ay1) * {sy}), 6)")
    for i, (sx, sy) in enumerate(p for p in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)) for _ in (0, 1))})


def _rbox():
    x1, y1, x2, y2, x3, y3, x4, y4 = c("ax1"), c("ay1"), c("bx2") + 40, c("by1"), c("ax2") + 40, c("ay2") + 30, c("bx1"), c("by2") + 30
    cx, cy = (x1 + x2 + x3 + x4) / 4, (y1 + y2 + y3 + y4) / 4
    return {"cx": cx, "cy": cy, "w": (g.euclid(x1, y1, x2, y2) + g.euclid(x3, y3, x4, y4)) / 2,
            "h": g.point_line_distance(cx, cy, x1, y1, x2, y2) + g.point_line_distance(cx, cy, x3, y3, x4, y4),
            "theta": F.round((F.atan2(y2 - y1, x2 - x1) + F.atan2(y3 - y4, x3 - x4)) / 2, 6)}


@query("polygon2rbox", "PRJ-65", """
WITH q AS (SELECT id, ax1 AS x1, ay1 AS y1, bx2 + 40 AS x2, by1 AS y2, ax2 + 40 AS x3, ay2 + 30 AS y3, bx1 AS x4, by2 + 30 AS y4 FROM boxes),
m AS (SELECT *, (x1 + x2 + x3 + x4) / 4 AS cx, (y1 + y2 + y3 + y4) / 4 AS cy FROM q)
SELECT id, cx, cy, (sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) + sqrt((x3 - x4) * (x3 - x4) + (y3 - y4) * (y3 - y4))) / 2 AS w,
 abs(cx * (y2 - y1) - cy * (x2 - x1) + x2 * y1 - y2 * x1) / (sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + 1e-6)
 + abs(cx * (y4 - y3) - cy * (x4 - x3) + x4 * y3 - y4 * x3) / (sqrt((x4 - x3) * (x4 - x3) + (y4 - y3) * (y4 - y3)) + 1e-6) AS h,
 round((atan2(y2 - y1, x2 - x1) + atan2(y3 - y4, x3 - x4)) / 2, 6) AS theta FROM m""", uses="boxes")
def polygon2rbox(spark, sf_dir):
    return relation(spark, sf_dir, "boxes").select("id", *[v.alias(k) for k, v in _rbox().items()])


_s("point_line_dist", "PRJ-66", lambda: g.point_line_distance(c("ax1"), c("ay1"), c("bx1"), c("by1"), c("bx2"), c("by2")),
   "abs(ax1 * (by2 - by1) - ay1 * (bx2 - bx1) + bx2 * by1 - by2 * bx1) / (sqrt((bx2 - bx1) * (bx2 - bx1) + (by2 - by1) * (by2 - by1)) + 1e-6)")
_s("distance2bbox", "PRJ-69..70", lambda: _named([c("ax1") - c("bx1"), c("ay1") - c("by1"), g.clip(c("ax1") + c("bx2"), 0, 300), g.clip(c("ay1") + c("by2"), 0, 200)]),
   {"x1": "ax1 - bx1", "y1": "ay1 - by1", "x2": "least(greatest(ax1 + bx2, 0e0), 300e0)", "y2": "least(greatest(ay1 + by2, 0e0), 200e0)"})
_s("bbox2delta", "PRJ-71", lambda: {"dx": ((c("bx1") + c("bx2")) / 2 - (c("ax1") + c("ax2")) / 2) / (c("ax2") - c("ax1")), "dy": ((c("by1") + c("by2")) / 2 - (c("ay1") + c("ay2")) / 2) / (c("ay2") - c("ay1")),
    "dw": F.round(F.ln((c("bx2") - c("bx1")) / (c("ax2") - c("ax1"))), 6), "dh": F.round(F.ln((c("by2") - c("by1")) / (c("ay2") - c("ay1"))), 6)},
   {"dx": "((bx1 + bx2) / 2 - (ax1 + ax2) / 2) / (ax2 - ax1)", "dy": "((by1 + by2) / 2 - (ay1 + ay2) / 2) / (ay2 - ay1)", "dw": "round(ln((bx2 - bx1) / (ax2 - ax1)), 6)", "dh": "round(ln((by2 - by1) / (ay2 - ay1)), 6)"})


def _delta2bbox():
    most = F.abs(F.ln(d(16) / d(1000)))
    dx, dy, dw, dh = c("frac") / 10, c("frac") / 20, g.clip(c("frac") / 4 - 2, -most, most), g.clip(c("frac") / 5 - 2, -most, most)
    w, h = (c("ax2") - c("ax1")) * F.exp(dw), (c("ay2") - c("ay1")) * F.exp(dh)
    x, y = (c("ax1") + c("ax2")) / 2 + (c("ax2") - c("ax1")) * dx, (c("ay1") + c("ay2")) / 2 + (c("ay2") - c("ay1")) * dy
    return {k: F.round(g.clip(v, 0, m), 6) for k, v, m in (("x1", x - w / 2, 300), ("y1", y - h / 2, 200), ("x2", x + w / 2, 300), ("y2", y + h / 2, 200))}


_CAP = "abs(ln(16e0 / 1000e0))"
_EW, _EH = f"(ax2 - ax1) * exp(least(greatest(frac / 4 - 2, -{_CAP}), {_CAP}))", f"(ay2 - ay1) * exp(least(greatest(frac / 5 - 2, -{_CAP}), {_CAP}))"
_PX, _PY = "((ax1 + ax2) / 2 + (ax2 - ax1) * (frac / 10))", "((ay1 + ay2) / 2 + (ay2 - ay1) * (frac / 20))"
_s("delta2bbox", "PRJ-72", _delta2bbox, {"x1": f"round(least(greatest({_PX} - {_EW} / 2, 0e0), 300e0), 6)", "y1": f"round(least(greatest({_PY} - {_EH} / 2, 0e0), 200e0), 6)", "x2": f"round(least(greatest({_PX} + {_EW} / 2, 0e0), 300e0), 6)", "y2": f"round(least(greatest({_PY} + {_EH} / 2, 0e0), 200e0), 6)"})
_s("wh_feat", "PRJ-77", lambda: _ints(F.array(*[c(a) - c(b) for a, b in (("ax1", "bx1"), ("ay1", "by1"), ("ax1", "bx2"), ("ay1", "by1"), ("ax1", "bx2"), ("ay1", "by2"), ("ax1", "bx1"), ("ay1", "by2"))])),
   "concat_ws(',', " + ", ".join(f"CAST({a} - {b} AS BIGINT)" for a, b in (("ax1", "bx1"), ("ay1", "by1"), ("ax1", "bx2"), ("ay1", "by1"), ("ax1", "bx2"), ("ay1", "by2"), ("ax1", "bx1"), ("ay1", "by2"))) + ")")


def _border():
    """The border halved (by 1, 2, 4, ...) until what is left of the size exceeds it."""
    size, border = (c("k") + 10), F.lit(128)
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda i: size - F.floor(border / i) > F.floor(border / i))
    return F.floor(border / F.array_min(fits)).cast("int")


_s("get_border", "PRJ-82", _border, "CAST(floor(128 / list_min(list_filter([1,2,4,8,16,32,64,128,256,512,1024,2048,4096], lambda i: k + 10 - floor(128 / i) > floor(128 / i)))) AS INT)")
_s("gaussian2d", "PRJ-83", lambda: F.round(F.exp(-((c("ax1") - 90) * (c("ax1") - 90) + (c("ay1") - 90) * (c("ay1") - 90)) / d(2 * 40.0 * 40.0)), 6), "round(exp(-((ax1 - 90) * (ax1 - 90) + (ay1 - 90) * (ay1 - 90)) / 3200e0), 6)")
_s("bbox2roi", "PRJ-84", lambda: {"image": c("grp"), "x1": c("ax1"), "y1": c("ay1")}, {"image": "grp", "x1": "ax1", "y1": "ay1"})
_s("bbox2result", "PRJ-85", lambda: {f"class{i}": F.when(c("grp") % 3 == i, c("ax1")) for i in range(3)}, {f"class{i}": f"CASE WHEN grp % 3 = {i} THEN ax1 END" for i in range(3)})
_s("parse_width", "PRJ-17", lambda: {"n": F.length(F.rtrim(F.translate("p_name", "\n", ""))), "w": F.col("p_size") / F.nullif(F.length(F.rtrim(F.translate("p_name", "\n", ""))), F.lit(0))},
   {"n": "CAST(length(rtrim(replace(p_name, chr(10), ''))) AS INT)", "w": "p_size / nullif(length(rtrim(replace(p_name, chr(10), ''))), 0)"}, base="part", keys="p_partkey")
_s("table_data", "PRJ-60", lambda: F.trim(F.concat(F.lit("  "), F.col("text"), F.lit(" "))), "trim(concat('  ', text, ' '))", base="fx_text", keys="table_id seq")
# overlap measures
_O = "(CASE WHEN least(ax2, bx2) > greatest(ax1, bx1) AND least(ay2, by2) > greatest(ay1, by1) THEN (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1)) ELSE 0e0 END)"
_AA, _AB = "((ax2 - ax1) * (ay2 - ay1))", "((bx2 - bx1) * (by2 - by1))"
_s("bbox_intersection_area", "JOI-59", lambda: g.overlap(A(), B()), _O)
_s("bbox_area", "JOI-60 JOI-72", lambda: g.area(A()), _AA)
_s("compute_iou", "JOI-61 JOI-65..67", lambda: g.iou(A(), B()), f"CASE WHEN {_O} > 0 THEN {_O} / ({_AA} + {_AB} - {_O}) ELSE 0e0 END")
_s("compute_iou_v2", "JOI-62", lambda: g.iou_eps(A(), B()), f"{_O} / (abs({_AA}) + abs({_AB}) - {_O} + 1e-6)")
_s("iou_of", "JOI-71", lambda: g.iou_eps(A(), B(), 1e-5), f"{_O} / (abs({_AA}) + abs({_AB}) - {_O} + 1e-5)")
_s("corner_distance", "JOI-63..64", lambda: g.corner_distance(A(), B()), "abs(bx1 - ax1) + abs(by1 - ay1) + abs(bx2 - ax2) + abs(by2 - ay2) + least(abs(bx1 - ax1) + abs(by1 - ay1), abs(bx2 - ax2) + abs(by2 - ay2))")
_s("rect_max_iou", "JOI-70", lambda: g.overlap_of_smaller(A(), B()), f"{_O} / least({_AA}, {_AB})")
_CUT = " + ".join(f"CASE WHEN (a{x} = {f}(a{x}, b{x}) AND a{y} = {h}(a{y}, b{y})) OR (b{x} = {f}(a{x}, b{x}) AND b{y} = {h}(a{y}, b{y})) THEN 0e0 ELSE abs(a{x} - b{x}) * abs(a{y} - b{y}) / 2 END"
                  for x, y, f, h in (("x1", "y1", "least", "least"), ("x2", "y1", "greatest", "least"), ("x2", "y2", "greatest", "greatest"), ("x1", "y2", "least", "greatest")))
_s("hull_iou", "JOI-68", lambda: F.round(g.hull_iou(A(), B()), 9), f"round({_O} / ((greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)) - ({_CUT})), 9)")
