"""Text, HTML and date functions: one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..registry import query, scalar
from ..session import with_settings
from .relations import Layout, relation

c = F.col
#: Bytes up to which the different values of a column are kept as a dictionary: those of a row group, instead of a megabyte.
DICTIONARY = 1 << 27


def _p(name, ids, column, sql, base="part", keys="p_partkey"):
    scalar(name, ids, base, keys, column, sql)


# lines with the characters that cleaning is about
_DIRTY = "concat(chr(8203), p_name, chr(12288), '&nbsp', chr(57348), 'x', chr(13), chr(10))"
_DIRTY_SPARK = "concat('\\u200b', p_name, '\\u3000', '&nbsp', '\\ue004', 'x', '\\r', '\\n')"
_CLEAN = f"rtrim(ltrim(replace(replace(replace({_DIRTY}, chr(8203), ''), chr(57348), ''), chr(12288), ' '), chr(13)||chr(10)), chr(13)||chr(10))"
_p("clean_sentence", "STR-01", lambda: t.clean_sentence(F.expr(_DIRTY_SPARK)), _CLEAN)
_p("clean_sentence_all", "STR-03", lambda: t.clean_sentence_all(F.expr(_DIRTY_SPARK)), f"replace(replace({_CLEAN}, '&nbsp', ' '), '&NBSP', ' ')")
_p("clean_sentence_remove_space", "STR-04..05", lambda: t.remove_space(t.clean_sentence_all(F.expr(_DIRTY_SPARK))), f"regexp_replace(replace({_CLEAN}, '&nbsp', ' '), '[ \\t\\n\\r\\f\\v]', '', 'g')")


@query("clean_sentence_space_line", "STR-02", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS INT) AS v FROM documents")
def clean_sentence_space_line(spark, sf):
    """Lines that are not blank once cleaned."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(t.clean_sentence(x))) > 0)
    return relation(spark, sf, "documents").select("doc_id", F.size(lines).alias("v"))


def _h(name, ids, column, sql):
    scalar(name, ids, "fx_html", "table_id cell_id", column, sql)


_h("clean_table_span", "STR-06", lambda: F.translate("td", "<>", "＜＞"), "replace(replace(td, '<', '＜'), '>', '＞')")
_TABLE = "concat('<table><thead><tr>', td, '</tr></thead>', chr(10), '<tbody>', td, '</tbody></table>')"
_TABLE_SPARK = "concat('<table><thead><tr>', td, '</tr></thead>', '\\n', '<tbody>', td, '</tbody></table>')"
_h("clean_table", "STR-07", lambda: t.clean_table(F.expr(_TABLE_SPARK)), f"replace(replace(replace(replace(replace(replace({_TABLE}, chr(13), ''), chr(10), ''), '<thead>', ''), '</thead>', ''), '<tbody>', ''), '</tbody', '')")
_h("cell_colspan", "STR-08", lambda: t.span_of(c("td"), "colspan"), "coalesce(try_cast(regexp_extract(td, 'colspan=\"([0-9]+)', 1) AS INT), 1)")
_h("cell_span", "STR-09", lambda: {"colspan": t.span_of(c("td"), "colspan"), "rowspan": t.span_of(c("td"), "rowspan")}, {k: f"coalesce(try_cast(regexp_extract(td, '{k}=\"([0-9]+)', 1) AS INT), 1)" for k in ("colspan", "rowspan")})


@query("pair_structure_diff", "STR-10", """WITH s AS (SELECT *, coalesce(try_cast(regexp_extract(td, 'colspan="([0-9]+)', 1) AS INT), 1) AS cs, coalesce(try_cast(regexp_extract(td, 'rowspan="([0-9]+)', 1) AS INT), 1) AS rs FROM fx_html)
SELECT a.table_id, a.cell_id, a.cs - b.cs AS diff_col, a.rs - b.rs AS diff_row, 0 AS diff_row_compat FROM s a JOIN s b ON a.table_id = b.table_id AND a.cell_id + 1 = b.cell_id""", uses="fx_html")
def pair_structure_diff(spark, sf):
    """Difference of the spans of neighbouring cells; the compatible column keeps the constant row difference."""
    s = relation(spark, sf, "fx_html").select("table_id", "cell_id", t.span_of(c("td"), "colspan").alias("cs"), t.span_of(c("td"), "rowspan").alias("rs"))
    w = Window.partitionBy("table_id").orderBy("cell_id")
    d = s.withColumns({"ncs": F.lead("cs").over(w), "nrs": F.lead("rs").over(w)}).filter(c("ncs").isNotNull())
    return d.select("table_id", "cell_id", (c("cs") - c("ncs")).alias("diff_col"), (c("rs") - c("nrs")).alias("diff_row"), F.lit(0).alias("diff_row_compat"))


scalar("box_list_to_json", "STR-11 SNK-02 SNK-19 SNK-29..32", "boxes", "id", lambda: F.to_json(F.struct(c("row_idx").alias("r"), F.array(c("row_idx"), c("col_idx"), c("row_span")).alias("b"))),
       "concat('{\"r\":', row_idx, ',\"b\":[', row_idx, ',', col_idx, ',', row_span, ']}')")
scalar("list_to_str", "STR-12 STR-107", "boxes", "id", lambda: F.array_join(F.array(*[c(x).cast("string") for x in ("row_idx", "col_idx", "grp")]), "_"), "concat_ws('_', row_idx, col_idx, grp)")
_NUM = "CASE grp % 4 WHEN 0 THEN 'O' WHEN 1 THEN concat(row_idx, '.', k, '.', col_idx) WHEN 2 THEN concat(k, '.5') ELSE concat('n', k) END"
scalar("ocr_post_process", "STR-13", "boxes", "id", lambda: t.ocr_post_process(F.expr(_NUM)),
       f"CASE WHEN regexp_matches(trim({_NUM}), '^[oO]$') THEN '0' WHEN regexp_matches({_NUM}, '^[-0-9.,]*$') AND length({_NUM}) - length(replace({_NUM}, '.', '')) > 1 THEN concat(replace(regexp_extract({_NUM}, '^(.*)\\.[^.]*$', 1), '.', ','), '.', regexp_extract({_NUM}, '\\.([^.]*)$', 1)) ELSE {_NUM} END")


@query("build_table_cells", "STR-19..21", """SELECT table_id, seq, c0 + 1 AS col_idx, r0 + 1 AS row_idx, c1 - c0 + 1 AS col_span, r1 - r0 + 1 AS row_span, CAST(x2 - x1 AS DOUBLE) / max(x2) OVER (PARTITION BY table_id) AS width_ratio FROM fx_gt""", uses="fx_gt")
def build_table_cells(spark, sf):
    """1-based places, spans and width share from 0-based closed ranges."""
    w = F.max("x2").over(Window.partitionBy("table_id"))
    g = relation(spark, sf, "fx_gt")
    return g.select("table_id", "seq", (c("c0") + 1).alias("col_idx"), (c("r0") + 1).alias("row_idx"), (c("c1") - c("c0") + 1).alias("col_span"), (c("r1") - c("r0") + 1).alias("row_span"), ((c("x2") - c("x1")).cast("double") / w).alias("width_ratio"))


@query("modify_cell_info", "STR-22..23", """WITH xs AS (SELECT table_id, x, row_number() OVER (PARTITION BY table_id ORDER BY x) AS i FROM (SELECT DISTINCT table_id, x1 AS x FROM fx_cells UNION SELECT DISTINCT table_id, x2 FROM fx_cells))
SELECT p.table_id, p.seq, coalesce(a.i, 0) AS col_from, coalesce(b.i, 0) AS col_to FROM fx_pred p LEFT JOIN xs a ON a.table_id = p.table_id AND a.x = p.x1 LEFT JOIN xs b ON b.table_id = p.table_id AND b.x = p.x2""", uses="fx_cells fx_pred")
def modify_cell_info(spark, sf):
    """Places by exact lookup of coordinates among the grid's; a coordinate that is not there keeps 0."""
    cl = relation(spark, sf, "fx_cells")
    xs = cl.select("table_id", F.explode(F.array("x1", "x2")).alias("x")).distinct().withColumn("i", F.row_number().over(Window.partitionBy("table_id").orderBy("x")))
    p = relation(spark, sf, "fx_pred").join(xs.select("table_id", c("x").alias("x1"), c("i").alias("a")), ["table_id", "x1"], "left")
    p = p.join(xs.select("table_id", c("x").alias("x2"), c("i").alias("b")), ["table_id", "x2"], "left")
    return p.select("table_id", "seq", F.coalesce("a", F.lit(0)).alias("col_from"), F.coalesce("b", F.lit(0)).alias("col_to"))


@query("weave_text_into_tokens", "STR-24..25 STR-31 STR-36 STR-43", """WITH k AS (SELECT table_id, cell_id, row_number() OVER (PARTITION BY table_id ORDER BY cell_id) - 1 AS td FROM fx_html), x AS (SELECT table_id, text, row_number() OVER (PARTITION BY table_id ORDER BY seq) - 1 AS td FROM fx_text)
SELECT k.table_id, string_agg(concat('<td>', x.text, '</td>'), '' ORDER BY k.td) FILTER (x.text IS NOT NULL) AS dropped, string_agg(concat('<td>', coalesce(x.text, ''), '</td>'), '' ORDER BY k.td) AS kept FROM k LEFT JOIN x ON x.table_id = k.table_id AND x.td = k.td GROUP BY k.table_id""", uses="fx_html fx_text")
def weave_text_into_tokens(spark, sf):
    """The k-th cell token takes the k-th text; ``dropped`` loses cells without text, ``kept`` does not."""
    n = lambda o: F.row_number().over(Window.partitionBy("table_id").orderBy(o)) - 1
    k = relation(spark, sf, "fx_html").select("table_id", n("cell_id").alias("td"))
    x = relation(spark, sf, "fx_text").select("table_id", n("seq").alias("td"), "text")
    s = F.array_sort(F.collect_list(F.struct("td", "text")))
    j = k.join(x, ["table_id", "td"], "left").groupBy("table_id").agg(s.alias("s"))
    td = lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>"))
    some = F.filter("s", lambda e: e["text"].isNotNull())
    joined = F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda e: td(e["text"])), ""))
    return j.select("table_id", joined.alias("dropped"), F.array_join(F.transform("s", lambda e: td(F.coalesce(e["text"], F.lit("")))), "").alias("kept"))


_p("deal_successive_space", "STR-26", lambda: t.successive_space(F.replace("p_name", F.lit("e"), F.lit("   "))), "replace(replace(replace(replace(p_name, 'e', '   '), '   ', '<space>'), ' ', ''), '<space>', ' ')")


@query("reduce_repeat_bold", "STR-27..28", """SELECT table_id, row_idx, CASE WHEN bool_and(starts_with(x, '<b>')) THEN concat('<b>', string_agg(replace(replace(x, '<b>', ''), '</b>', ''), ' ' ORDER BY col_idx), '</b>') ELSE string_agg(x, ' ' ORDER BY col_idx) END AS v
FROM (SELECT *, regexp_extract(td, '<td[^>]*>(.*)</td>', 1) AS x FROM fx_html) GROUP BY table_id, row_idx""", uses="fx_html")
def reduce_repeat_bold(spark, sf):
    """Texts that are all bold get one pair of tags around them."""
    x = relation(spark, sf, "fx_html").withColumn("x", F.regexp_extract("td", "<td[^>]*>(.*)</td>", 1))
    g = x.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "x"))).alias("s"))
    return g.select("table_id", "row_idx", t.one_bold(F.transform("s", lambda e: e["x"]), " ").alias("v"))


_h("merge_span_token", "STR-29 STR-38", lambda: F.regexp_replace(F.concat(F.replace("td", F.lit(" "), F.lit(", ")), F.lit(",</td>")), ", ", " "), "replace(concat(replace(td, ' ', ', '), ',</td>'), ', ', ' ')")
_EB = "concat('<eb', CASE WHEN cell_id % 11 = 0 THEN '' ELSE CAST(cell_id % 11 AS STRING) END, '></eb', CASE WHEN cell_id % 11 = 0 THEN '' ELSE CAST(cell_id % 11 AS STRING) END, '>')"
_h("deal_eb_token", "STR-30 STR-42", lambda: t.empty_box_tokens(F.expr(_EB)),
   "CASE cell_id % 11 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(x.replace(" ", "' || chr(8232) || '") for x in t.EMPTY_BOX_CELLS)) + " END")
_h("deal_isolate_span", "STR-32 STR-40", lambda: t.isolated_span(F.concat(F.lit('<td></td> rowspan="'), c("cell_id").cast("string"), F.lit('"></b></td>'))), "concat('<td rowspan=\"', cell_id, '\"></td>')")
_h("deal_duplicate_bold", "STR-33 STR-41", lambda: t.single_bold(F.concat(F.lit("<td><b>"), c("cell_id").cast("string"), F.lit("</b> <b>x</b></td>"))), "concat('<td><b>', cell_id, ' x</b></td>')")
_h("deal_bold_head", "STR-34 STR-39 STR-100", lambda: t.bold_cells(F.concat(F.lit("<thead><tr>"), "td", F.lit("</tr></thead>"))), "concat('<thead><tr>', regexp_replace(replace(replace(td, '<b>', ''), '</b>', ''), '<td([^>]*)>(.*?)</td>', '<td\\1><b>\\2</b></td>', 'g'), '</tr></thead>')")
_h("append_virtual_tokens", "STR-35", lambda: F.concat_ws(",", F.when(c("cell_id") % 2 == 0, "</tr>").otherwise("</tbody>"), F.when(c("cell_id") % 2 == 0, F.concat(F.lit("<tr>"), "td", F.lit("</tr>")))),
   "concat_ws(',', CASE WHEN cell_id % 2 = 0 THEN '</tr>' ELSE '</tbody>' END, CASE WHEN cell_id % 2 = 0 THEN concat('<tr>', td, '</tr>') END)")
_TOK = "concat('<tbody>,<tr>,<td></td>', CASE cell_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',</tbody>' ELSE ',</tr>,</tbody>' END)"
_h("text_to_list", "STR-44", lambda: F.array_join(t.repair_tail(F.split(F.expr(_TOK), ",")), "|"), "'<tbody>|<tr>|<td></td>|</tr>|</tbody>'")
_h("html_post_process", "STR-45 STR-37 STR-101", lambda: F.concat(F.lit("<html><body><table>"), "td", F.lit("</table></body></html>")), "concat('<html><body><table>', td, '</table></body></html>')")


@query("area_to_html", "STR-46", """WITH g AS (SELECT table_id, pk % 3 AS area, min(row_idx) AS r0, max(row_idx) AS r1, min(col_idx) AS c0, max(col_idx) AS c1 FROM fx_cells GROUP BY table_id, pk % 3)
SELECT table_id, string_agg(concat('<td rowspan="', r1 - r0 + 1, '" colspan="', c1 - c0 + 1, '"></td>'), '' ORDER BY r0, c0, area) AS html FROM g GROUP BY table_id""", uses="fx_cells")
def area_to_html(spark, sf):
    """An area of the grid becomes one cell at its first place with spans."""
    g = relation(spark, sf, "fx_cells").groupBy("table_id", (c("pk") % 3).alias("area")).agg(F.min("row_idx").alias("r0"), F.max("row_idx").alias("r1"), F.min("col_idx").alias("c0"), F.max("col_idx").alias("c1"))
    td = F.concat(F.lit('<td rowspan="'), (c("r1") - c("r0") + 1).cast("string"), F.lit('" colspan="'), (c("c1") - c("c0") + 1).cast("string"), F.lit('"></td>'))
    s = F.array_sort(F.collect_list(F.struct("r0", "c0", "area", td.alias("td"))))
    return g.groupBy("table_id").agg(F.array_join(F.transform(s, lambda e: e["td"]), "").alias("html"))


_h("format_html", "STR-47", lambda: F.concat(F.lit("<td>"), t.escape(c("td")), F.lit("</td>")), "concat('<td>', replace(replace(replace(td, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</td>')")
scalar("html_without_scripts", "STR-51", "pages", "page_id", lambda: F.md5(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "")), "md5(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'))")
_p("text_strip", "STR-56", lambda: F.translate("p_name", "aeiou", ""), "regexp_replace(p_name, '[aeiou]', '', 'g')")


@query("flag_font_size", "STR-57", """WITH ch AS (SELECT p_partkey, substr(p_name, CAST(i AS INT), 1) AS ch, CAST(i AS INT) AS i FROM part, unnest(range(1, length(p_name) + 1)) u(i)), s AS (SELECT *, ascii(ch) % 2 AS sz FROM ch), b AS (SELECT *, CASE WHEN sz = lag(sz) OVER (PARTITION BY p_partkey ORDER BY i) THEN 0 ELSE 1 END AS nw, min(sz) OVER (PARTITION BY p_partkey) AS lo, max(sz) OVER (PARTITION BY p_partkey) AS hi FROM s), r AS (SELECT *, sum(nw) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b),
g AS (SELECT p_partkey, run, CASE WHEN min(sz) = min(lo) AND min(lo) < max(hi) THEN concat('<s>', string_agg(ch, '' ORDER BY i), '</s>') ELSE string_agg(ch, '' ORDER BY i) END AS x FROM r GROUP BY p_partkey, run)
SELECT p_partkey, string_agg(x, '' ORDER BY run) AS v FROM g GROUP BY p_partkey""")
def flag_font_size(spark, sf):
    """Runs of the smallest size are marked if there is more than one size."""
    w = Window.partitionBy("p_partkey")
    s = relation(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "ch")).filter("ch <> ''").withColumn("sz", F.ascii("ch") % 2)
    b = s.withColumns({"nw": F.when(c("sz") == F.lag("sz").over(w.orderBy("i")), 0).otherwise(1), "lo": F.min("sz").over(w), "hi": F.max("sz").over(w)})
    r = b.withColumn("run", F.sum("nw").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda e: e["ch"]), "")
    g = r.groupBy("p_partkey", "run").agg(F.when((F.min("sz") == F.min("lo")) & (F.min("lo") < F.max("hi")), F.concat(F.lit("<s>"), joined, F.lit("</s>"))).otherwise(joined).alias("x"))
    return g.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "x"))), lambda e: e["x"]), "").alias("v"))


def _replaces(expr, pairs):
    for a, b in pairs:
        expr = f"replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return expr


_MESSY = "concat(td, '''', '.', '％', '“', '<br/>', 'pdf-table')"
_MESSY_SPARK = "concat(td, \"'\", '.', '％', '“', '<br/>', 'pdf-table')"
_h("norm_html", "STR-58", lambda: t.ordered_replace(t.remove_space(F.expr(_MESSY_SPARK)), t.NORM_HTML), _replaces(f"regexp_replace({_MESSY}, '[ \\t\\n\\r\\f\\v]', '', 'g')", t.NORM_HTML))
_h("norm_html_text", "STR-59", lambda: t.ordered_replace(t.remove_space(F.expr(_MESSY_SPARK)), t.NORM_HTML_TEXT), _replaces(f"regexp_replace({_MESSY}, '[ \\t\\n\\r\\f\\v]', '', 'g')", t.NORM_HTML_TEXT))
_WIDE = "concat('<td width=\"', cell_id, '%\" align=\"center\">', td, '</td>')"
_h("norm_html_remove_width", "STR-60", lambda: t.ordered_replace(t.without_width(t.remove_space(F.expr(_WIDE))), [("'", '"'), ("<br/>", "")]),
   f"regexp_replace(regexp_replace(regexp_replace({_WIDE}, '[ \\t\\n\\r\\f\\v]', '', 'g'), 'width=[\"'']\\d+%[\"'']', '', 'g'), 'align=[\"'']?center[\"'']?', '', 'g')")
_h("clean_html_table_width", "STR-75", lambda: t.without_width(F.expr(_WIDE)), f"regexp_replace(regexp_replace({_WIDE}, 'width=[\"'']\\d+%[\"'']', '', 'g'), 'align=[\"'']?center[\"'']?', '', 'g')")
_h("remove_html_table_text", "STR-76", lambda: F.regexp_replace("td", ">[^<>]*</td>", ">测试</td>"), "regexp_replace(td, '>[^<>]*</td>', '>测试</td>', 'g')")
scalar("process_show_html", "STR-62", "documents", "doc_id", lambda: F.md5(F.concat(F.lit("<xmp>"), F.regexp_replace("text", r"(?s)(.{50})(?=.)", "$1\n"), F.lit("</xmp>"))), "md5(concat('<xmp>', array_to_string(list_transform(range(0, length(text), 50), lambda i: substr(text, CAST(i AS INT) + 1, 50)), chr(10)), '</xmp>'))")
_OPS = "CASE grp % 4 WHEN 0 THEN 'equal,replace11,equal' WHEN 1 THEN 'equal,delete10,equal' WHEN 2 THEN 'equal,insert01,equal' ELSE 'equal' END"
scalar("analysis_diff_result", "", "boxes", "id", lambda: {"fixed": F.when(F.expr(_OPS) == "equal,delete10,equal", "MISSING").when(F.expr(_OPS) == "equal,replace11,equal", "GARBLED").otherwise("DIFF"), "compat": F.when(F.expr(_OPS).isin("equal,delete10,equal", "equal,replace11,equal"), "MISSING").otherwise("DIFF")},
       {"fixed": "CASE grp % 4 WHEN 0 THEN 'GARBLED' WHEN 1 THEN 'MISSING' ELSE 'DIFF' END", "compat": "CASE WHEN grp % 4 < 2 THEN 'MISSING' ELSE 'DIFF' END"})
_DIFFS = """WITH w AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part), ca AS (SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(a, '')) AS ch FROM w) WHERE ch <> '' GROUP BY ALL), cb AS (SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(b, '')) AS ch FROM w) WHERE ch <> '' GROUP BY ALL),
d AS (SELECT coalesce(ca.p_partkey, cb.p_partkey) AS p_partkey, coalesce(ca.n, 0) - coalesce(cb.n, 0) AS diff FROM ca FULL JOIN cb ON ca.p_partkey = cb.p_partkey AND ca.ch = cb.ch), s AS (SELECT p_partkey, sum(diff) AS diff_len, count(*) FILTER (diff <> 0) AS diff_char FROM d GROUP BY p_partkey)
"""


def _char_diff(spark, sf):
    """Signed length and number of differing characters of two texts, by one grouped count of both."""
    p = relation(spark, sf, "part").select("p_partkey", c("p_name").alias("a"), c("p_type").alias("b"))
    chars = p.select("p_partkey", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.split("a", "").alias("cs")), F.struct(F.lit(-1).alias("sign"), F.split("b", "").alias("cs")))).alias("s"))
    n = chars.select("p_partkey", "s.sign", F.explode("s.cs").alias("ch")).filter("ch <> ''").groupBy("p_partkey", "ch").agg(F.sum("sign").alias("diff"))
    return p, n.groupBy("p_partkey").agg(F.sum("diff").alias("diff_len"), F.count_if(c("diff") != 0).alias("diff_char"))


@query("compare_text_diff", "STR-66", _DIFFS + "SELECT w.p_partkey, length(a) >= 10 AND length(b) >= 10 AND abs(length(a) - length(b)) < 10 AND diff_len < 50 AND diff_char < 10 AS v FROM w JOIN s ON s.p_partkey = w.p_partkey")
def compare_text_diff(spark, sf):
    p, s = _char_diff(spark, sf)
    la, lb = F.length("a"), F.length("b")
    return p.join(s, "p_partkey").select("p_partkey", ((la >= 10) & (lb >= 10) & (F.abs(la - lb) < 10) & (c("diff_len") < 50) & (c("diff_char") < 10)).alias("v"))


@query("table_text_cell_diff", "STR-67..68", _DIFFS + "SELECT w.p_partkey, CASE WHEN a = b THEN 'SAME' WHEN diff_len = 0 THEN 'DIFF_TEXT_ORDER' WHEN length(a) > length(b) THEN 'DIFF_TEXT_LABEL_LESS_WORDS' WHEN length(a) = length(b) THEN 'DIFF_TEXT_INCONSISTENT' ELSE 'DIFF_TEXT_PREDICT_LESS_WORDS' END AS v FROM w JOIN s ON s.p_partkey = w.p_partkey")
def table_text_cell_diff(spark, sf):
    p, s = _char_diff(spark, sf)
    la, lb = F.length("a"), F.length("b")
    kind = F.when(c("a") == c("b"), "SAME").when(c("diff_len") == 0, "DIFF_TEXT_ORDER").when(la > lb, "DIFF_TEXT_LABEL_LESS_WORDS").when(la == lb, "DIFF_TEXT_INCONSISTENT").otherwise("DIFF_TEXT_PREDICT_LESS_WORDS")
    return p.join(s, "p_partkey").select("p_partkey", kind.alias("v"))


@query("table_structure_cell_diff", "STR-69", """SELECT coalesce(g.table_id, p.table_id) AS table_id, coalesce(g.seq, p.seq) AS seq, CASE WHEN p.seq IS NULL THEN 'MISSING' WHEN g.r0 <> p.r0 AND g.c0 <> p.c0 THEN 'DIFF_CELL_ROW_COL_SPAN' WHEN g.r0 <> p.r0 THEN 'DIFF_CELL_ROW_SPAN' WHEN g.c0 <> p.c0 THEN 'DIFF_CELL_COL_SPAN' ELSE 'SAME' END AS v FROM fx_gt g FULL JOIN fx_pred p ON p.table_id = g.table_id AND p.seq = g.seq""", uses="fx_gt fx_pred")
def table_structure_cell_diff(spark, sf):
    p = relation(spark, sf, "fx_pred").select("table_id", "seq", c("r0").alias("pr"), c("c0").alias("pc"))
    j = relation(spark, sf, "fx_gt").select("table_id", "seq", "r0", "c0").join(p, ["table_id", "seq"], "full")
    row, col = c("r0") != c("pr"), c("c0") != c("pc")
    return j.select("table_id", "seq", F.when(c("pr").isNull(), "MISSING").when(row & col, "DIFF_CELL_ROW_COL_SPAN").when(row, "DIFF_CELL_ROW_SPAN").when(col, "DIFF_CELL_COL_SPAN").otherwise("SAME").alias("v"))


_h("extract_table_structure", "STR-70", lambda: F.regexp_replace("td", ">[^<>]*<", "><"), "regexp_replace(td, '>[^<>]*<', '><', 'g')")
_h("extract_table_cell", "STR-71 SRC-60", lambda: F.array_join(F.filter(F.split(F.regexp_replace(F.concat("td", F.lit("<td>a</td>")), "</?(table|tr)>|</td>", ""), "<td>"), lambda x: F.length(x) > 0), "|"),
   "concat_ws('|', nullif(string_split(regexp_replace(concat(td, '<td>a</td>'), '</td>', '', 'g'), '<td>')[1], ''), nullif(string_split(regexp_replace(concat(td, '<td>a</td>'), '</td>', '', 'g'), '<td>')[2], ''), nullif(string_split(regexp_replace(concat(td, '<td>a</td>'), '</td>', '', 'g'), '<td>')[3], ''))")
_p("match_pattern_extract", "STR-72", lambda: F.array_join(F.regexp_extract_all("p_name", F.lit("([aeiou])[a-z]"), 1), ","), "array_to_string(regexp_extract_all(p_name, '([aeiou])[a-z]', 1), ',')")
_p("match_pattern_result", "STR-73", lambda: {"flag": c("p_name").rlike("[aeiou]{2}"), "n": F.size(F.regexp_extract_all("p_name", F.lit("[aeiou]{2}"), 0))}, {"flag": "regexp_matches(p_name, '[aeiou]{2}')", "n": "CAST(len(regexp_extract_all(p_name, '[aeiou]{2}')) AS INT)"})
_p("match_pattern_list", "STR-74", lambda: F.coalesce(*[F.nullif(F.regexp_extract("p_name", r, 0), F.lit("")) for r in ("z[a-z]", "q[a-z]", "[b-d][aeiou]")]), "coalesce(nullif(regexp_extract(p_name, 'z[a-z]'), ''), nullif(regexp_extract(p_name, 'q[a-z]'), ''), nullif(regexp_extract(p_name, '[b-d][aeiou]'), ''))")
scalar("find_text_span_index", "STR-77", "documents", "doc_id", lambda: {"first": F.locate("the", c("text")) - 1, "n": F.size(F.split("text", "the", -1)) - 1}, {"first": "CAST(strpos(text, 'the') - 1 AS INT)", "n": "CAST(len(string_split(text, 'the')) - 1 AS INT)"})
_LEV = "CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type))"
_p("rename_cost", "STR-80", lambda: F.when(c("p_size") % 5 == 0, 1.0).otherwise(t.normalised_distance(c("p_name"), c("p_type"))), f"CASE WHEN p_size % 5 = 0 THEN 1e0 ELSE {_LEV} END")
_p("rename_cost_short", "STR-81", lambda: t.normalised_distance(F.when(F.length("p_name") < 12, "####").otherwise(c("p_name")), c("p_type")), "CAST(levenshtein(CASE WHEN length(p_name) < 12 THEN '####' ELSE p_name END, p_type) AS DOUBLE) / greatest(length(CASE WHEN length(p_name) < 12 THEN '####' ELSE p_name END), length(p_type))")
_p("rename_cost_block", "STR-82", lambda: t.normalised_distance(F.replace("p_name", F.lit(" "), F.lit("")), F.replace("p_type", F.lit(" "), F.lit(""))), "CAST(levenshtein(replace(p_name, ' ', ''), replace(p_type, ' ', '')) AS DOUBLE) / greatest(length(replace(p_name, ' ', '')), length(replace(p_type, ' ', '')))")
_p("edit_distance", "STR-84", lambda: F.levenshtein("p_name", "p_type"), "CAST(levenshtein(p_name, p_type) AS INT)")
_ZH = "concat(CASE WHEN p_size % 4 = 0 THEN '十' ELSE '二百' END, substr('一二三四五六七八九', CAST(p_partkey % 9 + 1 AS INT), 1))"
_p("chinese_to_digits", "STR-85", lambda: t.chinese_number(F.expr(_ZH)), "CAST(CASE WHEN p_size % 4 = 0 THEN 10 ELSE 200 END + p_partkey % 9 + 1 AS INT)")
_p("md5_text", "STR-87 SRC-40", lambda: F.md5("p_name"), "md5(p_name)")
_p("random_names", "STR-88 STR-109", lambda: {"n_uuid": F.length(F.replace(F.uuid(), F.lit("-"), F.lit(""))), "n_random": F.length(F.randstr(F.lit(12), F.lit(7)))}, {"n_uuid": "32", "n_random": "12"})
_FULL = "concat('ＡＢｃ１２！', p_name, chr(12288))"
_p("full_to_half_width", "STR-89", lambda: t.half_width(F.expr("concat('ＡＢｃ１２！', p_name, '\\u3000')")), "concat('ABc12!', p_name, chr(12288))")
_p("unify_prompt_name", "STR-90", lambda: t.unify_prompt(F.concat(F.lit("kind["), F.concat_ws(",", "p_type", "p_brand", "p_type"), F.lit("]"))), "concat('kind[', CASE WHEN p_brand < p_type THEN concat(p_brand, ',', p_type) ELSE concat(p_type, ',', p_brand) END, ']')")
_PATH = "concat('/data/run-', p_size, '-x/', p_partkey, '_', p_size, '.5_page.pdf')"
_p("file_name", "STR-91", lambda: F.regexp_extract(F.expr(_PATH), r"([^/]*)\.[^./]*$", 1), "concat(p_partkey, '_', p_size, '.5_page')")
_p("raw_file_name", "STR-92", lambda: F.substring_index(F.expr(_PATH), "/", -1), "concat(p_partkey, '_', p_size, '.5_page.pdf')")
_p("pdf_to_image_file_name", "STR-93", lambda: F.regexp_replace(F.expr(_PATH), r"\.pdf$", ".jpg"), "concat('/data/run-', p_size, '-x/', p_partkey, '_', p_size, '.5_page.jpg')")
_p("checkpoint_num", "STR-94", lambda: F.split_part(F.split_part(F.expr(_PATH), F.lit("/"), F.lit(3)), F.lit("-"), F.lit(2)).cast("int"), "p_size")
_p("step_num", "STR-95", lambda: F.floor(F.split_part(F.substring_index(F.expr(_PATH), "/", -1), F.lit("_"), F.lit(2)).cast("double")), "CAST(p_size AS BIGINT)")
scalar("show_html", "STR-96..97", "fx_layout", "page seq", lambda: F.when(c("label") == "table", F.concat(F.lit('<div class="table">'), c("seq").cast("string"), F.lit("</div>"))).when(c("label") == "figure", F.concat(F.lit('<img src="'), c("seq").cast("string"), F.lit('"/>'))).otherwise(F.concat(F.lit("<p>"), c("seq").cast("string"), F.lit("</p>"))),
       "CASE label WHEN 'table' THEN concat('<div class=\"table\">', seq, '</div>') WHEN 'figure' THEN concat('<img src=\"', seq, '\"/>') ELSE concat('<p>', seq, '</p>') END")


@query("page_html", "STR-98 SNK-23", """SELECT page, string_agg(concat('<p>', seq, '</p>'), '' ORDER BY y1, x1, seq) AS html FROM fx_layout GROUP BY page""", uses="fx_layout")
def page_html(spark, sf):
    """Blocks of a page in reading order.

    Pages have the HTML of few contents, but each has it whole: Parquet files hold a text once, in a dictionary, whatever its length.
    """
    lay = Layout(with_settings(spark, {"parquet.dictionary.page.size": str(DICTIONARY)}), sf)
    s = F.array_sort(F.collect_list(F.struct("y1", "x1", "seq")))
    html = lay.once.groupBy("page").agg(F.array_join(F.transform(s, lambda e: F.concat(F.lit("<p>"), e["seq"].cast("string"), F.lit("</p>"))), "").alias("html"))
    return lay.on_pages(html, few=True)


_KIND = "CASE grp % 4 WHEN 0 THEN 'SAME' WHEN 1 THEN 'DIFF' WHEN 2 THEN 'REMOVE_WIDTH_SAME' ELSE 'other' END"
scalar("compare_type_parse", "STR-102 STR-104", "boxes", "id", lambda: {"name": F.coalesce(t.lookup(F.expr(_KIND), {k: k for k in t.COMPARE_TYPES}), F.lit("NONE")), "ordinal": t.lookup(F.expr(_KIND), {k: i for i, k in enumerate(t.COMPARE_TYPES)})},
       {"name": "CASE grp % 4 WHEN 0 THEN 'SAME' WHEN 1 THEN 'DIFF' WHEN 2 THEN 'REMOVE_WIDTH_SAME' ELSE 'NONE' END", "ordinal": "CASE grp % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 END"})
scalar("compare_type_parse_desc", "STR-103", "boxes", "id", lambda: t.lookup(F.expr("CASE WHEN grp % 2 = 0 THEN '不同' ELSE '完全相同' END"), {v: k for k, v in t.COMPARE_TYPES.items()}), "CASE WHEN grp % 2 = 0 THEN 'DIFF' ELSE 'SAME' END")
scalar("content_type_parse", "STR-105", "boxes", "id", lambda: F.coalesce(t.lookup(F.expr("CASE grp % 3 WHEN 0 THEN '文本' WHEN 1 THEN '表格' ELSE '?' END"), {v: k for k, v in t.CONTENT_TYPES.items()}), F.lit("NONE")), "CASE grp % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN 'TABLE' ELSE 'NONE' END")
scalar("language_family", "STR-108", "documents", "doc_id", lambda: t.language_family(c("lang")), "CASE WHEN lang = 'en' THEN 'en' WHEN lang IN ('fr', 'de', 'es') THEN 'latin' ELSE 'other' END")
# dates
_p("time_use_str", "DAT-01", lambda: t.duration(c("p_retailprice") / 1000), "CASE WHEN p_retailprice / 1000 < 1 THEN concat(printf('%.3f', p_retailprice / 1000 * 1000), ' ms') ELSE concat(printf('%.3f', p_retailprice / 1000), ' s') END")
scalar("now_str", "DAT-02..03 DAT-09", "orders", "o_orderkey", lambda: {"long": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "short": F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")},
       {"long": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "short": "strftime(o_orderdate, '%Y%m%d_%H%M%S')", "day": "strftime(o_orderdate, '%Y-%m-%d')"})
scalar("format_time", "DAT-04", "orders", "o_orderkey", lambda: F.date_format(F.timestamp_millis(c("o_orderkey") * 1234567), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "strftime(epoch_ms(o_orderkey * 1234567), '%Y-%m-%d %H:%M:%S.%f')")


@query("calc_diff_time", "DAT-05 DAT-07", "SELECT l_orderkey, count(*) AS n, sum(CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def calc_diff_time(spark, sf):
    """Seconds between two formatted times, summed for each order."""
    sec = lambda x: F.unix_timestamp(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    o = relation(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = relation(spark, sf, "lineitem").join(o, c("l_orderkey") == c("o_orderkey"))
    return j.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(sec("l_shipdate") - sec("o_orderdate")).alias("v"))


scalar("to_timestamp", "DAT-06", "orders", "o_orderkey", lambda: t.timestamp_of(F.when(c("o_orderkey") % 3 == 0, "").when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))),
       "CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) ELSE CAST(epoch(o_orderdate) AS BIGINT) END")
scalar("time_sub_dir", "DAT-08", "orders", "o_orderkey", lambda: F.concat(F.lit("out/"), F.date_format("o_orderdate", "yyyy-MM-dd")), "concat('out/', strftime(o_orderdate, '%Y-%m-%d'))")
