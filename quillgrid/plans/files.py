"""Sources and sinks as queries over derived rows; the file readers and writers have their own tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..registry import query, scalar
from ..session import fresh_path
from ..sources import readers, writers
from .relations import relation

c = F.col


@query("page_list", "SRC-03..04 SRC-06", """WITH p AS (SELECT p_partkey, p_size % 4 AS kind, 6 + p_size % 3 AS n FROM part)
SELECT p_partkey, array_to_string(CASE kind WHEN 0 THEN [1] WHEN 1 THEN [1, 3, 4] WHEN 2 THEN list_concat([1], range(4, n + 1)) ELSE range(1, n + 1) END, ',') AS v FROM p""")
def page_list(spark, sf):
    """Page specifications: 1 / 1,3,4 / 1,4-end / all."""
    spec = F.expr("CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,3,4' WHEN 2 THEN '1,4-end' ELSE 'all' END")
    pages = readers.page_numbers(spec, (c("p_size") % 3 + 6).cast("int"))
    return relation(spark, sf, "part").select("p_partkey", F.array_join(F.transform(pages, lambda v: v.cast("string")), ",").alias("v"))


@query("text_object_tree", "SRC-11", """WITH RECURSIVE n AS (SELECT p_partkey AS id, p_partkey // 3 AS parent, CASE p_partkey % 3 WHEN 0 THEN 'char' WHEN 1 THEN 'image' ELSE 'line' END AS kind FROM part),
r AS (SELECT id, kind, 0 AS depth FROM n WHERE id = (SELECT min(id) FROM n) UNION ALL SELECT n.id, n.kind, r.depth + 1 FROM r JOIN n ON n.parent = r.id AND n.id > r.id)
SELECT id, depth FROM r WHERE kind = 'char'""")
def text_object_tree(spark, sf):
    """Objects of one kind at any depth of a tree."""
    n = relation(spark, sf, "part").select(c("p_partkey").alias("id"), F.floor(c("p_partkey") / 3).alias("parent"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'char' WHEN 1 THEN 'image' ELSE 'line' END").alias("kind"))
    level = n.join(n.agg(F.min("id").alias("root")), c("id") == c("root")).select("id", "kind")
    found, depth = [], 0
    while True:  # a level is written before the next is looked for, whatever its size
        path = fresh_path(spark, "tree")
        level.write.parquet(path)
        level = spark.read.schema("id long, kind string").parquet(path)
        if level.isEmpty():
            break
        found.append(level.filter("kind = 'char'").select("id", F.lit(depth).alias("depth")))
        level = n.join(level.select(c("id").alias("up")), (c("parent") == c("up")) & (c("id") > c("up"))).select("id", "kind")
        depth += 1
    return reduce(DataFrame.unionByName, found) if found else level.select("id", F.lit(0).alias("depth"))


@query("block_text_metrics", "SRC-13..14", """WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS blocks, CAST(sum(length(line)) AS BIGINT) AS words, round(avg(length(line)), 6) AS per_block, count(*) > 1 AS success FROM b WHERE trim(line) <> CAST(doc_id AS VARCHAR) GROUP BY doc_id""")
def block_text_metrics(spark, sf):
    """Blocks of a document but those that are its page number, with totals."""
    b = relation(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != c("doc_id").cast("string"))
    n = F.length("line")
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(n).alias("words"), F.round(F.avg(n), 6).alias("per_block"), (F.count("*") > 1).alias("success"))


scalar("image_filters", "SRC-12 SRC-15..16 SNK-27", "boxes", "id", lambda: {"kept": (F.least(c("ax2") - c("ax1"), c("ay2") - c("ay1")) > 8) & (c("k") > 100) & (c("k") / ((c("ax2") - c("ax1")) * (c("ay2") - c("ay1")) * 3) > 0.1), "page": c("ax2") - c("ax1") >= 30},
       {"kept": "least(ax2 - ax1, ay2 - ay1) > 8 AND k > 100 AND k / ((ax2 - ax1) * (ay2 - ay1) * 3) > 0.1", "page": "ax2 - ax1 >= 30"})


@query("is_imaged_document", "", """WITH p AS (SELECT grp, row_idx, count(*) FILTER (score_pct < 3) = 0 AND count(*) FILTER (score_pct > 90) > 0 AS scanned FROM boxes GROUP BY grp, row_idx)
SELECT grp, bool_and(scanned) AS all_pages, bool_or(scanned) FILTER (row_idx <= 2) AS first_pages FROM p GROUP BY grp""", uses="boxes")
def is_imaged_document(spark, sf):
    """A page without text but with images is scanned; a document if all its pages are."""
    p = relation(spark, sf, "boxes").groupBy("grp", "row_idx").agg(((F.count_if(c("score_pct") < 3) == 0) & (F.count_if(c("score_pct") > 90) > 0)).alias("scanned"))
    return p.groupBy("grp").agg(F.bool_and("scanned").alias("all_pages"), F.bool_or(F.when(c("row_idx") <= 2, c("scanned"))).alias("first_pages"))


@query("table_file_rows", "SRC-32", """WITH l AS (SELECT doc_id, string_split(text, ' ') AS f, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE len(string_split(text, ' ')) >= 4) SELECT doc_id, trim(f[2]) AS a, trim(f[4]) AS b FROM l WHERE n > 2""")
def table_file_rows(spark, sf):
    """Fields of delimited lines; short lines go before the first ones are skipped."""
    l = relation(spark, sf, "documents").select("doc_id", "lang", F.split("text", " ").alias("f")).filter(F.size("f") >= 4)
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return l.withColumn("n", n).filter("n > 2").select("doc_id", F.trim(F.get("f", F.lit(1))).alias("a"), F.trim(F.get("f", F.lit(3))).alias("b"))


@query("latest_label", "SRC-33 SRC-47", "SELECT p_brand, arg_max(p_name, p_partkey) AS v FROM part GROUP BY p_brand")
def latest_label(spark, sf):
    """Of several lines for a name the last wins."""
    return relation(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_name", "p_partkey").alias("v"))


_F = "concat('page-', p_partkey, CASE p_size % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '.jpg' END)"
scalar("list_files", "SRC-36..37 SRC-54 SRC-58", "part", "p_partkey", lambda: F.expr(_F).startswith("page-1") & F.expr(_F).endswith(".pdf"), f"starts_with({_F}, 'page-1') AND ends_with({_F}, '.pdf')")
scalar("is_pdf_file", "SRC-39", "part", "p_partkey", lambda: F.lower(F.expr(_F)).endswith(".pdf"), f"ends_with(lower({_F}), '.pdf')")
scalar("is_url", "SRC-38", "pages", "page_id", lambda: F.coalesce(F.regexp_extract("url", "^([a-z]+)://", 1).isin("http", "https", "ftp", "file", "s3"), F.lit(False)), "coalesce(regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https', 'ftp', 'file', 's3'), false)")


@query("pairs_with_both_files", "SRC-42..44", "SELECT d.doc_id FROM documents d WHERE exists(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND exists(SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)")
def pairs_with_both_files(spark, sf):
    d = relation(spark, sf, "documents").select("doc_id")
    d = d.join(relation(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.join(relation(spark, sf, "pages").select(c("page_id").alias("doc_id")), "doc_id", "left_semi")


@query("units_of_image", "SRC-45 SRC-48..50", "SELECT table_id, string_agg(concat_ws(':', c0, c1, r0, r1), ';' ORDER BY y1, x1, y2, x2, seq) AS v FROM fx_pred GROUP BY table_id", uses="fx_pred")
def units_of_image(spark, sf):
    s = F.array_sort(F.collect_list(F.struct("y1", "x1", "y2", "x2", "seq", F.concat_ws(":", "c0", "c1", "r0", "r1").alias("v"))))
    return relation(spark, sf, "fx_pred").groupBy("table_id").agg(F.array_join(F.transform(s, lambda e: e["v"]), ";").alias("v"))


@query("sub_dataset", "SRC-46", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n > 3 AND lang IN ('en', 'fr')")
def sub_dataset(spark, sf):
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return relation(spark, sf, "documents").withColumn("n", n).filter((c("n") > 3) & c("lang").isin("en", "fr")).select("doc_id")


@query("whole_text_size", "SRC-52..53 SRC-55", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS v FROM documents")
def whole_text_size(spark, sf):
    return relation(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("v"))


@query("bio_label_map", "SRC-57", """WITH n AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS n FROM (SELECT DISTINCT upper(p_brand) AS brand FROM part))
SELECT 'O' AS label, 0 AS id UNION ALL SELECT concat('B-', brand), n * 2 + 1 FROM n UNION ALL SELECT concat('I-', brand), n * 2 + 2 FROM n""")
def bio_label_map(spark, sf):
    n = relation(spark, sf, "part").select(F.upper("p_brand").alias("b")).distinct().withColumn("n", F.row_number().over(Window.orderBy("b")) - 1)
    each = n.select(F.explode(F.array(F.struct(F.concat(F.lit("B-"), "b").alias("label"), (c("n") * 2 + 1).alias("id")), F.struct(F.concat(F.lit("I-"), "b").alias("label"), (c("n") * 2 + 2).alias("id")))).alias("s"))
    return spark.range(1).select(F.lit("O").alias("label"), F.lit(0).alias("id")).unionByName(each.select("s.label", "s.id"))


@query("table_csv_rows", "SNK-01 SNK-21..22 SNK-34", """SELECT table_id, row_idx, string_agg(concat('"', pk, '"'), ',' ORDER BY col_idx) AS line FROM fx_cells GROUP BY table_id, row_idx""", uses="fx_cells")
def table_csv_rows(spark, sf):
    s = F.array_sort(F.collect_list(F.struct("col_idx", F.concat(F.lit('"'), c("pk").cast("string"), F.lit('"')).alias("v"))))
    return relation(spark, sf, "fx_cells").groupBy("table_id", "row_idx").agg(F.array_join(F.transform(s, lambda e: e["v"]), ",").alias("line"))


@query("table_json", "SNK-20", """SELECT table_id, concat('[', string_agg(concat('{"pk":', pk, ',"sk":', sk, '}'), ',' ORDER BY row_idx), ']') AS json FROM fx_rows GROUP BY table_id""", uses="fx_rows")
def table_json(spark, sf):
    r = relation(spark, sf, "fx_rows")
    return writers.records(r.select("table_id", "row_idx", "pk", "sk"), ["table_id"], "row_idx").select("table_id", F.regexp_replace("json", '"row_idx":[0-9]+,', "").alias("json"))


@query("table_markdown", "SNK-04", """SELECT table_id, concat('| pk | sk |', chr(10), '|---|---|', chr(10), string_agg(concat('| ', pk, ' | ', sk, ' |'), chr(10) ORDER BY row_idx)) AS markdown FROM fx_rows GROUP BY table_id""", uses="fx_rows")
def table_markdown(spark, sf):
    return writers.markdown(relation(spark, sf, "fx_rows"), ["table_id"], "row_idx", ["pk", "sk"])


@query("table_html", "SNK-03", """SELECT table_id, concat('<table>', string_agg(concat('<tr><td>', pk, '</td><td>', sk, '</td></tr>'), '' ORDER BY row_idx), '</table>') AS html FROM fx_rows GROUP BY table_id""", uses="fx_rows")
def table_html(spark, sf):
    return writers.html(relation(spark, sf, "fx_rows"), ["table_id"], "row_idx", ["pk", "sk"])


scalar("css_style", "SNK-15", "part", "p_partkey", lambda: F.element_at(t.css(F.concat(F.lit(" color : "), "p_brand", F.lit("; width: 5px"))), "color"), "p_brand")
_CLS = "CASE p_size % 4 WHEN 0 THEN 'TYPE_FORMULA TYPE_INTEGER' WHEN 1 THEN 'TYPE_CURRENCY' WHEN 2 THEN 'x' ELSE 'TYPE_PERCENTAGE' END"
scalar("cell_data_type", "SNK-16", "part", "p_partkey", lambda: t.cell_type(F.expr(_CLS)), "CASE p_size % 4 WHEN 0 THEN 'FORMULA' WHEN 2 THEN 'STRING' ELSE 'NUMERIC' END")
scalar("number_format", "SNK-17", "part", "p_partkey", lambda: t.number_format(F.expr(_CLS)), "CASE p_size % 4 WHEN 0 THEN '#,##0' WHEN 1 THEN '$#,##0.00' WHEN 2 THEN 'General' ELSE '0.0%' END")


@query("coco_label_lines", "SNK-28", """SELECT table_id, string_agg(concat(x1, ',', y1, ';', x2, ',', y1, ';', x2, ',', y2, ';', x1, ',', y2), chr(10) ORDER BY seq) AS boxes, string_agg(concat_ws(',', c0, c1, r0, r1), chr(10) ORDER BY seq) AS logic FROM fx_gt GROUP BY table_id""", uses="fx_gt")
def coco_label_lines(spark, sf):
    """Lines of the quad and the logic file of each table."""
    g = relation(spark, sf, "fx_gt").select(c("table_id").alias("file"), c("seq").alias("pos"), F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2").alias("quad"), F.array("c0", "c1", "r0", "r1").alias("axis"))
    return writers.quad_lines(g).withColumnRenamed("file", "table_id")
