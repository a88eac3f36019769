"""Readers of the label, quad, logic, vocabulary and annotation files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col


def page_numbers(spec: Column, total: Column) -> Column:
    """Sorted distinct page numbers of a specification such as ``1,4-end`` or ``all``; an inverted range gives none."""
    all_pages = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))

    def one(part):
        lo = F.split_part(part, F.lit("-"), F.lit(1)).cast("int")
        last = F.split_part(part, F.lit("-"), F.lit(2))
        hi = F.when(~part.contains("-"), lo).when(last == "end", total).otherwise(F.try_to_number(F.nullif(last, F.lit("")), F.lit("99999999")).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    parts = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), one)
    return F.when(spec == "all", all_pages).otherwise(F.array_sort(F.array_distinct(F.flatten(parts))))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos (from 0) and value of each line of the text files below ``path``; a file is read whole, so its order is kept."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    cut = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return whole.select("path", F.posexplode(cut).alias("pos", "value"))


def label_html(spark: SparkSession, path: str) -> DataFrame:
    """img_name, html of tab-separated label files; the last line of a name wins."""
    rows = lines(spark, path).select("path", "pos", F.split_part("value", F.lit("\t"), F.lit(1)).alias("img_name"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("html"))
    return rows.groupBy("img_name").agg(F.max_by("html", F.struct("path", "pos")).alias("html"))


def table_rows(spark: SparkSession, path: str, indexes: list[int], sep: str = "\t", skip_first: int = 0) -> DataFrame:
    """Trimmed fields at ``indexes``; shorter rows are dropped before the first ones are skipped."""
    fields = lines(spark, path).withColumn("f", F.split("value", sep, -1)).filter(F.size("f") > max(indexes))
    n = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    return fields.withColumn("n", n).filter(c("n") > skip_first).select("path", "pos", *[F.trim(F.get("f", F.lit(i))).alias(f"c{i}") for i in indexes])


def quads(spark: SparkSession, boxes: str, logic: str) -> DataFrame:
    """file, pos, quad, axis: the lines of a quad file beside those of the logic file of the same name, by position."""
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    b = lines(spark, boxes).select(name, "pos", F.transform(F.split("value", "[;,]"), lambda v: v.try_cast("double")).alias("quad"))
    a = lines(spark, logic).select(name, "pos", F.transform(F.split("value", ","), lambda v: v.try_cast("int")).alias("axis"))
    return b.filter(F.size("quad") == 8).join(a.filter(F.size("axis") == 4), ["file", "pos"])


def coco(spark: SparkSession, path: str) -> DataFrame:
    """file_name, pos, quad, axis, bbox of the annotations of a COCO file."""
    schema = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<id:bigint,image_id:bigint,segmentation:array<array<double>>,logic_axis:array<array<double>>,bbox:array<double>,category_id:bigint>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(c("i.id").alias("image_id"), "i.file_name")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", c("a.id").alias("pos"), F.get("a.segmentation", F.lit(0)).alias("quad"), F.transform(F.get("a.logic_axis", F.lit(0)), lambda v: v.cast("int")).alias("axis"), "a.bbox")
    return notes.join(images, "image_id").select("file_name", "pos", "quad", "axis", "bbox")


def vocabulary(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """token, id: the lines of one file numbered from ``first``."""
    return lines(spark, path).select(c("value").alias("token"), (c("pos") + first).alias("id"))


def bio_labels(spark: SparkSession, path: str) -> DataFrame:
    """label, id: O, then B- and I- of each upper-cased line that is not an ignored one."""
    names = lines(spark, path).select("pos", F.upper(F.trim("value")).alias("v")).filter("v NOT IN ('OTHER', 'OTHERS', 'IGNORE', '')")
    n = F.row_number().over(Window.orderBy("pos")) - 1
    each = names.withColumn("n", n).select(F.explode(F.array(F.struct((c("n") * 2 + 1).alias("id"), F.concat(F.lit("B-"), "v").alias("label")), F.struct((c("n") * 2 + 2).alias("id"), F.concat(F.lit("I-"), "v").alias("label")))).alias("s"))
    return spark.createDataFrame([("O", 0)], "label string, id int").unionByName(each.select("s.label", "s.id"))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, md5 of the files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", c("length").alias("size"), F.md5("content").alias("md5"))
