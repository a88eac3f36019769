"""From raw documents to token files: five stages over whatever the stage before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  ``run`` writes each stage's rows as Parquet to the shared folder and reads them back
for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm import decontam, mixing, ngram_join, quality, token_file
from quillgrid.llm.common import fresh_path, no_shuffles_left, table
from quillgrid.session import ensure_workers


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.5 or more."""
    ensure_workers(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model, name="__score").filter(F.col("__score") >= 0.5).drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group that five-word shingle links of Jaccard 0.8 join; one row of each id, and all rows without id."""
    return ngram_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words (or a whole shorter item) of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them; where a selection cuts one, it counts if at least half is taken."""
    taken = mixing.mix(docs).select(F.col("id").alias("__id"), F.col("size").alias("__size"), mixing.copies(F.col("taken"), F.col("size")).alias("__n"))
    # rows of one id have the copies of each in some order; those of equal size are interchangeable
    by_id = taken.groupBy("__id", "__size").agg(F.sum("__n").alias("__n"), F.count("*").alias("__rows")).filter("__n > 0")
    sized = docs.withColumn("__size", mixing.word_count(F.col("text")).cast("long"))
    out = sized.join(by_id, F.col("doc_id").eqNullSafe(F.col("__id")) & (sized["__size"] == by_id["__size"]))
    # the copies are dealt evenly to rows that share id and size: the first few of them get one more
    place = F.row_number().over(Window.partitionBy("__id", by_id["__size"]).orderBy(F.xxhash64("text")))
    many = out.filter("__rows > 1").withColumn("__n", F.floor(F.col("__n") / F.col("__rows")) + (place <= F.col("__n") % F.col("__rows")).cast("int"))
    both = out.filter("__rows = 1").select(*docs.columns, "__n").unionByName(many.select(*docs.columns, "__n"))
    copies = both.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return copies.select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and for each document what they hold."""
    ensure_workers(spark)
    return token_file.write_and_digest(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

# A trained model and seeded blocks are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{name}")
        with no_shuffles_left(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
