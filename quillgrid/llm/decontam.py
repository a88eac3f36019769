"""Benchmark decontamination as a prefix-filtered set join.

Every window of a benchmark item (``size`` consecutive words; a shorter item is one window) must
occur whole in a document, so containment is 1 and the necessary prefix of a window is one shingle.
Shingles are word pairs, ordered by their frequency over all documents; the window's rarest pair is
joined with the pairs of the documents, the window's place and length are checked against the
document's bounds, and the words are compared.  A window with a pair that no document has is dropped
before that join.

Only DataFrame functions are used.  The benchmark side is broadcast if it has at most
``BROADCAST_WINDOWS`` windows (counted).  Beyond that the documents' words are written once, only word
pairs with their places go through the shuffles, and the words of a document are fetched for the places
that remain.

Null and empty texts have no words; an item without words has no window, and one without id none either.
Repeated rows are judged one by one.  An empty benchmark or an empty table gives clean rows or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

WINDOW = 10
BROADCAST_WINDOWS = 100_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; separators are all ASCII characters but letters and digits."""
    # a separator in front of and behind the text makes exactly one empty piece at each end
    parts = F.split(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BREAKS, -1)
    return F.slice(parts, F.lit(2), F.size(parts) - 2)


def _windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """The distinct windows: w (words), len, items (ids as strings)."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws")).filter(
        (F.size("ws") > 0) & F.col("item").isNotNull()
    )
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (size - 1)))).alias("at")
    return (
        b.select("item", "ws", starts)
        .select("item", F.slice("ws", F.col("at"), F.lit(size)).alias("w"))
        .groupBy("w")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("len", F.size("w"))
    )


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, F.lit("\u0000"), b)


def find_windows(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: row (its place in the scan), id, digest (of its text), n_words, spans (start, end of each occurrence, 0-based), items."""
    win = materialise(_windows(benchmark, item_col, item_text, size), "windows")
    n_win = win.count()
    small = n_win <= BROADCAST_WINDOWS
    hint = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    text = F.col(text_col)
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), words(text).alias("ws"))
    if not small:
        docs = materialise(docs, "words")
    # all pairs of the windows; a one-word window has the pair of its word and nothing
    pairs = win.select("w", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("len") - 1)), lambda i: _pair(F.get("w", i - 1), F.get("w", i))))
        .alias("off", "tok"))
    single = win.filter("len = 1").limit(1).count() > 0
    if n_win:
        at = docs.select("row", "ws", F.posexplode("ws").alias("pos", "x"))
        toks = at.select(_pair(F.col("x"), F.get("ws", F.col("pos") + 1)).alias("tok"))
        if single:
            toks = toks.unionByName(at.select(_pair(F.col("x"), F.lit(None).cast("string")).alias("tok")))
        seen = toks.join(hint(pairs.select("tok").distinct()), "tok").groupBy("tok").agg(F.count("*").alias("tf"))
        # the rarest pair of each window; windows of which a pair never occurs are gone
        ranked = pairs.join(seen, "tok", "left").groupBy("w").agg(
            F.min(F.struct("tf", "tok", "off")).alias("m"), F.count_if(F.col("tf").isNull()).alias("absent")
        )
        chosen = (
            win.join(ranked.filter("absent = 0"), "w")
            .select(F.col("m.tok").alias("tok"), F.col("m.off").alias("off"), "len", "w", "items")
        )
    else:
        chosen = win.select(F.lit(0).cast("long").alias("tok"), F.lit(0).alias("off"), "len", "w", "items")
    n = F.size("ws")
    start = F.col("pos") - F.col("off")
    span = F.struct(start.alias("start"), (start + F.col("len")).alias("end")).alias("span")
    per_row = [F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"),
               F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]
    if not small:
        return _by_shuffle(docs, chosen, single).groupBy("row", "id", "digest").agg(*per_row)
    # each document also sends one row with its number of words, by way of an entry of length 0
    spark = documents.sparkSession
    mark = spark.range(1).select(
        F.lit(0).cast("long").alias("tok"), F.lit(0).alias("off"), F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("w"), F.array().cast("array<string>").alias("items"),
    )
    rare = F.broadcast(chosen.unionByName(mark))
    pos = docs.select("row", "id", "digest", "ws", F.posexplode(F.concat(F.col("ws"), F.array(F.lit("")))).alias("pos", "x"))
    # the words stay a reference inside the fused stage from here to the comparison: no operator may stand between
    pair = F.when(F.col("pos") == n, F.lit(0).cast("long")).otherwise(_pair(F.col("x"), F.get("ws", F.col("pos") + 1)))
    alone = F.when(F.col("pos") < n - 1, _pair(F.col("x"), F.lit(None).cast("string")))  # the last word's pair is that already
    token = pos.select("row", "id", "digest", "ws", "pos", (F.explode(F.array(pair, alone)) if single else pair).alias("tok"))
    fits = F.when(F.col("len") == 0, F.col("pos") == n).otherwise(
        (start >= 0) & (start + F.col("len") <= n) & (F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("w"))
    )
    hit = token.join(rare, "tok").filter(fits).select(
        "row", "id", "digest", F.when(F.col("len") == 0, F.col("pos")).alias("n_words"), F.when(F.col("len") > 0, span).alias("span"), "items",
    )
    return hit.groupBy("row", "id", "digest").agg(*per_row)


def _by_shuffle(docs: DataFrame, chosen: DataFrame, single: bool) -> DataFrame:
    """Rows as above for benchmarks beyond a broadcast; ``docs`` is a written table."""
    n = F.size("ws")
    at = docs.select("row", F.posexplode("ws").alias("pos", "x"), "ws")
    pair = _pair(F.col("x"), F.get("ws", F.col("pos") + 1))
    alone = F.when(F.col("pos") < n - 1, _pair(F.col("x"), F.lit(None).cast("string")))
    token = at.select("row", "pos", n.alias("n"), (F.explode(F.array(pair, alone)) if single else pair).alias("tok"))
    start = (F.col("pos") - F.col("off")).alias("start")
    places = token.join(chosen, "tok").filter((start >= 0) & (start + F.col("len") <= F.col("n"))).select("row", start, "len", "w", "items")
    same = F.slice("ws", F.col("start") + 1, F.col("len")) == F.col("w")
    found = places.join(docs.select("row", "id", "digest", "ws"), "row").filter(same)
    span = F.struct("start", (F.col("start") + F.col("len")).alias("end"))
    none = docs.select("row", "id", "digest", n.alias("n_words"), F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
    return none.unionByName(found.select("row", "id", "digest", F.lit(None).cast("int").alias("n_words"), span.alias("span"), "items"))


def covered(spans: Column) -> Column:
    """Number of words inside the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
        lambda a: a["n"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` (all columns) without the rows that hold a window of ``benchmark``; other texts under the id of such a row stay."""
    hits = find_windows(documents, benchmark, size).filter(F.size("spans") > 0).select(F.col("id").alias("__hit"), F.col("digest").alias("__digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__digest"))
    return documents.join(hits, same, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i:i+9] AS w FROM bw, unnest(range(1, greatest(2, len(ws)-8))) t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT len(w) AS n FROM win),
dp AS (SELECT doc_id, n, i, ws[i:i+n-1] AS w FROM dw, lens, unnest(range(1, len(ws)-n+2)) t(i) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, n, item FROM dp JOIN win USING (w) WHERE len(w) = n),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i+n)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items,
  sha256(coalesce(s,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
