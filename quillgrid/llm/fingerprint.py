"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A document's set holds the hashes of its runs of five words (lower-cased A-Z, split at ASCII white
space; a shorter text is one shingle, an empty one has none).  The sketch is the ``k`` smallest
distinct 32-bit hashes in ascending order.  Sketches of parts merge into the sketch of the whole,
and give resemblance, containment and the number of distinct shingles; a set of at most ``k``
shingles is held whole, so its figures are exact.

Only DataFrame functions are used, inside one projection per text; nothing is exploded.  Nulls count
as empty texts, equal texts have equal sketches, two empty sketches resemble each other fully.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

K = 128
WORDS = 5
BITS = 32


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    parts = F.split(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), r"[\x20\x09-\x0D]+", -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda w: F.xxhash64(w))


def sketch(h: Column, k: int = K, n: int = WORDS) -> Column:
    """Bottom-k sketch from a column of word hashes; ``h`` must be a plain column, as it is read many times."""
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: _short(F.xxhash64(*[F.get(h, i + j) for j in range(n)])))
    shingles = F.when(F.size(h) >= n, runs).when(F.size(h) > 0, F.array(_short(F.xxhash64(h)))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.array_sort(F.array_distinct(shingles)), F.lit(1), F.lit(k))


def _short(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), F.lit(k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard resemblance of the two sets."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(merge(a, b, k)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / (F.get(a, F.lit(k - 1)) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's set that b's holds: |a and b| from resemblance and the size of the union."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Fixed-width hex of a sketch."""
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def fingerprint_documents(documents: DataFrame, text_col: str = "text", k: int = K) -> DataFrame:
    """``documents`` with sketch (array), n_shingles (estimate) and fingerprint (text)."""
    keep = [c for c in documents.columns if c not in ("sketch", "n_shingles", "fingerprint", "__h")]
    h = documents.select(*keep, word_hashes(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"))
    return h.withColumn("sketch", sketch(F.col("__h"), k)).drop("__h").withColumns(
        {"n_shingles": distinct_count(F.col("sketch"), k), "fingerprint": as_text(F.col("sketch"))}
    )


def with_neighbour(documents: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows dealt to ``parts`` ranges of descending id: key, text, part, look.

    Each range also gets, marked ``look``, the first row of the range below it (the last gets the very
    first), so that a window over (part) ordered by look, key descending sees every row's successor.
    Only the few range bounds pass through the driver.  Rows of one id are ordered by their text; rows
    without id come last.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    ids = documents.select(key.alias("key"))
    at = [i / parts for i in range(1, parts)]
    cuts = sorted(set(ids.agg(F.percentile_approx("key", at, 10_000)).first()[0] or [])) if at else []
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else None
    part = (lambda c: F.size(F.filter(bounds, lambda b: b > c))) if cuts else (lambda c: F.lit(0))
    firsts = sorted((r.p, r.k) for r in ids.groupBy(part(F.col("key")).alias("p")).agg(F.max("key").alias("k")).collect())
    base = documents.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not firsts:
        return base.withColumns({"part": F.lit(0), "look": F.lit(False)})
    heads = F.array(*[F.lit(k).cast("long") for _, k in firsts])
    above = F.array(*[F.lit(firsts[i - 1][0]) for i in range(len(firsts))])  # the part that looks at this head
    place = F.array_position(heads, F.col("key"))
    own = F.struct(part(F.col("key")).alias("part"), F.lit(False).alias("look"))
    extra = F.struct(F.get(above, place.cast("int") - 1).alias("part"), F.lit(True).alias("look"))
    dealt = F.when(place > 0, F.array(own, extra)).otherwise(F.array(own))
    return base.withColumn("d", F.explode(dealt)).select("id", "key", "text", "d.part", "d.look")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_neighbour(table(spark, sf_dir, "documents"), "doc_id", "text", parts)
    w = Window.partitionBy("part").orderBy("look", F.col("key").desc(), "text")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) AS int))"), F.substring(F.col("nxt"), F.lit(1), cut))
    step = rows.withColumn("nxt", F.coalesce(F.lead("text").over(w), F.lit("")))
    step = step.select("id", "key", "part", "look", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    step = step.select("id", "key", "part", "look", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       word_hashes(F.col("text")).alias("h"), word_hashes(F.col("edited")).alias("eh"))
    step = step.select("id", "key", "part", "look", "text", "n_chars", "edited_sha256", sketch(F.col("h")).alias("a"), sketch(F.col("eh")).alias("e"))
    step = step.withColumn("b", F.lead("a").over(w)).filter(~F.col("look"))
    return step.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e")).alias("near_edited"), resemblance(F.col("a"), F.col("b")).alias("near_next"),
        distinct_count(F.col("a")).alias("n_shingles_est"), containment(F.col("a"), F.col("e")).alias("contained_in_edited"),
    )
