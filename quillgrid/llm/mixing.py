"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix has as many words as the corpus.  Sources in code point order (null last) weigh 1, 2, 3 and so
on in a cycle; a source's target stops at ``MAX_EPOCHS`` times its size and the excess is shared anew by
weight.  The words of the mix go to the sources, and a source's words to its shards, by highest quotients
(size over 1, 3, 5, ...), so a source of a few words gets its share at any size of the corpus.  In each
shard the documents stand in seeded order; whole passes are taken first, then consecutive words from a
seeded block's start on.  So the result depends on the rows and the seed alone, and a hot source is spread over its shards.

Null texts have no words, nothing is taken of them; null sources form one source; repeated rows count
each, and of equal rows it is not told which is taken more often; an empty table gives no rows; extra
columns are not read.  The sums of the sources, and those of at most ``MAX_SHARDS`` shards besides one a
source, reach the driver as arrays.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

WEIGHTS, MAX_EPOCHS, BLOCKS, SEED = (1, 2, 3), 3, 20_000, 17
SHARD_DOCS, MAX_SHARDS = 2048, 16_384
BROADCAST_ROWS = 200_000


def targets(sizes: list[int], weights: list[float], cap: int = MAX_EPOCHS) -> list[float]:
    """Share of the total by weight, none above ``cap`` times its size."""
    total, out, free = sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(votes, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (1, 3, 5, ...); on a tie the earlier wins."""
    v = np.asarray(votes, dtype=np.float64)
    if not len(v) or v.sum() <= 0 or seats <= 0:
        return np.zeros(len(v), dtype=np.int64)
    count = lambda q: np.floor((v / q + 1) / 2).astype(np.int64)  # noqa: E731  quotients of at least q
    low, high = v.sum() / (2 * seats + len(v) + 2) / 2, v.max() * 1.0000001
    while count(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if count(mid).sum() > seats else (low, mid)
    out = count(high)
    left = seats - int(out.sum())
    if left > 0:
        best = list(zip((-v / (2 * out + 1)).tolist(), range(len(v))))
        heapq.heapify(best)
        for _ in range(left):
            i = best[0][1]
            out[i] += 1
            heapq.heapreplace(best, (-v[i] / (2 * out[i] + 1), i))
    return out


def word_count(c):
    """Number of runs without ASCII white space."""
    return F.size(F.split(F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" ")), r"[\x20\x09-\x0D]+", -1)) - 2


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """id, source, size, source_size, target, taken of every row."""
    spark = documents.sparkSession
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    rows = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).cast("long").alias("size"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "mix")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas()
    sources["none"] = sources["source"].isna()
    sources = sources.sort_values(["none", "source"], key=lambda c: c.map(lambda v: v or "") if c.name == "source" else c, ignore_index=True)
    sizes = sources["size"].tolist()
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_epochs)
    total = sum(sizes)
    block = max(1, total // blocks)
    # one shard for every shard_docs documents, or fewer and larger ones: MAX_SHARDS in all besides one a source
    each = max(shard_docs, -(-int(sources["n"].sum()) // MAX_SHARDS))
    sources["shards"] = np.maximum(1, -(-sources["n"].to_numpy(np.int64) // each))
    sources["target"] = np.array(goal, np.float64)
    sources["words"] = sainte_lague(goal, total)
    sources["place"] = np.arange(len(sources))
    named = [None if none else v for none, v in zip(sources["none"], sources["source"])]
    fields = zip(named, sizes, sources["target"].tolist(), sources["shards"].tolist(), sources["place"].tolist())
    s = spark.createDataFrame(list(fields), "__s string, source_size long, target double, shards int, place int")
    placed = rows.join(small(s, len(sources)), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # rows without id, and those of an id with more rows than a shard, are dealt out by their places
    many = rows.groupBy("id").agg(F.count("*").alias("m")).filter(F.col("id").isNull() | (F.col("m") > each)).select(F.col("id").alias("__i"))
    many = materialise(many, "ids")
    placed = placed.join(small(many.withColumn("often", F.lit(True)), many.count()), F.col("id").eqNullSafe(F.col("__i")), "left").drop("__i")
    salt = F.when(F.col("often"), F.col("row")).otherwise(F.lit(0))
    placed = placed.withColumn("salt", salt).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "salt"), F.col("shards")).cast("int"))
    parts = placed.groupBy("place", "shard").agg(F.sum("size").alias("size")).toPandas().sort_values(["place", "shard"], ignore_index=True)
    places, held = parts["place"].to_numpy(), parts["size"].to_numpy(np.int64)
    cuts = np.flatnonzero(np.diff(places, prepend=-1, append=-1))
    words = np.zeros(len(parts), np.int64)
    for a, b in zip(cuts, cuts[1:]):
        words[a:b] = sainte_lague(held[a:b], int(sources["words"][places[a]]))
    parts["words"] = np.minimum(words, max_epochs * held)
    start = np.random.default_rng(seed).integers(0, 1 << 62, len(parts))
    parts["first"] = start % np.maximum(1, -(-held // block)) * block
    p = spark.createDataFrame(parts.rename(columns={"place": "__p", "shard": "__h", "size": "shard_size"}),
                              "__p int, __h int, shard_size long, words long, first long")
    joined = placed.join(small(p, len(parts)), (F.col("place") == F.col("__p")) & (F.col("shard") == F.col("__h"))).drop("__p", "__h")
    order = [F.xxhash64(F.lit(seed + 1), "id", "salt"), "id", "size", "row"]
    w = Window.partitionBy("place", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(w)
    rest = F.col("words") % F.greatest("shard_size", F.lit(1))
    over = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest(F.col("end") - F.col("size"), a))
    first = F.col("first")
    part = over(first, first + rest) + over(first - F.col("shard_size"), first + rest - F.col("shard_size"))
    taken = F.floor(F.col("words") / F.greatest("shard_size", F.lit(1))) * F.col("size") + part
    return joined.withColumn("end", end).select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(taken, size):
    """How often a whole document stands in the mix: the two that a shard's selection cuts count if at least half is taken."""
    return F.when(size > 0, F.floor(taken / size + F.lit(0.5))).otherwise(F.lit(0)).cast("int")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")
