"""N-gram Jaccard join by vertical partitioning, and the groups of documents that its links join.

A document's set holds its distinct runs of five words; equal sets are one class, whatever the number of
copies.  Four steps, the same at every size:

1. Which sets can link at all.  In hash order a set and its partner share at least ``k`` of the first
   n - ceil(0.8 n) + k n-grams.  Workers sort these and send them in fragments of the hash space; a set of
   which too few come back as seen in another set has no partner.  Within a worker's chunk frequent n-grams
   are settled on the spot, so a fragment receives at most one entry of an n-gram from each chunk.
2. The global order.  The n-grams of the sets that remain are counted and ordered by how many sets hold
   them, rare first.  The order is cut into fragments; a set falls into one segment for each.  The overlap
   of a pair is counted segment by segment, and the partial counts are summed.
3. Which pairs are counted.  Two sets of Jaccard 0.8 share an n-gram among the rarest fifth (and one more)
   of each.  N-grams that at most ``HOT`` such prefixes hold give pairs, after bounds on sizes and places.
   For the others all holders are compared with a first centre, and then with the holder most like it, the
   centre proper; links make components.
4. What may be missing is a link between two holders of which one is in another component than their
   centre.  With D(x) the difference of x and its centre (what it lacks and what it adds),
   |x & y| = |c| - lacks(x) - lacks(y) + |D(x) & D(y)|.  If x does not link with c, a link of x and y
   asks for a common part of D(x) and D(y), so the same prefix filter runs on the differences: for
   thousands of variants of one text they hold next to nothing in common, and no pairs arise.

Hashes of n-grams and digests of sets (128 bits) stand for them; 48 bits are used in step 1 alone, where a
collision lets a set pass.  Every pair found is counted whole, so no link is guessed and none is lost.

Null ids give no links and a null component; null or empty texts are linked with nothing; rows that share
an id count as one document (a link of any of its texts is its own), and repeated rows count once.  Extra
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, claim_worker, kept_by, slices, table
from .components import components

WORDS, NUM, DEN = 5, 80, 100  # links: DEN * overlap >= NUM * union
BOTH = NUM + DEN  # the same: BOTH * overlap >= NUM * (n1 + n2)
EXTRA = 10  # step 1 asks for a tenth of a set's size in common
CHUNK_SETS, CHUNK_ROWS, CHUNK_GRAMS = 4096, 16_384, 1 << 20
CUTS = (2, 8, 64)  # fragments of the order end at these numbers of holders
HOT, PARTNERS = 16, 256
BROADCAST_IDS, HOT_SHARE = 500_000, 1000
CACHED_WORDS = 200_000
MARK = 0xFFFF
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept while a worker lives."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()
kept_by("ngram_join", _WORDS.clear)


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """64-bit hashes of the words (A-Z lower-cased, split at ASCII white space)."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def run_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, in text order; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    n = min(WORDS, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        acc = _mix(acc ^ h[j : len(h) - n + 1 + j]) + np.uint64(j)
    return acc


def gram_set(text: str | bytes | None) -> np.ndarray:
    """The document's set: distinct hashes, ascending."""
    return np.unique(run_hashes(word_hashes(text)))


def digest(grams: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(grams.tobytes())
    return tuple(int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))


def least_overlap(n: int) -> int:
    """Overlap that a set of ``n`` must have with any that it links with."""
    return -(-n * NUM // DEN)


def extra(n: int) -> int:
    """How many common n-grams step 1 asks of sets of ``n``."""
    return max(1, n // EXTRA)


# Step 1.

ROWS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("node", pa.int64()), ("own", pa.int64()),
                  ("f", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("sets", pa.binary())])
ROWS_DDL = "id long, n long, d1 long, d2 long, node long, own long, f int, chunk long, grams binary, sets binary"


class _Chunk:
    """Some documents of a task: their rows, and the first n-grams of their distinct sets."""

    def __init__(self):
        self.rows, self.at, self.firsts, self.size = [], {}, [], 0

    def add(self, i, text) -> None:
        s = gram_set(text)
        key = digest(s)
        if not len(s) or i is None:
            self.rows.append((i, len(s), *key, None))
            return
        if key not in self.at:
            self.at[key] = len(self.at)
            self.firsts.append(s[: len(s) - least_overlap(len(s)) + extra(len(s))])
            self.size += len(self.firsts[-1])
        self.rows.append((i, len(s), *key, self.at[key]))

    def full(self) -> bool:
        return len(self.at) >= CHUNK_SETS or len(self.rows) >= CHUNK_ROWS or self.size >= CHUNK_GRAMS

    def flush(self, number: int, fragments: int) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        grams = np.concatenate([np.zeros(0, np.uint64), *self.firsts])
        sets = np.repeat(np.arange(len(self.firsts), dtype=np.int64), [len(s) for s in self.firsts])
        order = np.argsort(grams)
        grams, sets = grams[order], sets[order]
        new = np.append(True, grams[1:] != grams[:-1])[: len(grams)]
        run = np.cumsum(new) - 1
        met = np.bincount(run) > 1 if len(run) else np.zeros(0, bool)
        own = np.bincount(sets[met[run]], minlength=max(1, len(self.firsts)))
        # one entry for each n-gram: its set, or a mark that several sets hold it and have their due
        grams, sets = grams[new], np.where(met, MARK, sets[new])
        f = ((grams & np.uint64(0xFFFF)) % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(f, kind="stable")
        f, grams, sets = f[order], (grams[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6], sets[order].astype("<u2")
        cuts = [0, *(np.flatnonzero(np.diff(f)) + 1).tolist(), len(f)]
        parts = [(int(f[a]), grams[a:b].tobytes(), sets[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if a < b]
        node = [None if r[4] is None else (number << 12) | r[4] for r in self.rows]
        none = lambda n, kinds: [pa.nulls(n, k) for k in kinds]
        columns = [pa.array(c, pa.int64()) for c in list(zip(*self.rows))[:4]]
        columns += [pa.array(node, pa.int64()), pa.array([0 if r[4] is None else int(own[r[4]]) for r in self.rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns + none(len(node), ROWS.types[6:]), schema=ROWS)
        if parts:
            blobs = [pa.array([p[0] for p in parts], pa.int32()), pa.array([number] * len(parts), pa.int64())]
            blobs += [pa.array([p[i] for p in parts], pa.binary()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(none(len(parts), ROWS.types[:6]) + blobs, schema=ROWS)


def _describe(documents: DataFrame, fragments: int, id_col: str, text_col: str) -> DataFrame:
    """A row for every document, and rows of n-grams (with ``f``) for every chunk and fragment of the hash space."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngram_join")
        number, chunk = TaskContext.get().partitionId() << 24, _Chunk()
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                chunk.add(i, text)
                if chunk.full():
                    yield from chunk.flush(number, fragments)
                    number, chunk = number + 1, _Chunk()
        yield from chunk.flush(number, fragments)

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(describe, ROWS_DDL)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows (without their first column) of each value of the first column, by which they are sorted."""
    key, held = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def _seen_elsewhere(blobs: DataFrame, fragments: int) -> DataFrame:
    """node, c: how many of a set's first n-grams other chunks hold too; counted by fragment, then summed by chunk."""
    sums = pa.schema([("node", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngram_join")
        for _, held in _by_key(batches):
            grams = np.zeros((sum(len(g) for _, g, _ in held) // 6, 8), np.uint8)
            grams[:, :6] = np.frombuffer(b"".join(g for _, g, _ in held), np.uint8).reshape(-1, 6)
            grams = grams.view("<u8").ravel()
            sets = np.frombuffer(b"".join(s for _, _, s in held), "<u2").astype(np.int64)
            node = (np.repeat(np.array([c for c, _, _ in held], np.int64), [len(s) // 2 for _, _, s in held]) << 12) | sets
            order = np.argsort(grams)
            grams, sets, node = grams[order], sets[order], node[order]
            run = np.cumsum(np.append(True, grams[1:] != grams[:-1])) - 1
            met = (np.bincount(run) > 1) | (np.bincount(run, weights=sets == MARK) > 0)
            node, c = np.unique(node[met[run] & (sets != MARK)], return_counts=True)
            cuts = [0, *(np.flatnonzero(np.diff(node >> 12)) + 1).tolist(), len(node)]
            rows = [(int(node[a]) >> 12, (node[a:b] & 0xFFF).astype("<u2").tobytes(), c[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:]) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["chunk", "sets", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in _by_key(batches):
            total = np.zeros(CHUNK_SETS, np.int64)
            for sets, counts in held:
                total[np.frombuffer(sets, "<u2")] += np.frombuffer(counts, "<u4")  # a set is once in a row
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((chunk << 12) | some), pa.array(total[some])], schema=sums)

    rows = blobs.select("f", "chunk", "grams", "sets").repartition(fragments, "f").sortWithinPartitions("f")
    counts = rows.mapInArrow(count, "chunk long, sets binary, counts binary")
    return counts.repartition(fragments, "chunk").sortWithinPartitions("chunk").mapInArrow(add, "node long, c long")


def _classes(rows: DataFrame, credits: DataFrame) -> DataFrame:
    """d1, d2, n, cid (smallest id), node, m (rows), alive of each distinct set."""
    full = rows.filter("node IS NOT NULL").join(credits, "node", "left")
    least = F.ceil(F.col("n") * NUM / DEN).cast("long")  # the smallest partner's size
    enough = F.col("own") + F.coalesce("c", F.lit(0)) >= F.greatest(F.lit(1), F.floor(least / EXTRA))
    best = F.min(F.struct("id", "node"))
    out = full.groupBy("d1", "d2").agg(F.max("n").alias("n"), best.alias("r"), F.count("*").alias("m"), F.max(enough).alias("alive"))
    return out.select("d1", "d2", "n", F.col("r.id").alias("cid"), F.col("r.node").alias("node"), "m", "alive")


# Steps 2 to 4.


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it if it was counted to have few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _sets(documents: DataFrame, alive: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, n, grams of the sets in ``alive`` (d1, d2, cid, node)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngram_join")
        for batch in slices(batches, 256):
            sets = [gram_set(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            keys = [digest(s) for s in sets]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int64)
            grams = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), grams], names=["d1", "d2", "grams"])

    rows = documents.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("text"))
    rows = rows.join(_small(alive.select("cid").distinct()), "cid", "left_semi").select("text")
    found = rows.mapInArrow(whole, "d1 long, d2 long, grams array<long>")
    return found.join(_small(alive.select("d1", "d2", "node", "n")), ["d1", "d2"]).select("node", "n", "grams").dropDuplicates(["node"])


def _ranked(grams: DataFrame, by: list[str], gram: str, size: Column) -> DataFrame:
    """For each group ``by``: ``ts``, its n-grams that another group holds too, by number of holders and hash, and ``lone``, how many it holds alone."""
    keys = [c for c in grams.columns if c not in by and c != gram]
    shared = [c for c in by if c != "node"]
    holders = grams.groupBy(*shared, gram).agg(F.count("*").alias("df")).filter("df > 1")
    out = grams.join(holders, [*shared, gram]).groupBy(*by, *keys).agg(F.sort_array(F.collect_list(F.struct("df", F.col(gram).alias("g")))).alias("ts"))
    return out.withColumn("lone", size - F.size("ts"))


def _need(n: Column) -> Column:
    return F.ceil(n * NUM / DEN)


def _near(n: Column, m: Column) -> Column:
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def _segments(ordered: DataFrame) -> DataFrame:
    """node, f, n, seg: what of a set falls in each fragment of the global order."""
    within = lambda low, high: lambda t: (t["df"] > low) & (t["df"] <= high)
    rare = within(0, CUTS[0])
    ranges = [lambda t: rare(t) & (t["g"] < 0), lambda t: rare(t) & (t["g"] >= 0)]
    ranges += [within(*cut) for cut in zip(CUTS, CUTS[1:])] + [lambda t: t["df"] > CUTS[-1]]
    segs = [F.struct(F.lit(f).alias("f"), F.transform(F.filter("ts", r), lambda t: t["g"]).alias("seg")) for f, r in enumerate(ranges)]
    out = ordered.select("node", "n", F.explode(F.array(*segs)).alias("s"))
    return out.select("node", F.col("s.f").alias("f"), "n", F.col("s.seg").alias("seg")).filter(F.size("seg") > 0)


def _with_partners(pairs: DataFrame, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` (column a) and ``right`` (column b) for each of ``pairs``; an ``a`` with many partners is dealt out."""
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks"))
    hint = F.broadcast if pairs.count() <= BROADCAST_IDS else (lambda df: df)
    salted = pairs.join(hint(heavy), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")).drop("chunks")
    many = left.join(hint(heavy), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return many.join(right.join(hint(salted), "b"), ["a", "salt", *on])


def _overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """a, b, na, nb, o: the overlap of each of ``pairs`` (a, b), as the sum of its partial overlaps."""
    left = segs.select(F.col("node").alias("a"), "f", F.col("n").alias("na"), F.col("seg").alias("sa"))
    right = segs.select(F.col("node").alias("b"), "f", F.col("n").alias("nb"), F.col("seg").alias("sb"))
    both = _with_partners(pairs, left, right, ["f"])
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))


def _links(overlaps: DataFrame) -> DataFrame:
    return overlaps.filter(BOTH * F.col("o") >= NUM * (F.col("na") + F.col("nb"))).select("a", "b")


def _halves(df: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(c if c in on else c + s) for c in df.columns]) for s in "12")


def _in_order(pairs: DataFrame) -> DataFrame:
    """Distinct a, b (a < b) of node1, node2."""
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _cold_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of sets that share an n-gram of their prefixes with few holders, after bounds on their sizes and its place."""
    x, y = _halves(postings.filter(F.col("m") <= HOT).drop("m"), ["tok"])
    n1, n2 = F.col("n1"), F.col("n2")
    first = (n1 < n2) | (n1 == n2) & (F.col("node1") < F.col("node2"))
    need = NUM * (n1 + n2)
    return _in_order(x.join(y, "tok").filter(first & _near(n1, n2) & (BOTH * (n1 - F.col("pos1")) >= need) & (BOTH * (n2 - F.col("pos2")) >= need)))


def _with_centre(hot: DataFrame, centres: DataFrame) -> DataFrame:
    return hot.join(centres, "tok").filter("a <> node").select("tok", "a", F.col("node").alias("b"))


def _stars(hot: DataFrame, segs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Overlaps of the holders of each frequent n-gram with their first centre, and with the holder most like that: the centre proper."""
    first = _with_centre(hot, hot.groupBy("tok").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("a"))).alias("c")).select("tok", "c.a"))
    first = scratch.table(first, "stars")
    one = scratch.table(_overlaps(scratch.table(first.select("a", "b").distinct(), "stars"), segs), "overlaps")
    unlike = -F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
    best = first.join(one, ["a", "b"]).groupBy("tok").agg(F.min(F.struct(unlike.alias("u"), F.col("b").alias("a"))).alias("c"))
    second = _with_centre(hot, best.select("tok", "c.a")).select("a", "b").distinct()
    return one, scratch.table(_overlaps(scratch.table(second, "stars"), segs), "overlaps")


def _label(df: DataFrame, column: str, comps: DataFrame, name: str) -> DataFrame:
    return df.join(comps.select(F.col("node").alias(column), F.col("comp").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _members(stars: DataFrame, comps: DataFrame) -> DataFrame:
    """The holders of those centres that have holders outside their component: size of the difference, and how far its prefixes reach.

    ``s`` is BOTH * lacks + NUM * n: two holders link where BOTH * |D & D'| >= s + s' - BOTH * |c|.
    """
    m = _label(_label(stars, "a", _small(comps), "ca"), "b", _small(comps), "comp")
    m = m.select(F.col("a").alias("c"), F.col("na").alias("nc"), F.col("b").alias("node"), F.col("nb").alias("n"), "comp", (F.col("ca") != F.col("comp")).alias("out"),
                 (F.col("na") + F.col("nb") - 2 * F.col("o")).alias("size"), (BOTH * (F.col("na") - F.col("o")) + NUM * F.col("nb")).alias("s"))
    least = m.groupBy("c").agg(F.min(F.when(F.col("out"), F.col("s"))).alias("s_out"), F.min(F.when(~F.col("out"), F.col("s"))).alias("s_in")).filter("s_out IS NOT NULL")
    m = m.join(_small(least), "c")
    reach = lambda s: F.coalesce(F.col("size") - F.ceil((F.col("s") + F.col(s) - BOTH * F.col("nc")) / BOTH) + 1, F.lit(0))
    m = m.withColumns({"to_out": reach("s_out"), "to_in": F.when(F.col("out"), reach("s_in")).otherwise(F.lit(0))}).drop("s_out", "s_in")
    return m.filter("greatest(to_out, to_in) > 0")


def _difference_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of holders in different components that share enough of their differences from the centre to link."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = _with_partners(members.select(F.col("c").alias("a"), F.col("node").alias("b")), left, right, [])
    lacks = F.transform(F.array_except("ga", "gb"), F.bitwise_not)
    grams = both.select(F.col("a").alias("c"), F.col("b").alias("node"), F.explode(F.concat(lacks, F.array_except("gb", "ga"))).alias("g"))
    ranked = _ranked(grams, ["c", "node"], "g", F.lit(0)).drop("lone").join(members, ["c", "node"])
    lone = F.col("size") - F.size("ts")
    ranked = ranked.withColumn("lone", lone).withColumn("ts", F.slice("ts", 1, F.greatest(F.lit(0), F.greatest("to_out", "to_in") - lone).cast("int")))
    post = ranked.select("c", "node", "n", "nc", "comp", "out", "s", "size", "to_out", "to_in", "lone", F.posexplode("ts").alias("pos", "t"))
    post = post.withColumns({"g": F.col("t.g"), "pos": F.col("pos") + F.col("lone")}).drop("t", "lone")
    x, y = _halves(post, ["c", "g"])
    meet = F.when(F.col("out2"), (F.col("node1") < F.col("node2")) & (F.col("pos1") < F.col("to_out1"))).otherwise(F.col("pos1") < F.col("to_in1"))
    need = F.col("s1") + F.col("s2") - BOTH * F.col("nc1")
    rest = lambda i: BOTH * (F.col("size" + i) - F.col("pos" + i)) >= need
    fits = (F.col("comp1") != F.col("comp2")) & _near(F.col("n1"), F.col("n2")) & (F.col("pos2") < F.col("to_out2")) & meet & rest("1") & rest("2")
    return _in_order(x.filter("out1").join(y, ["c", "g"]).filter(fits))


def jaccard_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row of ``documents``.

    The result reads two tables in the shared folder; all others are deleted.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    union = lambda *xs: reduce(DataFrame.unionByName, xs)
    # as many fragments as shuffle partitions, or more for large inputs, so that a fragment holds what a few input partitions send
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions() // 4)
    described = scratch.table(_describe(documents, fragments, id_col, text_col), "described")
    rows = scratch.table(described.filter("f IS NULL").select("id", "n", "d1", "d2", "node", "own"), "rows")
    credits = scratch.table(_seen_elsewhere(described.filter("f IS NOT NULL"), fragments), "credits")
    classes = scratch.table(_classes(rows, credits), "classes")
    scratch.drop("described", "credits")
    alive = classes.filter("alive")
    sets = scratch.table(_sets(documents, alive, id_col, text_col), "sets")
    grams = sets.select("node", "n", F.explode("grams").alias("g"))
    ordered = _ranked(grams, ["node"], "g", F.col("n")).filter(F.size("ts") >= _need(F.col("n")))
    ordered = scratch.table(ordered, "ordered")
    segs = scratch.table(_segments(ordered), "segments")
    reach = F.greatest(F.lit(0), F.col("n") - _need(F.col("n")) + 1 - F.col("lone")).cast("int")
    prefix = ordered.select("node", "n", "lone", F.posexplode(F.slice("ts", 1, reach)).alias("pos", "t"))
    prefix = prefix.select(F.col("t.g").alias("tok"), "node", "n", (F.col("pos") + F.col("lone")).alias("pos"))
    held = prefix.groupBy("tok").agg(F.count("*").alias("m")).filter("m > 1")
    postings = scratch.table(prefix.join(held, "tok"), "postings")
    scratch.drop("ordered")

    near = scratch.table(_links(_overlaps(scratch.table(_cold_pairs(postings), "pairs"), segs)), "links")
    one, two = _stars(postings.filter(F.col("m") > HOT).drop("m"), segs, scratch)
    links = scratch.table(union(_same_id(rows, classes), near, _links(one), _links(two)), "links")
    comps = components(links, scratch, "first")
    members = scratch.table(_members(two, comps), "members")
    far = scratch.table(_difference_pairs(members, sets), "pairs")
    links = scratch.table(union(links, _links(_overlaps(far, segs))), "links")
    comps = components(links, scratch, "last")
    out = _result(rows, classes, comps)
    result = Scratch(spark).table(out, "groups")
    scratch.drop()
    return result


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the different sets of one id."""
    key = F.struct("d1", "d2")
    full = rows.filter("node IS NOT NULL")
    mixed = full.groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi").select("id", "lo")
    found = full.join(mixed, "id").select("lo", "d1", "d2").filter(F.col("lo") != key).distinct()
    nodes = classes.select("d1", "d2", "node")
    found = found.join(nodes, ["d1", "d2"]).select(F.col("node").alias("b"), F.col("lo.d1").alias("d1"), F.col("lo.d2").alias("d2"))
    return found.join(nodes, ["d1", "d2"]).select(F.col("node").alias("a"), "b")


def _result(rows: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    named = classes.select("node", "cid").join(comps, "node")
    least = named.groupBy("comp").agg(F.min("cid").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id")
    mine = classes.join(_small(named), "node", "left").select("d1", "d2", "m", F.coalesce("component_id", "cid").alias("component_id"))
    # at most HOT_SHARE classes hold a larger share of the rows than that: they are broadcast, so no task gets all copies of one text
    share = rows.count() / HOT_SHARE
    hot = F.broadcast(mine.filter(F.col("m") > share).select("d1", "d2", F.col("component_id").alias("hot")))
    both = rows.select("id", "n", "d1", "d2", "node").join(hot, ["d1", "d2"], "left")
    plain = both.filter("hot IS NULL AND node IS NOT NULL").join(mine.filter(F.col("m") <= share), ["d1", "d2"], "left")
    done = both.filter("hot IS NOT NULL OR node IS NULL").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("hot", "id")))
    pick = ["id", F.col("n").alias("n_shingles"), "component_id"]
    return plain.select(*pick).unionByName(done.select(*pick))


def one_of_each_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` (all columns) with the smallest id of each group of linked documents.

    Of rows that share an id one stays, any of them; rows without id stay, as nothing can be said of them.
    """
    groups = jaccard_groups(documents, id_col, text_col)
    gone = groups.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_col)).distinct()
    repeated = groups.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("id").alias(id_col))
    left = documents.join(_small(gone), id_col, "left_anti")
    repeated = _small(repeated)
    once = left.join(repeated, id_col, "left_anti")
    return once.unionByName(left.join(repeated, id_col, "left_semi").dropDuplicates([id_col])).select(*documents.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
