"""URL rules through cascades of Bloom filters.

A cascade answers "is this key listed?" exactly for every key of a known universe: level 1 encodes
the listed keys, level 2 the universe's keys that level 1 takes for listed, level 3 the listed keys
that level 2 takes for those, and so on until no false positive is left.  The corpus's complete key
universe is known here (host suffixes with path prefixes of its urls), so no join is needed to judge
a url: the levels are a few words of bits inside the expression.

Only DataFrame functions are used.  The bits of a level are one constant of the plan, at most
``MAX_WORDS`` words (32 MB, some ten million listed keys); a list beyond that is matched by an exact
join instead.  The tables that the levels are built from are deleted once they are built.

Null, empty or odd urls: without ``://`` host and path are empty, and such a url has no keys.  An
empty table gives an empty table; other columns are not touched, repeated rows stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

MAX_WORDS = 1 << 22

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no ``://``."""
    host = ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))
    return host, F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys under which a rule for this url can be listed, longest first (on a tie the longer host).

    ``lengths``: the path lengths that occur in the rules; only those prefixes can be listed.
    """
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                fits,
                lambda n: F.struct(
                    (-(F.length(h) + n)).alias("l"), (-F.length(h)).alias("h"), F.concat(h, F.substring(path, 1, n)).alias("k")
                ),
            ),
        )
    )
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.array_sort(pairs), lambda s: s["k"])
    )


class Level:
    """One Bloom filter: ``words`` of 64 bits, ``n_hash`` seeded hashes."""

    def __init__(self, words: list[int], n_hash: int, seed: int):
        self.words, self.n_hash, self.seed = words, n_hash, seed

    def holds(self, key: Column) -> Column:
        # folded to one array before the query runs
        arr, bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>"), len(self.words) * 64
        out = F.lit(True)
        for i in range(self.n_hash):
            pos = _position(key, self.seed * 100 + i, bits)
            out = out & (F.getbit(F.get(arr, F.shiftright(pos, 6)), pos.bitwiseAND(63).cast("int")) == 1)
        return out


def _position(key: Column, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(bits)).cast("int")


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over the ``n`` rows of ``keys`` (column k) with about ``rate`` false positives."""
    n_hash = max(1, round(-math.log2(rate)))
    n_words = max(1, math.ceil(n * n_hash / math.log(2) / 64))
    seeds = F.explode(F.array(*[_position(F.col("k"), seed * 100 + i, n_words * 64) for i in range(n_hash)]))
    rows = (
        keys.select(seeds.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("b"))
        .collect()  # at most n_words rows, which the caller has bounded
    )
    words = [0] * n_words
    for r in rows:
        words[r.w] = r.b
    return Level(words, n_hash, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> list[Level] | None:
    """Levels for the keys (column k) of ``listed`` over ``universe``; None if they are too many for constants."""
    scratch = Scratch(listed.sparkSession)
    inside = scratch.table(listed.select("k").distinct(), "keys")
    n = inside.count()
    if not n:
        scratch.drop()
        return []
    rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(n_universe, 1)))
    if n * -math.log2(rate) / math.log(2) / 64 > MAX_WORDS:
        scratch.drop()
        return None
    levels = [_level(inside, n, rate, 1)]
    # what level 1 wrongly takes for listed: as small as the rules
    taken = universe.filter(levels[0].holds(F.col("k"))).select("k").distinct()
    mine, other = inside, scratch.table(taken.join(inside, "k", "left_anti"), "keys")
    while m := other.count():
        if m * 1.5 / 64 > MAX_WORDS:
            scratch.drop()
            return None
        levels.append(_level(other, m, 0.5, len(levels) + 1))
        mine, other = other, scratch.table(mine.filter(levels[-1].holds(F.col("k"))), "keys")
    scratch.drop()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe: the first level that denies it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out if levels else F.lit(False)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict.

    ``rules``: action (block or allow), host, path.  A rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest wins; a url without rule gets ``default``, as the
    cascades say that none of its keys is listed.
    """
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())  # as many as path lengths
    host, path = split_url(F.col(url))
    cols = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*cols).withColumns({"host": host, "path": path})
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = base.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("__keys").alias("k"))
    n_universe = universe.agg(F.approx_count_distinct("k")).first()[0]
    keys = rules.select("action", F.concat("host", "path").alias("k"))
    cascades = {a: build_cascade(keys.filter(F.col("action") == a), universe, n_universe) for a in ("allow", "block")}
    if None in cascades.values():
        return _by_join(keyed, keys, default, cols)
    allow, block = cascades["allow"], cascades["block"]
    rule = F.get(F.filter("__keys", lambda k: member(allow, k) | member(block, k)), F.lit(0))
    out = keyed.withColumn("rule", rule)
    verdict = (
        F.when(F.col("rule").isNull(), F.lit(default)).when(member(allow, F.col("rule")), F.lit("allow")).otherwise(F.lit("block"))
    )
    return out.withColumn("verdict", verdict).select(*cols, "host", "path", "rule", "verdict")


def _by_join(keyed: DataFrame, keys: DataFrame, default: str, cols: list[str]) -> DataFrame:
    """The same answer for lists beyond literals: semi join of the distinct keys, then the best rule of each key array."""
    arrays = keyed.select("__keys").filter(F.size("__keys") > 0).distinct()
    one = keys.groupBy("k").agg(F.min("action").alias("action"))  # allow before block, as above
    hit = (
        arrays.select("__keys", F.posexplode("__keys").alias("i", "k"))
        .join(one, "k")
        .groupBy("__keys")
        .agg(F.min(F.struct("i", "k", "action")).alias("m"))
    )
    return (
        keyed.join(hit, "__keys", "left")
        .withColumns({"rule": F.col("m.k"), "verdict": F.coalesce(F.col("m.action"), F.lit(default))})
        .select(*cols, "host", "path", "rule", "verdict")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


OP10_SQL = r"""
WITH rules(action, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/')),
u AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, best.h || best.p AS rule, coalesce(best.action, 'allow') AS verdict
FROM (SELECT u.*, (SELECT {'h': r.h, 'p': r.p, 'action': r.action} FROM rules r
    WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
    ORDER BY length(r.h || r.p) DESC, length(r.h) DESC LIMIT 1) AS best FROM u)
"""
