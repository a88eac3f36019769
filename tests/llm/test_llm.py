"""The training-data operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.llm import decontam, fingerprint, html_extract, language, mixing, ngram_join, quality, token_file, toxicity, url_filter
from quillgrid.llm.common import held_out
from quillgrid.llm.components import components
from quillgrid.llm.queries import QUERIES, SQL
from quillgrid.session import ensure_workers

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "   \n ", "en", None, 5), (5, "a b c d e f g", "en", "s", 13),
       (6, "A B C D E F G", "en", "t", 13), (None, "a b c d e f g", "en", "s", 13), (7, "x", "fr", "u", 1), (7, "x", "fr", "u", 1), (8, "w " * 30_000, "en", "s", 60_000)]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, size string, sketch string"


@pytest.fixture()
def odd(spark):
    """Nulls, blanks, repeats, a long text, and columns whose names the operators use themselves."""
    ensure_workers(spark)
    return spark.createDataFrame([(*r, "own", "own", "own", "own") for r in ODD], DOC)


@pytest.fixture()
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    ensure_workers(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    from conftest import rows

    ensure_workers(spark)
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


# 1


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ensure_workers(spark)
    model = toxicity.learn(docs, labels)
    got = toxicity.with_toxicity(docs, model).join(labels, "doc_id").select("score", "toxic").toPandas()
    assert got["score"].between(0, 1).all()
    assert got.groupby("toxic")["score"].mean().diff().iloc[-1] > 0.3


def test_toxicity_by_hand(spark):
    """Bias, weights and the dot products of all pairs of terms, summed one by one."""
    rng = np.random.default_rng(3)
    model = toxicity.FactorisationMachine(list(range(12)))
    model.bias, model.w = 0.3, rng.normal(size=12)
    model.v = rng.normal(size=(12, 4))
    for _ in range(20):
        ids = sorted(rng.choice(12, int(rng.integers(0, 7)), replace=False).tolist())
        want = model.bias + sum(model.w[i] for i in ids) + sum(model.v[i] @ model.v[j] for i, j in combinations(ids, 2))
        assert abs(model.raw(ids) - want) < 1e-9


def test_machine_learns_pairs():
    """Neither term alone is toxic, only both: additive weights cannot tell, the products can."""
    rng = np.random.default_rng(1)
    rows = [sorted(np.flatnonzero(rng.random(4) < 0.5).tolist()) for _ in range(2000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    m = toxicity.FactorisationMachine([0, 1, 2, 3]).fit(rows, y)
    assert m.raw([0, 1]) > 0 > max(m.raw([0]), m.raw([1]), m.raw([0, 2, 3]))


def test_toxicity_odd(spark, odd, none):
    model = toxicity.FactorisationMachine([])
    assert toxicity.with_toxicity(odd, model).count() == len(ODD)
    assert toxicity.with_toxicity(none, model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(odd, empty).raw([]) < -10


# 2


def test_fingerprint_edits(spark, docs):
    got = {r.doc_id: r for r in fingerprint.op2_fingerprint(spark, SF).collect()}
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, e = shingle_set(text), shingle_set(edited)
        true = len(a & e) / len(a | e) if a | e else 1.0
        assert abs(r.near_edited - true) < (1e-9 if len(a | e) <= fingerprint.K else 0.25)
        assert text != nxt or r.near_next == 1.0


def test_sketch_merge_and_counts(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3, 40, 900)]
    df = fingerprint.fingerprint_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    r = {x.doc_id: x for x in df.collect()}
    assert [round(r[i].n_shingles) for i in (0, 1)] == [1, 36]
    assert abs(r[2].n_shingles - 896) < 300
    two = df.filter("doc_id > 0").selectExpr("max(CASE WHEN doc_id = 1 THEN sketch END) a", "max(CASE WHEN doc_id = 2 THEN sketch END) b")
    m = two.select(fingerprint.merge(F.col("a"), F.col("b")).alias("m"), "b", fingerprint.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert m.m == m.b and m.c > 0.5  # the longer text holds the shorter's shingles


def test_fingerprint_odd(odd, none):
    got = fingerprint.fingerprint_documents(odd).collect()
    assert len(got) == len(ODD) and {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (1, 5, 6)}) == 1
    assert fingerprint.fingerprint_documents(none).count() == 0
    assert fingerprint.with_neighbour(none, "doc_id", "text", 4).count() == 0
    assert fingerprint.with_neighbour(odd, "doc_id", "text", 4).filter("NOT look").count() == len(ODD)


# 3


def brute_components(rows):
    sets, parent = defaultdict(set), {}
    for i, t in rows:
        sets[i] |= {frozenset(shingle_set(t))}
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i in parent}


def test_join_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.jaccard_groups(docs).collect()
    assert {r.id: r.component_id for r in got} == brute_components(rows)
    assert all(r.n_shingles == len(shingle_set(dict(rows)[r.id])) for r in got)


def test_join_chains_and_hot_groups(spark):
    """A chain whose ends are not alike, a large group of variants, and a passage that unlike texts share."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(104)]
    rows = [(i, " ".join(base[i * 8 : i * 8 + 0] + [f"c{j}" for j in range(i * 4, i * 4 + 104)])) for i in range(8)]
    for i in range(60):
        v = list(base)
        v[int(rng.integers(100))] = f"n{i}"
        rows.append((100 + i, " ".join(v)))
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [(200 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(60)]
    ensure_workers(spark)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.id: r.component_id for r in got} == brute_components(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_join_with_centres(spark, monkeypatch, hot):
    """Groups of variants on both sides of the threshold, so that centres do not link all that links."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PARTNERS", 5)
    rng = np.random.default_rng(hot)
    rows = []
    for group, (size, edits) in enumerate([(50, 4), (40, 7), (30, 12)]):
        for i in range(size):
            v = [f"v{group}x{j}" for j in range(104)]
            # some edits are common to a few variants: these link with each other and not with the centre
            for j in rng.choice(104, int(rng.integers(0, edits)), replace=False):
                v[j] = f"n{i}x{j}"
            if i % 5 == 4:
                for j in range(10 * (i % 3), 10 * (i % 3) + 30, 10):
                    v[j] = f"m{group}x{j}"
            rows.append((len(rows), " ".join(v[: 104 - i % 4])))
    ensure_workers(spark)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.id: r.component_id for r in got} == brute_components(rows)


def test_join_finds_links_beyond_centres(spark, monkeypatch):
    """Without the step on differences, links of this group would be missing."""
    monkeypatch.setattr(ngram_join, "HOT", 2)
    base = [f"v{j}" for j in range(104)]
    rows = [(i, " ".join([f"a{i}" if j == 10 * (i + 1) else w for j, w in enumerate(base)])) for i in range(6)]
    for i in range(2):  # five common edits and one of their own: far from the others, near each other
        v = [f"z{j}" if j % 20 == 7 else w for j, w in enumerate(base)]
        v[50 + 30 * i] = f"own{i}"
        rows.append((100 + i, " ".join(v)))
    ensure_workers(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert want[101] == 100 and want[5] == 0
    assert {r.id: r.component_id for r in ngram_join.jaccard_groups(df).collect()} == want


def test_join_repeated_rows(spark):
    """A repeated row counts once; three texts under one id are one document."""
    a = [f"w{i}" for i in range(104)]
    part = a[:64] + [f"x{i}" for i in range(40)]
    rows = [(7, " ".join(a)), (7, " ".join(a)), (8, " ".join(part)), (9, "one two three four five six"), (9, "p q r s t u"), (9, "k l m n o"), (10, "P Q r s t u"), (11, "k l m  n o")]
    ensure_workers(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_groups(df).collect()
    assert len(got) == len(rows) and {(r.id, r.component_id) for r in got} == {(7, 7), (8, 8), (9, 9), (10, 9), (11, 9)}
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(df).collect()) == [7, 8, 9]


def test_join_odd(odd, none):
    got = [(r.id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(odd).collect()]
    want = {1: 1, 5: 1, 6: 1, 2: 2, 3: 3, 4: 4, 7: 7, 8: 8, None: None}
    assert {(i, c) for i, _, c in got} == set(want.items()) and len(got) == len(ODD)
    kept = ngram_join.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert ngram_join.jaccard_groups(none).count() == 0


def test_join_leaves_one_table(odd, spark):
    """All intermediate tables are deleted."""
    import os

    from quillgrid.llm.common import shared_dir

    top = f"{shared_dir(spark)}/quillgrid"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    ngram_join.jaccard_groups(odd)
    assert [x.split("-")[0] for x in set(os.listdir(top)) - before] == ["groups"]


def test_join_keeps_rows_without_id(odd, spark, tmp_path):
    odd.unionByName(odd.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}).limit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = ngram_join.op3_ngram_join(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) + 1
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (3, None)]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}


# 4


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 40))
@settings(max_examples=80, deadline=None)
def test_sainte_lague(votes, seats):
    want = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[i] += 1
    assert mixing.sainte_lague(votes, seats).tolist() == want


def test_targets():
    got = mixing.targets([10, 1000, 1000, 0], [1, 2, 3, 1])
    assert got[0] == 30 and got[3] == 0 and abs(sum(got) - 2010) < 1e-6 and abs(got[2] / got[1] - 1.5) < 1e-9


def test_mix(spark, docs):
    a = mixing.mix(docs).toPandas().sort_values("id", ignore_index=True)
    b = mixing.mix(docs.repartition(7)).toPandas().sort_values("id", ignore_index=True)
    assert a.equals(b)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(words(text[i])) == n for i, n in zip(a["id"], a["size"]))
    assert (a["taken"] <= 3 * a["size"]).all()
    g = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((g["taken"] - g["target"]).abs() <= np.maximum(0.01 * g["target"], 5)).all()


def brute_taken(docs, shards, quotas, firsts):
    """Words taken of each document by walking word by word through each shard."""
    out = defaultdict(int)
    for s, members in shards.items():
        words = [i for i, n in members for _ in range(n)]
        for k in range(quotas[s]):
            out[words[(firsts[s] + k) % len(words)]] += 1
    return out


def test_mix_walks_words(spark):
    """Taken words against a plain walk from the seeded start, for one source and one shard, repeats included."""
    ensure_workers(spark)
    rows = [(i, "a", "w " * (i % 5)) for i in range(1, 30)] + [(i, "b", "w " * 7) for i in range(100, 104)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.id: r for r in mixing.mix(df).collect()}
    for source in "ab":
        mine = {i: len(t.split()) for i, s, t in rows if s == source}
        quota = sum(got[i].taken for i in mine)
        assert abs(quota - got[min(mine)].target) <= 1
        matches = []
        order = spark.createDataFrame([(i,) for i in mine], "id long").orderBy(F.xxhash64(F.lit(mixing.SEED + 1), "id", F.lit(0).cast("long")), "id").collect()
        walk = [(r.id, mine[r.id]) for r in order]
        for first in range(sum(mine.values())):
            taken = brute_taken(mine, {0: walk}, {0: quota}, {0: first})
            matches.append(all(taken[i] == got[i].taken for i in mine))
        assert any(matches)


def test_mix_without_ids(spark):
    """Rows without id and of one id are dealt to shards like others."""
    ensure_workers(spark)
    rows = [(None if i % 2 else 5, "a", "w w w") for i in range(3 * mixing.SHARD_DOCS)] + [(9, "b", "w " * 900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    g = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(g["taken"] - g["target"]) <= 1).all()


def test_mix_odd(odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 3 * got["size"]).all() and mixing.mix(none).count() == 0


def test_mix_tiny_sources(spark):
    """Sources far below a block's words beside a hot one, and more sources than blocks."""
    ensure_workers(spark)
    hot = [(i, "hot", "w " * 500) for i in range(200)]
    tiny = [(1000 + i, "a tiny", "w " * (3 + i)) for i in range(2)]
    tail = [(2000 + i, f"tail {i:03d}", "w " * 5) for i in range(60)]
    got = mixing.mix(spark.createDataFrame(hot + tiny + tail, "doc_id long, source string, text string"), blocks=20).toPandas()
    g = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (g["target"] > 0).all() and ((g["taken"] - g["target"]).abs() <= 1).all() and len(g) == 62
    assert g["taken"]["a tiny"] == 21 and g["taken"].sum() == got["size"].sum()


# 5


def test_html():
    page = """<html><head><title>t</title><style>p{}</style><script>var a = "</p>";</script></head><body class="has-sidebar"><header>Site</header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy, buy, buy.</div><div id="content"><h1>Head &amp; tail</h1><p>First   part,<br>with a long enough text, and commas.
    <p>Second <b>part &eacute; of it, quite long too.</p><ul class="menu"><li>x</li></ul><form>Mail <input></form></div>
    <div class="comments"><p>I disagree, and at length, with commas, so many.</p></div><aside>More</aside><footer>End</footer></body>"""
    assert html_extract.main_text(page) == "Head & tail\nFirst part, with a long enough text, and commas.\nSecond part é of it, quite long too."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<div><p></p></div>") == ""
    assert html_extract.main_text("<article><p>Cut in the mid") == "Cut in the mid"
    two = "<body><article><section><p>One, two, three.</p></section><section><p>Four, five, six.</p></section></article><nav>x</nav></body>"
    assert html_extract.main_text(two) == "One, two, three.\nFour, five, six."


def test_html_keeps_link_lists_and_parts():
    refs = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    page = f"<body><article><p>One, two, three.</p>{refs}<ul class=related><li><a href=/3>More</a></li></ul></article></body>"
    assert html_extract.main_text(page) == "One, two, three.\nFirst source\nSecond source"
    body = "A sentence of the page, with commas, that is long enough to count as prose"
    for n in (2, 3):
        parts = [f"<section><div><p>{body} {i}.</p></div></section>" for i in range(n)]
        page = f"<body><nav>Home</nav>{''.join(parts)}<div class=comments><p>{body}.</p></div></body>"
        assert html_extract.main_text(page) == "\n".join(f"{body} {i}." for i in range(n))


def test_html_pages(spark):
    ensure_workers(spark)
    got = html_extract.op5_html_extract(spark, SF).toPandas()
    assert (got["n_chars"] == got["text"].str.len()).all() and (got["n_chars"] > 0).all()
    odd = spark.createDataFrame([(1, None, None, "own"), (2, "u", "<p>a</p>" * 20_000, "own"), (2, "u", "<p>a</p>", "own")], "page_id long, url string, html string, text string")
    assert sorted(html_extract.extract_pages(odd).select("n_chars").toPandas()["n_chars"]) == [0, 1, 39_999]


# 6


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><![foo[x]]>", "a"), ("<p>x</p><!DOCTYPE [", "x"), ("<p>x</p><div class=", "x"), ("<p>x</p><!-- y", "x"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
    ("<ul><li>" * 5000 + "x", "x"), ("<p>a</p>" + "<span>" * 5000 + "</b>" * 5000, "a"), ("<b><table><td>" + "<i>" * 5000 + "</b>" * 5000 + "z", "z"),
    ("<p>one</i></b></p></p></div><p>two</p>", "one\ntwo"),
])
def test_html_malformed_and_deep(html, text):
    import time

    start = time.perf_counter()
    assert html_extract.main_text(html) == text and time.perf_counter() - start < 3


def test_html_points_by_hand():
    """Points as the naive walk over all ancestors gives them."""
    html = "<div><div><p>" + "a, b, c " * 9 + "</p><ul><li>one, two <p>three, four</p></li></ul>own, text</div><p>x, y</p></div><section><blockquote>q, <i>r</i></blockquote></section>"
    root = html_extract.parse(html)
    nodes = list(html_extract._walk(root))
    html_extract._measure(nodes)
    html_extract._score(nodes)
    want = dict.fromkeys(nodes, 0.0)
    for node in nodes:
        para = node.tag in html_extract.PARAGRAPH
        own = [k for k in node.kids if isinstance(k, str) and k.strip()]
        if not node.n or not (para or own and node.tag in html_extract.LISTS | html_extract.KEPT):
            continue
        text = html_extract._inline_text(node) if para else " ".join(own)
        points = (min(1, node.n / 25) + text.count(",") + min(node.n / 100, 3)) * (1 - html_extract._density(node))
        up, share = node.parent if para else node, 1
        while up is not None:
            if up.tag not in html_extract.PARAGRAPH or up.tag in ("td", "li", "dd", "blockquote"):
                want[up] += points * share
                share /= 2
            up = up.parent
    assert all(abs(n.points - want[n]) < 1e-9 for n in nodes) and max(want.values()) > 5


def test_language_many():
    """More languages than a signed byte counts."""
    langs = [f"l{i:03}" for i in range(300)]
    model = language.LanguageModel(langs, {}, np.zeros((0, 300)), {})
    rows = np.full((4, 300), -1.0)
    rows[:2, 299], rows[2:, 140] = 50, 50
    path = model.paths([rows])[0]
    assert path.tolist() == [299, 299, 140, 140] and language.spans(list("abcd"), path, langs) == [(0, 2, "l299"), (2, 4, "l140")]


def test_language(spark, docs):
    model = language.learn(docs)
    got = language.with_language(docs.withColumn("h", held_out(F.col("doc_id"), 3, 1)), model).filter("h AND lang IS NOT NULL").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    labeller = language.Labeller(model)
    by = {r.lang: r.text for r in docs.filter("n_chars > 600").collect()}
    text = " ".join(by["en"].split()[:40] + by["de"].split()[:40])
    words_, path = labeller.label([text])[0]
    spans = language.spans(words_, path, model.langs)
    assert [s[2] for s in spans if s[1] - s[0] > 10] == ["en", "de"]


def test_viterbi():
    rng = np.random.default_rng(0)
    model = language.LanguageModel(["a", "b", "c"], {}, np.zeros((0, 3)), {})
    rows = [rng.normal(size=(n, 3)) * 3 for n in (1, 6, 0, 4)]

    def best(e):
        paths = np.array(np.meshgrid(*[range(3)] * len(e))).reshape(len(e), -1).T
        score = [sum(e[i, p[i]] for i in range(len(e))) - 2.0 * np.count_nonzero(np.diff(p)) for p in paths]
        return paths[int(np.argmax(score))].tolist()

    for e, p in zip(rows, model.paths(rows, 2.0)):
        assert p.tolist() == (best(e) if len(e) else [])


def test_language_odd(odd, none):
    got = {r.doc_id: r.lang_pred for r in language.with_language(odd, language.learn(odd)).collect()}
    assert got[2] == got[3] == got[4] == "und" and got[8] == "en"
    assert language.with_language(none, language.learn(none)).count() == 0
    assert language.script("слово") == "cyrillic" and language.script("été") == "latin"


# 7


def test_quality_by_hand(spark, docs):
    """The lookup tables, added bin by bin in plain Python, and the same bits however rows are dealt."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, again = (quality.learn(d, labels) for d in (docs, docs.repartition(7)))
    got = {r.doc_id: r.score for r in quality.with_quality(docs.select("doc_id", "text"), model).collect()}
    two = {r.doc_id: r.score for r in quality.with_quality(docs.select("doc_id", "text"), again).collect()}
    assert got == two
    for r in docs.limit(50).collect():
        x = quality.features(r.text)
        place = lambda edges, v: sum(e <= v for e in edges)
        f = model.bias + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x))
        f += sum(t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])] for i, j, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-f))) < 1e-9


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.with_quality(docs, quality.learn(docs, labels), name="q").join(labels, "doc_id").select("q", "quality").toPandas()
    assert ((got["q"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95


def test_additive_model():
    rng = np.random.default_rng(3)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    m = quality.AdditiveModel().fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    assert quality.AdditiveModel().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_odd(odd, none):
    model = quality.AdditiveModel()
    assert quality.with_quality(odd, model).count() == len(ODD) and quality.with_quality(none, model).count() == 0
    assert len(quality.features(None)) == quality.N_FEATURES


# 8


def test_decontamination_by_shuffle(spark, docs, odd, none, monkeypatch):
    """The way beyond a broadcast gives the same rows."""
    ensure_workers(spark)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, "w"), (None, "a b c d")], "item_id long, text string"))
    one = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    pick = lambda: sorted(map(repr, decontam.find_windows(one, bench).select("id", "n_words", "spans", "items").collect()))
    want = pick()
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert pick() == want and sum("start=" in r for r in want) > 3
    assert decontam.find_windows(none, bench).count() == 0


def test_decontaminate_keeps_other_texts_of_an_id(spark):
    rows = [(1, "a b c d e f g h i j k"), (1, "quite another text"), (None, "a b c d e f g h i j"), (None, "x")]
    item = spark.createDataFrame([("t", "A b c d e f g h i j")], "item_id string, text string")
    left = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), item)
    assert sorted(r.text for r in left.collect()) == ["quite another text", "x"]


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "B c, D"), (2, None), (3, ""), (4, "x"), (5, "not there"), (6, " ".join("w" for _ in range(12)))], "item_id long, text string")
    got = {(r.id, r.n_words, tuple((s.start, s.end) for s in r.spans[:2]), tuple(r["items"])) for r in decontam.find_windows(odd, bench).collect()}
    assert (1, 7, ((1, 4),), ("1",)) in got and (7, 1, ((0, 1),), ("4",)) in got and (2, 0, (), ()) in got
    assert decontam.find_windows(odd, bench).count() == len(ODD)
    assert decontam.find_windows(none, bench).count() == 0
    assert decontam.find_windows(odd, bench.filter("false")).filter(F.size("spans") > 0).count() == 0
    clean = decontam.decontaminate(odd, bench)
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]


def test_covered(spark):
    s = spark.sql("SELECT array(struct(0 AS start, 3 AS end), struct(2 AS start, 5 AS end), struct(9 AS start, 10 AS end)) AS s")
    assert s.select(decontam.covered(F.col("s"))).first()[0] == 6


# 9


@given(st.lists(st.integers(0, 2**31), max_size=1500), st.sampled_from([8, 16]))
@settings(max_examples=40, deadline=None)
def test_codes(ids, width):
    blob = token_file.dac_encode(np.array(ids, np.uint64), width)
    assert token_file.dac_decode(blob).tolist() == ids
    for i in range(0, len(ids), 97):
        assert token_file.dac_get(blob, i) == ids[i]


def test_encoder():
    e = token_file.encoder(token_file.vocabulary_path())
    for text in ("", " ", "a  b", "it's  a\n\n test ,x ### done. ", "naïve café—ok", "\tx y\n z", "a" * 5000, "w1 22 w-3, don't!", "trailing ", "one.\nTwo\nthree 's x\n's", "\na b", " a\nb", "a\n\nb", "a\n\n\nb",
                 "end\n", "a \nb", "a\n b", "x\u00a0y z\u2003q", "a\x1cb c\x85d"):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet="ab'sZ1é-.,\n \t\u00a0漢", max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_blocks(texts):
    """Whatever was encoded before, a text has the ids of the tokenizer's plain call."""
    e = token_file.encoder(token_file.vocabulary_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode_all(pa.array(texts, pa.string()))] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.text(alphabet="aéZ1½,.'-#%st—…\u0301\x00\x7f \n\t\u00a0\u200b漢", max_size=14), max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_marks(texts):
    """Marks behind stems of all kinds, and few stems kept."""
    e = token_file.encoder(token_file.vocabulary_path())
    before, token_file.CACHED_WORDS = token_file.CACHED_WORDS, 8
    try:
        got = [np.frombuffer(b, "<u4").tolist() for b in e.encode_all(pa.array(texts, pa.string()))]
    finally:
        token_file.CACHED_WORDS = before
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_characters():
    """Every character in a word, alone and before a mark."""
    e = token_file.encoder(token_file.vocabulary_path())
    texts = [f"a{c} {c}, {c}a\n{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (ord(c) < 0x3400 or ord(c) % 61 == 0)]
    got = e.encode_all(pa.array(texts, pa.string()))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_encoder_keeps_no_objects():
    """New words cost a worker neither time nor memory for Python objects of their own."""
    import sys

    words = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(60_000)]
    e = token_file.Encoder(token_file.vocabulary_path())
    texts = pa.array([" ".join(words)], pa.string())
    before = sys.getallocatedblocks()
    n = len(e.encode_all(texts)[0])
    assert n > 4 * len(words) and sys.getallocatedblocks() - before < len(words)


def test_tokens_read_in_place(spark, docs, tmp_path):
    """Single tokens from the written files, by range reads of a few bytes."""
    ensure_workers(spark)
    token_file.write_tokens(docs.limit(40), f"{tmp_path}/t", token_file.vocabulary_path(), segment=3000, parts=2)
    n = 0
    for r in spark.read.parquet(f"{tmp_path}/t").withColumn("file", F.input_file_name()).collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            start = f.read().index(bytes(r.codes))  # where the segment's codes begin in the file
            sizes = []

            def read(at, size, f=f, start=start, sizes=sizes):
                sizes.append(size)
                f.seek(start + at)
                return f.read(size)

            for i in (0, 1, r.n_tokens // 2, r.n_tokens - 1):
                sizes.clear()
                assert token_file.dac_read(read, i) == token_file.dac_decode(r.codes)[i] and sum(sizes) < 400
                n += 1
    assert n >= 8


def test_encoder_added_tokens():
    from tokenizers import Tokenizer

    e = token_file.encoder(token_file.vocabulary_path())
    plain = Tokenizer.from_file(token_file.vocabulary_path())
    assert e.added
    for t in e.added:
        for text in (t, f"a {t} b", f"a{t}b c d", f"one two, {t}", f"{t[:-1]} x"):
            assert np.frombuffer(e.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file.op9_token_file(spark, SF).collect()}
    e, at = token_file.encoder(token_file.vocabulary_path()), 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = e.tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_odd(odd, none):
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_file.write_and_digest(odd).collect())
    assert [r[1] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8] and [r[2] for r in got][2:4] == [1, 1]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert token_file.write_and_digest(none).count() == 0


# 10


def test_urls_odd(spark):
    rows = [(1, "http://A.example.COM/en/78?x"), (2, None), (3, "no scheme"), (4, "ftp://x.com/en/1"), (5, "http://com/en/"), (6, "http://excom/en/"), (7, "http://a.net#/de/"),
            (8, "x://y.net/de/8/9"), (9, "http://y.example.net/de/80"), (9, "http://y.example.net/de/80"), (10, "http:///en/")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules).collect()}
    assert got[1] == ("a.example.com", "example.com/en/7", "allow") and got[2] == got[3] == ("", None, "allow")
    assert got[4][1:] == ("com/en/", "block") and got[5][2] == "block" and got[6][1] is None and got[7][1] is None
    assert got[8][1:] == ("net/de/", "allow") and got[9][1:] == ("example.net/de/8", "block") and got[10] == ("", None, "allow")
    assert url_filter.url_verdicts(pages.filter("false"), rules).count() == 0
    assert url_filter.url_verdicts(pages, rules.filter("false")).filter("verdict = 'block'").count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    listed = universe.filter("crc32(k) % 10 = 0")
    levels = url_filter.build_cascade(listed, universe, 3000)
    wrong = universe.filter(url_filter.member(levels, F.col("k")) != (F.crc32("k") % 10 == 0)).count()
    assert wrong == 0 and len(levels) > 1


def test_cascade_of_many_words(spark):
    """A list whose level has thousands of words of bits."""
    universe = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("k"))
    levels = url_filter.build_cascade(universe.filter("crc32(k) % 2 = 0"), universe, 60_000)
    assert len(levels[0].words) > 600
    assert universe.filter(url_filter.member(levels, F.col("k")) != (F.crc32("k") % 2 == 0)).count() == 0


def test_long_lists_by_join(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_WORDS", 0)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    joined = sorted(map(tuple, url_filter.url_verdicts(pages, rules).collect()), key=repr)
    monkeypatch.undo()
    assert joined == sorted(map(tuple, url_filter.url_verdicts(pages, rules).collect()), key=repr)


# the pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    now, seen = docs, []
    for name, stage in p.STAGES:
        out = stage(spark, now, SF).cache()
        seen.append((name, now, out))
        now = out
    columns = docs.columns
    assert all(o.columns == columns for _, _, o in seen[:-1])
    kept = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    (_, d0, q), (_, _, n), (_, _, c), (_, _, m), (_, _, t) = seen
    assert set(kept(q)) < set(kept(d0))
    comps = brute_components([(r.doc_id, r.text) for r in q.collect()])
    assert sorted(kept(n)) == sorted(set(comps.values()))
    hit = {r.id for r in decontam.find_windows(n, spark.read.parquet(f"{SF}/benchmark.parquet")).filter(F.size("spans") > 0).collect()}
    assert sorted(kept(c)) == sorted(set(kept(n)) - hit)
    times = defaultdict(int)
    for i in kept(m):
        times[i] += 1
    assert max(times.values()) <= 3 and set(times) <= set(kept(c)) and len(kept(t)) == len(kept(m))
    assert sorted(kept(p.run(spark, SF))) == sorted(kept(t))
