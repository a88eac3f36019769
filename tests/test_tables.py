"""Kernels that take many tables at once against those that take one."""

import random

import numpy as np

from quillgrid.operators import kernels as k


def _groups(seed, most, columns):
    """Offsets of groups of 0 to ``most`` rows, and columns of values below the given ones."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, most + 1, 300)
    return np.append(0, np.cumsum(sizes)), [rng.integers(0, n, sizes.sum()) for n in columns]


def test_text_edges_of_many_tables():
    offsets, (x0, y0, w) = _groups(1, 40, (4, 120, 4))
    for g, (a, b) in enumerate(zip(offsets, offsets[1:])):  # ranged at the left, at the right or about the middle
        x0[a:b] -= g % 3 * 5 * w[a:b]
    got = k.edges_of_all(offsets, np.arange(len(x0)), x0, y0, x0 + 10 * w)
    expected = []
    for g, (a, b) in enumerate(zip(offsets, offsets[1:])):
        if a < b:
            side, edges = k.relevant_edges(k.text_edges([(float(x), float(y), float(x + 10 * v), y + 12.0) for x, y, v in zip(x0[a:b], y0[a:b], w[a:b])]))
            expected.append((g, side, len(edges), sum(e.n for e in edges)))
    assert list(zip(*(np.asarray(got[n]).tolist() for n in ("of", "side", "n", "touches")))) == expected
    assert {e[1] for e in expected} == {"left", "right", "middle"}


def test_columns_of_many_tables():
    for spread in (3, 60):  # cliques apart, and chains that are searched
        offsets, (at, lo, w) = _groups(spread, 9, (4, spread, 40))
        x1 = at * 100 + lo
        x2 = x1 + 60 + w
        got = k.columns_of_all(offsets, np.arange(len(x1)), x1, x2)
        expected = []
        for g, (a, b) in enumerate(zip(offsets, offsets[1:])):
            m = (x1[a:b] + x2[a:b]) / 2
            near = {(i, j) for i in range(b - a) for j in range(b - a) if i != j and x1[a + j] < m[i] < x2[a + j]}
            found = sorted(k.cliques(b - a, near), key=lambda q: float(np.mean(m[q]))) if a < b else []
            expected += [(g, i, len(q), a + q[0]) for i, q in enumerate(found)]
        assert list(zip(*(got[n].tolist() for n in ("of", "col", "n", "first_seq")))) == expected


def test_places_of_many_tables():
    offsets, (rs, cs, row) = _groups(5, 40, (4, 4, 6))
    for a, b in zip(offsets, offsets[1:]):
        row[a:b] = np.sort(row[a:b])
    got = k.places_of_all(offsets, row, row, rs, cs)
    expected = []
    for a, b in zip(offsets, offsets[1:]):
        rows = [[(int(rs[i]), int(cs[i])) for i in range(a, b) if row[i] == r] for r in np.unique(row[a:b])]
        expected += k.occupied_places(rows)
    assert list(zip(*(got[n].tolist() for n in ("r", "c", "rs", "cs")))) == expected


def test_teds_of_plain_tables(monkeypatch):
    rng, full = random.Random(7), []
    real = k.tree_distance
    monkeypatch.setattr(k, "tree_distance", lambda *a: full.append(1) or real(*a))
    word = lambda some: "".join(rng.choice(some) for _ in range(rng.randint(0, 3)))
    html = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
    shortcuts = 0
    for n in range(150):
        rows = [[word("0123") or "0" for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        other = [[(word(("xyz", "x1t", "tdr<b>")[n % 3]) if rng.random() < 0.4 else x) for x in r] for r in rows]
        a, b = html(rows), html(other)
        del full[:]
        got = k.teds_both(a, b)
        shortcuts += not full and a != b
        t, u = k.table_tree(a), k.table_tree(b)
        nodes = max(k.count_nodes(t), k.count_nodes(u))
        assert got == (1 - real(t, u, k.rename_cost) / nodes, k.teds(a, b, True))
    assert shortcuts > 10


def test_tree_of_more_rows_than_a_recursion_may_have(spark, tmp_path):
    from quillgrid import registry

    spark.sql("SELECT id AS p_partkey FROM range(1500000) UNION ALL SELECT 30000003").write.parquet(f"{tmp_path}/part.parquet")
    df = registry.queries()["text_object_tree"](spark, str(tmp_path))
    # a child lies a level below its third; 30000003 has no parent here
    found = df.selectExpr("count(*) n", "count(DISTINCT id) ids", "max(depth) deepest", "count_if(id % 3 <> 0) others").first()
    assert (found.n, found.ids, found.others) == (500_000, 500_000, 0) and found.deepest == 13
