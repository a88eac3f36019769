"""Pages of equal content are worked out once, and every page gets its rows."""

import duckdb
import numpy as np
import pytest
from conftest import rows

from quillgrid import registry
from quillgrid.operators import kernels as k
from quillgrid.plans.relations import RELATIONS
from quillgrid.session import ensure_workers

BY_SQL = {
    "F1": "check_table_match_images", "F2": "page_html", "F10": "suppress_by_earlier", "F12": "suppress_by_score",
    "F13": "filter_layout_figure", "F15": "is_text_cell", "F16": "joint_points_outside_images", "F20": "show_html",
}
BY_KERNEL = {"F3": "sorted_boxes", "F7": "snap_corners", "F9": "rotated_nms", "F14": "hard_nms", "F17": "multiclass_nms", "F18": "nms_inter_classes"}


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """1,000 parts, some with keys beyond a million; 600 suppliers, one of them twice and one without key."""
    d = tmp_path_factory.mktemp("layout")
    c = duckdb.connect()
    part = "SELECT CASE WHEN i % 5 = 0 THEN i + 1000010 ELSE i END AS p_partkey, CAST(CASE WHEN hash(i) % 2 = 0 THEN 50 ELSE 1 END AS INT) AS p_size FROM range(1000) t(i)"
    supplier = "SELECT i AS s_suppkey FROM range(1, 601) t(i) UNION ALL SELECT 7 UNION ALL SELECT NULL"
    for name, sql in (("part", part), ("supplier", supplier)):
        c.sql(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), c


def _shuffled(spark):
    """Rows written to shuffles by all stages so far."""
    gw = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", BY_SQL.values())
def test_against_sql(spark, made, name):
    path, duck = made
    ensure_workers(spark)
    mine, theirs = registry.queries()[name](spark, path).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", BY_KERNEL.values())
def test_every_page_has_its_rows(spark, made, name):
    """As many rows for each page as for the page of the same boxes that stands first, and few of them shuffled."""
    path, _ = made
    ensure_workers(spark)
    before = _shuffled(spark)
    got = registry.queries()[name](spark, path).toPandas()
    assert _shuffled(spark) - before < 40_000  # the boxes of all pages are 60,100
    by = {p: sorted(map(tuple, g.drop(columns="page").to_numpy().tolist())) for p, g in got.groupby("page")}
    assert set(by) == set(range(1, 601)) or name == "snap_corners" and len(by) > 100
    for p in by:
        if p != 7:
            assert by[p] == by[p % 10 or 10 if p % 10 != 7 else 17]
    if name == "sorted_boxes":
        assert len(by[7]) == 2 * len(by[17]) == 200


def test_rotated_nms_by_distinct_boxes():
    rng = np.random.default_rng(3)
    b = rng.integers(0, 12, (300, 2)).astype(float) * 5
    b = np.column_stack([b, b + rng.integers(5, 9, (300, 2))])
    s = rng.integers(0, 6, 300).astype(float)
    angles = s * 0.03

    def inside(i, j):
        u, v = (b[i, 0] + b[i, 2] - b[j, 0] - b[j, 2]) / 2, (b[i, 1] + b[i, 3] - b[j, 1] - b[j, 3]) / 2
        w, z = np.cos(angles[j]), np.sin(angles[j])
        return abs(u * w + v * z) < (b[j, 2] - b[j, 0]) / 2 and abs(v * w - u * z) < (b[j, 3] - b[j, 1]) / 2

    kept = []
    for i in sorted(range(300), key=lambda i: (-s[i], i)):
        if not any(s[j] > s[i] and (inside(i, j) or inside(j, i)) for j in kept):
            kept.append(i)
    assert k.rotated_nms(b, s, angles) == kept and 20 < len(kept) < 300


def test_nearest_free_takes_the_first_of_equals():
    rng = np.random.default_rng(4)
    free, points, s = rng.integers(0, 8, (90, 2)).astype(float), rng.integers(0, 8, (120, 2)).astype(float), rng.integers(0, 5, 120).astype(float)
    left, expected = free.copy(), []
    for i in sorted(range(120), key=lambda i: (-s[i], i)):
        d = abs(left[:, 0] - points[i, 0]) + abs(left[:, 1] - points[i, 1])
        if d.min() <= 3:
            expected.append((i, *left[np.argmin(d)].tolist()))
            left[np.argmin(d)] = np.inf
    assert k.nearest_free(points, s, free, 3) == expected and len(expected) > 40
    assert k.nearest_free(points, s, free[:0], 3) == []


def test_point_equal_in_of_a_dense_group(spark, tmp_path):
    """4,000 orders of one customer make 250,000 pairs of neighbours at most, and each row of an id counts for itself."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT CASE WHEN i < 10 THEN 5 ELSE i END AS o_orderkey, CASE WHEN i % 97 = 0 THEN NULL ELSE 13 + i % 2 * 13 END AS o_custkey FROM range(4000) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df = registry.queries()["point_equal_in"](spark, str(tmp_path))
    assert rows(df.toPandas()) == rows(c.sql(registry.oracle_sql()["point_equal_in"]).df())
    assert "(grp" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and "cx" in plan


def test_page_html_is_held_once_in_files(spark, tmp_path):
    """40 pages of one content, over a megabyte each: files have that text a few times only, and each page has it whole."""
    c = duckdb.connect()
    for name, sql in (("part", "SELECT i * 10 AS p_partkey, CAST(i % 50 AS INT) AS p_size FROM range(90000) t(i)"), ("supplier", "SELECT i * 10 AS s_suppkey FROM range(40) t(i)")):
        c.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    registry.queries()["page_html"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    digest = lambda of: rows(c.sql(f"SELECT page, md5(html) AS md5, length(html) AS n FROM ({of}) t").df())
    got = digest(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert got == digest(registry.oracle_sql()["page_html"]) and len(got) == 40 and min(n for _, n, _ in got) > 1 << 20
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 5_000_000
    assert spark.conf.get("parquet.dictionary.page.size", None) is None  # holds for this result only


def test_point_equal_in_has_a_tolerance(spark, tmp_path):
    """points up to 1 apart in whole coordinates are within the reference's tolerance of 2, and points 2 apart are not."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT i * 3 AS o_orderkey, i * i % 1000 AS o_custkey FROM range(2000) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    b = c.sql(RELATIONS["boxes"][1]).df()
    apart = lambda i: np.maximum(abs(b.ax1 - b.bx1[i]), abs(b.ay1 - b.by1[i]))[(b.grp == b.grp[i]) & (b.id != b.id[i])].min()
    least = np.array([apart(i) for i in range(len(b))])
    assert all((least == n).sum() > 50 for n in (1, 2)) and (least == 0).any()
    got = registry.queries()["point_equal_in"](spark, str(tmp_path)).toPandas()
    assert dict(zip(got.id, got.v, strict=True)) == dict(zip(b.id, least < 2, strict=True))
    assert rows(got) == rows(c.sql(registry.oracle_sql()["point_equal_in"]).df())
