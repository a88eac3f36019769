"""Order-dependent and tree algorithms: a plain function for each, and an adaptor that runs it per page or table.

The groups are pages or tables, whose sizes do not grow with the corpus.
"""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on each group; its rows get the keys in front.

    One shuffle by the keys and a sort bring groups together; a worker then walks through its partition
    batch by batch, so thousands of small groups share one call.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in keys]
        out = f(pdf.reset_index(drop=True))
        for k, v in zip(keys, head):
            out[k] = v
        return out[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None and len(held):
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k = pdf[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
            held = pdf.iloc[cuts[-1] :]  # its group may go on in the next batch
            out = [one(pdf.iloc[x:y]) for x, y in zip(cuts, cuts[1:])]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held):
            yield one(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


# suppression


def iou_matrix(a: np.ndarray, b: np.ndarray, smaller: bool = False) -> np.ndarray:
    """IoU of each box of ``a`` with each of ``b``; by the smaller area if asked."""
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    o, sa, sb = w * h, area(a)[:, None], area(b)[None, :]
    return o / np.maximum(np.minimum(sa, sb) if smaller else sa + sb - o, 1e-12)


def greedy_nms(boxes: np.ndarray, scores: np.ndarray, threshold: float, top_k: int = -1, candidates: int = 0, smaller: bool = False) -> list[int]:
    """Indices kept: best first, every box that overlaps a kept one beyond the threshold goes."""
    order = np.lexsort((np.arange(len(scores)), -scores))
    order = order[:candidates] if candidates else order
    kept: list[int] = []
    while len(order):
        i = int(order[0])
        kept.append(i)
        if 0 < top_k == len(kept):
            break
        rest = order[1:]
        o = iou_matrix(boxes[i : i + 1], boxes[rest], smaller)[0]
        order = rest[o < threshold] if smaller else rest[o <= threshold]
    return kept


def multiclass_nms(boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, least: float, threshold: float, most: int = -1) -> list[int]:
    """Greedy suppression within each class of the boxes that score more than ``least``; the best ``most`` of all."""
    kept = []
    for k in np.unique(classes):
        own = np.flatnonzero((classes == k) & (scores > least))
        kept += [int(own[i]) for i in greedy_nms(boxes[own], scores[own], threshold)]
    kept.sort(key=lambda i: (-scores[i], i))
    return kept[:most] if most > 0 else kept


def rotated_nms(boxes: np.ndarray, scores: np.ndarray, angles: np.ndarray) -> list[int]:
    """Best first; a later box goes if the centre of one lies in the other and it scores less."""
    # boxes that agree in all are kept or go together, as none of them scores less
    alike, of = np.unique(np.column_stack([boxes, scores, angles]), axis=0, return_inverse=True)
    one, points = alike[:, :4], alike[:, 4]
    cx, cy = (one[:, 0] + one[:, 2]) / 2, (one[:, 1] + one[:, 3]) / 2

    half_w, half_h = (one[:, 2] - one[:, 0]) / 2, (one[:, 3] - one[:, 1]) / 2
    cos, sin = np.array([math.cos(a) for a in alike[:, 5]]), np.array([math.sin(a) for a in alike[:, 5]])

    def inside(i, j):
        u, v = cx[i] - cx[j], cy[i] - cy[j]
        return (abs(u * cos[j] + v * sin[j]) < half_w[j]) & (abs(v * cos[j] - u * sin[j]) < half_h[j])

    rest, kept = np.argsort(-points, kind="stable"), np.zeros(len(one), bool)
    while len(rest):
        i, rest = int(rest[0]), rest[1:]
        kept[i] = True
        rest = rest[~((points[i] > points[rest]) & (inside(i, rest) | inside(rest, i)))]
    found = np.flatnonzero(kept[of.reshape(-1)])
    return found[np.argsort(-scores[found], kind="stable")].tolist()


def nearest_free(points: np.ndarray, scores: np.ndarray, free: np.ndarray, most: float) -> list[tuple[int, float, float]]:
    """Best first, each point takes the nearest free one (of equally near ones the first) no farther than ``most`` by |dx| + |dy|.

    Free points of one place are looked at once and taken in their order.
    """
    at, of = np.unique(free, axis=0, return_inverse=True)
    by_place = np.argsort(of.reshape(-1), kind="stable")
    ends = np.cumsum(np.bincount(of.reshape(-1), minlength=len(at))).tolist()
    next_ = [0, *ends[:-1]]
    head = by_place[next_] if len(at) else by_place
    x, y = at[:, 0].copy(), at[:, 1].copy()
    out = []
    for i in np.argsort(-scores, kind="stable").tolist() if len(at) else ():
        d = abs(x - points[i, 0]) + abs(y - points[i, 1])
        least = d.min()
        if not least <= most:
            continue
        same = np.flatnonzero(d == least)
        w = int(same[np.argmin(head[same])])
        out.append((i, float(at[w, 0]), float(at[w, 1])))
        next_[w] += 1
        if next_[w] < ends[w]:
            head[w] = by_place[next_[w]]
        else:
            x[w] = y[w] = np.inf
    return out


# reading order


def sorted_boxes(boxes: np.ndarray) -> list[int]:
    """By y and x, then one pass that swaps neighbours of one line whose x are in the wrong order."""
    o = np.lexsort((boxes[:, 0], boxes[:, 1])).tolist() if len(boxes) else []
    at = boxes[:, :2].tolist()
    for i in range(len(o) - 1):
        a, b = at[o[i]], at[o[i + 1]]
        if abs(b[1] - a[1]) < 10 and b[0] < a[0]:
            o[i], o[i + 1] = o[i + 1], o[i]
    return o


# polygons


def clip_polygon(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Part of a convex polygon inside another (corners in one turning sense)."""
    out = list(subject)
    turn = 1.0 if signed_area(window) > 0 else -1.0
    for (x1, y1), (x2, y2) in zip(window, window[1:] + window[:1]):
        side = lambda p: turn * ((x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1))  # noqa: E731, B023
        cut, out = out, []
        for p, q in zip(cut, cut[1:] + cut[:1]):
            a, b = side(p), side(q)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def signed_area(p: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def covered_share(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Share of a's area inside b."""
    whole = abs(signed_area(a))
    return abs(signed_area(clip_polygon(a, b))) / whole if whole else 0.0


# text edges


class TextEdge:
    """A vertical line on which text lines start, end or centre."""

    def __init__(self, x: float, y0: float, y1: float):
        self.x, self.y0, self.y1, self.n, self.valid = x, y0, y1, 0, False

    def grow(self, x: float, y0: float, tol: float = 50) -> None:
        if abs(self.y0 - y0) <= tol + 1e-5 * abs(y0):
            self.x, self.y0, self.n = (self.n * self.x + x) / (self.n + 1), y0, self.n + 1
            self.valid = self.valid or self.n > 4


def text_edges(lines: list[tuple[float, float, float, float]]) -> dict[str, list[TextEdge]]:
    """Left, middle and right edges of text lines (x0, y0, x1, y1) from the top down."""
    edges: dict[str, list[TextEdge]] = {"left": [], "middle": [], "right": []}
    for x0, y0, x1, y1 in sorted(lines, key=lambda r: (-r[1], r[0])):
        for side, x in (("left", x0), ("middle", x0 + (x1 - x0) / 2), ("right", x1)):
            hit = next((e for e in edges[side] if abs(e.x - x) <= 0.5 + 1e-5 * abs(x)), None)
            if hit:
                hit.grow(x, y0)
            else:
                edges[side].append(TextEdge(x, y0, y1))
    return edges


def relevant_edges(edges: dict[str, list[TextEdge]]) -> tuple[str, list[TextEdge]]:
    """The side with most intersections of valid edges; left before right before middle on a tie."""
    total = {s: sum(e.n for e in edges[s] if e.valid) for s in ("left", "right", "middle")}
    best = max(total, key=lambda s: total[s])
    return best, [e for e in edges[best] if e.valid]


# cells


def merge_open_cells(cells: list[dict], before: str, after: str, lo: str, hi: str) -> tuple[list[dict], int]:
    """Neighbouring cells without an edge between them become one; a run that is never closed is dropped and counted."""
    out, run, dropped = [], [], 0
    for cell in cells:
        if cell[before] and run:
            dropped += len(run)
            run = []
        run.append(cell)
        if cell[after]:
            if run[0][before]:
                out.append({**run[0], hi: run[-1][hi], after: True})
            else:
                dropped += len(run)
            run = []
    return out, dropped + len(run)


def cliques(n: int, adjacent: set[tuple[int, int]]) -> list[list[int]]:
    """Maximal cliques of a graph, each in ascending order."""
    near = [{j for j in range(n) if (i, j) in adjacent or (j, i) in adjacent} for i in range(n)]
    out: list[list[int]] = []

    def grow(r: set[int], p: set[int], x: set[int]) -> None:
        if not p and not x:
            out.append(sorted(r))
            return
        pivot = max(p | x, key=lambda u: len(near[u] & p))
        for v in sorted(p - near[pivot]):
            grow(r | {v}, p & near[v], x & near[v])
            p = p - {v}
            x = x | {v}

    grow(set(), set(range(n)), set())
    return sorted(out)


def occupied_places(rows: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """Row, column, row span and column span of the cells of HTML rows, past the places that spans hold."""
    held, out = set(), []
    for r, row in enumerate(rows):
        col = 0
        for rs, cs in row:
            while (r, col) in held:
                col += 1
            out.append((r, col, rs, cs))
            held.update((r + i, col + j) for i in range(rs) for j in range(cs))
            col += cs
    return out


# groups side by side


def flat_groups(df: DataFrame, key: str, columns: list[str], f: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``f(offsets, *columns)`` on many groups at once: the rows of a group lie together, ordered by ``columns``.

    ``f`` returns ``of`` (each output row's group, by number) and the other columns of ``schema``, whose first is the key.
    Groups come as lists, so a side that is dealt by the key already is not shuffled again.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            rows = lists.flatten()
            out = f(offsets - offsets[0], *[rows.field(c).to_numpy(zero_copy_only=False) for c in columns])
            of = out.pop("of")
            yield pa.RecordBatch.from_pydict({key: batch.column(0).take(pa.array(of)), **{n: out[n] for n in names[1:]}}, schema=pa.schema([batch.schema.field(0), *[pa.field(n, kinds[n]) for n in names[1:]]]))

    kinds = {n: {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for n, x in zip(names, schema.split(","))}
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    return lists.mapInArrow(run, schema)


def by_size(offsets: np.ndarray, cells: int = 4_000_000) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of one size n, not empty, so many at a time that n * n of each are about ``cells`` at most."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == n)
        step = max(1, cells // (n * n))
        for at in range(0, len(own), step):
            yield own[at : at + step], n


def places_of_all(offsets: np.ndarray, row: np.ndarray, col_idx: np.ndarray, rs: np.ndarray, cs: np.ndarray) -> dict[str, np.ndarray]:
    """``occupied_places`` of many tables at once; cells come by row and column."""
    out = {n: np.zeros(len(row), np.int32) for n in ("r", "c")}
    for own, n in by_size(offsets):
        at = offsets[own][:, None] + np.arange(n)
        y, h, w = row[at], rs[at].astype(np.int64), cs[at].astype(np.int64)
        new = np.column_stack([np.zeros(len(own), bool), y[:, 1:] != y[:, :-1]])
        r = np.cumsum(new, axis=1)
        until = np.zeros((len(own), 16), np.int64)  # the row from which a column is free
        col, every, used = np.zeros(len(own), np.int64), np.arange(len(own)), 0
        for i in range(n):
            col[new[:, i]] = 0
            if (need := max(used, int(col.max())) + int(w[:, i].max()) + 1) > until.shape[1]:
                until = np.column_stack([until, np.zeros((len(own), need), np.int64)])
            col = ((until <= r[:, i, None]) & (np.arange(until.shape[1]) >= col[:, None])).argmax(axis=1)
            out["r"][at[:, i]], out["c"][at[:, i]] = r[:, i], col
            for j in range(int(w[:, i].max())):
                k = every[w[:, i] > j]
                until[k, col[k] + j] = np.maximum(until[k, col[k] + j], r[k, i] + h[k, i])
            col = col + w[:, i]
            used = max(used, int(col.max()))
    return {"of": np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), **out, "rs": rs.astype(np.int32), "cs": cs.astype(np.int32)}


def columns_of_all(offsets: np.ndarray, seq: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> dict[str, np.ndarray]:
    """Maximal cliques of the boxes of each table that share an x range, by their mean middle.

    Where being near is transitive the cliques are its classes; only other tables are searched.
    """
    m = (x1.astype(float) + x2) / 2
    found: list[tuple[np.ndarray, ...]] = []
    for own, n in by_size(offsets):
        at = offsets[own][:, None] + np.arange(n)
        mid, lo, hi = m[at], x1[at], x2[at]
        near = (lo[:, None, :] < mid[:, :, None]) & (mid[:, :, None] < hi[:, None, :])
        near |= near.transpose(0, 2, 1)
        near |= np.eye(n, dtype=bool)
        head = near.argmax(axis=2)  # the first box that is near
        plain = (near == (head[:, :, None] == head[:, None, :])).all(axis=(1, 2))
        if plain.any():
            g, key = own[plain], at[plain]
            first = head[plain] + np.arange(len(g))[:, None] * n
            count = np.bincount(first.ravel(), minlength=len(g) * n)
            total = np.bincount(first.ravel(), weights=mid[plain].ravel(), minlength=len(g) * n)
            k = np.flatnonzero(count)
            found.append((g[k // n], total[k] / count[k], k % n, count[k], seq[key.ravel()[k]]))
        for g, a, one in zip(own[~plain].tolist(), at[~plain], near[~plain]):
            i, j = np.nonzero(one)
            for place, q in enumerate(cliques(n, {(x, y) for x, y in zip(i.tolist(), j.tolist()) if x != y})):
                found.append(tuple(np.array([v]) for v in (g, float(np.mean(m[a][q])), place, len(q), seq[a[q[0]]])))
    of, mean, place, count, first = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
    o = np.lexsort((place, mean, of))
    of = of[o]
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
    col = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    return {"of": of, "col": col.astype(np.int32), "n": count[o].astype(np.int32), "first_seq": first[o].astype(np.int64)}


def edges_of_all(offsets: np.ndarray, seq: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, tol: float = 50) -> dict[str, np.ndarray]:
    """Side, number and touches of the relevant edges of each table: ``text_edges`` line by line in all tables of one size."""
    groups = len(offsets) - 1
    side, count, touches = np.full(groups, "left", object), np.zeros(groups, np.int32), np.zeros(groups, np.int32)
    x0, y0, x1 = (v.astype(float) for v in (x0, y0, x1))
    o = np.lexsort((np.arange(len(x0)), x0, -y0, np.repeat(np.arange(groups), np.diff(offsets))))
    x0, y0, x1 = x0[o], y0[o], x1[o]
    for own, n in by_size(offsets):
        at, every = offsets[own][:, None] + np.arange(n), np.arange(len(own))
        most = None
        for name, x in (("left", x0[at]), ("right", x1[at]), ("middle", (x0 + (x1 - x0) / 2)[at])):
            ex, ey = np.full((len(own), n), np.inf), np.zeros((len(own), n))
            en, valid, used = np.zeros((len(own), n), np.int64), np.zeros((len(own), n), bool), np.zeros(len(own), np.int64)
            for i in range(n):
                v, y = x[:, i], y0[at[:, i]]
                top = int(used.max())
                hit = abs(ex[:, :top] - v[:, None]) <= (0.5 + 1e-5 * abs(v))[:, None]
                w = hit.argmax(axis=1) if top else used
                old = hit[every, w] if top else np.zeros(len(own), bool)
                a = every[old]
                b = w[old]
                ok = abs(ey[a, b] - y[a]) <= tol + 1e-5 * abs(y[a])
                a, b = a[ok], b[ok]
                ex[a, b] = (en[a, b] * ex[a, b] + v[a]) / (en[a, b] + 1)
                ey[a, b] = y[a]
                en[a, b] += 1
                valid[a, b] |= en[a, b] > 4
                a = every[~old]
                ex[a, used[a]], ey[a, used[a]] = v[a], y[a]
                used[a] += 1
            total, number = (en * valid).sum(axis=1), valid.sum(axis=1)
            better = total > most if most is not None else np.ones(len(own), bool)
            most = total if most is None else np.maximum(most, total)
            side[own[better]] = name
            count[own[better]], touches[own[better]] = number[better], total[better]
    keep = np.flatnonzero(np.diff(offsets) > 0)
    return {"of": keep, "side": side[keep].tolist(), "n": count[keep], "touches": touches[keep]}


# tree edit distance


class Tree:
    __slots__ = ("tag", "colspan", "rowspan", "content", "kids")

    def __init__(self, tag: str, colspan: int = 1, rowspan: int = 1, content: list[str] | None = None):
        self.tag, self.colspan, self.rowspan, self.content, self.kids = tag, colspan, rowspan, content or [], []


class Markup(HTMLParser):
    """Reads any markup: unknown declarations count as comments."""

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)


class TableParser(Markup):
    """Tree of the first table; a cell keeps its content as characters and tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: Tree | None = None
        self.stack: list[Tree] = []
        self.cell: Tree | None = None

    def handle_starttag(self, tag, attrs):
        if self.cell is not None:
            self.cell.content.append(f"<{tag}>")
            return
        if tag in ("table", "thead", "tbody", "tr", "td", "th"):
            a = dict(attrs)
            num = lambda k: int(a[k]) if (a.get(k) or "").isdecimal() else 1
            node = Tree(tag, num("colspan"), num("rowspan"))
            if self.stack:
                self.stack[-1].kids.append(node)
            elif self.root is None:
                self.root = node
            self.stack.append(node)
            if tag in ("td", "th"):
                self.cell = node

    def handle_endtag(self, tag):
        if self.cell is not None and tag not in ("td", "th"):
            self.cell.content.append(f"</{tag}>")
            return
        if any(n.tag == tag for n in self.stack):
            while self.stack and self.stack.pop().tag != tag:
                pass
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.content.extend(data)


def table_tree(html: str) -> Tree | None:
    p = TableParser()
    p.feed(html or "")
    return p.root


def levenshtein(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def rename_cost(a: Tree, b: Tree, structure_only: bool = False) -> float:
    """1 for another tag or other spans, else the share of the contents that differs."""
    if (a.tag, a.colspan, a.rowspan) != (b.tag, b.colspan, b.rowspan):
        return 1.0
    if a.tag == "td" and not structure_only and (a.content or b.content):
        return levenshtein(a.content, b.content) / max(len(a.content), len(b.content))
    return 0.0


def tree_distance(a: Tree, b: Tree, cost: Callable[[Tree, Tree], float]) -> float:
    """Edit distance of ordered trees by key roots."""

    def flat(t):
        # each node after its children, with the place of its first leaf
        nodes, first, stack = [], [], [(t, None)]
        while stack:
            n, begin = stack.pop()
            if begin is None and n.kids:
                stack.append((n, len(nodes)))
                stack.extend((kid, None) for kid in reversed(n.kids))
            else:
                nodes.append(n)
                first.append(len(nodes) - 1 if begin is None else begin)
        return nodes, first, sorted({f: i for i, f in enumerate(first)}.values())

    (na, fa, ka), (nb, fb, kb) = flat(a), flat(b)
    d = [[0.0] * len(nb) for _ in na]
    costs = [[cost(x, y) for y in nb] for x in na]
    for i in ka:
        for j in kb:
            m, n, oi, oj = i - fa[i] + 2, j - fb[j] + 2, fa[i], fb[j]
            f = [[float(y) for y in range(n)]]
            for x in range(1, m):
                u = oi + x - 1
                above, row, whole, du, cu = f[-1], [float(x)], fa[u] == oi, d[u], costs[u]
                back = f[fa[u] - oi]
                for y in range(1, n):
                    v = oj + y - 1
                    least = min(above[y], row[y - 1]) + 1
                    if whole and fb[v] == oj:
                        best = min(least, above[y - 1] + cu[v])
                        du[v] = best
                    else:
                        best = min(least, back[fb[v] - oj] + du[v])
                    row.append(best)
                f.append(row)
    return d[-1][-1]


def _in_order(t: Tree) -> Iterator[tuple[Tree, int]]:
    """Nodes with their depths, each before its children."""
    stack = [(t, 0)]
    while stack:
        n, depth = stack.pop()
        yield n, depth
        stack.extend((kid, depth + 1) for kid in reversed(n.kids))


def count_nodes(t: Tree) -> int:
    return sum(1 for _ in _in_order(t))


def _shape(t: Tree) -> list[tuple]:
    return [(depth, n.tag, n.colspan, n.rowspan) for n, depth in _in_order(t)]


def teds(pred: str, true: str, structure_only: bool = False) -> float:
    """Similarity of two tables from the tree edit distance; 0 if either is none."""
    a, b = table_tree(pred), table_tree(true)
    if a is None or b is None:
        return 0.0
    if pred == true or structure_only and _shape(a) == _shape(b):
        return 1.0
    return 1.0 - tree_distance(a, b, lambda x, y: rename_cost(x, y, structure_only)) / max(count_nodes(a), count_nodes(b))


_PLAIN = re.compile("<table>(?:<tr>(?:<td>[^<>&]*</td>)+</tr>)+</table>")


def _plain_rows(html: str) -> list[list[str]] | None:
    """Contents of the cells of a table of plain rows; None of any other markup."""
    if not html or not _PLAIN.fullmatch(html):
        return None
    return [r.split("</td><td>") for r in html[15:-18].split("</td></tr><tr><td>")]


def teds_both(pred: str, true: str) -> tuple[float, float]:
    """``teds`` with and without the contents.

    In plain tables of one shape each changed cell costs 1 at most.  It costs 1 at least, whatever it is compared with,
    if it shares no character with any cell of the other table; then the distance is the number of these.
    """
    a, b = _plain_rows(pred), _plain_rows(true)
    if a is None or b is None or list(map(len, a)) != list(map(len, b)):
        return teds(pred, true), teds(pred, true, True)
    changed = [y for u, v in zip(a, b) if u != v for x, y in zip(u, v) if x != y]
    if changed and not (all(changed) and set(pred[15:-18]).difference("<>/tdr").isdisjoint("".join(changed)) and not set("tdr/").intersection("".join(changed))):
        return teds(pred, true), 1.0
    return 1.0 - len(changed) / (1 + len(a) + sum(map(len, a))), 1.0


def bracket(t: Tree) -> str:
    out, depth = [], 0
    for n, d in _in_order(t):
        own = f'"tag": {n.tag}, "colspan": {n.colspan}, "rowspan": {n.rowspan}, "text": {n.content}' if n.tag == "td" else f'"tag": {n.tag}'
        out.append("}" * (depth - d) + "{" + own)
        depth = d + 1
    return "".join(out) + "}" * depth


# text


def diff_codes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    return difflib.SequenceMatcher(None, a, b).get_opcodes()


def digits_to_chinese(n: int) -> str:
    """Integer below 10^8 as a numeral."""
    digits, units = "零一二三四五六七八九", ("", "十", "百", "千")
    if n < 0:
        return "负" + digits_to_chinese(-n)
    if n >= 10_000:
        high, low = divmod(n, 10_000)
        return digits_to_chinese(high) + "万" + (("零" if low < 1000 else "") + digits_to_chinese(low) if low else "")
    out, zero = "", False
    for i, ch in enumerate(str(n)):
        u = len(str(n)) - 1 - i
        if ch == "0":
            zero = bool(out)
        else:
            out += ("零" if zero else "") + digits[int(ch)] + units[u]
            zero = False
    out = out or "零"
    return out[1:] if out.startswith("一十") else out


class _Text(Markup):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(html: str) -> str:
    """All text of markup but that of scripts and styles."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "".join(p.out)


def mark_cells(html: str, places: set[tuple[int, int]]) -> str:
    """Table HTML with a background on the cells at (row, column) places."""
    out, r, k, at = [], -1, -1, 0
    low = html.lower()
    while at < len(html):
        nxt = low.find("<t", at)
        if nxt < 0:
            break
        out.append(html[at:nxt])
        if low.startswith("<tr", nxt):
            r, k = r + 1, -1
        elif low.startswith("<td", nxt):
            k += 1
            if (r, k) in places:
                out.append('<td style="background-color:yellow"')
                at = nxt + 3
                continue
        out.append(html[nxt : nxt + 2])
        at = nxt + 2
    return "".join(out) + html[at:]
