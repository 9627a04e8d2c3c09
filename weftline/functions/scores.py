"""Scores of blocks of vectors in Arrow batches: which pairs can matter comes from a matrix product, which
do from exact scores.

The product adds up in another order than :mod:`.vectors` does, so it only rules out pairs that are off by
more than its rounding; all others are scored as there, to the last bit. Vectors with elements that are
not finite, or too large or small to be squared, are always scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .vectors import DISTANCES

#: Queries by candidates of one product, pairs that are scored at once, rows of a batch that goes out.
TILE, PAIRS, OUT = 2048, 65_536, 20_000
#: Elements beyond these, but 0, can't be squared and added.
LARGE, SMALL = 1e100, 1e-100
#: Kinds of a score, in their order: NaN comes first among similarities and last among distances, as in
#: Spark; pairs without a score follow, then what is no pair.
FIRST, PLAIN, LAST, NO_SCORE, NO_PAIR = range(5)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


class Side:
    """Vectors of equal length, with their numbers among all rows."""

    def __init__(self, rows: np.ndarray, x: np.ndarray):
        self.rows, self.x, self.width = rows, x, x.shape[1]
        with np.errstate(all="ignore"):
            self.norm, most = _lengths(x), np.abs(x).max(axis=1, initial=0.0)
            self.odd = ~((most == 0) | ((most >= SMALL) & (most <= LARGE)))

    def part(self, which: slice | list[int]) -> Side:
        out = object.__new__(Side)
        out.width = self.width
        for name in ("rows", "x", "norm", "odd"):
            setattr(out, name, getattr(self, name)[which])
        return out

    def folded(self, k: int) -> Side:
        """Only the first k of equal vectors: the others are never among the k closest."""
        seen, kept = Counter(), []
        for n, row in enumerate(self.x):
            seen[key := row.tobytes()] += 1
            if seen[key] <= k:
                kept.append(n)
        return self if len(kept) == len(self.x) else self.part(kept)

    def factor(self, metric: str, query: bool) -> np.ndarray:
        """Rows whose product with the other side's is larger the closer the vectors are; for distances it
        is the negative square less that of the query's length."""
        x = np.where(self.odd[:, None], 0.0, self.x)
        if metric == "cosine":
            return x / np.where(self.odd | (self.norm == 0), 1.0, self.norm)[:, None]
        if metric in DISTANCES:
            more = np.full(len(x), -1.0) if query else np.where(self.odd, 0.0, self.norm) ** 2
            return np.column_stack([2 * x if query else x, more])
        return x

    def slack(self, metric: str, other: Side) -> np.ndarray:
        """Twice what rounding can move the product of each query with any of the other side, at most."""
        most = other.norm[~other.odd].max(initial=0.0)
        own = np.where(self.odd, 0.0, self.norm)
        scale = {"cosine": 1.0, "dot": own * most}.get(metric, (own + most) ** 2)
        return 16 * (self.width + 8) * np.finfo(float).eps * scale


def sides(column: pa.Array | pa.ChunkedArray) -> dict[int, Side]:
    """The vectors of a list column by their length; those of null or with null elements are in none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.list_(pa.float64()))
    good = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten()
    if values.null_count:
        parents = pc.list_parent_indices(column).to_numpy()
        good[parents[values.is_null().to_numpy(zero_copy_only=False)]] = False
    widths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    out = {}
    for width in np.unique(widths[good]).tolist():
        rows = np.flatnonzero(good & (widths == width))
        kept = values if len(rows) == len(column) else column.take(pa.array(rows)).flatten()
        out[width] = Side(rows, kept.to_numpy(zero_copy_only=False).reshape(len(rows), width))
    return out


def exact(metric: str, q: Side, c: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of query i[n] and candidate j[n], added up from the first element on."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for a in range(0, len(i), PAIRS):
            m, n = i[a : a + PAIRS], j[a : a + PAIRS]
            x, y = q.x[m], c.x[n]
            if metric in DISTANCES:
                out[a : a + PAIRS] = _lengths(x - y)
                continue
            dot = np.cumsum(x * y, axis=1)[:, -1] + 0.0 if q.width else np.zeros(len(m))
            if metric == "cosine":
                nx, ny = q.norm[m], c.norm[n]
                dot = np.where((nx == 0) | (ny == 0), 0.0, dot / (nx * ny))
            out[a : a + PAIRS] = dot
    return out


def _reach(product: np.ndarray, least: np.ndarray, q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose product reaches the query's least value, and all pairs of odd vectors."""
    hit = product >= least[:, None]
    hit[q.odd] = True
    hit[:, c.odd] = True
    flat = np.flatnonzero(hit)
    return flat // hit.shape[1], flat % hit.shape[1]


def _table(queries: pa.ChunkedArray, held: pa.Table, i: np.ndarray, row: np.ndarray, score: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that go out: the query's id, the columns held of the candidate, the score."""
    for a in range(0, len(i), OUT):
        s = slice(a, a + OUT)
        columns = [queries.take(pa.array(i[s])), *held.take(pa.array(row[s])).columns, pa.chunked_array([pa.array(score[s], mask=~known[s])])]
        yield from pa.table(columns, names=["__query", *held.column_names, "__score"]).combine_chunks().to_batches()


def _cut(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.Table, dict[int, Side]]]:
    """Columns without the vector, and the vectors."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            yield rows.drop_columns([vector]), sides(rows[vector])


class Best:
    """The k closest candidates of every query so far; of equal scores those that came first."""

    def __init__(self, n: int, k: int, metric: str):
        self.k, self.metric, self.sign = k, metric, 1.0 if metric in DISTANCES else -1.0
        self.kind, self.score, self.at = np.full((n, k), NO_PAIR, np.int8), np.zeros((n, k)), np.full((n, k), -1, np.int64)

    def keys(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nan = np.isnan(score)
        return np.where(nan, LAST if self.sign > 0 else FIRST, PLAIN).astype(np.int8), np.where(nan, 0.0, self.sign * score)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """The closeness below which a score is surely none of the best."""
        kind, score = self.kind[rows, -1], self.score[rows, -1]
        return np.where(kind == PLAIN, -score * score if self.sign > 0 else score, np.where(kind < PLAIN, np.inf, -np.inf))

    def add(self, i: np.ndarray, kind: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """Pairs of query i; ``at`` is larger than all before."""
        key = np.where(kind == PLAIN, self.sign * score, 0.0)
        last, worst = self.kind[i, -1], np.where(self.kind[i, -1] == PLAIN, self.sign * self.score[i, -1], 0.0)
        better = (kind < last) | ((kind == last) & (key < worst))
        if not better.any():
            return
        i, kind, score, at = i[better], kind[better], score[better], at[better]
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, self.k), i])
        kind, score, at = (np.concatenate([getattr(self, n)[rows].ravel(), x]) for n, x in (("kind", kind), ("score", score), ("at", at)))
        order = np.lexsort((at, np.where(kind == PLAIN, self.sign * score, 0.0), kind, i))
        i = i[order]
        new = order[np.arange(len(i)) - np.searchsorted(i, i) < self.k]  # k entries of each query at least: those that it had
        for name, x in (("kind", kind), ("score", score), ("at", at)):
            getattr(self, name)[rows] = x[new].reshape(len(rows), self.k)

    def scan(self, q: Side, c: Side, start: int) -> None:
        """Adds what matters of all pairs of two sides."""
        for a in range(0, len(c.rows), TILE):
            cs = c.part(slice(a, a + TILE))
            right, plain = cs.factor(self.metric, False).T, int((~cs.odd).sum())
            for b in range(0, len(q.rows), TILE):
                qs = q.part(slice(b, b + TILE))
                product, slack = qs.factor(self.metric, True) @ right, qs.slack(self.metric, cs)
                least = self.least(qs.rows) - slack
                if self.metric in DISTANCES:
                    least = least + np.where(qs.odd, 0.0, qs.norm) ** 2
                new = np.flatnonzero(least == -np.inf)
                if len(new) and plain >= self.k:
                    here = product[new][:, ~cs.odd]
                    least[new] = np.partition(here, plain - self.k, axis=1)[:, plain - self.k] - (slack[new] if np.ndim(slack) else slack)
                i, j = _reach(product, least, qs, cs)
                if len(i):
                    score = exact(self.metric, qs, cs, i, j)
                    self.add(qs.rows[i], self.keys(score)[0], score, start + cs.rows[j])

    def without_score(self, q: np.ndarray, rows: np.ndarray, start: int) -> None:
        """Adds pairs that have no score, for queries that have fewer than k others."""
        q, rows = q[self.kind[q, -1] > NO_SCORE], rows[: self.k]
        if len(q) and len(rows):
            n = len(q) * len(rows)
            self.add(np.repeat(q, len(rows)), np.full(n, NO_SCORE, np.int8), np.zeros(n), start + np.tile(rows, len(q)))


def nearest(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int, metric: str, vector: str) -> Iterator[pa.RecordBatch]:
    """The k closest rows of all batches for each query."""
    n, by_width = queries.num_rows, sides(queries["query"])
    best, start, held, places = Best(n, k, metric), 0, None, np.empty(0, np.int64)
    others = np.setdiff1d(np.arange(n), np.concatenate([np.empty(0, np.int64), *[s.rows for s in by_width.values()]]))
    for rows, found in _cut(batches, vector):
        folded = {width: c.folded(k) for width, c in found.items() if width in by_width}
        for width, q in by_width.items():
            if width in found:
                best.scan(q, folded[width], start)
            best.without_score(q.rows, np.setdiff1d(np.arange(rows.num_rows), found[width].rows) if width in found else np.arange(min(k, rows.num_rows)), start)
        best.without_score(others, np.arange(min(k, rows.num_rows)), start)
        both = np.concatenate([places, start + np.arange(rows.num_rows)])
        needed = np.unique(best.at)
        needed = needed[needed >= 0]
        held = (pa.concat_tables([held, rows]) if held is not None else rows).take(pa.array(np.searchsorted(both, needed))).combine_chunks()
        places, start = needed, start + rows.num_rows
    if held is not None:
        i, rank = np.nonzero(best.kind < NO_PAIR)
        yield from _table(queries["query_id"], held, i, np.searchsorted(places, best.at[i, rank]), best.score[i, rank], best.kind[i, rank] < NO_SCORE)


def reaching(batches: Iterator[pa.RecordBatch], queries: pa.Table, threshold: float, metric: str, vector: str) -> Iterator[pa.RecordBatch]:
    """All pairs that reach the threshold."""
    by_width, near = sides(queries["query"]), metric in DISTANCES
    for rows, found in _cut(batches, vector):
        for width in by_width.keys() & found.keys():
            q, c = by_width[width], found[width]
            for a in range(0, len(c.rows), TILE):
                cs = c.part(slice(a, a + TILE))
                right = cs.factor(metric, False).T
                for b in range(0, len(q.rows), TILE):
                    qs = q.part(slice(b, b + TILE))
                    least = (np.where(qs.odd, 0.0, qs.norm) ** 2 - (threshold**2 if threshold >= 0 else -np.inf) if near else threshold) - qs.slack(metric, cs)
                    i, j = _reach(qs.factor(metric, True) @ right, np.broadcast_to(least, len(qs.rows)), qs, cs)
                    score = exact(metric, qs, cs, i, j)
                    good = score <= threshold if near else np.isnan(score) | (score >= threshold)
                    yield from _table(queries["query_id"], rows, qs.rows[i[good]], cs.rows[j[good]], score[good], np.ones(int(good.sum()), bool))
