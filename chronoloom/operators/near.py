"""The best items of many queries by cosine, compared in matrices inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and items that one matrix holds.
QUERIES, ITEMS = 1024, 4096


class Vectors:
    """Vectors of a list array by length: row numbers, values, lengths in double precision, unit vectors in single precision.

    Null, empty and zero vectors and those that hold a null are in none: their cosine is 0. ``odd`` marks those whose
    unit vector says nothing (not finite, or of extreme length); they are always compared exactly.
    """

    def __init__(self, arr: pa.Array):
        sizes = pc.list_value_length(arr).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = arr.flatten(), np.cumsum(sizes) - sizes
        fit = sizes > 0
        if flat.null_count:
            fit[np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
            flat = flat.fill_null(0)
        values = flat.to_numpy(zero_copy_only=False)
        self.size, self.at, self.parts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), {}
        for n in np.unique(sizes[fit]).tolist():
            rows = np.flatnonzero(fit & (sizes == n))
            own = values.reshape(-1, n) if len(rows) == len(sizes) else values[first[rows][:, None] + np.arange(n)]
            norms = np.concatenate([np.sqrt(np.cumsum(np.square(own[i : i + ITEMS], dtype=np.float64), axis=1)[:, -1]) for i in range(0, len(own), ITEMS)])
            live = norms != 0
            if not live.all():
                rows, own, norms = rows[live], own[live], norms[live]
            odd = ~((norms > 1e-150) & (norms < 1e150))
            units = np.empty(own.shape, np.float32)
            for i in range(0, len(own), ITEMS):
                with np.errstate(all="ignore"):
                    units[i : i + ITEMS] = own[i : i + ITEMS] / norms[i : i + ITEMS, None]
            units[odd] = 0
            self.parts[n] = (rows, own, norms, units, odd)
            self.size[rows], self.at[rows] = n, np.arange(len(rows))


def cosines(q: Vectors, x: Vectors, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision, each sum taken from first to last as in ``vector.cosine``; 0 for other lengths."""
    out = np.zeros(len(r))
    same = np.flatnonzero((q.size[r] == x.size[c]) & (q.size[r] > 0))
    for n in np.unique(q.size[r[same]]).tolist():
        pairs = same[q.size[r[same]] == n]
        (_, a, na, _, _), (_, b, nb, _, _) = q.parts[n], x.parts[n]
        step = max(1, (1 << 20) // n)
        for lo in range(0, len(pairs), step):
            some = pairs[lo : lo + step]
            i, j = q.at[r[some]], x.at[c[some]]
            with np.errstate(all="ignore"):
                dots = np.cumsum(a[i].astype(np.float64) * b[j], axis=1)[:, -1]
                scale = na[i] * nb[j]
                out[some] = np.where(scale == 0, 0.0, dots / scale)
    return out


class Block:
    """Queries of a block and the best items found for each so far; items come in order of id."""

    def __init__(self, limit: int, least: float):
        self.limit, self.least = limit, least
        self.waiting, self.q, self.ids, self.seen = [], None, [], 0
        self.row, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, queries: pa.RecordBatch, items: pa.RecordBatch) -> None:
        if len(queries):
            self.waiting.append(queries)
        if len(items) and self.waiting and self.q is None:
            whole = pa.Table.from_batches(self.waiting).combine_chunks()
            self.keys, self.q, self.waiting = whole["query"].combine_chunks(), Vectors(whole["embedding"].combine_chunks()), []
            self.bar = np.full(len(self.keys), -np.inf)
        for lo in range(0, len(items) if self.q else 0, ITEMS):
            self.meet(items.slice(lo, ITEMS))

    def meet(self, items: pa.RecordBatch) -> None:
        ids, x = items.column("uuid"), Vectors(items.column("embedding"))
        fresh = np.concatenate([[True], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)])
        run = np.cumsum(fresh) - 1
        begin = np.append(np.flatnonzero(fresh), len(ids))
        keys, heads = self.keys, ids.take(pa.array(begin[:-1]))
        if keys.type != heads.type:
            keys, heads = keys.cast(pa.string()), heads.cast(pa.string())
        own = pc.index_in(keys, value_set=heads).fill_null(-1).to_numpy(zero_copy_only=False)
        found = []
        for n in [0] if self.least <= 0 else sorted(self.q.parts.keys() & x.parts.keys()):
            rows = self.q.parts[n][0] if n else np.arange(len(keys))
            cols = x.parts[n][0] if n else np.arange(len(ids))
            if n:
                cols = cols[self.apart(x.parts[n][1], run[cols])]
            place = np.full(len(ids), -1)
            place[cols] = np.arange(len(cols))
            for lo in range(0, len(rows), QUERIES):
                found += self.pairs(x, n, rows[lo : lo + QUERIES], cols, place, own, begin)
        if found:
            r, c = (np.concatenate(z) for z in zip(*found, strict=True))
            score = cosines(self.q, x, r, c)
            good = ~(score < self.least)
            self.merge(r[good], c[good] + self.seen, score[good])
        self.ids.append(ids)
        self.seen += len(ids)

    def apart(self, values: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Of equal vectors, whose scores are equal, those of the first ids: as many as any query can list besides itself."""
        bits = np.ascontiguousarray(values).view(np.dtype((np.void, values.shape[1] * values.itemsize))).ravel()
        _, kind = np.unique(bits, return_inverse=True)
        if kind.max(initial=-1) + 1 == len(kind):
            return np.arange(len(kind))
        order = np.lexsort((np.arange(len(kind)), kind))
        k, u, at = kind[order], run[order], np.arange(len(kind))
        first = np.append(True, k[1:] != k[:-1])
        other = first | np.append(True, u[1:] != u[:-1])
        names = np.cumsum(other)
        before = names - names[np.maximum.accumulate(np.where(first, at, 0))]
        again = at - np.maximum.accumulate(np.where(other, at, 0))
        return np.sort(order[(before <= self.limit) & (again < self.limit)])

    def pairs(self, x: Vectors, n: int, rows: np.ndarray, cols: np.ndarray, place: np.ndarray, own: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may be among a query's best: by single precision, less what that can be wrong by."""
        odd = np.zeros((1, 1), bool)
        if n:
            s, odd, err = self.rough(x, n, rows, cols)
        else:
            s, odd, err = np.zeros((len(rows), len(cols)), np.float32), np.zeros((len(rows), len(cols)), bool), 0.0
            for m in self.q.parts.keys() & x.parts.keys():
                i, j = np.flatnonzero(self.q.size[rows] == m), np.flatnonzero(x.size[cols] == m)
                if len(i) and len(j):
                    part, strange, wrong = self.rough(x, m, rows[i], cols[j])
                    s[np.ix_(i, j)], err = part, max(err, wrong)
                    odd[np.ix_(i, j)] = strange
        mine = np.flatnonzero(own[rows] >= 0)
        lo, hi = begin[own[rows[mine]]], begin[own[rows[mine]] + 1]
        for k in range(int((hi - lo).max(initial=0))):
            at = np.where(lo + k < hi, place[np.minimum(lo + k, len(place) - 1)], -1)
            s[mine[at >= 0], at[at >= 0]] = -np.inf
            if odd.any():
                odd = np.broadcast_to(odd, s.shape).copy()
                odd[mine[at >= 0], at[at >= 0]] = False
        bar = (np.maximum(self.bar[rows], self.least) - err)[:, None]
        hit = np.greater_equal(s, np.nextafter(bar.astype(np.float32), np.float32(-np.inf)))
        if odd.any():
            hit |= odd
        at = np.flatnonzero(hit)
        if not len(at):
            return []
        r, c = np.divmod(at, len(cols))
        many = np.flatnonzero(np.bincount(r, minlength=len(rows)) > self.limit)
        if len(many) and len(cols) > self.limit:
            some = np.where(np.broadcast_to(odd, s.shape)[many], -np.inf, s[many]) if odd.any() else s[many]
            cut = np.full(len(rows), -np.inf)
            cut[many] = np.partition(some, len(cols) - self.limit, axis=1)[:, len(cols) - self.limit] - 2 * err - 1e-7
            kept = s[r, c] >= cut[r]
            if odd.any():
                kept |= np.broadcast_to(odd, s.shape)[r, c]
            r, c = r[kept], c[kept]
        taken = s[r, c] > -np.inf
        return [(rows[r[taken]], cols[c[taken]])]

    def rough(self, x: Vectors, n: int, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Cosines in single precision, which of them say nothing, and by how much the others can be wrong."""
        _, _, _, a, qo = self.q.parts[n]
        _, _, _, b, xo = x.parts[n]
        i, j = self.q.at[rows], x.at[cols]
        s = a[i] @ b[j].T
        odd = qo[i][:, None] | xo[j][None, :] if qo[i].any() or xo[j].any() else np.zeros((1, 1), bool)
        return s, odd, 2 * (n + 8) * 2.0**-24

    def merge(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        touched = np.zeros(len(self.bar), bool)
        touched[row] = True
        old = touched[self.row]
        row, place, score = np.append(self.row[old], row), np.append(self.place[old], place), np.append(self.score[old], score)
        worth = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((place, -worth, row))
        row, place, score, worth = row[order], place[order], score[order], worth[order]
        first = np.append(True, row[1:] != row[:-1])[: len(row)]
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
        last = rank == self.limit - 1
        self.bar[row[last]] = worth[last]
        top = rank < self.limit
        self.row, self.place, self.score = (np.append(a[~old], b[top]) for a, b in ((self.row, row), (self.place, place), (self.score, score)))

    def result(self) -> Iterator[pa.RecordBatch]:
        if len(self.row):
            ids = pa.concat_arrays(self.ids).take(pa.array(self.place))
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(self.row)), ids, pa.array(self.score)], names=["query", "uuid", "score"])


def best_of_blocks(batches: Iterator[pa.RecordBatch], limit: int, least: float) -> Iterator[pa.RecordBatch]:
    """(query, uuid, score) from rows (g, qb, b, side, query, uuid, embedding) in that order; each (g, qb, b) is a block, side 0 its queries."""
    key, block = None, Block(limit, least)
    for batch in batches:
        change = np.zeros(max(0, len(batch) - 1), bool)
        for name in ("g", "qb", "b"):
            col = batch.column(name)
            change |= pc.not_equal(col.slice(1), col.slice(0, max(0, len(col) - 1))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            now = tuple(part.column(n)[0].as_py() for n in ("g", "qb", "b"))
            if now != key:
                yield from block.result()
                key, block = now, Block(limit, least)
            ask = int((part.column("side").to_numpy(zero_copy_only=False) == 0).sum())
            block.add(part.slice(0, ask), part.slice(ask))
    yield from block.result()
