"""The k best documents of a block of queries by BM25, over postings in arrays; used inside the tasks of ``sparse``.

Tiles of queries meet chunks of documents. Terms that many of both have are multiplied as matrices, the others pair by pair,
in single precision; what may be among the k best is then scored in double precision, so that nothing is lost to rounding.
Alike queries and alike documents lie together, so that a tile whose scores a chunk can't improve passes it by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries of a tile and documents of a chunk.
TILE, CHUNK = 1024, 512
#: A pair of postings costs about as much as so many cells of a matrix product.
PAIR_COST = 500
#: Pairs expanded at once, and candidates of a tile kept before they are settled.
PAIRS, PENDING = 500_000, 1_000_000
#: Share of a score, and an amount, that single precision and rounding to six places may take from it; the share grows with
#: the terms summed.
SLACK, STEP = 1e-3, 2e-6
#: Groups of alike queries and documents, and terms and queries they are made from.
GROUPS, GROUP_TERMS, GROUP_QUERIES = 24, 1024, 4096


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] places, for all i after each other."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts, dtype=np.int64)
    kind = np.int32 if max(int(starts.max()) + int(counts.max()), int(ends[-1])) < 2**31 else np.int64
    return np.arange(ends[-1], dtype=kind) + np.repeat((starts - ends + counts).astype(kind), counts)


def pointers(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Groups:
    """Alike vectors: means of directions over the terms most common among the queries."""

    def __init__(self, owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, terms: int) -> None:
        kept = np.argsort(-np.bincount(code, minlength=terms), kind="stable")[:GROUP_TERMS]
        self.place = np.full(terms, -1, np.int64)
        self.place[kept] = np.arange(len(kept))
        few = owner < GROUP_QUERIES
        x = self._directions(owner[few], code[few], weight[few], min(n, GROUP_QUERIES))
        self.means = x[np.linspace(0, len(x) - 1, min(GROUPS, len(x))).astype(int)]
        for _ in range(6):
            mine = np.argmax(x @ self.means.T, axis=1)
            total = np.zeros_like(self.means)
            np.add.at(total, mine, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            self.means = np.where(size > 0, total / np.maximum(size, 1e-9), self.means)

    def _directions(self, owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        at = self.place[code]
        x = np.zeros((n, max(1, int((self.place >= 0).sum()))), np.float32)
        x[owner[at >= 0], at[at >= 0]] = weight[at >= 0]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def of(self, ptr: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ptr) - 1, np.int64)
        for a in range(0, len(out), GROUP_QUERIES):
            z = min(len(out), a + GROUP_QUERIES)
            s = slice(ptr[a], ptr[z])
            owner = np.repeat(np.arange(z - a), np.diff(ptr[a : z + 1]))
            out[a:z] = np.argmax(self._directions(owner, code[s], weight[s], z - a) @ self.means.T, axis=1)
        return out


def rows_in_order(ptr: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers and places of the entries when rows are taken in this order."""
    counts = np.diff(ptr)[order]
    return pointers(counts), spread(ptr[:-1][order], counts)


class Tile:
    """Some queries of a block: their entries by query and by term."""

    def __init__(self, first: int, ptr: np.ndarray, code: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.first, self.n = first, len(ptr) - 1
        self.ptr, self.code, self.weight = ptr - ptr[0], code, weight
        self.slack = SLACK + float(np.diff(ptr).max()) * 2.0**-23
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))
        order = np.argsort(code, kind="stable")
        self.who, self.w = owner[order], weight[order].astype(np.float32)
        self.count = np.bincount(code, minlength=terms).astype(np.int32)
        self.start = pointers(self.count)[:-1].astype(np.int32)


class Chunk:
    """Some documents: their postings by term, with the greatest part of each."""

    def __init__(self, first: int, ptr: np.ndarray, code: np.ndarray, part: np.ndarray) -> None:
        self.first, self.n = first, len(ptr) - 1
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.part = code[order], owner[order], part[order].astype(np.float32)
        self.terms, starts, self.count = np.unique(self.code, return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(self.part, starts) if len(starts) else self.part


def bounds(tile: Tile, chunk: Chunk) -> np.ndarray:
    """No document of the chunk scores higher for a query of the tile."""
    n = tile.count[chunk.terms]
    at = spread(tile.start[chunk.terms], n)
    return np.bincount(tile.who[at], tile.w[at] * np.repeat(chunk.most, n), minlength=tile.n)


def scores(tile: Tile, chunk: Chunk, live: np.ndarray) -> np.ndarray:
    """Scores in single precision of the queries that are live (places in the tile) with all documents of the chunk."""
    place = np.full(tile.n, -1, np.int32)
    place[live] = np.arange(len(live))
    n = tile.count[chunk.terms]
    heavy = n * chunk.count * PAIR_COST > tile.n * chunk.n
    h = np.flatnonzero(heavy)
    right = np.zeros((len(h), chunk.n), np.float32)
    of_heavy = np.repeat(heavy, chunk.count)
    right[np.repeat(np.arange(len(h)), chunk.count[h]), chunk.owner[of_heavy]] = chunk.part[of_heavy]
    at = spread(tile.start[chunk.terms[h]], n[h])
    who, row = place[tile.who[at]], np.repeat(np.arange(len(h)), n[h])
    kept = who >= 0
    left = np.zeros((len(h), len(live)), np.float32)
    left[row[kept], who[kept]] = tile.w[at[kept]]
    out = left.T @ right
    flat = out.reshape(-1)
    rest = np.flatnonzero(~of_heavy & (np.repeat(n, chunk.count) > 0))
    many = tile.count[chunk.code[rest]]
    edges = np.cumsum(many)
    a = 0
    while a < len(rest):
        z = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + PAIRS, "right")))
        mine, m = rest[a:z], many[a:z]
        at = spread(tile.start[chunk.code[mine]], m)
        who = place[tile.who[at]]
        cell, value = who * chunk.n + np.repeat(chunk.owner[mine], m), tile.w[at] * np.repeat(chunk.part[mine], m)
        if len(live) < tile.n:
            cell, value = cell[who >= 0], value[who >= 0]
        if len(cell) * 8 > len(flat):
            flat += np.bincount(cell, value, minlength=len(flat)).astype(np.float32)
        else:
            np.add.at(flat, cell, value)
        a = z
    return out


class Search:
    """The k best of every query of a block, (query, item, raw) by raw to six places, then by item, as documents come by."""

    def __init__(self, ptr: np.ndarray, code: np.ndarray, weight: np.ndarray, k: int, idf: np.ndarray) -> None:
        n, terms = len(ptr) - 1, len(idf)
        self.k, self.idf = k, idf
        self.groups = Groups(np.repeat(np.arange(n), np.diff(ptr)), code, weight, n, terms)
        self.order = np.lexsort((np.diff(ptr), self.groups.of(ptr, code, weight)))
        ptr, at = rows_in_order(ptr, self.order)
        code, weight = code[at], weight[at]
        self.tiles = [Tile(a, ptr[a : a + TILE + 1], code[ptr[a] : ptr[min(n, a + TILE)]], weight[ptr[a] : ptr[min(n, a + TILE)]], terms) for a in range(0, n, TILE)]
        self.least = np.zeros(n)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array] | None] = [None] * len(self.tiles)
        self.scratch = np.zeros(terms)

    def add(self, items: pa.Array, ptr: np.ndarray, code: np.ndarray, part: np.ndarray) -> None:
        """Documents: their items, and their postings with the part each has in a score of weight one."""
        order = np.lexsort((np.diff(ptr), self.groups.of(ptr, code, part * self.idf[code])))
        ptr, at = rows_in_order(ptr, order)
        code, part, items = code[at], part[at], items.take(pa.array(order))
        cuts = range(0, len(order), CHUNK)
        chunks = [Chunk(a, p := ptr[a : a + CHUNK + 1], code[p[0] : p[-1]], part[p[0] : p[-1]]) for a in cuts]
        for t, tile in enumerate(self.tiles):
            most = [bounds(tile, c) for c in chunks]
            self._tile(t, tile, [(chunks[i], most[i]) for i in np.argsort([-m.sum() for m in most], kind="stable")], items, ptr, code, part)

    def _tile(self, t: int, tile: Tile, chunks: list[tuple[Chunk, np.ndarray]], items: pa.Array, ptr: np.ndarray, code: np.ndarray, part: np.ndarray) -> None:
        least = self.least[tile.first : tile.first + tile.n]
        q, d, s, size, fresh = [], [], [], 0, 0
        for chunk, most in chunks:
            live = np.flatnonzero((most > 0) & (most * (1 + tile.slack) >= least))
            if not len(live):
                continue
            got = scores(tile, chunk, live)
            unset = np.flatnonzero(least[live] <= 0)
            if len(unset) and chunk.n > self.k:
                kth = np.partition(got[unset], chunk.n - self.k, axis=1)[:, chunk.n - self.k]
                least[live[unset]] = np.maximum(0, kth * (1 - tile.slack) - STEP)
            cell = np.flatnonzero((got >= np.maximum(least[live], 1e-30).astype(np.float32)[:, None]).reshape(-1))
            row, column = np.divmod(cell, chunk.n)
            q.append(live[row])
            d.append(column + chunk.first)
            s.append(got.reshape(-1)[cell])
            size, fresh = size + len(cell), fresh + len(cell)
            if fresh > 2 * self.k * tile.n:
                q, d, s = ([x] for x in self._pruned(tile, least, np.concatenate(q), np.concatenate(d), np.concatenate(s)))
                size, fresh = len(q[0]), 0
                if size > PENDING:
                    self._settle(t, tile, q[0], d[0], items, ptr, code, part)
                    q, d, s, size = [], [], [], 0
        if size:
            self._settle(t, tile, *self._pruned(tile, least, np.concatenate(q), np.concatenate(d), np.concatenate(s))[:2], items, ptr, code, part)

    def _pruned(self, tile: Tile, least: np.ndarray, q: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-s, q))
        q, d, s = q[order], d[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        full = np.diff(np.concatenate([first, [len(q)]])) >= self.k
        at = first[full]
        least[q[at]] = np.maximum(least[q[at]], s[at + self.k - 1] * (1 - tile.slack) - STEP)
        kept = s >= least[q].astype(np.float32)
        return q[kept], d[kept], s[kept]

    def _settle(self, t: int, tile: Tile, q: np.ndarray, d: np.ndarray, items: pa.Array, ptr: np.ndarray, code: np.ndarray, part: np.ndarray) -> None:
        """Scores candidates in double precision and keeps the k best with those found before."""
        order = np.argsort(q, kind="stable")
        q, d = q[order], d[order]
        raw = np.zeros(len(q))
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])), [len(q)]])
        w = self.scratch
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            own = slice(tile.ptr[q[a]], tile.ptr[q[a] + 1])
            w[tile.code[own]] = tile.weight[own]
            counts = ptr[d[a:z] + 1] - ptr[d[a:z]]
            at = spread(ptr[d[a:z]], counts)
            raw[a:z] = np.add.reduceat(w[code[at]] * part[at], np.cumsum(counts) - counts)  # no document is without postings
            w[tile.code[own]] = 0
        raw = np.round(raw, 6)
        item = items.take(pa.array(d))
        if self.found[t] is not None:
            q0, raw0, item0 = self.found[t]
            q, raw, item = np.concatenate([q0, q]), np.concatenate([raw0, raw]), pa.concat_arrays([item0, item])
        order = np.lexsort((pc.rank(item, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), -raw, q))
        order = order[raw[order] > 0]
        sizes = np.bincount(q[order], minlength=tile.n)
        starts = pointers(sizes)[:-1]
        order = order[np.arange(len(order)) - np.repeat(starts, sizes) < self.k]
        self.found[t] = q[order], raw[order], item.take(pa.array(order))
        full = np.flatnonzero(sizes >= self.k)
        least = self.least[tile.first : tile.first + tile.n]
        least[full] = np.maximum(least[full], raw[order][pointers(np.minimum(sizes, self.k))[full + 1] - 1] * (1 - tile.slack) - STEP)

    def results(self):  # noqa: ANN201
        """(query, raw, item) a tile; queries by their place in the block."""
        for tile, found in zip(self.tiles, self.found, strict=True):
            if found is not None:
                yield self.order[found[0] + tile.first], found[1], found[2]
