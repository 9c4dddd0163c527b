"""Low-dimensional pictures of vectors, one object at a time or over the whole pool."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.operators.select import lloyd, units


def pca_axes(df: DataFrame, dims: int, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, explained share) over all rows, from one distributed sum of outer products; each axis' largest loading is positive."""
    from pyspark.ml.feature import PCA

    rows = df.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("v"))
    mean = rows.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(rows)
    matrix: DenseMatrix = model.pc
    axes = matrix.toArray().T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, axes * signs[:, None], model.explainedVariance.toArray()


def pca(df: DataFrame, dims: int = 2, vec: str = "embedding") -> DataFrame:
    """df's object_id, pos and coords: rows less the mean, on the principal axes."""
    mean, axes, _ = pca_axes(df, dims, vec)
    on = [F.aggregate(F.zip_with(F.col(vec), F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x.cast("double") * a), F.lit(-float(mean @ axis)), lambda s, x: s + x) for axis in axes]
    return df.select("object_id", "pos", F.array(*on).alias("coords"))


#: Pairs are met in tiles of TILE x TILE; tiles of up to HELD pairs in all (400 MB) stay in memory, beyond that each round makes them anew.
TILE = 512
HELD = 3 << 25
#: Distances in a block of the neighbour search; rows up to which N x N is held in double precision; sources whose paths are found at once;
#: the side of a factor's tiles.
BLOCK = 1 << 22
WHOLE = 2048
SOURCES = 256
FACTOR = 1024


def _tiles(n: int) -> list[tuple[slice, slice]]:
    """Those on and above the diagonal, for what is symmetric."""
    cuts = [slice(i, min(i + TILE, n)) for i in range(0, n, TILE)]
    return [(i, j) for k, i in enumerate(cuts) for j in cuts[k:]]


def _kept(made: Callable[[slice, slice], np.ndarray], n: int) -> Callable[[int], np.ndarray]:
    """The k-th tile: held if all are few enough, else made anew each time."""
    tiles = _tiles(n)
    if n * (n + TILE) // 2 > HELD:
        return lambda k: made(*tiles[k])
    held = [made(i, j) for i, j in tiles]
    return held.__getitem__


def _precision(n: int) -> type:
    """Of single pairs; sums over pairs and the rows' places are doubles."""
    return np.float64 if n <= WHOLE else np.float32


def _squares(x: np.ndarray, i: slice, j: slice, room: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Squared distances of rows i from rows j of x, which has a row for each dimension, in out; room is overwritten."""
    for c, axis in enumerate(x):
        part = np.subtract(axis[i, None], axis[j], out=room if c else out)
        part *= part
        if c:
            out += part
    return out


def _rooms(i: slice, j: slice, dtype: type, held: dict) -> list[np.ndarray]:
    shape = i.stop - i.start, j.stop - j.start
    if shape not in held:
        held[shape] = [np.empty(shape, dtype) for _ in range(3)]
    return held[shape]


def smacof_start(distance: Callable[[slice, slice], np.ndarray], n: int, dims: int, start: int = 0, rounds: int = 300, seed: int = 0) -> tuple[np.ndarray, float]:
    """(coordinates, stress) of metric scaling by majorisation from one seeded start. distance(i, j) gives the distances of rows i
    from rows j, which are symmetric: memory is bounded by HELD, however many rows there are.

    A round divides each distance by the one that is drawn. Sums of their products are where the rows move, times where they are, so
    stress takes no pass of its own."""
    dtype, tiles, rooms = _precision(n), _tiles(n), {}
    x = np.random.default_rng([seed, start]).random((n, dims))
    want = _kept(lambda i, j: distance(i, j).astype(dtype, copy=False), n)
    whole = 0.0
    last = np.inf
    for r in range(rounds):
        moved, x = np.zeros_like(x), x - x.mean(axis=0)
        drawn = np.ascontiguousarray(x.T, dtype=dtype)
        ones = np.column_stack([x, np.ones(n)]).astype(dtype)
        for k, (i, j) in enumerate(tiles):
            far = want(k)
            if not r:
                flat = far.ravel()
                whole += float(np.dot(flat, flat)) * (0.5 if i == j else 1.0)  # a tile of the diagonal holds each pair twice
            room, d, b = _rooms(i, j, dtype, rooms)
            _squares(drawn, i, j, room, d)
            if i == j or d.min() <= 1e-24:
                d[d <= 1e-24] = np.inf  # rows at one place don't move one another
            np.divide(far, np.sqrt(d, out=d), out=b)
            to = (b @ ones[j]).astype(float)
            moved[i] += to[:, -1:] * x[i] - to[:, :-1]
            if i != j:
                to = (b.T @ ones[i]).astype(float)
                moved[j] += to[:, -1:] * x[j] - to[:, :-1]
        stress = max(whole + n * float(np.vdot(x, x)) - 2 * float(np.vdot(x, moved)), 0.0)
        if last - stress < 1e-6 * max(stress, 1e-12):
            break
        last = stress
        x = moved / n
    return x, last


def smacof(distance: Callable[[slice, slice], np.ndarray], n: int, dims: int, starts: int = 1, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """Metric scaling, the best of seeded starts."""
    tried = [smacof_start(distance, n, dims, s, rounds, seed) for s in range(starts)]
    return min(tried, key=lambda t: t[1])[0] if tried else np.zeros((n, dims))


def euclidean(x: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    x = x - x.mean(axis=0)
    square = np.square(x).sum(axis=1)

    def distance(i: slice, j: slice) -> np.ndarray:
        far = np.sqrt(np.clip(square[i, None] + square[None, j] - 2 * x[i] @ x[j].T, 0, None))
        if i == j:
            np.fill_diagonal(far, 0)
        return far

    return distance


def cosine(x: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    unit = units(x).astype(_precision(len(x)))
    return lambda i, j: np.clip(1 - unit[i] @ unit[j].T, 0, None)


def mds_euclidean(x: np.ndarray, dims: int) -> np.ndarray:
    return smacof(euclidean(x), len(x), dims)


#: Of the metric scaling of cosine distances.
STARTS = 4


def mds_cosine(x: np.ndarray, dims: int) -> np.ndarray:
    return smacof(cosine(x), len(x), dims, starts=STARTS)


def _graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's neighbours and how far they are."""
    return nearest(x, min(15, max(5, len(x) - 1), len(x) - 1))


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(N, k) places and distances of the rows nearest to each, itself left out, ties by place. Products in blocks find
    a few more than k, whose differences tell; memory is a block's."""
    n, k = len(x), min(k, len(x) - 1)
    x = x - x.mean(axis=0)
    square, few = np.square(x).sum(axis=1), min(k + 8, n - 1)
    near, far = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    step = max(1, BLOCK // max(n, few * x.shape[1]))
    for at in range(0, n, step):
        i = slice(at, min(at + step, n))
        d = square[i, None] + square[None] - 2 * x[i] @ x.T
        d[np.arange(len(d)), np.arange(i.start, i.stop)] = np.inf
        part = np.argpartition(d, few - 1, axis=1)[:, :few]
        true = np.linalg.norm(x[part] - x[i, None], axis=2)
        order = np.lexsort((part, true))[:, :k]
        near[i], far[i] = np.take_along_axis(part, order, axis=1), np.take_along_axis(true, order, axis=1)
    return near, far


def _room(shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """An array on disk, in a file that has no name and ends with the array."""
    with tempfile.TemporaryFile() as f:
        f.truncate(int(np.prod(shape)) * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype=dtype, mode="r+", shape=shape)


def _squared_paths(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """(N, N) squares of path lengths along edges to neighbours, either way; where there is no path, of the longest one.

    Rows are found in blocks of sources, by relaxing a node's edges for a whole block whenever a neighbour came closer.
    Paths to sources of earlier blocks are known from those. Beyond WHOLE rows the result is in single precision, on disk."""
    n, k = near.shape
    a, b, w = np.repeat(np.arange(n), k), near.ravel(), far.ravel()
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    edges = np.unique(a * n + b, return_index=True)[1]  # an edge that both ends chose is there twice
    a, b, w = a[edges], b[edges], w[edges][:, None]
    cuts = np.searchsorted(a, np.arange(n + 1))
    links = [(b[i:j], w[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    out = np.empty((n, n)) if n <= WHOLE else _room((n, n), np.float32)
    most, broken = 0.0, False
    for at in range(0, n, SOURCES):
        to = min(at + SOURCES, n)
        d = np.full((n, to - at), np.inf)
        d[:at] = out[:at, at:to]
        d[np.arange(at, to), np.arange(to - at)] = 0
        todo = np.arange(n) >= at
        way = 1
        while todo.any():
            for v in np.flatnonzero(todo)[::way]:
                todo[v] = False
                js, ws = links[v]
                got = (d[js] + ws).min(axis=0)
                if (got < d[v]).any():
                    np.minimum(d[v], got, out=d[v])
                    todo[js[js >= at]] = True
            way = -way
        ends = np.isfinite(d)
        most, broken = max(most, d.max(where=ends, initial=0.0)), broken or not ends.all()
        out[at:to] = d.T
    for at in range(0, n, SOURCES):
        part = out[at : at + SOURCES]
        if broken:
            part[~np.isfinite(part)] = most
        np.square(part, out=part)
    return out


def top_axes(times: Callable[[np.ndarray], np.ndarray], n: int, dims: int, floor: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their vectors of a symmetric operator that is given by its products, from a block Krylov
    space. The space grows until what is left is under 1e-8 of each value, or under floor of the largest."""
    rng, width = np.random.default_rng(seed), dims + 2
    q = np.linalg.qr(rng.normal(size=(n, width)))[0]
    basis, small = np.empty((n, 0)), np.empty((0, 0))
    while True:
        z = times(q)
        basis = np.column_stack([basis, q])
        m = basis.shape[1]
        side = basis.T @ z
        grown = np.zeros((m, m))
        grown[: len(small), : len(small)] = small
        grown[:, -q.shape[1] :], grown[-q.shape[1] :] = side, side.T
        small = grown
        z -= basis @ side
        z -= basis @ (basis.T @ z)
        if m + width > n or m // width % 4 == 0:
            values, turns = np.linalg.eigh((small + small.T) / 2)
            values, turns = values[::-1][:dims], turns[:, ::-1][:, :dims]
            left = np.linalg.norm(z @ turns[-q.shape[1] :], axis=0)
            if m + width > n or (left <= 1e-8 * np.abs(values) + floor * np.abs(values[0])).all():
                return values, basis @ turns
        gone = np.linalg.norm(z, axis=0) <= 1e-14 * max(np.abs(side).max(), 1e-300)
        z[:, gone] = rng.normal(size=(n, int(gone.sum())))  # a space that is closed goes on elsewhere
        for _ in range(2):
            z -= basis @ (basis.T @ z)
            z = np.linalg.qr(z)[0]
        q = z


def _upright(vectors: np.ndarray) -> np.ndarray:
    """Each vector's largest entry is positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def isomap(x: np.ndarray, dims: int) -> np.ndarray:
    """Classical scaling of path lengths over the nearest-neighbour graph."""
    n = len(x)
    square = _squared_paths(*_graph(x))
    if n <= WHOLE // 2:
        j = np.eye(n) - 1 / n
        values, vectors = np.linalg.eigh(-0.5 * j @ square @ j)
        values, vectors = values[::-1][:dims], vectors[:, ::-1][:, :dims]
    else:

        def times(q: np.ndarray) -> np.ndarray:
            q = q - q.mean(axis=0)
            z = np.concatenate([square[at : at + SOURCES].astype(float) @ q for at in range(0, n, SOURCES)])
            return -0.5 * (z - z.mean(axis=0))

        values, vectors = top_axes(times, n, dims, floor=1e-7)
    return _upright(vectors) * np.sqrt(np.maximum(values, 0))


def _weights(x: np.ndarray, near: np.ndarray, damp: float) -> np.ndarray:
    """(N, k): how neighbours add up to each row; a row's weights sum to one."""
    n, k = near.shape
    out = np.empty((n, k))
    step = max(1, BLOCK // (k * max(k, x.shape[1])))
    for at in range(0, n, step):
        z = x[near[at : at + step]] - x[at : at + step, None]
        c = z @ z.transpose(0, 2, 1)
        c += np.eye(k) * damp * np.maximum(np.trace(c, axis1=1, axis2=2), 1e-12)[:, None, None]
        w = np.linalg.solve(c, np.ones((len(c), k, 1)))[..., 0]
        out[at : at + step] = w / w.sum(axis=1, keepdims=True)
    return out


def _embedding_matrix(near: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value), by row and column, of (I - W)' (I - W), on and under the diagonal."""
    n = len(near)
    at, r = np.column_stack([np.arange(n), near]), np.column_stack([np.ones(n), -weights])
    row, column = (np.broadcast_to(p, (n, at.shape[1], at.shape[1])) for p in (at[:, :, None], at[:, None, :]))
    under = row >= column
    key, place = np.unique(row[under] * n + column[under], return_inverse=True)
    return key // n, key % n, np.bincount(place, (r[:, :, None] * r[:, None, :])[under])


class Solver:
    """Solves (M + shift I) y = b for a symmetric matrix of entries on and under the diagonal, by Cholesky's factor in tiles on disk."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, shift: float, side: int = 0):
        self.n, self.side = n, side or FACTOR
        t = self.side
        self.cuts = [slice(i, min(i + t, n)) for i in range(0, n, t)]
        many = len(self.cuts)
        self.tiles = _room((many * (many + 1) // 2, t, t), np.float64)
        self.some = np.zeros((many, many), dtype=bool)
        tile = (row // t) * many + column // t
        order = np.argsort(tile, kind="stable")
        ends = np.searchsorted(tile[order], np.arange(many * many + 1))
        for j in range(many):
            for i in range(j, many):
                mine = order[ends[i * many + j] : ends[i * many + j + 1]]
                full = np.zeros((t, t))
                full[row[mine] - i * t, column[mine] - j * t] = value[mine]
                both = [p for p in range(j) if self.some[i, p] and self.some[j, p]]
                if i > j and not len(mine) and not both:
                    continue
                if i == j:
                    full += np.tril(full, -1).T
                    full[np.arange(t), np.arange(t)] += np.where(np.arange(t) < n - i * t, shift, 1.0)
                for p in both:
                    full -= self._tile(i, p) @ self._tile(j, p).T
                if i == j:
                    full = np.linalg.cholesky(full)
                    turned = np.linalg.inv(full).T
                else:
                    full = full @ turned
                self._tile(i, j)[:] = full
                self.some[i, j] = True

    def _tile(self, i: int, j: int) -> np.ndarray:
        return self.tiles[i * (i + 1) // 2 + j]

    def __call__(self, b: np.ndarray) -> np.ndarray:
        y = b.astype(float)
        many = len(self.cuts)
        size = lambda i: self.cuts[i].stop - self.cuts[i].start
        for i in range(many):
            for p in range(i):
                if self.some[i, p]:
                    y[self.cuts[i]] -= self._tile(i, p)[: size(i)] @ y[self.cuts[p]]
            y[self.cuts[i]] = np.linalg.solve(self._tile(i, i)[: size(i), : size(i)], y[self.cuts[i]])
        for i in reversed(range(many)):
            y[self.cuts[i]] = np.linalg.solve(self._tile(i, i)[: size(i), : size(i)].T, y[self.cuts[i]])
            for p in range(i):
                if self.some[i, p]:
                    y[self.cuts[p]] -= self._tile(i, p)[: size(i)].T @ y[self.cuts[i]]
        return y


def locally_linear(x: np.ndarray, dims: int, damp: float = 1e-3) -> np.ndarray:
    """The flattest vectors, but the constant one, of what is left of rows after their neighbours' share."""
    n = len(x)
    near, _ = _graph(x)
    row, column, value = _embedding_matrix(near, _weights(x, near, damp))
    if n <= WHOLE // 2:
        m = np.zeros((n, n))
        m[row, column] = m[column, row] = value
        return _upright(np.linalg.eigh(m)[1][:, 1 : dims + 1])
    solve = None
    shift = 1e-10 * value[row == column].mean()
    while solve is None:
        try:
            solve = Solver(n, row, column, value, shift)
        except np.linalg.LinAlgError:  # rounding left it indefinite
            shift *= 100

    def times(q: np.ndarray) -> np.ndarray:
        z = solve(q - q.mean(axis=0))
        return z - z.mean(axis=0)

    return _upright(top_axes(times, n, dims, floor=1e-12)[1])


def _breadths(x: np.ndarray, square: np.ndarray, perplexity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, breadth, whole) of each row: exp(-(d - least) * breadth) / whole are its shares of the others at squared distances d,
    and their entropy is that of the perplexity, to 1e-5. All pairs, in blocks of rows. Where more rows than that are as near as
    the nearest, no breadth is enough; it ends where rounding of the distances would begin to tell rows apart."""
    n = len(x)
    aim = np.log(min(perplexity, n - 1))
    top = 1e10 / np.maximum(square, 1e-290)
    least, breadth, whole = np.empty(n), np.empty(n), np.empty(n)
    step = max(1, BLOCK // n)
    for at in range(0, n, step):
        i = slice(at, min(at + step, n))
        d = np.maximum(square[i, None] + square[None] - 2 * x[i] @ x.T, 0)
        d[np.arange(len(d)), np.arange(i.start, i.stop)] = np.inf
        least[i] = d.min(axis=1)
        d -= least[i, None]
        own = np.arange(i.start, i.stop) - i.start, np.arange(i.start, i.stop)
        d[own] = 0
        d = d.astype(_precision(n))
        todo, lo, hi, b = np.arange(len(d)), np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _ in range(100):
            part = d if len(todo) == len(d) else d[todo]
            w = np.exp(part * -b[todo, None].astype(part.dtype))
            w[np.arange(len(todo)), own[1][todo]] = 0
            z = np.maximum(w.sum(axis=1, dtype=float), 1e-12)
            w *= part
            mean = w.sum(axis=1, dtype=float) / z
            w *= part
            spread = w.sum(axis=1, dtype=float) / z - mean * mean
            whole[at + todo] = z
            off = np.log(z) + b[todo] * mean - aim
            lo[todo], hi[todo] = np.where(off > 0, b[todo], lo[todo]), np.where(off > 0, hi[todo], b[todo])
            going = (np.abs(off) >= 1e-5) & ((off < 0) | (b[todo] < top[at + todo]))
            if not going.any():
                break
            todo, off, slope = todo[going], off[going], (b[todo] * b[todo] * spread)[going]
            with np.errstate(all="ignore"):  # by Newton in log b, where that stays between the bounds
                newton = b[todo] * np.exp(off / slope)
                middle = np.where(np.isinf(hi[todo]), b[todo] * 2, (lo[todo] + hi[todo]) / 2)
                b[todo] = np.minimum(np.where((newton > lo[todo]) & (newton < hi[todo]) & (newton < 100 * b[todo]), newton, middle), top[at + todo])
        breadth[i] = b
    return least, breadth, whole


def tsne(x: np.ndarray, dims: int, rounds: int = 250, seed: int = 0) -> np.ndarray:
    """All pairs draw and push in each round, in tiles: memory is bounded by HELD, however many rows there are."""
    n = len(x)
    rounding = 1e-30 * np.square(x).sum(axis=1).max()
    x = x - x.mean(axis=0)
    square = np.maximum(np.square(x).sum(axis=1), rounding)
    least, breadth, whole = _breadths(x, square, min(30, max(5, n - 1)))
    dtype, tiles, rooms = _precision(n), _tiles(n), {}

    def shares(i: slice, j: slice) -> np.ndarray:
        d = np.maximum(square[i, None] + square[None, j] - 2 * x[i] @ x[j].T, 0)
        p = np.zeros(d.shape, dtype)
        for k, far, turned in ((i, d.T, True), (j, d, False)):  # differences of distances in double, their powers in the pairs' precision
            e = ((least[k] - far) * breadth[k]).astype(dtype)
            share = np.exp(np.minimum(e, 0, out=e), out=e)
            share *= (0.5 / n / whole[k]).astype(dtype)
            p += share.T if turned else share
        if i == j:
            np.fill_diagonal(p, 0)
        return np.maximum(p, 1e-12, out=p)

    p = _kept(shares, n)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, dims))
    step = np.zeros_like(y)
    for r in range(rounds):
        drawn = np.ascontiguousarray(y.T, dtype=dtype)
        ones = np.column_stack([y, np.ones(n)]).astype(dtype)
        pull, push, total = np.zeros_like(y), np.zeros_like(y), 0.0
        for k, (i, j) in enumerate(tiles):
            room, w, b = _rooms(i, j, dtype, rooms)
            _squares(drawn, i, j, room, w)
            w += 1
            np.divide(1, w, out=w)
            if i == j:
                np.fill_diagonal(w, 0)
            np.multiply(p(k), w, out=b)
            for force, by in ((pull, b), (push, np.multiply(w, w, out=room))):
                to = (by @ ones[j]).astype(float)
                force[i] += to[:, -1:] * y[i] - to[:, :-1]
                if i != j:
                    to = (by.T @ ones[i]).astype(float)
                    force[j] += to[:, -1:] * y[j] - to[:, :-1]
            total += float(w.sum(dtype=float)) * (1 if i == j else 2)
        slope = 4 * (pull * (12 if r < 100 else 1) - push / total)
        step = (0.5 if r < 20 else 0.8) * step - max(n / 48, 50) * slope
        y = y + step
    return y - y.mean(axis=0)


def discriminant(x: np.ndarray, labels: np.ndarray, dims: int) -> np.ndarray:
    """Linear discriminants; at most classes - 1 of them."""
    mean = x.mean(axis=0)
    within, between = np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1],) * 2)
    for c in np.unique(labels):
        part = x[labels == c]
        within += (part - part.mean(axis=0)).T @ (part - part.mean(axis=0))
        between += len(part) * np.outer(part.mean(axis=0) - mean, part.mean(axis=0) - mean)
    values, axes = np.linalg.eig(np.linalg.pinv(within + 1e-9 * np.eye(len(within))) @ between)
    order = np.argsort(-values.real)[: min(dims, len(np.unique(labels)) - 1)]
    return (x - mean) @ axes[:, order].real


METHODS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"mds": mds_euclidean, "mds_cosine": mds_cosine, "isomap": isomap, "lle": locally_linear, "tsne": tsne}


def by_object(pool: DataFrame, method: str, dims: int = 2, labels: str | None = None) -> DataFrame:
    """(object_id, pos, coords) of each object's rows; lda takes classes from the column `labels`. An object of one row stands at the origin.

    An object's memory is bounded; its time grows with N x N, and Isomap and LLE keep 4 N^2 bytes on disk: for pools of pictures, not of corpora."""
    if method not in METHODS and method != "lda":
        raise ValueError(f"unknown method {method!r}; known: {', '.join([*METHODS, 'lda'])}")
    if method == "lda" and labels is None:
        raise ValueError("lda needs labels")
    kind = pool.schema["object_id"].dataType.simpleString()
    rows = pool.select("object_id", "pos", "embedding", *([labels] if labels else []))
    if method == "mds_cosine":
        return _by_start(rows, kind, dims)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        if len(x) < 2:
            coords = np.zeros((len(x), dims))
        else:
            coords = discriminant(x, rows[labels].to_numpy(), dims) if method == "lda" else METHODS[method](x, dims)
        return pd.DataFrame({"object_id": rows["object_id"], "pos": rows["pos"], "coords": list(coords.tolist())})

    return dealt(rows, "object_id").groupBy("object_id").applyInPandas(run, f"object_id {kind}, pos bigint, coords array<double>")


def _by_start(rows: DataFrame, kind: str, dims: int) -> DataFrame:
    """Metric scaling of cosine distances, each start of each object in a task of its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows["start"].iloc[0])
        rows = rows.sort_values("pos")
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        coords, stress = smacof_start(cosine(x), len(x), dims, start) if len(x) > 1 else (np.zeros((len(x), dims)), 0.0)
        return pd.DataFrame({"object_id": rows["object_id"], "row": np.arange(len(x)), "pos": rows["pos"], "coords": list(coords.tolist()), "stress": stress, "start": start})

    each = dealt(rows.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS))))), "object_id", "start")
    tried = each.groupBy("object_id", "start").applyInPandas(run, f"object_id {kind}, row long, pos bigint, coords array<double>, stress double, start int")
    best = F.min_by(F.struct("pos", "coords"), F.struct("stress", "start")).alias("best")
    return tried.groupBy("object_id", "row").agg(best).select("object_id", "best.pos", "best.coords")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in partitions that stay apart: an object is little data and much work, and small partitions would be joined."""
    return df.repartition(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def best_labels(x: np.ndarray, k: int, starts: int = 10, seed: int = 0) -> np.ndarray:
    """k-means labels, the tightest of seeded starts; k is held between 2 and the rows (one row: label 0)."""
    n = len(x)
    if n < 2:
        return np.zeros(n, dtype=int)
    k = max(2, min(k or 2, n))
    best, least = np.zeros(n, dtype=int), np.inf
    for s in range(starts):
        rng = np.random.default_rng([seed, s])
        seeds = [int(rng.integers(n))]
        near = np.square(x - x[seeds[0]]).sum(axis=1)
        while len(seeds) < k:  # each next one by its distance from those before
            pick = int(rng.choice(n, p=near / near.sum())) if near.sum() > 0 else next(i for i in range(n) if i not in seeds)
            seeds.append(pick)
            near = np.minimum(near, np.square(x - x[pick]).sum(axis=1))
        labels, centers = lloyd(x, seeds)
        spread = np.square(x - centers[labels]).sum()
        if spread < least - 1e-12:
            best, least = labels, spread
    return best


def cluster_labels(pool: DataFrame, k: int) -> DataFrame:
    """(object_id, pos, cluster): visual clusters of each object's rows."""
    kind = pool.schema["object_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return pd.DataFrame({"object_id": rows["object_id"], "pos": rows["pos"], "cluster": best_labels(np.stack(rows["embedding"].to_numpy()).astype(float), k).astype(np.int32)})

    return pool.select("object_id", "pos", "embedding").groupBy("object_id").applyInPandas(run, f"object_id {kind}, pos bigint, cluster int")


def shown(n: int, columns: int, dims: int) -> bool:
    """Whether there is anything to draw: two rows at least, as many columns as dimensions, and more than three rows in 3-D."""
    return n >= 2 and columns >= dims and (dims < 3 or n > 3)
