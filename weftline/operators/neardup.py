"""Verified links between near-duplicate sets of runs, proposed by min-hash bands.

Two sets of similarity J meet in a cell with probability 1 - (1 - J^ROWS)^bands. Inside a cell the counts of the runs by group
are points of an R-tree; the sum of the coordinate minima bounds the number of shared runs, for two sets and for a set and a
node. What survives is verified on the runs. Large cells are cut into blocks that meet pairwise.

Two passes keep huge families of near-copies linear: the first links neighbours inside each cell only; the second considers
only points of different components. The runs are never broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.session import cut, spread

GROUPS, BANDS, ROWS, LEAF, BLOCK = 128, 128, 5, 32, 2048


class _Words:
    """64-bit hashes of words, remembered up to a fixed number."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs."""
    z = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        z = z * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(z)]
        z ^= z >> np.uint64(29)
    return np.unique(z)


def _coefficients(bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240601)
    n = bands * ROWS
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def band_keys(runs: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One 64-bit key per band from the min-hashes of a text."""
    h = (runs >> np.uint64(32)).astype(np.uint32) ^ runs.astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 256):  # in slices, so that a very long text needs no huge table
        z = h[i : i + 256, None] * a[None, :] + c[None, :]
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x85EBCA6B)
        np.minimum(low, z.min(axis=0), out=low)
    m = low.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(m), dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ m[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def point_of(runs: np.ndarray) -> tuple[bytes, int]:
    """The count vector, a byte a group, and what did not fit into the bytes."""
    v = np.bincount(((runs >> np.uint64(17)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return np.minimum(v, 255).astype(np.uint8).tobytes(), int(np.maximum(v - 255, 0).sum())


def _cells(bands: int = BANDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = _coefficients(bands)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = [band_keys(np.frombuffer(x.as_py(), np.uint64), a, c) for x in part.column(1)]
                if keys:
                    ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), bands)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys))], ["id", "cell"])

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(np.frombuffer(x.as_py(), np.uint64)) for x in b.column(1)]
        points = [point_of(x) for x in got]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([p for p, _ in points], pa.binary()), pa.array([o for _, o in points], pa.int64())], ["id", "size", "point", "over"])


class RTree:
    """Points of one cell (or two blocks of it), bulk-loaded by size and then by the fullest groups."""

    def __init__(self, v: np.ndarray, size: np.ndarray, over: np.ndarray) -> None:
        self.v, self.size, self.over = v, size, over
        # Sort-tile: slabs of similar size, inside them by the two groups that vary most.
        spread_of = v.astype(np.float32).var(axis=0)
        g1, g2 = np.argsort(-spread_of)[:2]
        slab = np.argsort(np.argsort(size, kind="stable"), kind="stable") // (LEAF * 8)
        self.order = np.lexsort((v[:, g2], v[:, g1], slab))
        starts = np.arange(0, len(v), LEAF)
        self.starts = starts
        self.top = np.maximum.reduceat(v[self.order], starts, axis=0)
        self.least = np.minimum.reduceat(size[self.order], starts)
        self.most_over = np.maximum.reduceat(over[self.order], starts)
        self.up = np.arange(0, len(starts), 8)
        self.up_top = np.maximum.reduceat(self.top, self.up, axis=0)
        self.up_least = np.minimum.reduceat(self.least, self.up)
        self.up_over = np.maximum.reduceat(self.most_over, self.up)

    def near(self, i: int, share: float) -> np.ndarray:
        """Points that may share enough runs with point i: at least `share` of both sizes together."""
        q, n, o = self.v[i], self.size[i], self.over[i]
        up = np.flatnonzero(np.minimum(q, self.up_top).sum(1, dtype=np.int64) + np.minimum(o, self.up_over) >= share * (n + self.up_least))
        if not len(up):
            return up
        leaves = (self.up[up][:, None] + np.arange(8)).ravel()
        leaves = leaves[leaves < len(self.starts)]
        leaves = leaves[np.minimum(q, self.top[leaves]).sum(1, dtype=np.int64) + np.minimum(o, self.most_over[leaves]) >= share * (n + self.least[leaves])]
        at = (self.starts[leaves][:, None] + np.arange(LEAF)).ravel()
        p = self.order[at[at < len(self.v)]]
        return p[np.minimum(q, self.v[p]).sum(1, dtype=np.int64) + np.minimum(o, self.over[p]) >= share * (n + self.size[p])]


def _bounded(v: np.ndarray, size: np.ndarray, over: np.ndarray, i: np.ndarray, j: np.ndarray, share: float) -> np.ndarray:
    keep = [np.zeros(0, bool)]
    for at in range(0, len(i), 65536):
        x, y = i[at : at + 65536], j[at : at + 65536]
        keep.append(np.minimum(v[x], v[y]).sum(1, dtype=np.int64) + np.minimum(over[x], over[y]) >= share * (size[x] + size[y]))
    return np.concatenate(keep)


def _search(share: float, chain: bool):
    """Candidate pairs from points sorted by (cell, block pair). chain: neighbours only, else all pairs of different components."""

    def pairs(group: np.ndarray, side: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray, v: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[starts[1:], len(group)]
        count = ends - starts
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if chain:
            i = np.arange(len(group) - 1)
            i = i[group[1:] == group[:-1]]
            left.append(i)
            right.append(i + 1)
        else:
            small = np.repeat(count <= 2 * LEAF, count)
            for d in range(1, min(int(count.max()), 2 * LEAF)):
                i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]) & (comp[d:] != comp[:-d]))
                left.append(i)
                right.append(i + d)
        i, j = np.concatenate(left), np.concatenate(right)
        ok = _bounded(v, size, over, i, j, share)
        left, right = [ids[i[ok]]], [ids[j[ok]]]
        if not chain:
            for s, e in zip(starts[count > 2 * LEAF], ends[count > 2 * LEAF]):
                if (comp[s:e] == comp[s]).all():
                    continue
                tree = RTree(v[s:e], size[s:e], over[s:e])
                for i in range(e - s):
                    p = tree.near(i, share)
                    # Blocks of two sides meet each other only; their inner pairs belong to another task.
                    p = p[(comp[s + p] != comp[s + i]) & (ids[s + p] > ids[s + i]) & ((side[s + p] != side[s + i]) | (side[s:e] == side[s]).all())]
                    left.append(np.full(len(p), ids[s + i]))
                    right.append(ids[s + p])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            group, side, ids, comp, size, over = (t.column(n).to_numpy() for n in ("task", "side", "id", "comp", "size", "over"))
            v = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint8).reshape(len(ids), GROUPS)
            i, j = pairs(group, side, ids, comp, size, v, over)
            lo, hi = np.minimum(i, j), np.maximum(i, j)
            u = np.unique(np.stack([lo, hi]), axis=1) if len(lo) else np.zeros((2, 0), np.int64)
            u = u[:, u[0] != u[1]]
            return pa.RecordBatch.from_arrays([pa.array(u[0], pa.int64()), pa.array(u[1], pa.int64())], ["a", "b"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < 50_000:
                continue
            t = pa.concat_tables(held)
            task = t.column("task").to_numpy()
            last = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if last:
                yield flush(t.slice(0, last))
            held, rows = [t.slice(last)], t.num_rows - last
        if rows:
            yield flush(pa.concat_tables(held))

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ra"), b.column("rb")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= threshold * (len(p) + len(q) - shared) and shared > 0)
            t = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield t

    return run


def _links(candidates: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    runs = texts.select("id", "runs")
    both = candidates.hint("merge").join(runs.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a")
    both = both.hint("merge").join(runs.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    return both.select("a", "b", "ra", "rb").mapInArrow(_verify(threshold), "a long, b long")


def _tasks(points: DataFrame) -> DataFrame:
    """Points by cell, cells of more than BLOCK points as pairs of blocks; `task` numbers the work, sorted inside partitions."""
    n = points.groupBy("cell").agg(F.count("*").alias("n")).where(f"n > {BLOCK}").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # Cells of more than BLOCK points number at most BANDS / BLOCK of the points.
    p = points.hint("merge").join(n, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    p = p.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = p.withColumn("task", F.xxhash64("cell", F.least("side", "other"), F.greatest("side", "other")))
    return p.select("task", "side", "id", "comp", "size", "point", "over").repartition("task").sortWithinPartitions("task", "id")


def near_links(texts: DataFrame, threshold: float = 0.5, bands: int = BANDS) -> DataFrame:
    """Links (a, b) between distinct texts that make the same components as all pairs of at least `threshold` similarity."""
    share = threshold / (1 + threshold)
    cells = cut(spread(texts).mapInArrow(_cells(bands), "id long, cell long"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1").select("cell")
    cells = cells.hint("merge").join(shared, "cell").distinct()
    vectors = texts.mapInArrow(_vectors, "id long, size long, point binary, over long")
    points = cut(cells.hint("merge").join(vectors, "id"))
    first = _tasks(points.withColumn("comp", F.col("id"))).mapInArrow(_search(share, True), "a long, b long").distinct()
    links = cut(_links(first, texts, threshold))
    comps = connected_components(links)
    known = points.hint("merge").join(comps.select("id", F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    second = _tasks(known).mapInArrow(_search(share, False), "a long, b long").distinct()
    return links.unionByName(cut(_links(second, texts, threshold)))
