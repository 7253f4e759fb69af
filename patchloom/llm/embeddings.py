"""Near-duplicate embeddings by an epsilon grid order join.

A cosine of at least c between unit vectors is a distance of at most eps = sqrt(2 - 2 c). Vectors are sorted by their
grid cells, eps wide, on the leading principal dimensions, and the sequence is cut into intervals. Intervals whose boxes
on these dimensions are provably farther apart than eps are skipped; the others are joined recursively, halving the
longer one and skipping again, down to products of matrices. Single precision rules pairs out and in with a margin, and
what is left is decided in double precision.

An interval is sent to each of its partners once, in blocks, and several partners are joined by one task, so what is
moved is one interval for each pair of intervals that can't be skipped. Where no two intervals are provably apart, as
with vectors that are spread evenly in all directions, that is a constant small part of the square of the rows.

Identical vectors are one class with one representative and a count, so copies are never compared. A task hands on sums
of links by vector and a forest of its links, never the pairs. Null vectors, vectors with null or non-finite components
and zero vectors link with nothing; so do vectors of different lengths with each other. Rows with a null vec_id link
with nothing and have no component. Repeated rows are vectors of their own that share an id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Stash
from .graph import UnionFind, components

LEADING = 4  # principal dimensions of the grid
BOXED = 12  # principal dimensions of the boxes
MARGIN = 1e-4  # by which single precision may be wrong
BLOCK = 1 << 16  # components in a block, the unit that is moved
BLOCKS = 8  # blocks of an interval
PARTNERS = 4  # partners of an interval that one task joins with it


def checked(vectors: DataFrame, dtype: str) -> DataFrame:
    """vec_id, d1, d2 (digest), x (the components' bytes; null if nothing can be near it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, xs = b.column(1), []
            there = col.is_valid().to_pylist()
            flat = col.values.to_numpy(zero_copy_only=False) if len(col) else np.zeros(0)
            ends = col.offsets.to_numpy() if len(col) else np.zeros(1, int)
            for i in range(len(col)):
                x = flat[ends[i] : ends[i + 1]].astype(dtype) if there[i] else np.zeros(0, dtype)
                xs.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            digest = [x and xxhash.xxh3_128_digest(x) for x in xs]
            halves = [pa.array([d and int.from_bytes(d[i : i + 8], "little", signed=True) for d in digest], pa.int64()) for i in (0, 8)]
            yield pa.RecordBatch.from_arrays([b.column(0), *halves, pa.array(xs, pa.binary())], ["vec_id", "d1", "d2", "x"])

    kind = "float" if dtype == "float32" else "double"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).mapInArrow(run, "vec_id long, d1 long, d2 long, x binary")


def matrix(rows: list[bytes], width: int, dtype: str) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype)
    for i, x in enumerate(rows):
        own = np.frombuffer(x, dtype)
        out[i, : len(own)] = own
    return out


def unit(x: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Unit vectors; each is scaled by its largest component first, so no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(dtype, copy=False)


def principal(reps: DataFrame, n: int, width: int, dtype: str, fit_rows: int = 20_000) -> np.ndarray:
    """Leading principal directions (width x BOXED) of about fit_rows vectors, chosen by a hash; they only steer pruning."""
    share = min(1.0, fit_rows / max(1, n))
    chosen = reps if share == 1 else reps.where(F.shiftrightunsigned(F.xxhash64("rep"), 33) < int(share * (1 << 31)))
    rows = chosen.select("x").toArrow()["x"].to_pylist()
    x = unit(matrix(rows, width, dtype)) if rows else np.zeros((0, width))
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(width, width) if len(x) > 1 else np.eye(width))
    return vectors[:, ::-1][:, :BOXED]


def intervals(reps: DataFrame, n: int, axes: np.ndarray, width: int, dtype: str, eps: float, size: int, stash: Stash) -> DataFrame:
    """Blocks of the grid order, `size` vectors or fewer, with their interval: interval, block, lo, hi (box), ids, counts, dims, x.

    A block's interval follows from its place in the whole order, not from the partition that it is in."""
    grid = axes[:, :LEADING]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = unit(matrix(b.column(2).to_pylist(), width, dtype)) @ grid if b.num_rows else np.zeros((0, grid.shape[1]))
            c = np.floor(p / eps).astype(np.int32)
            c = np.pad(c, ((0, 0), (0, LEADING - c.shape[1])))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v) for v in c.T)], ["rep", "n", "x", *order])

    order = [f"c{i}" for i in range(LEADING)]
    placed = reps.select("rep", "n", "x").mapInArrow(cells, "rep long, n long, x binary, " + ", ".join(f"{c} int" for c in order))
    dealt = stash.put(placed, "cells").repartitionByRange(max(1, n // (BLOCKS * size)), *order, "rep").sortWithinPartitions(*order, "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, []

        def out(rows: list) -> pa.RecordBatch:
            nonlocal at
            x = matrix([r[2] for r in rows], width, dtype)
            p = unit(x) @ axes
            long = lambda v: pa.array([np.array(v, np.int64).tobytes()])
            box = [pa.array([f(0).tolist()], pa.list_(pa.float64())) for f in (p.min, p.max)]
            at += len(rows)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at - len(rows)]), pa.array([at]), *box, long([r[0] for r in rows]), long([r[1] for r in rows]), long([len(r[2]) for r in rows]), pa.array([x.tobytes()])], ["part", "first", "end", "lo", "hi", "ids", "counts", "dims", "x"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if held:
            yield out(held)

    blocks = stash.put(dealt.mapInArrow(cut, "part long, first long, end long, lo array<double>, hi array<double>, ids binary, counts binary, dims binary, x binary"), "blocks")
    start, starts = 0, []  # one number for each partition, of which there is one for an interval's vectors
    for r in blocks.groupBy("part").agg(F.max("end").alias("n")).orderBy("part").collect():
        starts.append((r.part, start))
        start += r.n
    if not starts:
        return blocks.select(F.col("part").alias("interval"), F.col("first").alias("block"), "lo", "hi", "ids", "counts", "dims", "x")
    begins = blocks.sparkSession.createDataFrame(starts, "part long, start long")
    place = F.col("start") + F.col("first")
    return blocks.join(begins, "part").select(F.expr(f"(start + first) div {BLOCKS * size}").alias("interval"), place.alias("block"), "lo", "hi", "ids", "counts", "dims", "x")


def partners(blocks: DataFrame, around: int, eps: float) -> DataFrame:
    """Pairs of intervals that aren't provably apart: owner, partner, turn (which of the owner's tasks joins them).

    Pairs are dealt around the circle of all `around` intervals, so each owns about as many. A box may have fewer
    dimensions than BOXED; those that it lacks are null, which greatest() skips."""
    dims = list(range(BOXED))
    about = blocks.groupBy("interval").agg(*[F.min(F.get("lo", F.lit(i))).alias(f"l{i}") for i in dims], *[F.max(F.get("hi", F.lit(i))).alias(f"h{i}") for i in dims])
    first = lambda c: F.floor(F.col(c) / eps)
    cells = lambda lo, hi: F.explode(F.sequence(lo, hi))
    # intervals that are near share a cell of the first dimension or have neighbouring ones; salts spread the few cells
    left = about.withColumn("cell", cells(first("l0") - 1, first("h0") + 1)).withColumn("salt", F.pmod(F.col("interval"), F.lit(16)))
    right = about.withColumn("cell", cells(first("l0"), first("h0"))).withColumn("salt", F.explode(F.expr("sequence(0L, 15L)")))
    right = right.select("cell", "salt", F.col("interval").alias("other"), *[F.col(f"{s}{i}").alias(f"{s}{i}_b") for s in "lh" for i in dims])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"l{i}") - F.col(f"h{i}_b"), F.col(f"l{i}_b") - F.col(f"h{i}")), F.lit(2)) for i in dims), F.lit(0.0))
    pairs = left.join(right, ["cell", "salt"]).where((F.col("interval") <= F.col("other")) & (gap <= (eps + MARGIN) ** 2)).select("interval", "other").distinct()
    mine = 2 * (F.col("other") - F.col("interval")) <= around
    pairs = pairs.select(F.when(mine, F.col("interval")).otherwise(F.col("other")).alias("owner"), F.when(mine, F.col("other")).otherwise(F.col("interval")).alias("partner"))
    return pairs.withColumn("turn", F.expr(f"pmod(partner - owner, {around}) div {PARTNERS}"))


class Side:
    """An interval ready to be joined."""

    def __init__(self, blocks: list[dict], width: int, dtype: str, axes: np.ndarray):
        self.ids, self.counts, self.dims = (np.concatenate([np.frombuffer(b[c], np.int64) for b in blocks]) for c in ("ids", "counts", "dims"))
        self.raw = np.concatenate([np.frombuffer(b["x"], dtype).reshape(-1, width) for b in blocks])
        self.x = unit(self.raw, np.float32)
        self.p = self.x @ axes.astype(np.float32)
        self.alike = bool((self.dims == self.dims[0]).all())
        self.links = np.zeros(len(self.ids), np.int64)


def near_pairs(a: Side, b: Side, cosine: float, eps: float, leaf: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
    """Matrices of links between parts of two intervals, with where they begin; of an interval with itself, each pair once."""
    same = a is b
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        i, j, k, l = todo.pop()
        if same and i >= l:
            continue
        pa_, pb = a.p[i:j], b.p[k:l]
        gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
        if (gap * gap).sum() > (eps + MARGIN) ** 2:
            continue
        if max(j - i, l - k) > leaf:
            if j - i >= l - k:
                m = (i + j) // 2
                todo += [(i, m, k, l), (m, j, k, l)]
            else:
                m = (k + l) // 2
                todo += [(i, j, k, m), (i, j, m, l)]
            continue
        dot = a.x[i:j] @ b.x[k:l].T
        if dot.max() < cosine - MARGIN:
            continue
        linked = dot >= cosine + MARGIN
        r, c = np.nonzero((dot >= cosine - MARGIN) & ~linked)
        for at in range(0, len(r), 1 << 14):
            x, y = r[at : at + (1 << 14)], c[at : at + (1 << 14)]
            linked[x, y] = (unit(a.raw[i + x]) * unit(b.raw[k + y])).sum(1) >= cosine
        if not (a.alike and b.alike and a.dims[0] == b.dims[0]):
            linked &= a.dims[i:j, None] == b.dims[None, k:l]
        if same:
            linked &= np.arange(i, j)[:, None] < np.arange(k, l)[None, :]
        if linked.any():
            yield i, k, linked


def labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each row and column of a matrix of links: labels spread as minima until none changes."""
    n, m = linked.shape
    row, col, none = np.arange(n), n + np.arange(m), n + m
    while True:
        new_row = np.minimum(row, np.where(linked, col[None, :], none).min(1))
        new_col = np.minimum(col, np.where(linked, new_row[:, None], none).min(0))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, size: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept; one row for each row of vectors.

    size: vectors of a block; None derives it from their width."""
    spark = vectors.sparkSession
    stash = Stash(spark, "embeddings")
    dtype = "float32" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "float64"
    rows = stash.put(checked(vectors, dtype), "rows")
    reps = stash.put(rows.where("x is not null and vec_id is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x")), "reps")
    n, longest = reps.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    width = (longest or 8) // np.dtype(dtype).itemsize
    eps = math.sqrt(2 - 2 * cosine)
    axes = principal(reps, n, width, dtype)
    size = size or max(64, BLOCK // width)
    blocks = intervals(reps, n, axes, width, dtype, eps, size, stash)
    pairs = stash.put(partners(blocks.select("interval", "lo", "hi"), -(-n // (BLOCKS * size)), eps), "pairs")
    own = pairs.select("owner", "turn", F.col("owner").alias("interval"), F.lit(0).alias("kind")).distinct()
    sent = own.unionByName(pairs.where("owner <> partner").select("owner", "turn", F.col("partner").alias("interval"), F.lit(1).alias("kind")))
    dealt = sent.join(blocks.drop("lo", "hi"), "interval").repartition("owner", "turn").sortWithinPartitions("owner", "turn", "kind", "interval", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uf, own, key, held = UnionFind(), None, None, []

        def said(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        def join(a: Side, b: Side) -> None:
            for i, k, linked in near_pairs(a, b, cosine, eps):
                n, m = linked.shape
                ids = np.concatenate([a.ids[i : i + n], b.ids[k : k + m]])
                a.links[i : i + n] += linked @ b.counts[k : k + m]
                b.links[k : k + m] += a.counts[i : i + n] @ linked
                of = np.concatenate(labels(linked))
                apart = np.flatnonzero(of != np.arange(n + m))
                for x, y in zip(ids[apart].tolist(), ids[of[apart]].tolist(), strict=True):
                    uf.join(x, y)

        def over(side: Side) -> pa.RecordBatch:
            at = np.flatnonzero(side.links)
            return said(0, side.ids[at], side.links[at])

        def done() -> Iterator[pa.RecordBatch]:
            """Joins what is held, which is all of one interval for one task of its owner."""
            nonlocal own, uf
            if not held:
                return
            side = Side(held, width, dtype, axes)
            if key[2] == 0:  # the owner itself, which comes first
                if own is not None:
                    yield over(own)
                own = side
                if key[1] == 0:
                    join(own, own)
            else:
                join(own, side)
                yield over(side)
            if len(uf.up) > 500_000:
                yield said(1, *uf.edges())
                uf = UnionFind()

        for t in batches:
            for r in t.to_pylist():
                if key != (at := (r["owner"], r["turn"], r["kind"], r["interval"])):
                    yield from done()
                    key, held = at, []
                held.append(r)
        yield from done()
        if own is not None:
            yield over(own)
        yield said(1, *uf.edges())

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "32")  # a row holds a block
    try:
        found = stash.put(dealt.mapInArrow(run, "kind int, a long, b long"), "found")
    finally:
        spark.conf.set(limit, before)
    comp = components(found.where("kind = 1").select("a", "b"), stash)
    stash.keep(rows, reps, found, comp)
    comp = comp.withColumnRenamed("id", "rep")
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    about_reps = reps.select("d1", "d2", "rep", "n").join(links, "rep", "left").join(comp, "rep", "left")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("d1")).alias("d1"), "d2").join(about_reps, ["d1", "d2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "rep", "vec_id"))
    n_links = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
