"""Connected components over an edge table: union-find in partitions, then star contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash

FLUSH = 500_000


class UnionFind:
    """Sets of integers; the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = [x for x in self.up if self.root(x) != x]
        return np.array(own, np.int64), np.array([self.root(x) for x in own], np.int64)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as (member, smallest member); memory is bounded by FLUSH links."""
    uf, n = UnionFind(), 0
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n += uf.join(u, v)
        if n >= FLUSH:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, uf.edges())), ["u", "v"])
            uf, n = UnionFind(), 0
    if n:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, uf.edges())), ["u", "v"])


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """links (a, b) of longs -> (id, component_id), one row for each id that has a link to another.

    Partition-local union-find first leaves a forest; then large-star and small-star rounds, each written to the
    shared folder, until nothing changes. All sums are partial aggregates, so a member with very many links is no
    hot key; joins on it are plain sort-merge joins, which adaptive execution can split."""
    edges = stash.put(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        out = stash.put(small, "edges")
        now = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stash.drop(edges)
        edges = out
        if now == before:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            out._stash_path = edges._stash_path
            return out
        before = now
