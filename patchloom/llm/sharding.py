"""K-d tree sharding: weighted medians along the widest metadata dimension until leaves reach the target bytes.

Each document is a point of four dimensions: the logarithm of its size, its share of ASCII (script density), its language
and its source, both by the order of their first seven bytes; a missing column or value is the least. A node that stands
for m leaves is cut along its widest dimension, by its range there as a share of the whole table's, at the weight of its
first m // 2 leaves. Cuts are exact: weights by interval are summed in Spark, the interval that holds the cut is narrowed
again, and once it is one value the text's CRC-32 and then the doc_id break the tie. What reaches the driver is at most
one number for each node and interval, a constant.

Equal texts are one point: where their language or source differ, the least counts. If the cut falls among equal texts
that weigh no more than `together` of a leaf, they go to its nearer side as one; heavier groups are cut by doc_id, so a
text that fills a third of a table still gives shards of one size.

Law `bytes`: sizes near equal, apart from what the last document or group on a cut weighs. A null or empty text weighs the
fixed overhead; null doc_ids sort before all others; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

OVERHEAD = 16
BINS = 512
WIDTH = 1 << 32  # sizes and shares are scaled to 32 bits
DIMS = ("d_size", "d_script", "d_lang", "d_source")
LEAST_ID, MOST_ID = -(1 << 62), 1 << 62  # LEAST_ID stands for null


@dataclass
class Cut:
    """A cut in the making: rows below it go left, rows above it right."""

    node: int
    leaves: int
    dim: str
    goal: int
    keys: tuple  # values fixed so far of (dim, crc, id)
    lo: int = 0
    hi: int = 0
    before: int = 0  # weight below the interval
    weight: int = 0  # weight inside it, 0 before anything is known of it
    ranges: tuple = ()  # least and largest value of each key there

    def low_side_holds_it(self, total: int) -> bool:
        """Whether the row on the cut goes left: what brings the left side nearer its goal, but leaves no side empty."""
        after = self.before + self.weight
        if not self.before or after == total:
            return not self.before
        return after - self.goal <= self.goal - self.before


def _name(docs: DataFrame, column: str) -> Column:
    """The first seven bytes of a name as a number, which keeps their order; 0 for none."""
    if column not in docs.columns:
        return F.lit(0).cast("long")
    raw = F.substring(F.col(column).cast("string").cast("binary"), 1, 7)
    return F.coalesce(F.conv(F.rpad(F.hex(raw), 14, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))


def coordinates(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and d_crc, the dimensions and id_key (null first)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long")
    chars = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    crc = F.crc32(raw)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (size + OVERHEAD).alias("size"),
        crc.alias("text_crc32"),
        F.least(F.lit(WIDTH - 1), F.floor(F.log2(size + OVERHEAD) * (WIDTH // 40))).cast("long").alias("d_size"),
        F.when(size == 0, 0).otherwise(F.floor(chars / size * (WIDTH - 1))).cast("long").alias("d_script"),
        _name(docs, "lang").alias("d_lang"),
        _name(docs, "source").alias("d_source"),
        crc.alias("d_crc"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id_key"),
        F.xxhash64(raw).alias("text_hash"),
    )


def joined(rows: DataFrame) -> DataFrame:
    """Coordinates with the least language and source of all equal texts; only texts that differ in them are joined."""
    names, key = ("d_lang", "d_source"), ["text_hash", "size", "text_crc32"]
    same = rows.groupBy(*key).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)])
    differ = same.where(" or ".join(f"min_{c} < max_{c}" for c in names)).select(*key, *[f"min_{c}" for c in names])
    out = rows.join(differ, key, "left").withColumns({c: F.coalesce(f"min_{c}", c) for c in names})
    return out.select([c for c in rows.columns if c != "text_hash"])


def _fixed(rows: DataFrame, values: dict[int, tuple], kinds: str) -> DataFrame:
    """A table of constants by node, at most one row for each leaf of the tree: small enough to broadcast."""
    return F.broadcast(rows.sparkSession.createDataFrame([(k, *v) for k, v in values.items()], f"node long, {kinds}"))


def _dim(name: str) -> Column:
    return F.coalesce(*[F.when(F.col(name) == d, F.col(d)) for d in DIMS])


def _narrow(rows: DataFrame, cuts: list[Cut], stage: int) -> None:
    """Narrows each cut's interval of key number `stage` to the one value that the cut falls on.

    An interval shrinks to the values that are really there, so a few rounds do, and none where one value is left."""
    while open_cuts := [c for c in cuts if c.lo < c.hi or not c.weight]:
        node = {c.node: c for c in open_cuts}
        at = _fixed(rows, {c.node: (c.dim, *(c.keys + (0, 0))[:2], c.lo, c.hi, (c.hi - c.lo) // BINS + 1) for c in open_cuts}, "dim string, k0 long, k1 long, l long, h long, w long")
        x = rows.join(at, "node").withColumn("v0", _dim("dim"))
        for key, fixed in (("v0", "k0"), ("d_crc", "k1"))[:stage]:
            x = x.where(F.col(key) == F.col(fixed))
        key = F.col(("v0", "d_crc", "id_key")[stage])
        binned = x.where(key.between(F.col("l"), F.col("h"))).select("node", "size", key.alias("v"), "l", "w", F.struct("v0", "d_crc", "id_key").alias("keys"))
        got: dict[int, dict[int, tuple]] = {c.node: {} for c in open_cuts}
        ends = [f(f"keys.{k}") for k in ("v0", "d_crc", "id_key") for f in (F.min, F.max)]
        for r in binned.groupBy("node", F.expr("(v - l) div w").alias("b")).agg(F.sum("size").alias("s"), F.array(*ends).alias("ends")).collect():
            got[r.node][r.b] = r.s, r.ends
        for k, c in node.items():
            for b in sorted(got[k]):
                c.weight, ends = got[k][b]
                if c.before + c.weight >= c.goal:
                    break
                c.before += c.weight
            c.ranges = (ends[0:2], ends[2:4], ends[4:6])
            c.lo, c.hi = c.ranges[stage]


def assign(rows: DataFrame, leaves: int, together: float, stash: Stash) -> DataFrame:
    """rows with shard 0 .. leaves - 1; the tree is walked a level at a time, all nodes of a level at once."""
    tree = {0: (0, leaves)}  # node -> first leaf, leaves
    whole: dict[str, int] = {}  # each dimension's range over the whole table
    while any(n > 1 for _, n in tree.values()):
        split = [k for k, (_, n) in tree.items() if n > 1]
        about = rows.where(F.col("node").isin(split)).groupBy("node").agg(F.sum("size").alias("total"), *[f(d).alias(f"{d}_{f.__name__}") for d in DIMS for f in (F.min, F.max)]).collect()
        cuts = []
        for r in about:
            wide = {d: r[f"{d}_max"] - r[f"{d}_min"] for d in DIMS}
            whole = whole or wide
            dim = max(DIMS, key=lambda d: wide[d] / max(1, whole[d]))
            n = tree[r.node][1]
            cuts.append(Cut(r.node, n, dim, max(1, round(r.total * (n // 2) / n)), (), r[f"{dim}_min"], r[f"{dim}_max"]))
        total = {r.node: r.total for r in about}
        for stage in range(3):
            for c in cuts:
                if stage:
                    c.lo, c.hi = c.ranges[stage]
                if stage == 2 and c.lo < c.hi and c.weight * c.leaves <= together * total[c.node]:
                    c.lo = c.hi = MOST_ID + 1 if c.low_side_holds_it(total[c.node]) else LEAST_ID - 1  # all on one side
            _narrow(rows, cuts, stage)
            for c in cuts:
                c.keys += (c.lo,)
        at = _fixed(rows, {c.node: (c.dim, *c.keys, c.low_side_holds_it(total[c.node])) for c in cuts}, "dim string, k0 long, k1 long, k2 long, left boolean")
        own, cut = F.struct(_dim("dim").alias("k0"), F.col("d_crc").alias("k1"), F.col("id_key").alias("k2")), F.struct("k0", "k1", "k2")
        right = (own > cut) | ((own == cut) & ~F.col("left"))
        moved = rows.join(at, "node", "left").withColumn("node", F.col("node") * 2 + F.when(F.col("dim").isNotNull() & right, 1).otherwise(0))
        before, rows = rows, stash.put(moved.drop("dim", "k0", "k1", "k2", "left"), "level")
        stash.drop(before)
        tree = {2 * k + side: at for k, (first, n) in tree.items() for side, at in ((0, (first, n // 2 if n > 1 else n)), (1, (first + n // 2, n - n // 2))) if side == 0 or n > 1}
    shard = _fixed(rows, {k: (first,) for k, (first, _) in tree.items()}, "shard int")
    return rows.join(shard, "node")


def shard_documents(docs: DataFrame, leaves: int | None = 40, target_bytes: int | None = None, slot_rows: int = 20_000, together: float = 0.02) -> DataFrame:
    """docs -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    leaves: number of shards; None derives it from target_bytes. slot_rows: about how many rows are numbered together.
    together: the weight of equal texts, as a share of a leaf, up to which a cut doesn't part them."""
    stash = Stash(docs.sparkSession, "sharding")
    rows = stash.put(joined(stash.put(coordinates(docs), "points")).withColumn("node", F.lit(0).cast("long")), "rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    leaves = leaves or max(1, -(-(total or 0) // target_bytes))
    rows = assign(rows, leaves, together, stash) if n else rows.withColumn("shard", F.lit(0))
    subs = max(1, n // leaves // slot_rows + 1)
    rows = stash.put(rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(subs)).cast("int").alias("sub")), "shards")
    stash.keep(rows)
    counts = rows.groupBy("shard", "sub").agg(F.count("*").alias("c"))
    starts = counts.select("shard", "sub", (F.sum("c").over(Window.partitionBy("shard").orderBy("sub")) - F.col("c")).alias("first"))
    local = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("at", local).join(starts, ["shard", "sub"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
