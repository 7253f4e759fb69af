"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

A document's set holds the 64-bit hashes of its distinct word shingles. SuperMinHash gives each element a random
permutation of the signature's places plus a random rank inside each step; the steps stop early, as soon as every
place holds a value that no later step can beat. Bands of equal values nominate pairs and every link is confirmed on
the full sets of the two texts.

No group is ever expanded into all pairs. Documents with one and the same set are a class with one representative.
Representatives are then linked in rounds: first each with the smallest partner that any of its bands offers, then
with the smallest member of each of its bands that is still in another component, and last, in blocks, with whatever is left in
another component in any of its bands. The last round makes the result exact for every pair that shares a band.

Null text, empty text and text without words give an empty set, which links with nothing. A row without doc_id links
with nothing, has no component and is kept. Rows that repeat a doc_id are one document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, WordIds, as_bytes, mix64, slices
from .graph import UnionFind, components

BLOCK = 512  # members of a band that are compared with as many others in one call
BANDS, ROWS = 32, 5  # a pair at 0.8 is missed with a chance of (1 - 0.8 ** 5) ** 32, about 3e-6
#: Four bits of each place are kept. Two sets at 0.8 agree in 0.8125 of the places, give or take 0.031 at 160 of them;
#: below this share, over five deviations less, they need no full check.
PLACES_ALIKE = 0.64
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: bytes | None, words: WordIds, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text; A-Z is lower-cased and words end at ASCII white space."""
    w = words.of((text or b"").lower().split())
    n = len(w)
    if not n:
        return w
    if n < k:
        return mix64((w * FACTORS[:n]).sum(keepdims=True) + GOLDEN * np.full(1, n, np.uint64))
    s = w[: n - k + 1] * FACTORS[0]
    for i in range(1, k):
        s = s + w[i : n - k + 1 + i] * FACTORS[i]
    return np.unique(mix64(s))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, places: int) -> np.ndarray:
    """SuperMinHash of many sets at once: elements[i] belongs to set owner[i]. Values are (step << 32) + rank."""
    top = np.uint64(places) << np.uint64(32)
    sig = np.full(n_sets * places, top, np.uint64)
    e, base, perm = elements, owner.astype(np.int64) * places, None
    for step in range(places):
        u = mix64(e + np.uint64(int(GOLDEN) * (step + 1) & (1 << 64) - 1))
        rank, k = u >> np.uint64(32), (step + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64))
        if perm is None:
            place = k
        else:
            rows = np.arange(len(e))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, step]
        np.minimum.at(sig, base + place, (np.uint64(step) << np.uint64(32)) + rank)
        open_sets = sig.reshape(n_sets, places).max(axis=1) >= np.uint64(step + 1) << np.uint64(32)
        live = open_sets[base // places]
        if not live.any():
            break
        if perm is None:
            e, base, k = e[live], base[live], k[live]
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(e), 1))
            perm[np.arange(len(e)), k] = 0
        elif not live.all():
            e, base, perm = e[live], base[live], perm[live]
    return sig.reshape(n_sets, places)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = mix64(sig + GOLDEN)
    key = np.arange(bands, dtype=np.uint64)[None, :] * FACTORS[1]
    for r in range(rows):
        key = mix64(key * FACTORS[2] + v[:, r::rows][:, :bands])
    return key.view(np.int64)


def place_bits(sig: np.ndarray) -> np.ndarray:
    """Four bits of each place, sixteen places to a long."""
    x = mix64(sig) & np.uint64(15)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 16))).reshape(len(x), -1, 16)
    return np.bitwise_or.reduce(x << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def features(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), bits (four of each place), bands (their keys)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            start = 0
            while start < len(ids):
                sets, size, stop = [], 0, start
                while stop < len(ids) and (size < 50_000 or stop == start):
                    sets.append(shingles(texts[stop], words, k))
                    size += len(sets[-1])
                    stop += 1
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                sig = super_minhash(np.concatenate(sets), owner, len(sets), bands * rows) if size else np.zeros((len(sets), bands * rows), np.uint64)
                keys, bits = band_keys(sig, bands, rows), place_bits(sig)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[start:stop], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digest], pa.int64()),
                        pa.array([d and int.from_bytes(d[8:], "little", signed=True) for d in digest], pa.int64()),
                        *(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (bits, keys)),
                    ],
                    schema=schema,
                )
                start = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bits array<long>, bands array<long>")


def plausible(n, n_b, bits, bits_b, places: int, percent: int):
    """A condition on two sets' sizes and bits that pairs at `percent` or more meet, but for a negligible chance."""
    unequal = F.lit(0)
    for i in range(-(-places // 16)):
        x = F.get(F.col(bits), F.lit(i)).bitwiseXOR(F.get(F.col(bits_b), F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        unequal = unequal + F.bit_count(x)
    return (100 * F.least(n, n_b) >= percent * F.greatest(n, n_b)) & (unequal <= int(places * (1 - PLACES_ALIKE * percent / 80)))


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are alike enough."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, held = WordIds(), None, None
        for t in slices(batches, 200):
            keep = []
            for a, x, y in zip(t.column(0).to_pylist(), as_bytes(t.column(2)), as_bytes(t.column(3)), strict=True):
                if last != (a, x):
                    last, held = (a, x), shingles(x, words, k)
                own = shingles(y, words, k)
                both = len(np.intersect1d(held, own, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(own) - both))
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep, pa.bool_())), t.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    text = lambda c: docs.where("text is not null").select(F.col("doc_id").cast("long").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(full, "a long, b long")


def confirmed_in_blocks(members: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members (key, rep, label) that share a key and have different labels.

    A key's members are dealt into blocks, and each pair of blocks is compared by one call, so neither the rows that
    come out nor what a call holds grows with the square of a key's members. A pair is compared where its first shared
    key is, and not at all once other links of the call have joined it."""
    sized = members.groupBy("key").agg(F.count("*").alias("c")).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    rows = members.join(sized, "key").join(reps.select("rep", "bands"), "rep").join(text, "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "label", "bands", "text")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("rep")
        key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
        block, rep, label = (t[c].to_pylist() for c in ("block", "rep", "label"))
        words, found, uf = WordIds(), [], UnionFind()
        sets = [shingles(x, words, k) for x in as_bytes(t["text"].chunk(0))]
        size = np.array([len(s) for s in sets])
        bands = np.array(t["bands"].to_pylist(), np.int64)
        mine = np.argmax(bands[0] == key)
        first = bands[:, :mine]
        for x in range(len(rep)):
            y = np.arange(x + 1, len(rep))
            fits = (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & ~(first[y] == first[x]).any(axis=1)
            for y in y[fits].tolist():
                if (i != j and block[x] == block[y]) or uf.root(label[x]) == uf.root(label[y]):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[y] - both):
                    uf.join(label[x], label[y])
                    found.append((rep[x], rep[y]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    stash = Stash(docs.sparkSession, "minhash")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    feats = stash.put(features(docs, k, bands, rows), "features")
    classes = feats.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2")
    reps = stash.put(classes.agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "reps")
    members = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = stash.put(members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key"), "shared")
    inside = stash.put(members.join(shared, "key").join(reps.select("rep", "bits"), "rep"), "inside")  # only what shares a band
    alike = lambda x="", y="_b": plausible(f"n{x}", f"n{y}", f"bits{x}", f"bits{y}", bands * rows, percent)
    other = [F.col(c).alias(f"{c}_b") for c in ("key", "n", "bits", "label")]
    link = lambda pairs: stash.put(confirmed(pairs, docs, k, percent), "links")

    def labelled(comp: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """inside with labels, where a band holds more than one component; and the smallest member of each such band."""
        x = inside.withColumn("label", F.col("rep")) if comp is None else inside.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component_id", "rep")).drop("component_id")
        if comp is not None:
            x = x.join(x.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key"), "key")
            x = stash.put(x, "mixed")
        return x, x.groupBy("key").agg(F.min(F.struct("rep", "n", "bits", "label")).alias("h")).select("key", *[F.col(f"h.{c}").alias(f"{c}_b") for c in ("rep", "n", "bits", "label")])

    x, hubs = labelled(None)
    near = x.join(hubs, "key").where((F.col("rep_b") < F.col("rep")) & alike())
    links = link(near.groupBy("rep").agg(F.min("rep_b").alias("a")).select("a", F.col("rep").alias("b")))

    x, hubs = labelled(components(links, stash))
    near = x.join(hubs, "key").where((F.col("label") != F.col("label_b")) & alike())
    links = stash.put(links.unionByName(link(near.select(F.col("rep_b").alias("a"), F.col("rep").alias("b")).distinct())), "links")

    x, _ = labelled(components(links, stash))
    met = x.join(x.select(*other), (F.col("key") == F.col("key_b")) & (F.col("label") != F.col("label_b")) & alike(), "left_semi")
    met = stash.put(met.select("key", "rep", "label"), "met")  # written first, so that a band of many members may be split
    links = stash.put(links.unionByName(stash.put(confirmed_in_blocks(met, reps, docs, k, percent), "links")), "links")
    comp = components(links, stash)
    stash.keep(feats, reps, comp)

    ids = reps.select("n", "d1", "d2", "rep")
    found = feats.select("doc_id", "n", "d1", "d2").join(ids, ["n", "d1", "d2"], "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    return _one_per_id(found)


def _one_per_id(found: DataFrame) -> DataFrame:
    component = F.coalesce("component_id", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept: one document of each group, all columns as they were."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
