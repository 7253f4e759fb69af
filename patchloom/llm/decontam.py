"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words, weighted by TF-IDF over the words of the benchmark; document frequencies
cover every document. A distributed randomised SVD of the benchmark's passages gives the latent space: each partition
adds up its share of A'(A Q), the driver orthonormalises, and a second pass refines the first; directions are whitened,
so common words don't rule the cosine. Every window of every document is compared with every passage of every benchmark
item; what is near enough is checked by the longest common subsequence of words around the window and by the item's
answer, its rarest words, so that reworded passages count and mere common words don't, or by a quotation, a run of words
in the item's own order without gaps. Long items are checked section by section and passage by passage, and one that is
found is enough.

Items are indexed and searched in blocks of `block`, of fewer where they are long, so what is broadcast and what
partitions send to the driver is bounded however large the benchmark is.

Null or empty texts hold no passage, and null or empty items match nothing. Repeated rows are each searched. With an
empty table there are no hits. Columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, slices

RANK = 96
HALF = 16  # words of half a window
RUN = 13  # words of a quotation that is a hit of its own
STEP = 8  # words between the starts of an item's passages
SECTION = 6 * HALF  # words of a section of an item; neighbours share a window's words
#: ASCII other than letters, digits and the underscore separates words.
SPLIT = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


SPACE = re.compile("[ \\t-\\r]")
LONG = 1 << 20  # code points of a text that are split into words at once
GRAM = 8  # words of the shortest quotation


def parts(text: str) -> Iterator[str]:
    """A text in parts that end at white space, so that a very long one is never a list of all its words."""
    start = 0
    while len(text) - start > LONG:
        m = SPACE.search(text, start + LONG)
        end = m.end() if m else len(text)
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(SPLIT).split() if text else []


class Vocabulary(dict):
    """Words of a block of items to terms from 1; 0 is any other word and weighs nothing."""

    def __init__(self, texts):
        super().__init__()
        for t in texts:
            for w in words_of(t):
                self.setdefault(w, len(self) + 1)

    def ids(self, text: str | None) -> np.ndarray:
        got = []
        for part in parts(text or ""):
            w = words_of(part)
            got.append(np.fromiter(map(self.get, w, repeat(0)), np.int32, len(w)))
        return got[0] if len(got) == 1 else np.concatenate(got)


def grams(x: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash of each n terms in a row."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        out = (out + x[i : len(x) - n + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(32)


def document_frequencies(docs: DataFrame, vocabulary) -> np.ndarray:
    """For each term the number of texts that hold it; place 0 is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = vocabulary.value, frozenset(vocabulary.value)
        n = np.zeros(len(own) + 1, np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                found = set().union(*(known.intersection(words_of(p)) for p in parts(t or "")))
                n[[own[w] for w in found]] += 1
                n[0] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    out = np.zeros(len(vocabulary.value) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _gathered(ids: list[np.ndarray], weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms padded to whole halves, the vector of each window of two halves, its text, its first half's number there."""
    halves = [-(-len(x) // HALF) for x in ids]
    flat = np.zeros(sum(halves) * HALF, np.int64)
    at = 0
    for x, h in zip(ids, halves, strict=True):
        flat[at : at + len(x)] = x
        at += h * HALF
    part = weighted[flat].reshape(-1, HALF, weighted.shape[1]).sum(axis=1)
    owner = np.repeat(np.arange(len(ids)), halves)
    if len(part) > 1:
        part[:-1] += np.where((owner[1:] == owner[:-1])[:, None], part[1:], 0)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves)
    return flat, part, owner, first


def windows(ids: list[np.ndarray], weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of all windows of some texts, the text of each, and the number of its first half there."""
    _, part, owner, first = _gathered(ids, weighted)
    return part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12), owner, first


def _cut(x: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text's terms in parts of at most `most`, a multiple of HALF, with their place; windows on a cut are in the part before it."""
    for at in range(0, max(1, len(x) - HALF), most - HALF):
        yield at, x[at : at + most]


def latent_basis(items: DataFrame, vocabulary, idf: np.ndarray, rank: int = RANK, passes: int = 2, seed: int = 7) -> np.ndarray:
    """Whitened leading right singular vectors (terms x rank) of the TF-IDF windows of items."""
    terms = len(idf)
    basis = np.random.default_rng(seed).standard_normal((terms, min(rank, terms))).astype(np.float32)
    for step in range(passes + 1):
        shared = items.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w = shared.value * idf[:, None]
            total, gram = np.zeros(w.shape, np.float32), np.zeros((w.shape[1],) * 2)
            for b in slices(batches):
                for _, ids in _batches(map(vocabulary.value.ids, b.column(0).to_pylist())):
                    flat, part = _gathered([x for _, _, x in ids], w)[:2]
                    gram += part.T @ part
                    # a word stands in the window that begins with its half and in the one before
                    both = part + np.vstack([np.zeros((1, w.shape[1]), np.float32), part[:-1]])
                    order = np.argsort(flat, kind="stable")
                    term, start = np.unique(flat[order], return_index=True)
                    if len(term):
                        total[term] += np.add.reduceat(both[order // HALF], start, axis=0) * idf[term][:, None]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary())], ["z", "gram"])

        z, gram = np.zeros(basis.shape), np.zeros((basis.shape[1],) * 2)
        for r in items.select("text").mapInArrow(run, "z binary, gram binary").toLocalIterator():
            z += np.frombuffer(r.z, np.float32).reshape(z.shape)
            gram += np.frombuffer(r.gram).reshape(gram.shape)
        if step < passes:
            basis = np.linalg.qr(z)[0].astype(np.float32)
    values, turn = np.linalg.eigh(gram)
    size = np.sqrt(np.maximum(values, 0))
    keep = size > 1e-3 * size.max() if size.max() > 0 else np.zeros(len(size), bool)
    return (basis @ (turn[:, keep] / size[keep])).astype(np.float32)


class Index:
    """Benchmark items in the latent space, with what the checks of a candidate need.

    An item is cut into sections of at most SECTION words, which are checked one by one, and these into passages of a
    window's words and of half as many, which have the vectors: no cosine and no check depends on an item's length."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: Vocabulary, idf: np.ndarray, basis: np.ndarray, near: float, lcs: float, loose: float, answer: float):
        self.vocabulary = vocabulary
        self.near, self.lcs, self.loose, self.answer = near, lcs, loose, answer
        self.weighted = basis * idf[:, None]
        kept = [(i, vocabulary.ids(t)) for i, t in items]
        kept = [(i, x) for i, x in kept if len(x)]
        self.ids = [i for i, _ in kept]
        self.idf, self.part, self.rare = idf, max(loose, 0.6), {}
        self.words, self.item, self.spans, vectors, sections = [], [], [], [], []
        for k, (_, x) in enumerate(kept):
            for at in range(0, max(1, len(x) - 2 * HALF), SECTION - 2 * HALF):
                own = x[at : at + SECTION]
                for size in (2 * HALF, HALF):
                    last = max(0, len(own) - size)
                    for start in (*range(0, last, STEP), last):
                        vectors.append(self.weighted[own[start : start + size]].sum(axis=0))
                        sections.append(len(self.words))
                        self.spans.append((start, min(size, len(own))))
                    if len(own) <= HALF:
                        break
                self.words.append(own.tolist())
                self.item.append(k)
        v = np.array(vectors).reshape(len(vectors), basis.shape[1])
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32).T
        self.section = np.array(sections, np.int64)
        self.masks, self.answers, self.counts, self.keys = [], [], [], []
        own = [grams(np.array(x)) for x in self.words]
        self.grams = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        for x in self.words:
            mask: dict[int, int] = {}
            for i, w in enumerate(x):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)
            self.counts.append({w: n for w, m in mask.items() if (n := m.bit_count() - 1)})
            self.keys.append(frozenset(mask))
            self.answers.append(self.rarest(x))

    def rarest(self, words: list[int]) -> frozenset[int]:
        rare = sorted(set(words), key=lambda w: (-self.idf[w], w))
        return frozenset(rare[: max(1, len(rare) // 4)])

    def has(self, g: np.ndarray) -> np.ndarray:
        """Whether each hash of GRAM terms is one of a section."""
        if not len(self.grams):
            return np.zeros(len(g), bool)
        return self.grams[np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)] == g

    def common(self, k: int, text: list[int], start: int = 0, size: int | None = None) -> float:
        """Length of the longest common subsequence of a run of words and section k, or `size` words of it, as a share."""
        mask, size = self.masks[k], size or len(self.words[k])
        v = full = (1 << size) - 1
        for w in text:
            if m := mask.get(w, 0) >> start & full:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return (size - v.bit_count()) / size

    def answered(self, rare: frozenset[int], text) -> bool:
        """Whether a run of words has enough of the rarest words; two of them may be there by chance."""
        return len(rare.intersection(text)) >= max(self.answer * len(rare), min(3, len(rare)))

    def quoted(self, k: int, text: list[int]) -> bool:
        """Whether RUN words of section k, or half of a shorter one but at least GRAM, stand side by side in a run of words."""
        words, n = len(self.words[k]), 1
        least = min(RUN, max(GRAM, -(-words // 2)), words)
        ends = [self.masks[k].get(w, 0) for w in text]  # bit i: the last n words are those up to word i
        while n < least and any(ends):
            step = min(n, least - n)
            ends = [e & b << step for e, b in zip(ends[step:], ends, strict=False)]
            n += step
        return any(ends)

    def reworded(self, k: int, text: list[int], p: int) -> bool:
        """Whether passage p of section k, a whole window's and shorter than k, is in a run of words, some words replaced."""
        start, size = self.spans[p]
        if not 2 * HALF <= size < len(self.words[k]):
            return False
        if p not in self.rare:
            self.rare[p] = self.rarest(self.words[k][start : start + size])
        return self.answered(self.rare[p], text) and self.common(k, text, start, size) >= self.part

    def candidates(self, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows and sections, sorted by section, of which a passage is near; the largest cosine and its passage."""
        at, passage, cosine = [], [], []
        for lo in range(0, len(self.section), 2048):
            near = (unit @ self.vectors[:, lo : lo + 2048]).ravel()
            found = np.flatnonzero(near >= self.near)
            a, p = np.divmod(found, min(2048, len(self.section) - lo))
            at.append(a)
            passage.append(lo + p)
            cosine.append(near[found])
        passage, cosine = np.concatenate(passage), np.concatenate(cosine)
        key = self.section[passage] * len(unit) + np.concatenate(at)
        order = np.lexsort((-cosine, key))
        key, start = np.unique(key[order], return_index=True)
        return key % len(unit), key // len(unit), cosine[order][start], passage[order][start]

    def hits(self, texts: list[tuple[int, int, np.ndarray]], whole: dict[int, np.ndarray]) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
        """Parts of texts (text, place in it, terms) -> text, item, (cosine, common share, answer share) of each section
        that passes the checks. whole: the terms of all texts, as a check may look beyond a part."""
        ids = [x for _, _, x in texts]
        if not self.ids or not sum(map(len, ids)):
            return
        unit, owner, first = windows(ids, self.weighted)
        first = first + np.array([at // HALF for _, at, _ in texts])[owner]
        number = [t for t, _, _ in texts]
        runs: list[list] = []
        for a, k, c, p in zip(*(x.tolist() for x in self.candidates(unit)), strict=True):
            if runs and runs[-1][0] == k and runs[-1][2] + 1 >= a and owner[a] == owner[runs[-1][1]] and a - runs[-1][1] < 8:
                runs[-1][2:] = a, *max(tuple(runs[-1][3:]), (c, p, a))
            else:
                runs.append([k, a, a, c, p, a])
        begins = [max(0, at - SECTION) for _, at, _ in texts]
        quotes = [np.cumsum(self.has(grams(whole[t][b : at + len(x) + SECTION + 2 * HALF]))) for b, (t, at, x) in zip(begins, texts, strict=True)]
        owner, first = owner.tolist(), first.tolist()
        for k, a, z, c, p, best in runs:
            text, reach, part = number[owner[a]], len(self.words[k]), owner[a]
            terms = whole[text]
            lo, hi = max(0, first[a] * HALF - reach), first[z] * HALF + 2 * HALF + reach
            near_words = terms[lo:hi].tolist()
            near = set(near_words)
            # a word that isn't there at all is in no common subsequence
            there = self.keys[k] & near
            most = len(there)
            if self.counts[k]:
                most += sum(map(self.counts[k].get, there, repeat(0)))
            hit, share = False, -1.0
            if most >= self.loose * reach:
                good = self.answered(self.answers[k], near)
                if good or most >= self.lcs * reach:
                    share = self.common(k, near_words)
                    hit = share >= self.lcs or good and share >= self.loose
            if not hit:
                # a quotation holds GRAM words of some section in a row, if its section isn't shorter
                g, left, right = quotes[part], lo - begins[part], min(hi - begins[part], len(quotes[part]) + GRAM - 1) - GRAM
                seen = right >= left and len(g) and g[right] > (g[left - 1] if left > 0 else 0)
                hit = (seen or reach < GRAM) and self.quoted(k, near_words)
            if not hit:
                middle = first[best] * HALF
                hit = self.reworded(k, terms[max(0, middle - HALF) : middle + 3 * HALF].tolist(), p)
            if hit:
                share = self.common(k, near_words) if share < 0 else share
                yield text, self.item[k], (c, share, len(self.answers[k] & near) / len(self.answers[k]))

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, dict[int, tuple[float, float, float]]]]:
        """For each text with hits: item -> (cosine, common share, answer share) of its best section."""
        for whole, batch in _batches(map(self.vocabulary.ids, texts)):
            out: dict[int, dict] = {}
            for text, item, about in self.hits(batch, whole):
                own = out.setdefault(text, {})
                if about[1] > own.get(item, (0, -1, 0))[1]:
                    own[item] = about
            yield from out.items()


def _batches(ids: Iterator[np.ndarray], most: int = 48_000) -> Iterator[tuple[dict[int, np.ndarray], list[tuple[int, int, np.ndarray]]]]:
    """Texts' terms by number, and their parts (number, place, terms); at most about `most` terms are in the parts, however
    long a text is."""
    whole, held, size = {}, [], 0
    for i, x in enumerate(ids):
        for at, part in _cut(x, most):
            if size and size + len(part) > most:
                yield whole, held
                whole, held, size = {}, [], 0
            whole[i] = x
            held.append((i, at, part))
            size += len(part)
    if held:
        yield whole, held


def indexes(docs: DataFrame, benchmark: DataFrame, block: int = 5_000, near: float = 0.55, lcs: float = 0.8, loose: float = 0.5, answer: float = 0.4) -> list:
    """Broadcast indexes, one for each block of items. near: least cosine of a candidate. lcs: least common share of a
    hit; loose: least share where at least `answer` of the item's rarest words, and three, are there too."""
    spark = docs.sparkSession
    stash = Stash(spark, "decontam")
    items = stash.put(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null"), "items")
    rows, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks, out = max(-(-rows // block), -(-chars // (block * 1_000))), []
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        vocabulary = Vocabulary(t for _, t in rows)
        shared = spark.sparkContext.broadcast(vocabulary)
        df = document_frequencies(docs, shared)
        idf = np.log1p(df[0] / (1 + df)).astype(np.float32)
        idf[0] = 0
        basis = latent_basis(part.repartition(4), shared, idf)
        out.append(spark.sparkContext.broadcast(Index(rows, vocabulary, idf, basis, near, lcs, loose, answer)))
    stash.keep()
    return out


def leaks(docs: DataFrame, index) -> DataFrame:
    """docs -> doc_id, item_id, cosine, common_share, answer_share; one row for each item found in a row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common_share", pa.float64()), ("answer_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in slices(batches):
            doc_ids, rows = b.column(0).to_pylist(), {}
            for i, hits in own.found(b.column(1).to_pylist()):
                for k, v in hits.items():  # a long text comes in several batches
                    rows[i, k] = max(rows.get((i, k), v), v, key=lambda v: v[1])
            rows = [(doc_ids[i], own.ids[k], *map(float, v)) for (i, k), v in sorted(rows.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, cosine double, common_share double, answer_share double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = [leaks(docs, i) for i in indexes(docs, benchmark, **options)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common_share double, answer_share double")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they were."""
    at = docs.columns.index("text")
    out = docs
    for index in indexes(docs, benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in slices(batches):
                clean = np.ones(b.num_rows, bool)
                clean[[i for i, _ in own.found(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
