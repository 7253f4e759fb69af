"""Language-model scoring with a class-based bigram model (Brown classes).

Exchange clustering assigns every word that occurs twice or more to a class, so that the likelihood of class bigrams is
large. The most frequent words, `seeds` for each class, are exchanged among the classes until none moves. Every other
word is then put where the likelihood gains most, given how often it stands beside each of these classes: those counts are
added up in Spark for all words, none is left out. The number of classes grows with the vocabulary. Words seen once and
unknown ones are one class, the end of a text another.

A token's probability is that of its class after the class before times that of the word in its class. In the class of
rare words, any unknown word is one more type, with the share that words seen once have there (Good-Turing).

Counts cover every training text: words are added up in each partition before they are shuffled. Words of at least the
count that leaves at most `head` of them are broadcast, a proven bound; what remains of each text, its rare words, is
joined to their counts and classes by a hash of 64 bits. So no vocabulary is too large, and no result depends on `head`.

A null text is an empty one: its only token is the end. With no training text every token has the probability that the
base formula gives for empty counts. Rows with a null or repeated doc_id are scored each; ties among classes go to the
first. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, as_bytes, fold, fold_of, slices

FLUSH = (1 << 20) - 1  # tokens whose neighbours are added up at once; a count of them fits 20 bits


def exchange(bigrams: np.ndarray, words: int, classes: int) -> np.ndarray:
    """Classes of the first `words` symbols of a bigram table; every other symbol is a class of its own.

    Each word in turn moves to the class that raises the likelihood most, by a thousandth at least, until a round moves none."""
    size = len(bigrams)
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(size - words)]).astype(np.int64)
    k = classes + size - words
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    table = member.T @ bigrams @ member
    left, right = bigrams @ member, bigrams.T @ member  # counts of a word before and after each class
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    moved = words
    while moved:
        moved = 0
        for w in range(words):
            a, own = of[w], bigrams[w, w]
            r, l = left[w].copy(), right[w].copy()
            r[a] -= own
            l[a] -= own
            table[a, :] -= r
            table[:, a] -= l
            table[a, a] -= own
            c = np.arange(classes)
            rows, cols, diag = table[c, :], table[:, c].T, table[c, c]
            gain = (f(rows + r) - f(rows)).sum(1) + (f(cols + l) - f(cols)).sum(1)
            # the two sums hold the diagonal twice, each time without the other's share
            gain += f(diag + r[c] + l[c] + own) + f(diag) - f(diag + r[c]) - f(diag + l[c])
            # what stands before the word still goes on with some class, and what stands after it still follows one
            before, after = table.sum(1)[c] + l[c], table.sum(0)[c] + r[c]
            gain -= f(before + r.sum() + own) - f(before) + f(after + l.sum() + own) - f(after)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-3:
                b = a
            table[b, :] += r
            table[:, b] += l
            table[b, b] += own
            if a != b:
                moved += 1
                of[w] = b
                left[:, a] -= bigrams[:, w]
                left[:, b] += bigrams[:, w]
                right[:, a] -= bigrams[w, :]
                right[:, b] += bigrams[w, :]
    return of


@dataclass
class Head:
    """The broadcast part of the vocabulary: sorted word hashes with their counts and numbers as seeds, -1 for none."""

    hashes: np.ndarray
    counts: np.ndarray
    seeds: np.ndarray


class Places(dict):
    """A word's place in the head, or -1 - place in `others` for a word that isn't there."""

    def __init__(self, head: Head, limit: int = 150_000):
        super().__init__()
        self.head, self.limit, self.others = head, limit, []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        i = int(np.searchsorted(self.head.hashes, h))
        if i == len(self.head.hashes) or self.head.hashes[i] != h:
            i = -1 - len(self.others)
            self.others.append(h)
        self[word] = i
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.limit:
            self.clear()
            self.others.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def count_words(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """texts (text) -> hash, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def out():
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in n), np.int64, len(n))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(n.values(), np.int64, len(n)))], ["hash", "n"])

        for b in slices(batches):
            for t in as_bytes(b.column(0)):
                n.update((t or b"").lower().split())
            if len(n) > flush:
                yield out()
                n.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _head(vocabulary: DataFrame, head: int, seeds: int) -> tuple[Head, int]:
    """The head and the least count in it, the seeds apart: the least, from 2 up, that leaves at most `head` words."""
    at_least, total = 2, 0
    for r in vocabulary.groupBy("n").count().orderBy(F.desc("n")).limit(head + 1).toLocalIterator():
        total += r["count"]
        if total > head:
            at_least = max(at_least, r.n + 1)
            break
    often = vocabulary.where("n >= 2")
    got, most = often.where(F.col("n") >= at_least).toArrow(), often.orderBy(F.desc("n"), "hash").limit(seeds).toArrow()
    h, at = np.unique(np.concatenate([got["hash"].to_numpy(), most["hash"].to_numpy()]), return_index=True)
    n = np.concatenate([got["n"].to_numpy(), most["n"].to_numpy()])[at]
    number = np.full(len(h), -1)
    top = np.lexsort((h, -n))[:seeds]
    number[top] = np.arange(len(top))
    return Head(h, n, number), at_least


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin; nulls are empty."""
    col = b.column(b.schema.get_field_index(name))
    sizes = np.array([0 if n is None else n for n in col.value_lengths().to_pylist()], np.int64)
    return np.array(col.flatten()), np.concatenate([[0], np.cumsum(sizes)])


def _between_ends(b: pa.RecordBatch, of_place: np.ndarray, tail: np.ndarray | int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a batch's texts in a row, one end before the first and one after each; a symbol for each, those of
    words that aren't in the head from `tail`, by their place in the batch's lists or one for all; and that place or -1."""
    places, starts = _flat(b, "places")
    ends = starts[1:] + np.arange(1, len(starts))
    out, where = np.full(len(places) + len(starts), end, np.int64), np.full(len(places) + len(starts), -1, np.int64)
    inner = np.ones(len(out), bool)
    inner[0] = False
    inner[ends] = False
    lists = _flat(b, "h")[1] if "h" in b.schema.names else _offsets(b)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = places >= 0
    symbol = np.empty(len(places), np.int64)
    symbol[inside] = of_place[places[inside]]
    at = np.full(len(places), -1, np.int64)
    at[~inside] = lists[row[~inside]] - 1 - places[~inside]
    symbol[~inside] = tail if np.isscalar(tail) else tail[at[~inside]]
    out[inner], where[inner] = symbol, at
    full = np.full(len(out), -1, np.int64)
    full[inner] = places
    return out, where, full


def _offsets(b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(b.column(b.schema.get_field_index("others"))))]).astype(np.int64)


def count_bigrams(texts: DataFrame, size: int, symbols) -> np.ndarray:
    """Symbol bigrams of encoded texts, each between two ends; symbols(batch) gives a batch's in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in slices(batches):
            s = symbols(b)
            total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(size * size)
    got = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def neighbours(texts: DataFrame, head, beside: np.ndarray, k: int) -> DataFrame:
    """texts (encoded) -> hash, near: how often each word that is no seed stands after and before each of k symbols.

    beside: the symbol of each place of the head; other words have k - 2, ends k - 1. near: code << 20 | count, codes
    from k on are of symbols after the word. Counts are added up for FLUSH tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = head.value, [], 0

        def out() -> pa.RecordBatch:
            words, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            words, of = np.unique(words, return_inverse=True)
            key, n = np.unique(np.concatenate([of * (2 * k) + left, of * (2 * k) + k + right]), return_counts=True)
            near = ((key % (2 * k)).astype(np.uint32) << np.uint32(20)) | n.astype(np.uint32)
            starts = np.searchsorted(key // (2 * k), np.arange(len(words) + 1)).astype(np.int32) * 4
            column = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(near.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(words), column], ["hash", "near"])

        for b in slices(batches, 200):
            s, at, places = _between_ends(b, beside, k - 2, k - 1)
            others = _flat(b, "h")[0].astype(np.int64)
            word = np.flatnonzero((at >= 0) | ((places >= 0) & (own.seeds[np.maximum(places, 0)] < 0 if len(own.seeds) else False)))
            for lo in range(0, len(word), FLUSH // 2):
                i = word[lo : lo + FLUSH // 2]
                hashes = np.where(at[i] >= 0, others[np.maximum(at[i], 0)] if len(others) else 0, own.hashes[np.maximum(places[i], 0)] if len(own.hashes) else 0)
                if size and size + len(i) > FLUSH:
                    yield out()
                    held, size = [], 0
                held.append((hashes, s[i - 1], s[i + 1]))
                size += len(i)
        if size:
            yield out()

    return texts.select("places", "h").mapInArrow(run, "hash long, near binary")


def classify(near: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """near (hash, near) -> hash, n, class: the class with which a word raises the likelihood of the class bigrams `table`
    most, to the first order: by the logarithms of its neighbours' shares beside each class."""
    k = len(table)
    smooth = table + 0.1
    before = np.log(smooth[:, :classes] / smooth[:, :classes].sum(0))  # of the symbols before a class
    after = np.log(smooth[:classes].T / smooth[:classes].sum(1))
    worth = np.vstack([before, after])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash, count and worth of the word that the next batch may go on with

        def out(h: np.ndarray, n: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(w.argmax(1).astype(np.int32))], ["hash", "n", "class"])

        for b in slices(batches, 4_000):
            if not b.num_rows:
                continue
            h, col = b.column(0).to_numpy(), b.column(1)
            ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] // 4
            entries = np.frombuffer(col.buffers()[2], np.uint32)[ends[0] : ends[-1]]
            starts = (ends - ends[0])[:-1]
            code, n = (entries >> np.uint32(20)).astype(np.int64), (entries & np.uint32(0xFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat(np.where(code < k, n, 0), starts[first])
            w = np.add.reduceat(n[:, None] * worth[code], starts[first], axis=0)
            h = h[first]
            if last and last[0] == h[0]:
                total[0] += last[1]
                w[0] += last[2]
            elif last:
                yield out(np.array([last[0]]), np.array([last[1]]), last[2][None, :])
            last = h[-1], total[-1], w[-1]
            yield out(h[:-1], total[:-1], w[:-1])
        if last:
            yield out(np.array([last[0]]), np.array([last[1]]), last[2][None, :])

    return near.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "hash long, n long, class int")


def score_documents(docs: DataFrame, folds: int = 10, held: int = 0, growth: float = 0.3, seeds: int = 12, head: int = 400_000, prior: float = 5.0) -> DataFrame:
    """docs -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    growth: there are as many classes as words that occur twice, to this power. seeds: words for each class that are
    exchanged until none moves. prior: weight of the class unigram in transitions. head: words that are broadcast; no
    result depends on it."""
    spark = docs.sparkSession
    stash = Stash(spark, "lmscore")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(fold("doc_id", folds) != held)
    vocabulary = stash.put(count_words(train), "words")
    texts = train.count()
    types, tokens, once = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
    big_n, big_v = tokens + texts, types + bool(texts)
    classes = max(1, round((types - once) ** growth))
    top, at_least = _head(vocabulary, head, seeds * classes)
    shared = spark.sparkContext.broadcast(top)
    base_all = big_n + 0.1 * (big_v + 1)
    unknown = min(0.9, (once + 0.5) / (once + 1))
    coded = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, logs double, places array<int>, h array<long>, c array<long>, row long"
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("logs", pa.float64()), ("places", pa.list_(pa.int32())), ("h", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())), ("row", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places in the head; -1 - place in h for any other word."""
        from pyspark import TaskContext

        own, places, row = shared.value, Places(shared.value), TaskContext.get().partitionId() << 36
        base, log = np.log10(own.counts + 0.1) - math.log10(base_all), np.log10(own.counts)
        end_base = math.log10(texts + 0.1) - math.log10(base_all)
        for b in slices(batches):
            ids, out = b.column(0).to_pylist(), []
            for t in as_bytes(b.column(1)):
                i = places.of((t or b"").lower().split())
                inside = i >= 0
                known, s = i[inside], i.astype(np.int32)
                rest, which, times = np.unique(-1 - i[~inside], return_inverse=True, return_counts=True)
                s[~inside] = -1 - which
                row += 1
                out.append((len(i) + 1, len(known) + bool(texts), base[known].sum() + end_base - len(which) * math.log10(base_all), log[known].sum(), s, [places.others[j] for j in rest.tolist()], times, row))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([ids, fold_of(ids, folds) == held, *cols], schema, strict=True)], schema=schema)

    encoded = stash.put(docs.mapInArrow(encode, coded), "encoded")
    learned = encoded.where("not held_out").select("places", "h")
    number = int(top.seeds.max(initial=-1)) + 1
    seed_of = np.where(top.seeds < 0, number, top.seeds)
    bigrams = count_bigrams(learned, number + 2, lambda b: _between_ends(b, seed_of, number, number + 1)[0])
    classes = min(classes, max(1, number))
    of = exchange(bigrams, number, classes) if number else np.array([classes, classes + 1])
    member = np.zeros((len(of), classes + 2))
    member[np.arange(len(of)), of] = 1
    found = stash.put(classify(neighbours(learned, shared, of[seed_of], classes + 2), member.T @ bigrams @ member, classes), "classes")

    # symbols of the model: the classes, the class of rare words, the end
    rare, end = classes, classes + 1
    of_place = np.where(top.seeds < 0, rare, of[seed_of])
    got = found.where(F.col("n") >= at_least).select("hash", "class").toArrow()  # a part of the head: at most `head` words
    of_place[np.searchsorted(top.hashes, got["hash"].to_numpy())] = got["class"].to_numpy()
    loose = encoded.select("row", F.posexplode(F.arrays_zip("h", "c")).alias("at", "x")).select("row", "at", F.col("x.h").alias("hash"), "x.c")
    tail = found.where(F.col("n") < at_least)
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) * F.col("c")
    emitted = F.when(F.col("n").isNull(), math.log10(unknown)).when(F.col("n") == 1, math.log10((1 - unknown) / max(1, once))).otherwise(F.log10("n")) * F.col("c")
    often = F.collect_list(F.when(F.col("n") >= 2, F.struct("at", "class")))
    rest = loose.join(tail, "hash", "left").groupBy("row").agg(F.sum(log).alias("rest"), F.sum(emitted).alias("rest_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("c")).otherwise(0)).alias("more"), often.alias("often"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    resolved = encoded.withColumn("others", F.size("h")).drop("h", "c").join(rest, "row", "left")
    resolved = resolved.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), (F.col("base") + zero("rest")).alias("base"), (F.col("logs") + zero("rest_logs")).alias("logs"), "places", "others", F.col("often.at").alias("at"), F.col("often.class").alias("classes"))
    resolved = stash.put(resolved, "resolved")
    stash.keep(resolved)
    table = spark.sparkContext.broadcast(of_place)

    def symbols(b: pa.RecordBatch) -> np.ndarray:
        begin = _offsets(b)
        tails = np.full(begin[-1], rare, np.int64)
        at, starts = _flat(b, "at")
        if len(at):
            tails[np.repeat(begin[:-1], np.diff(starts)) + at] = _flat(b, "classes")[0]
        return _between_ends(b, table.value, tails, end)[0]

    bigrams = count_bigrams(resolved.where("not held_out").select("places", "others", "at", "classes"), classes + 2, symbols)
    k = classes + 2
    share = (bigrams.sum(0) + 0.5) / (bigrams.sum() + 0.5 * k)
    trans = np.log10((bigrams + prior * share[None, :]) / (bigrams.sum(1, keepdims=True) + prior))
    # a word's share of its class; that of rare words is in `logs` already
    in_class = bigrams.sum(0)
    in_class[[rare, end]] = 1
    within = np.log10(np.maximum(in_class, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            s, starts = symbols(b), _flat(b, "places")[1]
            logs = trans[s[:-1], s[1:]] - within[s[1:]]
            each = np.add.reduceat(logs, starts[:-1] + np.arange(b.num_rows)) if b.num_rows else np.zeros(0)
            model = np.array(b.column(b.schema.get_field_index("logs"))) + each
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            base = b.column(b.schema.get_field_index("base"))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.full(b.num_rows, big_n)), base, pa.array(model) if texts else base], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return resolved.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
