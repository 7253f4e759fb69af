"""Language identification by rank-order profiles.

Letters are lower-cased, everything else is a word boundary, and n-grams of one to three places (boundaries at either
end only) are counted. A language's profile is its most frequent n-grams over all training texts, a document's profile
those of its whole text; the distance is the sum of how far each of the document's n-grams is out of place, an n-gram
that a profile lacks counting as the profile's length. Ties in frequency go by the n-gram's code.

Null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned. Rows with a null
lang teach nothing; a null doc_id counts as the empty text for its fold. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, fold_of, slices

LENGTH = 400  # n-grams of a profile
ORDERS = 3


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None, orders: int = ORDERS) -> np.ndarray:
    """The codes of all n-grams of a text; empty if it has no letter. Code points count modulo 2 ** 16."""
    if not text:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[x]
    x = np.where(letter, np.maximum(x & 0xFFFF, 1), 0).astype(np.uint64)
    x = np.concatenate([[0], x, [0]]).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
    x = x[keep]
    if len(x) < 3:
        return np.zeros(0, np.uint64)
    out = []
    for n in range(1, orders + 1):
        code = np.full(len(x) - n + 1, n << 60, np.uint64)
        inner = np.ones(len(code), bool)
        for i in range(n):
            part = x[i : len(x) - n + 1 + i]
            code |= part << np.uint64(16 * (n - 1 - i))
            if 0 < i < n - 1 or n == 1:
                inner &= part > 0
        out.append(code[inner & ((code & np.uint64((1 << 60) - 1)) > 0)])
    return np.concatenate(out)


def ranked(codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    code, n = np.unique(codes, return_counts=True)
    return code[np.lexsort((code, -n))[:length]]


class Profiles:
    def __init__(self, by_lang: dict[str, list[int]], length: int = LENGTH):
        self.langs, self.length = sorted(by_lang), length
        self.tables = []
        for lang in self.langs:
            codes = np.array(by_lang[lang], np.int64).view(np.uint64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and by how much it is nearer than the next: 0.5 for a tie, 1 for a perfect fit."""
        own = ranked(grams(text), self.length)
        if not len(own) or not self.langs:
            return "und", 0.0
        place, far = np.arange(len(own)), []
        for codes, rank in self.tables:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            far.append(int(np.where(codes[at] == own, abs(rank[at] - place), self.length).sum()))
        order = np.argsort(far, kind="stable")
        if len(far) == 1:
            return self.langs[0], 1 - far[0] / (self.length * len(own) + 1)
        return self.langs[order[0]], 0.5 + 0.5 * (far[order[1]] - far[order[0]]) / max(1, far[order[1]])


def fit(docs: DataFrame, folds: int = 5, held: int = 0, length: int = LENGTH) -> Profiles:
    """Profiles from every training row: n-grams are summed in each partition, then by Spark, and the top ones kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for i in range(0, len(own), 200):
                    code, n = np.unique(grams("\n".join(own[i : i + 200])), return_counts=True)
                    if lang in total:
                        code, inverse = np.unique(np.concatenate([total[lang][0], code]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([total[lang][1], n])).astype(np.int64)
                    total[lang] = code, n
        for lang, (code, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held)).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = sums.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("place") <= length)
    by_lang: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.place)):
        by_lang.setdefault(r.lang, []).append(r.code)
    return Profiles(by_lang, length)


def identify(docs: DataFrame, profiles: Profiles, folds: int = 5, held: int = 0) -> DataFrame:
    """docs -> doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            got = [profiles.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fold_of(ids, folds) == held), pa.array([x for x, _ in got], pa.string()), pa.array([float(s) for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
