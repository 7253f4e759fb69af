"""Best-fit packing of token sequences, hierarchical and residual.

Documents are tokenized and followed by one end id; only longer ones are cut. Each partition packs its own pieces by
best fit, longest first, and nearly full bins are final. The residue, underfull bins that could still be joined with
another, is merged up a tree of partitions, each time packed again as whole items, until one partition is left. By
best fit at most one bin of a partition is half full or less, and a join needs such a bin, so a partition hands up
that bin and at most `carry` bins with the most room. Bins not handed up are final as they are: no piece is lost.

A null or empty text is one piece that holds only the end id. Rows with a null or repeated doc_id are packed like any
other; pieces then repeat their numbers. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, slices

CAPACITY = 2048
END_ID = 0


class Encoder:
    """Token ids as little-endian bytes, by pieces between white space where a vocabulary allows it.

    Where normalisation is NFC, white space to blanks and lower case, and words are runs of letters, single digits and
    runs of other marks, white space always separates tokens and nothing crosses it, so a text's ids are its pieces' ids
    in a row; pieces repeat, so they are remembered. Any other vocabulary is given the whole text."""

    #: What a vocabulary's file must say for pieces to be tokenized one by one.
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    WORDS = [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[str, bytes] = {}  # pieces of this generation
        self.before: dict[str, bytes] = {}  # and of the one before, from which those still used are taken over
        said = json.loads(self.tokenizer.to_str())
        model, added = said["model"], [t["content"] for t in said["added_tokens"]]
        self.by_piece = (said["normalizer"] or {}).get("normalizers") == self.NORMAL and (said["pre_tokenizer"] or {}).get("pretokenizers") == self.WORDS and not said["truncation"] and not any(c.isspace() for t in added for c in t)
        self.plain = self.by_piece and model["type"] == "BPE" and not model.get("dropout") and not any(t.isalpha() for t in added)
        self.model = self.tokenizer.model
        #: Bytes as the characters that byte-level vocabularies write them with.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.written = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    @staticmethod
    def latin(word: str) -> bool:
        """Letters that neither normalisation nor lower-casing makes anything but letters of."""
        return word.isalpha() and max(word) < "\u0130" and unicodedata.is_normalized("NFC", word)

    def raw(self, piece: str) -> bytes:
        """The ids of a piece. Latin letters are one word to the vocabulary's merges, which need no more than its bytes."""
        if self.plain and self.latin(piece):
            word = "".join(map(self.written.__getitem__, piece.lower().encode()))
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, piece: str) -> bytes:
        out = self.known.get(piece)
        if out is None:
            out = self.before.get(piece)
            self.known[piece] = out = self.raw(piece) if out is None else out
        return out

    def learn(self, piece: str) -> None:
        """Remembers a piece's ids; Latin letters before ASCII marks are a group of tokens of their own."""
        core = piece.rstrip(".,!?;:|*#$%&")
        if piece in self.before:
            self.known[piece] = self.before[piece]
        elif self.plain and core != piece and core and self.latin(core):
            self.known[piece] = self.part(core.lower() if core.isascii() else core) + self.part(piece[len(core) :])
        elif self.plain and piece.isascii() and piece.isalpha():
            self.known[piece] = self.part(piece.lower())
        else:
            self.known[piece] = self.raw(piece)

    def __call__(self, text: str) -> bytes:
        if not self.by_piece:
            return self.raw(text)
        pieces = text.replace("\n", " ").split(" ")
        if len(self.known) > self.limit:
            self.known, self.before = {}, self.known
        for p in set(pieces).difference(self.known):
            self.learn(p)
        return b"".join(map(self.known.__getitem__, pieces))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32; one row for each piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        for b in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin and the place in it of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    rooms: list[int] = []  # the sorted distinct rooms of open bins
    by_room: dict[int, list[int]] = {}
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            k = len(fill)
            fill.append(0)
        else:
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bin_of[i], place[i] = k, fill[k]
        fill[k] += n
        room = capacity - fill[k]
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(k)
    return bin_of, place, np.array(fill, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], level: int, capacity: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Items (part, item, length, ...) -> the same columns, then bin, place, fill; chunk bounds what is held at once."""
    from pyspark import TaskContext

    task, done, held, n = TaskContext.get().partitionId(), 0, [], 0

    def out():
        nonlocal done
        t = pa.Table.from_batches(held).combine_chunks()
        k, place, fill = best_fit(t["length"].to_numpy(), capacity)
        ids = (np.int64(level) << np.int64(58)) + (np.int64(task) << np.int64(34)) + done + k
        done += len(fill)
        for name, x in (("bin", ids), ("place", place), ("fill", fill[k])):
            t = t.append_column(name, pa.array(x, pa.int64()))
        return t.append_column("task", pa.array(np.full(len(k), task, np.int64))).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= chunk:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def pack(items: DataFrame, capacity: int = CAPACITY, nearly: float = 1.0, carry: int = 64, fan_in: int = 8, chunk: int = 1_000_000) -> DataFrame:
    """items (with length) -> the same rows with sequence_id and offset.

    nearly: share of the capacity at which a bin is final. carry: roomy bins that a partition hands up each time.
    fan_in: partitions merged into one at each level of the tree. chunk: items packed together at most."""
    stash = Stash(items.sparkSession, "packing")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    base = stash.put(items.mapInArrow(lambda b: _pack(b, 0, capacity, chunk), f"{kinds}, bin long, place long, fill long, task long"), "level")
    full = int(capacity * nearly)
    bins = base.where(F.col("fill") < full).groupBy("bin").agg(F.first("fill").alias("length"), F.first("task").alias("task"))
    maps, level = [], 1
    parts = base.agg(F.max("task")).first()[0]
    parts = 0 if parts is None else parts + 1
    while parts:
        small = F.col("length") <= capacity // 2
        room = F.row_number().over(_by_task().orderBy("length", "bin"))
        up = bins.withColumn("rank", room).where(small | (F.col("rank") <= carry + 1)).select("bin", "length", (F.col("task") / fan_in).cast("long").alias("part"))
        nodes = (parts + fan_in - 1) // fan_in
        dealt = up.withColumnRenamed("bin", "item").repartition(nodes, "part").sortWithinPartitions("part")
        lv = level
        packed = stash.put(dealt.mapInArrow(lambda b, lv=lv: _pack(b, lv, capacity, chunk), "item long, length long, part long, bin long, place long, fill long, task long"), "level")
        maps.append(packed.select(F.col("item").alias("bin"), F.col("bin").alias("up_bin"), F.col("place").alias("up_place")))
        if parts == 1:
            break
        bins = packed.where(F.col("fill") < full).groupBy("bin").agg(F.first("fill").alias("length"), F.first("part").alias("task"))
        parts, level = nodes, level + 1
    out = base.drop("fill", "task")
    for m in maps:
        out = out.join(m, "bin", "left").select(*items.columns, F.coalesce("up_bin", "bin").alias("bin"), (F.col("place") + F.coalesce("up_place", F.lit(0))).alias("place"))
    return out.withColumnsRenamed({"bin": "sequence_id", "place": "offset"})


def _by_task():
    from pyspark.sql import Window

    return Window.partitionBy("task")


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer_path), **options)
