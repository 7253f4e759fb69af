"""Chunks of a patch: at file headers and after a number of lines, with long lines cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_LINES = 300
MAX_LINE_BYTES = 2048
CUT_MARK = "... [line truncated]"


def cut_line(line, most: int = MAX_LINE_BYTES):
    return F.when(F.octet_length(line) > most, F.concat(T.byte_truncate(line, most), F.lit(CUT_MARK))).otherwise(line)


def diff_chunks(segments: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """segments -> patch_id, file_seq, part, chunk: every line ends with LF; text before a header is a chunk of its own."""
    at = F.row_number().over(Window.partitionBy("patch_id", "file_seq").orderBy("pos")) - 1
    part = F.floor(at / max_lines).cast("bigint")
    lines = segments.select("patch_id", "file_seq", "pos", part.alias("part"), F.concat(cut_line(F.col("line"), max_bytes), F.lit("\n")).alias("out"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"])
    return lines.groupBy("patch_id", "file_seq", "part").agg(F.array_join(ordered, "").alias("chunk"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Adds chunk_seq (from 1) and total; blank chunks are not counted and go."""
    by = Window.partitionBy("patch_id")
    kept = chunks.where(F.length(T.trim(F.col("chunk"))) > 0)
    return kept.withColumns({"chunk_seq": F.row_number().over(by.orderBy("file_seq", "part")).cast("bigint"), "total": F.count("*").over(by)})
