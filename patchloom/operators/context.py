"""Definitions that a patch touches, within a number and a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Identifiers that are never looked up.
KEYWORDS = ("if", "else", "for", "while", "return", "const", "let", "var", "function", "class", "interface", "type", "import", "export", "from", "async", "await", "true", "false", "null", "undefined", "string", "number", "boolean", "any", "void", "Promise")
MOST_SYMBOLS = 10
MOST_BYTES = 3000


def context_symbols(segments: DataFrame, symbols: DataFrame) -> DataFrame:
    """patch_id, name, first_pos, first_at: indexed names in added lines and where they come first."""
    tokens = segments.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++")).select("patch_id", "pos", F.posexplode(T.words(F.col("line"), "[a-zA-Z0-9_$]+")).alias("at", "name"))
    first = tokens.where(~F.col("name").isin(*KEYWORDS)).groupBy("patch_id", "name").agg(F.min(F.struct("pos", "at")).alias("f"))
    known = first.join(symbols.select("name"), "name", "left_semi")
    return known.select("patch_id", "name", F.col("f.pos").alias("first_pos"), F.col("f.at").cast("bigint").alias("first_at"))


def context_topk(found: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """The first names of each patch, with rank from 1; place in the patch decides, which makes the choice a fixed one."""
    order = Window.partitionBy("patch_id").orderBy("first_pos", "first_at", "name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def context_text(top: DataFrame, symbols: DataFrame, budget: int = MOST_BYTES) -> DataFrame:
    """patch_id, context: entries in rank order up to the first that would exceed the budget."""
    # fixed value: the format of an entry, on which its bytes depend
    entry = F.concat(F.lit("\n--- Arch Reference: "), F.col("name"), F.lit(" (from "), F.col("file"), F.lit(") ---\n"), F.col("snippet"), F.lit("\n"))
    x = top.join(symbols.select("name", "file", "snippet"), "name").withColumn("entry", entry)
    by = Window.partitionBy("patch_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("bytes", F.sum(F.octet_length("entry")).over(by)).where(F.col("bytes") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda s: s["entry"]), "")
    return x.groupBy("patch_id").agg(text.alias("context"))
