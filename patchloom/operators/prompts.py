"""Prompts for a text generator. The wording is this library's own; budgets and sections are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONTEXT_BYTES, REQUIREMENT_BYTES, DIFF_BYTES, TICKET_BYTES = 2000, 2000, 10_000, 1500
BASE_CATEGORIES = "security, quality, performance, maintainability"
REVIEW_HEAD = "You review code changes in %s.%s%s\nReport real problems only, each with file, line, severity (high, medium, low), category (%s), issue and suggested_fix; also positives and suggestions.%s\nAnswer with one JSON object with the lists findings, positives and suggestions.\n\nChange:\n%s\n"
DESCRIBE_HEAD = "Describe this change for a pull request as one JSON object with title, summary (list) and test_plan (list).\n\nChange:\n%s%s\n"
COMMIT_HEAD = "Write a commit message for this change as one JSON object with message and body.\n\nChange:\n%s\n"


def requirements(ticket):
    """Blank requirements are none."""
    return F.when(F.length(T.trim(ticket)) > 0, ticket)


def review_prompts(chunks: DataFrame, labels: DataFrame, contexts: DataFrame | None = None, tickets: DataFrame | None = None) -> DataFrame:
    """chunks (patch_id, chunk_seq, chunk) -> patch_id, chunk_seq, prompt."""
    x = chunks.join(labels.select("patch_id", "prompt_label"), "patch_id", "left")
    x = x.join(contexts, "patch_id", "left") if contexts is not None else x.withColumn("context", F.lit(None).cast("string"))
    x = x.join(tickets.select("patch_id", F.col("text").alias("ticket")), "patch_id", "left") if tickets is not None else x.withColumn("ticket", F.lit(None).cast("string"))
    context = T.byte_truncate(F.coalesce("context", F.lit("")), CONTEXT_BYTES)
    need = requirements(F.col("ticket"))
    need_part = F.when(need.isNotNull(), F.concat(F.lit("\n\nRequirements:\n"), T.byte_truncate(need, REQUIREMENT_BYTES), F.lit("\n"))).otherwise("")
    context_part = F.when(F.length(context) > 0, F.concat(F.lit("\n\nContext:\n"), context, F.lit("\n"))).otherwise("")
    kinds = F.when(need.isNotNull(), BASE_CATEGORIES + ", compliance").otherwise(BASE_CATEGORIES)
    focus = F.when(need.isNotNull(), "\nReport requirements that are not met, with category compliance.").otherwise("")
    x = x.select("patch_id", "chunk_seq", F.col("prompt_label").alias("a"), need_part.alias("b"), context_part.alias("c"), kinds.alias("d"), focus.alias("e"), "chunk")
    return x.select("patch_id", "chunk_seq", F.format_string(REVIEW_HEAD, "a", "b", "c", "d", "e", "chunk").alias("prompt"))


def describe_prompts(patches: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    x = patches.join(tickets.select("patch_id", "text"), "patch_id", "left") if tickets is not None else patches.withColumn("text", F.lit(None).cast("string"))
    ticket = F.when(F.col("text").isNotNull(), F.concat(F.lit("\n\nTicket:\n"), T.byte_truncate(F.col("text"), TICKET_BYTES))).otherwise("")
    return x.select("patch_id", T.byte_truncate(F.col("diff"), DIFF_BYTES).alias("d"), ticket.alias("t")).select("patch_id", F.format_string(DESCRIBE_HEAD, "d", "t").alias("prompt"))


def commit_prompts(patches: DataFrame) -> DataFrame:
    return patches.select("patch_id", T.byte_truncate(F.col("diff"), DIFF_BYTES).alias("d")).select("patch_id", F.format_string(COMMIT_HEAD, "d").alias("prompt"))
