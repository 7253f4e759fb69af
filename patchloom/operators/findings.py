"""Findings of all stages together: order, threshold, numbers, adjacent duplicates, gate and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = {"high": 2, "medium": 1, "low": 0}


def severity_rank(severity):
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def parse_threshold(text):
    """The command-line spelling: high, medium, anything else low, in any case."""
    s = F.lower(text)
    return F.when(s == "high", "high").when(s == "medium", "medium").otherwise("low")


def union_findings(*parts: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """All findings with seq (from 0) in each patch: detectors in their order, then chunks in theirs; nothing is dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if decoded is not None:
        out = out.unionByName(decoded.select("patch_id", F.lit(9).alias("detector"), F.col("chunk_seq").cast("bigint").alias("at"), F.col("seq").cast("int").alias("sub"), "file", "line", "severity", "category", "issue", "suggested_fix", "confidence"))
    order = Window.partitionBy("patch_id").orderBy("detector", "at", "sub")
    return out.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))


def at_least(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= RANK[threshold])


def number(findings: DataFrame) -> DataFrame:
    """n from 1, over what a threshold has left, in stream order."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("patch_id").orderBy("seq")).cast("bigint"))


def adjacent_dedup(rows: DataFrame, text: str = "text", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows whose text differs from the one before in the patch."""
    before = F.lag(text).over(Window.partitionBy("patch_id").orderBy(*order))
    first = F.row_number().over(Window.partitionBy("patch_id").orderBy(*order)) == 1
    return rows.withColumns({"_b": before, "_f": first}).where(F.col("_f") | ~F.col(text).eqNullSafe(F.col("_b"))).drop("_b", "_f")


def review_gate(patches: DataFrame, findings: DataFrame, threshold: str = "low") -> DataFrame:
    """patch_id, findings (at or above the threshold), exit_code."""
    hit = at_least(findings, threshold).groupBy("patch_id").agg(F.count("*").alias("c"))
    n = F.coalesce("c", F.lit(0))
    return patches.select("patch_id").join(hit, "patch_id", "left").select("patch_id", n.alias("findings"), F.when(n > 0, 1).otherwise(0).alias("exit_code"))


def review_outcome(gate: DataFrame, skipped: DataFrame) -> DataFrame:
    """patch_id, outcome: findings, skipped (none, but some chunks were) or clean."""
    x = gate.join(skipped, "patch_id", "left")
    return x.select("patch_id", F.when(F.col("findings") > 0, "findings").when(F.coalesce("skipped", F.lit(0)) > 0, "skipped").otherwise("clean").alias("outcome"))
