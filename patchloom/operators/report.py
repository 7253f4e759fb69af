"""Reports as columns: JSON, wrapped text and one finding's block, without terminal colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BADGES = {"high": "HIGH", "medium": "MED", "low": "LOW"}
ICONS = {"security": "🔒", "quality": "🐛", "performance": "⚡", "maintainability": "📐", "compliance": "📋"}
WIDTH, INDENT, RULE = 68, 10, 62


def wrap_lines(text, width: int = WIDTH):
    """Greedy lines by bytes; a word longer than the width stands alone."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s, w):
        fits = (F.length(s["now"]) > 0) & (F.octet_length(s["now"]) + 1 + F.octet_length(w) <= width)
        empty = F.length(s["now"]) == 0
        done = F.when(fits | empty, s["done"]).otherwise(F.array_append(s["done"], s["now"]))
        now = F.when(empty, w).when(fits, F.concat(s["now"], F.lit(" "), w)).otherwise(w)
        return F.struct(done.alias("done"), now.alias("now"))

    end = lambda s: F.when(F.length(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"])
    return F.aggregate(words, start, add, end)


def wrap_text(text, indent: int = INDENT, width: int = WIDTH):
    return F.array_join(F.transform(wrap_lines(text, width), lambda x: F.concat(F.lit(" " * indent), x)), "\n")


def _named(table: dict[str, str], column):
    out = F.lit("")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def finding_text(numbered: DataFrame) -> DataFrame:
    """Numbered findings -> patch_id, n, block."""
    lead = lambda c: F.regexp_replace(wrap_text(F.col(c)), r"^ +", "")
    head = F.concat(F.lit("\n   "), _named(BADGES, F.col("severity")), F.lit("   "), _named(ICONS, F.col("category")), F.lit("  "), F.col("category"), F.lit("  "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" [#"), F.col("n").cast("string"), F.lit("]\n"))
    block = F.concat(head, F.lit("  " + "─" * RULE + "\n"), F.lit("  Issue  "), lead("issue"), F.lit("\n"), F.lit("  Fix    "), lead("suggested_fix"), F.lit("\n"))
    return numbered.select("patch_id", "n", block.alias("block"))


def notes_block(notes: DataFrame, title: str) -> DataFrame:
    """patch_id, block of positives or suggestions; patches without any have none."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "seq", "text"))), lambda x: F.concat(F.lit("     ·  "), x["text"]))
    return notes.groupBy("patch_id").agg(F.concat(F.lit(f"  {title}\n"), F.array_join(items, "\n")).alias("block"))


def report_json(findings: DataFrame, positives: DataFrame | None = None, suggestions: DataFrame | None = None) -> DataFrame:
    """patch_id, report: one object; findings are the filtered ones, in order, confidence only where it is known."""
    item = F.struct("seq", F.struct("file", "line", "severity", "category", "issue", "suggested_fix", "confidence").alias("f"))
    out = findings.groupBy("patch_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("findings"))
    for name, notes in (("positives", positives), ("suggestions", suggestions)):
        if notes is None:
            out = out.withColumn(name, F.array().cast("array<string>"))
        else:
            own = notes.groupBy("patch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "seq", "text"))), lambda x: x["text"]).alias(name))
            out = out.join(own, "patch_id", "full_outer")
    filled = [F.coalesce("findings", F.array().cast("array<struct<file:string,line:bigint,severity:string,category:string,issue:string,suggested_fix:string,confidence:float>>")).alias("findings"), *(F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in ("positives", "suggestions"))]
    return out.select("patch_id", F.to_json(F.struct(*filled)).alias("report"))


def text_report(numbered: DataFrame, positives: DataFrame, suggestions: DataFrame, outcome: DataFrame) -> DataFrame:
    """patch_id, report: each patch's findings, then how many there are and how many chunks were skipped, then the notes.

    outcome (patch_id, findings, skipped) has a row for each patch, also for those without findings or notes."""
    blocks = finding_text(numbered).groupBy("patch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "").alias("blocks"))
    out = outcome.join(blocks, "patch_id", "left")
    for notes, title, name in ((positives, "What is good", "good"), (suggestions, "What could be better", "better")):
        out = out.join(notes_block(notes, title).withColumnRenamed("block", name), "patch_id", "left")
    n, lost = F.col("findings"), F.coalesce("skipped", F.lit(0))
    plural = lambda x, word: F.concat(x.cast("string"), F.lit(f" {word}"), F.when(x == 1, "").otherwise("s"))
    none = F.when(lost > 0, "No answer could be read").otherwise("Nothing found")
    count = F.when(n > 0, plural(n, "finding")).otherwise(none)
    foot = F.concat(F.lit("  "), count, F.when(lost > 0, F.concat(F.lit(", "), plural(lost, "chunk"), F.lit(" skipped"))).otherwise(""), F.lit("\n"))
    line = F.lit("  " + "─" * RULE + "\n")
    part = lambda c: F.when(F.col(c).isNotNull(), F.concat(line, F.col(c), F.lit("\n"))).otherwise("")
    return out.select("patch_id", F.concat(F.coalesce("blocks", F.lit("")), foot, part("good"), part("better")).alias("report"))


def ticket_preview(ticket):
    return F.concat(F.left(ticket, F.lit(60)), F.when(F.octet_length(ticket) > 60, "...").otherwise(""))
