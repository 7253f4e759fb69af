"""Patches as lines: kinds, files, hunks and line numbers, all in one pass over one partitioning by patch.

State leaks across files on purpose: a header without a new path keeps the file before it, and so does a hunk without
a start. Values are therefore carried forward over the patch, not reset by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def explode_lines(patches: DataFrame) -> DataFrame:
    """patches (patch_id, diff) -> patch_id, pos (from 0), line. A null diff has no lines."""
    return patches.select("patch_id", F.posexplode(T.lines(F.col("diff"))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def annotate(lines: DataFrame) -> DataFrame:
    """lines -> the shared frame of all detectors.

    Adds is_header, is_hunk, kind (header, hunk, removed, added, context), file and rule_file ('' before any), file_seq,
    hunk_seq, hunk_start (0 before any hunk), content (without the marker), new_line (number in the new file)."""
    patch = Window.partitionBy("patch_id").orderBy("pos")
    so_far = patch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    header, hunk = line.startswith("diff --git"), line.startswith("@@")
    removed = line.startswith("-") & ~line.startswith("---")
    added = line.startswith("+") & ~line.startswith("+++")
    path = T.trim(T.piece(line, " b/", 2))
    after_plus = T.piece(line, r"\+", 2)
    rule_header = line.startswith("diff --git ")
    rule_hunk = ~rule_header & line.startswith("@@ ") & after_plus.isNotNull()
    x = lines.select(
        "patch_id",
        "pos",
        "line",
        header.alias("is_header"),
        hunk.alias("is_hunk"),
        F.when(header, "header").when(hunk, "hunk").when(removed, "removed").when(added, "added").otherwise("context").alias("kind"),
        F.when(header, path).alias("own_file"),
        F.when(rule_header, path).alias("own_rule_file"),
        F.when(hunk, F.when(after_plus.isNotNull(), T.u32_or_one(T.trim(T.piece(after_plus, ",", 1))))).alias("own_start"),
        rule_hunk.alias("is_rule_hunk"),
        F.when(rule_hunk, T.u32_or_one(F.regexp_extract(after_plus, r"^([^, ]*)", 1))).alias("own_line"),
        (~rule_header & ~rule_hunk & (added | line.startswith(" "))).cast("int").alias("step"),
        F.when(removed | added, F.substring(line, 2, 1 << 30)).otherwise(line).alias("content"),
    )
    x = x.withColumns(
        {
            "file": F.coalesce(F.last("own_file", ignorenulls=True).over(so_far), F.lit("")),
            "rule_file": F.coalesce(F.last("own_rule_file", ignorenulls=True).over(so_far), F.lit("")),
            "file_seq": F.sum(F.col("is_header").cast("int")).over(so_far),
            "hunk_seq": F.sum((F.col("is_header") | F.col("is_hunk")).cast("int")).over(so_far),
            "hunk_start": F.coalesce(F.last("own_start", ignorenulls=True).over(so_far), F.lit(0)).cast("bigint"),
            "base_line": F.coalesce(F.last("own_line", ignorenulls=True).over(so_far), F.lit(1)).cast("bigint"),
            "steps": F.coalesce(F.sum("step").over(patch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    at_hunk = F.coalesce(F.last(F.when(F.col("is_rule_hunk"), F.col("steps")), ignorenulls=True).over(so_far), F.lit(0))
    return x.withColumn("new_line", (F.col("base_line") + F.col("steps") - at_hunk).cast("bigint")).drop("own_file", "own_rule_file", "own_line", "base_line", "steps")


def segments(patches: DataFrame) -> DataFrame:
    return annotate(explode_lines(patches))


def files_changed(lines: DataFrame) -> DataFrame:
    """patch_id, files: the number of file headers."""
    return lines.groupBy("patch_id").agg(F.count_if(F.col("line").startswith("diff --git")).alias("files"))


#: File extensions and the language that each stands for.
LANGUAGES = {
    "rs": "Rust",
    "ts": "TypeScript",
    "tsx": "TypeScript",
    "js": "JavaScript",
    "jsx": "JavaScript",
    "mjs": "JavaScript",
    "cjs": "JavaScript",
    "py": "Python",
    "go": "Go",
    "java": "Java",
    "kt": "Kotlin",
    "kts": "Kotlin",
    "swift": "Swift",
    "rb": "Ruby",
    "cs": "C#",
    "cpp": "C++",
    "cc": "C++",
    "cxx": "C++",
    "c": "C",
    "h": "C",
    "php": "PHP",
}
DEFAULT_STACK = "TypeScript, JavaScript, Rust, Go, Python"


def patch_languages(lines: DataFrame) -> DataFrame:
    """patch_id, languages: the sorted distinct languages of the headers' extensions."""
    ext = F.regexp_extract(F.regexp_extract("line", r"([^.]*)\z", 1), r"(?U)^\s*(\S*)", 1)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    named = F.when(F.col("line").startswith("diff --git"), known[ext])
    return lines.groupBy("patch_id").agg(F.array_sort(F.collect_set(named)).alias("languages"))


def stack_label(languages: DataFrame) -> DataFrame:
    """patch_id, header_label, prompt_label."""
    joined = F.nullif(F.array_join("languages", ", "), F.lit(""))
    return languages.select("patch_id", F.coalesce(joined, F.lit("unknown")).alias("header_label"), F.coalesce(joined, F.lit(DEFAULT_STACK)).alias("prompt_label"))
