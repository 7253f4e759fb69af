"""Deterministic detectors over annotated lines: commented-out code, removed names still in use, pattern rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What makes a block sensitive, and the texts of findings.
SENSITIVE_PATHS = ("auth", "login", "token", "password", "security", "middleware")
SENSITIVE_CODE = ("auth", "token", "password", "login", "validate", "sanitize")
SENSITIVE_ISSUE = "Security-sensitive logic has been entirely commented out (%d lines). The function body is now dead code and will not execute — this may silently break authentication or validation."
COMMENTED_ISSUE = "A code block of %d lines has been commented out. Commented-out code is technical debt — either restore it or delete it."
COMMENTED_FIX = "Restore the logic if it should be active, or remove the commented block entirely. Use version control (git revert/branch) instead of commenting out."
REMOVED_ISSUE = "Variable `%s` was removed but is still referenced in the same scope. This will cause a ReferenceError (JavaScript) or NameError (Python) at runtime."
REMOVED_FIX = "Restore the declaration of `%s`, or remove all references to it. Do not leave code that uses an undefined variable."
LEAST_REMOVED = 3
IDENTIFIER = r"[\p{L}\p{N}_$]+"


def _any(column, parts):
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(column, F.lit(p))
    return out


def commented_code(segments: DataFrame) -> DataFrame:
    """One finding for each hunk of at least three removed lines of which 60 % come back behind a comment mark.

    A removed line is matched by key: each added line offers itself without slashes and stars, without `//` and without
    `// `, so the comparison of all removed with all added lines is an equi-join inside the hunk. A line that only
    changed its indentation matches too, as does the first form by definition."""
    own = ["patch_id", "file_seq", "hunk_seq"]
    rows = segments.where(F.col("kind").isin("removed", "added") & (F.col("file") != "")).withColumn("code", T.trim(F.col("content"))).where(F.length("code") > 0)
    removed = rows.where("kind = 'removed'")
    a = F.col("code")
    stripped = T.trim(F.regexp_replace(F.regexp_replace(a, r"^/+", ""), r"^\*+", ""))
    keys = F.array_distinct(F.array(stripped, F.when(a.startswith("//"), F.substring(a, 3, 1 << 30)), F.when(a.startswith("// "), F.substring(a, 4, 1 << 30))))
    offered = rows.where("kind = 'added'").select(*own, F.explode(keys).alias("code"), F.lit(1).alias("hit")).where("code is not null").distinct()
    has_added = rows.groupBy(*own).agg(F.count_if(F.col("kind") == "added").alias("added"))
    counted = removed.join(offered, [*own, "code"], "left").groupBy(*own, "file", "hunk_start").agg(F.count("*").alias("removed"), F.sum(F.coalesce("hit", F.lit(0))).alias("matched"), F.bool_or(_any(F.col("code"), SENSITIVE_CODE)).alias("code_hit"), F.min("pos").alias("pos"))
    hit = counted.join(has_added, own).where((F.col("removed") >= LEAST_REMOVED) & (F.col("added") > 0) & (F.col("matched") * 10 >= F.col("removed") * 6))
    sensitive = F.col("code_hit") | _any(F.col("file"), SENSITIVE_PATHS)
    return hit.select(
        "patch_id",
        F.lit(1).alias("detector"),
        F.col("pos").alias("at"),
        F.lit(0).alias("sub"),
        "file",
        F.col("hunk_start").alias("line"),
        F.when(sensitive, "high").otherwise("medium").alias("severity"),
        F.when(sensitive, "security").otherwise("quality").alias("category"),
        F.when(sensitive, F.format_string(SENSITIVE_ISSUE, "removed")).otherwise(F.format_string(COMMENTED_ISSUE, "removed")).alias("issue"),
        F.lit(COMMENTED_FIX).alias("suggested_fix"),
        F.lit(0.95).cast("float").alias("confidence"),
    )


def declared_name(line):
    """The name that a line declares: const, let or var, then def, then the word before the first ` := `; null if none."""
    t = T.trim(line)
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(found(r"^(?:const|let|var) ([\p{L}\p{N}_$]+)"), found(r"^def ([\p{L}\p{N}_]+)"), found(r"^(?:(?! := ).)*?([\p{L}\p{N}_]+) := "))


def declared_names(segments: DataFrame) -> DataFrame:
    """patch_id, pos, file, name of each removed line that declares one."""
    return segments.where("kind = 'removed'").select("patch_id", "file_seq", "pos", "file", declared_name(F.col("content")).alias("name")).where("name is not null")


def removed_still_used(segments: DataFrame) -> DataFrame:
    """Removed declarations whose name is an identifier of any line of the file that isn't removed, headers' paths included.

    The line is the stored line's place in the file added to a start that only a hunk directly after its file's header
    sets; it is carried over files."""
    stored = (~F.col("is_header") & ~F.col("is_hunk")).cast("int")
    by_file = Window.partitionBy("patch_id", "file_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = segments.withColumn("stored", F.sum(stored).over(by_file))
    x = x.withColumn("set_start", F.when(F.col("is_hunk") & (F.col("stored") == 0), F.col("own_start")))
    over_patch = Window.partitionBy("patch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("start", F.last("set_start", ignorenulls=True).over(over_patch))
    starts = x.groupBy("patch_id", "file_seq").agg(F.coalesce(F.max_by("start", "pos"), F.lit(1)).alias("start"))
    uses = x.where((F.col("kind").isin("added", "context")) & (F.col("file") != "")).select("patch_id", "file_seq", F.explode(T.words(F.col("content"), IDENTIFIER)).alias("name")).distinct()
    gone = x.where((F.col("kind") == "removed") & (F.col("file") != "")).select("patch_id", "file_seq", "pos", "file", "stored", declared_name(F.col("content")).alias("name")).where("name is not null")
    hit = gone.join(uses, ["patch_id", "file_seq", "name"], "left_semi").join(starts, ["patch_id", "file_seq"])
    return hit.select(
        "patch_id",
        F.lit(2).alias("detector"),
        F.col("pos").alias("at"),
        F.lit(0).alias("sub"),
        "file",
        (F.col("start") + F.col("stored") - 1).cast("bigint").alias("line"),
        F.lit("high").alias("severity"),
        F.lit("quality").alias("category"),
        F.format_string(REMOVED_ISSUE, "name").alias("issue"),
        F.format_string(REMOVED_FIX, "name").alias("suggested_fix"),
        F.lit(0.92).cast("float").alias("confidence"),
    )


@dataclass(frozen=True)
class Rule:
    """A pattern rule as users write it. No files means all files."""

    pattern: str
    message: str
    severity: str = "medium"
    category: str = "quality"
    files: tuple[str, ...] = field(default=())

    @property
    def java(self) -> str:
        """The pattern as Java's engine, which runs it, writes it: a group's name is of no use there."""
        return re.sub(r"((?:^|[^\\])(?:\\\\)*\()\?P?<(?![=!])\w+>", r"\1", self.pattern)

    def fault(self, spark: SparkSession) -> str | None:
        """Why the pattern can't be used: rules stay inside what linear-time engines and Java's share."""
        if re.search(r"\(\?(?:[=!]|<[=!])", self.pattern) or re.search(r"\\(?:[1-9]|k<)", self.pattern):
            return "lookaround or backreference"
        if re.search(r"(?:[*+?}]\+)|\(\?>", self.pattern):
            return "possessive or atomic"
        try:
            spark._jvm.java.util.regex.Pattern.compile(self.java)
        except IllegalArgumentException as e:  # what Spark makes of a PatternSyntaxException
            return str(e).splitlines()[0]
        return None


CATEGORIES = ("security", "performance", "maintainability", "compliance")


def rule_severity(text):
    s = F.lower(text)
    return F.when(s == "high", "high").when(s.isin("medium", "med"), "medium").otherwise("low")


def rule_category(text):
    return F.when(F.lower(text).isin(*CATEGORIES), F.lower(text)).otherwise("quality")


def glob_match(path, pattern):
    """`*`, `*.ext`, or an exact path or its last parts."""
    return (pattern == "*") | F.when(pattern.startswith("*."), F.endswith(path, F.substring(pattern, 2, 1 << 30))).otherwise((path == pattern) | F.endswith(path, F.concat(F.lit("/"), pattern)))


def rule_status(spark, rules: list[Rule]) -> DataFrame:
    """rule_id, pattern, fault: what is wrong with each rule, null if nothing."""
    return spark.createDataFrame([(i, r.pattern, r.fault(spark)) for i, r in enumerate(rules)], "rule_id int, pattern string, fault string")


def rule_findings(segments: DataFrame, rules: list[Rule]) -> DataFrame:
    """One finding for each added line and rule that matches it. Patterns are literals, compiled once, in one pass."""
    usable = [(i, r) for i, r in enumerate(rules) if r.fault(segments.sparkSession) is None]
    if not usable:
        return findings_like(segments)
    tests = []
    for i, r in usable:
        here = F.col("content").rlike(r.java)
        if r.files:
            fits = F.lit(False)
            for g in r.files:
                fits = fits | glob_match(F.col("rule_file"), F.lit(g))
            here = fits & here
        tests.append(F.when(here, F.struct(F.lit(i).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.message).alias("message"))))
    hits = segments.where("kind = 'added'").withColumn("hit", F.explode(F.array_compact(F.array(*tests))))
    return hits.select(
        "patch_id",
        F.lit(3).alias("detector"),
        F.col("pos").alias("at"),
        F.col("hit.rule_id").alias("sub"),
        F.col("rule_file").alias("file"),
        F.col("new_line").alias("line"),
        rule_severity(F.col("hit.severity")).alias("severity"),
        rule_category(F.col("hit.category")).alias("category"),
        F.col("hit.message").alias("issue"),
        F.lit("").alias("suggested_fix"),
        F.lit(1.0).cast("float").alias("confidence"),
    )


FINDING = "patch_id bigint, detector int, at bigint, sub int, file string, line bigint, severity string, category string, issue string, suggested_fix string, confidence float"


def findings_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDING)
