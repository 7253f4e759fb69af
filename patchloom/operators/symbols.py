"""The symbol index of source trees: incremental scan, definitions by pattern, snippets, first definition wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of definitions and their patterns, in order of precedence on a line.
PATTERNS = (
    ("function", r"export\s+(?:async\s+)?function\s+([a-zA-Z0-9_$]+)"),
    ("class", r"export\s+class\s+([a-zA-Z0-9_$]+)"),
    ("interface", r"export\s+interface\s+([a-zA-Z0-9_$]+)"),
    ("type", r"export\s+type\s+([a-zA-Z0-9_$]+)"),
    ("const", r"export\s+(?:const|let|var)\s+([a-zA-Z0-9_$]+)"),
    ("function", r"^func\s+([A-Z][a-zA-Z0-9_$]*)"),
    ("interface", r"^type\s+([A-Z][a-zA-Z0-9_$]*)\s+interface"),
    ("class", r"^type\s+([A-Z][a-zA-Z0-9_$]*)\s+struct"),
    ("function", r"^def\s+([a-zA-Z0-9_$]+)\("),
    ("class", r"^class\s+([a-zA-Z0-9_$]+)[(:]"),
    ("function", r"pub\s+fn\s+([a-z0-9_]+)"),
    ("class", r"pub\s+struct\s+([A-Z][a-zA-Z0-9]*)"),
    ("interface", r"pub\s+trait\s+([A-Z][a-zA-Z0-9]*)"),
)
SNIPPET_LINES = 40
INDEX_VERSION = "1.1.0"
SYMBOL = "name string, file string, line int, snippet string, type string"
FILE_STATE = "path string, mtime double"


def changed_files(files: DataFrame, file_state: DataFrame) -> DataFrame:
    """files whose mtime differs from the recorded one; decided before any content is parsed."""
    old = file_state.select("path", F.col("mtime").alias("_old"))
    return files.join(old, "path", "left").where(~F.col("mtime").eqNullSafe(F.col("_old"))).drop("_old")


def source_lines(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, line (from 1), text."""
    x = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "text"))
    return x.select("path", (F.col("i") + 1).alias("line"), "text")


def candidates(lines: DataFrame) -> DataFrame:
    """Every definition: name, type, path, line, pattern_ord, match_ord. A cheap test runs before the patterns."""
    t = F.col("text")
    likely = t.contains("export") | t.contains("pub ") | t.startswith("def ") | t.startswith("class ") | t.startswith("func ") | t.startswith("type ")

    def named(kind: str, k: int, pattern: str):
        each = lambda name, i: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(k).alias("pattern_ord"), i.alias("match_ord"))
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), each)

    found = [named(kind, k, p) for k, (kind, p) in enumerate(PATTERNS)]
    return lines.where(likely).select("path", "line", F.explode(F.concat(*found)).alias("d")).select("d.name", "d.type", "path", "line", "d.pattern_ord", "d.match_ord")


def snippets(definitions: DataFrame, lines: DataFrame, most: int = SNIPPET_LINES) -> DataFrame:
    """definitions (path, line, ...) with snippet: to the first line, of at most `most`, after which braces are closed.

    Each line goes to the definitions it may belong to by an equi-join on its file and its block of `most` lines."""
    keys = definitions.select("path", F.col("line").alias("start")).distinct()
    wanted = keys.withColumn("block", F.explode(F.array_distinct(F.array((F.col("start") / most).cast("int"), ((F.col("start") + most - 1) / most).cast("int")))))
    placed = lines.withColumn("block", (F.col("line") / most).cast("int"))
    x = placed.join(wanted, ["path", "block"]).where(F.col("line").between(F.col("start"), F.col("start") + most - 1))
    by = Window.partitionBy("path", "start").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"depth": F.sum(T.brace_delta(F.col("text"))).over(by), "opened": F.max(T.opens_brace(F.col("text")).cast("int")).over(by)})
    x = x.withColumn("closes", ((F.col("opened") == 1) & (F.col("depth") <= 0)).cast("int"))
    x = x.withColumn("closed_before", F.coalesce(F.sum("closes").over(by) - F.col("closes"), F.lit(0))).where("closed_before = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return definitions.join(x.groupBy("path", F.col("start").alias("line")).agg(text.alias("snippet")), ["path", "line"])


def first_definitions(found: DataFrame) -> DataFrame:
    """One definition for each name: the first by path, line, pattern and match."""
    order = Window.partitionBy("name").orderBy("path", "line", "pattern_ord", "match_ord")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def build_index(files: DataFrame, symbols: DataFrame | None = None, file_state: DataFrame | None = None, refresh: bool = False) -> DataFrame:
    """files (path, mtime, content) -> symbols (name, file, line, snippet, type).

    With an earlier index only changed files are parsed; names that it holds keep their definition, and then those whose
    file is gone are dropped, so such a name is lost until its new file changes again. refresh drops the earlier symbols
    of changed files first."""
    changed = files if file_state is None else changed_files(files, file_state)
    lines = source_lines(changed)
    found = candidates(lines)
    if symbols is not None:
        if refresh:
            symbols = symbols.join(changed.select(F.col("path").alias("file")), "file", "left_anti").select("name", "file", "line", "snippet", "type")
        found = found.join(symbols.select("name"), "name", "left_anti")
    new = snippets(first_definitions(found), lines).select("name", F.col("path").alias("file"), F.col("line").cast("int").alias("line"), "snippet", "type")
    if symbols is None:
        return new
    return symbols.select("name", "file", "line", "snippet", "type").unionByName(new).join(files.select(F.col("path").alias("file")), "file", "left_semi").select("name", "file", "line", "snippet", "type")


def save_index(symbols: DataFrame, file_state: DataFrame, path: str) -> None:
    """Writes a new version beside the others; a reader takes the newest whole one, so none is overwritten while read."""
    import time

    at = f"{path.rstrip('/')}/v{time.time_ns():020d}"
    symbols.write.parquet(f"{at}/symbols")
    file_state.write.parquet(f"{at}/file_state")
    symbols.sparkSession.createDataFrame([(INDEX_VERSION, path)], "version string, root string").coalesce(1).write.parquet(f"{at}/meta")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """symbols and file_state of the newest whole version; empty tables if there is none."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath()) for s in fs.listStatus(fs_path)) if fs.exists(fs_path) else []
    whole = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/meta/_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], SYMBOL), spark.createDataFrame([], FILE_STATE)
    return spark.read.schema(SYMBOL).parquet(f"{whole[-1]}/symbols"), spark.read.schema(FILE_STATE).parquet(f"{whole[-1]}/file_state")
