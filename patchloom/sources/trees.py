"""Source trees as tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never entered (a tool's own state folder is added by the caller), and the extensions that are read.
IGNORED = ("node_modules", ".git", "dist", "pkg", "target")
EXTENSIONS = ("ts", "tsx", "js", "jsx", "go", "py", "rs")


def listing(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """file, path (below root) and mtime (seconds) of each source file. No file's content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    at = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    x = raw.select(F.col("path").alias("file"), F.substring(at, len(base) + 1, 1 << 30).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return x.where(~F.col("path").rlike("(^|/)(" + "|".join(p.replace(".", "[.]") for p in ignored) + ")(/|$)"))


def source_tree(spark: SparkSession, root: str, known: DataFrame | None = None, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """path (below root), mtime (seconds), content of each source file; unreadable bytes are replaced.

    known (path, mtime): what an index holds. Files that it holds with the same time come with a null content and are
    not opened: they are listed first, and only the changed ones' names, which the driver lists anyway, are read."""
    files = listing(spark, root, ignored)
    if known is None:
        changed = files
    else:
        changed = files.join(known.select("path", "mtime"), ["path", "mtime"], "left_anti")
    names = [r.file for r in changed.select("file").collect()]
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    if names:
        read = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), text)
    else:
        read = spark.createDataFrame([], "file string, content string")
    return files.join(read, "file", "left").select("path", "mtime", "content")
