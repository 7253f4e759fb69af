"""Patches, source trees, answers and tickets derived from the test tables, which hold no diffs themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_PATCH = 5
EXTENSIONS = ("ts", "py", "go", "rs", "js", "md")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"))
    folder = F.when(F.col("doc_id") % 3 == 0, "auth").otherwise("core")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.withColumn("path", F.concat(F.lit("src/"), "source", F.lit("/"), folder, F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), ext))


def patches(spark: SparkSession, sf_dir: str, symbols: bool = False) -> DataFrame:
    """patch_id, diff: five documents each. symbols appends names of the derived source tree to some added lines."""
    i, raw, kind = F.col("i"), F.col("raw"), F.col("doc_id") % 4
    n = (i + 1).cast("string")
    v = lambda k: F.pmod(k, F.lit(7)).cast("string")
    tail = F.when(i % 5 == 0, F.concat(F.lit(" f"), F.col("doc_id").cast("string"), F.lit("_0()"))).otherwise("") if symbols else F.lit("")
    removed_use = F.when(i % 3 == 0, F.concat(F.lit("-const v"), v(i), F.lit(" = 1;"))).when(i % 3 == 1, F.concat(F.lit("+use(v"), v(i - 1), F.lit(");"))).otherwise(F.concat(F.lit(" "), raw))
    body = F.array_compact(
        F.array(
            F.when(i % 12 == 0, F.concat(F.lit("@@ -"), n, F.lit(",12 +"), n, F.lit(",12 @@"))),
            F.when(kind == 0, F.concat(F.lit("-"), raw)),
            F.when(kind == 0, F.concat(F.lit("+// "), raw)),
            F.when(kind == 1, removed_use),
            F.when(kind == 2, F.concat(F.lit("+"), raw, tail)),
            F.when(kind == 3, F.when(i % 2 == 0, F.concat(F.lit(" "), raw)).otherwise(F.concat(F.lit("-"), raw))),
            F.when((kind == 3) & (i % 2 == 1), F.concat(F.lit("+"), raw, F.lit(" TODO"))),
        )
    )
    docs = _documents(spark, sf_dir)
    head = lambda s: F.concat(*(F.lit(x) if x != "<path>" else F.col("path") for x in s))
    heads = F.array(head(("diff --git a/", "<path>", " b/", "<path>")), F.lit("index 0000000..1111111 100644"), head(("--- a/", "<path>")), head(("+++ b/", "<path>")))
    lines = docs.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select("doc_id", "path", "i", F.array_join(body, "\n").alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda s: s["part"])
    files = lines.groupBy("doc_id", "path").agg(parts.alias("parts")).withColumn("text", F.array_join(F.concat(heads, F.filter("parts", lambda p: F.length(p) > 0)), "\n"))
    of_patch = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"])
    return files.groupBy((F.col("doc_id") - F.col("doc_id") % FILES_PER_PATCH).alias("patch_id")).agg(F.concat(F.array_join(of_patch, "\n"), F.lit("\n")).alias("diff"))


def source_files(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """path, mtime, content: a definition every ninth line. later is a second snapshot, with changed and missing files."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("i").cast("string"))
    k = F.col("doc_id") % 6
    define = F.when(k == 1, F.concat(F.lit("def f"), name, F.lit("(x):"))).when(k == 2, F.concat(F.lit("func F"), name, F.lit("() {"))).when(k == 3, F.concat(F.lit("pub fn f"), name, F.lit("() {"))).when(k == 4, F.concat(F.lit("export const c"), name, F.lit(" = {"))).otherwise(F.concat(F.lit("export async function f"), name, F.lit("(x) {")))
    line = F.when(F.col("i") % 9 == 0, define).when(F.col("i") % 9 == 4, "}").otherwise(F.col("raw"))
    x = _documents(spark, sf_dir).select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select("doc_id", "path", "i", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    out = x.groupBy("doc_id", "path").agg(text.alias("content"))
    mtime = F.col("doc_id").cast("double")
    if later:
        out = out.where("doc_id % 10 <> 1")
        mtime = F.when(F.col("doc_id") % 10 == 0, mtime + 0.5).otherwise(mtime)
        out = out.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("\nexport class Late"), F.col("doc_id").cast("string"), F.lit(" {\n}"))).otherwise(F.col("content")))
    return out.select("path", mtime.alias("mtime"), "content")


#: One answer of each kind that decoding tells apart.
_F = '{"file":"a.ts","line":%d,"severity":"high","category":"security","issue":"x","suggested_fix":"y"}'
RESPONSES = (
    '{"findings":[' + _F % 1 + '],"positives":["p","q","q"],"suggestions":["s"]}',
    'Here it is:\n```json\n{"findings":[' + _F % 2 + "]}\n```\nDone.",
    "[" + _F % 3 + "," + _F % 4 + "]",
    "[" + _F % 5 + "]",
    '{"findings":[' + _F % 6 + '],"positives":["cut',
    '{"findings":[{"file":"a.ts","line":7,"severity":"High","category":"security","issue":"x","suggested_fix":"y"}]}',
    "no issues at all",
)
#: What decoding makes of each: status and number of findings.
EXPECTED = (("ok", 1), ("ok", 1), ("ok", 2), ("ok", 0), ("ok", 1), ("bad_json", 0), ("no_json", 0))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, chunk_seq, response: from events, seven kinds in turn."""
    events = read(spark, sf_dir, "events")
    table = F.array(*map(F.lit, RESPONSES))
    return events.select((F.col("event_id") - F.col("event_id") % 5).alias("patch_id"), (F.col("event_id") % 5 + 1).cast("bigint").alias("chunk_seq"), F.element_at(table, (F.col("event_id") % 7 + 1).cast("int")).alias("response"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, text: the first turn of each conversation, dealt to patches; the first conversation of each wins."""
    first = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.groupBy((F.col("conv_id") * FILES_PER_PATCH).alias("patch_id")).agg(F.min_by("text", "conv_id").alias("text"))
