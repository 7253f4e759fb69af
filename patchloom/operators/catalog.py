"""The catalogue of models that a generator may load, and what a host needs for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Id, name, size, least memory and least disk in GB.
MODELS = (
    ("0.5b", "Qwen2.5-Coder-0.5B", 0.4, 2, 1),
    ("1.5b", "Qwen2.5-Coder-1.5B", 1.1, 4, 2),
    ("3b", "Qwen2.5-Coder-3B", 2.1, 6, 3),
    ("7b", "Qwen2.5-Coder-7B", 4.7, 8, 6),
    ("14b", "Qwen2.5-Coder-14B", 9.0, 16, 11),
    ("32b", "Qwen2.5-Coder-32B", 20.0, 32, 22),
)
GB = 1 << 30


#: What each is for, in our words.
ABOUT = ("quick checks, also on weak hosts", "the default: fair answers at a fair speed", "closer reading of larger trees", "careful reviews where memory allows", "deep reading on a workstation", "the best answers, on a server")


def models(spark: SparkSession) -> DataFrame:
    """id, name, size_gb, min_ram_gb, min_disk_gb, about, file: that of the four-bit weights, named by a rule."""
    rows = [(*m, a, f"{m[1].lower()}-instruct-q4_k_m.gguf") for m, a in zip(MODELS, ABOUT, strict=True)]
    return spark.createDataFrame(rows, "id string, name string, size_gb double, min_ram_gb bigint, min_disk_gb bigint, about string, file string")


def find_model(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """ids (id) with the model of exactly that id; unknown ids go."""
    return ids.join(F.broadcast(models(spark)), "id")


def model_requirements(spark: SparkSession, hosts: DataFrame) -> DataFrame:
    """hosts (host, ram_bytes, disk_bytes) by model: ram_ok and disk_ok. The catalogue has six rows, so each host gets six."""
    all_models = F.array(*[F.struct(F.lit(m[0]).alias("id"), F.lit(m[3]).alias("ram"), F.lit(m[4]).alias("disk")) for m in MODELS])
    x = hosts.withColumn("m", F.explode(all_models))
    return x.select("host", F.col("m.id").alias("id"), (F.col("ram_bytes") / GB >= F.col("m.ram")).alias("ram_ok"), (F.col("disk_bytes") / GB >= F.col("m.disk")).alias("disk_ok"))


def mount_prefix(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """paths (path) -> path, free: that of the longest mount that is the path or an ancestor; 0 if there is none.

    Each path offers its ancestors, so the prefix match is an equi-join."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    offered = paths.select("path", F.explode(F.array_distinct(F.transform(steps, lambda p: F.when(p == "", "/").otherwise(p)))).alias("mount"))
    best = Window.partitionBy("path").orderBy(F.desc(F.length("mount")))
    found = offered.join(mounts, "mount").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("path", F.col("free").alias("_free"))
    return paths.join(found, "path", "left").select("path", F.coalesce("_free", F.lit(0.0)).alias("free"))
