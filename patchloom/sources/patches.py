"""Where patches come from: files, a git repository, a table; and the guards on the way in."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MOST_KB = 1500
#: Paths that reviews leave out, as git pathspecs. Without a wildcard a name is anchored at the root.
EXCLUDED = ("node_modules", "*-lock.json", "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "dist", "build", ".next", ".cache", "*.map", "*.min.js", "*.min.css")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """One patch for each file: patch_id (a hash of its path) and diff."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("patch_id"), F.col("value").alias("diff"))


def _git(repository: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repository, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


def git_patch(spark: SparkSession, repository: str, branch: str | None = None, paths: tuple[str, ...] = (), staged: bool = False) -> DataFrame:
    """A one-row table of a repository's difference: to a branch, of the last commit, or staged.

    A staged difference must not be blank and has no size limit; the others are refused above MOST_KB."""
    what = ["--cached"] if staged else [f"{branch}...HEAD" if branch else "HEAD~1..HEAD"]
    diff = _git(repository, "diff", *what, "--", *paths, *(f":(exclude){p}" for p in EXCLUDED))
    if staged and not diff.strip():
        raise ValueError("nothing is staged")
    if not staged and len(diff.encode()) // 1024 > MOST_KB:
        raise ValueError(f"the difference is larger than {MOST_KB} KB")
    return spark.createDataFrame([(0, diff)], "patch_id bigint, diff string")


def current_branch(repository: str) -> str | None:
    try:
        name = _git(repository, "rev-parse", "--abbrev-ref", "HEAD").strip()
    except RuntimeError:
        return None
    return None if name in ("", "HEAD") else name


def guard(patches: DataFrame, most_kb: int = MOST_KB) -> DataFrame:
    """Adds status: too_large, empty or ok."""
    size = F.floor(F.octet_length("diff") / 1024)
    return patches.withColumn("status", F.when(size > most_kb, "too_large").when(F.length(T.trim(F.col("diff"))) == 0, "empty").otherwise("ok"))


def _pattern(spec: str) -> str:
    body = "".join(".*" if c == "*" else c if c.isalnum() or c in "_-/" else "[.]" if c == "." else f"[{c}]" for c in spec)
    return f"^{body}$" if "*" in spec else f"^{body}(/.*)?$"


def is_excluded(path, specs: tuple[str, ...] = EXCLUDED):
    return path.rlike("|".join(_pattern(s) for s in specs))


def is_included(path, prefixes: tuple[str, ...]):
    """Whether a path is one of the given files or lies below one of the given folders; none given: all."""
    out = F.lit(not prefixes)
    for p in prefixes:
        p = p.rstrip("/")
        out = out | (path == p) | path.startswith(f"{p}/")
    return out


def resolve_ticket(given: str | None) -> str | None:
    """A path's contents, or the text itself; an unreadable file is no ticket."""
    if given is None or not os.path.exists(given):
        return given
    try:
        with open(given, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None
