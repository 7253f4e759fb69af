"""The generator stage: any callable from a prompt to text, made once for each partition, or a table of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROMPT_TOKENS = 4096
Generator = Callable[[str, int], str]


def silent() -> Generator:
    """The default generator: it finds nothing, always."""
    return lambda prompt, most: '{"findings": [], "positives": [], "suggestions": []}'


def generate(prompts: DataFrame, make: Callable[[], Generator] = silent, most_tokens: int = 1024, count: Callable[[str], int] = lambda s: -(-len(s.encode()) // 4), strict: bool = True) -> DataFrame:
    """prompts (keys, prompt) -> keys, response. A prompt that fills the window is fatal, or, if not strict, has a
    null response, so that one patch of a table doesn't end the run for all; output is cut to what is left.

    `make` runs once in each partition, so a model is loaded once. An answer may end where json_complete holds."""
    keys = [c for c in prompts.columns if c != "prompt"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            out = []
            for p in f["prompt"]:
                n = count(p)
                if n >= PROMPT_TOKENS and strict:
                    raise ValueError(f"a prompt of {n} tokens exceeds the window of {PROMPT_TOKENS}")
                out.append(model(p, min(most_tokens, PROMPT_TOKENS - n)) if n < PROMPT_TOKENS else None)
            yield f[keys].assign(response=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema if f.name != "prompt")
    return prompts.mapInPandas(run, f"{kinds}, response string")


def json_complete(text):
    """Whether the text, from its first non-space, is a bracketed value of which that kind of bracket is closed again.

    Strings are taken out first; then the least running depth at a closing bracket tells."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    bare = F.regexp_replace(t, r"(?s)\"(?:\\.|[^\"\\])*(?:\"|\\?\z)", "")

    def closed(first: str, last: str):
        marks = F.regexp_extract_all(bare, F.lit(f"([{first}{last}])"), F.lit(1))
        return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(False).alias("done")), lambda s, c: F.struct((s["d"] + F.when(c == F.lit(last[-1]), -1).otherwise(1)).alias("d"), (s["done"] | ((c == F.lit(last[-1])) & (s["d"] == 1))).alias("done")))["done"]

    return F.when(t.startswith("{"), closed("{", "}")).when(t.startswith("["), closed(r"\[", r"\]")).otherwise(False)
