"""Strict decoding of a generator's answers; JSON functions of the engine are too lenient, so this is an Arrow UDF."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("high", "medium", "low")
CATEGORIES = ("security", "quality", "performance", "maintainability", "compliance")
ITEM = "struct<file:string,line:bigint,severity:string,category:string,issue:string,suggested_fix:string,confidence:float>"
REVIEW = f"struct<status:string,findings:array<{ITEM}>,positives:array<string>,suggestions:array<string>>"
EMPTY: dict = {"findings": [], "positives": [], "suggestions": []}


class Mismatch(ValueError):
    pass


def _no_constant(name: str):
    raise Mismatch(name)


def _pairs(items):
    out = {}
    for k, v in items:
        if k in out and k in ("file", "line", "severity", "category", "issue", "suggested_fix", "confidence", *EMPTY):
            raise Mismatch(f"duplicate field {k}")
        out[k] = v
    return out


def parse(text: str):
    out = json.loads(text, parse_constant=_no_constant, object_pairs_hook=_pairs)
    if "\\ud" in text.lower():
        json.dumps(out, ensure_ascii=False).encode()  # half of a surrogate pair is no text: a ValueError
    return out


def _text(v) -> str:
    if not isinstance(v, str):
        raise Mismatch("not a string")
    return v


def _texts(v) -> list[str]:
    if not isinstance(v, list):
        raise Mismatch("not a list")
    return [_text(x) for x in v]


def finding(v) -> dict:
    if not isinstance(v, dict):
        raise Mismatch("not an object")
    line, confidence = v.get("line"), v.get("confidence")
    if isinstance(line, bool) or not isinstance(line, int) or not 0 <= line <= 4294967295:
        raise Mismatch("line")
    if v.get("severity") not in SEVERITIES or v.get("category") not in CATEGORIES:
        raise Mismatch("severity or category")
    if confidence is not None and (isinstance(confidence, bool) or not isinstance(confidence, (int, float))):
        raise Mismatch("confidence")
    return {"file": _text(v.get("file")), "line": line, "severity": v["severity"], "category": v["category"], "issue": _text(v.get("issue")), "suggested_fix": _text(v.get("suggested_fix")), "confidence": None if confidence is None else float(confidence)}


def findings(v) -> list[dict]:
    if not isinstance(v, list):
        raise Mismatch("not a list")
    return [finding(x) for x in v]


def outer(text: str, first: str, last: str) -> str | None:
    a, b = text.find(first), text.rfind(last)
    return text[a : b + 1] if 0 <= a < b else None


def review(text: str | None) -> dict:
    """status ok, no_json (an empty success) or bad_json (the chunk is skipped).

    The outermost object counts first, also if it is a single finding in a list, which then reads as an empty review;
    then the outermost list, of findings."""
    text = text or ""
    piece = outer(text, "{", "}")
    if piece is not None:
        try:
            v = parse(piece)
            if isinstance(v, dict):
                return {"status": "ok", "findings": findings(v.get("findings", [])), "positives": _texts(v.get("positives", [])), "suggestions": _texts(v.get("suggestions", []))}
        except (ValueError, RecursionError):
            pass
    piece = outer(text, "[", "]")
    if piece is None:
        return {"status": "no_json", **EMPTY}
    try:
        return {"status": "ok", **EMPTY, "findings": findings(parse(piece))}
    except (ValueError, RecursionError):
        return {"status": "bad_json", **EMPTY}


def fields(text: str | None, names: dict[str, type]) -> dict | None:
    """An object's fields with defaults, for descriptions and commit messages; null if it is no such object."""
    piece = outer(text or "", "{", "}")
    if piece is None:
        return None
    try:
        v = parse(piece)
        return {n: (_texts if kind is list else _text)(v.get(n, kind())) for n, kind in names.items()} if isinstance(v, dict) else None
    except (ValueError, RecursionError):
        return None


def decode_reviews(responses: DataFrame) -> DataFrame:
    """responses (..., response) with r: status, findings, positives, suggestions."""

    @F.pandas_udf(REVIEW)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([review(x) for x in s], columns=["status", "findings", "positives", "suggestions"])

    return responses.withColumn("r", run("response"))


def decoded_findings(decoded: DataFrame) -> DataFrame:
    """patch_id, chunk_seq, seq (from 0) and the fields of each finding."""
    return decoded.select("patch_id", "chunk_seq", F.posexplode("r.findings").alias("seq", "f")).select("patch_id", "chunk_seq", "seq", "f.*")


def decoded_notes(decoded: DataFrame, which: str) -> DataFrame:
    """patch_id, chunk_seq, seq, text of `positives` or `suggestions`."""
    return decoded.select("patch_id", "chunk_seq", F.posexplode(f"r.{which}").alias("seq", "text"))


def unanswered(decoded: DataFrame) -> DataFrame:
    """decoded, in which a chunk without a response, as of a prompt that fills the window, is no empty success but unanswered."""
    return decoded.withColumn("r", F.col("r").withField("status", F.when(F.col("response").isNull(), "unanswered").otherwise(F.col("r.status"))))


def skipped_chunks(decoded: DataFrame) -> DataFrame:
    """patch_id, skipped: how many chunks have no answer or one that can't be read."""
    return decoded.groupBy("patch_id").agg(F.count_if(F.col("r.status").isin("bad_json", "unanswered")).alias("skipped"))


def decode_descriptions(responses: DataFrame) -> DataFrame:
    """title, summary and test_plan of each response; valid tells whether it was such an object."""
    return _decode(responses, "struct<valid:boolean,title:string,summary:array<string>,test_plan:array<string>>", {"title": str, "summary": list, "test_plan": list})


def decode_commits(responses: DataFrame) -> DataFrame:
    return _decode(responses, "struct<valid:boolean,message:string,body:string>", {"message": str, "body": str})


def _decode(responses: DataFrame, kind: str, names: dict[str, type]) -> DataFrame:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        got = [fields(x, names) for x in s]
        return pd.DataFrame([{"valid": g is not None, **(g or {n: k() for n, k in names.items()})} for g in got], columns=["valid", *names])

    return responses.withColumn("r", run("response")).select(*[c for c in responses.columns if c != "response"], "r.*")


def json_slices(responses: DataFrame) -> DataFrame:
    """The outermost object and list of each response; null where there is none."""
    r = F.col("response")

    def cut(first: str, last: str):
        a = F.instr(r, first)
        b = F.length(r) - F.instr(F.reverse(r), last) + 1
        return F.when((a > 0) & (F.instr(r, last) > 0) & (b > a), F.substring(r, a, b - a + 1))

    return responses.select(*[c for c in responses.columns if c != "response"], cut("{", "}").alias("object_slice"), cut("[", "]").alias("list_slice"))
