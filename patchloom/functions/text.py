"""Text primitives as column expressions: line splitting, trimming, byte budgets, numbers, string literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U32 = 4294967295
#: Quoted strings up to the closing quote or the end of the line, escapes included.
LITERAL = r"\"(?:\\.|[^\"\\])*(?:\"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|`(?:\\.|[^`\\])*(?:`|\\?$)"


def lines(text: Column) -> Column:
    """An array of lines: ends are LF or CRLF, a final end adds no line, an empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def byte_truncate(text: Column, most: int) -> Column:
    """At most `most` bytes, cut back to a character's boundary."""
    raw = F.encode(text, "utf-8")
    cut = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, max(0, most - 4), -1)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cut, F.lit("")))


def piece(text: Column, separator: str, n: int) -> Column:
    """The n-th piece between separators (a pattern), null if there are fewer."""
    return F.try_element_at(F.split(text, separator), F.lit(n))


def u32_or_one(text: Column) -> Column:
    """A whole unsigned 32-bit number, else 1."""
    value = F.when(text.rlike(r"^\+?[0-9]+$"), F.expr("try_cast(1 as bigint)") * text.try_cast("bigint"))
    return F.when(value.between(0, MAX_U32), value).otherwise(F.lit(1)).cast("bigint")


def brace_delta(line: Column) -> Column:
    bare = F.regexp_replace(line, LITERAL, "")
    return (F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))).cast("int")


def opens_brace(line: Column) -> Column:
    return F.regexp_replace(line, LITERAL, "").contains("{")


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
