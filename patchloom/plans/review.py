"""Whole runs: review, describe and suggest a commit message, for every patch of a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, context, decode, detectors, findings, generate, prompts, report, segments
from ..sources import patches as sources
from .held import written


@dataclass(frozen=True)
class Review:
    """Results: findings (numbered, at or above the threshold), positives, suggestions, skipped, gate, outcome, report, text
    (the same for readers), answers (each chunk's raw answer and status, to look into what a generator said)."""

    findings: DataFrame
    positives: DataFrame
    suggestions: DataFrame
    skipped: DataFrame
    gate: DataFrame
    outcome: DataFrame
    report: DataFrame
    text: DataFrame
    answers: DataFrame


def static_findings(patches: DataFrame, rules: list[detectors.Rule] | None = None, limit_size: bool = True, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """What the detectors find, without a generator; the three share one frame of lines, which keep holds.

    Unless limit_size is off, patches too large for one task's window are left out, as review() does."""
    guarded = sources.guard(patches).where("status <> 'too_large'" if limit_size else "true").drop("status")
    lines = keep(segments.segments(guarded))
    return findings.union_findings(detectors.commented_code(lines), detectors.removed_still_used(lines), detectors.rule_findings(lines, rules or []))


def review(
    patches: DataFrame,
    rules: list[detectors.Rule] | None = None,
    symbols: DataFrame | None = None,
    tickets: DataFrame | None = None,
    languages: DataFrame | None = None,
    make_generator: Callable[[], generate.Generator] = generate.silent,
    threshold: str = "low",
    max_lines: int = chunks.MAX_LINES,
    most_tokens: int = 1024,
    limit_size: bool = True,
    strict: bool = True,
    keep: Callable[[DataFrame], DataFrame] = written,
) -> Review:
    """patches (patch_id, diff) -> Review. Blank patches and, unless limit_size is off, too large ones are left out.

    symbols: an index for context. tickets (patch_id, text): requirements. languages (patch_id, prompt_label): instead of
    the detected ones. strict: whether a prompt that fills the window ends the run; else its chunk is skipped. keep: how to hold the shared lines and the generator's answers, which are made once, between uses."""
    guarded = sources.guard(patches).where("status = 'ok'" if limit_size else "status <> 'empty'").drop("status")
    lines = keep(segments.segments(guarded))
    labels = languages if languages is not None else segments.stack_label(segments.patch_languages(lines))
    context_of = context.context_text(context.context_topk(context.context_symbols(lines, symbols)), symbols) if symbols is not None else None
    made = prompts.review_prompts(chunks.number_chunks(chunks.diff_chunks(lines, max_lines)), labels, context_of, tickets)
    answered = decode.decode_reviews(generate.generate(made, make_generator, most_tokens, strict=strict))
    decoded = keep(answered if strict else decode.unanswered(answered))
    every = findings.union_findings(detectors.commented_code(lines), detectors.removed_still_used(lines), detectors.rule_findings(lines, rules or []), decoded=decode.decoded_findings(decoded))
    shown = findings.number(findings.at_least(every, threshold))
    positives, suggestions = (findings.adjacent_dedup(decode.decoded_notes(decoded, n), order=("chunk_seq", "seq")) for n in ("positives", "suggestions"))
    skipped = decode.skipped_chunks(decoded)
    gate = findings.review_gate(guarded, every, threshold)
    text = report.text_report(shown, positives, suggestions, gate.join(skipped, "patch_id", "left"))
    answers = decoded.select(*[c for c in decoded.columns if c != "r"], F.col("r.status").alias("status"))
    return Review(shown, positives, suggestions, skipped, gate, findings.review_outcome(gate, skipped), report.report_json(shown, positives, suggestions), text, answers)


def describe(patches: DataFrame, tickets: DataFrame | None = None, make_generator: Callable[[], generate.Generator] = generate.silent) -> DataFrame:
    """patch_id, valid, title, summary, test_plan: one answer for each patch, which is cut and not chunked."""
    return decode.decode_descriptions(generate.generate(prompts.describe_prompts(patches, tickets), make_generator, 768))


def suggest_commit(patches: DataFrame, make_generator: Callable[[], generate.Generator] = generate.silent) -> DataFrame:
    """patch_id, valid, message, body."""
    return decode.decode_commits(generate.generate(prompts.commit_prompts(patches), make_generator, 512))


def write_findings(found: DataFrame, path: str) -> None:
    found.select("patch_id", "seq", "file", "line", "severity", "category", "issue", "suggested_fix", F.col("confidence")).write.mode("overwrite").parquet(path)
