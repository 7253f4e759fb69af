"""Named queries over the derived inputs, one for each operator or group of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, chunks, context, decode, detectors, findings, generate, prompts, report, segments, symbols
from ..operators.detectors import Rule
from ..sources import fixtures, patches
from ..sources.rules import EXAMPLES, parse_rules
from . import oracles
from .held import written
from .registry import ORACLES, QUERIES
from .review import review

RULES = [*EXAMPLES, Rule("(?i)licen[sc]e", "License text in a change", "urgent", "legal"), Rule("token = ", "Token in a change", "med", "Security", ("*.go", "*.ts")), Rule("(?=x)", "not usable")]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    if f.__name__ in oracles.SQL:
        ORACLES[f.__name__] = oracles.SQL[f.__name__]
    return f


def lines(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    return segments.segments(fixtures.patches(spark, sf_dir, symbols=named))


@query
def line_kinds(spark, sf_dir):
    return lines(spark, sf_dir).select("patch_id", "pos", "kind")


@query
def file_segments(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("patch_id", "file_seq", "file").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"))


@query
def hunk_starts(spark, sf_dir):
    return lines(spark, sf_dir).where("is_hunk").select("patch_id", "pos", F.col("hunk_seq").cast("bigint").alias("hunk_seq"), "hunk_start")


@query
def new_line_numbers(spark, sf_dir):
    return lines(spark, sf_dir).where("kind = 'added'").select("patch_id", "pos", "new_line")


@query
def files_changed(spark, sf_dir):
    return segments.files_changed(segments.explode_lines(fixtures.patches(spark, sf_dir)))


def _languages(spark, sf_dir):
    return segments.patch_languages(segments.explode_lines(fixtures.patches(spark, sf_dir)))


@query
def patch_languages(spark, sf_dir):
    return _languages(spark, sf_dir).select("patch_id", F.array_join("languages", "|").alias("languages"))


@query
def stack_label(spark, sf_dir):
    return segments.stack_label(_languages(spark, sf_dir))


def _chunk_digest(df):
    return df.select("patch_id", F.col("file_seq").cast("bigint").alias("file_seq"), "part", F.octet_length("chunk").cast("bigint").alias("bytes"), F.md5("chunk").alias("digest"))


@query
def diff_chunks(spark, sf_dir):
    return _chunk_digest(chunks.diff_chunks(lines(spark, sf_dir)))


@query
def diff_chunks_short(spark, sf_dir):
    return _chunk_digest(chunks.diff_chunks(lines(spark, sf_dir), max_lines=7))


@query
def long_line_cut(spark, sf_dir):
    return _chunk_digest(chunks.diff_chunks(lines(spark, sf_dir), max_bytes=100))


def _numbered(spark, sf_dir):
    return chunks.number_chunks(chunks.diff_chunks(lines(spark, sf_dir), max_lines=40))


@query
def chunk_numbering(spark, sf_dir):
    return _numbered(spark, sf_dir).select("patch_id", F.col("file_seq").cast("bigint").alias("file_seq"), "part", "chunk_seq", "total")


PATHS = ("src/a.ts", "node_modules/x.js", "src/node_modules/x.js", "a-lock.json", "x/b-lock.json", "yarn.lock", "x/yarn.lock", "dist/a.js", "build", "x/app.min.js", ".next/x", "a/b.map", "src/auth/d0.ts", "srcs/x.ts")


def _paths(spark, sf_dir):
    own = lines(spark, sf_dir).select(F.col("file").alias("path")).where("path <> ''").distinct()
    return own.unionByName(spark.createDataFrame([(p,) for p in PATHS], "path string"))


@query
def path_excludes(spark, sf_dir):
    return _paths(spark, sf_dir).where(~patches.is_excluded(F.col("path"))).distinct()


@query
def path_includes(spark, sf_dir):
    return _paths(spark, sf_dir).where(patches.is_included(F.col("path"), ("src/src0", "src/a.ts"))).distinct()


@query
def size_guard(spark, sf_dir):
    return patches.guard(fixtures.patches(spark, sf_dir), most_kb=8).select("patch_id", "status")


@query
def empty_guard(spark, sf_dir):
    p = fixtures.patches(spark, sf_dir)
    blank = p.select((F.col("patch_id") + 1_000_000).alias("patch_id"), F.lit(" \t\n").alias("diff"))
    return patches.guard(p.unionByName(blank)).groupBy("status").agg(F.count("*").alias("n"))


def _plain(df):
    return df.select("patch_id", "file", "line", "severity", "category", "issue", "suggested_fix", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@query
def commented_code(spark, sf_dir):
    return _plain(detectors.commented_code(lines(spark, sf_dir)))


@query
def commented_code_sensitive(spark, sf_dir):
    return detectors.commented_code(lines(spark, sf_dir)).groupBy("severity", "category").agg(F.count("*").alias("n"), F.sum("line").alias("line_sum"))


@query
def declared_names(spark, sf_dir):
    return detectors.declared_names(lines(spark, sf_dir)).select("patch_id", "pos", "file", "name")


@query
def removed_still_used(spark, sf_dir):
    return _plain(detectors.removed_still_used(lines(spark, sf_dir)))


@query
def rule_findings(spark, sf_dir):
    return _plain(detectors.rule_findings(lines(spark, sf_dir), RULES))


@query
def rule_glob_matches(spark, sf_dir):
    globs = F.array(*map(F.lit, ("*", "*.ts", "*.test.ts", "d0.ts", "auth/d0.ts", "src/*")))
    x = _paths(spark, sf_dir).distinct().withColumn("spec", F.explode(globs))
    return x.where(detectors.glob_match(F.col("path"), F.col("spec"))).groupBy("spec").agg(F.count("*").alias("n"), F.max("path").alias("last_path"))


@query
def rule_severity_parse(spark, sf_dir):
    x = fixtures.read(spark, sf_dir, "orders").select(F.regexp_extract("o_orderpriority", r"([A-Z]+)", 1).alias("given")).distinct()
    x = x.unionByName(spark.createDataFrame([(s,) for s in ("High", "med", "MEDIUM", "low", "", "security", "Compliance")], "given string"))
    return x.select("given", detectors.rule_severity(F.col("given")).alias("rule_severity"), detectors.rule_category(F.col("given")).alias("rule_category"), findings.parse_threshold(F.col("given")).alias("cli_severity"))


def _tree(spark, sf_dir, later=False):
    return fixtures.source_files(spark, sf_dir, later)


@query
def symbol_candidates(spark, sf_dir):
    found = symbols.candidates(symbols.source_lines(_tree(spark, sf_dir)))
    return found.select("name", "type", "path", F.col("line").cast("bigint").alias("line"), F.col("pattern_ord").cast("bigint").alias("pattern_ord"))


def _symbols(df):
    return df.select("name", "file", F.col("line").cast("bigint").alias("line"), F.md5("snippet").alias("snippet"), "type")


@query
def symbol_index(spark, sf_dir):
    return _symbols(symbols.build_index(_tree(spark, sf_dir)))


@query
def symbol_incremental(spark, sf_dir):
    first = _tree(spark, sf_dir)
    return _symbols(symbols.build_index(_tree(spark, sf_dir, True), symbols.build_index(first), first.select("path", "mtime")))


@query
def symbol_snippets(spark, sf_dir):
    return symbols.build_index(_tree(spark, sf_dir)).select("name", F.octet_length("snippet").cast("bigint").alias("bytes"), F.size(F.split("snippet", "\n")).cast("bigint").alias("n_lines"))


@query
def brace_deltas(spark, sf_dir):
    props = fixtures.read(spark, sf_dir, "events").select("event_id", F.concat("props", F.lit(" { 'x}' \"{"), F.col("event_type"), F.lit("\\\"{\" }")).alias("s"))
    return props.select("event_id", T.brace_delta(F.col("s")).cast("bigint").alias("delta"), T.opens_brace(F.col("s")).alias("opens"))


def _context(spark, sf_dir):
    index = written(symbols.build_index(_tree(spark, sf_dir)))
    found = context.context_symbols(lines(spark, sf_dir, named=True), index)
    return found, context.context_topk(found, 3), index


@query
def context_symbols(spark, sf_dir):
    return _context(spark, sf_dir)[0].select("patch_id", "name", "first_pos")


@query
def context_topk(spark, sf_dir):
    return _context(spark, sf_dir)[1].select("patch_id", "name", F.col("rank").cast("bigint").alias("rank"))


@query
def context_text(spark, sf_dir):
    _, top, index = _context(spark, sf_dir)
    return context.context_text(top, index).select("patch_id", F.octet_length("context").cast("bigint").alias("bytes"), F.md5("context").alias("digest"))


@query
def byte_truncate(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", T.byte_truncate(F.coalesce("text", F.lit("")), 37).alias("cut"))


@query
def review_prompts(spark, sf_dir):
    _, top, index = _context(spark, sf_dir)
    s = written(lines(spark, sf_dir))
    labels = segments.stack_label(segments.patch_languages(s))
    out = prompts.review_prompts(chunks.number_chunks(chunks.diff_chunks(s, max_lines=40)), labels, context.context_text(top, index), fixtures.tickets(spark, sf_dir))
    return out.select("patch_id", "chunk_seq", F.md5("prompt").alias("digest"))


@query
def describe_prompts(spark, sf_dir):
    return prompts.describe_prompts(fixtures.patches(spark, sf_dir), fixtures.tickets(spark, sf_dir)).select("patch_id", F.md5("prompt").alias("digest"))


@query
def commit_prompts(spark, sf_dir):
    return prompts.commit_prompts(fixtures.patches(spark, sf_dir)).select("patch_id", F.md5("prompt").alias("digest"))


@query
def json_complete(spark, sf_dir):
    r = fixtures.responses(spark, sf_dir)
    return r.select("patch_id", "chunk_seq", generate.json_complete(F.col("response")).alias("complete"))


@query
def json_slices(spark, sf_dir):
    return decode.json_slices(fixtures.responses(spark, sf_dir)).select("patch_id", "chunk_seq", "object_slice", "list_slice")


def _decoded(spark, sf_dir):
    return decode.decode_reviews(fixtures.responses(spark, sf_dir))


@query
def decoded_findings(spark, sf_dir):
    x = decode.decoded_findings(_decoded(spark, sf_dir))
    return x.select("patch_id", "chunk_seq", F.col("seq").cast("bigint").alias("seq"), "file", "line", "severity", "category", "issue", "suggested_fix")


@query
def skipped_chunks(spark, sf_dir):
    return decode.skipped_chunks(_decoded(spark, sf_dir))


@query
def generated_reviews(spark, sf_dir):
    """The default generator over all prompts: every chunk is answered, none is skipped."""
    made = generate.generate(prompts.review_prompts(chunks.number_chunks(chunks.diff_chunks(lines(spark, sf_dir), max_lines=40, max_bytes=200)), segments.stack_label(_languages(spark, sf_dir))))
    return decode.decode_reviews(made).groupBy("patch_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("r.status") == "ok").alias("ok"))


def _simple(spark, sf_dir, made):
    events = fixtures.read(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("patch_id"), F.element_at(F.array(*map(F.lit, made)), (F.col("event_id") % len(made) + 1).cast("int")).alias("response"))


DESCRIPTIONS = ('x {"title":"Add it","summary":["a","b"],"test_plan":[]} y', '{"title":5}', '{"summary":["only"]}', "none")
COMMITS = ('{"message":"fix: it","body":""}', '{"body":"b"}', '{"message":"a"} {', "{]")


@query
def pr_decoded(spark, sf_dir):
    x = decode.decode_descriptions(_simple(spark, sf_dir, DESCRIPTIONS))
    return x.select("patch_id", "valid", "title", F.array_join("summary", "|").alias("summary"), F.size("test_plan").cast("bigint").alias("steps"))


@query
def commit_decoded(spark, sf_dir):
    return decode.decode_commits(_simple(spark, sf_dir, COMMITS)).select("patch_id", "valid", "message", "body")


def _all_findings(spark, sf_dir, decoded=None):
    s = written(lines(spark, sf_dir))
    decoded = decode.decoded_findings(_decoded(spark, sf_dir) if decoded is None else decoded)
    return findings.union_findings(detectors.commented_code(s), detectors.removed_still_used(s), detectors.rule_findings(s, RULES), decoded=decoded)


@query
def all_findings(spark, sf_dir):
    return _all_findings(spark, sf_dir).select("patch_id", "seq", "file", "line", "severity", "category", "issue")


@query
def findings_threshold(spark, sf_dir):
    return findings.at_least(_all_findings(spark, sf_dir), "medium").groupBy("patch_id", "severity").agg(F.count("*").alias("n"))


@query
def finding_numbers(spark, sf_dir):
    return findings.number(findings.at_least(_all_findings(spark, sf_dir), "high")).select("patch_id", "seq", "n")


@query
def adjacent_dedup(spark, sf_dir):
    notes = decode.decoded_notes(_decoded(spark, sf_dir), "positives")
    return findings.adjacent_dedup(notes, order=("chunk_seq", "seq")).select("patch_id", "chunk_seq", F.col("seq").cast("bigint").alias("seq"), "text")


@query
def review_gate(spark, sf_dir):
    return findings.review_gate(fixtures.patches(spark, sf_dir), _all_findings(spark, sf_dir), "high")


@query
def review_outcome(spark, sf_dir):
    s = lines(spark, sf_dir)
    gate = findings.review_gate(fixtures.patches(spark, sf_dir), detectors.rule_findings(s, RULES), "high")
    return findings.review_outcome(gate, decode.skipped_chunks(_decoded(spark, sf_dir)))


@query
def report_json(spark, sf_dir):
    decoded = written(_decoded(spark, sf_dir))
    own = findings.at_least(_all_findings(spark, sf_dir, decoded), "medium")
    made = report.report_json(own, decode.decoded_notes(decoded, "positives"), decode.decoded_notes(decoded, "suggestions"))
    parsed = F.from_json("report", "struct<findings:array<struct<file:string,line:bigint,issue:string>>,positives:array<string>,suggestions:array<string>>").alias("p")
    x = made.select("patch_id", parsed)
    return x.select("patch_id", F.size("p.findings").cast("bigint").alias("n_findings"), F.array_join(F.col("p.positives"), "|").alias("positives"), F.size("p.suggestions").cast("bigint").alias("n_suggestions"), F.element_at("p.findings", 1)["issue"].alias("first_issue"))


@query
def wrapped_issue(spark, sf_dir):
    docs = fixtures.read(spark, sf_dir, "documents")
    return docs.select("doc_id", report.wrap_text(F.col("text")).alias("wrapped"))


@query
def finding_text(spark, sf_dir):
    numbered = findings.number(_all_findings(spark, sf_dir))
    return report.finding_text(numbered).select("patch_id", "n", F.md5("block").alias("digest"))


@query
def text_report(spark, sf_dir):
    """The whole report of patches for readers: findings, counts, notes."""
    decoded = written(_decoded(spark, sf_dir))
    every = written(_all_findings(spark, sf_dir, decoded))
    positives, suggestions = (findings.adjacent_dedup(decode.decoded_notes(decoded, n), order=("chunk_seq", "seq")) for n in ("positives", "suggestions"))
    gate = findings.review_gate(fixtures.patches(spark, sf_dir).select("patch_id"), every, "medium")
    made = report.text_report(findings.number(findings.at_least(every, "medium")), positives, suggestions, gate.join(decode.skipped_chunks(decoded), "patch_id", "left"))
    return made.select("patch_id", F.octet_length("report").cast("bigint").alias("bytes"), F.md5("report").alias("digest"))


@query
def whole_review(spark, sf_dir):
    """A whole run with the default generator, which finds nothing: what the detectors find, numbered. Prompts that
    fill the window go without an answer."""
    done = review(fixtures.patches(spark, sf_dir), RULES, threshold="medium", limit_size=False, strict=False)
    return done.findings.select("patch_id", "n", "file", "line", "severity", "category", "issue")


TOML = """
[[rule]]
pattern = "a+"
message = "as"

[[rule]]
pattern = 'b\\d'
message = "bs"
severity = "HIGH"
category = "Security"
files = ["*.py", "b.ts"]
"""


@query
def parsed_rules(spark, sf_dir):
    """The rules of a TOML text, with what is left out filled in."""
    rows = [(i, r.pattern, r.message, r.severity, r.category, "|".join(r.files)) for i, r in enumerate(parse_rules(TOML))]
    return spark.createDataFrame(rows, "n bigint, pattern string, message string, given_severity string, given_category string, files string").select("n", "pattern", "message", detectors.rule_severity(F.col("given_severity")).alias("severity"), detectors.rule_category(F.col("given_category")).alias("category"), "files")


@query
def rule_status(spark, sf_dir):
    return detectors.rule_status(spark, RULES).select("rule_id", F.col("fault").isNotNull().alias("refused"))


@query
def notes_block(spark, sf_dir):
    return report.notes_block(decode.decoded_notes(_decoded(spark, sf_dir), "positives"), "What is good")


@query
def ticket_preview(spark, sf_dir):
    return fixtures.tickets(spark, sf_dir).select("patch_id", report.ticket_preview(F.col("text")).alias("preview"))


@query
def model_lookup(spark, sf_dir):
    ids = fixtures.read(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, ("0.5b", "7b", "13b", "32B", "32b"))), (F.col("n_nationkey") % 5 + 1)).alias("id"), "n_nationkey")
    return catalog.find_model(spark, ids).select("n_nationkey", "id", "name", "size_gb", "file")


@query
def model_requirements(spark, sf_dir):
    hosts = fixtures.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), (F.col("s_suppkey") % 40 * catalog.GB).alias("ram_bytes"), ((F.col("s_suppkey") * 7) % 30 * catalog.GB + 5).alias("disk_bytes"))
    return catalog.model_requirements(spark, hosts)


MOUNTS = (("/", 1.0), ("/src", 2.0), ("/src/src0", 3.0), ("/srcx", 4.0))


@query
def mount_prefix(spark, sf_dir):
    paths = _paths(spark, sf_dir).distinct().select(F.when(F.length("path") % 5 == 0, F.col("path")).otherwise(F.concat(F.lit("/"), "path")).alias("path")).distinct()
    return catalog.mount_prefix(paths, spark.createDataFrame(list(MOUNTS), "mount string, free double"))
