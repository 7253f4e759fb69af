"""Symbols, context, decoding, findings, sources, whole runs, and every query against its SQL."""

import json
import os
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from patchloom.operators import catalog, context, decode, findings, generate, report, segments, symbols
from patchloom.operators.detectors import Rule
from patchloom.plans import held, registry, review
from patchloom.sources import patches, rules, trees
from patchloom.streaming import watch

SF = "/root/testdata/sf0.001"
FILE = "path string, mtime double, content string"
ITEM = '{"file":"a","line":1,"severity":"%s","category":"quality","issue":"i","suggested_fix":"f"}'


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_definition_wins(spark):
    files = spark.createDataFrame([("b.ts", 1.0, "export class A {\n}\nexport const x = 1"), ("a.py", 1.0, "def A(x):\n  pass\nclass B:")], FILE)
    assert rows(symbols.build_index(files), "name", "file", "line", "type") == [("A", "a.py", 1, "function"), ("B", "a.py", 3, "class"), ("x", "b.ts", 3, "const")]


def test_index_keeps_what_it_holds_and_loses_what_a_gone_file_held(spark):
    old = spark.createDataFrame([("A", "a.ts", 1, "old", "class"), ("G", "gone.ts", 1, "old", "class")], symbols.SYMBOL)
    state = spark.createDataFrame([("a.ts", 1.0), ("gone.ts", 1.0), ("same.ts", 5.0)], symbols.FILE_STATE)
    files = spark.createDataFrame([("a.ts", 2.0, "x\nexport class A {}\nexport class G {}\nexport class N {}"), ("same.ts", 5.0, "export class Never {}")], FILE)
    assert rows(symbols.build_index(files, old, state), "name", "line", "snippet") == [("A", 1, "old"), ("N", 4, "export class N {}")]
    assert rows(symbols.build_index(files, old, state, refresh=True), "name", "line") == [("A", 2), ("N", 4)]


def test_snippets(spark):
    body = "export function f() {\n  if (a) { '}' }\n  \"{\"\n}\nafter\nexport const open = 1\n" + "x\n" * 60
    got = dict(rows(symbols.build_index(spark.createDataFrame([("a.ts", 1.0, body)], FILE)), "name", "snippet"))
    assert got["f"].endswith("}") and got["f"].count("\n") == 3 and got["open"].count("\n") == 39


def test_saved_index(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    assert [d.count() for d in symbols.load_index(spark, at)] == [0, 0]
    s, f = spark.createDataFrame([("A", "a.ts", 1, "s", "class")], symbols.SYMBOL), spark.createDataFrame([("a.ts", 1.0)], symbols.FILE_STATE)
    symbols.save_index(s, f, at)
    back, state = symbols.load_index(spark, at)
    symbols.save_index(back.withColumn("line", F.lit(2)), state, at)
    assert rows(symbols.load_index(spark, at)[0], "name", "line") == [("A", 2)]


def test_context_stops_at_the_first_entry_over_budget(spark):
    names = spark.createDataFrame([(n, "f", 1, s, "class") for n, s in (("A", "a"), ("B", "b" * 3000), ("C", "c"))], symbols.SYMBOL)
    s = segments.segments(spark.createDataFrame([(1, "+A B C if"), (2, "-A"), (3, "+++ A")], "patch_id long, diff string"))
    top = context.context_topk(context.context_symbols(s, names))
    assert rows(top, "patch_id", "name", "rank") == [(1, "A", 1), (1, "B", 2), (1, "C", 3)]
    assert rows(context.context_text(top, names), "patch_id", "context") == [(1, "\n--- Arch Reference: A (from f) ---\na\n")]


@pytest.mark.parametrize(
    ("text", "status", "n"),
    [
        ('{"findings":[' + ITEM % "high" + "]}", "ok", 1),
        ("[" + ITEM % "high" + "]", "ok", 0),
        ("[" + ITEM % "high" + "," + ITEM % "low" + "]", "ok", 2),
        ('x {"other": 1} y', "ok", 0),
        ('{"findings":[' + ITEM % "high" + '],"positives":["cut', "ok", 1),
        ('{"findings":[' + ITEM % "High" + "]}", "bad_json", 0),
        ('{"findings":[' + (ITEM % "high").replace('"line":1', '"line":1.0') + "]}", "bad_json", 0),
        ('{"findings":[' + (ITEM % "high").replace('"line":1', '"line":-1') + "]}", "bad_json", 0),
        ('{"findings": [', "no_json", 0),
        ("nothing", "no_json", 0),
        (None, "no_json", 0),
        ("[1]", "bad_json", 0),
        ('{"findings": NaN}', "no_json", 0),
    ],
)
def test_decoding(text, status, n):
    got = decode.review(text)
    assert (got["status"], len(got["findings"])) == (status, n)


@pytest.mark.parametrize(("text", "want"), [("{}", True), ("  [1, [2]]x", True), ('{"a": "}"', False), ('{"a": "\\"}"}', True), ("```{}", False), ("[{]", True), ("", False), ("{]", False)])
def test_complete_answers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(generate.json_complete(F.col("t")).alias("c")).first().c is want


def test_window_is_fatal(spark):
    df = spark.createDataFrame([(1, "x" * 20_000)], "patch_id long, prompt string")
    with pytest.raises(Exception, match="exceeds the window"):
        generate.generate(df).collect()


def test_window_of_one_patch_alone(spark):
    """A chunk that fills the window is skipped if that is asked for; other patches are reviewed as ever."""
    def diff(n, text):
        return f"diff --git a/{n}.py b/{n}.py\n--- a/{n}.py\n+++ b/{n}.py\n@@ -0,0 +1,20 @@\n" + f"+{text}\n" * 20

    df = spark.createDataFrame([(1, diff("a", "x" * 1_000)), (2, diff("b", "TODO"))], "patch_id long, diff string")
    got = review.review(df, list(rules.EXAMPLES), strict=False)
    assert sorted((r.patch_id, r.status) for r in got.answers.collect()) == [(1, "unanswered"), (2, "ok")]
    assert sorted((r.patch_id, r.skipped) for r in got.skipped.collect()) == [(1, 1), (2, 0)]
    assert sorted((r.patch_id, r.outcome) for r in got.outcome.collect()) == [(1, "skipped"), (2, "findings")]


def test_held_tables_go_with_their_scope(spark):
    df = spark.range(3)
    outside = held.written(df)
    with held.held_within():
        inside = held.written(df)
        paths = [f.removeprefix("file://") for f in inside.inputFiles()]
        assert inside.count() == 3 and all(map(os.path.exists, paths))
    assert not any(map(os.path.exists, paths)) and outside.count() == 3


def test_static_findings_leave_out_what_is_too_large(spark):
    diff = "diff --git a/a.py b/a.py\n@@ -0,0 +1 @@\n+TODO\n"
    df = spark.createDataFrame([(1, diff), (2, diff + "+x\n" * 600_000), (3, None)], "patch_id long, diff string")
    found = lambda **o: sorted(r.patch_id for r in review.static_findings(df, [Rule("TODO", "todo")], **o).collect())
    assert found() == [1] and found(limit_size=False) == [1, 2]


def test_adjacent_duplicates(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "a", "a", None, None])], "patch_id long, seq int, text string")
    assert [r.text for r in findings.adjacent_dedup(df).orderBy("seq").collect()] == ["a", "b", "a", None]


def test_thresholds(spark):
    df = spark.createDataFrame([("HIGH",), ("med",), ("Medium",), ("x",)], "t string")
    assert [r.x for r in df.select(findings.parse_threshold(F.col("t")).alias("x")).collect()] == ["high", "low", "medium", "low"]


def test_wrapping(spark):
    text = "aa bb " + "c" * 80 + " dd"
    got = spark.createDataFrame([(text,), ("",), ("  ",)], "t string").select(report.wrap_text(F.col("t"), 2, 10).alias("x")).collect()
    assert [r.x for r in got] == ["  aa bb\n  " + "c" * 80 + "\n  dd", "", ""]


def test_sources(spark, tmp_path):
    (tmp_path / "p1.diff").write_text("diff --git a/x b/x\n+y\n")
    assert rows(patches.read_patches(spark, str(tmp_path)), "diff") == [("diff --git a/x b/x\n+y\n",)]
    (tmp_path / "rules.toml").write_text('[[rule]]\npattern = "a"\nmessage = "m"\nfiles = ["*.ts"]\n')
    assert rules.load_rules(str(tmp_path / "rules.toml")) == [Rule("a", "m", "medium", "quality", ("*.ts",))]
    assert rules.load_rules(str(tmp_path / "none.toml")) == []
    (tmp_path / "rules.toml").write_text("[[rule]\n")
    with pytest.warns(UserWarning):
        assert rules.load_rules(str(tmp_path / "rules.toml")) == []
    assert patches.resolve_ticket("some text") == "some text" and patches.resolve_ticket(str(tmp_path / "p1.diff")).startswith("diff")


def test_tree(spark, tmp_path):
    for name in ("a.py", "sub/b.ts", "node_modules/c.js", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("def f(x):\n")
    got = trees.source_tree(spark, str(tmp_path))
    assert rows(got, "path", "content") == [("a.py", "def f(x):\n"), ("sub/b.ts", "def f(x):\n")]
    state = got.select("path", "mtime")
    assert symbols.changed_files(got, state).count() == 0


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for text in ("one\n", "two\n"):
        (tmp_path / "a.py").write_text(text)
        (tmp_path / "yarn.lock").write_text(text)
        git("add", ".")
        git("commit", "-qm", "c")
    diff = patches.git_patch(spark, str(tmp_path)).first()["diff"]
    assert "+two" in diff and "yarn.lock" not in diff and patches.current_branch(str(tmp_path)) == "main"
    with pytest.raises(ValueError, match="staged"):
        patches.git_patch(spark, str(tmp_path), staged=True)
    with pytest.raises(RuntimeError):
        patches.git_patch(spark, str(tmp_path), branch="none")


def test_guards(spark):
    df = spark.createDataFrame([(1, ""), (2, " \t\n"), (3, "x"), (4, "y" * 1025 * 3)], "patch_id long, diff string")
    assert rows(patches.guard(df, 2), "patch_id", "status") == [(1, "empty"), (2, "empty"), (3, "ok"), (4, "too_large")]


def test_mounts(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/ab",), ("x/y",), ("/",)], "path string")
    mounts = spark.createDataFrame([("/", 1.0), ("/a", 2.0), ("/a/b", 3.0)], "mount string, free double")
    assert rows(catalog.mount_prefix(paths, mounts), "path", "free") == [("/", 1.0), ("/a/b/c", 3.0), ("/ab", 1.0), ("x/y", 0.0)]


def test_whole_run(spark):
    diff = "diff --git a/src/auth.ts b/src/auth.ts\n@@ -1,3 +1,4 @@\n-a1\n-b1\n-c1\n+// a1\n+// b1\n+// c1\n+foo() // TODO\n"
    p = spark.createDataFrame([(1, diff), (2, "  "), (3, "diff --git a/x.py b/x.py\n+ok\n")], "patch_id long, diff string")
    names = spark.createDataFrame([("foo", "f.ts", 1, "function foo() {}", "function")], symbols.SYMBOL)

    def make():
        seen = json.dumps({"findings": [], "positives": ["good", "good"], "suggestions": []})
        return lambda prompt, most: seen if "Arch Reference: foo" in prompt else "no"

    got = review.review(p, [Rule("TODO", "todo", "low")], names, spark.createDataFrame([(1, "must work")], "patch_id long, text string"), make_generator=make, threshold="medium")
    assert rows(got.findings, "patch_id", "n", "severity", "line") == [(1, 1, "high", 1)]
    assert rows(got.positives, "patch_id", "text") == [(1, "good")]
    assert rows(got.gate, "patch_id", "findings", "exit_code") == [(1, 1, 1), (3, 0, 0)]
    assert rows(got.outcome, "patch_id", "outcome") == [(1, "findings"), (3, "clean")]
    report_of = json.loads(got.report.where("patch_id = 1").first().report)
    assert [f["category"] for f in report_of["findings"]] == ["security"] and report_of["positives"] == ["good"]
    assert review.describe(p).count() == 3 and rows(review.suggest_commit(p), "valid") == [(True,)] * 3


def test_a_generator_runs_once_for_each_chunk(spark, tmp_path):
    """All results come from the same answers; half a surrogate pair is no answer and stops nothing."""
    seen = str(tmp_path)

    def make():
        def answer(prompt, most):
            import os
            import uuid

            open(os.path.join(seen, uuid.uuid4().hex), "w").close()
            if "broken" in prompt:
                return '{"findings": [], "positives": ["\\ud800"]}'
            return '{"findings": [{"file": "a", "line": 1, "severity": "high", "category": "security", "issue": "i", "suggested_fix": "f"}], "positives": ["good"], "suggestions": ["more"]}'

        return answer

    p = spark.createDataFrame([(1, "diff --git a/a b/a\n@@ -0,0 +1 @@\n+fine\n"), (2, "diff --git a/a b/a\n@@ -0,0 +1 @@\n+broken\n")], "patch_id long, diff string")
    got = review.review(p, make_generator=make)
    for df in (got.findings, got.positives, got.suggestions, got.skipped, got.gate, got.outcome, got.report, got.text, got.answers):
        df.collect()
    assert len(os.listdir(seen)) == 2
    assert rows(got.outcome, "patch_id", "outcome") == [(1, "findings"), (2, "skipped")]
    assert rows(got.answers, "patch_id", "status") == [(1, "ok"), (2, "bad_json")]
    text = {r.patch_id: r.report for r in got.text.collect()}
    assert "security  a:1 [#1]" in text[1] and "  1 finding\n" in text[1] and "     ·  good\n" in text[1] and text[1].endswith("     ·  more\n")
    assert text[2] == "  No answer could be read, 1 chunk skipped\n"


def test_reviews_as_they_come(spark, tmp_path):
    from patchloom.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.diff").write_text("diff --git a/x.py b/x.py\n@@ -0,0 +1 @@\n+breakpoint()\n")
    found = []
    watch.watch_reviews(watch.patch_stream(spark, str(tmp_path / "in")), str(tmp_path / "c"), lambda done, n: found.append((n, done.findings.count(), done.gate.first().exit_code)), rules=list(rules.EXAMPLES)).awaitTermination(60)
    assert found == [(0, 1, 1)]


def test_an_incremental_scan_opens_changed_files_alone(spark, tmp_path):
    for name, raw in (("a.py", b"one"), ("b.py", b"tw\xffo"), ("target/c.py", b"x"), (".own/d.py", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    own = (*trees.IGNORED, ".own")
    first = trees.source_tree(spark, str(tmp_path), ignored=own)
    assert rows(first, "path", "content") == [("a.py", "one"), ("b.py", "tw\ufffdo")]
    state = spark.createDataFrame(first.select("path", "mtime").collect())
    os.utime(tmp_path / "a.py", (1, 1))
    assert rows(trees.source_tree(spark, str(tmp_path), state, own), "path", "content") == [("a.py", "one"), ("b.py", None)]
    assert {r.content for r in trees.source_tree(spark, str(tmp_path), trees.listing(spark, str(tmp_path), own), own).collect()} == {None}


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.diff").write_text("diff --git a/x.ts b/x.ts\n@@ -1 +4,1 @@\n+TODO\n")
    stream = watch.patch_stream(spark, str(tmp_path / "in"))
    watch.watch(stream, str(tmp_path / "out"), str(tmp_path / "check"), [Rule("TODO", "m")]).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "file", "line", "issue") == [("x.ts", 4, "m")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
