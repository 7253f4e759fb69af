"""Lines, chunks and detectors: golden cases, and random malformed patches against the plain model."""

import random

import pytest
from pyspark.sql import functions as F

import model
from patchloom.functions import text as T
from patchloom.operators import chunks, detectors, segments
from patchloom.operators.detectors import Rule

HEAD = "diff --git a/src/foo.js b/src/foo.js\nindex 1..2 100644\n--- a/src/foo.js\n+++ b/src/foo.js\n"


def seg(spark, *diffs):
    return segments.segments(spark.createDataFrame(list(enumerate(diffs)), "patch_id long, diff string"))


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lines(spark):
    for text, want in (("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])):
        got = spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t")).alias("x")).first().x
        assert got == want == model.lines(text)


@pytest.mark.parametrize(
    ("diff", "most", "want"),
    [
        ("line1\nline2\nline3\nline4\nline5", 2, ["line1\nline2\n", "line3\nline4\n", "line5\n"]),
        ("diff --git a/file1.js b/file1.js\n+a\ndiff --git a/file2.js b/file2.js\n+b", 100, ["diff --git a/file1.js b/file1.js\n+a\n", "diff --git a/file2.js b/file2.js\n+b\n"]),
        ("", 10, []),
        ("only one line", 10, ["only one line\n"]),
    ],
)
def test_chunks(spark, diff, most, want):
    got = chunks.diff_chunks(seg(spark, diff), most).orderBy("file_seq", "part").collect()
    assert [r.chunk for r in got] == want


def test_long_lines_are_cut_at_a_character(spark):
    got = [r.chunk for r in chunks.diff_chunks(seg(spark, "a" * 2049, "a" * 2047 + "é", "a" * 2048)).orderBy("patch_id").collect()]
    assert got == ["a" * 2048 + "... [line truncated]\n", "a" * 2047 + "... [line truncated]\n", "a" * 2048 + "\n"]


def test_hunk_starts_are_parsed_twice(spark):
    rows = seg(spark, HEAD + "@@ -1 +7 @@\n+x\n context\n+y").where("kind = 'added'").orderBy("pos").collect()
    assert [(r.hunk_start, r.new_line) for r in rows] == [(1, 7), (1, 9)]


def test_lost_lines_and_kept_files(spark):
    rows = seg(spark, "diff --git a/x b/x\n+++i\n--- x\ndiff --git nothing\n+z").orderBy("pos").collect()
    assert [r.kind for r in rows] == ["header", "context", "context", "header", "added"] and rows[-1].file == "x"


def test_reindented_block_counts_as_commented_out(spark):
    s = seg(spark, HEAD + "@@ -1,3 +1,3 @@\n-a\n-b\n-c\n+  a\n+  b\n+  c")
    assert found(detectors.commented_code(s), "file", "line", "severity") == [("src/foo.js", 1, "medium")]


@pytest.mark.parametrize(("hits", "n"), [(3, 1), (2, 0)])
def test_sixty_percent(spark, hits, n):
    body = "".join(f"-l{i}\n" for i in range(5)) + "".join(f"+// l{i}\n" for i in range(hits))
    assert detectors.commented_code(seg(spark, HEAD + "@@ -1 +1 @@\n" + body)).count() == n


def test_commented_out_before_any_hunk_is_line_zero(spark):
    assert found(detectors.commented_code(seg(spark, "diff --git a/x b/auth.c\n-a1\n-b1\n-c1\n+//a1\n+/*b1\n+// c1")), "line", "category") == [(0, "security")]


def test_declarations(spark):
    cases = {"const foo = 1": "foo", "  let mut x = 2": "mut", "var $a": "$a", "def f(x):": "f", "a, err := g()": "err", "export const x": None, "let {a} = b": None, "x = y := z": "y", ") := 3": None, "const": None}
    df = spark.createDataFrame(list(cases.items()), "l string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", detectors.declared_name(F.col("l"))).collect())


def test_removed_names(spark):
    own = lambda d: found(detectors.removed_still_used(seg(spark, d)), "line", "issue")
    assert [x[0] for x in own(HEAD + "@@ -1 +1 @@\n-const foo = 1")] == [4]  # the path in the header is a use
    assert len(own("diff --git a/a b/a\n@@ -1 +5,1 @@\n-const x = 1\n+const x = 2")) == 1
    assert [x[0] for x in own("diff --git a/a b/a\n@@ -1 +5,1 @@\n-const x = 1\n x")] == [5]
    assert own("diff --git a/a b/a\n-const x = 1\n xx") == []


def test_rules(spark):
    rules = [Rule("TODO", "m", "urgent", "Security", ("*.test.ts",)), Rule("a(?=b)", "bad"), Rule("(", "bad"), Rule("x", "n", "med")]
    s = seg(spark, "+x TODO x\ndiff --git a/a.test.ts b/a.test.ts\n@@ -1 +3,2 @@\n+TODO")
    assert found(detectors.rule_findings(s, rules), "file", "line", "severity", "category", "issue") == [("", 1, "medium", "quality", "n"), ("a.test.ts", 3, "low", "security", "m")]
    assert found(detectors.rule_status(spark, rules).where("fault is not null"), "rule_id") == [(1,), (2,)]
    assert detectors.rule_findings(s, []).count() == 0


@pytest.mark.parametrize(("pattern", "fault", "hit"), [("(?P<name_1>TO)DO", False, True), ("(?<n>TO)DO", False, True), (r"TODO\z", False, True), ("x(?i)todo", False, False), ("(?i)todo", False, True), (r"a(?!b)", True, False), (r"(a)\1", True, False), ("a++", True, False), ("(?>a)", True, False), ("[", True, False), (r"\(\?P<n>", False, False), (r"\p{Lu}ODO", False, True)])
def test_rule_patterns_are_those_of_the_engine_that_runs_them(spark, pattern, fault, hit):
    rule = Rule(pattern, "m")
    assert (rule.fault(spark) is not None) is fault
    got = detectors.rule_findings(seg(spark, "diff --git a/a b/a\n@@ -1 +3,1 @@\n+TODO"), [rule]).count()
    assert got == int(hit)


def malformed(r):
    name = lambda: r.choice(["foo", "x1", "a_b", "mut", "err"])
    code = lambda: r.choice([f"const {name()} = 1;", f"let {name()}", f"def {name()}(a):", f"{name()}, {name()} := f()", f"use({name()})", f"{name()} TODO", "", "  ", "-- x", "++i"])
    header = lambda: r.choice(["diff --git a/src/auth/x.ts b/src/auth/x.ts", "diff --git a/m.py b/m.py", "diff --gitx b/z.go", "diff --git nothing", "diff --git a/q b/ q.ts b/r"])
    hunk = lambda: r.choice(["@@ -1,2 +3,4 @@", "@@ -1 +7 @@", "@@-1 +9,1", "@@ nothing", "@@ -2,1 +x,1 @@", "@@ +5", "@@ -1 + 6,2 @@"])
    out, last = [], []
    for _ in range(r.randrange(1, 40)):
        k = r.random()
        if k < 0.08:
            out.append(header())
        elif k < 0.2:
            out.append(hunk())
        elif k < 0.45:
            last.append(code())
            out.append("-" + r.choice(["", " "]) + last[-1])
        elif k < 0.6 and last:
            out.append(r.choice(["+// ", "+//", "+ ", "+/*", "+ //* "]) + r.choice(last[-4:]))
        elif k < 0.8:
            out.append("+" + code())
        else:
            out.append(r.choice([" ", "", "\\"]) + code())
    return r.choice(["\n", "\r\n"]).join(out) + r.choice(["", "\n"])


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_random_patches_against_the_model(spark, partitions):
    r = random.Random(int(partitions))
    diffs = [malformed(r) for _ in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        s = seg(spark, *diffs).cache()
        rules = [Rule("TODO", "0", files=("*.ts", "r")), Rule("use", "1"), Rule(r"\bfoo\b", "2", files=("x.ts",))]
        every = [(i, *x) for i, d in enumerate(diffs) for x in model.commented(d)]
        assert [(a, b, c) for a, b, c in found(detectors.commented_code(s), "patch_id", "file", "line")] == sorted(x[:3] for x in every) and every
        every = [(i, *x[:2]) for i, d in enumerate(diffs) for x in model.removed_used(d)]
        assert found(detectors.removed_still_used(s), "patch_id", "file", "line") == sorted(every) and every
        every = [(i, f, n, str(k)) for i, d in enumerate(diffs) for f, n, k in model.rule_hits(d, [(x.pattern, x.files) for x in rules])]
        assert found(detectors.rule_findings(s, rules), "patch_id", "file", "line", "issue") == sorted(every) and every
        for most in (1, 7, 300):
            got = chunks.diff_chunks(s, most).orderBy("patch_id", "file_seq", "part").collect()
            assert [(x.patch_id, x.chunk) for x in got] == [(i, c) for i, d in enumerate(diffs) for c in model.chunks(d, most)]
        s.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
