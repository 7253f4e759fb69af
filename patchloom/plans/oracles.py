"""SQL for an independent engine, one statement for each query that SQL can express."""

from __future__ import annotations

from ..sources.fixtures import RESPONSES
from . import expected


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _u32(x: str) -> str:
    return f"coalesce(CASE WHEN try_cast(CASE WHEN regexp_full_match({x}, '\\+?[0-9]+') THEN {x} END AS BIGINT) <= 4294967295 THEN try_cast({x} AS BIGINT) END, 1)"


def _bytes(x: str, n: int) -> str:
    cuts = ", ".join(f"TRY(decode(encode({x})[1:{k}]))" for k in range(n, n - 4, -1))
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE coalesce({cuts}) END"


SO_FAR = "OVER (PARTITION BY patch_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DOCS = """docs AS (SELECT doc_id, coalesce(text, '') AS text, 'src/' || coalesce(source, 'none') || '/' || CASE WHEN doc_id % 3 = 0 THEN 'auth' ELSE 'core' END || '/d' || doc_id || '.' || ['ts', 'py', 'go', 'rs', 'js', 'md'][doc_id % 6 + 1] AS path FROM documents),
raws AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs)"""


def _lines(named: bool = False) -> str:
    tail = "|| CASE WHEN i % 5 = 0 THEN ' f' || doc_id || '_0()' ELSE '' END" if named else ""
    return f"""{DOCS},
parts AS (
  SELECT doc_id, -4 AS ord, 'diff --git a/' || path || ' b/' || path AS line FROM docs
  UNION ALL SELECT doc_id, -3, 'index 0000000..1111111 100644' FROM docs
  UNION ALL SELECT doc_id, -2, '--- a/' || path FROM docs
  UNION ALL SELECT doc_id, -1, '+++ b/' || path FROM docs
  UNION ALL SELECT doc_id, i * 10, '@@ -' || (i + 1) || ',12 +' || (i + 1) || ',12 @@' FROM raws WHERE i % 12 = 0
  UNION ALL SELECT doc_id, i * 10 + 1, '-' || raw FROM raws WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, i * 10 + 2, '+// ' || raw FROM raws WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, i * 10 + 1, CASE i % 3 WHEN 0 THEN '-const v' || (i % 7) || ' = 1;' WHEN 1 THEN '+use(v' || ((i - 1) % 7) || ');' ELSE ' ' || raw END FROM raws WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, i * 10 + 1, '+' || raw {tail} FROM raws WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, i * 10 + 1, CASE WHEN i % 2 = 0 THEN ' ' ELSE '-' END || raw FROM raws WHERE doc_id % 4 = 3
  UNION ALL SELECT doc_id, i * 10 + 2, '+' || raw || ' TODO' FROM raws WHERE doc_id % 4 = 3 AND i % 2 = 1),
lines AS (SELECT doc_id - doc_id % 5 AS patch_id, row_number() OVER (PARTITION BY doc_id - doc_id % 5 ORDER BY doc_id, ord) - 1 AS pos, line FROM parts),
marks AS (
  SELECT *, starts_with(line, 'diff --git') AS is_header, starts_with(line, '@@') AS is_hunk,
    starts_with(line, '-') AND NOT starts_with(line, '---') AS removed, starts_with(line, '+') AND NOT starts_with(line, '+++') AS added,
    {_trim("string_split(line, ' b/')[2]")} AS path, string_split(line, '+')[2] AS plus FROM lines),
kinds AS (
  SELECT *, CASE WHEN is_header THEN 'header' WHEN is_hunk THEN 'hunk' WHEN removed THEN 'removed' WHEN added THEN 'added' ELSE 'context' END AS kind,
    CASE WHEN removed OR added THEN substr(line, 2) ELSE line END AS content,
    CASE WHEN is_hunk AND plus IS NOT NULL THEN {_u32(_trim("string_split(plus, ',')[1]"))} END AS own_start,
    CASE WHEN starts_with(line, '@@ ') AND plus IS NOT NULL THEN {_u32("regexp_extract(plus, '^([^, ]*)', 1)")} END AS own_line,
    CASE WHEN added OR starts_with(line, ' ') THEN 1 ELSE 0 END AS step FROM marks),
seg0 AS (
  SELECT *, coalesce(last_value(CASE WHEN is_header THEN path END IGNORE NULLS) {SO_FAR}, '') AS file,
    sum(is_header::INT) {SO_FAR} AS file_seq, sum((is_header OR is_hunk)::INT) {SO_FAR} AS hunk_seq,
    coalesce(last_value(own_start IGNORE NULLS) {SO_FAR}, 0) AS hunk_start,
    sum(CASE WHEN own_line IS NOT NULL THEN 1 ELSE 0 END) {SO_FAR} AS line_run,
    coalesce(last_value(own_line IGNORE NULLS) {SO_FAR}, 1) AS base_line FROM kinds),
seg AS (
  SELECT *, base_line + coalesce(sum(step) OVER (PARTITION BY patch_id, line_run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_line FROM seg0)"""


LINES, NAMED = _lines(), _lines(True)


def _chunks(max_lines: int = 300, max_bytes: int = 2048) -> str:
    cut = f"CASE WHEN strlen(line) > {max_bytes} THEN {_bytes('line', max_bytes)} || '... [line truncated]' ELSE line END"
    return f"""placed AS (SELECT patch_id, file_seq::BIGINT AS file_seq, pos, ((row_number() OVER (PARTITION BY patch_id, file_seq ORDER BY pos) - 1) // {max_lines})::BIGINT AS part, {cut} || chr(10) AS out FROM seg),
chunks AS (SELECT patch_id, file_seq, part, string_agg(out, '' ORDER BY pos) AS chunk FROM placed GROUP BY ALL)"""


CHUNK_DIGEST = "SELECT patch_id, file_seq, part, strlen(chunk)::BIGINT AS bytes, md5(chunk) AS digest FROM chunks"
NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY file_seq, part) AS chunk_seq, count(*) OVER (PARTITION BY patch_id) AS total FROM chunks WHERE " + _trim("chunk") + " <> '')"
LANGS = "exts AS (SELECT patch_id, regexp_extract(regexp_extract(line, '([^.]*)$', 1), '^\\s*(\\S*)', 1) AS ext, line FROM lines), langs AS (SELECT patch_id, list_sort(coalesce(list(DISTINCT l) FILTER (l IS NOT NULL), [])) AS l FROM (SELECT patch_id, CASE WHEN starts_with(line, 'diff --git') THEN CASE ext " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for v, exts in expected.LANGUAGES for k in exts.split()) + " END END AS l FROM exts) GROUP BY patch_id)"
LABELS = f"labels_ AS (SELECT patch_id, coalesce(nullif(array_to_string(l, ', '), ''), 'unknown') AS header_label, coalesce(nullif(array_to_string(l, ', '), ''), {lit(expected.DEFAULT_STACK)}) AS prompt_label FROM langs)"
_paths = ("src/a.ts", "node_modules/x.js", "src/node_modules/x.js", "a-lock.json", "x/b-lock.json", "yarn.lock", "x/yarn.lock", "dist/a.js", "build", "x/app.min.js", ".next/x", "a/b.map", "src/auth/d0.ts", "srcs/x.ts")
PATHS = "paths AS (SELECT DISTINCT file AS path FROM seg WHERE file <> '' UNION SELECT unnest([" + ", ".join(map(lit, _paths)) + "]))"
WHOLE = "whole AS (SELECT patch_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS diff FROM lines GROUP BY patch_id)"


def _hit(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(p)})" for p in parts) + ")"


def _say(text: str, value: str) -> str:
    a, b = text.replace("%d", "%s").split("%s", 1)
    return f"{lit(a)} || {value} || {lit(b)}"


D1 = f"""code AS (SELECT *, {_trim('content')} AS code FROM seg WHERE kind IN ('removed', 'added') AND file <> ''),
keys AS (SELECT DISTINCT patch_id, hunk_seq, unnest([{_trim("regexp_replace(regexp_replace(code, '^/+', ''), '^\\*+', '')")}, CASE WHEN starts_with(code, '//') THEN substr(code, 3) END, CASE WHEN starts_with(code, '// ') THEN substr(code, 4) END]) AS code FROM code WHERE kind = 'added' AND code <> ''),
hunks AS (SELECT c.patch_id, c.hunk_seq, c.file, c.hunk_start, count(*) AS n, sum(CASE WHEN k.code IS NULL THEN 0 ELSE 1 END) AS m, bool_or({_hit('c.code', expected.SENSITIVE_CODE)}) OR {_hit('c.file', expected.SENSITIVE_PATHS)} AS hot, min(c.pos) AS at_pos
  FROM code c LEFT JOIN keys k USING (patch_id, hunk_seq, code) WHERE c.kind = 'removed' AND c.code <> '' GROUP BY c.patch_id, c.hunk_seq, c.file, c.hunk_start),
d1 AS (SELECT patch_id, 1 AS detector, at_pos, 0 AS sub, file, hunk_start AS line, CASE WHEN hot THEN 'high' ELSE 'medium' END AS severity, CASE WHEN hot THEN 'security' ELSE 'quality' END AS category,
  CASE WHEN hot THEN {_say(expected.SENSITIVE_ISSUE, 'n')} ELSE {_say(expected.COMMENTED_ISSUE, 'n')} END AS issue, {lit(expected.COMMENTED_FIX)} AS suggested_fix, 0.95::DOUBLE AS confidence
  FROM hunks h WHERE n >= 3 AND m * 10 >= n * 6 AND EXISTS (SELECT 1 FROM code c WHERE c.patch_id = h.patch_id AND c.hunk_seq = h.hunk_seq AND c.kind = 'added' AND c.code <> ''))"""
_T = _trim("content")
NAME = f"coalesce(nullif(regexp_extract({_T}, '^(?:const|let|var) ([\\p{{L}}\\p{{N}}_$]+)', 1), ''), nullif(regexp_extract({_T}, '^def ([\\p{{L}}\\p{{N}}_]+)', 1), ''), CASE WHEN contains({_T}, ' := ') THEN nullif(regexp_extract(split_part({_T}, ' := ', 1), '([\\p{{L}}\\p{{N}}_]+)$', 1), '') END)"
D2 = f"""stored AS (SELECT *, sum(CASE WHEN is_header OR is_hunk THEN 0 ELSE 1 END) OVER (PARTITION BY patch_id, file_seq ORDER BY pos) AS k FROM seg),
starts AS (SELECT patch_id, file_seq, coalesce(arg_max(s, pos), 1) AS start FROM (SELECT patch_id, file_seq, pos, last_value(CASE WHEN is_hunk AND k = 0 THEN own_start END IGNORE NULLS) {SO_FAR} AS s FROM stored) WHERE s IS NOT NULL GROUP BY ALL),
uses AS (SELECT DISTINCT patch_id, file_seq, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_$]+')) AS name FROM stored WHERE kind IN ('added', 'context')),
gone AS (SELECT patch_id, file_seq, pos, file, k, {NAME} AS name FROM stored WHERE kind = 'removed' AND file <> ''),
d2 AS (SELECT g.patch_id, 2 AS detector, g.pos AS at_pos, 0 AS sub, g.file, coalesce(s.start, 1) + g.k - 1 AS line, 'high' AS severity, 'quality' AS category, {_say(expected.REMOVED_ISSUE, 'g.name')} AS issue, {_say(expected.REMOVED_FIX, 'g.name')} AS suggested_fix, 0.92::DOUBLE AS confidence
  FROM gone g JOIN uses USING (patch_id, file_seq, name) LEFT JOIN starts s USING (patch_id, file_seq) WHERE g.name IS NOT NULL)"""


def _glob(path: str, g: str) -> str:
    if g == "*":
        return "true"
    return f"ends_with({path}, {lit(g[1:])})" if g.startswith("*.") else f"({path} = {lit(g)} OR ends_with({path}, {lit('/' + g)}))"


def _severity(s: str) -> str:
    return f"CASE WHEN lower({s}) = 'high' THEN 'high' WHEN lower({s}) IN ('medium', 'med') THEN 'medium' ELSE 'low' END"


def _category(s: str) -> str:
    return f"CASE WHEN lower({s}) IN ('security', 'performance', 'maintainability', 'compliance') THEN lower({s}) ELSE 'quality' END"


#: The usable rules of the queries, again: number, pattern, message, severity, category, globs.
RULES = (
    (0, r"\bprint\(|console\.(?:log|debug)\(", "This prints while the program runs: is it meant to stay?", "low", "quality", ("*.py", "*.ts", "*.js")),
    (1, r"(?i)\b(?:passwd|password|pwd)\b\s*[:=]\s*[\"'][^\"']{3,}", "A password stands in the source; read it from the environment", "high", "security", ()),
    (2, r"\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----", "This looks like a key that should not be shared", "high", "security", ()),
    (3, r"\b(?:TODO|XXX)\b", "Something is left to do here", "low", "maintainability", ()),
    (4, r"\b(?:breakpoint\(\)|set_trace\(\))", "A breakpoint stops the program", "medium", "quality", ("*.py",)),
    (5, "(?i)licen[sc]e", "License text in a change", "low", "quality", ()),
    (6, "token = ", "Token in a change", "medium", "security", ("*.go", "*.ts")),
)
D3 = "d3 AS (" + " UNION ALL ".join(f"SELECT patch_id, 3 AS detector, pos AS at_pos, {i} AS sub, file, new_line::BIGINT AS line, {lit(s)} AS severity, {lit(c)} AS category, {lit(m)} AS issue, '' AS suggested_fix, 1.0::DOUBLE AS confidence FROM seg WHERE kind = 'added' AND regexp_matches(content, {lit(p)})" + (" AND (" + " OR ".join(_glob("file", g) for g in gs) + ")" if gs else "") for i, p, m, s, c, gs in RULES) + ")"
PLAIN = "SELECT patch_id, file, line::BIGINT AS line, severity, category, issue, suggested_fix, confidence FROM "

_kind = "[" + ", ".join(lit(r) for r in RESPONSES) + "]"
ANSWERS = f"answers AS (SELECT event_id - event_id % 5 AS patch_id, event_id % 5 + 1 AS chunk_seq, {_kind}[event_id % 7 + 1] AS response, event_id % 7 AS k FROM events)"
#: What the answers hold: kind, place, line.
_found = ((0, 0, 1), (1, 0, 2), (2, 0, 3), (2, 1, 4), (4, 0, 6))
DECODED = "decoded AS (SELECT a.patch_id, a.chunk_seq, f.seq::BIGINT AS seq, 'a.ts' AS file, f.line::BIGINT AS line, 'high' AS severity, 'security' AS category, 'x' AS issue, 'y' AS suggested_fix FROM answers a JOIN (VALUES " + ", ".join(map(str, _found)) + ") f(k, seq, line) ON a.k = f.k)"
NOTES = "notes AS (SELECT patch_id, chunk_seq, seq::BIGINT AS seq, text FROM answers, (VALUES (0, 'p'), (1, 'q'), (2, 'q')) n(seq, text) WHERE k = 0)"
ALL = f"""{ANSWERS}, {DECODED}, {D1}, {D2}, {D3},
every AS (SELECT patch_id, detector, at_pos, sub, file, line::BIGINT AS line, severity, category, issue, suggested_fix FROM d1 UNION ALL SELECT patch_id, detector, at_pos, sub, file, line::BIGINT, severity, category, issue, suggested_fix FROM d2
  UNION ALL SELECT patch_id, detector, at_pos, sub, file, line, severity, category, issue, suggested_fix FROM d3 UNION ALL SELECT patch_id, 9, chunk_seq, seq, file, line, severity, category, issue, suggested_fix FROM decoded),
findings AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY detector, at_pos, sub) - 1 AS seq FROM every)"""

_define = "CASE doc_id % 6 WHEN 1 THEN 'def f' || doc_id || '_' || i || '(x):' WHEN 2 THEN 'func F' || doc_id || '_' || i || '() {' WHEN 3 THEN 'pub fn f' || doc_id || '_' || i || '() {' WHEN 4 THEN 'export const c' || doc_id || '_' || i || ' = {' ELSE 'export async function f' || doc_id || '_' || i || '(x) {' END"
TREE = f"tree AS (SELECT doc_id, path, i + 1 AS line, CASE WHEN i % 9 = 0 THEN {_define} WHEN i % 9 = 4 THEN '}}' ELSE raw END AS text FROM raws)"
LATER = "later AS (SELECT * FROM tree WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, path, max(line) + 1, 'export class Late' || doc_id || ' {' FROM tree WHERE doc_id % 10 = 0 GROUP BY ALL UNION ALL SELECT doc_id, path, max(line) + 2, '}' FROM tree WHERE doc_id % 10 = 0 GROUP BY ALL)"
_LITERALS = r'''"(\\.|[^"\\])*("|\\?$)|''' + r"""'(\\.|[^'\\])*('|\\?$)|""" + r"""`(\\.|[^`\\])*(`|\\?$)"""


def _bare(x: str) -> str:
    return f"regexp_replace({x}, {lit(_LITERALS)}, '', 'g')"


def _delta(x: str) -> str:
    return f"(length({_bare(x)}) - length(replace({_bare(x)}, '{{', ''))) - (length({_bare(x)}) - length(replace({_bare(x)}, '}}', '')))"


def _symbols(tree: str, name: str = "") -> str:
    pats = " UNION ALL ".join(f"SELECT path, line, {lit(kind)} AS type, {k} AS pattern_ord, unnest(regexp_extract_all(text, {lit(p)}, 1)) AS name FROM likely{name}" for k, (kind, p) in enumerate(expected.DEFINITIONS))
    return f"""likely{name} AS (SELECT * FROM {tree} WHERE contains(text, 'export') OR contains(text, 'pub ') OR starts_with(text, 'def ') OR starts_with(text, 'class ') OR starts_with(text, 'func ') OR starts_with(text, 'type ')),
found{name} AS ({pats}),
firsts{name} AS (SELECT * FROM found{name} QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, line, pattern_ord) = 1),
braces{name} AS (SELECT path, line, text, {_delta('text')} AS delta, contains({_bare('text')}, '{{') AS opens FROM {tree}),
windows{name} AS (SELECT f.name, b.line, b.text, sum(b.delta) OVER w AS depth, bool_or(b.opens) OVER w AS opened FROM firsts{name} f JOIN braces{name} b ON b.path = f.path AND b.line BETWEEN f.line AND f.line + 39 WINDOW w AS (PARTITION BY f.name ORDER BY b.line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends{name} AS (SELECT name, min(CASE WHEN opened AND depth <= 0 THEN line END) AS last_line FROM windows{name} GROUP BY name),
symbols{name} AS (SELECT f.name, f.path AS file, f.line::BIGINT AS line, string_agg(w.text, chr(10) ORDER BY w.line) AS snippet, f.type FROM firsts{name} f JOIN windows{name} w USING (name) JOIN ends{name} e USING (name) WHERE e.last_line IS NULL OR w.line <= e.last_line GROUP BY ALL)"""


SYMBOLS = _symbols("tree")
CONTEXT = f"""tokens AS (SELECT patch_id, pos, unnest(regexp_extract_all(line, '[a-zA-Z0-9_$]+')) AS name, generate_subscripts(regexp_extract_all(line, '[a-zA-Z0-9_$]+'), 1) AS k FROM seg WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')),
known AS (SELECT patch_id, name, min(pos * 1000000 + k) AS first FROM tokens WHERE name NOT IN ({", ".join(map(lit, expected.NOT_NAMES))}) AND name IN (SELECT name FROM symbols) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY first, name) AS rank FROM known QUALIFY rank <= 3),
entries AS (SELECT patch_id, rank, chr(10) || '--- Arch Reference: ' || name || ' (from ' || file || ') ---' || chr(10) || snippet || chr(10) AS entry FROM top JOIN symbols USING (name)),
budget AS (SELECT *, sum(strlen(entry)) OVER (PARTITION BY patch_id ORDER BY rank) AS bytes FROM entries),
ctx AS (SELECT patch_id, string_agg(entry, '' ORDER BY rank) AS context FROM budget WHERE bytes <= {expected.REFERENCE_BYTES} GROUP BY patch_id)"""
TICKETS = "tickets AS (SELECT conv_id * 5 AS patch_id, arg_min(text, conv_id) AS text FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id) GROUP BY ALL)"


def _format(text: str, *values: str) -> str:
    parts = text.split("%s")
    return " || ".join(x for p, v in zip(parts, [*values, ""], strict=True) for x in (lit(p), v) if x)


_need = f"CASE WHEN {_trim('t.text')} <> '' THEN t.text END"
REVIEW = f"""prepared AS (SELECT n.patch_id, n.chunk_seq, n.chunk, l.prompt_label, {_bytes("coalesce(c.context, '')", expected.CONTEXT_BYTES)} AS context, {_need} AS need FROM numbered n LEFT JOIN labels_ l USING (patch_id) LEFT JOIN ctx c USING (patch_id) LEFT JOIN tickets t USING (patch_id))
SELECT patch_id, chunk_seq, md5({_format(expected.REVIEW, "prompt_label", f"CASE WHEN need IS NULL THEN '' ELSE chr(10) || chr(10) || 'Requirements:' || chr(10) || {_bytes('need', expected.NEED_BYTES)} || chr(10) END", "CASE WHEN context = '' THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) END", f"CASE WHEN need IS NULL THEN {lit(expected.BASE_CATEGORIES)} ELSE {lit(expected.BASE_CATEGORIES + ', compliance')} END", "CASE WHEN need IS NULL THEN '' ELSE chr(10) || 'Report requirements that are not met, with category compliance.' END", "chunk")}) AS digest FROM prepared"""
_w = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
WRAP = """list_reduce(list_prepend({'d': '', 'n': ''}, list_transform(%s, lambda w: {'d': '', 'n': w})), lambda s, w: CASE WHEN s.n = '' THEN {'d': s.d, 'n': w.n} WHEN strlen(s.n) + 1 + strlen(w.n) <= 68 THEN {'d': s.d, 'n': s.n || ' ' || w.n} ELSE {'d': s.d || '          ' || s.n || chr(10), 'n': w.n} END)"""


def _wrapped(column: str) -> str:
    return f"(SELECT CASE WHEN w.n = '' THEN '' ELSE w.d || '          ' || w.n END FROM (SELECT {WRAP % _w.replace('text', column)} AS w))"


def _ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^ +', '')"


_badge = "CASE severity WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MED' ELSE 'LOW' END"
_icon = "CASE category WHEN 'security' THEN '🔒' WHEN 'quality' THEN '🐛' WHEN 'performance' THEN '⚡' WHEN 'maintainability' THEN '📐' ELSE '📋' END"
BLOCK = f"chr(10) || '   ' || {_badge} || '   ' || {_icon} || '  ' || category || '  ' || file || ':' || line || ' [#' || n || ']' || chr(10) || '  ' || repeat('─', 62) || chr(10) || '  Issue  ' || {_ltrim(_wrapped('issue'))} || chr(10) || '  Fix    ' || {_ltrim(_wrapped('suggested_fix'))} || chr(10)"
_models = "models(id, name, size_gb, ram, disk) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(b)}, {c}::DOUBLE, {d}, {e})" for a, b, c, d, e in expected.MODELS) + ")"


def _noted(title: str, notes: str) -> str:
    return f"coalesce((SELECT '  ' || repeat('─', 62) || chr(10) || '  {title}' || chr(10) || string_agg('     ·  ' || text, chr(10) ORDER BY chunk_seq, seq) || chr(10) FROM {notes} x WHERE x.patch_id = c.patch_id HAVING count(*) > 0), '')"


REPORT = f"""good AS (SELECT * FROM notes QUALIFY lag(text) OVER (PARTITION BY patch_id ORDER BY chunk_seq, seq) IS DISTINCT FROM text),
better AS (SELECT patch_id, min(chunk_seq) AS chunk_seq, 0 AS seq, 's' AS text FROM answers WHERE k = 0 GROUP BY patch_id),
shown AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY seq) AS n FROM findings WHERE severity <> 'low'),
blocks AS (SELECT patch_id, count(*) AS n, string_agg(block, '' ORDER BY n) AS blocks FROM (SELECT patch_id, n, {BLOCK} AS block FROM shown) GROUP BY patch_id),
lost AS (SELECT patch_id, count(*) AS lost FROM answers WHERE k IN ({', '.join(map(str, expected.UNREADABLE))}) GROUP BY patch_id),
counted AS (SELECT p.patch_id, coalesce(b.n, 0) AS n, coalesce(b.blocks, '') AS blocks, coalesce(l.lost, 0) AS lost FROM (SELECT DISTINCT patch_id FROM lines) p LEFT JOIN blocks b USING (patch_id) LEFT JOIN lost l USING (patch_id)),
reports AS (SELECT patch_id, blocks || '  ' || CASE WHEN n = 1 THEN '1 finding' WHEN n > 1 THEN n || ' findings' WHEN lost > 0 THEN 'No answer could be read' ELSE 'Nothing found' END
  || CASE WHEN lost = 1 THEN ', 1 chunk skipped' WHEN lost > 1 THEN ', ' || lost || ' chunks skipped' ELSE '' END || chr(10) || {_noted('What is good', 'good')} || {_noted('What could be better', 'better')} AS report FROM counted c)
SELECT patch_id, strlen(report)::BIGINT AS bytes, md5(report) AS digest FROM reports"""


SQL: dict[str, str] = {
    "line_kinds": f"WITH {LINES} SELECT patch_id, pos, kind FROM seg",
    "file_segments": f"WITH {LINES} SELECT patch_id, file_seq::BIGINT AS file_seq, file, count(*) AS n_lines, min(pos) AS first_pos FROM seg GROUP BY ALL",
    "hunk_starts": f"WITH {LINES} SELECT patch_id, pos, hunk_seq::BIGINT AS hunk_seq, hunk_start FROM seg WHERE is_hunk",
    "new_line_numbers": f"WITH {LINES} SELECT patch_id, pos, new_line::BIGINT AS new_line FROM seg WHERE kind = 'added'",
    "files_changed": f"WITH {LINES} SELECT patch_id, sum(is_header::INT)::BIGINT AS files FROM seg GROUP BY patch_id",
    "patch_languages": f"WITH {LINES}, {LANGS} SELECT patch_id, array_to_string(l, '|') AS languages FROM langs",
    "stack_label": f"WITH {LINES}, {LANGS}, {LABELS} SELECT patch_id, header_label, prompt_label FROM labels_",
    "diff_chunks": f"WITH {LINES}, {_chunks()} {CHUNK_DIGEST}",
    "diff_chunks_short": f"WITH {LINES}, {_chunks(7)} {CHUNK_DIGEST}",
    "long_line_cut": f"WITH {LINES}, {_chunks(300, 100)} {CHUNK_DIGEST}",
    "chunk_numbering": f"WITH {LINES}, {_chunks(40)}, {NUMBERED} SELECT patch_id, file_seq, part, chunk_seq, total FROM numbered",
    "path_excludes": f"WITH {LINES}, {PATHS} SELECT path FROM paths WHERE NOT (path IN ('node_modules', 'pnpm-lock.yaml', 'package-lock.json', 'yarn.lock', 'dist', 'build', '.next', '.cache') OR regexp_matches(path, '^(node_modules|pnpm-lock[.]yaml|package-lock[.]json|yarn[.]lock|dist|build|[.]next|[.]cache)/') OR ends_with(path, '-lock.json') OR ends_with(path, '.map') OR ends_with(path, '.min.js') OR ends_with(path, '.min.css'))",
    "path_includes": f"WITH {LINES}, {PATHS} SELECT path FROM paths WHERE path IN ('src/src0', 'src/a.ts') OR starts_with(path, 'src/src0/') OR starts_with(path, 'src/a.ts/')",
    "size_guard": f"WITH {LINES}, {WHOLE} SELECT patch_id, CASE WHEN strlen(diff) // 1024 > 8 THEN 'too_large' WHEN {_trim('diff')} = '' THEN 'empty' ELSE 'ok' END AS status FROM whole",
    "empty_guard": f"WITH {LINES}, {WHOLE} SELECT status, count(*) AS n FROM (SELECT CASE WHEN strlen(diff) // 1024 > 1500 THEN 'too_large' WHEN {_trim('diff')} = '' THEN 'empty' ELSE 'ok' END AS status FROM (SELECT diff FROM whole UNION ALL SELECT ' ' FROM whole)) GROUP BY status",
    "commented_code": f"WITH {LINES}, {D1} {PLAIN} d1",
    "commented_code_sensitive": f"WITH {LINES}, {D1} SELECT severity, category, count(*) AS n, sum(line)::BIGINT AS line_sum FROM d1 GROUP BY ALL",
    "declared_names": f"WITH {LINES} SELECT patch_id, pos, file, name FROM (SELECT *, {NAME} AS name FROM seg WHERE kind = 'removed') WHERE name IS NOT NULL",
    "removed_still_used": f"WITH {LINES}, {D2} {PLAIN} d2",
    "rule_findings": f"WITH {LINES}, {D3} {PLAIN} d3",
    "rule_glob_matches": f"WITH {LINES}, {PATHS}, g AS (" + " UNION ALL ".join(f"SELECT {lit(g)} AS spec, path FROM paths WHERE {_glob('path', g)}" for g in ("*", "*.ts", "*.test.ts", "d0.ts", "auth/d0.ts", "src/*")) + ") SELECT spec, count(*) AS n, max(path) AS last_path FROM g GROUP BY spec",
    "rule_severity_parse": f"WITH g AS (SELECT DISTINCT regexp_extract(o_orderpriority, '([A-Z]+)', 1) AS given FROM orders UNION ALL SELECT unnest(['High', 'med', 'MEDIUM', 'low', '', 'security', 'Compliance'])) SELECT given, {_severity('given')} AS rule_severity, {_category('given')} AS rule_category, CASE WHEN lower(given) = 'high' THEN 'high' WHEN lower(given) = 'medium' THEN 'medium' ELSE 'low' END AS cli_severity FROM g",
    "symbol_candidates": f"WITH {DOCS}, {TREE}, {SYMBOLS} SELECT name, type, path, line::BIGINT AS line, pattern_ord::BIGINT AS pattern_ord FROM found",
    "symbol_index": f"WITH {DOCS}, {TREE}, {SYMBOLS} SELECT name, file, line, md5(snippet) AS snippet, type FROM symbols",
    "symbol_incremental": f"WITH {DOCS}, {TREE}, {LATER}, {SYMBOLS}, {_symbols('later', '_later')}, merged AS (SELECT * FROM symbols UNION ALL SELECT * FROM symbols_later WHERE name NOT IN (SELECT name FROM symbols)) SELECT name, file, line, md5(snippet) AS snippet, type FROM merged WHERE file IN (SELECT path FROM docs WHERE doc_id % 10 <> 1)",
    "symbol_snippets": f"WITH {DOCS}, {TREE}, {SYMBOLS} SELECT name, strlen(snippet)::BIGINT AS bytes, len(string_split(snippet, chr(10)))::BIGINT AS n_lines FROM symbols",
    "brace_deltas": f"""WITH e AS (SELECT event_id, props || ' {{ ''x}}'' "{{' || event_type || '\\"{{" }}' AS s FROM events) SELECT event_id, ({_delta('s')})::BIGINT AS delta, contains({_bare('s')}, '{{') AS opens FROM e""",
    "context_symbols": f"WITH {NAMED}, {TREE}, {SYMBOLS}, {CONTEXT} SELECT patch_id, name, (first // 1000000)::BIGINT AS first_pos FROM known",
    "context_topk": f"WITH {NAMED}, {TREE}, {SYMBOLS}, {CONTEXT} SELECT patch_id, name, rank FROM top",
    "context_text": f"WITH {NAMED}, {TREE}, {SYMBOLS}, {CONTEXT} SELECT patch_id, strlen(context)::BIGINT AS bytes, md5(context) AS digest FROM ctx",
    "byte_truncate": f"SELECT doc_id, {_bytes("coalesce(text, '')", 37)} AS cut FROM documents",
    "review_prompts": f"WITH {LINES}, {_chunks(40)}, {NUMBERED}, {LANGS}, {LABELS}, {TREE}, {SYMBOLS}, {CONTEXT.replace('FROM seg', 'FROM seg_named')}, {TICKETS}, {REVIEW}",
    "describe_prompts": f"WITH {LINES}, {WHOLE}, {TICKETS} SELECT patch_id, md5({_format(expected.DESCRIBE, _bytes('diff', expected.DIFF_BYTES), f"CASE WHEN t.text IS NULL THEN '' ELSE chr(10) || chr(10) || 'Ticket:' || chr(10) || {_bytes('t.text', expected.TICKET_BYTES)} END")}) AS digest FROM whole LEFT JOIN tickets t USING (patch_id)",
    "commit_prompts": f"WITH {LINES}, {WHOLE} SELECT patch_id, md5({_format(expected.COMMIT, _bytes('diff', expected.DIFF_BYTES))}) AS digest FROM whole",
    "json_complete": f"WITH {ANSWERS} SELECT patch_id, chunk_seq, k IN (0, 2, 3, 5) AS complete FROM answers",
    "json_slices": f"WITH {ANSWERS} SELECT patch_id, chunk_seq, nullif(regexp_extract(response, '(?s)[{{].*[}}]'), '') AS object_slice, nullif(regexp_extract(response, '(?s)\\[.*\\]'), '') AS list_slice FROM answers",
    "decoded_findings": f"WITH {ANSWERS}, {DECODED} SELECT * FROM decoded",
    "skipped_chunks": f"WITH {ANSWERS} SELECT patch_id, sum(CASE WHEN k IN ({', '.join(map(str, expected.UNREADABLE))}) THEN 1 ELSE 0 END)::BIGINT AS skipped FROM answers GROUP BY patch_id",
    "generated_reviews": f"WITH {LINES}, {_chunks(40, 200)}, {NUMBERED} SELECT patch_id, count(*) AS chunks, count(*) AS ok FROM numbered GROUP BY patch_id",
    "pr_decoded": "SELECT event_id AS patch_id, event_id % 4 IN (0, 2) AS valid, CASE WHEN event_id % 4 = 0 THEN 'Add it' ELSE '' END AS title, CASE event_id % 4 WHEN 0 THEN 'a|b' WHEN 2 THEN 'only' ELSE '' END AS summary, 0::BIGINT AS steps FROM events",
    "commit_decoded": "SELECT event_id AS patch_id, event_id % 4 <> 3 AS valid, CASE event_id % 4 WHEN 0 THEN 'fix: it' WHEN 2 THEN 'a' ELSE '' END AS message, CASE WHEN event_id % 4 = 1 THEN 'b' ELSE '' END AS body FROM events",
    "all_findings": f"WITH {LINES}, {ALL} SELECT patch_id, seq, file, line, severity, category, issue FROM findings",
    "findings_threshold": f"WITH {LINES}, {ALL} SELECT patch_id, severity, count(*) AS n FROM findings WHERE severity <> 'low' GROUP BY ALL",
    "finding_numbers": f"WITH {LINES}, {ALL} SELECT patch_id, seq, row_number() OVER (PARTITION BY patch_id ORDER BY seq) AS n FROM findings WHERE severity = 'high'",
    "notes_block": f"WITH {ANSWERS}, {NOTES} SELECT patch_id, '  What is good' || chr(10) || string_agg('     ·  ' || text, chr(10) ORDER BY chunk_seq, seq) AS block FROM notes GROUP BY patch_id",
    "rule_status": "SELECT i::INT AS rule_id, i = 7 AS refused FROM range(8) t(i)",
    "adjacent_dedup": f"WITH {ANSWERS}, {NOTES} SELECT * FROM notes QUALIFY lag(text) OVER (PARTITION BY patch_id ORDER BY chunk_seq, seq) IS DISTINCT FROM text",
    "review_gate": f"WITH {LINES}, {ALL} SELECT p.patch_id, count(f.patch_id) AS findings, CASE WHEN count(f.patch_id) > 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT DISTINCT patch_id FROM lines) p LEFT JOIN (SELECT patch_id FROM findings WHERE severity = 'high') f ON f.patch_id = p.patch_id GROUP BY p.patch_id",
    "review_outcome": f"WITH {LINES}, {D3}, {ANSWERS} SELECT p.patch_id, CASE WHEN p.patch_id IN (SELECT patch_id FROM d3 WHERE severity = 'high') THEN 'findings' WHEN p.patch_id IN (SELECT patch_id FROM answers WHERE k = 5) THEN 'skipped' ELSE 'clean' END AS outcome FROM (SELECT DISTINCT patch_id FROM lines) p",
    "report_json": f"WITH {LINES}, {ALL}, {NOTES}, f AS (SELECT patch_id, count(*) AS c, arg_min(issue, seq) AS i FROM findings WHERE severity <> 'low' GROUP BY patch_id), n AS (SELECT patch_id, string_agg(text, '|' ORDER BY chunk_seq, seq) AS t, (count(*) // 3)::BIGINT AS s FROM notes GROUP BY patch_id) SELECT patch_id, coalesce(c, 0)::BIGINT AS n_findings, coalesce(t, '') AS positives, coalesce(s, 0)::BIGINT AS n_suggestions, i AS first_issue FROM f FULL JOIN n USING (patch_id)",
    "wrapped_issue": f"SELECT doc_id, {_wrapped('text')} AS wrapped FROM documents",
    "finding_text": f"WITH {LINES}, {ALL}, numbered_ AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY seq) AS n FROM findings) SELECT patch_id, n, md5({BLOCK}) AS digest FROM numbered_",
    "text_report": f"WITH {LINES}, {ALL}, {NOTES}, {REPORT}",
    "whole_review": f"""WITH {LINES}, {D1}, {D2}, {D3},
own AS (SELECT patch_id, detector, at_pos, sub, file, line, severity, category, issue FROM d1 UNION ALL SELECT patch_id, detector, at_pos, sub, file, line, severity, category, issue FROM d2 UNION ALL SELECT patch_id, detector, at_pos, sub, file, line, severity, category, issue FROM d3)
SELECT patch_id, row_number() OVER (PARTITION BY patch_id ORDER BY detector, at_pos, sub) AS n, file, line::BIGINT AS line, severity, category, issue FROM own WHERE severity <> 'low'""",
    "parsed_rules": "SELECT * FROM (VALUES (0::BIGINT, 'a+', 'as', 'medium', 'quality', ''), (1::BIGINT, 'b\\d', 'bs', 'high', 'security', '*.py|b.ts')) v(n, pattern, message, severity, category, files)",
    "ticket_preview": f"WITH {TICKETS} SELECT patch_id, left(text, 60) || CASE WHEN strlen(text) > 60 THEN '...' ELSE '' END AS preview FROM tickets",
    "model_lookup": f"WITH {_models} SELECT n_nationkey, id, name, size_gb, lower(name) || '-instruct-q4_k_m.gguf' AS file FROM (SELECT n_nationkey, ['0.5b', '7b', '13b', '32B', '32b'][n_nationkey % 5 + 1] AS id FROM nation) JOIN models USING (id)",
    "model_requirements": f"WITH {_models} SELECT s_suppkey AS host, id, (s_suppkey % 40) >= ram AS ram_ok, (s_suppkey * 7) % 30 + 5.0 / 1073741824 >= disk AS disk_ok FROM supplier, models",
    "mount_prefix": f"WITH {LINES}, {PATHS}, p AS (SELECT DISTINCT CASE WHEN length(path) % 5 = 0 THEN path ELSE '/' || path END AS path FROM paths), m(mount, free) AS (VALUES ('/', 1.0::DOUBLE), ('/src', 2.0::DOUBLE), ('/src/src0', 3.0::DOUBLE), ('/srcx', 4.0::DOUBLE)) SELECT p.path, coalesce(arg_max(m.free, length(m.mount)), 0.0::DOUBLE) AS free FROM p LEFT JOIN m ON p.path = m.mount OR starts_with(p.path, CASE WHEN m.mount = '/' THEN '/' ELSE m.mount || '/' END) GROUP BY p.path",
}
SQL["review_prompts"] = SQL["review_prompts"].replace(", " + TREE, ", seg_named AS (WITH " + NAMED + " SELECT * FROM seg), " + TREE, 1)
