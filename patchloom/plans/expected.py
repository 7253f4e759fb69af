"""Fixed values that the SQL of the queries states for itself, so that a wrong one in an operator shows.

Each is what rows must hold, in the order in which it decides: word lists, extensions, patterns, messages, budgets."""

SENSITIVE_PATHS = ("auth", "login", "token", "password", "security", "middleware")
SENSITIVE_CODE = ("auth", "token", "password", "login", "validate", "sanitize")
SENSITIVE_ISSUE = "Security-sensitive logic has been entirely commented out (%s lines). The function body is now dead code and will not execute — this may silently break authentication or validation."
COMMENTED_ISSUE = "A code block of %s lines has been commented out. Commented-out code is technical debt — either restore it or delete it."
COMMENTED_FIX = "Restore the logic if it should be active, or remove the commented block entirely. Use version control (git revert/branch) instead of commenting out."
REMOVED_ISSUE = "Variable `%s` was removed but is still referenced in the same scope. This will cause a ReferenceError (JavaScript) or NameError (Python) at runtime."
REMOVED_FIX = "Restore the declaration of `%s`, or remove all references to it. Do not leave code that uses an undefined variable."

LANGUAGES = (
    ("Rust", "rs"),
    ("TypeScript", "ts tsx"),
    ("JavaScript", "js jsx mjs cjs"),
    ("Python", "py"),
    ("Go", "go"),
    ("Java", "java"),
    ("Kotlin", "kt kts"),
    ("Swift", "swift"),
    ("Ruby", "rb"),
    ("C#", "cs"),
    ("C++", "cpp cc cxx"),
    ("C", "c h"),
    ("PHP", "php"),
)
DEFAULT_STACK = "TypeScript, JavaScript, Rust, Go, Python"

#: Kind, and the pattern whose group is the name.
DEFINITIONS = (
    ("function", r"export\s+(?:async\s+)?function\s+([a-zA-Z0-9_$]+)"),
    ("class", r"export\s+class\s+([a-zA-Z0-9_$]+)"),
    ("interface", r"export\s+interface\s+([a-zA-Z0-9_$]+)"),
    ("type", r"export\s+type\s+([a-zA-Z0-9_$]+)"),
    ("const", r"export\s+(?:const|let|var)\s+([a-zA-Z0-9_$]+)"),
    ("function", r"^func\s+([A-Z][a-zA-Z0-9_$]*)"),
    ("interface", r"^type\s+([A-Z][a-zA-Z0-9_$]*)\s+interface"),
    ("class", r"^type\s+([A-Z][a-zA-Z0-9_$]*)\s+struct"),
    ("function", r"^def\s+([a-zA-Z0-9_$]+)\("),
    ("class", r"^class\s+([a-zA-Z0-9_$]+)[(:]"),
    ("function", r"pub\s+fn\s+([a-z0-9_]+)"),
    ("class", r"pub\s+struct\s+([A-Z][a-zA-Z0-9]*)"),
    ("interface", r"pub\s+trait\s+([A-Z][a-zA-Z0-9]*)"),
)
NOT_NAMES = "if else for while return const let var function class interface type import export from async await true false null undefined string number boolean any void Promise".split()

REFERENCE_BYTES, CONTEXT_BYTES, NEED_BYTES, DIFF_BYTES, TICKET_BYTES = 3000, 2000, 2000, 10_000, 1500
BASE_CATEGORIES = "security, quality, performance, maintainability"
REVIEW = (
    "You review code changes in %s.%s%s\n"
    "Report real problems only, each with file, line, severity (high, medium, low), category (%s), issue and suggested_fix; also positives and suggestions.%s\n"
    "Answer with one JSON object with the lists findings, positives and suggestions.\n\nChange:\n%s\n"
)
DESCRIBE = "Describe this change for a pull request as one JSON object with title, summary (list) and test_plan (list).\n\nChange:\n%s%s\n"
COMMIT = "Write a commit message for this change as one JSON object with message and body.\n\nChange:\n%s\n"

#: Size, name, GB to load, least GB of memory, least GB of disk.
MODELS = (
    ("0.5b", "Qwen2.5-Coder-0.5B", 0.4, 2, 1),
    ("1.5b", "Qwen2.5-Coder-1.5B", 1.1, 4, 2),
    ("3b", "Qwen2.5-Coder-3B", 2.1, 6, 3),
    ("7b", "Qwen2.5-Coder-7B", 4.7, 8, 6),
    ("14b", "Qwen2.5-Coder-14B", 9.0, 16, 11),
    ("32b", "Qwen2.5-Coder-32B", 20.0, 32, 22),
)
#: Answers whose JSON can't be read, by their number in the cycle of seven.
UNREADABLE = (5,)
