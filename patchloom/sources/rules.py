"""Users' pattern rules from TOML: a list of tables named rule."""

from __future__ import annotations

import os
import tomllib
import warnings

from ..operators.detectors import Rule

#: Rules to begin with.
EXAMPLES = (
    Rule(r"\bprint\(|console\.(?:log|debug)\(", "This prints while the program runs: is it meant to stay?", "low", "quality", ("*.py", "*.ts", "*.js")),
    Rule(r"(?i)\b(?:passwd|password|pwd)\b\s*[:=]\s*[\"'][^\"']{3,}", "A password stands in the source; read it from the environment", "high", "security"),
    Rule(r"\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----", "This looks like a key that should not be shared", "high", "security"),
    Rule(r"\b(?:TODO|XXX)\b", "Something is left to do here", "low", "maintainability"),
    Rule(r"\b(?:breakpoint\(\)|set_trace\(\))", "A breakpoint stops the program", "medium", "quality", ("*.py",)),
)


def parse_rules(text: str) -> list[Rule]:
    """The rules of a TOML text; an error if it isn't valid."""
    found = tomllib.loads(text).get("rule", [])
    return [Rule(r["pattern"], r["message"], r.get("severity", "medium"), r.get("category", "quality"), tuple(r.get("files", ()))) for r in found]


def load_rules(path: str) -> list[Rule]:
    """The rules of a file; none, with a warning, if it can't be read or isn't valid; none if it doesn't exist."""
    if not os.path.exists(path):
        return []
    try:
        with open(path, encoding="utf-8") as f:
            return parse_rules(f.read())
    except (OSError, UnicodeDecodeError, KeyError, TypeError, AttributeError, tomllib.TOMLDecodeError) as e:
        warnings.warn(f"no rules from {path}: {e}", stacklevel=2)
        return []
