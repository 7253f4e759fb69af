"""Personal data: candidate generators, gradient-boosted trees, calibrated redactions.

Base spans follow fixed formats and always stay. High-recall generators propose more, overlapping spans (secrets, phone
numbers without a country code, card and address look-alikes, disguised e-mail addresses). Boosted trees score them by
format and context; per kind, a threshold calibrated for precision on examples that the trees haven't seen selects.
The trees are trained on made-up examples, `examples` of them from a fixed seed, never on the corpus.

Spans are code points, end exclusive. Null text is an empty one and holds nothing. Repeated rows are each searched.
Other columns are ignored by find() and carried by redact().
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed formats of base spans. A lookbehind keeps digit runs from being tried at each digit; no match is changed by it.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Generators beyond the base.
LONG_TOKEN = re.compile(r"[A-Za-z0-9_/+=-]{16,}")
NUMBER = re.compile(r"[(]?[0-9][0-9 ().-]{6,}[0-9]")
GROUP = re.compile("[(]?[0-9]+")
AT = re.compile(r"\(at\)|\[at\]| at ")  # what every disguised address holds
DISGUISED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,24}){1,4}")
HINTS = {
    "secret": frozenset("token secret key password passwd pwd auth bearer apikey credential".split()),
    "phone": frozenset("phone tel call mobile cell fax whatsapp telefon telefono téléphone".split()),
    "card": frozenset("card visa mastercard credit debit amex pan karte carte tarjeta".split()),
    "ip": frozenset("ip host server address addr ipv4 gateway".split()),
    "email": frozenset("mail email contact reach write e".split()),
}
NEXT_LEFT, NEXT_RIGHT = re.compile("(?<=[0-9])([ ().-]+)\\Z"), re.compile("([ ().-]+)(?=[0-9])")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ to both sides, so no word is tried twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def numbers(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """Phone and card proposals in a run of digit groups: every start and end at groups, longest first, so that numbers
    side by side are proposed each. At most 19 groups are in one, so proposals are linear in the run."""
    groups = [(g.start(), g.end(), g.end() - g.start() - (text[g.start()] == "(")) for g in GROUP.finditer(text, start, end)]
    out = []
    for i, (first, _, _) in enumerate(groups):
        n, own = 0, []
        for _, last, digits in groups[i : i + 19]:
            n += digits
            if n > 19:
                break
            if last - first - (text[first] == "(") < 8:
                continue
            if 7 <= n <= 15:
                own.append((first, 3, last))
            if n >= 13:
                own.append((first, 2, last))
        out += own[::-1]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals of all generators: (start, kind number, end)."""
    out = []
    for m in LONG_TOKEN.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and not s.isdigit():
            out.append((m.start(), 4, m.end()))
    for m in NUMBER.finditer(text):
        out += numbers(text, m.start(), m.end())
    for m in IP.finditer(text):
        out.append((m.start(), 1, m.end()))
    for m in AT.finditer(text):
        end = m.start() - text.startswith(" ", max(0, m.start() - 1), m.start())
        start = end
        while start and end - start < 64 and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < end and (found := DISGUISED.match(text, start)):
            out.append((start, 0, found.end()))
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a proposal; checksums and base rules are no features."""
    s, n = text[start:end], end - start
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    groups = re.findall("[0-9]+", s)
    before = text[max(0, start - 30) : start]
    words = [w.lower() for w in WORD.findall(before)][-3:]
    out = [kind, n, digits / n, letters / n, upper / n, entropy, switches / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), s.count(" "), s.count("-"), s.count("."), s.count("(")]
    out += [float(any(w in HINTS[k] for w in words)) for k in KINDS]
    out += [float(before[-1:] in "\"'=:") if before else 0.0, float(text[end : end + 1].isalnum()), float(before[-1:].isalnum()), float(bool(re.fullmatch("[0-9a-f]+", s))), max((int(g) for g in groups if len(g) < 6), default=0)]
    # what a cut run of digit groups looks like: groups at its ends, kinds of separators, digits that go on beyond them
    seps = re.findall("[^0-9]+", s) if kind in (2, 3) else []
    sizes = list(map(len, groups)) or [0]
    left, right = NEXT_LEFT.search(text, max(0, start - 6), start), NEXT_RIGHT.match(text, end)
    out += [sizes[0], sizes[-1], len(set(seps)), float(left is not None), float(right is not None), float(left is not None and left[1] in seps), float(right is not None and right[1] in seps), float(left is not None and left[1] == " "), float(right is not None and right[1] in (" ", " ("))]
    out += [float(bool(re.search(r"\. |\.[A-Z]", s))), float("(" in s or "[" in s)]
    return out


class Trees:
    """Gradient boosting of small regression trees on the logistic loss; every split is an exact search of quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins, self.trees, self.start = rounds, depth, rate, bins, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        z = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            z += self.rate * self._apply(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        if depth and len(rows) > 10:
            for f, own in enumerate(cuts):
                if not len(own):
                    continue
                at = np.searchsorted(own, x[rows, f], side="left")  # x <= own[i] exactly where at <= i
                left_g, left_h = (np.cumsum(np.bincount(at, v[rows], len(own) + 1))[:-1] for v in (g, h))
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, own[i]))
        if best[1] is None:
            return total_g / (total_h + 1)
        f, cut = best[1]
        low = x[rows, f] <= cut
        return f, cut, self._grow(x, g, h, cuts, rows[low], depth - 1), self._grow(x, g, h, cuts, rows[~low], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._apply(a, x), self._apply(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._apply(t, x) for t in self.trees)


def examples(n: int, seed: int = 11) -> list[tuple[str, int, int, int, int]]:
    """Made-up proposals: (text, start, kind number, end, label)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "ion", "es", "le", "que", "sch", "ó", "en", "ment", "ti")) for _ in range(r.randint(1, 3)))
    hint = lambda k: r.choice(sorted(HINTS[k]))
    phone = lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"))
    card = lambda: r.choice((" ", "-")).join(d(4) for _ in range(4))

    def beside(kind: str | None) -> tuple[str, str, str, int]:
        """Numbers side by side, cut at one of the kind; at a wrong place for none."""
        while True:
            kinds = [r.choice(("phone", "phone", "card")) for _ in range(r.randint(2, 4))]
            parts = [(k, phone() if k == "phone" else card()) for k in kinds]
            run, own, at = " ".join(x for _, x in parts), [], 0
            for k, x in parts:
                own.append((at, KINDS.index(k), at + len(x)))
                at += len(x) + 1
            fit = [c for c in own if KINDS[c[1]] == kind] if kind else [c for c in numbers(run, 0, len(run)) if c not in own]
            if fit:
                start, found, end = r.choice(fit)
                lead = r.choice((f"{word()} ", f"{hint('phone')} ", f"{hint('card')} "))
                return lead + run[:start], run[start:end], run[end:] + " ", found

    makers = [
        (1, "secret", lambda: (f'{hint("secret")} = "', hexes(r.choice((32, 40, 64))), '"')),
        (1, "secret", lambda: (f"{hint('secret')}: ", mixed(r.randint(20, 44)), " ")),
        (1, "secret", lambda: (f"{word()} ", mixed(r.randint(28, 44)), " ")),
        (0, "secret", lambda: (f"{word()} ", "-".join(word() for _ in range(5)) + d(1), " ")),
        (0, "secret", lambda: (f"{word()} ", word() * 6 + d(1), f" {word()}")),
        (0, "secret", lambda: ("", "/".join(word() for _ in range(5)) + "/" + d(4), " ")),
        (1, "phone", lambda: (f"{hint('phone')} ", r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}")), " ")),
        (1, "phone", lambda: (f"{word()} ", r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}")), f" {word()}")),
        (0, "phone", lambda: (f"{word()} ", d(r.randint(7, 15)), f" {word()}")),
        (0, "phone", lambda: (f"{word()} ", r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)}.{d(2)}.{d(1)}.{d(3)}", f"19{d(2)} - 20{d(2)}", f"{d(3)} {d(3)} {d(3)}.{d(2)}")), f" {word()}")),
        (1, "card", lambda: (f"{hint('card')} ", r.choice((" ", "-", "")).join(d(4) for _ in range(4)), " ")),
        (1, "card", lambda: (f"{word()} ", r.choice((" ", "-")).join(d(4) for _ in range(4)), f" {word()}")),
        (0, "card", lambda: (f"{word()} ", d(r.randint(13, 19)), f" {word()}")),
        (0, "card", lambda: (f"{word()} ", " ".join(d(r.randint(1, 3)) for _ in range(8)), f" {word()}")),
        (1, "ip", lambda: (f"{hint('ip')} ", ".".join(str(r.randint(1, 255)) for _ in range(4)), " ")),
        (0, "ip", lambda: (f"{word()} ", ".".join(d(r.randint(1, 4)) for _ in range(4)), f" {word()}")),
        (1, "email", lambda: (f"{hint('email')} ", f"{word()}.{word()}{r.choice((' at ', ' (at) ', '[at]'))}{word()}{r.choice((' dot ', ' (dot) ', '.'))}{r.choice(('com', 'org', 'net', 'de'))}", " ")),
        (0, "email", lambda: (f"{word()} ", f"{word()} at {word()} dot {word()}", f" {word()}")),
        (1, "email", lambda: (f"{word()} ", f"{word()}.{word()}{r.choice((' at ', ' (at) ', ' [at] '))}{word()}{r.choice((' (dot) ', ' [dot] ', '.'))}{r.choice(('com', 'org', 'net', 'de'))}", f" {word()}")),
        (0, "email", lambda: (f"{word()} ", f"{word()} at {word()}{r.choice(('. ', '. ', '.'))}{word().capitalize()}", f" {word()}")),
        (0, "email", lambda: (f"{word()} ", f"{word()} at {word()}. {word().capitalize()}", " ")),
        *[(1, "phone", lambda: beside("phone"))] * 2,
        *[(1, "card", lambda: beside("card"))] * 2,
        *[(0, None, lambda: beside(None))] * 6,
    ]
    out = []
    for i in range(n):
        label, kind, make = makers[i % len(makers)]
        a, s, b, *found = make()
        lead = " ".join(word() for _ in range(4)) + " "
        out.append((lead + a + s + b + word(), len(lead + a), found[0] if found else KINDS.index(kind), len(lead + a + s), label))
    return out


class Model:
    def __init__(self, n: int = 9_000, precision: float = 0.98, seed: int = 11):
        own = examples(n, seed)
        random.Random(seed).shuffle(own)
        x = np.array([features(t, s, k, e) for t, s, k, e, _ in own])
        y = np.array([float(v) for *_, v in own])
        part = len(own) * 2 // 3
        self.trees = Trees().fit(x[:part], y[:part])
        z, gold, kind = self.trees.margin(x[part:]), y[part:], x[part:, 0]
        self.threshold = np.full(len(KINDS), np.inf)
        for k in range(len(KINDS)):
            order = np.argsort(-z[kind == k])
            right = np.cumsum(gold[kind == k][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= precision)
            if len(good):
                self.threshold[k] = max(0.0, z[kind == k][order][good[-1]])

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """base and the proposals that the trees select and nothing selected before overlaps, best first."""
        own = candidates(text)
        if not own:
            return base
        used = bytearray(len(text))  # code points of what is selected
        for s, _, e in base:
            used[s:e] = b"\1" * (e - s)
        free = [c for c in own if used.find(1, c[0], c[2]) < 0]
        fit, margin = [], []
        for at in range(0, len(free), 2_000):
            x = np.array([features(text, *c) for c in free[at : at + 2_000]])
            z = self.trees.margin(x) - self.threshold[x[:, 0].astype(int)]
            good = np.flatnonzero(z >= 0)
            fit += [free[at + i] for i in good.tolist()]
            margin += z[good].tolist()
        out: list[tuple[int, int, int]] = []
        for i in np.argsort(-np.array(margin), kind="stable").tolist():
            s, _, e = fit[i]
            if used.find(1, s, e) < 0:
                out.append(fit[i])
                used[s:e] = b"\1" * (e - s)
        return sorted(base + out)


@lru_cache(1)
def model() -> Model:
    """The model is made from its seed where it is needed, once for each Python worker."""
    return Model()


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, sha, said = [], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in range(4)])
                sha.append(hashlib.sha256(_say(base).encode()).hexdigest())
                said.append(_say(model().spans(t, base)) if t else "")
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in n.T), pa.array(sha, pa.string()), pa.array(said, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with every span, or union of overlapping ones, replaced by the first one's kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for s, k, e in model().spans(text, base_spans(text)):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with masked texts; n_chars, where it is a column, follows. All else stays."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(b.columns)
            at = names.index("text")
            texts = [masked(t) for t in cols[at].to_pylist()]
            cols[at] = pa.array(texts, cols[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([v if t is None else len(t) for t, v in zip(texts, cols[i].to_pylist(), strict=True)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
