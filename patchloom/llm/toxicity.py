"""Toxicity by a weighted finite-state pattern grammar.

A text is a row of clauses, a clause a row of words. Five transducers read a clause in step:

* insult: a word or word stem of the learned insult terminals gives out that terminal;
* threat: two ordinary words of a learned pair, in their order and at most GAP words apart, give out that pair;
* target: holds from REACH words before somebody who is addressed or spoken of to REACH words after;
* negation: holds for some words after a negation;
* reported speech: holds from a reporting verb to the end of the clause.

Their composition is one transducer: what an insult or a threat gives out is joined with the states of the other three
where it is met, so there are 2 * 2 ** 3 composed end states. A matched clause is scored by the weights of its terminals
and of its end states; a text has the score of its worst clause, and one without matched clauses that of such texts.

Terminals are learned from labelled rows, words and pairs that are between significantly more different neighbours in
toxic texts. The same neighbours count once, so exact or near copies of a text don't make its words telling. All weights
are fitted together by ridge logistic regression on clauses, in turns with the choice of each text's worst clause. A word
is a terminal or an ordinary word, never both.

Null and empty texts match nothing. Labels that are null are no examples; a doc_id that is labelled more than once counts
as toxic if any label is 1. With no toxic example the score is 0. Repeated rows are scored each, ties among clauses go to
the first, and texts of any length are read whole. Columns other than doc_id and text are ignored, or carried by
drop_toxic().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, fold, fold_of, slices

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
STEM = range(4, 8)  # letters of a stem terminal
GAP = 3  # words from the first of a threat to the second, at most
REACH = 6  # words from a target to what it is the target of, at most
NEGATED = 3  # words for which a negation holds
LONGEST = 1 << 20  # words of a clause; longer ones are read in parts
#: Fixed word lists of the grammar.
TARGETS = frozenset("you your yours yourself he she him her they them everyone tu toi vous il elle eux du dich dir ihr euch er sie usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not never no nobody isn aren wasn don doesn nicht nie kein keine pas jamais aucun nunca ni".split())
REPORTS = frozenset("said says told wrote quoted reported called sagte sagt meinte dit disait dijo dice escribió".split())
CLAUSE_ENDS = frozenset(".!?;\n")
#: What is expected of the composed end states before any example is seen: a threat counts more than an insult, a target
#: adds to either, a negation or a report takes away.
EXPECTED = np.array([0.5 * (s >> 3) + 0.3 * (s >> 2 & 1) - 0.6 * (s >> 1 & 1) - 0.5 * (s & 1) for s in range(16)])


class Countdown:
    """A transducer that gives out 1 while at most `reach` words have passed since a trigger."""

    def __init__(self, triggers: frozenset[str], reach: int):
        self.triggers, self.reach, self.start = triggers, reach, 0

    def step(self, state: int, word: str) -> int:
        return self.reach + 1 if word in self.triggers else max(0, state - 1)

    def run(self, words: list[str]) -> list[int]:
        state, out = self.start, []
        for w in words:
            state = self.step(state, w)
            out.append(int(state > 0))
        return out


TARGET, NEGATION, REPORT = Countdown(TARGETS, REACH), Countdown(NEGATIONS, NEGATED), Countdown(REPORTS, LONGEST)


def context(words: list[str]) -> list[int]:
    """The composed states of target, negation and reported speech at each word of a clause; targets reach both ways."""
    after, before = TARGET.run(words), TARGET.run(words[::-1])[::-1]
    return [4 * (a | b) + 2 * n + r for a, b, n, r in zip(after, before, NEGATION.run(words), REPORT.run(words), strict=True)]


@dataclass
class Grammar:
    """words, stems: the number of each insult terminal. pairs: of each threat, by its first and second word. weights of
    terminals and states of composed end states score a clause with bias."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    pairs: dict[str, dict[str, int]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    states: list[float] = field(default_factory=lambda: [0.0] * 16)
    bias: float = -20.0

    def __post_init__(self):
        self.seen: dict[str, tuple[int, ...]] = {}

    def insults(self, word: str) -> tuple[int, ...]:
        out = [self.words[word]] if word in self.words else []
        out += [self.stems[word[:k]] for k in STEM if word[:k] in self.stems]
        return tuple(out)

    def threats(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Place and number of each threat: the state is the first words of pairs that are still in reach."""
        waiting: list[tuple[int, dict[str, int]]] = []
        for i, w in enumerate(words):
            waiting = [x for x in waiting if i - x[0] <= GAP]
            for _, second in waiting:
                if w in second:
                    yield i, second[w]
            if w in self.pairs:
                waiting.append((i, self.pairs[w]))

    def clause(self, words: list[str]) -> tuple[frozenset[int], frozenset[int]]:
        """The terminals that a clause gives out and the composed end states that they are met in."""
        found = [(i, k, 0) for i, w in enumerate(words) for k in self.seen.get(w) or self.insults(w)]
        if self.pairs:
            found += [(i, k, 8) for i, k in self.threats(words)]
        if not found:
            return frozenset(), frozenset()
        at = context(words)
        return frozenset(k for _, k, _ in found), frozenset(kind + at[i] for i, _, kind in found)

    def clauses(self, text: str | None) -> Iterator[tuple[frozenset[int], frozenset[int]]]:
        """The matched clauses of a text. Clauses that hold no terminal and no first word of a threat aren't walked."""
        tokens = TOKEN.findall(text.lower()) if text else []
        seen = self.seen
        if len(seen) > 60_000:
            seen.clear()
        for w in set(tokens).difference(seen):
            seen[w] = self.insults(w)
        pairs, done = self.pairs, -1
        for i in [i for i, w in enumerate(tokens) if seen[w] or w in pairs] if pairs else [i for i, w in enumerate(tokens) if seen[w]]:
            if i <= done:
                continue
            first = last = i
            while first > done + 1 and tokens[first - 1] not in CLAUSE_ENDS:
                first -= 1
            while last + 1 < len(tokens) and tokens[last + 1] not in CLAUSE_ENDS and last - first < LONGEST:
                last += 1
            done = last
            own = self.clause(tokens[first : last + 1])
            if own[0]:
                yield own

    def worth(self, clause: tuple[frozenset[int], frozenset[int]]) -> float:
        return self.bias + sum(self.weights[k] for k in sorted(clause[0])) + sum(self.states[s] for s in sorted(clause[1]))

    def score(self, text: str | None) -> float:
        z = max(map(self.worth, self.clauses(text)), default=self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def clauses_of(text: str | None) -> Iterator[list[str]]:
    own: list[str] = []
    for w in TOKEN.findall(text.lower()) if text else []:
        if w in CLAUSE_ENDS:
            if own:
                yield own
            own = []
        else:
            own.append(w)
    if own:
        yield own


def _between(words: list[str], first: int, last: int) -> int:
    """A hash of the words beside some words of a clause."""
    return xxhash.xxh3_64_intdigest(f"{words[first - 1] if first else ''} {words[last + 1] if last + 1 < len(words) else ''}") - (1 << 63)


def single(words: list[str], only: frozenset[str] | None = None) -> Iterator[tuple[str, int]]:
    """Possible insult terminals of a clause, "=word" and "^stem", with what they are between."""
    for i, w in enumerate(words):
        if len(w) > 2:
            own = [f"={w}", *(f"^{w[:k]}" for k in STEM if len(w) > k)]
            if only is None or (own := [t for t in own if t in only]):
                h = _between(words, i, i)
                for t in own:
                    yield t, h


def paired(words: list[str], only: dict[str, set[str]] | None = None, insults: Grammar | None = None) -> Iterator[tuple[str, int]]:
    """Possible threats of a clause: two ordinary words, GAP apart at most, as "first second", with what they are between."""
    ordinary = [not insults.insults(w) for w in words] if insults else [True] * len(words)
    for i, a in enumerate(words):
        if ordinary[i] and (only is None or a in only):
            for j in range(i + 1, min(len(words), i + 1 + GAP)):
                if ordinary[j] and (a != words[j] if only is None else words[j] in only[a]):
                    yield f"{a} {words[j]}", _between(words, i, j)


def _count(docs: DataFrame, terms) -> DataFrame:
    """docs (text) -> term, n: what it is between, all the different neighbours; the term "" stands for all different clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, int]] = set()

        def out() -> pa.RecordBatch:
            got = list(found)
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([h for _, h in got], pa.int64())], ["term", "between"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                for words in clauses_of(text):
                    found.add(("", xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)))
                    found.update(terms(words))
                    if len(found) > 300_000:
                        yield out()
                        found.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "term string, between long").distinct().groupBy("term").agg(F.count("*").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float, centre: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression of rows that stand for `times` each by Newton's method, shrunk towards `centre`; the last
    coefficient is the bias, which is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    aim = np.append(centre, 0.0)
    w, shrink = aim.copy(), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (times * p * (1 - p) + 1e-9)) @ x + np.diag(shrink), x.T @ (times * (p - y)) + shrink * (w - aim))
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def significant(yes: int, no: int, seen: dict[str, int], clean: dict[str, int], least: float) -> list[tuple[float, str]]:
    """Terms counted at least twice as often in toxic texts as by chance, by the likelihood ratio; the most telling first.
    yes, no: all clauses of toxic and of other texts."""
    rate, ranked = yes / (yes + no), []
    for term, a in seen.items():
        b = clean.get(term, 0)
        share = a / (a + b)
        if share < 2 * rate:
            continue
        g = 2 * (a * math.log(share / rate) + (b * math.log((1 - share) / (1 - rate)) if b else 0))
        if g >= least:
            ranked.append((-g, term))
    return sorted(ranked)


def _weigh(grammar: Grammar, found: list[list[tuple[frozenset[int], frozenset[int]]]], y: np.ndarray, turns: int = 4) -> None:
    """Fits the weights on one clause of each text, in turns with the choice of the worst one; the texts without matched
    clauses are two rows that stand for all of them."""
    size = len(grammar.weights)
    matched = [i for i, f in enumerate(found) if f]
    quiet = y[[not f for f in found]]
    gold = np.concatenate([y[matched], [1.0, 0.0]])
    times = np.concatenate([np.ones(len(matched)), [quiet.sum() + 0.5, len(quiet) - quiet.sum() + 0.5]])
    chosen = {i: max(found[i], key=lambda c: len(c[0])) for i in matched}
    for _ in range(turns):
        x = np.zeros((len(matched) + 2, size + 16), np.float32)
        for row, i in enumerate(matched):
            x[row, sorted(chosen[i][0])] = 1
            x[row, [size + s for s in sorted(chosen[i][1])]] = 1
        w = logistic(x, gold, times, 0.5, np.concatenate([np.zeros(size), EXPECTED]))
        grammar.weights, grammar.states, grammar.bias = w[:size].tolist(), w[size:-1].tolist(), float(w[-1])
        worst = {i: max(found[i], key=grammar.worth) for i in matched}
        if worst == chosen:
            break
        chosen = worst


def fit(docs: DataFrame, labels: DataFrame, examples: int = 20_000, terminals: int = 500, folds: int = 4, held: int = 2) -> Grammar:
    """A grammar from labelled rows of the folds other than `held`.

    examples: the most labelled rows used, those first by a hash of doc_id. terminals: the most insult terminals and the
    most threats kept, those first that tell most."""
    stash = Stash(docs.sparkSession, "toxicity")
    docs, labels = docs.select("doc_id", F.col("text").cast("string").alias("text")), labels.select("doc_id", "toxic")
    gold = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    gold = gold.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(examples).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = stash.put(docs.join(F.broadcast(gold), docs["doc_id"] == F.col("_id")).select("text", "toxic"), "examples")
    n = {r.toxic > 0: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = n.get(True, 0), n.get(False, 0)
    if not yes or not no:
        return Grammar(bias=20.0 if yes else -20.0)
    toxic, clean, least = rows.where("toxic > 0"), rows.where("toxic <= 0"), max(3, yes // 300)

    def telling(terms, limited, chance) -> list[str]:
        seen = {r.term: r.n for r in _count(toxic, terms).where((F.col("n") >= least) | (F.col("term") == "")).collect()}
        yes = seen.pop("", 0)
        other = {r.term: r.n for r in _count(clean, limited(seen)).collect()}
        no = other.pop("", 0)
        return [t for _, t in significant(yes, no, seen, other, chance(yes + no, len(seen)))[:terminals]] if yes else []

    def of_words(seen):
        only = frozenset(seen)
        return lambda words: single(words, only)

    chosen = telling(single, of_words, lambda clauses, _: 9 + 2 * math.log10(clauses))
    grammar = Grammar({t[1:]: i for i, t in enumerate(chosen) if t[0] == "="}, {t[1:]: i for i, t in enumerate(chosen) if t[0] == "^"})

    words, stems = grammar.words, grammar.stems

    def of_pairs(seen):
        firsts: dict[str, set[str]] = {}
        for term in seen:
            a, b = term.split()
            firsts.setdefault(a, set()).add(b)
        return lambda words: paired(words, firsts)

    # there are far more pairs than words, so chance finds more of them
    for term in telling(lambda own: paired(own, None, Grammar(words, stems)), of_pairs, lambda _, tried: 15 + 2 * math.log(tried + 1)):
        a, b = term.split()
        grammar.pairs.setdefault(a, {})[b] = len(chosen)
        chosen.append(term)
    grammar.weights = [0.0] * len(chosen)
    pairs, size = grammar.pairs, len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(words, stems, pairs, [0.0] * size)
        for b in slices(batches):
            found = [sorted({(tuple(sorted(k)), tuple(sorted(s))) for k, s in own.clauses(t)}) for t in b.column(0).to_pylist()]
            kinds = [pa.array([[list(c[i]) for c in f] for f in found], pa.list_(pa.list_(pa.int32()))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kinds, b.column(1)], ["k", "s", "toxic"])

    got = rows.mapInArrow(run, "k array<array<int>>, s array<array<int>>, toxic int").collect()
    stash.keep()
    got.sort(key=lambda r: (r.k, r.s, r.toxic))  # the order of partitions is no part of the fit
    _weigh(grammar, [[(frozenset(k), frozenset(s)) for k, s in zip(r.k, r.s, strict=True)] for r in got], np.array([float(r.toxic > 0) for r in got]))
    return grammar


def _own(g: Grammar) -> Grammar:
    return Grammar(g.words, g.stems, g.pairs, g.weights, g.states, g.bias)


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(grammar)
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            s = np.array([own.score(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fold_of(ids, folds) == held), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the grammar doesn't reject, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(grammar)
        for b in slices(batches):
            yield b.filter(pa.array([own.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
