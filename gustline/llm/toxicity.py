"""Toxicity by a weighted finite-state pattern grammar.

A lexicon automaton over letters maps every word of a clause to a symbol: an insult of one of three strengths, a
threat, a target, a negation, a reporting word, or any other. Five transducers over these symbols
(:func:`insults`, :func:`threats`, :func:`targets`, :func:`negations`, :func:`reports`) are composed into one machine,
:data:`MACHINE`: the first two turn words into matches (a threat is one only in a clause with a target, so the
machine guesses and pays for its guess when the target comes), the third tells whether the clause addresses
somebody (guessed at its start, checked at its end), the fourth whether a match stands within reach of a negation,
the fifth whether it is reported speech. Each output letter has a weight; a clause's score is the weight of the
best path through the composed machine, and words outside of matched clauses add nothing. A text's score
is a logistic function of the sum of its clause scores and of their density.

Everything learned has a prior, and the prior alone decides where there are no labelled rows: stems (word beginnings, or whole
words) by their smoothed odds in toxic against clean texts, the arcs' weights by the smoothed odds of texts that use
them, the logistic function by a ridge around its prior. The fit reads a bounded sample of labelled rows,
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``, those with the lowest checksums of their ids; counting is an aggregation on the
executors, and the driver sees stems and one short row of counts for each sampled text, no texts. Whole texts are read and
scored.

Defined results: a null or empty text has the score of a text without matches; repeated rows are scored one by
one, and equal texts of one label count once in the fit; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.shared import lean, stash, unstash

#: Labelled rows that the fit reads.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 4500
#: A learned stem: its lengths in letters, the distinct words before it that it needs in toxic texts, its least odds there.
STEM_LETTERS = range(4, 9)
MIN_CONTEXTS, MIN_RATIO = 5, 25.0
#: Log odds from which an insult has strength 1 and 2.
STRENGTHS = (4.0, 5.0)
#: Texts that the priors count as, of each label.
PRIOR_TEXTS = 20.0

#: Word lists of the lexicon: fixed values.
THREATS = ("kill", "hurt", "destroy", "murder", "burn")
TARGETS = ("you", "your", "youre", "he", "she", "they", "them", "du", "dich", "ihr", "sie", "tu", "vous", "il", "elle", "usted", "él", "ella")
NEGATIONS = ("not", "no", "never", "nor", "isnt", "arent", "nicht", "kein", "keine", "nie", "pas", "ne", "jamais", "nunca", "tampoco")
REPORTS = ("said", "says", "called", "quoted", "wrote", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")
SEED_STEMS = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting", "loser")
#: Words that a negation stays open for.
NEGATION_REACH = 3

#: Symbols of words, and the matches (letters of insult strength or threat) that the first two machines make of them.
INSULTS, THREAT, TARGET, NEGATION, REPORT, OTHER = ("I0", "I1", "I2"), "K", "T", "N", "R", "O"
SYMBOLS = (*INSULTS, THREAT, TARGET, NEGATION, REPORT, OTHER)
MATCHES = ("m0", "m1", "m2", "mk")

_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = ".!?;:\n"
_CLAUSE = re.compile(f"[^{_BREAKS}]*")


# --- machines -------------------------------------------------------------------------------------------------------


class Machine:
    """A transducer that writes one letter for each that it reads: ``arcs[state][letter]`` lists (written letter, next state)."""

    def __init__(self, starts: Sequence, finals: Sequence, arcs: dict):
        self.starts, self.finals, self.arcs = tuple(starts), frozenset(finals), arcs

    def __matmul__(self, other: Machine) -> Machine:
        """Composition: ``other`` reads what this machine writes. Only states that a path reaches are built."""
        starts = [(a, b) for a in self.starts for b in other.starts]
        arcs: dict = {}
        todo = list(starts)
        while todo:
            at = todo.pop()
            if at in arcs:
                continue
            arcs[at] = {}
            for letter, outs in self.arcs[at[0]].items():
                steps = [(z, (n, m)) for y, n in outs for z, m in other.arcs[at[1]].get(y, ())]
                if steps:
                    arcs[at][letter] = steps
                    todo += [s for _, s in steps]
        finals = [s for s in arcs if s[0] in self.finals and s[1] in other.finals]
        return Machine(starts, finals, arcs)

    def numbered(self) -> Machine:
        """The same machine with small integers as states."""
        number = {s: i for i, s in enumerate(self.arcs)}
        arcs = {number[s]: {x: [(y, number[n]) for y, n in outs] for x, outs in by.items()} for s, by in self.arcs.items()}
        return Machine([number[s] for s in self.starts], [number[s] for s in self.finals], arcs)

    def best(self, letters: Sequence[str], weights: dict[str, float]) -> tuple[float, tuple[str, ...]]:
        """Weight of the best path over ``letters`` and the weighted letters that it writes; minus infinity without one."""
        live: dict = {s: (0.0, ()) for s in self.starts}
        for x in letters:
            then: dict = {}
            for state, (total, wrote) in live.items():
                for y, nxt in self.arcs[state].get(x, ()):
                    w = weights.get(y)
                    here = (total, wrote) if w is None else (total + w, (*wrote, y))
                    if nxt not in then or here[0] > then[nxt][0]:
                        then[nxt] = here
            live = then
        ends = [live[s] for s in live if s in self.finals]
        return max(ends, key=lambda e: e[0]) if ends else (-math.inf, ())


def _keep(letters: Sequence[str], state) -> dict:
    return {x: [(x, state)] for x in letters}


def insults() -> Machine:
    """Insult words become matches of their strength."""
    return Machine([0], [0], {0: _keep([x for x in SYMBOLS if x not in INSULTS], 0) | {x: [(m, 0)] for x, m in zip(INSULTS, MATCHES)}})


def threats() -> Machine:
    """A threat word is a match if the clause names a target before or after it; else, or by choice, any other word."""
    rest = [*MATCHES[:3], NEGATION, REPORT, OTHER]
    free = _keep(rest, "free") | {TARGET: [(TARGET, "paid")], THREAT: [(OTHER, "free"), ("mk", "owed")]}
    owed = _keep(rest, "owed") | {TARGET: [(TARGET, "paid")], THREAT: [("mk", "owed")]}
    paid = _keep([*rest, TARGET], "paid") | {THREAT: [("mk", "paid")]}
    return Machine(["free"], ["free", "paid"], {"free": free, "owed": owed, "paid": paid})


def targets() -> Machine:
    """Matches of a clause with a target are marked ``t``. Which of both it is, is guessed at the clause's start."""
    rest = [NEGATION, REPORT, OTHER]
    marked = {m: [(m + "t", None)] for m in MATCHES}
    at = lambda s: {m: [(outs[0][0], s)] for m, outs in marked.items()}
    return Machine(
        ["none", "awaited"],
        ["none", "seen"],
        {
            "none": _keep([*rest, *MATCHES], "none"),
            "awaited": _keep(rest, "awaited") | at("awaited") | {TARGET: [(TARGET, "seen")]},
            "seen": _keep([*rest, TARGET], "seen") | at("seen"),
        },
    )


def negations() -> Machine:
    """Matches among the NEGATION_REACH words after a negation are marked ``n``."""
    found = [m + t for m in MATCHES for t in ("", "t")]
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        down = max(left - 1, 0)
        arcs[left] = _keep([TARGET, REPORT, OTHER], down) | {NEGATION: [(NEGATION, NEGATION_REACH)]} | {m: [(m + "n" if left else m, down)] for m in found}
    return Machine([0], list(arcs), arcs)


def reports() -> Machine:
    """Matches after a reporting word are marked ``r``."""
    found = [m + t + n for m in MATCHES for t in ("", "t") for n in ("", "n")]
    rest = [TARGET, NEGATION, OTHER]
    plain = _keep([*rest, *found], "plain") | {REPORT: [(REPORT, "said")]}
    said = _keep([*rest, REPORT], "said") | {m: [(m + "r", "said")] for m in found}
    return Machine(["plain"], ["plain", "said"], {"plain": plain, "said": said})


PARTS = (insults(), threats(), targets(), negations(), reports())
MACHINE = (PARTS[0] @ PARTS[1] @ PARTS[2] @ PARTS[3] @ PARTS[4]).numbered()
#: Weighted letters, and their weights without any labelled row.
LETTERS = tuple(m + t + n + r for m in MATCHES for t in ("", "t") for n in ("", "n") for r in ("", "r"))
PRIOR_WEIGHTS = {x: (1.0, 1.5, 2.0, 1.0)[MATCHES.index(x[:2])] * (1.3 if "t" in x[2:] else 1.0) * (0.3 if "n" in x[2:] else 1.0) * (0.4 if "r" in x[2:] else 1.0) for x in LETTERS}
#: Prior of the logistic function over log sum and density of the clause scores, and its intercept.
PRIOR_LOGISTIC = (4.0, 0.2, -3.0)


class Lexicon:
    """A letter automaton from words to symbols. ``stems``: log odds by word beginning, or by whole word where it ends in ``$``."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.next: list[dict[str, int]] = [{}]
        self.begins: list[str | None] = [None]  # symbol of any word that passes the state
        self.ends: list[str | None] = [None]  # symbol of the word that ends in it
        for words, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET)):
            for w in words:
                self.ends[self._state(w)] = symbol
        for w in THREATS:
            self.begins[self._state(w)] = THREAT
        for s, odds in stems.items():
            put, symbol = self.ends if s.endswith("$") else self.begins, INSULTS[sum(odds >= x for x in STRENGTHS)]
            put[self._state(s.rstrip("$"))] = symbol

    def _state(self, letters: str) -> int:
        at = 0
        for c in letters:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                for rows, empty in ((self.next, {}), (self.begins, None), (self.ends, None)):
                    rows.append(empty)
            at = self.next[at][c]
        return at

    def symbol(self, word: str) -> str:
        """The strongest of what the word begins with and is."""
        at, found = 0, OTHER
        for c in word:
            nxt = self.next[at].get(c)
            if nxt is None:
                return found
            at = nxt
            found = _stronger(found, self.begins[at])
        return _stronger(found, self.ends[at])

    def matching(self) -> list[str]:
        """Letters with which a word that may match begins."""
        return [s.rstrip("$") for s in self.stems] + list(THREATS)


_RANK = {x: i for i, x in enumerate((OTHER, REPORT, NEGATION, TARGET, THREAT, *INSULTS))}


def _stronger(a: str, b: str | None) -> str:
    return a if b is None or _RANK[b] < _RANK[a] else b


# --- scoring --------------------------------------------------------------------------------------------------------


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: dict[str, float], logistic: Sequence[float]):
        self.lexicon, self.weights, self.logistic = lexicon, weights, tuple(float(x) for x in logistic)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_auto"}

    def _triggers(self, low: str) -> Iterator[int]:
        """Starts of the words that may match."""
        auto = self.__dict__.get("_auto")
        if auto is None:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for s in self.lexicon.matching():
                auto.add_word(s, len(s))
            auto.make_automaton()
            self._auto = auto
        for end, n in auto.iter(low):
            start = end - n + 1
            if start == 0 or not low[start - 1].isalpha():
                yield start

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, float, tuple[str, ...]]]:
        """(start, end, score, matches) of the clauses with a match, over the lower-cased text."""
        low = (text or "").lower()
        read = 0
        for at in self._triggers(low):
            if at < read:
                continue
            start = max(max(low.rfind(c, read, at) for c in _BREAKS) + 1, read)
            end = _CLAUSE.match(low, at).end()
            score, wrote = MACHINE.best([self.lexicon.symbol(w) for w in _WORD.findall(low[start:end])], self.weights)
            if wrote:
                yield start, end, score, wrote
            read = end

    def score(self, text: str | None) -> float:
        total = sum(s for _, _, s, _ in self.clauses(text))
        z = float(np.dot(features(total, len(text or "")), self.logistic))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def features(total: float, chars: int) -> np.ndarray:
    total = max(total, 0.0)
    return np.array([math.log1p(total), min(10.0, 1000 * total / (chars + 200)), 1.0])


# --- fit ------------------------------------------------------------------------------------------------------------


def stem_contexts(text: str) -> dict[str, set[int]]:
    """The checksums of the words before, by stem of the text."""
    out: dict[str, set[int]] = defaultdict(set)
    before = 0
    for word in _WORD.findall(text.lower()):
        if len(word) >= STEM_LETTERS[0]:
            for k in STEM_LETTERS:
                if len(word) < k:
                    break
                out[word[:k]].add(before)
            out[word + "$"].add(before)
        before = zlib.crc32(word.encode("utf-8", "replace"))
    return out


def _stem_counts(rows: DataFrame) -> DataFrame:
    """stem, n1, n0 (toxic and clean texts that hold it), contexts (distinct words before it in toxic ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = Counter(), Counter()
        seen: dict[str, set[int]] = defaultdict(set)
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = stem_contexts(text)
                n[y].update(found.keys())
                if y:
                    for s, c in found.items():
                        seen[s] |= c
        stems = sorted(n[0].keys() | n[1].keys())
        for at in range(0, len(stems), 50_000):
            some = stems[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([n[1][s] for s in some], pa.int64()), pa.array([n[0][s] for s in some], pa.int64()), pa.array([sorted(seen.get(s, ())) for s in some], pa.list_(pa.int64()))],
                ["stem", "n1", "n0", "seen"],
            )

    parts = rows.select("y", "text").mapInArrow(lean(run), "stem string, n1 long, n0 long, seen array<long>")
    return parts.groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("contexts"))


def learn_stems(counts: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """Log odds of the seed stems and of the learned ones. A learned stem's evidence is the number of distinct words before
    it; of a learned stem and its continuations the shortest stays."""
    need = max(MIN_CONTEXTS, 0.005 * n1)
    ratio = ((F.col("n1") + 0.5) / max(n1, 1)) / ((F.col("n0") + 1.0) / max(n0, 1))
    rows = counts.filter(F.col("stem").isin(list(SEED_STEMS)) | ((F.col("n1") >= need) & (F.col("contexts") >= need) & (ratio >= MIN_RATIO)))
    got = {r["stem"]: (r["n1"], r["n0"]) for r in rows.select("stem", "n1", "n0").collect()}  # bounded by the sample
    out: dict[str, float] = {}
    for s in sorted({*SEED_STEMS, *got}, key=lambda s: (s not in SEED_STEMS, len(s), s)):
        if s not in SEED_STEMS and any(s[:k] in out for k in range(1, len(s))):
            continue
        a, b = got.get(s, (0, 0))
        odds = math.log((a + 0.1 * PRIOR_TEXTS) / (n1 + PRIOR_TEXTS)) - math.log((b + 0.002 * PRIOR_TEXTS) / (n0 + PRIOR_TEXTS))
        if odds >= 1.0:  # a seed that clean texts hold as well is no insult here
            out[s] = odds
    return out


def learn_weights(used: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Weights of LETTERS from ``used``, a row a text: which letters its best paths write."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    out = {}
    for k, x in enumerate(LETTERS):
        a, b = float(used[y > 0.5, k].sum()), float(used[y < 0.5, k].sum())
        p = 0.01 * PRIOR_TEXTS
        out[x] = math.log((a + p * math.exp(PRIOR_WEIGHTS[x])) / (n1 + PRIOR_TEXTS)) - math.log((b + p) / (n0 + PRIOR_TEXTS))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: Sequence[float] = PRIOR_LOGISTIC, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge around ``prior``; the prior itself without rows."""
    w = start = np.array(prior, float)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - start) ** 2).sum())

    now = loss(w)
    for _ in range(100 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - start))
        scale = 1.0
        while (then := loss(w - scale * step)) > now and scale > 1e-9:
            scale /= 2
        if now - then < 1e-12:
            break
        w, now = w - scale * step, then
    return w


def default_scorer() -> Scorer:
    """The prior alone."""
    odds = math.log(0.1 / 0.002)
    return Scorer(Lexicon(dict.fromkeys(SEED_STEMS, odds)), dict(PRIOR_WEIGHTS), PRIOR_LOGISTIC)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable=None) -> Scorer:
    """A scorer from a bounded sample of the labelled rows; ``usable`` (a Column over doc_id) chooses whose labels
    may be learned from."""
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marks = marks.filter(usable) if usable is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("m", F.xxhash64(F.lit(29), F.col("doc_id").cast("string")))
    some = marks.filter("y = 1").orderBy("m", "doc_id").limit(SAMPLE_TOXIC).unionByName(marks.filter("y = 0").orderBy("m", "doc_id").limit(SAMPLE_CLEAN))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN short rows are broadcast
    rows = texts.join(F.broadcast(some.select("doc_id", "y")), "doc_id").groupBy("y", "text").agg(F.min("doc_id").alias("doc_id"))
    rows = stash(rows)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon(learn_stems(_stem_counts(rows), n.get(1, 0), n.get(0, 0)))
    first = docs.sparkSession.sparkContext.broadcast(Scorer(lexicon, dict(PRIOR_WEIGHTS), PRIOR_LOGISTIC))
    number = {x: k for k, x in enumerate(LETTERS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for t in batch.column("text"):
                c = [0] * len(LETTERS)
                for _, _, _, wrote in first.value.clauses(t.as_py()):
                    for x in wrote:
                        c[number[x]] += 1
                counts.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("chars"), pa.array(counts, pa.list_(pa.int32()))], ["y", "chars", "counts"])

    # no more rows than the sample has
    got = rows.select("y", F.length("text").cast("long").alias("chars"), "text").mapInArrow(lean(run), "y int, chars long, counts array<int>").collect()
    unstash(rows)
    got.sort(key=lambda r: (r["y"], r["chars"], r["counts"]))
    y = np.array([r["y"] for r in got], float)
    counts = np.array([r["counts"] for r in got], float).reshape(len(got), len(LETTERS))
    weights = learn_weights(counts > 0, y)
    totals = counts @ np.array([weights[x] for x in LETTERS])
    x = np.array([features(t, r["chars"]) for t, r in zip(totals, got)]).reshape(len(got), 3)
    return Scorer(lexicon, weights, fit_logistic(x, y))


def with_scores(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score column."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # a few hundred stems

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series([sent.value.score(t) for t in text], dtype="float64")

    return docs.withColumn(out_col, scored(F.col(f"`{text_col}`")))


def matched_clauses(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, score, matches of every matched clause (code points of the lower-cased text)."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, a, b, s, list(m)) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for a, b, s, m in sent.value.clauses(t)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "end", "score", "matches"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, start long, end long, score double, matches array<string>")


def predict(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_scores(rows, scorer).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [sent.value.score(t.as_py()) < 0.5 for t in batch.column("row").field(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(lean(run), packed.schema).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
