"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language. Its n-grams are 64-bit hashes (four 16-bit letters: exact within the basic
plane, letters beyond it by their block of 32) in sorted arrays, searched by bisection. A text's language is the model
with the lowest cross-entropy per letter over the whole text. A second decision rejects texts that even the best
model does not know: its cross-entropy lies above a limit, the language's mean plus a margin that shrinks with the root of the text's
length, calibrated on rows that the fit left out so that ``REJECT_SHARE`` of a language's own texts are rejected. A rejected
text is ``und`` with score 0; the best language is told beside it. The score of others is the softmax of the models' log-likelihoods over at
most ``EVIDENCE_LETTERS`` letters' worth of evidence, with a calibrated sharpness.

The fit reads a bounded sample of labelled rows: of each language the share of ids with the lowest checksums that
makes ``SAMPLE_PER_LANGUAGE`` expected rows, one row an id; whole texts are read and scored. Each model is
therefore of bounded size, which is what is sent to the executors.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is its best language; without labelled rows every
text is ``und``; languages with equal cross-entropy are taken in alphabetical order; without rows set aside nothing is rejected;
repeated rows are scored one by one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the models, expected labelled rows a language that the fit reads, share of them that calibrates.
ORDER = 4
SAMPLE_PER_LANGUAGE = 1000
CALIBRATION_SHARE = 5
#: Share of a language's own texts that its limit rejects, and letters of evidence that a score counts at most.
REJECT_SHARE, EVIDENCE_LETTERS = 0.002, 40

_U16 = np.uint64(16)


def letters_of(text: str) -> np.ndarray:
    """Lower-cased 16-bit letters with three boundary marks in front; those beyond the basic plane share one of the
    private-use letters by blocks of 32."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    raw = np.where(raw > 0xFFFF, 0xE000 + (raw >> 5) % 6400, raw)
    return np.concatenate([np.full(ORDER - 1, 2, np.uint64), raw.astype(np.uint64)])


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the highest order, sorted, and their counts."""
    x = letters_of(text)
    if len(x) < ORDER:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = x[: -(ORDER - 1)]
    for k in range(1, ORDER):
        code = (code << _U16) | x[k : len(x) - ORDER + 1 + k]
    code = np.sort(code)
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[start], np.diff(np.append(start, len(code)))


class KneserNey:
    """Interpolated Kneser-Ney over sorted hash arrays, from the counts of the highest order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, alphabet: int):
        self.levels = []  # from the highest order down: (sorted codes, discounted shares, sorted contexts, back-off weights)
        c, n = codes, counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            ones, twos = max(int((n == 1).sum()), 1), int((n == 2).sum())
            discount = min(max(ones / (ones + 2.0 * twos), 0.1), 0.95)
            context = c >> _U16
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(c) else np.empty(0, np.int64)
            total = np.add.reduceat(n, at) if len(c) else np.empty(0)
            kinds = np.diff(np.append(at, len(c)))
            share = np.maximum(n - discount, 0) / np.repeat(total, kinds)
            self.levels.append((c, share, context[at], discount * kinds / total))
            if order > 1:  # how many letters stand before each shorter n-gram
                keep = np.uint64((1 << (16 * (order - 1))) - 1)
                c, n = np.unique(c & keep, return_counts=True)
                n = n.astype(np.float64)
        self.floor = 1.0 / alphabet

    def prob(self, codes: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's last letter after its first ones."""
        p = np.full(len(codes), self.floor)
        for order in range(1, ORDER + 1):
            known, share, contexts, weight = self.levels[ORDER - order]
            mine = codes & np.uint64((1 << (16 * order)) - 1) if order < 4 else codes
            p = _find(known, share, mine, 0.0) + _find(contexts, weight, mine >> _U16, 1.0) * p
        return p


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class LanguageModels:
    """All models, and the log-probabilities of every n-gram that any of them has seen, in one sorted table."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        letters = np.unique(np.concatenate([c & np.uint64(0xFFFF) for c, _ in counts.values()])) if counts else np.empty(0)
        self.models = [KneserNey(*counts[x], max(len(letters), 1) + 1) for x in self.langs]
        self.codes = np.unique(np.concatenate([c for c, _ in counts.values()])) if counts else np.empty(0, np.uint64)
        self.logs = self._log(self.codes)
        self.limit = {x: (0.0, np.inf) for x in self.langs}  # mean, and margin at one letter
        self.sharpness = 1.0

    def _log(self, codes: np.ndarray) -> np.ndarray:
        return np.log(np.stack([m.prob(codes) for m in self.models], 1)) if self.models else np.empty((0, 0))

    def entropies(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Cross-entropy a letter under each model, in nats."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        seen = self.codes[at] == codes
        total = counts[seen] @ self.logs[at[seen]]
        if not seen.all():
            total = total + counts[~seen] @ self._log(codes[~seen])
        return -total / counts.sum()

    def known(self, lang: str, entropy: float, letters: int) -> bool:
        """Whether a text of so many letters may be of the language at this cross-entropy."""
        mean, margin = self.limit[lang]
        return entropy <= mean + margin / max(letters, 1) ** 0.5

    def judge(self, text: str | None) -> tuple[str, float, float, bool, str]:
        """(language, score, cross-entropy, rejected, best language)."""
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, 0.0, False, "und"
        h = self.entropies(*grams_of(text))
        best = int(np.argmin(h))
        lang, entropy = self.langs[best], float(h[best])
        if not self.known(lang, entropy, len(text)):
            return "und", 0.0, entropy, True, lang
        w = np.exp(-(h - h[best]) * self.sharpness * min(len(text), EVIDENCE_LETTERS))
        return lang, float(1 / w.sum()), entropy, False, lang


def has_letter(text: str) -> bool:
    return text.isalpha() or any(c.isalpha() for c in text)


def calibrate(models: LanguageModels, rows: list[tuple[str, np.ndarray, np.ndarray, int]]) -> None:
    """Set rejection limits and the sharpness of scores from (language, n-grams, counts, length) of rows that
    the fit left out."""
    own: dict[str, list[tuple[float, int]]] = {x: [] for x in models.langs}
    gaps = []
    for lang, codes, counts, length in rows:
        if lang in own and len(codes):
            h = models.entropies(codes, counts)
            k = models.langs.index(lang)
            own[lang].append((float(h[k]), length))
            gaps.append(((h - h[k]) * min(length, EVIDENCE_LETTERS), k))
    for lang, found in own.items():
        if found:
            h, n = (np.array(x, float) for x in zip(*found))
            mean = float(np.median(h))
            models.limit[lang] = mean, float(max(np.quantile((h - mean) * np.sqrt(n), 1 - REJECT_SHARE, method="higher"), 0.0))
    if gaps:
        grid = [0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0]
        loss = [sum(float(np.log(np.exp(-np.clip(g * s, -50, 50)).sum())) for g, _ in gaps) for s in grid]
        models.sharpness = grid[int(np.argmin(loss))]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Models from a bounded sample of ``labelled``; rows with a null text or language take no part."""
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("text is not null and lang is not null and id is not null")
    mark = F.xxhash64(F.lit(17), "id")
    # the share of each language's ids to read, as a bound on their evenly spread checksums: one count a language
    most = F.lit(None).cast("long")
    for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect():
        bound = -(1 << 63) + min((1 << 64) - 1, (SAMPLE_PER_LANGUAGE << 64) // r["n"])
        most = F.when(F.col("lang") == r["lang"], F.lit(bound)).otherwise(most)
    chosen = rows.filter(mark <= most).dropDuplicates(["lang", "id"]).select("lang", "id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for lang, i, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "id", "text")], strict=True):
                codes, n = grams_of(text)
                for c, v in zip(out, (lang, zlib.crc32(i.encode()) % CALIBRATION_SHARE == 0, codes.tobytes(), n.astype(np.int32).tobytes(), len(text)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1]), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())], ["lang", "aside", "codes", "n", "length"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of this task's fitted rows, summed by language; rows set aside pass."""
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in count(batches):
            aside = batch.column("aside").to_pylist()
            if any(aside):
                yield batch.filter(batch.column("aside"))
            for r in batch.filter(pa.array([not x for x in aside])).to_pylist():
                pairs = np.frombuffer(r["codes"], np.uint64), np.frombuffer(r["n"], np.int32).astype(np.int64)
                sums.setdefault(r["lang"], []).append(pairs)
                if len(sums[r["lang"]]) > 100:
                    sums[r["lang"]] = [_merge(sums[r["lang"]])]
        for lang, parts in sums.items():
            codes, n = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([False]), pa.array([codes.tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary()), pa.array([0], pa.int64())], ["lang", "aside", "codes", "n", "length"])

    got = chosen.coalesce(8).mapInArrow(total, "lang string, aside boolean, codes binary, n binary, length long").collect()  # bounded by the sample
    parts: dict[str, list] = {}
    aside = []
    for r in got:
        codes, n = np.frombuffer(bytes(r["codes"]), np.uint64), np.frombuffer(bytes(r["n"]), np.int32).astype(np.int64)
        if r["aside"]:
            aside.append((r["lang"], codes, n, r["length"]))
        else:
            parts.setdefault(r["lang"], []).append((codes, n))
    models = LanguageModels({lang: m for lang, p in parts.items() if len((m := _merge(p))[0])})
    calibrate(models, aside)
    return models


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    if not len(codes):
        return codes, n
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(n, at)


def predict(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected, best (the language that the lowest cross-entropy names, rejected or not) of
    every row."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample of the fit
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.judge(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "entropy", "rejected", "best"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean, best string")
