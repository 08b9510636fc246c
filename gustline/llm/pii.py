"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags white-space tokens as outside, email, ip, card or phone. Its features are word shapes (counts of
digits, letters, dots, hyphens and signs, length) of a token and of its neighbours, and a few cue words. It is
trained from a small labelled table (:func:`labelled_table`) by full-batch gradient ascent and decoded by
Viterbi in numpy batches. Tokens whose shape outweighs any gain from transitions are certainly outside, so the
chain is cut there without changing its best path; only the pieces in between are decoded.

Runs of one tag become spans if their characters bear the tag out (digit counts, Luhn's rule, an address once
"at" and "dot" are read as signs), and are added where no pattern span lies.

Defined results: a null text counts as empty and has no spans; repeated rows are read one by one; positions
are code points, ends exclusive; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ("outside", *KINDS)

# Fixed patterns. Each is anchored so that a scan is linear: an address is found from its sign, an ip from the
# first digit of a run (a match can start nowhere else).
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = []
    if "@" in text:
        free = 0  # end of the last match
        at = text.find("@")
        while at >= 0:
            m = _DOMAIN.match(text, at)
            start = at
            if m is not None:
                # walk back over the local part in blocks, not before the last match
                lo = at
                while lo > free:
                    block = text[max(free, lo - 64) : lo]
                    tail = _LOCAL.match(block[::-1]).end()
                    start = lo - tail
                    if tail < len(block):
                        break
                    lo = start
                if start < at:
                    out.append((start, 0, m.end()))
                    free = m.end()
            at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- features ---------------------------------------------------------------------------------------------------

#: Cue words of the field: fixed values, by group.
CUES = {1: ("at", "(at)", "[at]", "@"), 2: ("dot", "(dot)", "[dot]"), 3: ("tel", "tel:", "phone", "phone:", "call", "fax", "fax:", "mobile"), 4: ("card", "card:", "visa", "mastercard", "credit"), 5: ("ip", "ip:", "host", "server", "address"), 6: ("mail", "mail:", "email", "email:", "e-mail", "contact")}
_DIGIT_CUTS = np.array([1, 3, 4, 5, 7, 10, 12, 15, 17])
_LENGTH_CUTS = np.array([3, 6, 9, 13, 20])
_SIZES = (len(_DIGIT_CUTS) + 1, 3, 5, 2, 2, 4, 2, 2, len(_LENGTH_CUTS) + 1)  # digits, letters, dots, @, leading +, hyphens, brackets, other signs, length
_N_OWN = int(np.prod(_SIZES))
_N_CTX = (len(_DIGIT_CUTS) + 1) * (len(CUES) + 1) * 2  # digits, cue, hyphen or bracket

_CLASS = np.full(129, 1, np.uint8)  # 1 letter (and all beyond ASCII), 2 digit, 3 dot, 4 @, 5 +, 6 hyphen, 7 bracket, 8 other, 0 space
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 0 if _ch in " \t\n\v\f\r" else 2 if _ch.isdigit() else 1 if _ch.isalpha() else {".": 3, "@": 4, "+": 5, "-": 6, "(": 7, ")": 7, "[": 7, "]": 7, ",": 1, "'": 1}.get(_ch, 8)
_LOW = np.arange(129, dtype=np.int64)
_LOW[65:91] += 32


@functools.lru_cache(maxsize=1)
def _cue_table() -> dict[tuple[int, int, int], int]:
    out = {}
    for group, words in CUES.items():
        for w in words:
            x = np.array([ord(c) for c in w], np.int64)
            out[len(w), int(x.sum()), int((x * np.arange(len(w))).sum())] = group
    return out


def shapes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends, own feature codes and context codes of a text."""
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
    cls = _CLASS[cp]
    solid = np.concatenate([[False], cls != 0, [False]])
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = turn[::2], turn[1::2]
    k = len(starts)
    if not k:
        return starts, ends, np.empty(0, np.int64), np.empty(0, np.int64)
    length = ends - starts

    def count(c: int) -> np.ndarray:
        where = np.flatnonzero(cls == c)
        return np.bincount(np.searchsorted(starts, where, side="right") - 1, minlength=k) if len(where) else np.zeros(k, np.int64)

    digits, dots, ats, plus, hyphens, brackets, other = (count(c) for c in range(2, 9))
    letters = length - digits - dots - ats - plus - hyphens - brackets - other
    d = np.searchsorted(_DIGIT_CUTS, digits, side="right")
    parts = (d, np.minimum((letters > 0) + (letters > 2), 2), np.minimum(dots, 4), np.minimum(ats, 1), (cls[starts] == 5).astype(np.int64), np.minimum(hyphens, 3), np.minimum(brackets, 1), np.minimum(other, 1), np.searchsorted(_LENGTH_CUTS, length, side="right"))
    own = np.zeros(k, np.int64)
    for p, size in zip(parts, _SIZES, strict=True):
        own = own * size + p
    cue = np.zeros(k, np.int64)
    table = _cue_table()
    lengths = np.array(sorted({key[0] for key in table}))
    short = np.flatnonzero(np.isin(length, lengths) & (digits == 0))
    if len(short):
        low = _LOW[cp]
        sums, marks = np.cumsum(low), np.cumsum(low * np.arange(len(low)))
        a, b = starts[short], ends[short] - 1
        s = sums[b] - sums[a] + low[a]
        m = marks[b] - marks[a] + low[a] * a - s * a
        key = (length[short] << 40) | (s << 20) | m
        for (n, x, y), group in table.items():
            cue[short[key == ((n << 40) | (x << 20) | y)]] = group
    ctx = (d * (len(CUES) + 1) + cue) * 2 + ((hyphens > 0) | (brackets > 0))
    return starts, ends, own, ctx


def _own_parts(own: np.ndarray) -> list[np.ndarray]:
    out = []
    for size in reversed(_SIZES):
        out.append(own % size)
        own = own // size
    return out[::-1]


# --- training table ----------------------------------------------------------------------------------------------


def labelled_table(sentences: int = 450, seed: int = 5) -> list[list[tuple[str, int]]]:
    """Labelled sentences of (token, tag): values in varied formats among plain words, figures, dates, hex keys
    and versions. A rule and a seed make it, so the table can be listed at any time."""
    rnd = random.Random(seed)
    syllables = "the on er tion re ing an de la ción sch ung en os au mi ver th a of".split()
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    name = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 8)))
    small = lambda: str(rnd.randint(1, 255))

    def card() -> str:
        d = rnd.choice("345") + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def email() -> list[str]:
        user, host, top = name() + rnd.choice(["", ".", "_"]) + digits(rnd.choice([0, 2])), name(), rnd.choice(["com", "org", "net", "example.com"])
        return rnd.choice([[f"{user}@{host}.{top}"], [f"{user}@{host}.{top}"], [user, rnd.choice(CUES[1]), host, rnd.choice(CUES[2]), top.split(".")[0]], [f"{user}(at){host}.{top}"]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return rnd.choice([["+" + digits(1), f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(2)}", digits(2), c, digits(4)], [f"{a}.{b}.{c}"]])

    def number() -> list[str]:
        d = card()
        return rnd.choice([[d], [d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join((d[:4], d[4:8], d[8:12], d[12:]))], [".".join((d[:4], d[4:8], d[8:12], d[12:]))]])

    def ip() -> list[str]:
        a = ".".join(small() for _ in range(4))
        return [rnd.choice([a, a, a + ":" + digits(4), a + "/" + rnd.choice(["8", "16", "24"])])]

    def noise() -> str:
        return rnd.choice([digits(rnd.randint(1, 6)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", "password=" + "%018x" % rnd.getrandbits(72), '"%x"' % rnd.getrandbits(160), "AKIA" + digits(3) + "BD7EW", f"{digits(2)}:{digits(2)}", "http://www." + name() + ".com/" + digits(3), digits(9), digits(11), f"({digits(4)})", f"{digits(3)}-{digits(3)}", "3.0", "4.0."])

    makers = (email, ip, number, phone)
    cue_groups = {1: 6, 2: 5, 3: 4, 4: 3}
    out = []
    for _ in range(sentences):
        row: list[tuple[str, int]] = []
        for _ in range(rnd.randint(1, 3)):
            row += [(word() + rnd.choice(["", "", "", ",", "."]), 0) for _ in range(rnd.randint(1, 5))]
            if rnd.random() < 0.35:
                row.append((noise(), 0))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                tag = rnd.randint(1, 4)
                if rnd.random() < 0.3:
                    row.append((rnd.choice(CUES[cue_groups[tag]]), 0))
                tokens = makers[tag - 1]()
                row += [(t, tag) for t in tokens]
                if rnd.random() < 0.25:
                    row[-1] = (row[-1][0] + rnd.choice(".,"), tag)
        row += [(word(), 0) for _ in range(rnd.randint(0, 3))]
        out.append(row)
    return out


# --- the field ------------------------------------------------------------------------------------------------------


class Crf:
    """Weights by feature part (own shape parts, shape of the neighbours) and between tags."""

    def __init__(self):
        k = len(TAGS)
        self.parts = [np.zeros((s, k)) for s in _SIZES]
        self.before, self.here, self.after = (np.zeros((_N_CTX, k)) for _ in range(3))
        self.steps = np.zeros((k, k))

    def weights(self) -> list[np.ndarray]:
        return [*self.parts, self.before, self.here, self.after, self.steps]

    def seal(self) -> Crf:
        """One table over whole shapes, for scoring."""
        codes = np.arange(_N_OWN)
        self.own = sum(w[p] for w, p in zip(self.parts, _own_parts(codes), strict=True))
        return self

    def emissions(self, own: np.ndarray, ctx: np.ndarray, head: np.ndarray) -> np.ndarray:
        """``head`` marks each text's first token."""
        e = self.own[own] + self.here[ctx]
        inner = ~head[1:, None]
        e[1:] += self.before[ctx[:-1]] * inner
        e[:-1] += self.after[ctx[1:]] * inner
        return e

    def tags(self, own: np.ndarray, ctx: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are not outside on the best path, and their tags. Several texts may follow each other."""
        if head is None:
            head = np.zeros(len(own), bool)
            head[:1] = True
        e = self.emissions(own, ctx, head)
        # outside for certain: no change of tag here could be made up for by the two transitions it touches
        bound = 2 * float(self.steps.max() - self.steps.min())
        loose = np.flatnonzero(e[:, 1:].max(axis=1) + bound >= e[:, 0])
        if not len(loose):
            return loose, loose
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(loose) > 1) | head[loose[1:]]]))
        lengths = np.diff(np.append(cut, len(loose)))
        path = self._viterbi(e, loose[cut], lengths, head)
        keep = path > 0
        return loose[keep], path[keep]

    def _viterbi(self, e: np.ndarray, first: np.ndarray, lengths: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Best tags of pieces of the chain that begin at ``first``, between tokens that are outside."""
        out = np.zeros(int(lengths.sum()), np.int64)
        offset = np.cumsum(lengths) - lengths
        ends = np.append(head, True)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            some = order[at : at + max(1, 200_000 // longest)]
            at += len(some)
            size = lengths[some]
            score = e[first[some]] + np.where(head[first[some]], 0.0, 1.0)[:, None] * self.steps[0]
            back = np.zeros((longest, len(some), len(TAGS)), np.int8)
            for t in range(1, longest):
                live = int((size > t).sum())  # sorted by length
                through = score[:live, :, None] + self.steps
                back[t, :live] = through.argmax(axis=1)
                score[:live] = through.max(axis=1) + e[first[some[:live]] + t]
            score += np.where(ends[first[some] + size], 0.0, 1.0)[:, None] * self.steps[:, 0]
            tag = score.argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                live = int((size > t).sum())
                out[offset[some[:live]] + t] = tag[:live]
                tag[:live] = back[t, np.arange(live), tag[:live]]
        return out


def train(table: list[list[tuple[str, int]]], rounds: int = 80, rate: float = 0.2, ridge: float = 2e-4, ridge_steps: float = 2e-2) -> Crf:
    """Full-batch gradient ascent (Adam) on the conditional log-likelihood."""
    k = len(TAGS)
    seqs = [(*shapes(" ".join(w for w, _ in row))[2:], np.array([t for _, t in row])) for row in table if row]
    longest = max(len(s[2]) for s in seqs)
    m = len(seqs)
    own, ctx, tag, live = (np.zeros((m, longest), np.int64) for _ in range(4))
    for i, (o, c, t) in enumerate(seqs):
        own[i, : len(t)], ctx[i, : len(t)], tag[i, : len(t)], live[i, : len(t)] = o, c, t, 1
    mask = live.astype(bool)
    parts = _own_parts(own)
    crf = Crf()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in crf.weights()]
    gold = np.eye(k)[tag]
    pairs_mask = mask[:, 1:]
    for turn in range(1, rounds + 1):
        e = sum(w[p] for w, p in zip(crf.parts, parts, strict=True)) + crf.here[ctx]
        e[:, 1:] += crf.before[ctx[:, :-1]] * pairs_mask[..., None]
        e[:, :-1] += crf.after[ctx[:, 1:]] * pairs_mask[..., None]
        alpha, beta = np.zeros((m, longest, k)), np.zeros((m, longest, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = _logsum(alpha[:, t - 1, :, None] + crf.steps, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(crf.steps + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
        z = _logsum(alpha[:, -1], 1)
        node = (gold - np.exp(alpha + beta - z[:, None, None])) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + crf.steps + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs_mask[..., None, None]
        grads = []
        for w, p in zip(crf.parts, parts, strict=True):
            grads.append(_sum_by(p, node, len(w)))
        for w, c, v in ((crf.before, ctx[:, :-1], node[:, 1:]), (crf.here, ctx, node), (crf.after, ctx[:, 1:], node[:, :-1] * pairs_mask[..., None])):
            grads.append(_sum_by(c, v, len(w)))
        seen = np.zeros((k, k))
        np.add.at(seen, (tag[:, :-1][pairs_mask], tag[:, 1:][pairs_mask]), 1)
        grads.append(seen - edge.sum(axis=(0, 1)))
        for w, g, (a, b) in zip(crf.weights(), grads, moments, strict=True):
            g = g / m - (ridge_steps if w is crf.steps else ridge) * w
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            w += rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
    return crf.seal()


def _sum_by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    i, v = index.ravel(), values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(i, v[:, j], size) for j in range(v.shape[1])], 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@functools.lru_cache(maxsize=1)
def default_crf() -> Crf:
    return train(labelled_table())


# --- spans ----------------------------------------------------------------------------------------------------------

_AT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+", re.I)
_DOT = re.compile(r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EDGE = " \t\n\v\f\r.,;:!?\"'"


def _bears_out(kind: int, value: str) -> bool:
    if kind == 0:
        return _ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", value))) is not None
    digits = _NOT_DIGIT.sub("", value)
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/][0-9]+)?", value) is not None and all(int(p) <= 255 for p in re.split("[:/]", value)[0].split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9][0-9 ./-]*[0-9]", value) is not None and luhn(digits)
    return 9 <= len(digits) <= 15 and re.fullmatch(r"\+?[(0-9][0-9 ().-]*[0-9]", value) is not None and (value[0] in "+(" or len(re.split(r"[ ().-]+", value)) >= 3)


#: Letters that are read together at most, where several texts fit.
_TOGETHER = 400_000


def added_spans(texts: list[str], crf: Crf, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans of the field that touch no pattern span of it."""
    out: list[list[tuple[int, int, int]]] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _TOGETHER):
            size += len(texts[to]) + 1
            to += 1
        out += _added(texts[at:to], crf, base[at:to])
        at = to
    return out


def _added(texts: list[str], crf: Crf, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends, own, ctx = shapes("\n".join(texts))
    if not len(starts):
        return out
    owner = np.searchsorted(offsets, starts, side="right") - 1
    head = np.concatenate([[True], owner[1:] != owner[:-1]])
    where, tags = crf.tags(own, ctx, head)
    if not len(where):
        return out
    cut = np.flatnonzero((np.diff(where) > 1) | (np.diff(tags) != 0) | head[where[1:]]) + 1
    for run in np.split(np.arange(len(where)), cut):
        i = int(owner[where[run[0]]])
        text, lo = texts[i], int(offsets[i])
        kind = int(tags[run[0]]) - 1

        def trimmed(a: int, b: int) -> tuple[int, int]:
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            return a, b

        whole = trimmed(int(starts[where[run[0]]]) - lo, int(ends[where[run[-1]]]) - lo)
        spans = [whole]
        if not _bears_out(kind, text[whole[0] : whole[1]]):  # a run may hold several values side by side
            spans = [trimmed(int(starts[where[j]]) - lo, int(ends[where[j]]) - lo) for j in run] if len(run) > 1 else []
        for a, b in spans:
            if b > a and not any(s < b and a < e for s, _, e in base[i]) and _bears_out(kind, text[a:b]):
                out[i].append((a, kind, b))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans, n_added of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(crf or default_crf())  # fixed size
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            counts, digest, spans, more = [[] for _ in KINDS], [], [], []
            texts = [t.as_py() or "" for t in batch.column("text")]
            bases = [base_spans(t) for t in texts]
            for base, new in zip(bases, added_spans(texts, model, bases), strict=True):
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(sorted(base + new)))
                more.append(len(new))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, crf: Crf | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's characters replaced by its kind in angle brackets; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(crf or default_crf())

    def clean(text):
        import pandas as pd

        out = []
        for t in text:
            if t:
                base = base_spans(t)
                parts, at = [], 0
                for s, k, e in sorted(base + added_spans([t], sent.value, [base])[0]):
                    if s >= at:
                        parts += [t[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype="object")

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(f"`{text_col}`")))
