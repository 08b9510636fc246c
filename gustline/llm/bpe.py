"""BPE encoding and decoding.

The encoder replays no merges. A word is covered from the left by the longest vocabulary entry (found by an
Aho-Corasick automaton over all entries); a choice stands if the pair of the last two entries is one that the
merge order itself would leave standing (the pair-compatibility table), otherwise the encoder backtracks to
the next shorter entry. The first full cover is the exact result of the merges, in time linear in the word's
length. Decoding joins slices of one byte buffer by an offset table.

The vocabulary file is read from a path given as a parameter; it is never copied. Texts go through the file's
own steps: special tokens are cut out first, then NFC, runs of white space to one space, lower case, the
file's split pattern, and byte-to-letter mapping with a word-end suffix.

Defined results: a null text counts as empty and has no ids; an empty table gives an empty result; repeated
rows are encoded one by one; very long texts stream through pre-tokens, nothing is cut; further columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.shared import lean

#: Entries of a worker's cache of chunks and words, which is emptied when full, and the longest chunk it takes. Results of
#: the pair-compatibility table that a worker remembers; others are worked out again. Both bound memory only.
CACHE_WORDS = 100_000
CACHE_LETTERS = 48
CACHE_PAIRS = 200_000


_CONTROLS = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class BacktrackingBpe:
    """Encoder and decoder of one ``tokenizers`` JSON file with a BPE model and a word-end suffix."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = 1 + max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.names: list[str] = [""] * size
        for name, i in self.vocab.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.names[i] = name
        self._special_re = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._special_first = sorted({x[0] for x in self.special})
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split = regex.compile(pattern)
        self._spaces = regex.compile(r"\s+")
        self._letters = _byte_letters()
        self._map = str.maketrans({chr(b): c for b, c in enumerate(self._letters)})
        # symbols are handled as tuples of units, the word end being one unit of its own
        self._rank: dict[tuple[int, int], tuple[int, int]] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            whole = self.vocab.get(a + b)
            left, right = self.vocab.get(a), self.vocab.get(b)
            if whole is not None and left is not None and right is not None:
                self._rank.setdefault((left, right), (rank, whole))
                self._halves.setdefault(whole, (left, right))
        self._made = {whole: self._rank[pair][0] for whole, pair in self._halves.items()}
        # the letters of a word's end, with the suffix, are one unit: written as one private letter
        self._ends = {c: chr(0xF0000 + i) for i, c in enumerate(self._letters)}
        self._units: dict[str, int] = {}
        reachable = self._reachable()
        self._auto = ahocorasick.Automaton()
        for name, i in self.vocab.items():
            if i in reachable:
                self._auto.add_word(self._as_units(name), i)
                self._units[self._as_units(name)] = i
        self._auto.make_automaton()
        self._lengths = [0] * size
        for u, i in self._units.items():
            self._lengths[i] = len(u)
        self._shorter = self._shorter_table()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, list[int]] = {}
        self._table()

    def _as_units(self, name: str) -> str:
        s = self.suffix
        if s and name.endswith(s) and len(name) > len(s):
            name = name[: -len(s)]
            return name[:-1] + self._ends[name[-1]] if name[-1] in self._ends else name
        return name

    def _reachable(self) -> set[int]:
        """Entries that the merges can make: single units, and wholes whose halves can be made."""
        ok = {i for name, i in self.vocab.items() if len(self._as_units(name)) == 1}
        for whole, (a, b) in sorted(self._halves.items(), key=lambda x: self._made[x[0]]):
            if a in ok and b in ok:
                ok.add(whole)
        return ok

    def _shorter_table(self) -> dict[int, int]:
        """For each entry the longest entry that is a proper prefix of it."""
        out = {}
        for u, i in self._units.items():
            for k in range(len(u) - 1, 0, -1):
                if (j := self._units.get(u[:k])) is not None:
                    out[i] = j
                    break
        return out

    def _table(self) -> None:
        raw = [n.encode("utf-8") + b" " for n in self.names]
        self._widths = np.array([len(r) for r in raw], np.int64)
        self._offsets = np.cumsum(self._widths) - self._widths
        self._bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave entry ``a`` standing right before entry ``b``: no merge across the seam
        comes before both sides are complete."""
        left, right, limit, ok = a, b, 1 << 60, True
        while True:
            if (hit := self._rank.get((left, right))) is not None and hit[0] < limit:
                ok = False
                break
            up_left, up_right = self._made.get(left, -1), self._made.get(right, -1)
            if up_left < 0 and up_right < 0:
                break
            # undo the later of the two last merges; at equal ranks the left one was made first
            if up_left > up_right:
                limit = up_left
                left = self._halves[left][1]
            else:
                limit = up_right + 1 if up_right >= 0 else limit
                right = self._halves[right][0]
        if len(self._compatible) < CACHE_PAIRS:
            self._compatible[a, b] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of byte letters (without the suffix)."""
        n = len(word)
        units = word[:-1] + self._ends[word[-1]] if self.suffix else word
        longest = [-1] * n
        lengths = self._lengths
        for end, i in self._auto.iter(units):
            longest[end - lengths[i] + 1] = i  # later ends are longer
        dead = bytearray(n + 1)
        out: list[int] = []
        fits, known, shorter = self._fits, self._compatible, self._shorter
        at, token = 0, longest[0]
        while at < n:
            placed = False
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    if not out:
                        placed = True
                        break
                    pair = (out[-1], token)
                    ok = known.get(pair)
                    if fits(*pair) if ok is None else ok:
                        placed = True
                        break
                token = shorter.get(token, -1)
            if placed:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter.get(token, -1)
        return out

    def normalise(self, text: str) -> str:
        """NFC and lower case. Runs of white space stay: the split pattern drops white space of any length."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        cache, out = self._cache, []
        words = (chunk,) if chunk.isalpha() else self._split.findall(chunk)
        for word in words:
            ids = cache.get(word)
            if ids is None:
                ids = self.encode_word(word if word.isascii() and word.isprintable() else word.encode("utf-8", "replace").decode("latin-1").translate(self._map))
                self._keep(word, ids)
            out += ids
        if len(words) > 1:
            self._keep(chunk, out)
        return out

    def _keep(self, chunk: str, ids: list[int]) -> None:
        if len(chunk) <= CACHE_LETTERS:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[chunk] = ids

    def _encode_plain(self, text: str, out: list[int]) -> None:
        known = self._cache.get
        low = self.normalise(text)
        # str.split() takes four control characters for white space that the pattern takes for symbols
        for chunk in low.split() if not _CONTROLS.search(low) else self._spaces.split(low):
            ids = known(chunk)
            out += self._encode_chunk(chunk) if ids is None else ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        at = 0
        if self._special_re is not None and any(c in text for c in self._special_first):
            for m in self._special_re.finditer(text):
                self._encode_plain(text[at : m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
        self._encode_plain(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        """The entries' names joined by a space, as the file names no decoder."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        widths = self._widths[ids]
        ends = np.cumsum(widths)
        at = np.repeat(self._offsets[ids] - ends + widths, widths)
        at += np.arange(len(at))
        return self._bytes[at[:-1]].tobytes().decode("utf-8")


@functools.lru_cache(maxsize=2)
def load(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            n, by_ids, by_text = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                n.append(len(ids))
                by_ids.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                by_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.encode(x.as_py()) for x in batch.column("text")], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(lean(run), "doc_id long, text string")
