"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all preceding turns are its context and only its reply is trainable.
Conversations are formatted turn by turn and cut into pieces of about PIECE_CHARS characters; an example is
its rows: every earlier piece whole, and the target's own piece up to and with the target. So the
context is repeated in every example and never cut, a row is bounded by a piece and one turn, and a task
holds one piece at a time, also for a conversation that holds a third of all rows (whose examples are quadratic
in its turns, which is what the method asks for).

Template of a turn: ``<s>[ROLE] role [INST] text [/INST]</s>`` and a line feed. Inside roles and texts the
three characters ``\\``, ``<`` and ``[`` are written ``\\\\``, ``\\l`` and ``\\b``, so that no control string
can occur there; the escape is reversible.

Rows are range-partitioned by (conversation, turn, role, text) and sorted; a conversation that crosses
partitions is continued from its first part's figures. Defined results: null texts and roles are empty; repeated
turns are ordered by role and text; a null conversation id is one conversation; an empty table gives an empty
result; further columns are not read; roles other than ``assistant`` are never trainable; turns after the last
target are in no example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.shared import stash

#: The template's fixed strings, by part of a turn.
OPEN, MID, SHUT, END = "<s>[ROLE] ", " [INST] ", " [/INST]", "</s>\n"
TARGET_ROLE = "assistant"
#: Characters of a piece, and of the rows that are handed on together.
PIECE_CHARS, BATCH_CHARS = 1 << 16, 1 << 22

_ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_UNESCAPE = {"\\\\": "\\", "\\l": "<", "\\b": "["}
_BODY = r"([^\\<\[]*(?:\\[\\lb][^\\<\[]*)*)"
_SEGMENT = re.compile(re.escape(OPEN) + _BODY + re.escape(MID) + _BODY + re.escape(SHUT) + re.escape(END))


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: _UNESCAPE[m[0]], text) if "\\" in text else text


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and start and end of its reply."""
    head = OPEN + escape(role) + MID
    body = escape(text)
    return head + body + SHUT + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation or part of one."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, part, seq (place in this part of the conversation), ahead, before (characters and
    targets ahead of the turn in this part), segment, loss_start, loss_end (the trainable characters of the segment; both null for
    a turn that is no target).

    The segments of a conversation in the order (part, seq) are its formatted text."""
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    # the splitters' sample holds a digest in place of the text
    rows = rows.withColumn("mark", F.sha2("text", 256))
    order = ["conv_id", "turn", "role", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, seq, chars, targets = object(), 0, 0, 0
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            seqs, aheads, befores, texts, starts, ends = [], [], [], [], [], []
            for c, role, text in zip(convs, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seq, chars, targets = (seq + 1, chars, targets) if c == conv else (0, 0, 0)
                conv = c
                s, a, b = segment(role, text)
                target = role == TARGET_ROLE
                seqs.append(seq)
                aheads.append(chars)
                befores.append(targets)
                chars += len(s)
                targets += target
                texts.append(s)
                starts.append(a if target else None)
                ends.append(b if target else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([part] * len(convs), pa.int32()), pa.array(seqs, pa.int64()), pa.array(aheads, pa.int64()), pa.array(befores, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["conv_id", "part", "seq", "ahead", "before", "segment", "loss_start", "loss_end"],
            )

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, part int, seq long, ahead long, before long, segment string, loss_start int, loss_end int")


def _pieces(formatted: DataFrame) -> DataFrame:
    """The rows of :func:`expand`, and as example n_examples + 1, without loss and context, the turns after the
    last target."""
    w = Window.partitionBy("conv_id").orderBy("part")
    parts = formatted.groupBy("conv_id", "part").agg(F.sum(F.length("segment")).alias("chars"), F.count("loss_start").alias("k"))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.sum("chars").over(w) - F.col("chars")).alias("chars"), (F.sum("k").over(w) - F.col("k")).alias("k"), F.sum("k").over(Window.partitionBy("conv_id")).alias("n"))
    turns = formatted.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    turn = F.struct("part", "seq", (F.col("k") + F.col("before")).alias("before"), "segment", "loss_start", "loss_end")
    piece = F.floor((F.col("chars") + F.col("ahead")) / PIECE_CHARS).alias("piece")
    rows = turns.groupBy("conv_id", piece).agg(F.first("n").alias("n_examples"), F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_examples", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])

    def examples(conv, piece, n, turns) -> Iterator[tuple]:
        text = "".join(t["segment"] for t in turns)
        k, at, told = turns[0]["before"], 0, 0
        for t in turns:
            start, at = at, at + len(t["segment"])
            if t["loss_start"] is not None:
                k, told = k + 1, at
                yield conv, k, n, piece, text[:at], start + t["loss_start"], start + t["loss_end"]
        if k == n and told < at:
            yield conv, n + 1, n, piece, text[told:], None, None
        for later in range(k + 1, n + 1):
            yield conv, later, n, piece, text, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "piece", "n_examples", "turns")], strict=True):
                for x in examples(*row):
                    out.append(x)
                    chars += len(x[4])
                    if chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, "conv_id long, example long, n_examples long, piece long, text string, loss_start int, loss_end int")


def expand(formatted: DataFrame) -> DataFrame:
    """The examples: conv_id, example (from 1 on in the order of the targets), n_examples of the conversation,
    piece, text, loss_start, loss_end.

    The texts of an example in the order of piece are all turns up to its target. The loss range, in the text of the
    last piece, is the target's reply; all else is context. An example of at most PIECE_CHARS characters is one
    row."""
    return _pieces(formatted).filter("example <= n_examples")


class _Digest:
    """What is read back from the examples of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.ends: list[tuple[int, int]] = []  # turns and characters up to each target
        self.example, self.seen = 0, (0, 0)

    def add(self, formatted: str) -> None:
        """The next piece of the longest example, or of what follows it."""
        for role, text in parse(formatted):
            self.turns += 1
            self.chars += len(segment(role, text)[0])
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == TARGET_ROLE:
                self.ends.append((self.turns, self.chars))

    def reply(self, example: int, turns: int, chars: int, reply: str | None) -> None:
        """The next piece of any example; the last one has its reply."""
        if example != self.example:
            self.example, self.seen = example, (0, 0)
        self.seen = (self.seen[0] + turns, self.seen[1] + chars)
        if reply is not None:
            if self.seen != self.ends[example - 1]:
                raise ValueError(f"example {example} of conversation {self.conv} is not the prefix of its target")
            self.loss_chars += len(reply)
            self.loss.update(reply.encode("utf-8", "surrogatepass"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from its
    examples: the turns and characters of the longest one and of what follows it, and the replies of all. Every piece
    of every example is parsed, and an example that does not hold exactly the turns up to its target is an error.

    A digest over a conversation is a chain, so its parts meet in order; they stream through, none is held, and
    of the shorter examples only counts and replies travel."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    lean = pa.schema([("conv_id", pa.int64()), ("kind", pa.int32()), ("example", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("turns", pa.int64()), ("chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, k, n, piece, text, a, b in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "example", "n_examples", "piece", "text", "loss_start", "loss_end")], strict=True):
                if k >= n:
                    out.append((c, 0, k, piece, text, 0, 0))
                if k <= n:
                    out.append((c, 1, k, piece, None if a is None else unescape(text[a:b]), len(parse(text)), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), lean)], schema=lean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        out: list[_Digest] = []

        def flush(done: list[_Digest]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d.conv for d in done], pa.int64()),
                    pa.array([d.turns for d in done], pa.int64()),
                    pa.array([d.all.hexdigest() for d in done], pa.string()),
                    pa.array([d.loss_chars for d in done], pa.int64()),
                    pa.array([d.loss.hexdigest() for d in done], pa.string()),
                    pa.array([d.chars for d in done], pa.int64()),
                ],
                schema=schema,
            )

        for batch in batches:
            for c, kind, k, text, turns, chars in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "kind", "example", "text", "turns", "chars")], strict=True):
                if now is None or now.conv != c:
                    if now is not None:
                        now.ends = []
                        out.append(now)
                    now = _Digest(c)
                if kind == 0:
                    now.add(text)
                else:
                    now.reply(k, turns, chars, text)
            if len(out) >= 5000:
                yield flush(out)
                out = []
        if now is not None:
            out.append(now)
        if out:
            yield flush(out)

    rows = _pieces(formatted).mapInArrow(read, "conv_id long, kind int, example long, piece long, text string, turns long, chars long")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "example", "piece").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Format, write down, expand, read back."""
    return read_back(stash(format_turns(turns)))
