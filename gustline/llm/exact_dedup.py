"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, an external sort places equal texts next to each
other, and the sorted rows are told apart by full comparisons of neighbours (the boundary test of a window over
the range and the text). Normalising, sorting and comparing run in the JVM; one Arrow function looks up a row's range.

A splitter is as long as it must be to differ from the sampled text before it. Where a text is so frequent that
neighbours in the sample are equal, the splitter is the whole text and an id, so that one text that holds a third of all
rows is dealt over as many ranges as its share asks for. Every row is compared with such texts in full, and what their
ranges hold together (size, id that stays) is one pre-aggregated row a text. The sample has SAMPLE_A_RANGE rows
a range; the driver gets the splitters only, of MOST_CHARS characters together: longer ones are left out, which merges
two ranges and changes no result.

Defined results: a null text counts as the empty text; repeated rows are separate rows of one group, and of
rows that share the kept id exactly one is kept; a null id never wins against a present one; an empty table gives an empty
result; further columns of the input never take part (they are carried as one struct where rows are returned).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.shared import ascii_lower, lean

#: Sampled rows a range, and characters of all splitters together.
SAMPLE_A_RANGE, MOST_CHARS = 32, 16_000_000

_BEFORE_ALL, _AFTER_ALL = -(1 << 65), 1 << 65


def normalised(text: Column) -> Column:
    """A-Z lower-cased; null is empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _id_order(keep: str) -> Column:
    return F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()


def _rank(doc_id: int | None, keep: str) -> int:
    """Orders ids as :func:`_id_order` does."""
    return _AFTER_ALL if doc_id is None else -doc_id if keep == "max" else doc_id


def splitters(rows: DataFrame, ranges: int, keep: str, seed: int = 11) -> list[tuple[str, int]]:
    """About ``ranges`` - 1 sorted pairs: a row belongs after all pairs that are not above its (text, rank of its id). The
    rank is that of a row only where the pair's text is a whole, frequent one."""
    n = rows.count()
    some = rows if n <= ranges * SAMPLE_A_RANGE else rows.sample(ranges * SAMPLE_A_RANGE / n, seed)
    one = some.select("doc_id", normalised(F.col("text")).alias("t")).repartition(1).sortWithinPartitions("t", _id_order(keep))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, k = None, 0
        for batch in batches:
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if k and k % SAMPLE_A_RANGE == 0:
                    if t == before:
                        out.append((t, True, i))
                    else:
                        same = next((j for j, (a, b) in enumerate(zip(before, t)) if a != b), min(len(before), len(t)))
                        out.append((t[: same + 1], False, None))
                before, k = t, k + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.string(), pa.bool_(), pa.int64()))], ["t", "whole", "doc_id"])

    got = [(r["t"], _rank(r["doc_id"], keep) if r["whole"] else _BEFORE_ALL) for r in one.mapInArrow(lean(cut), "t string, whole boolean, doc_id long").collect()]
    got = sorted(set(got))
    while sum(len(t) for t, _ in got) > MOST_CHARS:
        got.remove(max(got, key=lambda s: len(s[0])))
    return got


def _placed(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: bool) -> tuple[DataFrame, int]:
    """doc_id, text (and row, all columns), p (the range), hot (number of the frequent text that it equals, or -1); number of ranges."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    spark = docs.sparkSession
    cuts = splitters(rows.select("doc_id", "text"), int(spark.conf.get("spark.sql.shuffle.partitions")), keep)
    hot = {t: k for k, t in enumerate(dict.fromkeys(t for t, r in cuts if r != _BEFORE_ALL))}
    longest = max((len(t) for t, _ in cuts), default=0) + 1
    sent = spark.sparkContext.broadcast((cuts, hot))  # bounded by MOST_CHARS

    @F.pandas_udf("struct<p:int,hot:int>")
    def place(doc_id: pd.Series, start: pd.Series) -> pd.DataFrame:
        at, often = sent.value
        p = [bisect_right(at, (t, _rank(None if i is None or i != i else int(i), keep))) for i, t in zip(doc_id, start)]
        return pd.DataFrame({"p": p, "hot": [often.get(t, -1) for t in start]}).astype("int32")

    # ids travel as text: a column of numbers with nulls would lose their last digits
    args = F.col("doc_id").cast("string"), F.substring(normalised(F.col("text")), 1, longest)
    to = place.asNondeterministic()(*args)  # else a filter on the result would run it twice
    return rows.withColumn("to", to).select(*rows.columns, F.col("to.p").alias("p"), F.col("to.hot").alias("hot")), len(cuts) + 1


def _sorted(placed: DataFrame, text: Column, ranges: int, keep: str) -> tuple[DataFrame, Window]:
    """The rows in content order within their range, with t, the normalised ``text``; a window over equal neighbours."""
    dealt = placed.repartitionById(ranges, F.col("p")).withColumn("t", normalised(text))
    return dealt.sortWithinPartitions("p", "t", _id_order(keep)), Window.partitionBy("p", "t")


def _hot_totals(placed: DataFrame, keep: str) -> DataFrame:
    """hot, g_keep, g_n, g_p (the range of the row that stays) of the texts that lie in several ranges: no more rows than splitters."""
    best = F.max if keep == "max" else F.min
    return F.broadcast(placed.filter("hot >= 0").groupBy(F.col("hot").alias("h")).agg(best("doc_id").alias("g_keep"), F.count("*").alias("g_n"), F.min("p").alias("g_p")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``keep``: ``max`` or ``min`` id stays."""
    placed, ranges = _placed(docs, id_col, text_col, keep, False)
    rows, equal = _sorted(placed, F.col("text"), ranges, keep)
    ordered = equal.orderBy(_id_order(keep))
    runs = rows.select("doc_id", "p", "hot", "t", F.row_number().over(ordered).alias("k"), F.first("doc_id").over(ordered).alias("keep_id"), F.count("*").over(equal).alias("n"))
    runs = runs.select("doc_id", "p", "hot", "k", "keep_id", "n", F.sha2("t", 256).alias("text_sha256"))
    whole = _hot_totals(placed, keep)
    lone = F.col("h").isNull()
    return runs.join(whole, F.col("hot") == F.col("h"), "left").select(
        "doc_id",
        F.when(lone, F.col("keep_id")).otherwise(F.col("g_keep")).alias("keep_id"),
        F.when(lone, F.col("n")).otherwise(F.col("g_n")).alias("group_size"),
        ((F.col("k") == 1) & (lone | (F.col("p") == F.col("g_p")))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    placed, ranges = _placed(docs, id_col, text_col, keep, True)
    whole = _hot_totals(placed, keep)
    # the text travels inside the row only
    rows, equal = _sorted(placed.select("doc_id", "row", "p", "hot"), F.col("row").getField(text_col), ranges, keep)
    first = rows.withColumn("k", F.row_number().over(equal.orderBy(_id_order(keep)))).filter("k = 1")
    kept = first.join(whole, F.col("hot") == F.col("h"), "left").filter("h is null or p = g_p")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
