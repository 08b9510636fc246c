"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

Words are the runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is ``n``
consecutive words of a benchmark item; an item of fewer words is one window. The windows' 64-bit hashes are the hash
set, which goes out in two forms: a bitmap of 16 bits a window or more (up to ``MOST_BITS``; a literal of the plan) that every window of a document's words
is tested against where it stands, and a relation from hash to window and items, which the few windows that pass the
bitmap are joined with and compared with word for word. The relation is broadcast up to ``BROADCAST_WINDOWS`` windows
(counted before) and shuffled by hash beyond; rows and results are the same.

Only DataFrame functions run, nothing is sampled, and each document is read once; what leaves the scan is one row a document and
one a hit. A document is one group of the final aggregation, which combines before it shuffles.

Defined results: a null or empty text has no words, no hits and is not contaminated; items without words hold
no window; repeated rows each give a row; equal ids with different texts are judged apart; without benchmark
rows nothing is hit; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.shared import ascii_lower, stash

#: A word separator, once A-Z is lower-cased; a word before that, with the separators ahead of it.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UNIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows up to which the relation is broadcast; least and most bits of the bitmap (logarithms).
BROADCAST_WINDOWS = 250_000
LEAST_BITS, MOST_BITS = 10, 24


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def hashes_of(words: Column) -> Column:
    """A hash for each word: a window's hash is that of its words' hashes, so that every word's letters are read once."""
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, words, items of every distinct window."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    each = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), n).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64(hashes_of(F.col("words"))).alias("hash"), "words", "items")


def _bitmap(windows: DataFrame, count: int) -> tuple[Column, int]:
    """The set bits as an array of longs, by the highest bits of the hash, and the logarithm of their number."""
    bits = min(max((16 * count - 1).bit_length(), LEAST_BITS), MOST_BITS)
    at = _cell("hash", bits)
    rows = windows.groupBy(at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit("hash"))).alias("v")).collect()  # 2**(bits - 6) at most
    cells = [0] * (1 << (bits - 6))
    for r in rows:
        cells[r["at"]] = r["v"]
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>"), bits


def _cell(h: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits + 6).cast("int")


def _bit(h: Column | str) -> Column:
    return (F.col(h) if isinstance(h, str) else h).bitwiseAND(F.lit(63)).cast("int")


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, all_rows: bool) -> DataFrame:
    """doc_id, tkey (checksum of the text), n_words, copies (equal rows; 0 unless ``all_rows``), spans (first word and number of words), items."""
    windows = stash(windows_of(benchmark, n))
    size = windows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.size("words"))).alias("lengths")).first()  # n lengths at most
    bitmap, bits = _bitmap(windows, size["n"])
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("tkey"), words_of(text).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn("h", hashes_of(F.col("w")))  # before the explode, which then leaves the words behind

    def found(length: int) -> Column:
        """Places and hashes of the windows of ``length`` words that pass the bitmap."""
        # the hashes are named more than once here, which keeps the optimizer from working them out anew for every window
        starts = F.when(F.size("h") >= length, F.sequence(F.lit(1), F.size("h") - (length - 1))).otherwise(F.array().cast("array<int>"))
        each = F.transform(starts, lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("h", i, length)).alias("hash")))
        some = F.filter(each, lambda x: F.getbit(F.get(bitmap, _cell(x["hash"], bits)), _bit(x["hash"])) == 1)
        return F.transform(some, lambda x: F.struct(x["i"].alias("i"), x["hash"].alias("hash"), F.slice("w", x["i"], length).alias("own")))

    base = F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("array<string>").alias("own")))
    place = F.concat(base if all_rows else F.slice(base, 1, 0), *[found(k) for k in size["lengths"]])
    # an outer explode: for a plain one the optimizer infers a filter that would make all places twice
    places = rows.select("doc_id", "tkey", "n_words", F.explode_outer(place).alias("p")).select("doc_id", "tkey", "n_words", "p.*")
    known = windows.withColumnRenamed("hash", "known")
    known = F.broadcast(known) if size["n"] <= BROADCAST_WINDOWS else known
    # the comparison in full
    met = places.join(known, F.col("hash") == F.col("known"), "left" if all_rows else "inner").withColumn("hit", F.coalesce(F.col("own") == F.col("words"), F.lit(False)))
    met = met.filter("hit or i = 0" if all_rows else "hit")
    span = F.when(F.col("hit"), F.struct((F.col("i") - 1).cast("long").alias("s"), F.size("words").cast("long").alias("l")))
    return met.groupBy("doc_id", "tkey").agg(
        F.max("n_words").alias("n_words"),
        F.sum((F.col("i") == 0).cast("long")).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("items")))))).alias("items"),
    )


def _judged(hits: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["s"] + x["l"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["s"] + x["l"]).alias("end")),
        lambda a: a["n"],
    )
    return hits.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", all_rows: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated. ``all_rows=False``: only documents with hits."""
    per = _judged(_hits(docs, benchmark, n, id_col, text_col, all_rows))
    if all_rows:
        per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the rule of :func:`contamination` names (by id)."""
    bad = contamination(docs, benchmark, n, id_col, text_col, all_rows=False).filter("contaminated").select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(bad["__bad_id"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every hit word, and the separators ahead of it, taken out of its text; all else stays as it is."""
    hits = _hits(docs, benchmark, n, id_col, text_col, False).select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key"), F.col("spans").alias("__spans"))
    text = F.col(f"`{text_col}`")
    both = docs.join(hits, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")
    units = F.filter(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u, k: ~F.exists("__spans", lambda s: (s["s"] <= k) & (k < s["s"] + s["l"])))
    rest = F.concat(F.array_join(units, ""), F.regexp_replace(text, "(?s)^(?:" + UNIT + ")*+", ""))
    return both.select(*[F.when(F.col("__spans").isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
