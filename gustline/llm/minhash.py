"""Near-duplicates by b-bit MinHash.

A text's set is its distinct word shingles (64-bit hashes). ``PERMUTATIONS`` minima give ``BANDS`` band keys for
candidates; of each minimum only the low ``B = 2`` bits are kept, packed into machine words, and the similarity
of a candidate pair is estimated from bit counts, corrected for the collisions of two bits. Pairs whose estimate
is ``SLACK`` or more below the threshold are dropped; all others are confirmed on the full sets. By the binomial
tail, a link of similarity 0.8 is dropped so with probability 4e-10, and by the long signatures with less than 1e-9.

Candidates never grow with the square of a group. Texts with equal sets are one node. In each band bucket every
member is compared with one pivot, the smallest id; links form connected components; buckets whose members
all lie in one component are closed. Buckets still open are compared with further random pivots, and what then
remains open is compared pair by pair across components, without a cap; there the size bound and the estimate are conditions of the join.
That last step is quadratic in what stays open (a bucket full of texts that are alike but not linked: every one of its pairs has to be told
from a link), with 64 machine words a comparison; the number of its pairs is logged, and the adaptive skew join splits such a bucket over tasks. PAIRS_A_MEMBER chooses
by that number between further pivots and this step: a choice of plan, the links are the same. With 32 bands of 4 minima, two texts with similarity 0.8 share a bucket with probability 1 - 5e-8.

Defined results: a null text, or one without words, has an empty set, links with nothing and is kept; a text
with fewer words than a shingle has one shingle, its whole word sequence; rows that share an id are one
document, linked where any of its rows is; repeated rows each give a row; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.components import connected_components
from gustline.llm.shared import lean, stash, unstash

PERMUTATIONS, BANDS, B, SLACK = 128, 32, 2, 0.3
#: Rounds with random pivots, pivots a bucket, and open pairs a member from which such a round is worth while.
PIVOT_ROUNDS, PIVOTS, PAIRS_A_MEMBER = 2, 4, 256

#: Signature of members of buckets that stay open, and its slack; its first positions are compared first, with a slack that is as many
#: standard errors wide.
FINE_PERMUTATIONS, FINE_SLACK = 4096, 0.05
FIRST_PERMUTATIONS, FIRST_SLACK = 1024, 0.1

_log = logging.getLogger(__name__)
_STEP = 2048
_rng = np.random.Generator(np.random.PCG64(20240817))
_A = _rng.integers(1, 1 << 32, FINE_PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, FINE_PERMUTATIONS, dtype=np.uint32)
_K = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Words are runs without ASCII white space, A-Z lower-cased."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, parts), np.uint64, len(parts))
    n = len(h)
    if n < words:  # one shingle; its hash depends on the number of words
        return _finish((h * _K[:n]).sum(keepdims=True, dtype=np.uint64) + _K[32 + n])
    s = h[: n - words + 1] * _K[0]
    for k in range(1, words):
        s += h[k : n - words + 1 + k] * _K[k]
    s = _finish(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def minima(s: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The least value of each permutation over a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(permutations, 0xFFFFFFFF, np.uint32)
    a, c = _A[:permutations], _C[:permutations, None]
    step = _STEP * PERMUTATIONS // permutations
    for at in range(0, len(x), step):
        y = np.multiply.outer(a, x[at : at + step])
        y += c
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = PERMUTATIONS // BANDS
    k = (m.reshape(BANDS, rows).astype(np.uint64) + np.uint64(1)) * _K[:rows]
    return _finish(k.sum(axis=1, dtype=np.uint64) + _K[32] * np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of all minima: B planes of PERMUTATIONS bits as 64-bit words, plane by plane."""
    mixed = _finish(m.astype(np.uint64) * _K[7])
    bits = np.concatenate([(mixed >> np.uint64(p)).astype(np.uint8) & 1 for p in range(B)])
    return np.packbits(bits).view(np.int64)


def estimate(a: Column, b: Column, permutations: int = PERMUTATIONS, first: int | None = None) -> Column:
    """Similarity from packed signatures: the share of equal positions (of the ``first`` ones), corrected for chance collisions."""
    per, words = permutations // 64, (first or permutations) // 64
    if words <= 16:
        differ = sum((F.bit_count(_any_plane(a, b, F.lit(w), per)) for w in range(words)), F.lit(0))
    else:  # a loop: written out, the condition would outgrow what the JVM compiles
        differ = F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda n, w: n + F.bit_count(_any_plane(a, b, w, per)))
    equal = 1 - differ / F.lit(64 * words)
    chance = 2.0**-B
    return (equal - chance) / (1 - chance)


def _any_plane(a: Column, b: Column, w: Column, per: int) -> Column:
    out = F.get(a, w).bitwiseXOR(F.get(b, w))
    for p in range(1, B):
        out = out.bitwiseOR(F.get(a, w + p * per).bitwiseXOR(F.get(b, w + p * per)))
    return out


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, digest, bits, bands = [], [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), words)
                n.append(len(s))
                if len(s):
                    m = minima(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bits.append(pack(m))
                    bands.append(band_keys(m))
                else:
                    digest.append(None)
                    bits.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "bits", "bands"],
            )

    return rows.mapInArrow(lean(run), "doc_id long, n long, digest binary, bits array<long>, bands array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 200):
                some = [shingle_set(t.as_py(), words).tobytes() for t in texts[at : at + 200]]
                yield pa.RecordBatch.from_arrays([ids[at : at + 200], pa.array(some, pa.binary())], ["id", "s"])

    return rows.mapInArrow(lean(run), "id long, s binary")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    num, den = threshold.numerator, threshold.denominator
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate([p, q])
                z.sort()
                same = int((z[1:] == z[:-1]).sum())
                keep.append(den * same >= num * (len(z) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    limit = Fraction(str(threshold))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    thin = stash(_signatures(rows, words))
    # one node for each set; the id of its smallest member names it
    nodes = stash(thin.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    placed = nodes.select("id", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).filter("pivot != other")
    members = stash(placed.join(shared.select("key", "pivot"), "key"))  # of buckets with two nodes or more
    bits = nodes.select("id", "n", "bits")
    wanted = members.select("id").distinct()
    sets = stash(_sets(rows.join(wanted, rows["doc_id"] == wanted["id"], "left_semi"), words))
    links = stash(_linked(members.filter("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")), bits, sets, limit))
    comp = stash(connected_components(links))
    for turn in range(PIVOT_ROUNDS + 1):
        opened = stash(_open_members(members, comp))
        n_members, n_pairs = _open_size(opened)
        if not n_pairs:
            break
        _log.info("open buckets, round %d: %d members, %d pairs across components", turn, n_members, n_pairs)
        last = turn == PIVOT_ROUNDS or n_pairs <= PAIRS_A_MEMBER * n_members
        pairs = _open_pairs(opened, nodes, sets, limit) if last else _pivot_pairs(opened, bits, limit, turn)
        links = stash(links.unionByName(_confirm(pairs.distinct(), sets, limit)))  # the joins that made them hold the bounds
        comp = stash(connected_components(links))
        unstash(opened)
        if last:
            break
    unstash(sets)
    # rows of one id are one document: ids tie their sets together
    by_set = thin.filter("doc_id is not null").select("doc_id", "digest").distinct()
    twice = by_set.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    tied = by_set.join(twice, "doc_id").join(nodes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    if not tied.isEmpty():
        comp = stash(connected_components(links.unionByName(tied)))
    name = nodes.join(comp, nodes["id"] == comp["node"], "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = thin.filter("n > 0").select("doc_id", "n", "digest").join(name, "digest", "left").select("doc_id", "n", "component")
    out = out.unionByName(thin.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sizes_fit(na: Column, nb: Column, threshold: Fraction) -> Column:
    return F.least(na, nb) * threshold.denominator >= F.greatest(na, nb) * threshold.numerator


def _linked(pairs: DataFrame, bits: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Distinct pairs that pass the size bound, the signature estimate and the full comparison."""
    pairs = pairs.filter("a != b").distinct()
    x = bits.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = bits.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    near = pairs.join(x, "a").join(y, "b").filter(_sizes_fit(F.col("na"), F.col("nb"), threshold) & (estimate(F.col("xa"), F.col("xb")) > float(threshold) - SLACK))
    return _confirm(near.select("a", "b").distinct(), sets, threshold)


def _fine(sets: DataFrame) -> DataFrame:
    """id and long packed signature of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [pack(minima(np.frombuffer(x.as_buffer(), np.uint64), FINE_PERMUTATIONS)) for x in batch.column("s")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits, pa.list_(pa.int64()))], ["id", "bits"])

    return sets.mapInArrow(lean(run), "id long, bits array<long>")


def _open_pairs(opened: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """All pairs across components within open buckets that may reach the threshold, each from the first bucket
    that both are in. Long signatures are made for these members only, and the bounds are conditions of the join
    itself: pairs that fail them are never rows."""
    long = _fine(sets.join(opened.select("id").distinct(), "id", "left_semi"))
    full = opened.join(nodes.select("id", "n", "bits", "bands").join(long.withColumnRenamed("bits", "fine"), "id"), "id")
    x, y = full.alias("x"), full.alias("y")
    coarse = estimate(F.col("x.bits"), F.col("y.bits")) > float(threshold) - SLACK
    # from the cheapest test to the dearest
    near = _sizes_fit(F.col("x.n"), F.col("y.n"), threshold) & coarse & (estimate(F.col("x.fine"), F.col("y.fine"), FINE_PERMUTATIONS, FIRST_PERMUTATIONS) > float(threshold) - FIRST_SLACK)
    fine = estimate(F.col("x.fine"), F.col("y.fine"), FINE_PERMUTATIONS) > float(threshold) - FINE_SLACK
    first = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & near & first & fine
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _open_members(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, id, comp of the members of buckets that hold more than one component."""
    put = members.join(comp, members["id"] == comp["node"], "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    still = put.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    return put.join(still, "key")


def _open_size(opened: DataFrame) -> tuple[int, int]:
    """Members of open buckets, and their pairs across components."""
    by = opened.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    row = by.agg(F.sum("s").alias("m"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("p")).first()
    return row["m"] or 0, (row["p"] or 0) // 2


def _pivot_pairs(opened: DataFrame, bits: DataFrame, threshold: Fraction, turn: int) -> DataFrame:
    """Members outside of an open bucket's largest component with PIVOTS random members of that component, where
    size and estimate allow a link (conditions of the join: other pairs are never rows)."""
    sizes = opened.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("comp", "k").alias("main"))
    mine = opened.join(sizes, "key").join(bits, "id")
    one = F.struct(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(turn * PIVOTS + k)).alias("h"), one.alias("p"))).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = mine.filter("comp = main").groupBy("key").agg(*picks).select("key", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.p") for k in range(PIVOTS)]))).alias("p")).select("key", "p.*")
    out = mine.filter("comp != main").select("key", F.col("id").alias("a"), "n", "bits")
    fits = _sizes_fit(F.col("n"), F.col("nb"), threshold) & (estimate(F.col("bits"), F.col("xb")) > float(threshold) - SLACK)
    return out.alias("o").join(chosen.alias("c"), (F.col("o.key") == F.col("c.key")) & fits).select("a", "b")


def near_dedup(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a smaller id of their component stands for."""
    gone = near_duplicates(docs, words, threshold, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone_id"], "left_anti")
