"""Operators of the training-data part against brute force, exact round trips, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from gustline.llm import bpe, chat, components, decontaminate, exact_dedup, langid, minhash, pii, sharding, toxicity, urls

DOC = "doc_id long, text string, sha string, part int, row string"  # extra columns with clashing names
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "r") for i, t in rows], DOC).repartition(3)


EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "One"), (5, "one"), (5, "one"), (6, prose(3000, 1)), (7, "É é"), (8, "é é"), (9, None)]


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


# exact dedup


def lowered(t):
    return (t or "").translate(str.maketrans(UPPER, UPPER.lower()))


def check_exact(spark, data, keep):
    got = exact_dedup.exact_groups(docs(spark, data), keep=keep).collect()
    groups = {}
    for i, t in data:
        groups.setdefault(lowered(t), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(data)
    for g in got:
        ids = by_sha[g["text_sha256"]]
        known = [i for i in ids if i is not None]
        best = None if not known else max(known) if keep == "max" else min(known)
        assert (g["keep_id"], g["group_size"]) == (best, len(ids)) and (not g["kept"] or g["doc_id"] == best)
    assert sum(g["kept"] for g in got) == len(groups)
    left = exact_dedup.exact_dedup(docs(spark, data), keep=keep)
    assert left.columns == ["doc_id", "text", "sha", "part", "row"]
    left = left.collect()
    assert sorted(lowered(x["text"]) for x in left) == sorted(groups)
    assert all(x["doc_id"] in groups[lowered(x["text"])] for x in left)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(spark, keep):
    r = random.Random(2)
    check_exact(spark, [*EDGES, (None, "one"), (None, "no id"), *[(100 + i, r.choice(["HOT text", "hot TEXT", "x%d" % (i % 7)])) for i in range(300)]], keep)


@pytest.mark.parametrize("keep, most", [("max", 10**6), ("min", 10**6), ("max", 0), ("min", 300)])
def test_exact_groups_deal_hot_and_alike_texts_over_ranges(spark, monkeypatch, keep, most):
    monkeypatch.setattr(exact_dedup, "SAMPLE_A_RANGE", 5)
    monkeypatch.setattr(exact_dedup, "MOST_CHARS", most)
    r = random.Random(3)
    start = "the same beginning " * 40
    texts = ["hot", "HOT", "Hot", start + "a", start.upper() + "A", start, start + "b\U0001f642", start + "b\uffff", "\U0001f642", ""]
    data = [((1 << 60) + i if i % 9 else None, texts[0] if i % 3 == 0 else r.choice(texts)) for i in range(400)]
    rows = docs(spark, data).select("doc_id", "text")
    cuts = exact_dedup.splitters(rows, 8, keep)
    assert cuts == sorted(cuts) and len(cuts) <= 20 and sum(len(t) for t, _ in cuts) <= most
    if most == 10**6:
        placed, ranges = exact_dedup._placed(rows, "doc_id", "text", keep, False)
        seen = {(x["hot"], x["p"]) for x in placed.select("hot", "p").distinct().collect()}
        assert ranges > 2 and len([p for h, p in seen if h == 0]) > 1
    check_exact(spark, data, keep)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert sharding.shard_rows(none, 4).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert langid.predict(none, langid.fit(none.withColumnRenamed("sha", "lang"))).count() == 0
    assert pii.find_pii(none, pii.default_crf()).count() == 0
    assert toxicity.predict(none, toxicity.default_scorer()).count() == 0
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# near duplicates


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_near(data, k, num=80):
    sets = [(i, shingles(t, k)) for i, t in data]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def near_data():
    r = random.Random(3)
    data = [e for e in EDGES if e[0] != 5] + [(5, "one")]
    n = 100
    for g in range(6):
        base = prose(60, 50 + g).split()
        for _ in range(14):  # a chain of edits around the threshold
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
            data.append((n, " ".join(w)))
            n += 1
            if r.random() < 0.3:
                base = w
    data += [(n + i, "hot copy " + prose(30, 7)) for i in range(40)]
    return data


def test_near_duplicates_equal_brute_force(spark):
    data = near_data()
    want = brute_near(data, 4)
    for r in minhash.near_duplicates(docs(spark, data), words=4).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_pivot_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_A_MEMBER", 0)
    data = near_data()
    want = brute_near(data, 4)
    assert all(r["component_id"] == want[r["doc_id"]][1] for r in minhash.near_duplicates(docs(spark, data), words=4).collect())


def test_signature_estimate_is_unbiased():
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    p, q = (np.unpackbits(minhash.pack(minhash.minima(x, 1024)).view(np.uint8)).reshape(2, -1) for x in (a, b))
    equal = (p == q).all(axis=0).mean()
    assert abs((equal - 0.25) / 0.75 - 1500 / 2500) < 0.06


def test_estimates_lose_fewer_links_than_banding():
    banding = (1 - 0.8**4) ** minhash.BANDS
    for n, slack in ((minhash.PERMUTATIONS, minhash.SLACK), (minhash.FIRST_PERMUTATIONS, minhash.FIRST_SLACK), (minhash.FINE_PERMUTATIONS, minhash.FINE_SLACK)):
        most = math.floor(n * (0.25 + 0.75 * (0.8 - slack)) + 1e-9)
        p = 0.25 + 0.75 * 0.8
        lost = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(most + 1))
        assert lost < banding / 10


def test_estimate_is_the_share_of_equal_positions(spark):
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    n = minhash.FINE_PERMUTATIONS
    a, b = (minhash.pack(minhash.minima(np.unique(x), n)) for x in (pool[:2000], pool[300:2300]))
    p, q = (np.unpackbits(x.view(np.uint8)).reshape(2, -1) for x in (a, b))
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    for k in (128, 1024, n):
        equal = (p == q).all(axis=0)[:k].mean()
        got = row.select(minhash.estimate(row["a"], row["b"], n, k)).first()[0]
        assert math.isclose(got, (equal - 0.25) / 0.75, abs_tol=1e-12)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 360)] + [(400 + i, 401 + i) for i in range(30)]
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


# sharding


def test_permutation_is_one_and_inverts():
    for n in (1, 2, 3, 24, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 9)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 9, inverse=True) == np.arange(n)).all()


def test_shards_are_even_and_computable(spark):
    data = [*EDGES, *[(i + 20, "t" * (i % 50)) for i in range(200)]]
    got = sharding.shard_rows(docs(spark, data), 24, 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(data) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (sharding.row_of(got["shard"].to_numpy(), got["slot"].to_numpy(), len(data), 24, 7) == got["row_number"]).all()
    again = sharding.shard_rows(docs(spark, data).repartition(5), 24, 7).toPandas()
    cols = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got[cols].to_numpy())) == sorted(map(tuple, again[cols].to_numpy()))


def test_sharding_equals_plain_python(spark):
    import zlib

    def walk(row, n, keys):
        half = 1
        while 4**half < n:
            half += 1
        x = row
        while True:
            left, right = x >> half, x % 2**half
            for k in keys:
                y = ((right ^ k) * 0x9E3779B97F4A7C15) % 2**64
                y ^= y >> 29
                y = (y * 0xBF58476D1CE4E5B9) % 2**64
                y ^= y >> 32
                left, right = right, left ^ (y % 2**half)
            x = left * 2**half + right
            if x < n:
                return x

    r = random.Random(13)
    data = [(r.choice([None, -5, i, i]), r.choice([None, "", "é", prose(i % 30, i)])) for i in range(333)] + [(400, prose(30000, 1)), (401, "x"), (401, "x")]
    n, keys = len(data), sharding._keys(7)
    figures = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in data)
    want = sorted(((known, i), size, crc, k, walk(k, n, keys) % 24, walk(k, n, keys) // 24) for k, ((known, i), crc, size) in enumerate(figures))
    got = sharding.shard_rows(docs(spark, data), 24, 7).collect()
    assert sorted(((g["doc_id"] is not None, g["doc_id"] or 0), g["size"], g["text_crc32"], g["row_number"], g["shard"], g["slot"]) for g in got) == want


# BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    from gustline.llm.queries import bpe_path

    ref, own = Tokenizer.from_file(bpe_path()), bpe.load(bpe_path())
    r = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCXYZ0123456789'’.,;!?-_@#<>|\n\t éüßñçΣσςİıŁ日本語🙂‍́ \x00\x1c\x85"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(r.choice("etaoinsrh") for _ in range(r.randint(1, 30))) for _ in range(1500)]
    texts += ["", " ", "a<|endoftext|>b", "it's they'll", "a" * 5000, "ΑΣ ΟΔΟΣ", prose(4000, 8)]
    for t in texts:
        ids = ref.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    got = {x["doc_id"]: x for x in bpe.bpe_digests(docs(spark, [(1, None), (2, "Two words")]), bpe_path()).collect()}
    assert got[1]["n_tokens"] == 0 and got[2]["n_tokens"] == 2
    back = bpe.bpe_decode(bpe.bpe_encode(docs(spark, [(1, None), (2, "Two words")]), bpe_path()), bpe_path())
    assert rows_of(back) == [(1, ""), (2, "two</w> words</w>")]


def test_bpe_edges(spark, tmp_path):
    """Special tokens of any first letter, repeated rows, clashing names, an empty table."""
    import json

    from tokenizers import Tokenizer

    from gustline.llm.queries import bpe_path

    with open(bpe_path(), encoding="utf-8") as f:
        spec = json.load(f)
    i = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    spec["added_tokens"].append({"id": i, "content": "[CUT]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    ref, own = Tokenizer.from_file(path), bpe.BacktrackingBpe(path)
    for t in ("a[CUT]b", "[CUT]", "x [CUT][CUT] y", "[cut] <|endoftext|>[CUT"):
        assert own.encode(t) == ref.encode(t, add_special_tokens=False).ids
    data = [(1, "twice"), (1, "twice"), (None, prose(50_000, 4)), (2, None), (3, " \n ")]
    got = bpe.bpe_digests(docs(spark, data), bpe_path()).collect()
    assert sorted((g["doc_id"] or 0, g["n_tokens"]) for g in got) == [(0, len(ref.encode(prose(50_000, 4)).ids)), (1, 1), (1, 1), (2, 0), (3, 0)]
    none = spark.createDataFrame([], DOC)
    assert bpe.bpe_digests(none, bpe_path()).count() == bpe.bpe_encode(none, bpe_path()).count() == 0


# PII


def test_pii_base_spans_equal_plain_regexes():
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(k, t):
        d = re.sub("[^0-9]", "", t)
        return [True, k == 1 and all(int(p) <= 255 for p in t.split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]

    r = random.Random(7)
    for _ in range(4000):
        t = "".join(r.choice("aA1234567890..@@--++  ()é%_\n0255") for _ in range(r.randint(0, 80)))
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, t) if ok(k, m[0]))


def test_pii_field_adds_what_patterns_miss(spark):
    crf = pii.default_crf()
    held_out = pii.labelled_table(150, 99)
    hit = total = 0
    for row in held_out:
        _, _, own, ctx = pii.shapes(" ".join(w for w, _ in row))
        path = [0] * len(row)
        for i, k in zip(*crf.tags(own, ctx)):
            path[i] = k
        hit += sum(a == b for a, (_, b) in zip(path, row))
        total += len(row)
    assert hit / total > 0.97
    data = [(1, None), (2, ""), (3, "write to jo.do [at] example [dot] com"), (4, "call (415) 555-2671 or a.b@c.de"), (5, "the year 1999 and 3.14"), (6, prose(3000, 9))]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, data), crf).collect()}
    assert got[1]["spans"] == got[2]["spans"] == got[5]["spans"] == got[6]["spans"] == ""
    assert got[3]["spans"] == "email:9:37" and got[3]["n_email"] == 0 and got[3]["n_added"] == 1
    assert got[4]["spans"] == "phone:5:19,email:23:31" and got[4]["n_email"] == 1
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, data), crf).collect()}[4] == "call <phone> or <email>"


def test_pii_recall_and_precision_by_kind():
    """Spans on sentences that the fit never saw."""
    crf = pii.default_crf()
    found, there, right = [0] * 4, [0] * 4, 0
    told = 0
    for row in pii.labelled_table(400, 123):
        text, at, want = "", 0, []
        for w, tag in row:
            at = len(text)
            text += w + " "
            if tag:
                if want and want[-1][1] == tag - 1 and want[-1][2] == at - 1:
                    want[-1] = (want[-1][0], tag - 1, len(text) - 1)
                else:
                    want.append((at, tag - 1, len(text) - 1))
        base = pii.base_spans(text)
        spans = sorted(base + pii.added_spans([text], crf, [base])[0])
        told += len(spans)
        right += sum(any(k == k2 and s < e2 and s2 < e for s2, k2, e2 in want) for s, k, e in spans)
        for s, k, e in want:
            there[k] += 1
            found[k] += any(k == k2 and s < e2 and s2 < e for s2, k2, e2 in spans)
    assert min(there) > 20 and all(f >= 0.9 * t for f, t in zip(found, there)) and right >= 0.95 * told


def test_pii_edges(spark):
    crf = pii.default_crf()
    data = [(1, None), (2, ""), (3, "a.b@c.de"), (3, "a.b@c.de"), (None, prose(20_000, 3) + " 10.0.0.1"), (4, "1.2.3.4"), (4, "x")]
    got = pii.find_pii(docs(spark, data), crf).collect()
    assert sorted((g["doc_id"] or 0, g["n_email"], g["n_ip"]) for g in got) == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (4, 0, 0), (4, 0, 1)]
    clean = pii.redact(docs(spark, data), crf)
    assert clean.columns == ["doc_id", "text", "sha", "part", "row"]
    clean = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert clean.count((3, "<email>")) == 2 and (1, None) in clean and (2, "") in clean and (4, "<ip>") in clean
    # equal gains: the tag that is listed first
    assert pii.TAGS[0] == "outside" and pii.find_pii(docs(spark, [(1, "word")]), crf).first()["spans"] == ""


# decontamination


@pytest.mark.parametrize("broadcast, most_bits", [(250_000, 24), (0, 24), (250_000, 7), (0, 7)])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast, most_bits):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", min(10, most_bits))
    monkeypatch.setattr(decontaminate, "MOST_BITS", most_bits)
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    bench = [(1, prose(30, 11)), (2, "short item"), (3, None), (4, "..."), (10, prose(13, 12)), (11, prose(30, 11))]
    data = [*EDGES, (20, "Before, " + prose(30, 11).upper() + " after"), (21, "a short   ITEM, twice: short item"), (22, " ".join(prose(30, 11).split()[:13])), (23, " ".join(prose(30, 11).split()[:12])), (24, prose(900, 13) + " short item")]
    got = {}
    for r in decontaminate.contamination(docs(spark, data), spark.createDataFrame(bench, "item_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in data:
        w, hit, items = words(t), set(), set()
        for k, b in bench:
            bw = words(b)
            n = min(13, len(bw))
            for s in range(len(bw) - n + 1 if bw else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == bw[s : s + n]:
                        hit |= set(range(at, at + n))
                        items.add(str(k))
        r = got[i][0]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(items))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert len(got[5]) == 2
    left = decontaminate.drop_contaminated(docs(spark, data), spark.createDataFrame(bench, "item_id long, text string"))
    assert {20, 21, 22} & {r["doc_id"] for r in left.collect()} == set() and left.columns[0] == "doc_id"
    if broadcast and most_bits == 24:
        whole = spark.createDataFrame(bench, "item_id long, text string")
        cut = decontaminate.remove_spans(docs(spark, [*data, (30, "Keep (this): SHORT, item! Short? end.. ")]), whole)
        assert cut.columns == ["doc_id", "text", "sha", "part", "row"]
        cut = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert cut[30] == "Keep (this! Short? end.. " and cut[1] is None and cut[6] == prose(3000, 1) and cut[20] == "Before after" and cut[22] == ""
        assert cut[24] == prose(900, 13)
        none = decontaminate.contamination(docs(spark, data), whole.filter("false")).collect()
        assert len(none) == len(data) and not any(r["n_hit"] or r["contaminated"] for r in none)


# urls


def test_urls_propagate_blocks_and_prefer_allows(spark):
    pages = [
        (1, "http://A.example.com/en/1", '<link href="http://alias.test/x" rel="canonical">'),
        (2, "http://alias.test/x", None),
        (3, "http://example.com/en/7up", '<link rel=canonical href="http://alias.test/y">'),
        (4, "http://alias.test/y", ""),
        (5, "http://b.org/es/1", '<meta http-equiv="refresh" content="0; url=http://alias.test/z">'),
        (6, "http://alias.test/z", '<link rel="canonical" href="http://c.example.com/en/70">'),
        (7, None, None), (8, "no scheme", "x"), (9, "http://example.net/de/8?x", "x"), (10, "http://x.net/de/1", "x"), (2, "http://alias.test/x", None),
    ]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in range(1, 11)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert got[1]["host"] == "a.example.com" and got[1]["rule"] == "com/en/" and got[2]["rule"] is None and got[9]["path"] == "/de/8"


def test_urls_follow_every_link(spark):
    page = "http://www.b.org/es/dir/1?q=1"
    links = ["http://t.test/1?a=1&amp;b=2", "//t.test/2", "/", "x/y", "../up/./z?k=/../1", "?only=q", "#part", "mailto:a@t.test", "https://t.test/3"]
    want = {"http://t.test/1?a=1&b=2", "http://t.test/2", "http://www.b.org/", "http://www.b.org/es/dir/x/y", "http://www.b.org/es/up/z?k=/../1", "http://www.b.org/es/dir/1?only=q", "https://t.test/3"}
    html = " ".join(f'<link rel="canonical" href="{x}">' for x in links[:5]) + " ".join(f'<meta http-equiv="refresh" content="0; url={x}">' for x in links[5:])
    pages = [(1, page, html), (2, "http://t.test", '<link rel=canonical href=sub>'), *[(10 + i, u, "") for i, u in enumerate(sorted(want))]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = {(r["a"], r["b"]) for r in urls.link_edges(df).collect()}
    assert edges == {(page, b) for b in want} | {("http://t.test/", "http://t.test/sub")}
    assert {r["verdict"] for r in urls.judge_urls(df).filter("page_id != 2").collect()} == {"block"}


URL_ROWS = "page_id long, url string, html string, host string, a string, b string"  # clashing names


def url_pages(seed=12, n=500):
    """Pages in chains, hubs and loose ends, linked in many spellings."""
    r = random.Random(seed)
    sites = ["http://example.com", "http://Sub.Example.com", "HTTPS://example.net", "http://a.org", "http://b.test", "http://c.test:80", "http://d.test"]
    paths = ["/en/%d", "/en/7%d", "/de/%d", "/de/8%d", "/es/%d", "", *["/x/y/%d", "/x/%d?q=1&r=2", "/z/%d", "/%d/"] * 4]
    urls = [r.choice(sites) + (p % i if "%d" in (p := r.choice(paths)) else p) for i in range(n)]
    rows = []
    for i, u in enumerate(urls):
        tags = []
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            to = urls[r.choice([i - i % 10, i - i % 10 + r.randrange(10), i])]
            scheme, rest = to.split("://")
            host = rest.split("/")[0]
            own = u.split("://")[0].lower() + "://" + u.split("://")[1].split("/")[0].lower()
            spell = [to, to.replace("&", "&amp;"), scheme.upper() + "://" + host.upper() + rest[len(host) :], to + "#part", "#top", "mailto:x@y.z", "sub/../other", "./s?k=1", "..", "?z=2"]
            if scheme.lower() == u.split("://")[0].lower():
                spell.append("//" + rest)
            if own == scheme.lower() + "://" + host.lower() and "/" in rest:
                spell.append(rest[len(host) :])
            x = r.choice(spell[:3] * 3 + spell)
            tags.append(r.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' class=x rel=Canonical />", '<link rel="next canonical" href={} >', '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;URL={}' http-equiv=Refresh>", '<link rel="stylesheet" href="{}">', '<a rel="canonical" href="{}">']).format(x))
        rows.append((i, u, None if r.random() < 0.02 else "<html>" + "\n".join(tags) + "</html>", "h", "a", "b"))
    return [*rows, (n, None, '<link rel="canonical" href="http://a.org/es/1">', "h", "a", "b"), (n + 1, "no scheme", "", "h", "a", "b"), rows[3], (3, urls[4], "", "h", "a", "b")]


def brute_urls(rows):
    from urllib.parse import urljoin, urlsplit

    def norm(u):
        if u is None or "://" not in u:
            return None
        p = urlsplit(u)
        return p.scheme.lower() + "://" + p.netloc.lower() + (p.path or "/") + ("?" + p.query if p.query else "")

    def own(u):
        if u is None or "://" not in u:
            return "", "", None
        host, path = urlsplit(u).netloc.lower(), urlsplit(u).path
        fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, default=None)

    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, u, html, *_ in rows:
        if norm(u) is None:
            continue
        for tag in re.findall(r"<(?:link|meta)[^>]*>", html or "", re.I):
            m = re.search(r"url=([^'\">]+)" if "refresh" in tag.lower() else r"href=['\"]?([^'\" >]+)", tag, re.I)
            if "stylesheet" in tag or m[1].startswith(("#", "mailto:")):
                continue
            root[find(norm(urljoin(u.split("://")[0].lower() + "://" + u.split("://")[1], m[1].replace("&amp;", "&"))))] = find(norm(u))
    state = {}
    for x in list(root):
        if (best := own(x)[2]) is not None:
            state.setdefault(find(x), set()).add(best[3])
    out = []
    for i, u, *_ in rows:
        host, path, best = own(u)
        carried = norm(u) in root and state.get(find(norm(u))) == {"block"}
        out.append((i, host, path, best and best[2], best[3] if best else "block" if carried else "allow"))
    return out


def test_urls_equal_brute_force_and_sql(spark):
    import duckdb

    from gustline.llm.queries import ORACLES

    rows = url_pages()
    want = sorted(map(str, brute_urls(rows)))
    got = urls.judge_urls(spark.createDataFrame(rows, URL_ROWS).repartition(7))
    got = sorted(str(tuple(r)) for r in got.select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want
    alone = sorted(map(str, brute_urls([(i, u, "", *x) for i, u, _, *x in rows])))
    assert sum(a != b for a, b in zip(alone, want)) > 8  # the links matter
    con = duckdb.connect()
    import pandas as pd

    pages = pd.DataFrame(rows, columns=["page_id", "url", "html", "host", "a", "b"])[["page_id", "url", "html"]]  # noqa: F841
    con.sql("create table pages as select * from pages")
    assert sorted(map(str, con.sql(ORACLES["op8_url_filter"]).fetchall())) == want


def test_urls_long_page_and_rule_ties(spark):
    html = "<p>" + "x" * 500_000 + '<link rel="canonical" href="/far">' + "y" * 500_000
    pages = [(1, "http://h.test/a", html), (2, "http://h.test/far", "")]
    rules = (("block", "h.test", "/far"), ("allow", "test", "/zzzzz"))
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block"}
    tie = (("block", "h.test", "/a"), ("allow", "test", "/aaa"), ("allow", "h.test", "/a"))
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), tie).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "allow", 2: "allow"}


# chat


def test_chat_round_trip(spark):
    text = "</s>[INST] ok [/INST] \\l \\\\ \\b <s>"
    s, a, b = chat.segment("assistant", text)
    assert chat.parse(s) == [("assistant", text)] and chat.unescape(s[a:b]) == text
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "user", None), (1, 3, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "assistant", "é" * 50000)]
    f = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).cache()
    assert chat.expand(f).count() == 3
    got = {r["conv_id"]: r for r in chat.read_back(f).collect()}
    for c in (1, 2, 3):
        own = [(r or "", t or "") for k, _, r, t in turns if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.segment(r, t)[0]) for r, t in own)


@pytest.mark.parametrize("piece", [1, 200, 1 << 16])
def test_chat_examples_hold_their_whole_context(spark, monkeypatch, piece):
    r = random.Random(8)
    turns = [(c, i, r.choice(["user", "assistant", "system", "assistant"]), r.choice(["", "</s>[INST] \\l", prose(r.randint(1, 40), i)])) for c, n in ((1, 1), (2, 7), (3, 60), (None, 5)) for i in range(n)]
    turns += [(4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 2, "user", "never answered"), (5, 0, "user", "alone")]
    monkeypatch.setattr(chat, "PIECE_CHARS", piece)
    f = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)).cache()
    got = {}
    for x in chat.expand(f).collect():
        got.setdefault((x["conv_id"], x["example"]), []).append((x["piece"], x["text"], x["loss_start"], x["loss_end"]))
    want = {}
    for c in (1, 2, 3, None, 4, 5):
        own = [(role, t) for k, _, role, t in turns if k == c]
        ends = [i for i, (role, _) in enumerate(own) if role == "assistant"]
        want |= {(c, n): own[: i + 1] for n, i in enumerate(ends, 1)}
    assert got.keys() == want.keys() and max(n for _, n in want) > 20
    for key, own in want.items():
        rows = sorted(got[key])
        assert chat.parse("".join(x[1] for x in rows)) == own
        assert all(x[2] is None for x in rows[:-1]) and chat.unescape(rows[-1][1][rows[-1][2] : rows[-1][3]]) == own[-1][1]
    for x in chat.read_back(f).collect():
        own = [(role, t) for k, _, role, t in turns if k == x["conv_id"]]
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest() and x["n_turns"] == len(own)
        assert x["loss_sha256"] == hashlib.sha256("".join(t for a, t in own if a == "assistant").encode()).hexdigest()
    f.unpersist()


# language, on rows that the fits never saw


def test_language_held_out_accuracy(spark, sf):
    from gustline.llm.queries import op2_language_id

    sf = sf.replace("sf0.001", "sf0.01")
    got = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    out = got.filter("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98 and out["score"].between(0, 1).all()
    # und only without letters
    models = langid.LanguageModels({"xx": langid.grams_of("abc abd")})
    assert models.judge(None)[0] == models.judge("12 34")[0] == models.judge("")[0] == "und" and models.judge("abc")[0] == "xx"
    assert 0 < out["rejected"].mean() < 0.05 and (out["score"][out["rejected"]] == 0).all()


def test_language_rejects_what_no_model_knows(spark, sf):
    rows = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").filter("length(text) > 200")
    models = langid.fit(rows.filter("lang in ('en', 'de')"))
    got = langid.predict(rows, models).join(rows.select("doc_id", "lang"), "doc_id").toPandas()
    known = got["lang"].isin(["en", "de"])
    assert got["rejected"][known].mean() < 0.03 and got["rejected"][~known].mean() > 0.95
    assert (got["lang_pred"][got["rejected"]] == "und").all() and set(got["best"]) == {"en", "de"}


def test_language_edges(spark):
    r = random.Random(11)
    alphabet = {"aa": "abcdefg ", "bb": "uvwxyz ", "gothic": "".join(map(chr, range(0x10330, 0x10340))) + " ", "deseret": "".join(map(chr, range(0x10428, 0x10440))) + " "}
    said = lambda x, n: "".join(r.choice(alphabet[x]) for _ in range(n))
    learn = [(i, said(x, 60), x, 1, "r") for i, x in enumerate(list(alphabet) * 30)]
    learn += learn[:4] + [(999, None, "aa", 1, "r"), (998, "abc", None, 1, "r"), (None, "abc", "bb", 1, "r")]
    kinds = "doc_id long, text string, lang string, score int, entropy string"  # clashing names
    models = langid.fit(spark.createDataFrame(learn, kinds))
    assert models.langs == sorted(alphabet)
    ask = [(1, said("gothic", 50), "x", 1, ""), (2, said("deseret", 50), "x", 1, ""), (3, None, "x", 1, ""), (4, "", "x", 1, ""), (5, "12 !", "x", 1, ""), (6, said("aa", 200_000), "x", 1, ""), (6, said("bb", 9), "x", 1, "")]
    got = langid.predict(spark.createDataFrame(ask, kinds), models).collect()
    assert sorted((g["doc_id"], g["best"]) for g in got) == [(1, "gothic"), (2, "deseret"), (3, "und"), (4, "und"), (5, "und"), (6, "aa"), (6, "bb")]
    twins = langid.LanguageModels({x: langid.grams_of("abc abd") for x in ("zz", "yy")})
    assert twins.judge("abc")[4] == "yy"


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat the cat ran"
    letters = np.unique(langid.letters_of(text))
    alphabet = len(letters) + 20  # twenty letters that the text does not have
    m = langid.KneserNey(*langid.grams_of(text), alphabet=alphabet)
    every = np.concatenate([letters, np.arange(0x4E00, 0x4E00 + 20).astype(np.uint64)])
    for context in ("the", "at ", "zzz", "e c", "  t"):
        code = np.uint64(0)
        for c in context:
            code = (code << np.uint64(16)) | np.uint64(ord(c))
        assert math.isclose(m.prob((code << np.uint64(16)) | every).sum(), 1.0, abs_tol=1e-9)


# toxicity


def naive_best(letters, weights):
    """All ways through the five machines one after the other."""
    best = -math.inf

    def walk(at, states, total):
        nonlocal best
        if at == len(letters):
            if all(s in m.finals for s, m in zip(states, toxicity.PARTS)):
                best = max(best, total)
            return
        for states2, out in step(states, letters[at], 0):
            walk(at + 1, states2, total + weights.get(out, 0.0))

    def step(states, letter, k):
        if k == len(states):
            yield (), letter
            return
        for y, nxt in toxicity.PARTS[k].arcs[states[k]].get(letter, ()):
            for rest, out in step(states, y, k + 1):
                yield (nxt, *rest), out

    for a in toxicity.PARTS[2].starts:
        walk(0, (0, "free", a, 0, "plain"), 0.0)
    return best


def test_toxicity_machine_equals_naive_path_search():
    r = random.Random(10)
    for _ in range(400):
        letters = [r.choice(toxicity.SYMBOLS) for _ in range(r.randint(0, 9))]
        weights = {x: r.uniform(-2, 4) for x in toxicity.LETTERS}
        total, wrote = toxicity.MACHINE.best(letters, weights)
        assert math.isclose(total, naive_best(letters, weights), abs_tol=1e-9) and math.isclose(total, sum(weights[x] for x in wrote), abs_tol=1e-9)


def test_toxicity_clauses():
    s = toxicity.default_scorer()
    says = lambda t: [m for _, _, _, m in s.clauses(t)]
    assert says("an idiot came") == [("m0",)] and says("you idiot") == [("m0t",)] and says("he is not an idiot") == [("m0tn",)]
    assert says("it said idiot today") == [("m0r",)] and says("not one two three idiot") == [("m0",)] and says("xidiot") == []
    assert says("we kill time") == [] and says("i will kill you. you sit, we kill time") == [("mkt",), ("mkt",)] and says("burn it. you") == []
    assert [(a, b) for a, b, _, _ in s.clauses("One two. IDIOTS, all; no")] == [(8, 20)]
    assert s.score("you idiot") > s.score("an idiot came") > s.score("no idiot") > s.score("a day") == s.score(None) == s.score("")


def test_toxicity_held_out_by_class(spark, sf):
    from gustline.llm.queries import op10_toxicity

    sf = sf.replace("sf0.001", "sf0.1")
    got = op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    found = got.groupby("toxic")["predicted"].mean()
    assert found[1] > 0.85 and found[0] < 0.01 and got["score"].between(0, 1).all()


def test_toxicity_learns_from_few_labels_around_its_prior(spark):
    few = docs(spark, [(1, "you idiot"), (2, "what an idiot you are"), (2, "what an idiot you are"), (3, "a fine day"), (4, "he is not an idiot"), (5, "bread and milk"), (6, None)])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1), (None, 1)], "doc_id long, toxic int")
    fixed = toxicity.default_scorer()
    learned = toxicity.fit(few, labels)
    assert learned.logistic != fixed.logistic and learned.score("you idiot") > learned.score("a fine day")
    assert learned.weights["m0t"] > fixed.weights["m0t"] and learned.weights["m0tn"] < learned.weights["m0t"]
    none = toxicity.fit(few, labels.filter("false"))
    assert none.logistic == fixed.logistic and np.allclose([none.weights[x] for x in toxicity.LETTERS], [fixed.weights[x] for x in toxicity.LETTERS])
    one = toxicity.fit(few, labels.filter("toxic = 1"))
    assert one.score("you idiot") > 0.5
    long = docs(spark, [(1, None), (2, ""), (3, prose(20000, 1)), (4, "you idiot"), (4, "you idiot"), (None, "x")])
    got = toxicity.predict(long, fixed).collect()
    assert len(got) == 6 and [g["score"] for g in got if g["doc_id"] == 4] == [fixed.score("you idiot")] * 2
    left = toxicity.drop_toxic(long, fixed)
    assert left.columns == ["doc_id", "text", "sha", "part", "row"] and sorted(x["doc_id"] or 0 for x in left.collect()) == [0, 1, 2, 3]
    assert [tuple(x) for x in toxicity.matched_clauses(long, fixed).select("doc_id", "start", "end").collect()] == [(4, 0, 9)] * 2


def brute_hits(text, bench, n=13):
    """(words, hit words) of a text."""
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)) if w]
    windows = {tuple(b[s : s + n]) for b in map(words, bench) if b for s in range(max(len(b) - n, 0) + 1)}
    w, hit = words(text), set()
    for size in {len(x) for x in windows}:
        for at in range(len(w) - size + 1):
            if tuple(w[at : at + size]) in windows:
                hit |= set(range(at, at + size))
    return len(w), len(hit)


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from gustline.llm.queries import bpe_path

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = toxicity.fit(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    left = [(r["doc_id"], r["text"]) for r in raw.collect() if scorer.score(r["text"]) < 0.5]
    seen = set()
    left = [(i, t) for i, t in sorted(left) if not (lowered(t) in seen or seen.add(lowered(t)))]
    near = brute_near(left, 5)
    left = [(i, t) for i, t in left if near[i][1] == i]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not (h := brute_hits(t, bench))[1] or 20 * h[1] < h[0]]
    ref = Tokenizer.from_file(bpe_path())
    want = []
    for i, t in left:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and 0 < len(want) < raw.count()


@pytest.mark.parametrize("rows", [[], EDGES])
def test_pipeline_stages_on_edges(spark, sf, rows):
    import corpus_pipeline

    given = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "length(text) as n_chars")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf)
        if name != "bpe":
            assert out.columns == given.columns
        counts.append((name, out.count()))
    # toxicity, contamination and encoding touch nothing here; "One" and "one" are near copies, and 5 is there twice
    assert [c for _, c in counts] == [len(rows), len({lowered(t) for _, t in rows}), len(rows) - 2 * bool(rows), len(rows), len(rows)]


def test_bpe_worker_keeps_little():
    """The caches of a worker stay bounded, with the same ids, and what a task leaves unused goes back to the system."""
    import pyarrow

    from gustline.llm import shared
    from gustline.llm.queries import bpe_path

    encoder = bpe.BacktrackingBpe(bpe_path())
    words = [f"q{i:x}z" for i in range(120_000)]
    first = encoder.encode(" ".join(words[:50]))
    encoder.encode(" ".join(words))
    assert len(encoder._cache) <= 100_000 and len(encoder._compatible) <= 200_000
    assert encoder.encode(" ".join(words[:50])) == first

    def anon():
        return next(int(x.split()[1]) // 1024 for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:"))

    def run(batches):
        for batch in batches:
            large = [f"{i:x}" * 40 for i in range(400_000)]
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array([len(pyarrow.array(large))])], ["n"])

    before = anon()
    assert [b.to_pylist() for b in shared.lean(run)(iter([None]))] == [[{"n": 400_000}]]
    assert anon() < before + 40
