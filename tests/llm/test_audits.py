"""Fingerprints, centroid clustering and the source divergence audit against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfage.llm import clustering, divergence, fingerprint

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def clash(df):
    """Columns whose names the operators use themselves."""
    for c in ("k", "term", "total", "cluster", "rank", "count", "hashes", "block"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---------------------------------------------------------------- fingerprints
def sketch(text, shingle=5, fraction=1 / 8):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    got = {hashlib.md5(" ".join(w[i: i + shingle]).encode()).hexdigest() for i in range(max(len(w) - shingle + 1, 1))} if w else set()
    return sorted(int(h[:16], 16) for h in got if int(h[:16], 16) < fraction * 2**64)


def alike(a, b):
    if not a and not b:
        return 1.0
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def digits(a):
    return ",".join(f"{h:016x}" for h in a)


EDGE_DOCS = [(10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0), (10**9 + 2, " \n\t ", "en", "s", 4), (None, "a b c " * 50, "en", "s", 100),
             (None, "a b c " * 50, "en", "s", 100), (None, "other " * 9, "en", "s", 100), (7, "z " * 30, None, "s", 60), (7, "Z y " * 31, None, "", 62),
             (10**9 + 3, "Q", "en", "s", 1), (10**9 + 4, "q😀é", "zz", "s", 1), (10**9 + 5, "long wörd 😀 " * 30000, "en", "s", 100000),
             (10**9 + 5, "long wörd 😀 " * 30000, "en", "s", 100000)]


def brute_report(rows):
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda x: (
        x[0] is None, -(x[0] or 0), hashlib.md5(f"{'' if x[0] is None else x[0]}:{x[1]}".encode()).digest()))
    after = {a: b for a, b in zip(distinct, distinct[1:] + distinct[:1])}
    out = []
    for i, t in rows:
        t = t or ""
        nxt = after[(i, t)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digits(a), digits(b), alike(a, b), alike(a, c)))
    return Counter(out)


def test_fingerprints_of_edited_texts(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    docs = clash(real.unionByName(spark.createDataFrame(EDGE_DOCS, DOC)).repartition(5))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(tuple(r)[:7] for r in fingerprint.edit_report(spark, docs).collect())
    assert got == brute_report(rows)
    one = docs.where("doc_id = 7 AND source = ''")
    assert [r.near_next for r in fingerprint.edit_report(spark, one).collect()] == [1.0]
    assert fingerprint.edit_report(spark, docs.limit(0)).collect() == []


def test_followers_cross_ranges(spark):
    """Many ranges, some empty: every document follows the next larger id, the largest one the smallest."""
    docs = spark.range(0, 5000, 1, 7).selectExpr("id * 1000003 % 5000 AS doc_id", "CAST(id AS STRING) AS text")
    keys = {r.doc_id: r.k for r in fingerprint._keyed(docs).collect()}
    link = {bytes(r.k): bytes(r.prev_k) for r in fingerprint.followers(spark, docs).collect()}
    assert all(link[bytes(keys[i])] == bytes(keys[(i + 1) % 5000]) for i in range(5000))


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(4)
    big = [f"w{rng.randint(0, 10**6)}" for _ in range(40000)]
    df = spark.createDataFrame([(" ".join(big), " ".join(big[5000:9000]), " ".join(big[30000:] + [f"x{i}" for i in range(10000)]))], "a string, b string, c string")
    sk = df.select(*[fingerprint.retained(fingerprint.words(F.col(x))).alias(x) for x in "abc"])
    r = sk.select(fingerprint.containment(F.col("a"), F.col("b")).alias("ab"), fingerprint.containment(F.col("a"), F.col("c")).alias("ac"),
                  fingerprint.merged(F.col("b"), F.col("c")).alias("m"), "b", "c").first()
    assert r.ab == 1.0 and abs(r.ac - 0.5) < 0.05
    assert r.m == sorted(set(r.b) | set(r.c))
    with pytest.raises(ValueError):
        fingerprint.retained(F.col("a"), fraction=0.7)


# ---------------------------------------------------------------- clustering
def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cents = [q for _, q in start]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        where = assign()
        for c in range(len(cents)):
            mine = [q for (_, q), (a, _) in zip(kept, where) if a == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    where = assign() if cents else []
    inertia = defaultdict(int)
    for c, d in where:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (c, d) in zip(kept, where))


def test_clusters(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = [(10**6, None, 0), (10**6 + 1, [1.0, None] + [0.5] * 62, 0), (10**6 + 2, [float("nan")] * 64, 0), (10**6 + 3, [float("-inf")] * 64, 0),
           (10**6 + 4, [0.25] * 63, 0), (10**6 + 5, [], 0), (10**6 + 6, [0.25] * 64, 0), (10**6 + 6, [0.25] * 64, 0), (None, [0.1] * 64, 0),
           (10**6 + 7, [-1000.0] * 64, 0)]
    both = clash(emb.unionByName(spark.createDataFrame(odd, emb.schema))).repartition(5)
    rows = [(r.vec_id, r.embedding) for r in both.collect()]
    assert Counter(map(tuple, clustering.cluster(spark, both).collect())) == brute_clusters(rows)
    assert clustering.cluster(spark, both.limit(0)).collect() == []
    # fewer vectors than centroids, all of them equal: number 0 takes them
    same = spark.createDataFrame([(i, [0.5] * 64, 0) for i in range(5)], emb.schema)
    assert {(r.cluster, r.distance, r.inertia) for r in clustering.cluster(spark, same).collect()} == {(0, 0, 0)}
    nameless = spark.createDataFrame([(None, [0.5] * 64, 0)], emb.schema)
    assert clustering.cluster(spark, nameless).collect() == []


def test_too_large_a_component_is_refused(spark):
    emb = spark.createDataFrame([(1, [1e12] + [0.0] * 63, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="a component beyond"):
        clustering.cluster(spark, emb).collect()


def test_orchard_search_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    for spread in (3, 400):                 # many ties, and well separated groups
        centroids = rng.integers(-spread, spread + 1, (40, 3))
        x = centroids[rng.integers(0, 40, 3000)] + rng.integers(-2, 3, (3000, 3))
        gap, lists = clustering.neighbour_lists(centroids)
        best, dist, computed = clustering.nearest(x, centroids, gap, lists)
        every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
        assert computed < 40 * 3000 * (0.9 if spread == 3 else 0.6)


# ---------------------------------------------------------------- divergence
def brute_audit(rows, min_docs=3, top=200):
    unit = 10**9
    docs = [(l or "", s or "", [lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, l, s in rows]
    df, count = Counter(), defaultdict(Counter)
    for lang, source, w in docs:
        df.update((lang, x) for x in set(w))
        count[(lang, source)].update(w)
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        sources = sorted(s for x, s in count if x == lang)
        share, whole = {}, Counter()
        for s in sources:
            n = sum(count[(lang, s)][t] for t in kept)
            share[s] = {t: 1 + unit * (count[(lang, s)][t] + 1) // (n + len(kept)) for t in kept}
            whole.update({t: count[(lang, s)][t] for t in kept})
        n = sum(whole.values())
        q = {t: 1 + unit * (whole[t] + 1) // (n + len(kept)) for t in kept}
        for s in sources:
            pair = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in sources if o != s]
            term = [((share[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[(lang, s)][t] and share[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def test_divergence_audit(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(6)
    made = [(10**8 + i, " ".join(f"{rng.choice('abcdé')}{rng.choice('xyz')}" for _ in range(rng.randint(0, 40))), "xx", f"s{i % 6}", 0) for i in range(60)]
    made += [(10**7 + i, "unter" if i else None, "only one", f"s{i}", 0) for i in range(2)]
    docs = clash(real.unionByName(spark.createDataFrame(EDGE_DOCS + made, DOC)).repartition(5))
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    want = brute_audit(rows)
    for block in (divergence.BLOCK, 50):
        assert sorted(map(tuple, divergence.audit(spark, docs, block=block).collect())) == want
    assert divergence.audit(spark, docs.limit(0)).collect() == []


def test_shares_need_no_more_than_64_bits():
    count = np.array([0, 1, 10**12, 3 * 10**15 - 1])
    for total in (1 + 3 * 10**15, 9 * 10**15):
        assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]


def test_galloping_merge():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (1, 1000), (300, 300), (7, 100_000), (2000, 100_000)):
        a, b = (np.sort(rng.choice(200_000, k, replace=False)) for k in (n, m))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()
        ca, cb = rng.integers(1, 50, n), rng.integers(1, 50, m)
        x, y = dict(zip(a.tolist(), ca.tolist())), dict(zip(b.tolist(), cb.tolist()))
        p = lambda d, t, total: 1 + 10**9 * (d.get(t, 0) + 1) // total
        both = set(x) | set(y)
        want = (len(both), sum((p(x, t, 9999) - p(y, t, 777777)) ** 2 // p(y, t, 777777) for t in both),
                sum((p(x, t, 9999) - p(y, t, 777777)) ** 2 // p(x, t, 9999) for t in both))
        assert divergence.merge(a, ca, b, cb, 9999, 777777) == want
        assert divergence.merge(b, cb, a, ca, 777777, 9999) == (want[0], want[2], want[1])
