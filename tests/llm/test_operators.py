"""Every operator against a brute-force version, on driver rows and on hand-made edge rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfage.llm import decontaminate, langid, minhash, mixing, pii, recompress, records, suffix, topk, warc

SF = "/root/testdata/sf0.001"
LOW = -(1 << 63)
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0), (10**9 + 2, " \n\t ", "en", "s", 4), (None, "a " * 50, "en", "s", 100),
         (None, "a " * 50, "en", "s", 100), (7, "z " * 30, None, "s", 60), (7, "z " * 31, None, "", 62), (10**9 + 3, "Q", "en", "s", 1),
         (10**9 + 4, "q", "en", "s", 1), (10**9 + 5, "long " * 20000, "en", "s", 100000), (10**9 + 5, "long " * 20000, "en", "s", 100000)]


def words(s, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, s or "")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(60)] for _ in range(4)]
    extra = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 20)}"
        extra.append((2 * 10**9 + i, " ".join(w), "en", f"s{i % 3}", 1))
    extra += [(3 * 10**9 + i, " ".join(rng.choice("ab") if i % 2 else rng.choice("aaab") for _ in range(rng.randint(0, 60))), "fr", "s", 1)
              for i in range(100)]
    real = spark.read.parquet(f"{SF}/documents.parquet")
    df = real.unionByName(spark.createDataFrame(EDGES + extra, DOC)).withColumn("size", F.lit("clash")).withColumn("label", F.lit(1)) \
        .withColumn("rid", F.lit("x")).withColumn("kind", F.lit(2)).repartition(5)
    path = f"/tmp/shelfage-test-docs-{random.SystemRandom().randint(0, 1 << 60):x}"
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_minhash_components(spark, docs, rows):
    got = minhash.near_duplicates(spark, docs, shingle=2, bucket_keys=20000).collect()
    sets = []
    for _, s in rows:
        w = words(lower(s))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    where: dict = {}
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in where.get(x, ()))
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for x in s:
            where.setdefault(x, []).append(k)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(str((i, len(s), least.get(find(k)), i == least.get(find(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets)))
    assert want == sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got)


def test_deduplicated_keeps_columns_and_one_row_each(spark, docs):
    out = minhash.deduplicated(spark, docs)
    assert out.schema.names == docs.schema.names
    # equal rows of one id: one stays; documents without words link with nothing and all stay
    assert out.where("doc_id = 1000000005").count() == 1 and out.where("text = ''").count() == docs.where("text = ''").count()
    assert out.subtract(docs).count() == 0


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c)
        t += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return t % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                                   ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii_spans(spark, docs, rows):
    rng = random.Random(5)
    bits = ["a@b.com", "+x@c.org", "@", "1.2.3.4", ".5", "0255.1.1.1", "4111 1111 1111 1111", "+1 (212) 555-1234", "+", "1 ", "-", ".", "é", "😀", "\u0001", "a"]
    made = [(4 * 10**9 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    made += [(5 * 10**9, "1 " * 20000 + "9" * 20000), (5 * 10**9 + 1, "pay GB82 WEST 1234 5698 7654 32 now, ssn 123-45-6789, GB83 WEST 1234 5698 7654 32")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = pii.report(both).collect()
    want = Counter()
    for i, s in rows + made:
        b = base_spans(s or "")
        n = Counter(x[2] for x in b)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in b).encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    extra = [r for r in got if r.doc_id == 5 * 10**9 + 1][0]
    assert (extra.n_iban, extra.n_ssn) == (1, 1) and extra.scores == "0.8,0.8"
    assert pii.report(both.limit(0)).collect() == []


def test_warc_roundtrip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    schema = pages.schema
    pages = pages.unionByName(pages.limit(20).selectExpr("page_id + 1000000 AS page_id", "url", "html")) \
        .unionByName(spark.createDataFrame([(5000000, None, None), (5000001, "x\r\ny", ""), (None, None, "")], schema)).withColumn("shard", F.lit("clash"))
    source = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    best: dict = {}
    for k, v in source.items():
        if k is not None:
            best[v] = max(best.get(v, k), k)
    for least in (0, 1 << 40):
        got = {r.page_id: r for r in warc.roundtrip(spark, pages, min_revisit_bytes=least, shard_bytes=100_000, roll_bytes=20_000).collect()}
        assert set(got) == set(source) and len({r.path for r in got.values()}) > 3
        for k, v in source.items():
            r = got[k]
            assert (r.payload_bytes, r.payload_digest) == (len(v), base64.b32encode(hashlib.sha1(v).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if least or k == best[v] else ("revisit", best[v]))
    assert warc.roundtrip(spark, pages.limit(0)).collect() == []


def test_warc_files_are_a_function_of_the_table(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for name, n in (("a", 1), ("b", 7)):
        warc.write_archive(spark, pages.repartition(n), str(tmp_path / name), shard_bytes=30_000).collect()
    files = [{p.name: p.read_bytes() for p in (tmp_path / x).iterdir() if p.suffix == ".gz"} for x in "ab"]
    assert files[0] == files[1] and len(files[0]) > 2


def test_warc_shards_hold_equal_bytes_however_ids_are_spread(spark, tmp_path):
    """A far id, ids in a row, and a skewed spread: shards near ``shard_bytes``, one task each, read back by as many tasks as files."""
    html = F.repeat(F.lit("x"), 744)
    pages = spark.range(1000).select(F.when(F.col("id") == 999, F.lit(1 << 62)).when(F.col("id") < 500, F.col("id"))
                                     .otherwise(F.col("id") * F.col("id") * 1000).alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))
    manifest = warc.write_archive(spark, pages, str(tmp_path / "a"), min_revisit_bytes=1 << 40, shard_bytes=100_000)
    sizes = Counter()
    for r in manifest.collect():
        sizes[r.shard] += 1000 * r.records
    assert sorted(sizes) == list(range(10)) and set(sizes.values()) == {100_000}
    back = warc.read_archive(spark, manifest)
    assert back.rdd.getNumPartitions() == manifest.count() == 10 and back.count() == 1000
    assert not (tmp_path / "a" / warc.TEMPORARY).exists()


def test_warc_repeated_ids_and_long_payloads(spark):
    long = "é" * 3_000_000
    rows = [(1, "u", "a"), (1, "u", "a"), (1, None, "b"), (2, "u", "a"), (2, "v", "c"), (3, "w", long), (4, "w", long), (None, "n", "b"), (None, "n", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.roundtrip(spark, pages, shard_bytes=1000).collect())
    want: Counter = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((j for j, _, k in rows if j is not None and (k or "") == (h or "")), default=None)
        first = top is None or i == top
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top)] += 1
    assert got == want


def test_mix_targets_and_reruns(spark, docs, rows):
    got = mixing.mix(spark, docs).collect()
    assert Counter(r["size"] for r in got) == Counter(len(words(s)) for _, s in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = sum(size.values()), set(), {}
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * size[s] if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= mixing.BLOCK_WORDS + 1
    again = mixing.mix(spark, docs.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix(spark, docs.limit(0)).collect() == []


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(1)
    for seats in (1, 7, 50, 333):
        votes = [rng.randint(0, 1000) for _ in range(12)]
        df = spark.createDataFrame(list(enumerate(votes)), "party int, votes long").withColumn("seats", F.lit(seats).cast("long"))
        got = {r.party: r.quota for r in mixing.apportion(df, [], "party", "votes", "seats").collect()}
        won = [0] * 12
        for _ in range(seats):
            won[max(range(12), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        assert [got[i] for i in range(12)] == won


def test_quotas_in_groups_of_shards_and_empty_texts(spark, docs):
    """More shards than a group holds: targets, caps and reruns hold as with one group; texts without words are never taken."""
    some = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**10))
    kw = {"shard_words": 64, "group_shards": 3}
    got = mixing.mix(spark, some, **kw).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken, target, shards = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        shards[r.source] += -(-r["size"] // 64)
    assert max(shards.values()) > 50
    for s, t in target.items():  # what shards lose to their own limit of three turns
        assert taken[s] <= t + mixing.BLOCK_WORDS + 1 and taken[s] >= 0.95 * t - mixing.BLOCK_WORDS
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(spark, some.repartition(5), **kw).collect()))
    empty = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0), (2, " ", "en", None, 0)], DOC)
    assert [(r.taken, r.target) for r in mixing.mix(spark, empty).collect()] == [(0, 0.0)] * 3
    assert mixing.mixed_documents(spark, empty).collect() == []


def test_mixed_documents_are_read_as_often_as_taken(spark, docs):
    """Many equal rows, null ids and sources: as many copies as the mix takes, without a comparison of all pairs."""
    same = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("v w x").alias("text"), F.lit("en").alias("lang"),
                                    F.lit(None).cast("string").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    both = docs.select(same.columns).unionByName(same).unionByName(same.withColumn("doc_id", F.lit(None).cast("long")).limit(50))
    want: Counter = Counter()
    for r in mixing.mix(spark, both).collect():
        if r["size"]:
            want[(r.doc_id, r.source, r["size"])] += (2 * r.taken + r["size"]) // (2 * r["size"])
    out = mixing.mixed_documents(spark, both)
    got = Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect())
    assert got == +want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and not re.search(r"hashpartitioning\([^,]*coalesce", plan)  # texts are dealt once


def test_mixed_documents_columns(spark, docs):
    out = mixing.mixed_documents(spark, docs)
    assert out.columns == docs.columns and out.subtract(docs).count() == 0


def test_token_records(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.default_tokenizer())
    rng = random.Random(1)
    signs = list("abAB09 '’.,!<>|=-_̸́éÉßçİıΣσς中文😀\t\n  ½ǅ`{}~ʼn") + ["'s", "'t", "<|endoftext|>", "<|", "K"]
    made = [(4 * 10**9 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    some = docs.where("doc_id IS NOT NULL AND doc_id NOT IN (7, 1000000005)").select("doc_id", "text")
    both = some.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in both.collect()}
    start = 0
    for r in sorted(records.roundtrip(spark, both).collect(), key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        if r.doc_id % 50 == 0:  # a shuffled read by the offset
            doc, again = records.read_ids(r.path, r.offset)
            assert doc == r.doc_id and (again == ids).all()
    assert len(records.roundtrip(spark, docs.select("doc_id", "text")).collect()) == docs.count()
    assert records.roundtrip(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_tokenizer(name):
    """Parts encoded once give the ids of whole texts; a tokenizer with another normalizer or pattern encodes whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    rng = random.Random(8)
    signs = "aAzZeEÉéßçÀÞþÿ×÷µªº«»09'!,.-<|>{}~`@[]\\/ \t\n\x0b\x1c\x85  Σσςİıſ\u0338\u0301\u0307\u030c日本한Ωⅷ²½\0\x7f😀_=J"
    texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 3, 5, 8, 13, 40]))) for _ in range(20_000)]
    texts += ["'s i'm I'M we'll É's é,x", "<|endoftext|> a<|startoftext|>b", "a|b", "x" * 100_000, "É," * 20_000, "", None]
    tok, enc = Tokenizer.from_file(path), records.encoder(path)
    assert enc.by_parts == (name == "word_bpe_49k.json")
    for text, ids in zip(texts, enc.encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids
    assert enc.encode(pa.array([], pa.string())) == [] and [len(x) for x in enc.encode(pa.array([None, "", " "]))][:2] == [0, 0]


def test_repeated_and_null_ids_are_records_in_order(spark):
    rows = [(None, "b b"), (None, "a"), (3, "x"), (3, "x"), (3, "y z"), (1, None), (2, ""), (2, None)]
    got = sorted(records.roundtrip(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2, 3, 3, 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    enc = records.encoder(records.default_tokenizer())
    want = Counter((i, zlib.crc32(np.append(enc.encode(pa.array([t], pa.string()))[0], 1).astype("<u4").tobytes())) for i, t in rows)
    assert want == Counter((r.doc_id, r.ids_crc32) for r in got)


def test_damaged_record_is_refused(spark, docs):
    path = records.roundtrip(spark, docs.limit(3)).collect()[0].path
    with open(path, "r+b") as f:
        f.seek(20)
        f.write(b"\xff\xff")
    with pytest.raises(ValueError):
        records.read_ids(path, 0)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, 0), (10**9 + 1, "12 ..", "en", None, 0), (10**9 + 2, "", None, None, 0), (None, "the", "en", None, 0)], DOC)
    got = langid.identify(spark, docs.unionByName(odd)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang.get(r.doc_id)]
    assert sum(right) / len(right) > 0.97
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == [10**9, 10**9 + 1, 10**9 + 2]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(spark, docs.limit(0)).collect() == []
    # labels of held-out rows are not read
    swapped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert {r.lang_pred for r in langid.identify(spark, swapped).collect()} <= {"de", "en", "es", "fr", "und"}


def test_repeated_bytes(spark, docs, rows):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(150)) for _ in range(5)]
    made = [(4 * 10**9 + i, "".join(rng.choice(["a", "a", "b\0"]) for _ in range(rng.randint(0, 160)))) for i in range(80)]
    made += [(5 * 10**9 + i, "".join(rng.choice(base)[rng.randint(0, 80):][: rng.randint(30, 150)] for _ in range(2))) for i in range(200)]
    made += [(6 * 10**9 + n, "a" * n) for n in (49, 50, 51)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    first: dict = {}
    for i, s in rows + made:
        w, i = (s or "").encode(), LOW if i is None else i
        for k in range(len(w) - 49):
            first[w[k: k + 50]] = min(first.get(w[k: k + 50], i), i)
    want = Counter()
    for i, s in rows + made:
        w, j = (s or "").encode(), LOW if i is None else i
        gone = bytearray(len(w))
        for k in range(len(w) - 49):
            if first[w[k: k + 50]] < j:
                gone[k: k + 50] = b"\1" * 50
        want[(i, len(w), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, r in zip(w, gone) if not r)).hexdigest())] += 1
    got = suffix.remove_repeats(spark, both, bucket_bytes=100_000).collect()
    assert want == Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert suffix.remove_repeats(spark, both.limit(0)).collect() == []


def test_repeat_groups_hold_all_their_places(spark):
    rng = random.Random(8)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (52, 60, 70, 90, 140)]
    texts = [None, "", "x" * 300, "yx" * 60, passage[0], passage[0]]
    for _ in range(60):
        texts.append("".join(rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choice("ij") for _ in range(rng.randint(0, 8)))
                             for _ in range(rng.randint(1, 5))))
    docs = spark.createDataFrame([(i // 2 if i > 60 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, group string")
    found: dict = {}
    for r in suffix.repeat_groups(spark, docs, bucket_bytes=2000).collect():
        found.setdefault(r.group, []).append(r)
    by_id: dict = {}
    for d in docs.collect():
        by_id.setdefault(d.doc_id, []).append(d.text or "")
    assert len(found) > 20
    inside = set()
    for places in found.values():
        n = places[0].n_bytes
        text = {t[r.start: r.start + n] for r in places for t in by_id[r.doc_id]}
        text = next(x for x in text if len(x) == n and all(any(t[r.start: r.start + n] == x for t in by_id[r.doc_id]) for r in places))
        want = {(i, k) for i, some in by_id.items() for t in some for k in range(len(t) - n + 1) if t.startswith(text, k)}
        assert n >= 50 and {(r.doc_id, r.start) for r in places} == want
        sides = [(t[k - 1: k] if k else "", t[k + n: k + n + 1]) for i, k in want for t in by_id[i] if t.startswith(text, k)]
        for side, is_open in enumerate((any(r.open_left for r in places), any(r.open_right for r in places))):
            assert is_open or len({x[side] for x in sides}) > 1 or sides[0][side] == ""
        inside.update(text[k: k + 50] for k in range(n - 49))
    # every string of 50 bytes at two places lies in a group
    at: dict = {}
    for i, some in by_id.items():
        for t in some:
            for k in range(len(t) - 49):
                at.setdefault(t[k: k + 50], set()).add((i, k))
    assert inside == {x for x, places in at.items() if len(places) > 1}
    assert suffix.repeat_groups(spark, docs.limit(0)).collect() == []


def test_interval_tree():
    texts = sorted(["banana"[i:] for i in range(6)])
    lcp = [0] + [len([1 for k in range(min(len(a), len(b))) if a[: k + 1] == b[: k + 1]]) for a, b in zip(texts, texts[1:])]
    assert sorted(suffix.interval_tree(lcp, 1)) == [(1, 0, 0, 2), (2, 0, 4, 5), (3, 1, 1, 2)]


def test_repeated_words(spark, docs, rows):
    first: dict = {}
    for i, s in rows:
        w, i = words(s), LOW if i is None else i
        for k in range(len(w) - 12):
            x = tuple(w[k: k + 13])
            first[x] = min(first.get(x, i), i)
    want = Counter()
    for i, s in rows:
        w, j = words(s), LOW if i is None else i
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k: k + 13])] < j:
                gone[k: k + 13] = [True] * 13
        want[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, r in zip(w, gone) if not r).encode()).hexdigest())] += 1
    got = recompress.remove_repeats(spark, docs, bucket_bytes=100_000).collect()
    assert want == Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert recompress.remove_repeats(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("names", [1, 7, None])
def test_windows_that_share_a_name_are_told_apart_by_their_words(monkeypatch, names):
    """The names of a slice cut down to 1 or 7: the entries are still the different windows."""
    if names:
        whole = recompress.window_names
        monkeypatch.setattr(recompress, "window_names", lambda *a, **k: whole(*a, **k) % np.uint64(names))
    rng = random.Random(4)
    long = ["w" * 40 + "a", "w" * 40 + "b", "w" * 32]
    texts = [" ".join(rng.choice(["a", "b", "ab", *long]) for _ in range(rng.randint(0, 40))) for _ in range(20)] + ["b a " * 20] * 2 + [None]
    piece = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    s = recompress.Slice(piece, 3, 4)
    every = [x for t in texts for x in words(t)]
    got: dict = {}
    for k, entry, doc in zip(s.at[s.order].tolist(), s.entry.tolist(), s.doc.tolist()):
        got.setdefault(entry, set()).add((tuple(every[k: k + 3]), int(s.least[entry]) <= doc))
    assert all(len(x) == 1 for x in got.values())
    assert len(got) == len({x for v in got.values() for x, _ in v})


def test_exact_top_k(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(10**6, None, 0), (10**6 + 20, [1.0, None] + [0.5] * 62, 0), (10**6 + 40, [float("nan")] * 64, 0),
                                 (10**6 + 60, [0.25] * 64, 0), (10**6 + 61, [0.25] * 64, 0), (10**6 + 61, [0.25] * 64, 0), (None, [0.1] * 64, 0)], emb.schema)
    both = emb.unionByName(odd)
    good = [(r.vec_id, np.floor(64 * np.array(r.embedding, float)).astype(int)) for r in both.collect()
            if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    want = Counter()
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        want.update((int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order))
    got = topk.top_k(topk.scaled(both), F.col("vec_id") % 20 == 0, query_block=16, candidate_block=64).collect()
    assert want == Counter(map(tuple, got))
    assert topk.top_k(topk.scaled(both.limit(0)), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_on_vectors_of_other_lengths_and_clashing_columns(spark):
    rows = [(20, [1.0, 2.0], "q"), (1, [1.0, 1.0], "a"), (2, [1.0, 1.0, 1.0], "a"), (3, [], "a"), (40, [], "a"), (60, [1.0, 0.0, 5.0], "a")]
    got = topk.top_k(topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string"), 1), F.col("vec_id") % 20 == 0, k=3)
    assert Counter(map(tuple, got.collect())) == Counter([(20, 1, 1, 3), (40, 1, 3, 0), (60, 1, 2, 6)])


@pytest.mark.parametrize("spread, most_read, most_resolved", [(2.0, 0.5, 0.05), (0.0, 0.95, 0.2)])
def test_top_k_stops_before_the_ends_of_its_lists(spark, spread, most_read, most_resolved):
    """Vectors of uneven length let most queries stop early; even ones stop too, later. Both find the same as the whole product."""
    rng = np.random.default_rng(5)
    x = np.floor(40 * rng.standard_normal((3000, 16)) * np.exp(spread * rng.standard_normal((3000, 1)))).astype(int)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<long>")
    args = (vectors, F.col("vec_id") % 20 == 0)
    size = {"k": 5, "query_block": 64, "candidate_block": 512}
    want = Counter()
    for i in range(0, 3000, 20):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:5]
        want.update((i, r + 1, int(j), int(s[j])) for r, j in enumerate(best))
    assert want == Counter(map(tuple, topk.top_k(*args, **size).collect()))
    cost = topk.reading(*args, **size).collect()
    places, read, resolved = (sum(r[c] for r in cost) for c in ("places", "read", "resolved"))
    zeros = int((x[::20] == 0).sum())                     # lists of weight 0 are not read
    assert len(cost) == 150 and places == 3000 * (16 * 150 - zeros)
    assert read < most_read * places and resolved < most_resolved * 3000 * 150


def test_benchmark_windows(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(900, "the of"), (901, None), (902, "!!"), (903, "Qqq"), (904, "q"), (904, "q"),
                                                       (None, "z z"), (905, "z " * 12), (905, "a " * 30), (906, "a " * 30)], bench.schema))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    window: dict = {}
    for r in bench.collect():
        w = words(lower(r.text), pattern)
        for k in range(max(len(w) - 9, 1) if w else 0):
            window.setdefault(tuple(w[k: k + 10]), set()).add("" if r.item_id is None else str(r.item_id))
    want = Counter()
    for i, s in rows:
        w = words(lower(s), pattern)
        hit, items = [False] * len(w), set()
        for n in {len(x) for x in window}:
            for k in range(len(w) - n + 1):
                if found := window.get(tuple(w[k: k + n])):
                    items |= found
                    hit[k: k + n] = [True] * n
        want[(i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit))] += 1
    for block in (1 << 20, 2000):
        got = decontaminate.scan(spark, docs, bench, block_bytes=block).drop("spans").collect()
        assert want == Counter(map(tuple, got))
    clashing = bench.withColumn("block", F.lit("x")).withColumn("path", F.lit(1))
    assert want == Counter(map(tuple, decontaminate.scan(spark, docs, clashing).drop("spans").collect()))
    assert decontaminate.clean(spark, docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.scan(spark, docs.limit(0), bench).collect() == []


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 300)
    text[::50] = 0
    index = decontaminate.FMIndex(text, 3)
    phrases = np.zeros((40, 5), np.int64)
    lengths = rng.integers(1, 6, 40)
    for i, n in enumerate(lengths):
        phrases[i, :n] = rng.integers(1, 4, n)
    low, high = index.search(phrases, lengths)
    for i, n in enumerate(lengths):
        want = [k for k in range(len(text) - n + 1) if (text[k: k + n] == phrases[i, :n]).all()]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after and after <= before
        if name == "language":
            assert len(after) > 0.9 * len(before)
        if name == "decontamination":
            hit = {r.doc_id for r in decontaminate.scan(spark, kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert after == before - hit
        kept = out
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert len(out) == kept.count() and corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), SF).count() == 0


def test_pipeline_on_null_repeated_and_empty_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows and very long texts pass all stages; documents without a letter go; no rows give no rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, some in (("edges", docs.unionByName(spark.createDataFrame(EDGES, DOC).select(docs.columns))), ("empty", docs.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "edges"))
    got = out.collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()} | {i for i, *_ in EDGES}
    assert got and {r.doc_id for r in got} <= ids - {10**9, 10**9 + 1, 10**9 + 2}
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    nothing = corpus_pipeline.run(spark, str(tmp_path / "empty"))
    assert nothing.columns == out.columns and nothing.collect() == []


def test_pipeline_bounds_batches_by_bytes(spark, tmp_path):
    """Rows go to Python in batches of about ``ARROW_BATCH_BYTES`` in every stage; a bound of the caller stays."""
    import corpus_pipeline
    from shelfage.session import ARROW_BATCH_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    row = F.col("id").cast("string")
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(row, F.repeat(F.lit(" word"), 500)).alias("text"),
                                             F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(2500).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "word " * 20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs.limit(0), str(tmp_path))
            got = docs.mapInArrow(sizes, "bytes long, n long").collect()
            assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) < 1.1 * ARROW_BATCH_BYTES
        spark.conf.set(key, "7777")
        corpus_pipeline.decontamination(spark, docs, str(tmp_path))
        assert spark.conf.get(key) == "7777"
    finally:
        spark.conf.unset(key)


def test_fm_index_memory_of_a_shard():
    """A shard of benchmark words only: ranks, positions and the sort of the suffixes take 4 bytes a place, keys 8."""
    import tracemalloc

    text = np.random.default_rng(1).integers(1, 4000, 200_000)
    tracemalloc.start()
    try:
        decontaminate.FMIndex(text, 4000)
        assert tracemalloc.get_traced_memory()[1] < 100 * len(text)
    finally:
        tracemalloc.stop()
