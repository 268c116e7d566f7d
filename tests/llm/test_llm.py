"""The training-data operators against brute force, exact round trips and held-out accuracy, on small and awkward tables."""

import collections
import hashlib
import os
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from porelake.llm import chat, common, embed_dedup, langid, licenses, minhash, mixing, packing, quality, queries, sharding, topk, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, white space alone, other scripts, control strings."""
    long = " ".join(f"word{i % 977}" for i in range(9000))
    rows = [
        (1, "the same text of a few words here", "en", "a", 3), (2, "the same text of a few words here", None, "b", None), (2, "the same text of a few words here", None, "b", None), (3, None, "en", None, 0),
        (4, "", "de", "b", 0), (5, " \t\n ", None, None, 3), (6, long, "en", "a", len(long)), (7, long + " end", "en", "a", 1), (8, "one", "fr", "c", 3), (9, "ONE", "fr", "c", 3),
        (10, "naïve 世界 привет 🙂 <|endoftext|> x", None, "é", 5), (11, "12 34 !! ??", "en", "c", 9), (12, "a b\x1cc d", "fr", "c", 3), (None, "no id at all", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return common.read(spark, SF, "documents")


# --- helpers


def test_running_before(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = common.running_before(d, "g", ["id"], F.col("v"), "before", 500, per=20).collect()
    for g in range(3):
        part = sorted((r.before, r.v) for r in got if r.g == g)
        at = 0
        for before, v in part if len({p[0] for p in part}) == len(part) else []:
            assert before == at
            at += v
        assert max(r.before + r.v for r in got if r.g == g) == sum(r.v for r in got if r.g == g)


def test_shared_folder_is_asked_for():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# --- 1 packing


def check_packed(rows, docs, window):
    """rows: key, start, length, n, sequence_id, offset, ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.byte_bpe_path())
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r.sequence_id].append(r)
    for i, s in enumerate(sorted(whole)):
        at = 0
        for r in sorted(whole[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert s == i and (at == window or s == max(whole))
    want = collections.Counter((d.doc_id, tuple([*tok.encode(d.text or "", add_special_tokens=False).ids, 0])) for d in docs)
    got, left = collections.Counter(), sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at, ids = 0, []
    for r in left:
        assert r.start == at
        ids += np.frombuffer(r.ids, "<u4").tolist()
        at += r.length
        if at == r.n:
            got[r.key.doc_id, tuple(ids)] += 1
            at, ids = 0, []
    assert got == want and at == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(spark, parts):
    docs = awkward(spark).repartition(parts)
    packed = packing.sequences(docs, ["doc_id"], 64, ranks=queries.ranks_path(), special=(("<|endoftext|>", 50256),))
    rows = packing.pieces(packed).collect()
    check_packed(rows, docs.collect(), 64)
    seqs = {s.sequence_id: s for s in packing.padded(packed, 64, 9).collect()}
    assert all(len(s.ids) == 256 for s in seqs.values()) and sum(s.n_ids < 64 for s in seqs.values()) <= 1
    for s, x in seqs.items():
        ids = b"".join(r.ids for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset))
        assert x.ids == ids + bytes([9, 0, 0, 0]) * (64 - x.n_ids)
    assert packing.sequences(empty(spark), ["doc_id"], 64).count() == 0


def test_packing_shuffles_boundary_records_alone(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), "id"), 20).alias("text")).repartition(4)
    packed = packing.sequences(docs, ["doc_id"], 64)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Filter (isnotnull(n_ids" in plan
    cut = spark.read.parquet(re.search(r"(\S*/windows-\w+)", packed.inputFiles()[0])[1])
    assert cut.filter("n_ids < 64").count() <= 2 * 4 * 2 < cut.filter("n_ids = 64").count() / 20


def test_packing_keys_of_any_name(spark):
    names = ["n", "part", "at", "ids", "key", "offset", "a.b"]
    docs = awkward(spark).select("text", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    got = packing.pieces(packing.sequences(docs, names, 64)).select("key.*", "sequence_id").collect()
    assert {tuple(r)[:7] for r in got} == {tuple(range(7))}


@tables
def test_packing_documents(spark):
    check_packed(packing.pieces(queries.pack_documents(documents(spark), ["doc_id"])).collect(), documents(spark).collect(), 1024)
    r = queries.op1_concat_cut(spark, SF).first()
    assert set(r.asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_both_tokenisers_agree():
    """On each code point up to the bound, in words, between spaces and beside digits; the slow tokeniser takes many texts at once."""
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(packing.byte_bpe_path()), packing._encoder(packing.byte_bpe_path(), queries.ranks_path(), (("<|endoftext|>", 50256),))
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}9{chr(c)}!  {chr(c)}\n" for c in range(packing._ALIKE + 1) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(texts), 20_000):
        for x, t in zip(texts[lo : lo + 20_000], tok.encode_batch(texts[lo : lo + 20_000], add_special_tokens=False), strict=True):
            assert t.ids == fast(x), x


# --- 2 sharding


@tables
def test_shards(spark):
    docs = documents(spark).collect()
    got = queries.op2_kd_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes, most = [sum(r.size for r in v) for v in by.values()], max(r.size for r in got)
    assert max(sizes) - min(sizes) <= 2 * most


def test_shards_of_equal_rows(spark):
    """One text holds all the rows: its shards still have equal sizes."""
    d = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"), F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    n = [r["count"] for r in sharding.shard_documents(d, 24).groupBy("shard").count().collect()]
    assert len(n) == 24 and max(n) - min(n) <= 4
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert sharding.shard_documents(awkward(spark).withColumn("w", F.lit(1)).withColumn("row", F.lit(1)), 3).count() == 14


def test_shards_of_repeated_rows(spark):
    """Rows that are wholly equal are dealt out as well, and have slots of their own."""
    d = spark.range(600).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 400, "0123456").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("x").alias("lang"), F.lit("s").alias("source"))
    got = sharding.shard_documents(d, 4).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 600 and max(sizes.values()) - min(sizes.values()) <= 40
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_equal_texts_stand_together(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 1997).cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 5).cast("string")).alias("lang"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    got = sharding.shard_documents(d, 8, together=16).collect()
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32].add(r.shard)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert all(len(v) == 1 for v in of.values()) and max(sizes.values()) - min(sizes.values()) < 0.02 * min(sizes.values())


@tables
@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_equal_texts_of_the_given_tables(spark, table):
    """At the registered parameters: only groups of over 1/16 of a shard's bytes are split, and the shards' sizes stay near."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    ids = {r.doc_id: r.text for r in docs.collect()}
    of, size, own = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in sharding.shard_documents(docs, 24).collect():
        of[ids[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
        own[ids[r.doc_id]] += r.size
    total = sum(size.values())
    groups = [t for t in of if own[t] > len((t or "").encode()) + 8]
    assert groups and all(len(of[t]) == 1 for t in groups if own[t] * 16 * 24 <= total)
    if table == "sf0.01":  # the smaller table has a text of nearly a shard's bytes
        assert max(size.values()) < 1.02 * total / 24 and min(size.values()) > 0.98 * total / 24


def test_many_rows_of_few_bytes_stand_together(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("a text of some length, number "), F.repeat(F.col("id").cast("string"), 8))).alias("text"), F.lit("l").alias("lang"), F.lit("s").alias("source"))
    got = sharding.shard_documents(d, 4, together=2).collect()
    assert len({r.shard for r in got if r.size == 8}) == 1 and len(got) == 4000


def plain_kd(keys, w, heavy, n):
    """A plain k-d tree with exact medians: each row's shard, numbered from the left."""
    bits = sharding._BITS

    def width(k, w):
        sums = np.cumsum(w[np.argsort(k, kind="stable")])
        k = np.sort(k) >> (bits - 12)
        return int(k[np.searchsorted(sums * 10, sums[-1] * 9, "right")] - k[np.searchsorted(sums * 10, sums[-1], "right")]) if len(k) else 0

    def cut(k, w, target):
        """The key below which the weight is nearest to target, the lower of two."""
        order = np.argsort(k, kind="stable")
        best = None
        for key in [*sorted(set(k[order].tolist())), None]:
            below = int(w[k < key].sum()) if key is not None else int(w.sum())
            if best is None or abs(below - target) < best[0]:
                best = (abs(below - target), key, below)
        return best[1:]

    def split(rows, n, first):
        if n == 1:
            out[rows] = first
            return
        light, big = rows[~heavy[rows]], rows[heavy[rows]]
        widths = [width(keys[light, i], w[light]) for i in range(keys.shape[1])]
        k, share = keys[:, widths.index(max(widths))], n // 2 / n
        at_big, got = cut(k[big], w[big], w[big].sum() * share)
        at, _ = cut(k[light], w[light], w[rows].sum() * share - got)
        goes = np.where(heavy[rows], True if at_big is None else k[rows] < (at_big or 0), True if at is None else k[rows] < (at or 0))
        split(rows[goes], n // 2, first)
        split(rows[~goes], n - n // 2, first + n // 2)

    out = np.zeros(len(w), int)
    split(np.arange(len(w)), n, 0)
    return out


def test_tree_like_a_plain_one(spark):
    rng = np.random.default_rng(9)
    n = 700
    pts = [(i, int(w), float(a), float(b), int(t), int(i)) for i, (w, a, b, t) in enumerate(zip(rng.integers(1, 100, n) * np.where(rng.random(n) < 0.02, 60, 1), rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 1 << 40, n), strict=True))]
    df = spark.createDataFrame(pts, "id long, w long, a double, b double, t long, r long")
    keyed = sharding._keyed(df.withColumn("heavy", F.lit(False)), ["a", "b"], "t", "r").orderBy("id").toPandas()
    for shards in (5, 8):
        got, _ = sharding.kd_shards(df.repartition(3), ["a", "b"], "t", "r", shards, tolerance=0)
        w = keyed["w"].to_numpy()
        want = plain_kd(keyed[["k0", "k1"]].to_numpy(), w, w * 64 * shards > w.sum(), shards)
        assert [r.shard for r in got.orderBy("id").collect()] == want.tolist()
    one, _ = sharding.kd_shards(df, ["a", "b"], "t", "r", target_bytes=sum(p[1] for p in pts) // 10 + 1)
    assert one.agg(F.countDistinct("shard")).first()[0] == 10


# --- 3 near-duplicate vectors


def vectors(seed, n, d=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, d))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.25, 0.33, 2], (n, 1))
    return x * rng.uniform(0.1, 30, (n, 1))


def links(x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = u @ u.T >= t
    np.fill_diagonal(a, False)
    return a


def reach(a):
    low = np.arange(len(a))
    while True:
        new = np.minimum(low, np.where(a, low[None], len(a)).min(1))
        if (new == low).all():
            return low
        low = new


@pytest.mark.parametrize("cell", [37, 8192])
def test_near_vectors(spark, cell):
    x = vectors(2, 300)
    odd = [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df.repartition(3), "vec_id", "embedding", 0.9, cell).collect()}
    a = links(x, 0.9)
    low = reach(a)
    assert [got[i].n_links for i in range(300)] == a.sum(1).tolist() and [got[i].component_id for i in range(300)] == low.tolist()
    assert [(got[i].n_links, got[i].component_id) for i in range(300, 307)] == [(0, 300), (0, 301), (0, 302), (0, 303), (0, 304), (1, 305), (1, 305)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_quantised_bound():
    x = vectors(3, 400)
    q = embed_dedup.quantise(x)
    u, codes, s, e = q
    assert np.abs(codes).max() <= 127
    exact, rough = u @ u.T, (codes.astype(float) @ codes.T.astype(float)) * np.outer(s, s)
    assert (np.abs(exact - rough) <= np.outer(e, 1 + e) + e[None]).all()
    i, j, recomputed = embed_dedup.tile_links(q, q, 0.9, True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(links(x, 0.9)), strict=True) if a < b}
    assert recomputed < 0.1 * 400 * 399 / 2


@tables
def test_near_vectors_of_the_table(spark):
    e = common.read(spark, SF, "embeddings").orderBy("vec_id").collect()
    a = links(np.array([r.embedding for r in e], float), 0.9)
    got = queries.op3_int8_tiles(spark, SF).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == a.sum(1).tolist() and [r.component_id for r in got] == [e[i].vec_id for i in reach(a)]


def test_null_ids_of_vectors(spark):
    """One row of each component is kept, that of the least id; where none has an id, one of them."""
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (2**60 + 1, [2.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(0)).withColumn("rid", F.lit(0))
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(d, "vec_id", "embedding").collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (None, 2, 1, False), (2**60 + 1, 2, 1, False), (None, 1, None, True), (None, 1, None, False)], key=str)
    v = d.select(F.col("vec_id").alias("vec"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 100).cast("double")).alias("x"), F.lit(1).alias("len"))
    top = topk.top_k(v, v, 10).orderBy("query_id").collect()
    assert [tuple(r) for r in top] == [(1, 1, 2**60 + 1, 20000), (2**60 + 1, 1, 1, 20000)]


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


# --- 4 exact top-k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(400, 12)) * rng.uniform(0.1, 40, (400, 1)))
    x[50:90] = x[50]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec long, x array<double>")
    got = topk.top_k(df, df.filter("vec % 10 = 0"), 10, q_block=16, c_block=60, head=3).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, 400, 10):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:10]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(best)]
    assert [tuple(r) for r in got] == want
    few = spark.createDataFrame([(0, [1.0]), (100, [2.0, 3.0])], "vec long, x array<double>")
    assert [tuple(r) for r in topk.top_k(few, few, 10).orderBy("query_id").collect()] == [(0, 1, 100, 2), (100, 1, 0, 2)]
    assert topk.top_k(few.limit(0), few.limit(0), 10).count() == 0


def test_pruning_prunes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)) * np.geomspace(50, 0.01, 16)
    x = np.floor(x * 10)
    x = x[np.argsort(-(x**2).sum(1))]
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    q = x[:5]
    least = np.sort(q @ x.T, axis=1)[:, -11]
    i, j, s, full = topk.block_top(q, np.arange(5), x, np.arange(2000), 10, least, turn, 4)
    assert full < 0.2 * 5 * 2000 and len(i) == 50 and (s == np.rint((q[i] * x[j]).sum(1))).all()


# --- 5 language ID


def test_codewords():
    for n in (2, 4, 7, 8, 20):
        c = langid.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(c) for b in c[:i]]
        assert min(apart) * 2 > c.shape[1]


@tables
def test_language_id(spark):
    got = queries.op5_ecoc(spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents(spark).count() and 20 < len(held) < 90
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_one_wrong_bit_is_corrected():
    model = {"langs": list("abcdefgh"), "code": langid.codewords(8), "bit": np.ones(7, np.float32)}
    for i, c in enumerate(model["code"]):
        for b in range(7):
            m = 4 * c.copy()
            m[b] *= -1
            best, _, _ = langid.decode(model, m[None].astype(np.float32))
            assert best[0] == i
    _, _, gap = langid.decode(model, np.zeros((1, 7), np.float32))
    assert gap[0] < 1e-6


@tables
def test_language_id_like_a_plain_one(spark):
    """Each text alone: counts of byte n-grams in a dictionary, each language's loss in a loop."""
    docs = documents(spark)
    model = langid.fit(docs.filter("lang is not null and text is not null"), per_lang=30)

    def place(gram):
        b = [int(langid._PLAIN[x]) for x in gram]
        m = (1 << 32) - 1
        two = lambda p, q: (q * 0x85EBCA77 & m) ^ ((p + 7) * 0xC2B2AE3D & m)
        h = (b[0] * 0x9E3779B1 & m) if len(b) == 1 else two(*b) if len(b) == 2 else (two(b[1], b[2]) * 5 & m) ^ ((b[0] + 3) * 0x27D4EB2F & m)
        return ((h ^ h >> 15) * 0x2C1B3C6D & m) >> 19

    got = {r.key.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for d in docs.orderBy("doc_id").limit(60).collect():
        if not d.text or not any(c.isalpha() for c in d.text):
            assert got[d.doc_id].lang_pred == "und"
            continue
        raw = b" " + d.text.lower().encode() + b" "
        grams = collections.Counter(raw[i : i + n].translate(bytes(langid._PLAIN.astype(np.uint8))) for n in (1, 2, 3) for i in range(len(raw) - n + 1))
        x = collections.Counter()
        for g, n in grams.items():
            x[place(g)] += n
        length = np.sqrt(sum(x.values()))
        margins = model["bias"] + sum(np.sqrt(n) / length * model["w"][i].astype(float) for i, n in x.items())
        loss = [sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(model["bit"], code, margins, strict=True)) for code in model["code"]]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert got[d.doc_id].lang_pred == model["langs"][int(np.argmin(loss))] and np.isclose(got[d.doc_id].score, p.max(), atol=1e-3)


def test_language_sample_is_bounded(spark):
    """One text that stands 5,000 times counts once, and the others of its language are learnt from."""
    rows = spark.range(5000).select(F.lit("immer derselbe satz").alias("text"), F.lit("de").alias("lang"))
    rows = rows.unionByName(spark.range(900).select(F.concat(F.lit("satz nummer "), "id").alias("text"), F.lit("de").alias("lang"))).unionByName(spark.range(7).select(F.concat(F.lit("sentence "), "id").alias("text"), F.lit("en").alias("lang")))
    assert langid.fit(rows, per_lang=100)["rows"] == 107
    few = langid.fit(rows, per_lang=100, max_rows=20)  # fewer of each, but no language is lost
    assert few["langs"] == ["de", "en"] and few["rows"] == 17


def test_language_id_awkward(spark):
    d = awkward(spark)
    model = langid.fit(d.filter("lang is not null and text is not null"))
    got = {r.key.doc_id: r.lang_pred for r in langid.predict(d, model, ["doc_id"]).collect()}
    assert {got[i] for i in (3, 4, 5, 11)} == {"und"} and got[1] in ("en", "fr", "de")
    assert {r.lang_pred for r in langid.predict(d, langid.fit(empty(spark)), ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty(spark), model, ["doc_id"]).count() == 0


# --- 6 quality


@tables
def test_quality_held_out(spark):
    """Fitted on the rows of even doc_id of a larger table, the classifier sorts those of odd doc_id."""
    sf = SF.replace("0.001", "0.1")
    docs, grades = common.read(spark, sf, "documents"), quality.graded(common.read(spark, sf, "labels"))
    got = quality.grade(docs, quality.fit(docs, grades.filter("doc_id % 2 = 0")), ["doc_id"]).select("key.doc_id", "expected_grade", "selected").join(grades, "doc_id").filter("doc_id % 2 = 1").collect()
    kept = {g: [r.selected for r in got if r.grade == g] for g in range(3)}
    assert np.mean(kept[0]) < 0.02 and np.mean(kept[1]) < 0.25 and np.mean(kept[2]) > 0.98
    means = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert means == sorted(means)


def plain_features(text):
    """The same in plain Python, a text and a word at a time."""
    place = lambda salt, x: int(quality._place(salt, np.array([x], np.uint64))[0])
    hasher = words.Hasher()

    def hashed(b):
        raw = np.frombuffer(b + b" ", np.uint8)
        return int(hasher.spans(hasher.sums(raw), np.array([0]), np.array([len(b)]))[0])

    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    low = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode())
    if not found:
        return [quality.EMPTY]
    out, shapes = {place(30, 8 * len(set(found)) // len(found))}, collections.Counter()
    for w, v in zip(found, low, strict=True):
        four = [w[0], *(w[-i] if i <= len(w) else None for i in (3, 2, 1))]
        classes = []
        for b in four:
            c = int(quality._CLASS[b]) if b is not None else classes[-1]
            if not classes or classes[-1] != c:
                classes.append(c)
        code = 0
        for c in classes:
            code = code * 512 + c
        shapes[code] += 1
        v = re.sub(rb"^[^\x80-\xff\w]+|[^\x80-\xff\w]+$", b"", v)
        out.add(place(1, hashed(v)))
        out |= {place(k, hashed(v[:k])) for k in (4, 5) if len(v) > k}
    for code, n in shapes.items():
        out |= {place(10 + j, code) for j in range(min(8, int(np.log2(len(found) / n))), 9)}
    return sorted(out)


@tables
def test_quality_like_a_plain_one(spark):
    docs = documents(spark)
    model = quality.fit(docs, quality.graded(common.read(spark, SF, "labels")))
    got = {r.key.doc_id: r for r in quality.grade(docs, model, ["doc_id"]).collect()}
    some = [*docs.orderBy("doc_id").limit(80).collect(), *(r for r in awkward(spark).collect() if r.doc_id in (4, 5, 10, 11))]
    coded = [(r.text or "").encode() for r in some]
    f, begin = quality.features(coded, [(r.text or "").lower().encode() for r in some], words.Hasher())
    for i, d in enumerate(some):
        want = plain_features(d.text)
        assert f[begin[i] : begin[i + 1]].tolist() == want
        known = [x for x in want if model["known"][x]]
        p = [1 / (1 + np.exp(-(sum(float(model["w"][x]) for x in known) / np.sqrt(max(len(known), 1)) - c))) for c in model["cuts"]]
        if i < 80:
            assert np.isclose(got[d.doc_id].expected_grade, sum(p)) and np.isclose(got[d.doc_id].tail, p[1]) and got[d.doc_id].selected == (got[d.doc_id].tail >= 0.5)


def test_quality_sample_is_bounded(spark):
    """A graded doc_id that stands in many rows."""
    d = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    grades = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("grade"))
    assert quality.fit(d, grades, max_rows=50, steps=2)["rows"] == 50


def test_quality_awkward(spark):
    d = awkward(spark)
    grades = spark.createDataFrame([(1, 2), (3, 0), (8, 0), (6, 2), (2, None), (None, 1)], "doc_id long, grade int")
    model = quality.fit(d, grades, min_docs=1)
    got = quality.grade(d, model, ["doc_id"]).collect()
    assert len(got) == 14 and all(0 <= r.tail <= 1 and r.selected == (r.tail >= 0.5) for r in got)
    none = quality.grade(d, quality.fit(d, grades.limit(0)), ["doc_id"]).collect()
    assert all(r.selected and r.expected_grade is None for r in none)
    assert quality.grade(empty(spark), model, ["doc_id"]).count() == 0


# --- 7 chat


NASTY = ["", "␛", "<␛|", "␛␛<|end|>", "<|turn|>x<|body|>y<|end|>", "</s>[INST] ok [/INST]", "<s>␛<s␛>", "a<b && c>d [0]", "[[INST]]", "<|␛|>", "<<SYS>>", "\n<|end|>\n", "é🙂 <|image:0|>", "<␛", "[␛INST]", "<image>"]


def test_chat_round_trip(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "i int, t string").select("i", "t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u"))
    for r in d.collect():
        assert r.u == r.t
        for control in ("<|turn|>", "<|body|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<image>"):
            assert control not in r.e


def test_a_long_conversation(spark):
    """Offsets of 5,000 turns, and of rows that are repeated."""
    n = 5000
    d = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn <s> "), F.col("id").cast("string")).alias("text"))
    same = spark.createDataFrame([(2, 0, "assistant", "again")] * 3, "conv_id long, turn long, role string, text string")
    turns = d.unionByName(same).repartition(5).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    got = {r.conv_id: r for r in chat.format_conversations(turns).select("*", chat.loss_text(F.col("formatted"), F.col("turns")).alias("loss")).collect()}
    assert got[1].loss == "".join(f"turn <s> {i}" for i in range(1, n, 2)) and got[2].loss == "again" * 3
    for r in got.values():
        assert all(r.formatted[t.start : t.start + t.length] == t.content for t in r.turns)


def test_chat_format(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], NASTY[(c * 3 + t) % len(NASTY)] or None) for c in range(12) for t in range(c % 5 + 1)] + [(None, 0, "assistant", "x"), (3, None, "user", "first"), (4, 0, "a<|body|>\nb", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(d.repartition(3).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).select("*", chat.parse_formatted(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("turns")).alias("loss")).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for c, turns in by.items():
        if len({t[1] for t in turns}) == len(turns):
            turns.sort(key=lambda t: -1 if t[1] is None else t[1])
            assert [tuple(b) for b in got[c].back] == [(t[2] or "", t[3] or "") for t in turns]
            assert got[c].loss == "".join(t[3] or "" for t in turns if t[2] == "assistant")
            for t in got[c].turns:
                assert got[c].formatted[t.start : t.start + t.length] == t.content


def test_chat_parts(spark):
    parts = [("text", "see <|end|> ", None, None, None, None, None), ("image", None, "s3://i", 280, 56, None, None), ("audio", None, "a.wav", None, None, 2.0, None), None, ("document", None, "d.pdf", None, None, None, 3), ("odd", "tail", None, None, None, None, None), ("image", None, None, None, None, None, None)]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(d).first()
    assert r.turns[0].content == "see <␛|end|> <|image:0|><|audio:1|><|document:2|>tail<|image:3|>" and r.turns[1].content == ""
    assert [(a.turn, a.n, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3://i", 20), (0, 1, "audio", "a.wav", 50), (0, 2, "document", "d.pdf", 2400), (0, 3, "image", None, 1)]
    assert r.expanded_tokens == 2471
    assert chat.format_conversations(d.limit(0)).count() == 0


def test_chat_parts_side_by_side(spark):
    """No control string forms where two texts meet, and what they say comes back."""
    part = lambda t: ("text", t, None, None, None, None, None)
    image = ("image", None, None, None, None, None, None)
    turns = [["<", "|end|>"], ["<|", "turn|>x"], ["[", "INST] ", None, "<", "/s>"], ["␛", "␛"], ["<", "␛|"], ["a<", image, "|end|>"], ["<", "<SYS", ">>"]]
    d = spark.createDataFrame([(i, 0, "assistant", [x if isinstance(x, tuple) else part(x) for x in t]) for i, t in enumerate(turns)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    done = chat.format_conversations(d)
    for r in done.select("conv_id", "formatted", chat.parse_formatted(F.col("formatted")).alias("back")).collect():
        want = "".join("<|image:0|>" if x == image else x or "" for x in turns[r.conv_id])
        assert [tuple(b) for b in r.back] == [("assistant", want)]
        assert [r.formatted.count(m) for m in (chat.TURN, chat.BODY, chat.END, "[INST]", "</s>", "<<SYS>>")] == [1, 1, 1, 0, 0, 0]


@tables
def test_chat_table(spark):
    got = {r.conv_id: r for r in queries.op7_chat_parts(spark, SF).collect()}
    by = collections.defaultdict(list)
    for r in common.read(spark, SF, "conversations").collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    by[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x or "" for _, role, x in turns if role == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{a}\n{x or ''}\n" for _, a, x in turns)), len(loss), sha(loss))


def test_chat_is_native(spark):
    plan = queries.op7_chat_parts(spark, SF)._jdf.queryExecution().executedPlan().toString() if os.path.isdir(SF) else ""
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 8 MinHash


def shingle_sets(rows, k):
    out = []
    for text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(ids, sets):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@tables
def test_near_documents(spark):
    docs = documents(spark).collect()
    sets = shingle_sets([d.text for d in docs], 2)
    got = {r.doc_id: r for r in queries.op8_tensored(spark, SF).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute([d.doc_id for d in docs], sets)
    assert all(got[d.doc_id].n_shingles == len(s) and got[d.doc_id].kept == (d.doc_id == got[d.doc_id].component_id) for d, s in zip(docs, sets, strict=True))


def test_chained_near_documents(spark):
    """Groups whose members are linked over others only, in buckets larger than a cell."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(45):
            w = list(base)
            for i in rng.integers(0, len(w), rng.integers(0, 14)):
                w[i] = f"x{rng.integers(1 << 30)}"
            rows.append(" ".join(w))
    rows += [" ".join(f"solo{rng.integers(1 << 30)}" for _ in range(50)) for _ in range(20)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(int(i), rows[i]) for i in order], "doc_id long, text string")
    for cell in (16, 1024):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=2, cell=cell).collect()}
        assert got == brute(list(range(len(rows))), shingle_sets(rows, 2))


def test_near_documents_awkward(spark):
    got = minhash.near_duplicates(awkward(spark), shingle=5).collect()
    assert len(got) == 14
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[9].component_id == 8 and by[7].component_id == 6 and [by[i].n_shingles for i in (3, 4, 5, 8)] == [0, 0, 0, 1]
    assert all(by[i].kept and by[i].component_id == i for i in (3, 4, 5))
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_shingle_hashes():
    h, texts = words.Hasher(), ["A b\tc", "a B c", "x" * 70_000 + " b c", "", None, "one", "é a b c c c c", " \n ", "a b c a b c"]
    for k in (1, 2, 5):
        flat, begin = minhash.shingles([words.encoded(t) for t in texts], k, h)
        assert np.diff(begin).tolist() == [len(s) for s in shingle_sets(texts, k)]
        alone = [minhash.shingles([words.encoded(t)], k, h)[0].tolist() for t in texts]
        assert [flat[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == alone and alone[0] == alone[1]
    ranges = lambda sizes, rows=9: [(lo, lo + len(t)) for lo, t, coded in words.chunks(pa.array(["x" * n for n in sizes], pa.string()), rows, 10) if len(t) == len(coded)]
    assert ranges([]) == [] and ranges([3, 3, 30, 4, 6, 1]) == [(0, 2), (2, 3), (3, 5), (5, 6)] and ranges([1] * 5, 2) == [(0, 2), (2, 4), (4, 5)]


# --- 9 licences


MIT = " ".join(licenses.SENTENCES[k] + "." for k in ("mit.grant", "mit.notice", "mit.asis")).replace("conditions.", "conditions:")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Some text. Licensed under the Apache License, Version 2.0.\nMore", ["Apache-2.0"]), (f"x\n{MIT}\ny", ["MIT"]), (MIT.replace(" the ", "\nthe "), ["MIT"]), ("licensed UNDER cc by-nc 4.0.", ["CC-BY-NC-4.0"]),
        ("words before\nReleased under the MIT License.\nAll rights reserved.", ["All-Rights-Reserved", "MIT"]), ("We gave a license to all rights reserved seats.", []), (None, []), ("", []),
        (licenses.SENTENCES["gpl.free"] + ".\n\n" + licenses.SENTENCES["gpl.hope"] + ".", ["GPL-3.0-or-later"]), ("Licensed under the Apache License, Version 2.0 or later.", []),
        (". ".join(licenses.SENTENCES[k] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")) + ".", ["BSD-3-Clause"]),
        (". ".join(licenses.SENTENCES[k] for k in ("bsd.grant", "bsd.binary", "bsd.source")) + ".", []),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;", ["Apache-2.0", "MIT"]), ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", ["GPL-2.0-only WITH Linux-syscall-note"]),
        ("SPDX-License-Identifier: none", []), ("Released under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("Licensed under zlib License", ["Zlib"]),
        (f"{licenses.SENTENCES['bsd.grant']}. {'word ' * 5000}. {licenses.SENTENCES['bsd.source']}.", []),
        (f"{licenses.SENTENCES['apache.header']}. {'word ' * 5000}. {licenses.SENTENCES['apache.copy']}.", ["Apache-2.0"]),
        (f"{licenses.SENTENCES['gpl2.free']}. {licenses.SENTENCES['gpl.hope']}. {licenses.SENTENCES['classpath.link']}.", ["GPL-2.0-or-later WITH Classpath-exception-2.0"]),
    ],
)
def test_licences(spark, text, want):
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()
    assert r.licences == want
    for m in r.matches:
        assert 0 <= m.start < m.end <= len(text)


GPL, ISC = (" ".join(licenses.SENTENCES[k] + "." for k in keys) for keys in (("gpl.free", "gpl.hope"), ("isc.grant",)))


@pytest.mark.parametrize(("text", "want"), [(MIT, ["MIT"]), (GPL, ["GPL-3.0-or-later"]), (ISC, ["ISC"]), (licenses.SENTENCES["unlicense.public"] + ".", ["Unlicense"])])
@pytest.mark.parametrize("mark", ["", " * ", "// ", "dnl "])
def test_wrapped_licences(text, want, mark):
    """A header of many lines, straight under a copyright line or after a line that is blank but for its mark, or all on one line."""
    head = "Copyright (c) 2020 Foo"
    made = [f"{head} {text}"]
    for width in (30, 60):
        lines = textwrap.wrap(text, width)
        for whole in ([head, *lines], [head, "", *lines], [f"{head} {lines[0]}", *lines[1:]]):
            made.append("/*\n" + "\n".join(mark + x for x in whole) + "\n */\nint x;")
    for whole in made:
        assert [licenses.RULES[r][0] for r, _, _ in licenses.match_rules(licenses.sentences(whole))] == want


def test_short_licences_inside_a_line():
    found = lambda text: [k for k, _, _ in licenses.sentences(text)]
    assert found("int x; /* Licensed under the MIT License */ int y;") == ["MIT.named0.0t"]
    assert found("Copyright (c) 2020 Foo All rights reserved.") == ["rights.reserved"]
    assert found("It is not so that this is licensed under the MIT License.") == found("Copyright and all rights reserved.") == []


BSD = ". ".join(licenses.SENTENCES[k] for k in ("bsd.grant", "bsd.source", "bsd.binary")) + ". "
NAMES = licenses.SENTENCES["bsd.names"]


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        *((NAMES.replace("the copyright holder", x) + ".", "BSD-3-Clause") for x in ("Google Inc.", "the University of California, Berkeley", "<organization>", "\u682a\u5f0f\u4f1a\u793e", "a " * 50)),
        ("Neither the names of the copyright holders nor the names of their contributors" + NAMES.split("contributors")[1] + " of Foo", "BSD-3-Clause"),
        ("The name of the author may not" + NAMES.split(" may")[1] + ".", "BSD-3-Clause"),
        ("THIS SOFTWARE IS PROVIDED AS IS.", "BSD-2-Clause"), ("Neither is the name of use. The name of Foo may be used with permission.", "BSD-2-Clause"), ("", "BSD-2-Clause"),
    ],
)
def test_bsd_with_a_holders_name(clause, want):
    for text in (BSD + clause, " * " + "\n * ".join(textwrap.wrap(BSD + clause, 40)), f"{BSD}{clause} More.\n\n{BSD}{clause}"):
        got = licenses.sentences(text)
        hits = licenses.match_rules(got)
        assert {licenses.RULES[r][0] for r, _, _ in hits} == {want}
        assert all(0 <= a < b <= len(text) for _, a, b in got) and all(x[2] <= y[1] for x, y in zip(got, got[1:], strict=False))


@tables
def test_licences_of_the_table(spark):
    """A plainer reading: lines that are, normalised, a known sentence; and rules tried at each sentence of such a list."""
    got = {r.doc_id: r for r in queries.op9_license_rules(spark, SF).collect()}
    ids = {licenses.normalise(s): k for k, s in licenses.SENTENCES.items()}
    n = 0
    for d in documents(spark).collect():
        want = [ids[x] for x in map(licenses.normalise, re.split(r"\n|(?<=[.!?]) ", d.text or "")) if x in ids]
        assert want == got[d.doc_id].sentence_ids
        of = {licence for licence, _, seq in licenses.RULES if len(seq) == 1 and seq[0] in want}
        assert sorted(of) == got[d.doc_id].licences
        n += len(want)
    assert n > 0
    assert licenses.scan(empty(spark), ["doc_id"]).count() == 0 and licenses.scan(awkward(spark), ["doc_id"]).count() == 14


def test_ids_stay_whole(spark):
    """Great ids beside a null one, and keys of any name."""
    d = spark.createDataFrame([(2**60 + 1, "x"), (None, "y"), (2**60 + 3, None)], "doc_id long, text string").coalesce(1)
    names = ["matches", "licences", "score", "lang_pred", "tail", "selected", "a.b"]
    for c in names:
        d = d.withColumn(c, F.lit(c))
    model = langid.fit(spark.createDataFrame([("wort und satz", "de"), ("word and sentence", "en")], "text string, lang string"))
    none = quality.fit(d, spark.createDataFrame([], "doc_id long, grade int"))
    for out in (licenses.scan(d, ["doc_id", *names]), langid.predict(d, model, ["doc_id", *names]), quality.grade(d, none, ["doc_id", *names])):
        assert sorted(((r.key.doc_id or 0, *r.key[1:]) for r in out.collect())) == [(i, *names) for i in (0, 2**60 + 1, 2**60 + 3)]


# --- 10 mixing


def test_share_out():
    t = mixing.share_out([100, 10, 50], [3, 1, 2], 240)
    assert t[1] == 20 and np.isclose(sum(t), 240) and all(a <= 2 * b + 1e-9 for a, b in zip(t, [100, 10, 50], strict=True))
    assert mixing.share_out([0, 0], [1, 1], 0) == [0, 0] and mixing.share_out([], [], 0) == []


def test_permutation():
    for n in (1, 2, 3, 10, 257):
        p = mixing.permuted(np.arange(n), n, 12345 + n)
        assert sorted(p.tolist()) == list(range(n))
        assert all(mixing._place_of(int(p[i]), n, 12345 + n) == i for i in range(n))
    assert mixing.permuted(np.arange(1000), 1000, 1).tolist() != mixing.permuted(np.arange(1000), 1000, 2).tolist()


def test_draws():
    """Each shard's draws are found alone, fill the shard, and add up to the sources' slots; their spread is about that of multinomial draws."""
    slots = np.array([5000, 0, 1203, 7])
    whole = list(mixing.draw_shards(slots, 100, 3, 0, 10**9))
    assert [j for j, _, _ in whole] == list(range(63)) and sum(own for _, _, own in whole).tolist() == slots.tolist()
    assert [int(own.sum()) for _, _, own in whole] == [100] * 62 + [10]
    at = np.zeros(4, int)
    for j, before, own in whole:
        assert before.tolist() == at.tolist()
        at += own
        ((k, b, o),) = mixing.draw_shards(slots, 100, 3, j, j + 1)
        assert k == j and b.tolist() == before.tolist() and o.tolist() == own.tolist()
    share = slots / slots.sum()
    assert 0.6 < np.var([own[0] for _, _, own in whole[:-1]]) / (100 * share[0] * (1 - share[0])) < 1.6
    great = np.array([3 * 10**9, 10**9])
    first = mixing._halved(great, 2 * 10**9, np.random.default_rng(1))
    assert first.sum() == 2 * 10**9 and abs(first[0] - 1.5e9) < 1e6


def plain_mix(rows, texts, block, shard, seed=20):
    """A plain mix of small tables: (rid, shard, src, nth, epoch, block, at, words) of all spans, from the places of the rows."""
    sources: dict = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.src, r.start)):
        words = WORD.findall(texts[r.rid] or "")
        assert r.size == len(words) and r.start == len(sources[r.src]), "gapless"
        sources[r.src] += [(r.rid, i) for i in range(len(words))]
    out, slots, plan = collections.Counter(), [], []
    n = max(sources, default=-1) + 1
    for s in range(n):
        target = next(r.target for r in rows if r.src == s)
        words, left, takes = sources[s], round(target), []
        nb, e = -(-len(words) // block), 0
        while left > 0 and nb:
            for i in range(nb):
                b = int(mixing.permuted(np.array([i]), nb, mixing._key(seed, s, e))[0])
                part = words[b * block : (b + 1) * block][:left]
                if part:
                    takes.append((e, b, part))
                    left -= len(part)
            e += 1
        plan.append(takes)
        slots.append(len(takes))
    for j, before, own in mixing.draw_shards(np.array(slots, np.int64), shard, seed, 0, 1 << 40) if n else ():
        for s in range(n):
            for nth in range(own[s]):
                e, b, part = plan[s][before[s] + nth]
                spans = collections.defaultdict(list)
                for rid, i in part:
                    spans[rid].append(i)
                for rid, i in spans.items():
                    out[rid, j, s, nth, e, b, i[0], len(i)] += 1
    return out


def check_mix(rows, spans, block):
    words = collections.Counter()
    for s in spans:
        words[s.rid] += s.words
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert words[r.rid] <= 2 * r.size
        x = per[r.src]
        x[0], x[1], x[2] = x[0] + r.size, x[1] + words[r.rid], r.target
    for size, taken, target in per.values():
        assert abs(taken - target) <= 1
    for (src, _, _, _), v in collections.Counter((s.src, s.epoch, s.block, s.rid) for s in spans).items():
        assert v == 1, src
    slots = {(s.shard, s.src, s.nth) for s in spans}
    assert len(slots) <= sum(-(-int(x[2] + 1) // block) + 2 for x in per.values()) + sum(-(-x[0] // block) for x in per.values())


@tables
@pytest.mark.parametrize(("block", "shard"), [(512, 4096), (37, 50)])
def test_mix(spark, block, shard):
    docs = documents(spark).select("doc_id", "source", "text")
    rows, spans, texts = mixing.mix(docs, block=block, shard_slots=shard, with_texts=True)
    texts, rows, spans = {r.rid: r.doc.text for r in texts.collect()}, rows.collect(), spans.collect()
    check_mix(rows, spans, block)
    assert collections.Counter(tuple(s) for s in spans) == plain_mix(rows, texts, block, shard)
    sizes = [sum(r.size for r in rows if r.src == s) for s in range(max(r.src for r in rows) + 1)]
    want = mixing.share_out(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
    assert all(np.isclose(r.target, want[r.src]) and r.source_size == sizes[r.src] for r in rows)
    assert [r.doc.source for r in sorted(rows, key=lambda r: r.src)] == sorted((r.doc.source for r in rows), key=lambda s: (s is None, (s or "").encode()))


@tables
def test_mix_does_not_depend_on_partitions(spark):
    """Nor on repeated rows, whose number in a piece is bounded."""
    docs = documents(spark).select("doc_id", "source", "text")
    docs = docs.unionByName(docs.limit(1).crossJoin(spark.range(300).select()))
    of = []
    for parts in (1, 5):
        rows, spans = mixing.mix(docs.repartition(parts), block=64, shard_slots=100)
        taken = spans.groupBy("rid").agg(F.sum("words").alias("taken"))
        of.append(collections.Counter((r.doc.doc_id, r.size, r.taken) for r in rows.join(taken, "rid", "left").collect()))
    assert of[0] == of[1]


def test_running_before_with_repeated_rows(spark):
    d = spark.range(3000).select(F.lit(0).alias("g"), F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("x"), "id", (F.col("id") % 3).alias("v"))
    got = common.running_before(d, "g", ["x"], F.col("v"), "before", 3000, per=50, tie="id").collect()
    at, order = 0, sorted(got, key=lambda r: (r.before, r.v > 0))
    zero = [r for r in order if not r.v]
    for r in (r for r in order if r.v):
        assert r.before == at
        at += r.v
    assert at == 3000 and len(zero) == 1000


def test_lookup(spark):
    d = spark.range(9000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = d.select("k").distinct().select("k", (F.col("k") * 2).alias("v"))
    got = common.lookup(d, table, "k", 9000, hot=10).collect()
    assert len(got) == 9000 and all(r.v == 2 * r.k for r in got) and len({r.id for r in got}) == 9000


def test_mix_awkward(spark):
    """With columns whose names are the operator's own."""
    docs = awkward(spark)
    for i, c in enumerate(("target", "src", "size", "start", "rid", "doc", "_s", "_h", "words", "a.b")):
        docs = docs.withColumn(c, F.lit(i))
    rows, spans, texts = mixing.mix(docs, block=16, shard_slots=20, with_texts=True)
    out = mixing.mixed_texts(rows, spans, texts)
    assert out.columns == docs.columns and {r["a.b"] for r in out.select("`a.b`").collect()} == {9}
    out, rows, spans = out.collect(), rows.collect(), spans.collect()
    check_mix(rows, spans, 16)
    assert len(rows) == 14 and sum(len(WORD.findall(r.text)) for r in out) == sum(s.words for s in spans)
    assert mixing.mix(empty(spark))[0].count() == 0 and mixing.mix(empty(spark))[1].count() == 0


def test_mixed_texts_are_parts_of_texts(spark):
    d = spark.createDataFrame([(i, " ".join(f"{i}.{j}" for j in range(i * 7)), None, "ab"[i % 2], 1) for i in range(30)], DOCS)
    for r in mixing.mixed_texts(*mixing.mix(d, block=8, shard_slots=16, with_texts=True)).collect():
        at = [int(w.split(".")[1]) for w in r.text.split(" ")]
        assert at == sorted(at) and all(w.startswith(f"{r.doc_id}.") for w in r.text.split(" "))
