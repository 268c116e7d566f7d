"""Ranked lexical search against a plain scan of all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.llm import lexical, queries

from .test_llm import SF, awkward, documents, empty, tables

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=20):
    """(doc_id, text), (item_id, text) -> (item_id, rank, doc_id, score)."""
    each = [(d, collections.Counter(words(t))) for d, t in docs]
    n, length = sum(1 for _, c in each if c), sum(sum(c.values()) for _, c in each)
    df = collections.Counter(t for _, c in each for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in {*items}:
        asked[i].update(words(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in each:
            m = 75 + 25 * sum(c.values()) * n // length if c else 0
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def some(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "ÉTÉ", "x1", "世界"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([3, 12, 44])]) for _ in range(rng.choice([0, 1, 5, 60])))
    return [(i * 7 % 1009, text()) for i in range(n)]


def test_bits_lead_to_every_document():
    rng = np.random.default_rng(1)
    for docs in (1, 2, 3, 17, 256):
        df = rng.integers(0, docs + 1, 12)
        seq = np.concatenate([rng.permutation(docs)[:n] for n in df]).astype(np.int32)
        impact = np.concatenate([np.sort(rng.integers(1, 9, n))[::-1] for n in df]).astype(np.int32)
        levels = lexical._levels(docs)
        tree = lexical.Tree(impact, np.packbits(lexical.wavelet(seq, levels), axis=1).tobytes(), np.bincount(seq, minlength=docs).astype(np.int32), df)
        by_doc = sorted(range(len(seq)), key=lambda i: (seq[i], i))
        assert tree.impact[levels].tolist() == impact[by_doc].tolist()
        for k, at_once in ((1, 1), (5, 1), (5, 3), (1000, 8)):
            asked = [(np.array(sorted(rng.choice(12, m, replace=False))), rng.integers(1, 4, m)) for m in (1, 4, 12)]
            got = tree.search(asked, k, np.ones(3, np.int64), at_once)
            for (t, w), found in zip(asked, got, strict=True):
                score = np.zeros(docs, np.int64)
                for x, y in zip(t, w, strict=True):
                    at = slice(tree.term[x], tree.term[x + 1])
                    score[seq[at]] += impact[at] * y
                want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s)[:k]
                assert found == [(-s, d) for s, d in want]


def test_few_nodes_are_opened():
    docs = 4096
    seq, impact = np.arange(docs, dtype=np.int32), np.full(docs, 5, np.int32)
    tree = lexical.Tree(impact, np.packbits(lexical.wavelet(seq, 12), axis=1).tobytes(), np.ones(docs, np.int32), np.array([docs]))
    opened = []
    real = tree._open
    tree._open = lambda o, *a: (opened.extend(o), real(o, *a))
    assert tree.search([(np.array([0]), np.array([2]))], 3, np.ones(1, np.int64), 1) == [[(10, 0), (10, 1), (10, 2)]]
    assert len(opened) < 30
    assert tree.search([(np.array([0]), np.array([2]))], 3, np.array([11]), 1) == [[]]


@pytest.mark.parametrize("most_docs,most_postings,block", [(16_384, 1 << 20, 200_000), (257, 300, 25)])
def test_against_a_plain_scan(spark, most_docs, most_postings, block):
    docs, items = some(1, 700) + [(5000 + i, "the w1 w2 copy") for i in range(300)], [(i, t) for i, t in some(2, 30)] + [(1, "w1 w2"), (1, "w1 w2"), (1, "copy"), (None, "w3 w3"), (70, None), (71, "absent"), (72, "COPY the été ÉTÉ")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit("clash")).repartition(3)
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(0))
    index = lexical.build_index(d, most_docs=most_docs, most_postings=most_postings)
    assert most_postings > 300 or index.count() > 3
    assert rows_of(lexical.search(index, q, 7, block=block)) == plain(docs, items, 7)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "the same text of a few words here"), (2, "word3 word5 one naïve 世界"), (3, ""), (4, "no id at all, a id")]
    q = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.search(lexical.build_index(docs), q)) == plain(rows, items)
    assert rows_of(lexical.search(lexical.build_index(empty(spark)), q)) == [] == rows_of(lexical.search(lexical.build_index(docs), q.limit(0)))
    with pytest.raises(ValueError, match="most_docs"):
        lexical.build_index(docs, most_docs=1 << 17)


@tables
def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_wavelet_search"](spark, SF)) == plain(docs, items)
