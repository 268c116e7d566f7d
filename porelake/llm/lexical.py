"""Ranked lexical search in dual-sorted wavelet trees.

A shard is a run of documents of one task, numbered by doc_id. Its postings are in one sequence, term by term, a term's by falling impact;
the sequence is held as a wavelet tree over the document numbers. So a term's postings are a range of the root, and a range of
each node below, in which they are still by falling impact: the first has the highest of all documents under the node. A query
starts with its terms' ranges at the root. The node of the highest bound, the sum of its terms' first impacts times their weights, is
opened next, and its ranges go on into both children by two ranks each; at a leaf, the bound is the document's score. The search ends
when as many leaves have come up as are asked for, or when no bound reaches what the task has found in earlier shards."""

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stash, unstash
from .words import chunks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: Column) -> Column:
    """A text's terms, with repeats: runs of ASCII digits and letters and of other characters than ASCII's; only A-Z are lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(TERM), F.lit(0))


class _Shard:
    """Documents and their postings, until there are enough."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.size, self.doc, self.term, self.tf, self.postings = [], [], [], [], [], 0

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        flat, sizes, number = [], [], self.number
        for t in texts:
            words = t.translate(_FOLD).split()
            sizes.append(len(words))
            flat += [number[w] for w in words]
        doc = np.repeat(np.arange(len(self.ids), len(self.ids) + len(texts)), sizes)
        key, tf = np.unique(doc << 32 | np.array(flat, np.int64), return_counts=True)
        self.doc.append(key >> 32)
        self.term.append(key & 0xFFFFFFFF)
        self.tf.append(tf)
        self.ids += ids
        self.size += sizes
        self.postings += len(key)

    def row(self, part: int, nth: int) -> pa.RecordBatch:
        order = np.array(sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0)), np.int64)  # by doc_id, null last
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        doc, term, tf = at[np.concatenate(self.doc)], np.concatenate(self.term), np.concatenate(self.tf)
        by = np.argsort(term << 32 | doc)
        size = np.array(self.size, np.int64)[order]
        one = lambda x, kind: pa.array([x], kind)
        columns = {
            "part": one(part, pa.int32()), "nth": one(nth, pa.int32()), "ids": one([self.ids[i] for i in order], pa.list_(pa.int64())), "docs": one(int((size > 0).sum()), pa.int64()), "words": one(int(size.sum()), pa.int64()),
            "terms": one([*self.number], pa.list_(pa.binary())).cast(pa.list_(pa.string())), "df": one(np.bincount(term, minlength=len(self.number)), pa.list_(pa.int32())),
            "sizes": one(size.tobytes(), pa.binary()), "doc": one(doc[by].astype(np.int32).tobytes(), pa.binary()), "tf": one(tf[by].astype(np.int32).tobytes(), pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


_POSTINGS = "part int, nth int, ids array<long>, docs long, words long, terms array<string>, df array<int>, sizes binary, doc binary, tf binary"


def _postings(most_docs: int, most_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for lo, texts, coded in chunks(batch.column("text"), 256, 1 << 19):
                shard.add(batch.column("doc_id")[lo : lo + len(texts)].to_pylist(), coded)
                if shard.postings >= most_postings or len(shard.ids) > most_docs - 256:
                    yield shard.row(part, nth)
                    nth, shard = nth + 1, _Shard()
        if shard.ids:
            yield shard.row(part, nth)

    return run


def impacts(tf: np.ndarray, doc: np.ndarray, sizes: np.ndarray, n: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) of postings, m = 75 + (25 size n) div length for a document of `size` terms."""
    distinct, at = np.unique(sizes, return_inverse=True)
    m = np.array([75 + 25 * int(s) * n // max(length, 1) for s in distinct], np.int64)[at]
    return 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])


def _levels(n: int) -> int:
    return max(1, (n - 1).bit_length())


def wavelet(seq: np.ndarray, levels: int) -> np.ndarray:
    """Document numbers in the root's order -> uint8[levels, n] of bits: at a level, nodes follow each other by their documents, and the
    bit of a posting says to which child it goes."""
    out = np.empty((levels, len(seq)), np.uint8)
    for level in range(levels):
        down = levels - 1 - level
        here = seq if not level else seq[np.argsort((seq >> (down + 1)).astype(np.uint16), kind="stable")]
        out[level] = here >> down & 1
    return out


def _tree(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                doc, tf, sizes = (np.frombuffer(b.column(c)[0].as_py(), k) for c, k in (("doc", np.int32), ("tf", np.int32), ("sizes", np.int64)))
                df = np.asarray(b.column("df")[0].values, np.int64)
                impact = impacts(tf.astype(np.int64), doc, sizes, n, length)
                by = np.argsort(np.repeat(np.arange(len(df)), df) << 20 | (1_000_000 - impact), kind="stable")
                bits = np.packbits(wavelet(doc[by], _levels(len(sizes))), axis=1)
                tree = [pa.array([x.tobytes()], pa.binary()) for x in (impact[by].astype(np.int32), bits, np.bincount(doc, minlength=len(sizes)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "nth", "ids", "docs", "words", "terms", "df")), *tree], ["part", "nth", "ids", "docs", "words", "terms", "df", "impact", "bits", "per_doc"])

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", most_docs: int = 16_384, most_postings: int = 1 << 20) -> DataFrame:
    """docs(doc_id of an integer type, text) -> a row for each shard, in the shared folder: part and nth (its place), ids (by which
    documents are numbered), docs (those with a term) and words (their terms with repeats), terms and df (its dictionary; postings are in that order),
    impact, bits, per_doc (the tree).

    Every row is indexed, repeated rows each; null and empty texts have no postings. A shard ends with the chunk of texts (half a megabyte,
    or one longer text) that takes it to most_postings, so that a task's memory is bounded; nothing is shuffled. At most 65,536 documents are a shard. An
    empty table has no shards; other columns are not read."""
    if not 256 < most_docs <= 1 << 16:
        raise ValueError("most_docs: more than 256, at most 65536")
    pairs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), "text")
    postings = stash(pairs.mapInArrow(_postings(most_docs, most_postings), _POSTINGS), "lexical-postings")
    n, length = postings.agg(F.sum("docs"), F.sum("words")).first()
    kind = "part int, nth int, ids array<long>, docs long, words long, terms array<string>, df array<int>, impact binary, bits binary, per_doc binary"
    out = stash(postings.mapInArrow(_tree(n or 0, length or 0), kind), "lexical-index")
    unstash(postings)
    return out


class Tree:
    """A shard's tree, ready for search: ranks and impacts of all levels."""

    def __init__(self, impact: np.ndarray, bits: bytes, per_doc: np.ndarray, df: np.ndarray):
        self.levels, n = _levels(len(per_doc)), len(impact)
        packed = np.frombuffer(bits, np.uint8).reshape(self.levels, -1)
        self.start = np.zeros((1 << self.levels) + 1, np.int32)  # of each document's postings, in the order of documents
        self.start[1 : len(per_doc) + 1] = np.cumsum(per_doc)
        self.start[len(per_doc) + 1 :] = n
        self.term = np.concatenate([[0], np.cumsum(df)])
        self.zeros = np.zeros((self.levels, n + 1), np.int32)  # to the left
        self.impact = np.empty((self.levels + 1, n), np.int32)
        self.impact[0] = impact
        for level in range(self.levels):
            bit = np.unpackbits(packed[level], count=n)
            np.cumsum(1 - bit, out=self.zeros[level, 1:])
            # where the children of each node begin: left ones at the node's start, right ones behind them
            width = 1 << (self.levels - level)
            begin = self.start[:-1:width]
            node = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
            left = self.zeros[level, :-1] - self.zeros[level, begin][node]
            to = np.where(bit == 0, begin[node] + left, self.start[width // 2 :: width][node] + np.arange(n) - begin[node] - left)
            self.impact[level + 1, to] = self.impact[level]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray, at_once: int = 8) -> list[list[tuple[int, int]]]:
        """Queries (terms' numbers, their weights) -> (score, document number) of each one's k best, by falling score, then document;
        none of a score below least[query]. Each round opens up to at_once nodes of every query."""
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        heaps: list[list] = []
        for q, (t, w) in enumerate(queries):
            a, b = self.term[t], self.term[t + 1]
            keep = b > a
            a, b, w = a[keep], b[keep], w[keep]
            bound = int((self.impact[0, a].astype(np.int64) * w).sum())
            # (-bound, first document, level, ranges and weights), the first three of which tell nodes apart; of equal bounds the smaller document comes first
            heaps.append([(-bound, 0, 0, a, b, w)] if bound and bound >= least[q] else [])
        live = [q for q, h in enumerate(heaps) if h]
        while live:
            opened, of, still = [], [], []
            for q in live:
                heap, n = heaps[q], 0
                while heap and n < at_once and len(best[q]) < k:
                    if heap[0][2] == self.levels:
                        if n:
                            break  # an opened node may hold a better document
                        bound, doc, *_ = heappop(heap)
                        best[q].append((-bound, doc))
                    else:
                        opened.append(heappop(heap))
                        of.append(q)
                        n += 1
                if n:
                    still.append(q)
            live = still
            if opened:
                self._open(opened, of, heaps, least)
        return best

    def _open(self, opened: list, of: list[int], heaps: list[list], least: np.ndarray) -> None:
        count = np.array([len(o[3]) for o in opened])
        node = np.repeat(np.arange(len(opened)), count)
        a, b, w = (np.concatenate([o[i] for o in opened]) for i in (3, 4, 5))
        first, level = np.array([o[1] for o in opened]), np.array([o[2] for o in opened])
        half = 1 << (self.levels - level - 1)
        begin, middle = self.start[first].astype(np.int64), self.start[first + half].astype(np.int64)
        at, l0 = begin[node], level[node]
        base = self.zeros[level, begin].astype(np.int64)[node]
        za, zb = self.zeros[l0, a] - base, self.zeros[l0, b] - base
        right = middle[node] - at
        a, b = np.concatenate([at + za, right + a - za]), np.concatenate([at + zb, right + b - zb])
        keep = np.flatnonzero(b > a)
        child = np.concatenate([node, node + len(opened)])[keep]
        a, b, w = a[keep], b[keep], np.concatenate([w, w])[keep]
        gain = self.impact[np.concatenate([l0, l0])[keep] + 1, a].astype(np.int64) * w
        begins = np.flatnonzero(np.diff(child, prepend=-1))
        if not len(begins):
            return
        bound, which = np.add.reduceat(gain, begins), child[begins]
        query = np.array(of)[which % len(opened)]
        good = np.flatnonzero((bound > 0) & (bound >= least[query]))
        ends = np.append(begins[1:], len(child))
        doc = (first[which % len(opened)] + np.where(which >= len(opened), half[which % len(opened)], 0)).tolist()
        deep, bound, query, begins, ends = (level[which % len(opened)] + 1).tolist(), bound.tolist(), query.tolist(), begins.tolist(), ends.tolist()
        for i in good.tolist():
            s = slice(begins[i], ends[i])
            heappush(heaps[query[i]], (-bound[i], doc[i], deep[i], a[s], b[s], w[s]))


def _search(block, k: int):
    """block: broadcast (items, terms, item numbers, weights), sorted by item number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, names, number, weight = block.value
        names = pa.array(names, pa.string())
        cuts = np.searchsorted(number, np.arange(len(items) + 1))
        held: list[list[tuple]] = [[] for _ in items]
        least = np.ones(len(items), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                at = pc.index_in(names, value_set=b.column("terms")[0].values).fill_null(-1).to_numpy()
                there = at >= 0
                if not there.any():
                    continue
                impact, per_doc = (np.frombuffer(b.column(c)[0].as_py(), np.int32) for c in ("impact", "per_doc"))
                tree = Tree(impact, b.column("bits")[0].as_py(), per_doc, np.asarray(b.column("df")[0].values, np.int64))
                queries = [(at[x:y][there[x:y]], weight[x:y][there[x:y]]) for x, y in zip(cuts, cuts[1:], strict=False)]
                ids = b.column("ids")[0].values
                for q, found in enumerate(tree.search(queries, k, least)):
                    if found:
                        new = ids.take(pa.array([d for _, d in found])).to_pylist()
                        held[q] = sorted([*held[q], *((-s, d is None, d or 0) for (s, _), d in zip(found, new, strict=True))])[:k]
                        if len(held[q]) == k:
                            least[q] = -held[q][-1][0]
        out = [(item, None if none else d, -s) for item, rows in zip(items, held, strict=True) for s, none, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, item_id: str = "item_id", block: int = 200_000) -> DataFrame:
    """build_index(), queries(item_id of an integer type, text) -> item_id, rank (from 1), doc_id, score: each item's k documents of the highest
    scores above 0 (all, if fewer), equal scores by ascending doc_id, a null one last.

    With N documents that have a term, df of them a query's term, the term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), once for each of
    its occurrences in the query; the score is the sum of the weights times the impacts. Rows of one item_id are one query, but repeated
    ones count once; items without terms, or without a document, have no rows. Other columns are not read.

    Queries go to the executors in blocks of about `block` terms, which are read by the driver and broadcast one after the other; each
    block takes one pass over the index. A task keeps k rows a query. Scores must stay below 2 ** 63."""
    spark = index.sparkSession
    asked = queries.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), "text").distinct()
    asked = stash(asked.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "lexical-asked")
    n = index.agg(F.sum("docs")).first()[0] or 0
    spoken = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    spoken = spoken.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n + 2) / (F.col("df") * F.lit(2.0) + 1))).cast("long") * F.col("times")
    weighed = asked.join(spoken, "term").select("item_id", "term", weight.alias("weight")).filter("weight > 0")
    weighed = stash(weighed, "lexical-queries")
    blocks = spread(weighed.count(), block)
    found = []
    for i in range(blocks):
        part = weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id", "term").toArrow()
        coded = part.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        number = coded.indices.to_numpy()
        sent = spark.sparkContext.broadcast((coded.dictionary.to_pylist(), part.column("term").to_pylist(), number, part.column("weight").to_numpy()))
        tops = stash(index.mapInArrow(_search(sent, k), "item_id long, doc_id long, score long"), "lexical-tops")
        sent.unpersist()
        found.append(tops)
    unstash(asked, weighed)
    every = spark.read.schema(found[0].schema).parquet(*(t._stash_path for t in found))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
