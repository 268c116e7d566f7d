"""Near-duplicate documents by MinHash with tensored banding.

A few small collections of minhashes are drawn; each pair of collections makes one table, whose key joins their two values. So m
collections of w minhashes, m * w in all, serve m * (m - 1) / 2 tables of keys of 2 * w minhashes. Documents that share a key are
candidates; links are confirmed on the documents' full sets of shingles.

Documents of equal sets are one class from the start. Candidates are then taken in three steps, each followed by the components of the
links found so far: (1) each class with the member of its buckets that it meets most often; (2) in buckets that still hold several
components, each class with the nearest class of another component; (3) all pairs of the components that are left in a
bucket. In (2) and (3) fingerprints of the sets settle most pairs: the sets' symmetric difference has at least as many elements as
their fingerprints have different bits. Pairs of classes that are in one component already are never enumerated."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, lookup, spread, stash, unstash
from .vectors import grouped, in_cells
from .words import LOWER, Hasher, buffer, chunks, mixed, words

_PRINT = 4096


def shingles(texts: list[bytes], k: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Texts -> the sorted distinct 64-bit hashes of each text's k-word shingles (of all its words as one, if there are fewer than k),
    one text after the other; and where each text's begin (and where the last's end)."""
    raw, begin = buffer(texts)
    low = LOWER[raw]
    start, end = words(raw)
    word = hasher.spans(hasher.sums(low), start, end)
    first = np.searchsorted(start, begin)  # each text's first word
    n = np.diff(first)
    size = np.minimum(n, k)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.flatnonzero(np.arange(len(word)) - first[doc] <= (n - size)[doc])  # words that begin a shingle
    doc = doc[at]
    own = size[doc]
    out = own.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            more = mixed(out * np.uint64(0xD6E8FEB86659FD93) + word[np.minimum(at + i, max(len(word) - 1, 0))])
            out = more if (own == k).all() else np.where(i < own, more, out)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def halves(shingle: np.ndarray, begin: np.ndarray, m: int, w: int) -> np.ndarray:
    """Sets that aren't empty, one after the other, and where each begins -> m values of 32 bits for each, the i-th made of minhashes
    i * w to (i + 1) * w - 1."""
    a, b = _seeds(m * w)
    out = np.zeros((m, len(begin)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(m * w):
            least = np.minimum.reduceat((shingle * a[i]) ^ ((shingle + b[i]) >> np.uint64(29)), begin)
            out[i // w] = mixed(out[i // w] * np.uint64(31) + least + np.uint64(i % w + 1))
    return (out.T >> np.uint64(32)).astype(np.uint32)


def digests(shingle: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set that tell sets apart."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mixed(shingle), begin).astype(np.int64), np.bitwise_xor.reduceat(mixed(shingle + np.uint64(99)), begin).astype(np.int64)


def _chunked(texts: pa.Array, k: int, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(first, end, shingles, where each text's begin, which texts have any, digests of all) for ranges of a batch's texts."""
    for lo, _, coded in chunks(texts):
        hi = lo + len(coded)
        s, begin = shingles(coded, k, hasher)
        some = np.flatnonzero(np.diff(begin))
        sums = np.zeros((2, hi - lo), np.int64)
        if len(some):
            sums[:, some] = digests(s, begin[some])
        yield lo, hi, s, begin, some, (sums[0], sums[1])


def _sign(k: int, m: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, s, begin, some, (h1, h2) in _chunked(batch.column("text"), k, hasher):
                half = [b""] * (hi - lo)
                for i, x in zip(some, halves(s, begin[some], m, w) if len(some) else (), strict=True):
                    half[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi], pa.array(np.diff(begin)), pa.array(h1), pa.array(h2), pa.array(half, pa.binary())], ["key", "n", "h1", "h2", "half"])

    return run


def _entries(m: int):
    pairs_i, pairs_j = np.triu_indices(m, 1)
    table = np.arange(len(pairs_i), dtype=np.uint64) << np.uint64(48)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                x = np.frombuffer(b"".join(b.column("half").to_pylist()), np.uint32).reshape(b.num_rows, m)
                with np.errstate(over="ignore"):
                    keys = mixed(mixed(table + x[:, pairs_i]) ^ (x[:, pairs_j].astype(np.uint64) << np.uint64(20)))
                cid = np.repeat(b.column("cid").to_numpy(), len(table))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).ravel()), pa.array(cid), pa.array(np.tile(np.arange(len(table), dtype=np.int16), b.num_rows))], ["key", "cid", "table"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, s, begin, _, (h1, h2) in _chunked(batch.column("text"), k, hasher):
                doc = np.repeat(np.arange(hi - lo), np.diff(begin))
                for a in range(0, hi - lo, 256):  # bits of 256 texts at once
                    b = min(a + 256, hi - lo)
                    mine = slice(begin[a], begin[b])
                    bits = np.bincount((doc[mine] - a) * _PRINT + (s[mine] >> np.uint64(52)).astype(np.int64), minlength=(b - a) * _PRINT) & 1
                    prints = np.packbits(bits.astype(np.uint8).reshape(b - a, _PRINT), axis=1)
                    cols = [pa.array(np.diff(begin)[a:b]), pa.array(h1[a:b]), pa.array(h2[a:b]), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array([s[x:y].tobytes() for x, y in zip(begin[a:b], begin[a + 1 : b + 1], strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["n", "h1", "h2", "print", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_u"), b.column("set_v"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.searchsorted(y, x)
                both = int((y[np.minimum(both, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    return run


def _bits(column) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1)


def _near(percent: int, m: int, nearest: bool):
    """Cells sorted by (key, i, j) -> pairs (u, v) of different components that may be links by size and fingerprint: for each row the
    nearest, or all, each in the first table that both meet in."""
    pairs_i, pairs_j = np.triu_indices(m, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["key", "i", "j"]):
            left = t.column("left").to_numpy(zero_copy_only=False)
            cid, root, n = (t.column(c).to_numpy() for c in ("cid", "root", "n"))
            minor, table = t.column("minor").to_numpy(zero_copy_only=False), t.column("table").to_numpy()
            bits = _bits(t.column("print").combine_chunks()).astype(np.float32)
            half = np.frombuffer(b"".join(t.column("half").to_pylist()), np.uint32).reshape(len(cid), m)
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            ones = bits.sum(1)
            for lo in range(0, len(a), 256):
                p = a[lo : lo + 256]
                differ = ones[p][:, None] + ones[b][None] - 2 * (bits[p] @ bits[b].T)
                total = n[p][:, None] + n[b][None]
                # 100 both >= percent union, both = (total - differ) / 2, union = (total + differ) / 2
                may = ((100 - percent) * total >= (100 + percent) * differ) & (root[p][:, None] != root[b][None])
                may &= np.minimum(n[p][:, None], n[b][None]) * 100 >= percent * np.maximum(n[p][:, None], n[b][None])
                if nearest:
                    share = np.where(may, differ / total, 9.0)
                    best = share.argmin(1) if len(b) else np.zeros(0, int)
                    i = np.flatnonzero(may[np.arange(len(p)), best]) if len(b) else np.zeros(0, int)
                    j = best[i]
                    out = [pa.array(cid[p[i]]), pa.array(cid[b[j]]), pa.array(share[i, j].astype(np.float64))]
                else:
                    i, j = np.nonzero(may)
                    same = half[p[i]] == half[b[j]]
                    first = same.argmax(1)
                    rest = same.copy()
                    rest[np.arange(len(i)), first] = False
                    second = rest.argmax(1)
                    keep = (pairs_i[table[p[i]]] == first) & (pairs_j[table[p[i]]] == second) & ((cid[p[i]] < cid[b[j]]) | ~minor[b[j]])
                    i, j = i[keep], j[keep]
                    out = [pa.array(cid[p[i]]), pa.array(cid[b[j]]), pa.array(np.zeros(len(i)))]
                if len(i):
                    yield pa.RecordBatch.from_arrays(out, ["u", "v", "far"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = 5, percent: int = 80, m: int = 15, w: int = 3, cell: int = 1024) -> DataFrame:
    """docs(key, text) -> key, n_shingles, component_id (least key reachable by links), kept (key = component_id).

    Words are runs of other than white space (0x20, 0x09 to 0x0D), A-Z in lower case. A document's set holds its distinct shingles of
    `shingle` words, or all its words as one if there are fewer. Two documents link if 100 * intersection >= percent * union, found
    through a common key of the m * (m - 1) / 2 tables and confirmed on the full sets; at 80 % a pair has a common key with a
    probability of 0.9996, at 85 % of 0.99998. Documents without words, or null, have no set and no link. Repeated rows and copies
    are one class (rows of a null key take part only through such copies); a class, bucket or component of any size is spread over tasks. An empty table gives no rows."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), "text")
    signed = stash(texts.mapInArrow(_sign(shingle, m, w), f"key {kind}, n long, h1 long, h2 long, half binary"), "minhash")
    classes = signed.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("rep"), F.min("half").alias("half"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")

    # keys that two classes share, counted before the rows are dealt by key
    entries = classes.select("half", "cid").mapInArrow(_entries(m), "key long, cid long, table short")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = stash(entries.join(shared, "key"), "minhash-buckets")
    members = buckets.select("cid").distinct().join(classes, "cid")
    chosen = texts.join(members.select(F.col("rep").alias("key")).distinct(), "key", "left_semi").select("text")
    sets = chosen.mapInArrow(_sets(shingle), "n long, h1 long, h2 long, print binary, set binary")
    sets = stash(sets.join(members.select("h1", "h2", "n", "cid", "half"), ["h1", "h2", "n"]).drop("h1", "h2").dropDuplicates(["cid"]), "minhash-sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        one = sets.select(F.col("cid").alias("u"), F.col("set").alias("set_u"))
        two = sets.select(F.col("cid").alias("v"), F.col("set").alias("set_v"))
        return stash(pairs.join(one, "u").join(two, "v").mapInArrow(_confirm(percent), "u long, v long"), name)

    # (1) a bucket's least class is its centre; a bucket over the cell size has centres for its parts, and a centre of these
    part = F.when(F.col("c") > cell, F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / cell))).otherwise(0).cast("int")
    centred = buckets.withColumn("part", part).withColumn("low", F.min("cid").over(Window.partitionBy("key", "part")))
    stars = centred.filter("cid <> low").select(F.col("cid").alias("u"), F.col("low").alias("v"))
    tops = centred.filter(F.col("c") > cell).select("key", "low").distinct()
    tops = tops.withColumn("top", F.min("low").over(Window.partitionBy("key"))).filter("low <> top").select(F.col("low").alias("u"), F.col("top").alias("v"))
    met = stars.unionByName(tops).groupBy("u", "v").agg(F.count(F.lit(1)).alias("times"))
    pairs = met.groupBy("u").agg(F.max(F.struct("times", (-F.col("v")).alias("v"))).alias("x")).select("u", (-F.col("x.v")).alias("v"))
    links = confirmed(pairs, "minhash-links")
    roots = connected_components(links, "minhash-cc")

    for nearest in (True, False):  # (2), (3)
        at = buckets.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        by = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
        several = by.groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        several = several.select("key", F.col("x.root").alias("major"), F.ceil(F.col("all") / cell).cast("int").alias("nj"), F.ceil((F.col("all") - F.col("x.k")) / cell).cast("int").alias("ni"))
        at = at.join(several, "key").withColumn("minor", F.col("root") != F.col("major"))
        own = lambda n: F.pmod(F.xxhash64("cid", F.lit(3)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = at.filter("minor").select("key", own("ni").alias("i"), each("nj").alias("j"), "cid", "root", "table", "minor", F.lit(True).alias("left"))
        right = at.select("key", each("ni").alias("i"), own("nj").alias("j"), "cid", "root", "table", "minor", F.lit(False).alias("left"))
        dealt = stash(left.unionByName(right), "minhash-cells")
        rows = dealt.count()
        if not rows:
            break
        cells = dealt.join(sets.select("cid", "n", "half", "print"), "cid")
        near = in_cells(cells, ["key", "i", "j"], max(spread(rows, 20_000), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_near(percent, m, nearest), "u long, v long, far double")
        near = near.groupBy("u").agg(F.min(F.struct("far", "v")).alias("x")).select("u", F.col("x.v").alias("v")) if nearest else near.select("u", "v").distinct()
        links = confirmed(near, "minhash-links")
        unstash(dealt)
        if links.isEmpty():
            if nearest:
                continue
            break
        # new links join components: only their roots go through the rounds again
        of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        lifted = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
        up = connected_components(lifted, "minhash-cc")
        raised = lookup(roots, up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", roots.count(), "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = stash(raised.unionByName(up.join(roots.select("node"), "node", "left_anti")), "minhash-roots")

    unstash(buckets, sets, links)
    named = classes.select("cid", "h1", "h2", "n", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = stash(named, "minhash-named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = lookup(named, least, "root", named.count()).select("h1", "h2", "n", "component_id")
    out = signed.select("key", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
