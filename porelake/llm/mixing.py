"""Mixing sources to target weights.

Each source's words, its documents one after the other, are cut into blocks of a fixed length. The output is a list of shards of
slots; a shard's number of slots from each source is a multinomial draw, and the i-th slot of a source takes block perm(i) of
it, perm being a pseudorandom permutation of the source's blocks. Slots and blocks are then joined by (source, block).

All shards' draws add up to the sources' slots. Multinomial draws under that condition are hypergeometric; they are drawn by halving
the list of shards again and again, so that a task finds those of its own shards without the others'."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, n_words, running_before, stash, unstash

_WORD = re.compile(WORD)


def share_out(sizes: list[int], weights: list[float], budget: float, most: float = 2.0) -> list[float]:
    """Targets: budget shared by weight; none above `most` times its size, the excess shared again by weight among the others."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: int, key: int, rounds: int = 40) -> np.ndarray:
    """i in 0..n-1 -> its image under a permutation of 0..n-1 chosen by key. Each round swaps x and k - x (mod n) or not, by a hash of
    the larger: a permutation for any n, found for each index alone."""
    if n <= 1:
        return np.zeros(len(i), np.int64)
    x, n64 = i.astype(np.uint64), np.uint64(n)
    with np.errstate(over="ignore"):
        for r in range(rounds):
            salt = _mixed(np.array([(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)], np.uint64))[0]
            y = (salt % n64 + n64 - x) % n64
            top = np.maximum(x, y)
            x = np.where(_mixed(top ^ salt) & np.uint64(1 << 20), y, x)
    return x.astype(np.int64)


def plan_slots(sizes: list[int], targets: list[float], block: int, seed: int) -> list[dict]:
    """For each source: blocks, slots, last_take (words of its last slot).

    A source takes round(target) words: whole rounds through all its blocks, then whole blocks in permuted order and part of one
    more."""
    plan = []
    for s, (size, target) in enumerate(zip(sizes, targets, strict=True)):
        want, nb = min(round(target), 2 * size), -(-size // block)
        if not want:
            plan.append({"blocks": nb, "slots": 0, "last_take": 0})
            continue
        rounds, rest = divmod(want, size)
        slots, last = rounds * nb, block
        if rest:  # how many blocks of the next round it takes; the short one shifts the count by one at most
            short, place = size - (nb - 1) * block, _place_of(nb - 1, nb, _key(seed, s, rounds))
            words = lambda i: i * block - (block - short) * (place < i)
            k = max(i for i in range(max(0, rest // block - 1), min(nb, rest // block + 2) + 1) if i <= nb and words(i) <= rest)
            slots, last = slots + k + (rest > words(k)), rest - words(k) or block
        plan.append({"blocks": nb, "slots": slots, "last_take": last})
    return plan


def _halved(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `take` slots come from each source, of which `left` are to be given: a multivariate hypergeometric draw, from 10 ** 9 slots
    on by normal draws of the same variance."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, n in enumerate(left.tolist()):
        if rest < 10**9:
            x = int(rng.hypergeometric(n, rest - n, take)) if take else 0
        else:
            p, among = n / rest, max(rest - 1, 1)
            x = round(rng.normal(take * p, np.sqrt(take * p * (1 - p) * ((rest - take) / among))))
        x = min(max(x, take - (rest - n), 0), n, take)
        out[s], take, rest = x, take - x, rest - n
    return out


def draw_shards(slots: np.ndarray, shard_slots: int, seed: int, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, the slots of each source before it, its slots of each source) for shards lo .. hi - 1 of all. All shards but the last
    have shard_slots slots."""
    total = int(slots.sum())

    def down(a: int, b: int, before: np.ndarray, own: np.ndarray):
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, before, own
            return
        mid = (a + b) // 2
        first = _halved(own, min(mid * shard_slots, total) - a * shard_slots, np.random.default_rng([seed, a, b]))
        yield from down(a, mid, before, first)
        yield from down(mid, b, before + first, own - first)

    yield from down(0, -(-total // shard_slots), np.zeros_like(slots), slots)


def _key(seed: int, source: int, round_: int) -> int:
    return (seed * 1_000_003 + source) * 64 + round_


def _place_of(block: int, n: int, key: int, rounds: int = 40) -> int:
    """The index that permuted() maps to block: the rounds undo themselves, last first."""
    if n <= 1:
        return 0
    x = block
    for r in reversed(range(rounds)):
        salt = int(_mixed(np.array([(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)], np.uint64))[0])
        y = (salt % n - x) % n
        if int(_mixed(np.array([max(x, y) ^ salt], np.uint64))[0]) & (1 << 20):
            x = y
    return x


def _slots(plan: list[dict], block: int, shard_slots: int, seed: int):
    slots = np.array([p["slots"] for p in plan], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("id").to_numpy()  # neighbours
            for shard, before, own in draw_shards(slots, shard_slots, seed, int(shards.min()), int(shards.max()) + 1) if len(shards) else ():
                for s in np.flatnonzero(own):
                    i, nb = before[s] + np.arange(own[s]), plan[s]["blocks"]
                    at, n = np.empty(len(i), np.int64), len(i)
                    for e in np.unique(i // nb):
                        mine = i // nb == e
                        at[mine] = permuted(i[mine] % nb, nb, _key(seed, int(s), int(e)))
                    take = np.where(i == slots[s] - 1, plan[s]["last_take"], block)
                    cols = [pa.array(np.full(n, s, np.int32)), pa.array(np.full(n, shard, np.int64)), pa.array(np.arange(n)), pa.array((i // nb).astype(np.int32)), pa.array(at), pa.array(take.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["src", "shard", "nth", "epoch", "block", "take"])

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block: int = 512, shard_slots: int = 4096, seed: int = 20, with_texts: bool = False) -> tuple[DataFrame, DataFrame] | tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, source, text and others) -> (rows, spans), or (rows, spans, texts) if with_texts.

    rows: rid, doc (a struct of doc_id and source), src (index of its source), size (words), source_size, target (its source's), start
    (of its words in the source). spans: the mix: rid, shard, src, nth (slot of that source in the shard), epoch, block, at (first
    word of the document that it takes), words. texts: rid and doc (a struct of all columns of docs, whose names may be any), for
    mixed_texts().

    Sources are in order of code points, null last; they weigh `weights`, repeated; their targets share `share` times all words and
    stop at `most` (at most 2) times their size. One row for each source comes to the driver. Null texts have no words; rows with no
    words have no spans, repeated rows count each, an empty table gives no rows. A document's place in its source depends on
    its doc_id and text alone, so the mix is the same in each run, however the rows are partitioned; rows that agree in both are
    interchangeable."""
    spark = docs.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    sized = docs.select(whole).select("doc", n_words(F.col("doc.text")).alias("size"), F.xxhash64("doc.text").alias("_h"), F.col("doc.source").alias("_s"))
    if not with_texts:
        sized = sized.withColumn("doc", F.struct("doc.doc_id", "doc.source"))
    sized = stash(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    by = {r[0]: (r[1], r[2]) for r in sized.groupBy("_s").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [by[s][0] for s in names]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    plan = plan_slots(sizes, targets, block, seed)
    table = spark.createDataFrame([(s, i, sizes[i], targets[i]) for i, s in enumerate(names)] or [(None, 0, 0, 0.0)], "_n string, src int, source_size long, target double")
    table = F.broadcast(table) if len(names) <= 100_000 else table
    small = sized.select("rid", F.struct("doc.doc_id", "doc.source").alias("doc"), "size", "_h", "_s").join(table, F.col("_s").eqNullSafe(F.col("_n"))).drop("_s", "_n").withColumn("_d", F.col("doc.doc_id"))
    rows = stash(running_before(small, "src", ["_d", "_h"], F.col("size"), "start", sum(n for _, n in by.values()), tie="rid").drop("_d", "_h"), "mix-rows")
    texts = sized.select("rid", "doc") if with_texts else None
    if not with_texts:
        unstash(sized)
    shards = -(-sum(p["slots"] for p in plan) // shard_slots)
    ids = spark.range(0, shards, 1, max(1, min(-(-shards // 8), 100_000)))
    slots = ids.mapInArrow(_slots(plan, block, shard_slots, seed), "src int, shard long, nth long, epoch int, block long, take long")
    pieces = rows.filter("size > 0").select("rid", "src", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    cut = F.greatest("start", F.col("block") * block)
    # Spark takes slots for as small as the list of shards; the hint keeps it from broadcasting what grows with the data
    spans = pieces.hint("merge").join(slots.hint("merge"), ["src", "block"]).select("rid", "shard", "src", "nth", "epoch", "block", (cut - F.col("start")).alias("at"), (F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take")) - cut).alias("words"))
    spans = spans.filter("words > 0")
    return (rows, spans, texts) if with_texts else (rows, spans)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, size, parts in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for at, words in ((p["at"], p["words"]) for p in parts):
                if runs and runs[-1][1] == at:
                    runs[-1][1] += words
                else:
                    runs.append([at, at + words])
            if runs != [[0, size]]:
                ends = [m.span() for m in _WORD.finditer(text)]
                text = " ".join(text[ends[a][0] : ends[b - 1][1]] for a, b in runs)
            out.append(text)
        i = batch.schema.names.index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.string())).drop_columns(["size", "parts"])


def mixed_texts(rows: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """What mix(with_texts=True) gave -> the columns of its docs, a row for each document and round (epoch) that takes some of it: text
    is what that round takes of it, whole where it takes all; spans that aren't neighbours are joined by a space."""
    took = spans.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    whole = texts.join(rows.select("rid", "size"), "rid").join(took.drop("epoch"), "rid")
    named = texts.schema["doc"].dataType.names
    others = F.struct(*(F.col(f"doc.`{c}`") for c in named if c != "text"), F.lit(0).alias("_"))
    cut = whole.select(others.alias("others"), F.col("doc.text").alias("text"), "size", "parts")
    done = cut.mapInArrow(_cut_texts, cut.select("others", "text").schema)
    return done.select(*(F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in named))
