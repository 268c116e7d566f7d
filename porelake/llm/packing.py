"""Packing by concatenate and cut.

Pass 1 tokenises each partition and writes its ids with their offsets inside the partition; the partitions' token totals are
summed in order to give each partition its global offset. Pass 2 cuts the one long sequence of ids at multiples of the window:
windows that a task has all ids of come out as rows at once; what is left at both ends of its run of ids are boundary records, which alone are
shuffled, by sequence, and merged."""

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_struct, schema, stash, unstash

#: Both tokenisers were compared on each code point up to here, in words, between spaces and beside digits; texts beyond take the slower.
_ALIKE = 0x2FFFF


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _encoder(path: str, ranks: str | None, special: tuple[tuple[str, int], ...]):
    """text -> list of ids, as tokenizers gives them from the file at path with add_special_tokens=False.

    ranks: the same vocabulary for tiktoken, five times as fast and with the same ids (see tests/llm)."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if ranks is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=dict(special))

    def encode(text: str) -> list[int]:
        if text.isascii() or max(text) <= chr(_ALIKE):
            return fast.encode(text, allowed_special="all") if special else fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def _tokens(path: str, ranks: str | None, special, end_id: int, wide: bool):
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = _encoder(path, ranks, special), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 256):
                ids, starts, ns = [], [], []
                for text in texts[lo : lo + 256].to_pylist():
                    x = encode(text or "")
                    x.append(end_id)
                    ids.append(np.array(x, kind).tobytes())
                    starts.append(at)
                    ns.append(len(x))
                    at += len(x)
                cols = [batch.column("key")[lo : lo + 256], pa.array([part] * len(ns), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "part", "part_start", "n", "ids"])

    return run


def tokenise(docs: DataFrame, keys: list[str], path: str, ranks: str | None = None, special: tuple[tuple[str, int], ...] = (), end_id: int = 0, wide: bool = False) -> DataFrame:
    """docs(keys, text) -> key (a struct of the keys, whose names may be any), at (position of the first id in the whole corpus), n, ids
    (little-endian, of 2 bytes, or of 4 if wide); each document ends with end_id. The table lies in the shared folder; the
    order of documents is that of the input's partitions. Null texts are empty."""
    keyed = docs.select(key_struct(keys), "text")
    kinds = schema("key int, part int, part_start long, n long, ids binary", key=keyed.schema["key"].dataType)
    done = stash(keyed.mapInArrow(_tokens(path, ranks, special, end_id, wide), kinds), "tokens")
    totals = done.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one number for each partition
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    spark = docs.sparkSession
    parts = spark.createDataFrame(list(base.items()) or [(0, 0)], "part int, base long")
    # a partition of input makes one row of 12 bytes here: 8 MB hold the totals of 700,000 partitions
    parts = F.broadcast(parts) if len(base) <= 500_000 else parts
    out = done.join(parts, "part").select("key", (F.col("base") + F.col("part_start")).alias("at"), "n", "ids")
    out._stash_path = done._stash_path
    return out


def _windows(window: int, wide: bool):
    """Tokens in order of at -> (sequence_id, offset, n_ids, pieces, ids): one row for each window, or part of a window at the ends of
    a run of neighbouring documents."""
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, begin, end, made, key_kind = [], [], 0, -1, [], None

        def close() -> None:
            nonlocal held, pieces, begin
            if pieces:
                made.append((begin // window, begin % window, end - begin, pieces, b"".join(held)))
            held, pieces, begin = [], [], end

        def out() -> pa.RecordBatch:
            nonlocal made
            seq, off, n, of, ids = zip(*made, strict=True)
            flat = [p for x in of for p in x]
            piece = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], key_kind), *(pa.array([p[i] for p in flat], pa.int64()) for i in (1, 2, 3, 4))], ["key", "start", "length", "n", "offset"])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int32)
            made = []
            return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), piece), pa.array(ids, pa.binary())], ["sequence_id", "offset", "n_ids", "pieces", "ids"])

        for batch in batches:
            key_kind = batch.schema.field("key").type
            for key, at, n, ids in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != end:  # another run
                    close()
                    begin = end = at
                x, start = np.frombuffer(ids, kind).astype("<u4"), 0
                while start < n:
                    off = (at + start) % window
                    k = min(window - off, n - start)
                    held.append(x[start : start + k].tobytes())
                    pieces.append((key, start, k, n, off))
                    start += k
                    end = at + start
                    if off + k == window:
                        close()
                if len(made) >= 256:
                    yield out()
        close()
        if made:
            yield out()

    return run


def sequences(docs: DataFrame, keys: list[str], window: int = 1024, path: str | None = None, ranks: str | None = None, special: tuple[tuple[str, int], ...] = (), end_id: int = 0, wide: bool = False) -> DataFrame:
    """docs(keys, text) -> sequence_id, n_ids, pieces (array, in order, of key, start (in the document), length, n (the document's
    ids, with end_id), offset (in the sequence)), ids (binary, little-endian unsigned 32-bit).

    All ids stand one after the other; sequence s holds ids s * window to (s + 1) * window - 1, so only the last is shorter
    (padded() fills it up). A document longer than the window goes over several sequences. Empty and null texts give the end_id alone;
    repeated rows are packed each; an empty table gives no rows. key is a struct of the keys, whose names may be any; other columns
    are not read. At most `window` boundary records meet in a row."""
    tokens = tokenise(docs, keys, path or byte_bpe_path(), ranks, special, end_id, wide)
    kinds = schema("sequence_id long, offset long, n_ids long, pieces array<struct<key: int, start: long, length: long, n: long, offset: long>>, ids binary", key=tokens.schema["key"].dataType)
    cut = stash(tokens.mapInArrow(_windows(window, wide), kinds), "windows")
    unstash(tokens)
    whole = cut.filter(F.col("n_ids") == window).select("sequence_id", "n_ids", "pieces", "ids")
    parts = cut.filter(F.col("n_ids") < window).groupBy("sequence_id").agg(F.sum("n_ids").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "pieces", "ids"))).alias("x"))
    joined = F.aggregate("x", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    merged = parts.select("sequence_id", "n_ids", F.flatten(F.transform("x", lambda p: p["pieces"])).alias("pieces"), joined.alias("ids"))
    return whole.unionByName(merged)


def padded(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequences() -> the same with ids of window * 4 bytes, the last sequence's filled up with pad_id."""
    pad = int(pad_id).to_bytes(4, "little") * window
    return packed.withColumn("ids", F.when(F.col("n_ids") < window, F.substring(F.concat("ids", F.lit(pad)), 1, window * 4)).otherwise(F.col("ids")))


def pieces(packed: DataFrame) -> DataFrame:
    """sequences() -> a row for each piece: key, start, length, n, sequence_id, offset, ids (its own)."""
    each = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    return each.select("p.key", "p.start", "p.length", "p.n", "sequence_id", "p.offset", F.expr("substring(ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"))
