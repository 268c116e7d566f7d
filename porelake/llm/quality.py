"""Quality by ordinal regression: a cumulative-link model on graded ratings.

One weight vector over hashed features of the text gives a score s; ordered thresholds t_1 < t_2 < ... turn it into
P(grade >= j) = sigmoid(s - t_j), from which come the expected grade and the tail probability by which documents are selected."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, schema, text_of
from .words import Hasher, buffer, chunks, encoded, mixed, words

DIM = 1 << 18
_STEPS = 9
#: A byte's class: 1 capital, 2 letter (bytes of other scripts too), 3 digit, and each other sign its own; and whether it is part of a word.
_CLASS = np.array([1 if 65 <= b < 91 else 2 if 97 <= b < 123 or b >= 128 else 3 if 48 <= b < 58 else b + 4 for b in range(256)], np.uint64)
_INNER = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


def _place(salt: int, x: np.ndarray) -> np.ndarray:
    """Hashes -> indexes below DIM, another choice for each salt."""
    with np.errstate(over="ignore"):
        return mixed(x + np.uint64(salt) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(46)


EMPTY = int(_place(9, np.zeros(1, np.uint64))[0])


def _shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Classes of a word's first and last three bytes, neighbours of one class made one: `Word.` as `Aa.`, `WORD!!` as `A!`."""
    out, last = _CLASS[raw[start]], _CLASS[raw[start]]
    for i in (3, 2, 1):
        now = np.where(end - i >= start, _CLASS[raw[np.maximum(end - i, start)]], last)
        out = np.where(now != last, out * np.uint64(512) + now, out)
        last = now
    return out


def features(texts: list[bytes], lower: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Texts, and the same in lower case -> the sorted distinct indexes of each text's features, one text after the other, and where each
    text's begin (and where the last's end).

    Which words (without signs around them) and which word beginnings of 4 and 5 bytes the whole text has, and, in steps of a
    factor of two, the share of its words that have each shape, and of its distinct words. The empty text has a feature of its own."""
    raw, begin = buffer(texts)
    start, end = words(raw)
    n = np.diff(np.searchsorted(start, begin))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    made = [(np.flatnonzero(n == 0).astype(np.uint64), np.full(int((n == 0).sum()), EMPTY, np.uint64))]
    if len(start):
        with np.errstate(over="ignore"):
            _, at, times = np.unique(hasher.spans(hasher.sums(raw), start, end) + mixed(doc), return_index=True, return_counts=True)
        own = doc[at]
        kinds = np.bincount(own.astype(np.int64), minlength=len(texts))
        shape = _shapes(raw, start[at], end[at])
        with np.errstate(over="ignore"):
            _, one, which = np.unique(shape + mixed(own), return_index=True, return_inverse=True)
        whose, shape, having = own[one], shape[one], np.bincount(which, times)
        step = np.minimum(_STEPS - 1, np.log2(n[whose.astype(np.int64)] / having).astype(np.int64))
        for j in range(_STEPS):  # at least this share
            mine = step <= j
            made.append((whose[mine], _place(10 + j, shape[mine])))
        some = np.flatnonzero(n)
        made.append((some.astype(np.uint64), _place(30, (8 * kinds[some] // n[some]).astype(np.uint64))))
        low, _ = buffer(lower)
        a, b = (x[at] for x in words(low))
        inside, sums = _INNER[low], hasher.sums(low)
        inner, before = np.append(np.flatnonzero(inside), len(low)), np.concatenate([[0], np.cumsum(inside)])
        first = np.minimum(inner[before[a]], b)
        last = np.where(first < b, inner[before[b] - 1] + 1, first)
        made.append((own, _place(1, hasher.spans(sums, first, last))))
        for k in (4, 5):
            long = last - first > k
            made.append((own[long], _place(k, hasher.spans(sums, first[long], first[long] + k))))
    pairs = np.sort(np.concatenate([d * np.uint64(DIM) + f for d, f in made]))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    return (pairs % np.uint64(DIM)).astype(np.uint32), np.searchsorted(pairs, np.arange(len(texts) + 1, dtype=np.uint64) * np.uint64(DIM))


def _chunked(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, features, where each text's begin) for ranges of a batch's texts."""
    for lo, part, coded in chunks(texts):
        yield lo, lo + len(part), *features(coded, [encoded((t or "").lower()) for t in part], hasher)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for lo, hi, f, begin in _chunked(batch.column("text"), hasher):
            x = [f[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("grade", "h", "t")), pa.array(x, pa.binary())], ["grade", "h", "t", "x"])


def fit(docs: DataFrame, grades: DataFrame, max_rows: int = 6_000, steps: int = 400, min_docs: int = 3, significance: float = 4.0) -> dict:
    """docs(doc_id, text), grades(doc_id, grade 0..K-1) -> the model. Learns from at most max_rows of the graded rows, those with the
    least hashes of doc_id and text, whose hashed features come to the driver. Features whose counts over the grades differ from
    chance by `significance` standard deviations take part, each with the size of its log odds. A grade that is null doesn't count; of
    several grades of a doc_id the least does; rows that share a graded doc_id are learnt from each, within max_rows."""
    graded = grades.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = graded.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    # a tenth more than are wanted, in expectation, for a broadcast of about max_rows rows of 20 bytes; then the least
    chosen = graded.withColumn("h", h).filter(F.col("h") <= F.lit(int(min(1.0, (1.1 * max_rows + 100) / max(n, 1)) * (1 << 30))))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "h", F.xxhash64("text").alias("t"), "text")
    made = picked.mapInArrow(_featurise, "grade int, h long, t long, x binary")
    got = made.orderBy("h", "t", "x").limit(max_rows).toArrow()
    if not got.num_rows:
        return {"w": np.zeros(DIM, np.float32), "known": np.zeros(DIM, bool), "cuts": np.zeros(0), "fitted": False}
    rows = [np.frombuffer(b.as_buffer(), np.uint32) for b in got["x"]]
    y = got["grade"].to_numpy().astype(np.int32)
    k, n = int(y.max()) + 1, len(rows)
    lens = np.array([len(r) for r in rows])
    cols, doc = np.concatenate(rows).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), lens)
    del rows, got
    pa.default_memory_pool().release_unused()
    share = np.bincount(y, minlength=k).astype(float)
    having = np.stack([np.bincount(cols[y[doc] == g], minlength=DIM) for g in range(k)]).astype(float)
    seen = having.sum(0)
    # which features some grade has more or less often than chance would give it, and how much so on either side of a threshold
    expected = seen[None] * share[:, None] / n
    spread = np.sqrt(np.maximum(expected * (1 - share[:, None] / n) * (1 - seen[None] / n), 1e-9))
    sure = np.where(seen >= min_docs, ((np.abs(having - expected) - 0.5) / spread).max(0), 0)
    names = np.flatnonzero(sure >= significance)
    odds = np.zeros(DIM)
    for j in range(1, k):
        low, high = ((part.sum(0) + 0.5) / (total.sum() + 1) for part, total in ((having[:j], share[:j]), (having[j:], share[j:])))
        odds = np.maximum(odds, np.abs(np.log(low / high)))
    value = odds[names]
    place = np.full(DIM, -1, np.int32)
    place[names] = np.arange(len(names))
    kept = place[cols] >= 0
    cols, doc = place[cols[kept]], doc[kept]
    x, scale = value[cols], 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    above = y[:, None] >= np.arange(1, k)[None]
    weight = (1 / np.sqrt(np.maximum(share, 1)))[y]
    weight = weight / weight.sum()
    w = np.zeros(len(names))
    cuts = np.linspace(-1, 1, k - 1) if k > 2 else np.zeros(k - 1)
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)
    # some texts at a time, so that what is made on the way stays small
    ends = np.searchsorted(doc, np.arange(0, n + 500, 500))
    parts = [(a * 500, min(a * 500 + 500, n), slice(lo, hi)) for a, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if a * 500 < n]
    for t in range(1, steps + 1):  # Adam on the weighted cumulative-link loss
        gw, gc = 3e-4 * w, np.zeros_like(cuts)
        for a, b, of in parts:
            s = np.bincount(doc[of] - a, x[of] * w[cols[of]], b - a) * scale[a:b]
            g = (1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30))) - above[a:b]) * weight[a:b, None]
            gw += np.bincount(cols[of], x[of] * (g.sum(1) * scale[a:b])[doc[of] - a], len(names))
            gc -= g.sum(0)
        m, v, mc, vc = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        cuts = np.sort(cuts - 0.05 * (mc / (1 - 0.9**t)) / (np.sqrt(vc / (1 - 0.99**t)) + 1e-9))
    w = w * value
    whole = np.zeros(DIM, np.float32)
    whole[names] = w
    known = np.zeros(DIM, bool)
    known[names] = True
    return {"w": whole, "known": known, "cuts": cuts, "fitted": True, "rows": n}


def _grade(model: dict, least: int, tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w, cuts = Hasher(), model["w"].astype(np.float64), model["cuts"]
        for batch in batches:
            if not model["fitted"]:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.nulls(n, pa.float64()), pa.array(np.ones(n)), pa.array(np.ones(n, bool))], ["key", "expected_grade", "tail", "selected"])
                continue
            for lo, hi, f, begin in _chunked(text_of(batch), hasher):
                doc, known = np.repeat(np.arange(hi - lo), np.diff(begin)), model["known"][f]
                number = np.bincount(doc[known], minlength=hi - lo)
                s = np.bincount(doc[known], w[f[known]], hi - lo) / np.sqrt(np.maximum(number, 1))
                p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
                upper = p[:, least - 1] if least <= p.shape[1] else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi], pa.array(p.sum(1)), pa.array(upper), pa.array(upper >= tail)], ["key", "expected_grade", "tail", "selected"])

    return run


def grade(docs: DataFrame, model: dict, keys: list[str], least: int = 2, tail: float = 0.5) -> DataFrame:
    """docs(keys, text) -> key (a struct of the keys, whose names may be any), expected_grade, tail (P(grade >= least)), selected (tail
    at least `tail`).

    Reads whole texts; null is as empty. If there was nothing to learn from, expected_grade is null and all are selected. Repeated
    rows stay; an empty table gives no rows."""
    rows = keyed(docs, keys)
    return rows.mapInArrow(_grade(model, least, tail), schema("key int, expected_grade double, tail double, selected boolean", key=rows.schema["key"].dataType))


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> doc_id, grade: 0 of low quality, 1 toxic, 2 neither; null where quality is."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(toxic, 1).when(F.col("quality").isNotNull(), 2).alias("grade"))
