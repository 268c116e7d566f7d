"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each of its bits. A text gets the language
whose codeword has the least logistic loss over the predicted margins, each bit weighted by how well it was learnt; two languages
of nearly the same loss make it ambiguous."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, schema, text_of

DIM = 1 << 13
UND = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become spaces; the bytes of other characters stay.
_PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: rows of a Hadamard matrix of order 8 at least without its constant column, so that any two differ in
    half of the bits or more; one bit's error is corrected for up to 8 languages, more for more."""
    order = 8
    while order < n:
        order *= 2
    h = np.ones((1, 1), np.float32)
    while len(h) < order:
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:]


def features(text: str) -> np.ndarray:
    """Square roots of the frequencies of the whole text's hashed byte 1-, 2- and 3-grams, of length 1."""
    b = _PLAIN[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    one, two = b * np.uint32(0x9E3779B1), b[1:] * np.uint32(0x85EBCA77) ^ (b[:-1] + np.uint32(7)) * np.uint32(0xC2B2AE3D)
    three = two[1:] * np.uint32(5) ^ (b[:-2] + np.uint32(3)) * np.uint32(0x27D4EB2F)
    out = np.zeros(DIM, np.float32)
    for grams in (one, two, three):
        if len(grams):
            grams = grams ^ (grams >> np.uint32(15))
            out += np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(19), minlength=DIM)
    np.sqrt(out, out)
    return out / max(float(np.sqrt(out @ out)), 1e-9)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(x, pa.binary())], ["lang", "h", "x"])


def fit(train: DataFrame, per_lang: int = 400, max_rows: int = 16_384, steps: int = 150) -> dict:
    """train(text, lang), without nulls -> the model. Learns from at most per_lang distinct texts of each language, fewer if all
    languages' together would be over max_rows, but one of each at least (all, where there are fewer): those with the least hash. So
    every language is learnt, and the driver holds max_rows vectors of DIM floats, or one for each language. A text that stands in many
    rows counts once, so copies neither fill the sample nor make it larger."""
    hashed = train.select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    langs = sorted((r.lang for r in counts), key=lambda s: s.encode())
    if not langs:
        return {"langs": []}
    per_lang = max(1, min(per_lang, max_rows // len(langs)))
    # half as many again as are wanted (of few, eight more), in expectation; then the least
    shares = train.sparkSession.createDataFrame([(r.lang, min(1.0, (1.5 * per_lang + 8) / max(r.n, 1))) for r in counts], "lang string, share double")
    some = hashed.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    least = some.groupBy("lang", "h").agg(F.first("text").alias("text")).withColumn("_r", rank).filter(F.col("_r") <= per_lang)
    got = least.select("lang", "text", "h").mapInArrow(_featurise, "lang string, h long, x binary").toArrow()
    if not got.num_rows:
        return {"langs": []}
    place = {lang: i for i, lang in enumerate(langs)}
    which = np.array([place[v] for v in got["lang"].to_pylist()])
    order = np.lexsort((got["h"].to_numpy(), which))  # the same sums in each run
    which, x = which[order], np.empty((len(order), DIM), np.float32)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    for i, b in zip(at, got["x"], strict=True):
        x[i] = np.frombuffer(b.as_buffer(), np.float16)
    del got
    pa.default_memory_pool().release_unused()
    code = codewords(len(langs))
    y, weight = code[which], (1 / np.bincount(which, minlength=len(langs)))[which].astype(np.float32)[:, None] / len(langs)
    w, bias = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)
    for t in range(1, steps + 1):  # Adam on the balanced logistic loss
        g = -y * weight / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30)))
        gw, gb = x.T @ g + 1e-6 * w, g.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    right = (weight * (y * (x @ w + bias) > 0)).sum(0)  # a bit that was learnt no better than by chance doesn't count
    return {"langs": langs, "rows": len(x), "w": w, "bias": bias, "code": code, "bit": np.clip(2 * right - 1, 0.02, 1).astype(np.float32)}


def decode(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """margins[n, bits] -> index of the language, its score in 0..1, and the loss by which the next language is worse, per bit."""
    ones = (model["code"] > 0).astype(margins.dtype)
    loss = (np.logaddexp(0, -margins) * model["bit"]) @ ones.T + (np.logaddexp(0, margins) * model["bit"]) @ (1 - ones).T
    best, n = loss.argmin(1), len(loss)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    least = np.partition(loss, 1, axis=1)[:, :2] if loss.shape[1] > 1 else np.concatenate([loss, loss + model["bit"].sum() * 9], 1)
    return best, p[np.arange(n), best] / p.sum(1), (least[:, 1] - least[:, 0]) / model["bit"].sum()


def _predict(model: dict, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = text_of(batch)[lo : lo + 256].to_pylist()
                lang, score, ambiguous = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model["langs"] else []
                if at:
                    x = np.stack([features(texts[i]) for i in at])
                    best, p, gap = decode(model, x @ model["w"] + model["bias"])
                    for i, b, q, d in zip(at, best, p, gap, strict=True):
                        lang[i], score[i], ambiguous[i] = model["langs"][b], q, d < margin
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo : lo + 256], pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], ["key", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: dict, keys: list[str], margin: float = 0.02) -> DataFrame:
    """docs(keys, text) -> key (a struct of the keys, whose names may be any), lang_pred, score, ambiguous (the next language's mean loss
    a bit is within margin of the best's).

    Reads whole texts and nothing else. A text that is null or has no letter, or any text if nothing could be learnt: `und`, 0, not
    ambiguous. Repeated rows stay; an empty table gives no rows."""
    rows = keyed(docs, keys)
    return rows.mapInArrow(_predict(model, margin), schema("key int, lang_pred string, score double, ambiguous boolean", key=rows.schema["key"].dataType))
