"""Training of the two-branch BiLSTM on executors: back-propagation through time in numpy, one summed gradient a step.

An epoch's rows are dealt once, to training or validation and to steps, and written so that a step is a folder of its own. In a step
each task sums the gradients of its rows; the sums are cut into slices that are added up on executors, slice by slice, so that the
driver gets one gradient, whatever the number of tasks. It clips it, takes an Adam step and sends the weights out again."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .training import stable_fraction

Weights = dict[str, np.ndarray]
SLICES = 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _names(name: str, layer: int, back: bool) -> list[str]:
    tail = f"l{layer}" + "_reverse" * back
    return [f"{name}.{kind}_{tail}" for kind in ("weight_ih", "weight_hh", "bias_ih", "bias_hh")]


def _forward(x: np.ndarray, w: Weights, name: str, layer: int, back: bool) -> tuple[np.ndarray, tuple]:
    """x[n, steps, width] -> h[n, steps, size], and what _backward needs."""
    wi, wh, bi, bh = (w[k] for k in _names(name, layer, back))
    (n, steps), size = x.shape[:2], wh.shape[1]
    order = range(steps - 1, -1, -1) if back else range(steps)
    given = x @ wi.T + (bi + bh)
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out, gates, cells = np.empty((n, steps, size), x.dtype), np.empty((n, steps, 4, size), x.dtype), np.empty((n, steps, size), x.dtype)
    for t in order:
        z = (given[:, t] + h @ wh.T).reshape(n, 4, size)  # input, forget, cell, output
        g = gates[:, t]
        g[:, :2], g[:, 2], g[:, 3] = _sigmoid(z[:, :2]), np.tanh(z[:, 2]), _sigmoid(z[:, 3])
        c = g[:, 1] * c + g[:, 0] * g[:, 2]
        h = g[:, 3] * np.tanh(c)
        cells[:, t], out[:, t] = c, h
    return out, (x, out, gates, cells, order)


def _backward(d: np.ndarray, kept: tuple, w: Weights, name: str, layer: int, back: bool, grad: Weights) -> np.ndarray:
    """Gradient of h[n, steps, size] -> that of x; adds those of the weights to grad."""
    x, out, gates, cells, order = kept
    ki, kh, kbi, kbh = _names(name, layer, back)
    wi, wh = w[ki], w[kh]
    n, steps, size = out.shape
    dz, dh, dc, zero = np.empty((n, steps, 4 * size), x.dtype), np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    order = list(order)
    for at in range(steps - 1, -1, -1):
        t, before = order[at], order[at - 1] if at else None
        i, f, g, o = (gates[:, t, j] for j in range(4))
        squashed = np.tanh(cells[:, t])
        dh = d[:, t] + dh
        dc = dc + dh * o * (1 - squashed * squashed)
        old = zero if before is None else cells[:, before]
        dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dc * i * (1 - g * g), dh * squashed * o * (1 - o)], 1)
        dh, dc = dz[:, t] @ wh, dc * f
    earlier = np.zeros_like(out)
    earlier[:, order[1:]] = out[:, order[:-1]]
    flat = dz.reshape(-1, 4 * size)
    grad[ki] += flat.T @ x.reshape(n * steps, -1)
    grad[kh] += flat.T @ earlier.reshape(n * steps, -1)
    grad[kbi] += (b := flat.sum(0))
    grad[kbh] += b
    return dz @ wi


def _layers(w: Weights, name: str) -> int:
    return sum(k.startswith(f"{name}.weight_ih_l") and not k.endswith("_reverse") for k in w)


class _Stack:
    """Stacked bidirectional layers, with dropout between them."""

    def __init__(self, w: Weights, name: str):
        self.w, self.name, self.n = w, name, _layers(w, name)

    def forward(self, x: np.ndarray, drop) -> np.ndarray:
        self.kept, self.masks = [], []
        for layer in range(self.n):
            done = [_forward(x, self.w, self.name, layer, back) for back in (False, True)]
            self.kept.append([k for _, k in done])
            x = np.concatenate([h for h, _ in done], 2)
            self.masks.append(drop(x) if layer < self.n - 1 else 1)
            x = x * self.masks[-1]
        return x

    def backward(self, d: np.ndarray, grad: Weights) -> np.ndarray:
        for layer in range(self.n - 1, -1, -1):
            d = d * self.masks[layer]
            half = d.shape[2] // 2
            d = _backward(d[:, :, :half], self.kept[layer][0], self.w, self.name, layer, False, grad) + _backward(d[:, :, half:], self.kept[layer][1], self.w, self.name, layer, True, grad)
        return d


def loss_and_gradient(w: Weights, kmer: np.ndarray, signal: np.ndarray, label: np.ndarray, class_weight=(1.0, 1.0), dropout: float = 0.0, seed: int = 0, learn: bool = True) -> tuple[float, float, np.ndarray, Weights]:
    """kmer int[n, k], signal[n, k, 19], label int[n] -> the sum of the rows' weighted losses, the sum of their weights, the predicted
    classes, and the gradient of the first (empty unless learn)."""
    kind, rng = w["fc1.bias"].dtype, np.random.default_rng(seed)
    drop = (lambda x: (rng.random(x.shape) >= dropout).astype(kind) / kind.type(1 - dropout)) if dropout else (lambda x: 1)
    signal = signal.astype(kind)
    ins = {"seq": np.concatenate([w["embed.weight"][kmer], signal[:, :, :4]], 2), "signal": signal[:, :, 4:]}
    stacks, tops, kept = {}, {}, {}
    for name, x in ins.items():
        stacks[name] = _Stack(w, f"lstm_{name}")
        kept[name] = stacks[name].forward(x, drop)
        tops[name] = kept[name] @ w[f"fc_{name}.weight"].T + w[f"fc_{name}.bias"]
    joint = _Stack(w, "lstm_comb")
    y = joint.forward(np.concatenate([np.maximum(tops["seq"], 0), np.maximum(tops["signal"], 0)], 2), drop)
    size = y.shape[2] // 2
    ends = np.concatenate([y[:, -1, :size], y[:, 0, size:]], 1)
    mask = drop(ends)
    logits = (ends * mask) @ w["fc1.weight"].T + w["fc1.bias"]
    shifted = logits - logits.max(1, keepdims=True)
    log_p = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
    each = np.asarray(class_weight, kind)[label]
    loss = float(-(each * log_p[np.arange(len(label)), label]).sum())
    grad: Weights = {}
    if learn:
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        d = np.exp(log_p) * each[:, None]
        d[np.arange(len(label)), label] -= each
        grad["fc1.weight"] += d.T @ (ends * mask)
        grad["fc1.bias"] += d.sum(0)
        d = (d @ w["fc1.weight"]) * mask
        dy = np.zeros_like(y)
        dy[:, -1, :size], dy[:, 0, size:] = d[:, :size], d[:, size:]
        d = joint.backward(dy, grad)
        half = tops["seq"].shape[2]
        for name, part in (("seq", d[:, :, :half]), ("signal", d[:, :, half:])):
            part = part * (tops[name] > 0)
            flat = part.reshape(-1, part.shape[2])
            grad[f"fc_{name}.weight"] += flat.T @ kept[name].reshape(len(flat), -1)
            grad[f"fc_{name}.bias"] += flat.sum(0)
            part = stacks[name].backward(part @ w[f"fc_{name}.weight"], grad)
            if name == "seq":
                np.add.at(grad["embed.weight"], kmer, part[:, :, : w["embed.weight"].shape[1]])
    return loss, float(each.sum()), logits.argmax(1), grad


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(x: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


@dataclass
class State:
    """Weights and what Adam keeps; a checkpoint holds all of it."""

    weights: Weights
    first: np.ndarray = field(default=None)
    second: np.ndarray = field(default=None)
    steps: int = 0
    epoch: int = 0
    best: float = 0.0

    def __post_init__(self):
        n = sum(v.size for v in self.weights.values())
        self.first = np.zeros(n) if self.first is None else self.first
        self.second = np.zeros(n) if self.second is None else self.second

    def take(self, gradient: np.ndarray, rate: float, clip: float | None) -> None:
        """One Adam step; a gradient longer than clip is shortened to it."""
        if clip is not None:
            gradient = gradient * min(1.0, clip / (float(np.sqrt((gradient * gradient).sum())) + 1e-6))
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        move = self.first / (1 - 0.9**self.steps) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)
        self.weights = shaped(flat(self.weights).astype(np.float64) - rate * move, self.weights)

    def save(self, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
        """A table of tensors, on any storage that Spark writes."""
        parts = self.weights | {"adam.first": self.first, "adam.second": self.second, "adam.steps": np.array(self.steps), "epoch": np.array(self.epoch), "best": np.array(self.best)}
        rows = [(k, v.dtype.str, list(v.shape), v.tobytes()) for k, v in parts.items()]
        spark.createDataFrame(rows, "name string, kind string, shape array<int>, value binary").coalesce(1).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "State":
        got = {r.name: np.frombuffer(r.value, np.dtype(r.kind)).reshape(r.shape) for r in spark.read.parquet(path).collect()}
        rest = {k: got.pop(k) for k in ("adam.first", "adam.second", "adam.steps", "epoch", "best")}
        return cls(got, rest["adam.first"], rest["adam.second"], int(rest["adam.steps"]), int(rest["epoch"]), float(rest["best"]))


def _rows(batches: Iterator[pa.RecordBatch], size: int):
    """(kmer, signal, label) of at most `size` rows; signals of k * 19 values."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            b = batch.slice(lo, size)
            lists = [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("kmer", "signal")]
            yield lists[0].astype(np.int64), lists[1].reshape(b.num_rows, lists[0].shape[1], -1), b.column("label").to_numpy().astype(np.int64)


def _gradients(weights, rows: int, class_weight, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, part = weights.value, TaskContext.get().partitionId()
        loss = weight = n = 0.0
        total = np.zeros(sum(v.size for v in w.values()))
        for nth, (kmer, signal, label) in enumerate(_rows(batches, rows)):
            a, b, _, grad = loss_and_gradient(w, kmer, signal, label, class_weight, dropout, seed=abs(hash((seed, part, nth))))
            loss, weight, n = loss + a, weight + b, n + len(label)
            total += flat(grad)
        if n:
            cut = np.array_split(np.concatenate([total, [loss, weight, n]]), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["slice", "part", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by slice and part, so that sums come out alike in each run."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[k] = sums[k] + np.frombuffer(x) if k in sums else np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "sums"])


def gradient(rows: DataFrame, w: Weights, class_weight=(1.0, 1.0), dropout: float = 0.0, seed: int = 0, batch: int = 256) -> tuple[np.ndarray, float, float, int]:
    """rows(kmer, signal, label) -> the gradient of the mean weighted loss over all of them, that loss, the weights' sum, the number of rows."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(w)
    each = rows.select("kmer", "signal", "label").mapInArrow(_gradients(sent, batch, class_weight, dropout, seed), "slice int, part int, sums binary")
    parts = max(1, min(SLICES, sc.defaultParallelism))
    got = each.repartition(parts, "slice").sortWithinPartitions("slice", "part").mapInArrow(_added, "slice int, sums binary").collect()
    sent.unpersist()
    if not got:
        return np.zeros(sum(v.size for v in w.values())), 0.0, 0.0, 0
    whole = np.concatenate([np.frombuffer(r.sums) for r in sorted(got, key=lambda r: r.slice)])
    loss, weight, n = whole[-3:].tolist()
    return whole[:-3] / weight, loss / weight, weight, int(n)


def _judged(weights, rows: int, class_weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = weights.value, np.zeros(6)
        for kmer, signal, label in _rows(batches, rows):
            loss, weight, said, _ = loss_and_gradient(w, kmer, signal, label, class_weight, learn=False)
            yes, true = said == 1, label == 1
            seen += [loss, weight, (yes & true).sum(), (~yes & ~true).sum(), (yes & ~true).sum(), (~yes & true).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in seen], ["loss", "weight", "tp", "tn", "fp", "fn"])

    return run


def validate(rows: DataFrame, w: Weights, class_weight=(1.0, 1.0), batch: int = 1024) -> dict[str, float]:
    """Loss, accuracy, precision, recall and F1 over all rows(kmer, signal, label), in one pass; 0 where a ratio divides by 0."""
    sent = rows.sparkSession.sparkContext.broadcast(w)
    names = ("loss", "weight", "tp", "tn", "fp", "fn")
    seen = rows.select("kmer", "signal", "label").mapInArrow(_judged(sent, batch, class_weight), ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
    sent.unpersist()
    loss, weight, tp, tn, fp, fn = (x or 0.0 for x in seen)
    ratio = lambda a, b: a / b if b else 0.0
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"loss": ratio(loss, weight), "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def dealt(rows: DataFrame, key: str, epoch: int, batch: int, folder: str, train: float = 0.7, parts: int | None = None) -> tuple[int, DataFrame]:
    """Writes rows(key, kmer, signal, label) for an epoch: the keys' hashes say which rows train, and in which of about n / batch steps.
    A step's folder has `parts` files, in an order that is the same in each run. Returns the number of steps and the table."""
    parts = parts or rows.sparkSession.sparkContext.defaultParallelism
    trains = stable_fraction(F.col(key), f"epoch{epoch}") < train
    n = rows.filter(trains).count()
    steps = max(1, round(n / batch))
    h = F.xxhash64(key, F.lit(epoch))
    drawn = rows.select(key, "kmer", "signal", "label", F.when(trains, F.pmod(h, F.lit(steps)).cast("int")).otherwise(-1).alias("step"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(parts)).alias("_p"))
    drawn.repartition(min(steps + 1, 200) * parts, "step", "_p").sortWithinPartitions("step", key, F.xxhash64("kmer", "signal", "label")).drop("_p").write.mode("overwrite").partitionBy("step").parquet(folder)
    return steps, rows.sparkSession.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, kmer array<int>, signal array<float>, label int, step int").parquet(folder)


def train(
    rows: DataFrame, start: Weights, folder: str, key: str = "info", epochs: int = 25, batch: int = 1024, rate: float = 1e-3, decay: float = 0.4, clip: float | None = 0.7, dropout: float = 0.5,
    class_weight: tuple[float, float] = (1.0, 1.0), slack: float = 0.0002, seed: int = 71, parts: int | None = None,
) -> tuple[State, list[dict]]:
    """rows(key, kmer array<int>, signal array<float> of k * 19, label 0 or 1) and weights as BiLstmScorer has them -> the state after
    the last epoch, and what each epoch came to: epoch, train_loss, loss, accuracy, precision, recall, f1, saved.

    Each epoch draws 70 % of the keys anew for training, takes a step for every `batch` rows or so, and validates on the others; the rate
    falls by `decay` from epoch to epoch. `folder`, on storage that driver and executors share, gets `state` after each epoch, from which a
    stopped run goes on where it ended, and `model_epoch<n>` when the accuracy is over the best so far - slack. Two runs on the same
    rows give the same weights. Rows with a null key, kmer, signal or label take no part; rows of one key stay together. Without any rows the weights stay.

    The driver holds the weights, Adam's two moments and one gradient. An epoch is one shuffle of the rows; a step reads its own rows alone."""
    spark = rows.sparkSession
    rows = rows.filter(" and ".join(f"{c} is not null" for c in (f"`{key}`", "kmer", "signal", "label"))).select(key, F.col("kmer").cast("array<int>").alias("kmer"), F.col("signal").cast("array<float>").alias("signal"), F.col("label").cast("int").alias("label"))
    state, history = State(start), []
    if _there(spark, f"{folder}/state/_SUCCESS"):
        state = State.load(spark, f"{folder}/state")
    elif _there(spark, f"{folder}/state-before/_SUCCESS"):
        state = State.load(spark, f"{folder}/state-before")
    for epoch in range(state.epoch, epochs):
        steps, table = dealt(rows, key, epoch, batch, f"{folder}/rows", parts=parts)
        losses, weight = 0.0, 0.0
        for step in range(steps):
            g, loss, w, n = gradient(table.filter(F.col("step") == step), state.weights, class_weight, dropout, seed * 1_000_003 + epoch * 10_007 + step)
            if n:
                state.take(g, rate * decay**epoch, clip)
                losses, weight = losses + loss * w, weight + w
        seen = validate(table.filter("step = -1"), state.weights, class_weight)
        state.epoch = epoch + 1
        better = seen["accuracy"] > state.best - slack
        if better:
            state.best = seen["accuracy"]
            state.save(spark, f"{folder}/model_epoch{epoch + 1}")
        _moved(spark, f"{folder}/state", f"{folder}/state-before")
        state.save(spark, f"{folder}/state")
        history.append({"epoch": epoch + 1, "train_loss": losses / weight if weight else 0.0, **seen, "saved": better})
    return state, history


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def _moved(spark: SparkSession, path: str, to: str) -> None:
    """Keeps a whole earlier state while the next is written."""
    if _there(spark, f"{path}/_SUCCESS"):
        where, fs = _path(spark, to)
        fs.delete(where, True)
        fs.rename(_path(spark, path)[0], where)
