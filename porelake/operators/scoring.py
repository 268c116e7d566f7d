"""Scoring: a scorer turns (kmer, signal) batches into class probabilities; calls keep that of class 1."""

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    def __call__(self, kmer: np.ndarray, signal: np.ndarray) -> np.ndarray:
        """kmer int[n, k], signal float32[n, k, 19] -> probabilities float[n, 2]."""


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class ConstantScorer:
    def __init__(self, p: float = 0.5):
        self.p = p

    def __call__(self, kmer, signal):
        return np.tile([1 - self.p, self.p], (len(kmer), 1))


class LogisticScorer:
    """Linear in the flattened signal, with weights / scale. Terms are added in the signal's order, one by one, so that a row near one half
    comes out alike in every batch and on every machine."""

    def __init__(self, weights: np.ndarray, bias: float = 0.0, scale: float = 1.0):
        self.weights, self.bias, self.scale = np.asarray(weights, np.float64), bias, scale

    def __call__(self, kmer, signal):
        terms = signal.reshape(len(signal), -1).astype(np.float64) * self.weights / self.scale
        p = 1 / (1 + np.exp(-(np.cumsum(terms, axis=1)[:, -1] + self.bias)))
        return np.stack([1 - p, p], 1)


def _lstm(x: np.ndarray, w: dict, name: str, layer: int, back: bool) -> np.ndarray:
    tail = f"l{layer}" + "_reverse" * back
    wi, wh, b = w[f"{name}.weight_ih_{tail}"], w[f"{name}.weight_hh_{tail}"], w[f"{name}.bias_ih_{tail}"] + w[f"{name}.bias_hh_{tail}"]
    n, steps, size = len(x), x.shape[1], wh.shape[1]
    h, c, out = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype), np.empty((n, steps, size), x.dtype)
    given = x @ wi.T + b
    for t in range(steps - 1, -1, -1) if back else range(steps):
        i, f, g, o = np.split(given[:, t] + h @ wh.T, 4, 1)
        sig = lambda v: 1 / (1 + np.exp(-v))
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
        out[:, t] = h
    return out


def bilstm(x: np.ndarray, w: dict, name: str, layers: int) -> np.ndarray:
    """Stacked bidirectional LSTM; gates in the order input, forget, cell, output; [n, steps, 2 * hidden]."""
    for layer in range(layers):
        x = np.concatenate([_lstm(x, w, name, layer, False), _lstm(x, w, name, layer, True)], 2)
    return x


class BiLstmScorer:
    """Two branches, bases with their four statistics and the 15 samples, joined by a third LSTM; weights by their PyTorch names, as saved
    in an .npz file. The numbers of layers are those that there are weights of, unless they are given."""

    def __init__(self, weights: dict[str, np.ndarray], branch_layers: int | None = None, joint_layers: int | None = None):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        there = lambda name: sum(k.startswith(f"{name}.weight_ih_l") and not k.endswith("_reverse") for k in self.w)
        self.branch_layers, self.joint_layers = branch_layers or there("lstm_seq"), joint_layers or there("lstm_comb")

    @classmethod
    def load(cls, path: str) -> "BiLstmScorer":
        with np.load(path) as f:
            return cls(dict(f))

    def _branch(self, x, name):
        y = bilstm(x, self.w, f"lstm_{name}", self.branch_layers) @ self.w[f"fc_{name}.weight"].T + self.w[f"fc_{name}.bias"]
        return np.maximum(y, 0)

    def logits(self, kmer, signal):
        signal = np.asarray(signal, np.float32)
        bases = np.concatenate([self.w["embed.weight"][kmer], signal[:, :, :4]], 2)
        y = bilstm(np.concatenate([self._branch(bases, "seq"), self._branch(signal[:, :, 4:], "signal")], 2), self.w, "lstm_comb", self.joint_layers)
        size = y.shape[2] // 2
        return np.concatenate([y[:, -1, :size], y[:, 0, size:]], 1) @ self.w["fc1.weight"].T + self.w["fc1.bias"]

    def __call__(self, kmer, signal):
        return softmax(self.logits(kmer, signal))


def random_weights(embedding: int = 8, hidden: int = 256, branch_layers: int = 2, joint_layers: int = 3, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the full model's shapes, for tests and warm-up."""
    rng, w = np.random.default_rng(seed), {"embed.weight": (16, embedding)}
    half = hidden // 2

    def lstm(name, width, size, layers):
        for layer in range(layers):
            for tail in (f"l{layer}", f"l{layer}_reverse"):
                w.update({f"{name}.weight_ih_{tail}": (4 * size, width if not layer else 2 * size), f"{name}.weight_hh_{tail}": (4 * size, size), f"{name}.bias_ih_{tail}": (4 * size,), f"{name}.bias_hh_{tail}": (4 * size,)})

    lstm("lstm_seq", embedding + 4, half, branch_layers)
    lstm("lstm_signal", 15, half, branch_layers)
    lstm("lstm_comb", hidden, hidden, joint_layers)
    for name in ("seq", "signal"):
        w |= {f"fc_{name}.weight": (half, 2 * half), f"fc_{name}.bias": (half,)}
    w |= {"fc1.weight": (2, 2 * hidden), "fc1.bias": (2,)}
    return {k: rng.normal(0, 0.1, v).astype(np.float32) for k, v in w.items()}


def _score(scorer, batch: int, shape: tuple[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                x = frame.iloc[lo : lo + batch]
                kmer = np.stack(x["kmer"].to_numpy()).astype(np.int64)
                signal = np.stack(x["signal"].to_numpy()).astype(np.float32).reshape(len(x), -1, shape[1])
                p = scorer(kmer, signal)
                done = x.drop(columns=["kmer", "signal"])
                yield done.assign(methylation_rate=p[:, 1].astype(np.float32), predicted=(p[:, 1] > p[:, 0]).astype(np.int32))

    return run


def score(features: DataFrame, scorer: Scorer, batch: int = 1024, per_base: int = 19) -> DataFrame:
    """Features -> their other columns, methylation_rate (probability of class 1), predicted (the likelier class). The scorer travels once
    with the task; batches flow through it as the join makes them, without a stage between."""
    keep = [f for f in features.schema.fields if f.name not in ("kmer", "signal")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return features.mapInPandas(_score(scorer, batch, (0, per_base)), f"{kinds}, methylation_rate float, predicted int")


def call_mods(features: DataFrame, scorer: Scorer, batch: int = 1024) -> DataFrame:
    """Features -> calls."""
    s = score(features, scorer, batch)
    return s.select("read_id", s.ref_start.alias("reference_start"), s.ref_end.alias("reference_end"), s.chr.alias("chromosome"), s.pos.alias("pos_in_strand"), "strand", "methylation_rate")
