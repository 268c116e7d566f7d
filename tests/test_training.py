"""Training of the BiLSTM, and pair counts by correlation."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake import cli
from porelake.operators import bilstm, distance, scoring

from .test_engine import rows


def small(kind=np.float64, seed=0):
    return {k: v.astype(kind) * 3 for k, v in scoring.random_weights(embedding=3, hidden=6, branch_layers=2, joint_layers=2, seed=seed).items()}


def data(n, k=5, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 4, (n, k)), rng.normal(size=(n, k, 19)), rng.integers(0, 2, n)


def test_forward_is_the_scorers():
    w = small(np.float32)
    kmer, signal, label = data(7)
    loss, weight, said, grad = bilstm.loss_and_gradient(w, kmer, signal, label, learn=False)
    logits = scoring.BiLstmScorer(w, 2, 2).logits(kmer, signal)
    p = scoring.softmax(logits.astype(np.float64))
    assert said.tolist() == logits.argmax(1).tolist() and weight == 7 and not grad
    assert np.isclose(loss, -np.log(p[np.arange(7), label]).sum(), rtol=1e-4)


@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_like_finite_differences(dropout):
    w, (kmer, signal, label) = small(), data(4, 3)
    run = lambda w: bilstm.loss_and_gradient(w, kmer, signal, label, (1.0, 2.5), dropout, seed=9)
    grad = run(w)[3]
    rng = np.random.default_rng(1)
    for name, x in w.items():
        for at in rng.choice(x.size, min(6, x.size), replace=False):
            moved = []
            for step in (1e-5, -1e-5):
                other = dict(w)
                other[name] = x.copy()
                other[name].ravel()[at] += step
                moved.append(run(other)[0])
            assert np.isclose((moved[0] - moved[1]) / 2e-5, grad[name].ravel()[at], rtol=1e-4, atol=1e-7), name


def test_adam_by_hand():
    s = bilstm.State({"a": np.array([1.0, 2.0]), "b": np.array([[3.0]])})
    g = np.array([3.0, 0.0, -4.0])
    s.take(g, 0.1, None)
    assert np.allclose(bilstm.flat(s.weights), [0.9, 2.0, 3.1])  # the first step is the rate, whatever the gradient
    first = s.first.copy()
    s.take(g, 0.1, 0.5)
    assert np.allclose(s.first, 0.9 * first + 0.1 * g * 0.1, atol=1e-6)


@pytest.fixture(scope="module")
def table(spark):
    """The label is whether the middle base is a C with a strong signal."""
    rng = np.random.default_rng(3)
    made = []
    for i in range(240):
        label = int(i % 2)
        kmer = [int(x) for x in rng.integers(0, 4, 3)]
        kmer[1] = 1 if label else 2
        signal = rng.normal(size=57) + (1.0 if label else -1.0)
        made.append((f"k{i}", kmer, [float(x) for x in signal], label))
    return spark.createDataFrame(made, "info string, kmer array<int>, signal array<float>, label int").repartition(3)


def test_summed_gradient_is_that_of_all_rows(spark, table):
    w = small()
    got = table.orderBy("info").collect()
    kmer, signal, label = np.array([r.kmer for r in got]), np.array([r.signal for r in got]).reshape(-1, 3, 19), np.array([r.label for r in got])
    loss, weight, _, grad = bilstm.loss_and_gradient(w, kmer, signal, label, (1.0, 3.0))
    for parts in (1, 7):
        g, mean, total, n = bilstm.gradient(table.repartition(parts), w, (1.0, 3.0), batch=50)
        assert n == 240 and total == weight and np.isclose(mean, loss / weight) and np.allclose(g, bilstm.flat(grad) / weight, atol=1e-9)
    assert bilstm.gradient(table.limit(0), w)[3] == 0


def test_training_learns_repeats_and_resumes(spark, table, tmp_path):
    start = {k: v.astype(np.float32) for k, v in scoring.random_weights(embedding=3, hidden=6, branch_layers=1, joint_layers=1, seed=5).items()}
    go = lambda name, epochs: bilstm.train(table, start, str(tmp_path / name), epochs=epochs, batch=60, rate=0.03, decay=0.9, dropout=0.1, parts=2)
    one, history = go("one", 4)
    assert [h["epoch"] for h in history] == [1, 2, 3, 4] and one.steps >= 8
    assert history[-1]["train_loss"] < 0.6 * history[0]["train_loss"] and history[-1]["accuracy"] > 0.9 and history[0]["saved"]
    go("two", 2)  # stops, and goes on from its state
    two, rest = go("two", 4)
    assert [h["epoch"] for h in rest] == [3, 4] and two.steps == one.steps
    assert np.allclose(bilstm.flat(one.weights), bilstm.flat(two.weights), atol=1e-6)
    loaded = bilstm.State.load(spark, str(tmp_path / "one" / "state"))
    assert np.array_equal(bilstm.flat(loaded.weights), bilstm.flat(one.weights)) and loaded.epoch == 4 and loaded.best == one.best
    assert (tmp_path / "one" / "model_epoch1" / "_SUCCESS").exists()
    features = table.select("info", "kmer", "signal", "label")
    said = scoring.score(features, scoring.BiLstmScorer(loaded.weights, 1, 1)).select("label", "predicted").collect()
    assert np.mean([r.label == r.predicted for r in said]) > 0.9
    seen = bilstm.validate(table, loaded.weights)
    assert np.isclose(seen["accuracy"], np.mean([r.label == r.predicted for r in said]))


def test_training_without_rows(spark, table, tmp_path):
    start = small(np.float32)
    nothing = table.limit(0)
    state, history = bilstm.train(nothing, start, str(tmp_path / "none"), epochs=1)
    assert np.array_equal(bilstm.flat(state.weights), bilstm.flat(start)) and history[0]["loss"] == 0.0
    bad = table.limit(2).withColumn("label", F.lit(None).cast("int"))
    assert bilstm.train(bad, start, str(tmp_path / "bad"), epochs=1)[0].steps == 0


def test_train_command(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "in").mkdir()
    label = rng.integers(0, 2, 120)
    x = np.concatenate([rng.integers(0, 4, (120, 3)), rng.normal(size=(120, 57)) + (2 * label[:, None] - 1), label[:, None]], 1).astype(np.float32)
    np.save(tmp_path / "in" / "a.npy", x)
    run = lambda out, *more: cli.COMMANDS["train"][0](spark, cli.parser().parse_args(["train", str(tmp_path / "in"), str(tmp_path / out), "--kmer_size", "3", *more]))
    run("m", "--epochs", "2", "--batch_size", "60", "--rate", "0.03", "--hidden", "6", "--branch_layers", "1", "--joint_layers", "1", "--dropout", "0")
    assert (tmp_path / "m" / "state" / "_SUCCESS").exists() and bilstm.State.load(spark, str(tmp_path / "m" / "state")).epoch == 2
    scorer = scoring.BiLstmScorer.load(str(tmp_path / "m" / "weights.npz"))
    assert (scorer.branch_layers, scorer.joint_layers) == (1, 1) and scorer(x[:, :3].astype(int), x[:, 3:60].reshape(120, 3, 19)).shape == (120, 2)
    assert np.array_equal(bilstm.flat(scorer.w), bilstm.flat(bilstm.State.load(spark, str(tmp_path / "m" / "state")).weights))
    run("linear", "--model", "logistic")
    with np.load(tmp_path / "linear.npz") as f:
        assert f["weights"].shape == (57,)


# --- pairs of calls


def all_pairs(calls, most=None, by_chrom=False):
    spots = collections.defaultdict(list)
    for r, c, p, v in calls:
        if None not in (r, p, v):
            spots[(r, c) if by_chrom else r].append((p, v))
    out = collections.Counter()
    for own in spots.values():
        own.sort()
        for i, (p, v) in enumerate(own):
            for q, u in own[i + 1 :]:
                if most is None or q - p <= most:
                    out[q - p, v + u] += 1
    return sorted((d, sum(out[d, k] for k in range(3)), *(out[d, k] for k in range(3))) for d in {d for d, _ in out})


@pytest.mark.parametrize("width", [16, 64, 1 << 16])
def test_pair_counts_like_all_pairs(spark, width):
    rng = np.random.default_rng(width)
    calls = [(f"r{int(r)}" if r else None, f"c{int(c)}", int(p), int(v)) for r, c, p, v in zip(rng.integers(0, 5, 600), rng.integers(0, 2, 600), rng.integers(-40, 120, 600), rng.integers(0, 2, 600), strict=True)]
    calls += [("r1", "c0", 7, 1)] * 20 + [("r2", "c0", None, 1), ("r2", "c0", 3, None)]
    t = spark.createDataFrame(calls, "read_name string, chrom string, pos int, prob int")
    for most in (None, 0, 10, 40):
        for by_chrom in (False, True):
            assert rows(distance.pair_counts(t, most, by_chrom, width)) == all_pairs(calls, most, by_chrom)
    assert distance.pair_counts(t.limit(0)).count() == 0


def test_lags_by_transform_and_one_by_one():
    rng = np.random.default_rng(8)
    width = 3000
    p, q = (np.sort(rng.choice(width, n, replace=False)) for n in (1500, 1400))
    a1, a0, b1, b0 = (rng.integers(0, 50, n) for n in (1500, 1500, 1400, 1400))
    fast, slow = np.zeros((3, 2 * width - 1), np.int64), np.zeros((3, 2 * width - 1), np.int64)
    distance._add_lags(fast, a1, a0, b1, b0, p, q, False)
    for lo in range(0, 1500, 500):
        distance._add_lags(slow, a1[lo : lo + 500], a0[lo : lo + 500], b1, b0, p[lo : lo + 500], q, False)
    assert (fast == slow).all() and fast.sum() > 0
    fast[:], slow[:] = 0, 0
    distance._add_lags(fast, a1, a0, a1, a0, p, p, True)
    at = (p[None] - p[:, None]).ravel() + width - 1
    for k, n in enumerate((a0[:, None] * a0, a0[:, None] * a1 + a1[:, None] * a0, a1[:, None] * a1)):
        np.add.at(slow[k], at, n.ravel())
    assert (fast[:, width:] == slow[:, width:]).all() and (fast[:, : width - 1] == 0).all()
    assert fast[:, width - 1].tolist() == [(a0 * (a0 - 1) // 2).sum(), (a0 * a1).sum(), (a1 * (a1 - 1) // 2).sum()]


def test_a_long_read_is_many_groups(spark):
    n = 300_000
    t = spark.range(n).selectExpr("concat('r', id div 1000000) as read_name", "id as pos", "cast(id % 3 = 0 as int) as prob")
    got = distance.pair_counts(t, width=1 << 15)
    far = {r.distance: (r.n, r.c2) for r in got.filter("distance in (1, 3, 299999)").collect()}
    assert far == {1: (n - 1, 0), 3: (n - 3, 99_999), 299_999: (1, 0)}
    plan = distance.pair_counts(t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
