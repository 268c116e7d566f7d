"""Operators, sources, the feature kernel, scoring, streaming and the command line on small fixtures."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake import cli, schemas
from porelake.functions import sequence as sq
from porelake.operators import distance, features, metrics, reads, scoring, sites, training, validate
from porelake.sources import arrays, bam, fasta, sam, tables
from porelake.streaming import calls as streams


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_site_aggregation(spark):
    c = spark.createDataFrame([("c", 5, 0.9), ("c", 5, 0.5), ("c", 5, 0.7), ("c", 9, 0.2)], "chr string, pos int, prob double")
    got = rows(sites.aggregate_sites(c))
    assert [(r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in got] == [("c", 5, 6, 66.666667, 2, 1), ("c", 9, 10, 0.0, 0, 1)]
    assert rows(sites.confident(c, 0.8)) == [("c", 5, 0.9)]


def test_strand_merge(spark):
    motif = spark.createDataFrame([("c", 5, 7)], "chr string, start int, end int")
    s = spark.createDataFrame([("c", 5, 6, 2, 1), ("c", 6, 7, 0, 3), ("c", 8, 9, 1, 1)], "chr string, start int, end int, methy int, unmethy int")
    for got in (sites.merge_strands(motif, s), sites.merge_strands_by_overlap(motif, s)):
        (r,) = got.collect()
        assert (r.methy, r.unmethy, round(r.frequency, 6)) == (2, 4, 33.333333)
    assert sites.merge_strands(motif, s, then=lambda d: d.select(F.count("*").alias("n"))).first().n == 2


def test_overlaps_like_all_pairs(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [("c", int(a), int(a + k)) for a, k in zip(rng.integers(0, 300, n), rng.integers(1, 60, n), strict=True)]
    a, b = make(60), make(60)
    kind = "chr string, start int, end int"
    want = sorted((x[1], x[2], y[1], y[2], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    got = sites.overlaps(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 16)
    assert sorted(tuple(r)[1:] for r in got.select("chr", "a_start", "a_end", "b_start", "b_end", "overlap").collect()) == want


LABELS, SCORES = [1, 1, 0, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.3, 0.1]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(list(zip(LABELS, SCORES, strict=True)), "label int, prob double")


def test_roc(scored):
    for parts in (1, 3):
        assert round(metrics.roc_auc(scored, parts).first()[0], 6) == 0.833333
        assert round(metrics.average_precision(scored, parts).first()[0], 6) == 0.805556
    flipped = scored.withColumn("prob", -F.col("prob"))
    assert math.isclose(metrics.roc_auc(flipped).first()[0], 1 - 0.8333333333)
    assert metrics.roc_auc(scored.filter("label = 1")).first()[0] is None


def test_sweep(scored):
    a, b = (rows(f(scored).select("threshold", "TP", "TN", "FP", "FN", "TPR", "FPR", "F1", "Precision", "Accuracy", "Specificity"), "threshold") for f in (metrics.sweep, metrics.sweep_by_grid))
    assert a == b and len(a) == 101
    at = {r[0]: [round(x, 6) for x in r[1:]] for r in a}
    assert at[0.0] == [3, 0, 3, 0, 1, 1, 0.666667, 0.5, 0.5, 0]
    assert at[0.8] == [2, 2, 1, 1, 0.666667, 0.333333, 0.666667, 0.666667, 0.666667, 0.666667]
    assert at[1.0] == [0, 3, 0, 3, 0, 0, 0, 0, 0.5, 0.5]
    assert all(x[1] >= y[1] and x[3] >= y[3] for x, y in zip(a, a[1:], strict=False))


def test_balance(spark):
    m = spark.createDataFrame([(0.1, 30, 80, 20, 10), (0.2, 40, 50, 50, 0)], "threshold double, TP long, TN long, FP long, FN long")
    got = rows(metrics.balance(m).select("multiplier", "adjusted_TN", "adjusted_FP", "b_Precision", "b_Specificity"), F.desc("b_Precision"))
    assert [(*r[:3], round(r[3], 6), round(r[4], 6)) for r in got] == [(0.4, 32, 8, 0.789474, 0.761905), (0.4, 20, 20, 0.666667, 1.0)]
    none = m.unionByName(spark.createDataFrame([(0.3, 1, 0, 0, 1)], m.schema))
    assert {r.multiplier for r in metrics.balance(none).collect()} == {0.0}
    conf = metrics.high_confidence(metrics.balance(m), (0.7, 0.99)).orderBy("level").collect()
    assert [(r.total, r.TP_first, r.TN_last) for r in conf] == [(140, 30, 50), (140, 0, 50)]


READS = [("r1", 10, 1), ("r1", 20, 1), ("r1", 35, 0), ("r2", 10, 0), ("r2", 20, 1), ("r3", 100, 1), ("r3", 110, 1), ("r3", 110, 0)]


def test_distances(spark):
    c = spark.createDataFrame([(r, "c", p, v) for r, p, v in READS], schemas.BINARY_CALLS)
    want = [(0, 1, 0, 1, 0, -1.0), (10, 4, 0, 2, 2, -0.333333), (15, 1, 0, 1, 0, -1.0), (25, 1, 0, 1, 0, -1.0)]
    got = rows(distance.correlation(distance.pair_counts(c)).select("distance", "n", "c0", "c1", "c2", F.round("correlation", 6)))
    assert got == want
    assert rows(distance.pair_counts(c, 15)) == [w[:5] for w in want[:3]]
    ones = distance.correlation(distance.pair_counts(c.filter("prob = 1")))
    assert {r.correlation for r in ones.collect()} == {None}


def test_smoothing(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=80)
    curve = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "distance long, correlation double")
    got = [r[2] for r in rows(distance.smooth(curve), "distance")]
    x = np.arange(80)
    want = [np.polyval(np.polyfit(x[a : a + 51] - i, y[a : a + 51], 3), 0) for i, a in ((i, min(max(i - 25, 0), 29)) for i in range(80))]
    assert np.allclose(got, want)
    assert {r.smoothed for r in distance.smooth(curve.filter("distance < 50")).collect()} == {None}


def test_islands_and_pearson(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate("aabbba")], "i int, v string")
    assert [r[2] for r in rows(distance.islands(d.withColumn("g", F.lit(1)), ["g"], ["i"], "v").select("i", "v", "island"))] == [0, 0, 1, 1, 1, 2]
    p = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "ratio double, frequency double")
    assert math.isclose(validate.pearson(p).first().pearson, np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])
    assert validate.pearson(p.limit(1)).first().pearson is None


def test_downsample_keeps_reads_whole(spark):
    d = spark.range(3000).select((F.col("id") % 300).cast("string").alias("read_id"), "id")
    small, large = (reads.downsample(d, f) for f in (0.2, 0.6))
    n = {r[0]: r[1] for r in small.groupBy("read_id").count().collect()}
    assert set(n.values()) == {10} and 30 < len(n) < 100
    assert small.join(large, "id", "left_anti").count() == 0


GENOME = "TTACGATCGGCATCGATTACGCCGATGACGT" * 3


def made_reads(seed=3):
    """A forward, a reverse and a split read over GENOME, with their signals."""
    rng, out, signals = np.random.default_rng(seed), [], []
    for i, (start, end, forward, split) in enumerate([(2, 70, True, False), (10, 85, False, False), (5, 60, True, True)]):
        ref = GENOME[start:end]
        clip = 4
        seq = "A" * clip + ref + "C" * 2
        n = len(seq)
        moves = np.concatenate([[0], np.cumsum(rng.integers(1, 6, n))])
        bits = np.zeros(moves[-1], int)
        bits[moves[:-1]] = 1
        trim, before = 7, 30 if split else 0
        samples = int(moves[-1]) * 5 + trim
        name = f"read{i}"
        signals.append(("one.pod5", "parent" if split else name, [int(x) for x in rng.integers(200, 900, samples + before + 20)], -10.0, 0.2))
        tags = {"fn": ("Z", "one.pod5"), "ts": ("i", trim), "ns": ("i", samples), "NM": ("i", 0), "mv": ("Bc", [5, *bits.tolist()])}
        tags |= {"pi": ("Z", "parent"), "sp": ("i", before)} if split else {}
        cigar = [("S", clip), ("M", len(ref)), ("S", 2)]
        qual = "".join(chr(33 + int(q)) for q in rng.integers(5, 50, n))
        out.append({"read_id": name, "flag": 0 if forward else 16, "chr": "c1", "pos0": start, "mapq": 60, "cigar": cigar, "seq": seq, "qual": qual, "tags": tags})
    return out, signals


def by_hand(r, signals, k):
    """The features of one read, one value at a time."""
    tags = {k: v[1] for k, v in r["tags"].items()}
    raw = next(s for s in signals if s[1] == tags.get("pi", r["read_id"]))
    pa = [0.2 * (x - 10.0) for x in raw[2]]
    med = sorted(pa)[(len(pa) - 1) // 2]
    mad = sorted(abs(x - med) for x in pa)[(len(pa) - 1) // 2] / 0.674489
    x = [(v - med) / mad for v in pa]
    if "sp" in tags:
        x = x[tags["sp"] : tags["sp"] + tags["ns"]]
    x = x[tags["ts"] :]
    moves = [i for i, b in enumerate(tags["mv"][1:]) if b] + [len(tags["mv"]) - 1]
    groups, lengths = [], []
    for a, b in zip(moves, moves[1:], strict=False):
        a, b = a * 5, b * 5
        n = b - a
        if n < 15:
            s = max(a - (15 - n) // 2, 0)
            s = min(s, len(x) - 15)
        else:
            s = a + (n - 15) // 2
        groups.append(x[s : s + 15])
        lengths.append(n)
    forward, length = not r["flag"] & 16, r["cigar"][1][1]
    ref = GENOME[r["pos0"] : r["pos0"] + length]
    qual = [(ord(c) - 33) / 60 for c in r["qual"]]
    lead = r["cigar"][0][1]
    if not forward:
        ref = ref[::-1].translate(str.maketrans("ACGT", "TGCA"))
        qual, lead = qual[::-1], r["cigar"][2][1]
    out, half = {}, k // 2
    for i in range(len(ref) - 1):
        if ref[i : i + 2] == "CG" and i >= half and i + half < len(ref):
            pos = r["pos0"] + i if forward else r["pos0"] + length - 1 - i
            feature = []
            for j in range(i - half, i + half + 1):
                g = groups[j + lead]
                feature += [sum(g) / 15, sum(g) / 15, lengths[j + lead], qual[j + lead], *g]
            out[pos] = (["ACGT".index(c) for c in ref[i - half : i + half + 1]], feature)
    return out


@pytest.fixture(scope="module")
def genome(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    made, signals = made_reads()
    (d / "bam").mkdir()
    bam.write_bam(str(d / "bam" / "one.bam"), [("c1", len(GENOME))], made)
    (d / "ref.fa").write_text(">c1 a description\n" + GENOME[:40].lower() + "\n" + GENOME[40:] + "\n>none\n>c2\nNNNN\n")
    spark.createDataFrame(signals, schemas.RAW_READS).write.parquet(str(d / "signals.parquet"))
    return d, made, signals


def test_fasta(spark, genome):
    assert rows(fasta.read_fasta(spark, str(genome[0] / "ref.fa"))) == [("c1", GENOME), ("c2", "NNNN")]
    parts = fasta.chunked(fasta.read_fasta(spark, str(genome[0] / "ref.fa")), 40, 10).filter("chr = 'c1'").orderBy("chunk").collect()
    assert [(p.at, len(p.seq)) for p in parts] == [(0, 50), (40, 50), (80, 13)]


def test_bam_and_sam_agree(spark, genome):
    d, made, _ = genome
    lines = ["@HD\tVN:1.6"]
    for r in made:
        tags = [f"{k}:{v[0]}:{v[1]}" if v[0] != "Bc" else f"{k}:B:c,{','.join(map(str, v[1]))}" for k, v in r["tags"].items()]
        lines.append("\t".join([r["read_id"], str(r["flag"]), r["chr"], str(r["pos0"] + 1), str(r["mapq"]), "".join(f"{n}{o}" for o, n in r["cigar"]), "*", "0", "0", r["seq"], r["qual"], *tags]))
    got_sam = sam.parse_sam(spark.createDataFrame([(x,) for x in lines], "value string")).drop("rnext", "pnext").orderBy("read_id").collect()
    got_bam = bam.read_bam(spark, str(d / "bam")).drop("rnext", "pnext").orderBy("read_id").collect()
    assert got_sam == got_bam and len(got_sam) == 3
    assert (got_bam[0].q_start, got_bam[0].q_len, got_bam[0].ref_end, got_bam[2].is_split, got_bam[2].parent_read) == (4, 68, 70, True, "parent")
    assert tuple(got_bam[0].moves[:2]) == (0, made[0]["tags"]["mv"][1][2:].index(1) + 1)


def _features(spark, genome, **kw):
    d = genome[0]
    return features.site_features(bam.read_bam(spark, str(d / "bam")), arrays.read_signals(spark, str(d / "signals.parquet")), fasta.read_fasta(spark, str(d / "ref.fa")), k=5, **kw)


def test_features_like_by_hand(spark, genome):
    got = {(r.read_id, r.pos): r for r in _features(spark, genome).collect()}
    want = {(r["read_id"], p): v for r in genome[1] for p, v in by_hand(r, genome[2], 5).items()}
    assert set(got) == set(want) and len(want) > 20
    for key, (kmer, feature) in want.items():
        assert got[key].kmer == kmer and np.allclose(got[key].signal, feature, atol=2e-4)
        assert GENOME[key[1]] == ("C" if got[key].strand == "+" else "G")


def test_features_with_labels(spark, genome):
    all_pos = sorted({r.pos for r in _features(spark, genome).collect()})
    kind = "chr string, pos int"
    pos, neg = spark.createDataFrame([("c1", p) for p in all_pos[:3]], kind), spark.createDataFrame([("c1", p) for p in all_pos[2:5]] + [("c9", 1)], kind)
    made = _features(spark, genome, labels=reads.truth_labels(pos, neg), round_digits=6)
    assert {(r.pos, r.label) for r in made.collect()} == {(p, int(i < 3)) for i, p in enumerate(all_pos[:5])}
    m = features.training_matrix(made, 4)
    assert {len(r.features) for r in m.collect()} == {20 * 5 + 1}
    s = features.split_features(m, 5).first()
    assert len(s.kmer) == 5 and len(s.signal) == 95
    c = features.crop_features(m, 5, 3)
    assert {len(r.features) for r in c.collect()} == {61}


def test_chunked_reference_agrees(spark, genome):
    d = genome[0]
    a, ref = bam.read_bam(spark, str(d / "bam")), fasta.read_fasta(spark, str(d / "ref.fa"))
    two = [rows(reads.join_reference(a, ref, n).select("read_id", "ref_seq")) for n in (1 << 20, 0)]
    assert two[0] == two[1] and len(two[0]) == 3


def test_matrices(spark, genome, tmp_path):
    m = features.training_matrix(_features(spark, genome).withColumn("label", F.lit(1)), 4)
    done = arrays.write_npz(m, str(tmp_path / "npz")).collect()
    assert done[0].rows == m.count()
    np.save(tmp_path / "npz" / "more.npy", np.ones((3, 101), np.float32))
    np.save(tmp_path / "npz" / "wide.npy", np.ones((3, 7), np.float32))
    (tmp_path / "npz" / "bad.npz").write_bytes(b"nothing")
    got = arrays.read_matrices(spark, str(tmp_path / "npz"), 5)
    assert got.count() == m.count() + 3
    assert {r.name for r in arrays.list_files(spark, str(tmp_path / "npz"), ".npz").collect()} == {"one.npz", "bad.npz"}


def test_matrix_files_are_cut(spark, tmp_path):
    made = spark.range(25).selectExpr("if(id < 20, 'a.pod5', null) as file_name", "lpad(id, 4, '0') as info", "array(cast(id as float), 0.5f) as features")
    got = rows(arrays.write_npz(made, str(tmp_path / "z"), most=8).select("path", "rows"))
    assert [(os.path.basename(p), n) for p, n in got] == [("a.npz", 8), ("a.part1.npz", 8), ("a.part2.npz", 4), ("none.npz", 5)]
    with np.load(tmp_path / "z" / "a.part1.npz") as f:
        assert f["features"][:, 0].tolist() == list(range(8, 16)) and bytes(f["site_infos"][0]) == b"0008"
    assert arrays.write_npz(made.limit(0), str(tmp_path / "none")).count() == 0


def test_matrix_commands(spark, genome, tmp_path):
    m = features.training_matrix(_features(spark, genome).withColumn("label", F.lit(1)), 4)
    arrays.write_npz(m, str(tmp_path / "npz")).collect()
    n = m.count()
    run = lambda name, *args: cli.COMMANDS[name][0](spark, cli.parser().parse_args([name, *map(str, args), "--kmer_size", "5"]))
    run("merge_npz", tmp_path / "npz", tmp_path / "merged", "--chunks", "3")
    assert sorted(os.listdir(tmp_path / "merged")) == [f"chunk{i}.npy" for i in range(3)] and sum(len(np.load(f)) for f in (tmp_path / "merged").iterdir()) == n
    run("combine", tmp_path / "npz", tmp_path / "merged", tmp_path / "both", "--chunks", "2")
    assert sum(len(np.load(f)) for f in (tmp_path / "both").iterdir()) == 2 * n
    run("extract_kmer", tmp_path / "npz", tmp_path / "short", "--new_kmer_size", "3")
    assert {np.load(f).shape for f in (tmp_path / "short").iterdir()} == {(n, 61)}


def test_bam_splits_and_sorted_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = [("z", 1_000_000), ("a", 500_000)]
    made = [
        {"read_id": f"r{i}", "flag": 4 if i % 50 == 0 else 0, "chr": "*" if i % 50 == 0 else names[i % 2][0], "pos0": -1 if i % 50 == 0 else int(rng.integers(0, 400_000)), "mapq": 60,
         "cigar": [] if i % 50 == 0 else [("M", 2000)], "seq": "".join(rng.choice(list("ACGT"), 2000)), "qual": None, "tags": {"fn": ("Z", "x" * (200_000 if i == 7 else 3))}}
        for i in range(600)
    ]
    bam.write_bam(str(tmp_path / "in.bam"), names, made)
    assert len(bam.splits(str(tmp_path / "in.bam"), 10_000)) > 10
    done = bam.write_sorted(bam.read_raw(spark, str(tmp_path / "in.bam")), bam.header_of(str(tmp_path / "in.bam")), str(tmp_path / "out"), 3).collect()
    assert sum(r.rows for r in done) == 600 and len(done) > 1
    files = sorted(r.path for r in done)
    assert all(os.path.exists(f + ".bai") for f in files) and sum(len(bam.splits(f, 20_000)) for f in files) > len(files) + 5
    load = lambda path, split: spark.read.format("bam").option("split", split).load(path).select("read_id", "flag", "chr", "pos0", "cigar", "seq")
    whole, small, again = (load(str(tmp_path / p), n) for p, n in (("in.bam", 64 << 20), ("out", 20_000), ("out", 64 << 20)))
    assert rows(whole) == rows(small) == rows(again) and small.rdd.getNumPartitions() > again.rdd.getNumPartitions() == len(files)
    order = [(r.chr is None, {"z": 0, "a": 1}.get(r.chr), r.pos0) for f in files for r in load(f, 64 << 20).collect()]
    assert order == sorted(order, key=lambda o: (o[0], o[1] or 0, o[2]))


def test_downsampled_bam(spark, genome, tmp_path):
    cli.down_sample(spark, cli.parser().parse_args(["down_sample", str(genome[0] / "bam"), str(tmp_path / "d"), "--cov", "5"]))
    assert rows(bam.read_bam(spark, str(tmp_path / "d" / "coverage5.bam")).select("read_id", "seq", "qual", "moves")) == rows(bam.read_bam(spark, str(genome[0] / "bam")).select("read_id", "seq", "qual", "moves"))


def test_scorers(spark, genome):
    f = _features(spark, genome)
    assert {round(r.methylation_rate, 6) for r in scoring.call_mods(f, scoring.ConstantScorer(0.25)).collect()} == {0.25}
    w = scoring.random_weights(hidden=8, seed=1)
    c = scoring.call_mods(f, scoring.BiLstmScorer(w), batch=7)
    assert c.dtypes == spark.createDataFrame([], schemas.CALLS).dtypes
    again = scoring.call_mods(f.repartition(3), scoring.BiLstmScorer(w), batch=1000)
    assert [(r[0], r[4], round(r[6], 5)) for r in rows(c)] == [(r[0], r[4], round(r[6], 5)) for r in rows(again)]
    full = scoring.random_weights()
    assert abs(sum(v.size for v in full.values()) - 5.36e6) < 5e4


def test_lstm_by_hand():
    w = {f"l.{a}_{b}_l0{t}": np.full(s, 0.3 + 0.1 * len(t)) for t in ("", "_reverse") for a, b, s in (("weight", "ih", (4, 1)), ("weight", "hh", (4, 1)), ("bias", "ih", (4,)), ("bias", "hh", (4,)))}
    sig = lambda v: 1 / (1 + math.exp(-v))
    for back, t in ((False, ""), (True, "_reverse")):
        k, h, c, want = 0.3 + 0.1 * len(t), 0.0, 0.0, []
        for x in ([2.0, 1.0] if back else [1.0, 2.0]):
            z = k * x + k * h + 2 * k
            c = sig(z) * c + sig(z) * math.tanh(z)
            h = sig(z) * math.tanh(c)
            want.append(h)
        got = scoring.bilstm(np.array([[[1.0], [2.0]]]), w, "l", 1)[0, :, int(back)]
        assert np.allclose(got, want[::-1] if back else want)


def test_training(spark):
    d = spark.range(1000).withColumn("name", F.col("id").cast("string"))
    c = training.chunk_of(d, "id", 10)
    assert {r.chunk for r in c.collect()} == set(range(10))
    f, g = (training.split(d, "id", e).filter("is_train") for e in (1, 2))
    assert 620 < f.count() < 780 and f.join(g, "id", "left_anti").count() > 100
    files = training.file_chunks(d.limit(25).select("name")).collect()
    assert sorted({r.chunk for r in files}) == list(range(9)) and len(files) == 25
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    rows_ = spark.createDataFrame([(v.tolist(), int(v[0] > 0)) for v in x], "features array<double>, label int")
    model = training.logistic_baseline(rows_)
    assert training.evaluate(model, rows_).first().accuracy > 0.95


def test_tables(spark, genome, tmp_path):
    c = scoring.call_mods(_features(spark, genome), scoring.ConstantScorer(0.1234567))
    tables.write_calls(c, str(tmp_path / "calls"))
    assert tables.read_calls(spark, str(tmp_path / "calls")).count() == c.count()
    text = "".join(open(os.path.join(tmp_path, "calls", f)).read() for f in os.listdir(tmp_path / "calls") if f.endswith(".csv"))
    assert "0.123457" in text and "reference_start" in text
    (tmp_path / "hc.tsv").write_text("chromosome\tpos\nc1\t5\tx\nc1\t5\ty\nc2\t7\n")
    assert rows(tables.read_hc_sites(spark, str(tmp_path / "hc.tsv"), 1)) == [("c1", 5, 1), ("c2", 7, 1)]
    assert rows(reads.truth_labels(spark.createDataFrame([("c", 5)], "chr string, pos int"), spark.createDataFrame([("c", 5), ("c", 9)], "chr string, pos int"))) == [("c", 5, 1), ("c", 9, 0)]


def test_streaming(spark, genome, tmp_path):
    f = _features(spark, genome).withColumn("label", F.lit(None).cast("int")).drop("file_name")
    f.repartition(3).write.parquet(str(tmp_path / "in"))
    src = streams.stream_features(spark, str(tmp_path / "in"), f.schema, 1)
    q = streams.append(streams.call_stream(src, scoring.ConstantScorer(0.9)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == f.count()
    q = streams.append(streams.call_stream(src, scoring.ConstantScorer(0.9)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == f.count()


def test_command_line(spark, genome, tmp_path, capsys):
    d = genome[0]
    np.savez(tmp_path / "w.npz", **scoring.random_weights(hidden=8))
    cli.extract_and_call_mods(spark, cli.parser().parse_args(["extract_and_call_mods", str(d / "signals.parquet"), str(d / "bam"), str(d / "ref.fa"), str(tmp_path / "c"), str(tmp_path / "w.npz"), "--kmer_size", "5"]))
    assert "1 signal files, 3 reads, " in capsys.readouterr().out
    cli.detail_aggregation(spark, cli.parser().parse_args(["detail_aggregation", str(tmp_path / "c"), "--aggregation_output", str(tmp_path / "s"), "--merge_strand", str(d / "ref.fa")]))
    assert tables.read_site_freq(spark, str(tmp_path / "s")).count() > 3
    assert set(cli.COMMANDS) >= {"extract_hc_sites", "extract_and_call_mods", "train"} and sq.MOTIFS
