"""Command line: the engine's entry points, each over paths that the cluster reads and writes."""

import argparse
import io
import os
import shlex

import numpy as np
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import bilstm, distance, features, metrics, reads, scoring, sites, training, validate
from .sources import arrays, bam, fasta, pod5, sam, tables


def _alignments(spark, path):
    return sam.read_sam(spark, path) if path.endswith(".sam") else spark.read.parquet(path) if path.endswith(".parquet") else bam.read_bam(spark, path)


def _signals(spark, path):
    return arrays.read_signals(spark, path) if path.endswith(".parquet") else pod5.read_pod5(spark, path)


def _report(written):
    """Runs a sink and shows its counts."""
    written.agg(F.countDistinct("path").alias("files"), F.sum("rows").alias("rows")).show()


def _matrices(rows, a, file_column="file_name"):
    """Rows of path, ord, features as .npy files named by a column, or as Parquet."""
    if a.form == "parquet":
        (rows.write.partitionBy(file_column) if file_column == "chunk" else rows.write).parquet(a.output)
    else:
        named = rows.withColumn("_name", F.format_string("chunk%d", "chunk") if file_column == "chunk" else F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.npy$", ""))
        _report(arrays.write_matrices(named, a.output, "_name", ["path", "ord"]))


def extract_hc_sites(spark, a):
    labels = reads.truth_labels(tables.read_hc_sites(spark, a.pos, 1), tables.read_hc_sites(spark, a.neg, 0))
    reference = fasta.read_fasta(spark, a.reference_path)
    made = features.site_features(_alignments(spark, a.bam_path), _signals(spark, a.pod5_dir), reference, a.motif_type, a.loc_in_motif, a.kmer_size, labels, round_digits=6)
    width = fasta.max_name_length(reference).first()[0] or 0
    matrix = features.training_matrix(made, width)
    matrix.write.partitionBy("file_name").parquet(a.write_dir) if a.form == "parquet" else _report(arrays.write_npz(matrix, a.write_dir))


def extract_and_call_mods(spark, a):
    aligned, found = Observation("reads"), Observation("features")
    whole = reads.counted(_alignments(spark, a.bam_path), "reads", aligned)
    made = features.site_features(whole, _signals(spark, a.pod5_dir), fasta.read_fasta(spark, a.reference_path), a.motif_type, a.loc_in_motif, a.kmer_size, ledger=a.ledger or None)
    made = reads.counted(made, "features", found, files=F.approx_count_distinct("file_name"))
    tables.write_calls(scoring.call_mods(made, scoring.BiLstmScorer.load(a.module_path), a.batch_size), a.write_file)
    counts = aligned.get | found.get
    print(f"{counts['files']} signal files, {counts['reads']} reads, {counts['features']} features, at least {-(-counts['features'] // a.batch_size)} batches")
    if a.ledger and os.path.isdir(a.ledger):
        features.read_ledger(spark, a.ledger).groupBy("reason").count().orderBy("reason").show()


def _calls(spark, path):
    c = tables.read_calls(spark, path)
    return c.select("read_id", c.chromosome.alias("chr"), c.pos_in_strand.alias("pos"), c.methylation_rate.alias("prob"))


def detail_aggregation(spark, a):
    calls = _calls(spark, a.file_path)
    calls = sites.confident(calls, a.filter_ratio) if a.filter_ratio else calls
    found = sites.aggregate_sites(calls, a.threshold)
    if a.merge_strand and a.merge_program:
        motifs = sites.motif_bed(fasta.read_fasta(spark, a.merge_strand))
        sites.merge_by_program(motifs, found, shlex.split(a.merge_program)).write.mode("overwrite").text(a.aggregation_output)
        return
    if a.merge_strand:
        found = sites.merge_strands(sites.motif_bed(fasta.read_fasta(spark, a.merge_strand)), found)
    tables.write_tsv(found.orderBy("chr", "start"), a.aggregation_output)


def detail_dict(spark, a):
    pairs = validate.frequency_pairs(_calls(spark, a.file), tables.read_wgbs(spark, a.wgbs), a.threshold)
    validate.correlation_matrix(pairs).show()
    tables.write_tsv(pairs, a.output)


def f1_auc(spark, a):
    rows = metrics.labelled(metrics.join_truth(tables.read_wgbs(spark, a.wgbs), _calls(spark, a.calls)), a.pos, a.neg, a.label_cut)
    metrics.roc_auc(rows, 64).join(metrics.average_precision(rows, 64)).show()
    tables.write_tsv(metrics.sweep(rows).coalesce(1).orderBy("threshold"), a.output)


def roc_compare(spark, a):
    one, two = (metrics.balance(tables.read_threshold_metrics(spark, p)) for p in (a.metrics1, a.metrics2))
    metrics.compare_confidence(one, two).orderBy("level").show()


def distance_correlation(spark, a):
    got = distance.correlation(distance.pair_counts(tables.read_binary_calls(spark, a.file), a.max_distance))
    tables.write_tsv(distance.top_distances(got, a.dist_len) if a.dist_len else got.orderBy("distance"), a.output)


def down_sample(spark, a):
    binary = not a.bam.endswith((".sam", ".parquet"))
    whole = bam.read_raw(spark, a.bam) if binary else _alignments(spark, a.bam)
    for level, part in reads.coverage_series(whole, a.cov).items():
        if binary:
            text, names = bam.heads_of(a.bam)
            os.makedirs(a.output, exist_ok=True)
            path = f"{a.output}/coverage{level}.bam"
            print(f"{path}: {bam.write_one(part, names, path, text)} records")
        else:
            part.write.parquet(f"{a.output}/coverage={level}")


def validation(spark, a):
    names = reads.read_names(_alignments(spark, a.bam))
    calls = reads.semi_join_names(_calls(spark, a.detail), names)
    validate.downsample_curve(calls, tables.read_wgbs(spark, a.wgbs), a.cov, threshold=a.threshold).orderBy("coverage").show()


def merge_npz(spark, a):
    rows = arrays.read_matrices(spark, a.input, a.kmer_size)
    _matrices(training.chunk_of(rows.withColumn("_k", F.concat_ws("#", "path", "ord")), "_k", a.chunks).drop("_k"), a, "chunk")


def extract_kmer(spark, a):
    _matrices(features.crop_features(arrays.read_matrices(spark, a.input, a.kmer_size), a.kmer_size, a.new_kmer_size), a)


def combine(spark, a):
    rows = training.union_sources(arrays.read_matrices(spark, a.one, a.kmer_size), arrays.read_matrices(spark, a.two, a.kmer_size))
    if a.form == "parquet":
        training.shuffle_rows(rows, ["path", "ord"]).write.parquet(a.output)
    else:  # rows of both sources go to files, and to places in them, by their hash
        dealt = training.chunk_of(rows.withColumn("_k", F.concat_ws("#", "path", "ord")), "_k", a.chunks).withColumn("_name", F.format_string("combined%d", "chunk"))
        _report(arrays.write_matrices(dealt.withColumn("_h", training.hash_order(["_k"])), a.output, "_name", ["_h", "_k"]))


def train(spark, a):
    """A BiLSTM (its weights as a table, and as .npz for extract_and_call_mods), or with --model logistic the linear baseline."""
    rows = features.split_features(arrays.read_matrices(spark, a.input, a.kmer_size), a.kmer_size).withColumn("_k", F.concat_ws("#", "path", "ord"))
    if a.model == "bilstm":
        start = scoring.random_weights(hidden=a.hidden, branch_layers=a.branch_layers, joint_layers=a.joint_layers, seed=a.seed)
        state, seen = bilstm.train(rows, start, a.output, "_k", a.epochs, a.batch_size, a.rate, a.decay, dropout=a.dropout, seed=a.seed)
        for h in seen:
            print(", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in h.items()))
        _save_npz(spark, f"{a.output}/weights.npz", **state.weights)
        return
    rows = training.split(rows, "_k")
    model = training.logistic_baseline(rows.filter("is_train"), "signal")
    got = training.evaluate(model, rows.filter("not is_train"), "signal")
    got.show()
    training.save_if_better(model, got.first()["accuracy"], 0.0, a.output)
    _save_npz(spark, a.output.rstrip("/") + ".npz", weights=model.coefficients.toArray(), bias=model.intercept)


def _save_npz(spark, path, **arrays_):
    """To any file system that Spark writes."""
    held = io.BytesIO()
    np.savez(held, **arrays_)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()


# name: (function, arguments as (name, default, type); no default: required and in this order)
COMMANDS = {
    "extract_hc_sites": (extract_hc_sites, [("pod5_dir",), ("bam_path",), ("reference_path",), ("write_dir",), ("pos",), ("neg",), ("kmer_size", 51, int), ("motif_type", "CG", str), ("loc_in_motif", 0, int), ("form", "npz", str)]),
    "extract_and_call_mods": (extract_and_call_mods, [("pod5_dir",), ("bam_path",), ("reference_path",), ("write_file",), ("module_path",), ("kmer_size", 51, int), ("batch_size", 1024, int), ("motif_type", "CG", str), ("loc_in_motif", 0, int), ("ledger", "", str)]),
    "detail_aggregation": (detail_aggregation, [("file_path",), ("threshold", 0.5, float), ("aggregation_output", "detail_aggregation.txt", str), ("filter_ratio", 0.0, float), ("merge_strand", "", str), ("merge_program", "", str)]),
    "detail_dict": (detail_dict, [("file",), ("wgbs",), ("output",), ("threshold", 0.5, float)]),
    "f1_auc": (f1_auc, [("wgbs",), ("calls",), ("output",), ("pos", 1.0, float), ("neg", 0.0, float), ("label_cut", 0.5, float)]),
    "roc_compare": (roc_compare, [("metrics1",), ("metrics2",)]),
    "distance_correlation": (distance_correlation, [("file",), ("output",), ("dist_len", 0, int), ("max_distance", None, int)]),
    "down_sample": (down_sample, [("bam",), ("output",), ("cov", 60.0, float)]),
    "validation": (validation, [("bam",), ("detail",), ("wgbs",), ("cov", 60.0, float), ("threshold", 0.5, float)]),
    "merge_npz": (merge_npz, [("input",), ("output",), ("kmer_size", 51, int), ("chunks", 10, int), ("form", "npy", str)]),
    "combine": (combine, [("one",), ("two",), ("output",), ("kmer_size", 51, int), ("chunks", 10, int), ("form", "npy", str)]),
    "extract_kmer": (extract_kmer, [("input",), ("output",), ("kmer_size", 51, int), ("new_kmer_size", 13, int), ("form", "npy", str)]),
    "train": (train, [("input",), ("output",), ("kmer_size", 51, int), ("model", "bilstm", str), ("epochs", 25, int), ("batch_size", 1024, int), ("rate", 1e-3, float), ("decay", 0.4, float), ("dropout", 0.5, float), ("hidden", 256, int), ("branch_layers", 2, int), ("joint_layers", 3, int), ("seed", 71, int)]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="porelake")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, args) in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a[0]) if len(a) == 1 else p.add_argument(f"--{a[0]}", default=a[1], type=a[2])
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"porelake {args.command}").getOrCreate()
    COMMANDS[args.command][0](spark, args)


if __name__ == "__main__":
    main()
