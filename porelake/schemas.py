"""Schemas of the engine's tables. Coordinates are 0-based and half-open; an unknown value is null."""

CIGAR = "array<struct<op: tinyint, len: int>>"
RAW_READS = "file_name string, read_id string, signal array<smallint>, offset float, scale float"
ALIGNMENTS = (
    "read_id string, flag int, chr string, mapq int, ref_start int, ref_end int, ref_len int, q_start int, q_end int, q_len int, "
    f"cigar {CIGAR}, seq string, qual string, is_forward boolean, is_mapped boolean, is_split boolean, parent_read string, split int, "
    "num_samples int, trim_start int, stride int, moves array<int>, nm int, md string, file_name string, rnext string, pnext int, tlen bigint"
)
REFERENCE = "chr string, seq string"
HC_SITES = "chr string, pos int, label int"
CALLS = "read_id string, reference_start int, reference_end int, chromosome string, pos_in_strand int, strand string, methylation_rate float"
WGBS = "chr string, start int, end int, ratio double, cov int"
BINARY_CALLS = "read_name string, chrom string, pos int, prob int"
THRESHOLD_METRICS = (
    "threshold double, TP bigint, TN bigint, FP bigint, FN bigint, TPR double, FPR double, F1 double, Precision double, Accuracy double, Recall double, Specificity double"
)
SITE_FREQ = "chr string, start int, end int, frequency double, methy bigint, unmethy bigint"
FEATURES = "read_id string, ref_start int, ref_end int, chr string, pos int, strand string, kmer array<int>, signal array<float>, label int"
