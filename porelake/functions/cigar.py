"""CIGAR functions over array<struct<op, len>>; operations are numbered M0 I1 D2 N3 S4 H5 P6 =7 X8."""

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"
_REF, _QUERY = (0, 2, 3, 7, 8), (0, 1, 7, 8)


def parse_cigar(text: Column) -> Column:
    """`5S10M` -> array of (op, len); other text gives an empty array."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)),
        lambda t: F.struct((F.instr(F.lit(OPS), F.right(t, F.lit(1))) - 1).cast("tinyint").alias("op"), F.left(t, F.length(t) - 1).cast("int").alias("len")),
    )


def op_sum(cigar: Column, ops: tuple[int, ...]) -> Column:
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin(*ops)), F.lit(0), lambda a, c: a + c["len"])


def op_sums(cigar: Column, *kinds: tuple[int, ...]) -> Column:
    """op_sum() of several sets of operations in one walk: struct(s0, s1, ...)."""
    none = F.struct(*(F.lit(0).alias(f"s{i}") for i in range(len(kinds))))
    return F.aggregate(cigar, none, lambda a, c: F.struct(*((a[f"s{i}"] + F.when(c["op"].isin(*ops), c["len"]).otherwise(0)).alias(f"s{i}") for i, ops in enumerate(kinds))))


def reference_length(cigar: Column) -> Column:
    return op_sum(cigar, _REF)


def identity(cigar: Column, nm: Column, match_ops: tuple[int, ...] = (0,)) -> Column:
    """(matches - edit distance) / aligned; 0 where the edit distance is unknown (-1 or null), null where nothing is aligned.

    Only M counts as a match, unless match_ops says otherwise."""
    align = op_sum(cigar, tuple({*match_ops, 1, 2}))
    return F.when(F.coalesce(nm, F.lit(-1)) == -1, F.lit(0.0)).otherwise(F.try_divide((op_sum(cigar, match_ops) - nm).cast("double"), align.cast("double")))


def coverage(cigar: Column, q_len: Column, match_ops: tuple[int, ...] = (0,)) -> Column:
    """Matches / aligned length of the query; -1 where that is 0."""
    return F.when(q_len == 0, F.lit(-1.0)).otherwise(F.try_divide(op_sum(cigar, match_ops).cast("double"), q_len.cast("double")))


def query_start(cigar: Column) -> Column:
    """Length of a leading soft clip, or 0."""
    return F.when(F.get(cigar, F.lit(0))["op"] == 4, F.get(cigar, F.lit(0))["len"]).otherwise(0)


def query_end(cigar: Column, seq_len: Column) -> Column:
    last = F.get(cigar, F.size(cigar) - 1)
    return seq_len - F.when((last["op"] == 4) & (seq_len > 0), last["len"]).otherwise(0)


def ref_to_query(cigar: Column, is_forward: Column) -> Column:
    """For each reference base the position in the query that it is aligned to, from the first aligned base, and at the end the length
    of the query's aligned part. A deleted base has the position of the next query base. Reverse reads are read from their end."""
    ordered = F.when(is_forward, cigar).otherwise(F.reverse(cigar))
    step = lambda a, c: F.struct(
        F.concat(a["starts"], F.array(a["q"])).alias("starts"), (a["q"] + F.when(c["op"].isin(*_QUERY), c["len"]).otherwise(0)).alias("q")
    )
    walked = F.aggregate(ordered, F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("q")), step)
    none = F.array().cast("array<int>")
    run = lambda c, q: (
        F.when((c["len"] > 0) & c["op"].isin(0, 7, 8), F.sequence(q, q + c["len"] - 1)).when(c["op"].isin(2, 3), F.array_repeat(q, c["len"])).otherwise(none)
    )
    return F.transform(
        F.array(F.struct(ordered.alias("c"), walked.alias("w"))),
        lambda x: F.concat(F.flatten(F.zip_with(x["c"], x["w"]["starts"], run)), F.array(x["w"]["q"])),
    )[0]
