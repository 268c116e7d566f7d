"""Sequence functions: motifs, complements, base codes, k-mers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A base's code is its place in this alphabet (U is T's in RNA).
ALPHABET = "ACGTNWSMKRYBVDHZ"
# Bases and their complements; the others are their own.
PAIRS = ("ACGTMKRYBVDH", "TGCAKMYRVBHD")
# Motifs by type.
MOTIFS = {
    "C": ("C",),
    "CG": ("CG",),
    "CHG": ("CAG", "CCG", "CTG"),
    "CHH": ("CAA", "CAC", "CAT", "CCA", "CCC", "CCT", "CTA", "CTC", "CTT"),
}


def motif_set(kind: str) -> tuple[str, ...]:
    if kind not in MOTIFS:
        raise ValueError(f"unknown motif type {kind!r}; one of {', '.join(MOTIFS)}")
    return MOTIFS[kind]


def _rna(text: str, rna: bool) -> str:
    return text.replace("T", "U") if rna else text


def complement(seq: Column, rna: bool = False) -> Column:
    return F.translate(seq, _rna(PAIRS[0], rna), _rna(PAIRS[1], rna))


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def complement_base(base: Column) -> Column:
    """A base's complement; N for what isn't a base."""
    return F.when((F.length(base) == 1) & (F.instr(F.lit(ALPHABET), base) > 0), complement(base)).otherwise("N")


def bases(seq: Column) -> Column:
    """Array of a sequence's characters; empty for the empty sequence."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def base_codes(seq: Column, rna: bool = False) -> Column:
    """Codes of a sequence's bases; null where a letter isn't in the alphabet."""
    return F.transform(bases(seq), lambda c: F.nullif(F.instr(F.lit(_rna(ALPHABET, rna)), c), F.lit(0)) - 1)


def motif_offsets(seq: Column, kind: str, loc: int = 0) -> Column:
    """0-based offsets i + loc of all places i, overlapping ones too, where a motif of this kind stands."""
    motifs = motif_set(kind)
    n = len(motifs[0])
    chars = bases(seq)
    at = lambda a, i: F.concat(*(F.get(a, i + j) for j in range(n)))
    places = F.when(F.length(seq) >= n, F.sequence(F.lit(0), F.length(seq) - n)).otherwise(F.array().cast("array<int>"))
    # the characters are split once for each row and then read by index
    found = F.transform(F.array(chars), lambda a: F.filter(places, lambda i: at(a, i).isin(*motifs)))[0]
    return F.transform(found, lambda i: i + loc)


def kmer_at(seq: Column, offset: Column, k: int) -> Column:
    """The k bases centred on offset."""
    return F.substring(seq, offset - (check_odd(k) - 1) // 2 + 1, F.lit(k))


def check_odd(k: int) -> int:
    if k % 2 == 0:
        raise ValueError(f"the k-mer size must be odd, not {k}")
    return k


def window_fits(seq: Column, offset: Column, k: int) -> Column:
    half = (check_odd(k) - 1) // 2
    return (offset >= half) & (offset + half < F.length(seq))


def centre_crop(values: Column, k: int, k_new: int) -> Column:
    """Elements (k - k_new) / 2 to (k + k_new) / 2 of an array of k."""
    return F.slice(values, (k - k_new) // 2 + 1, k_new)
