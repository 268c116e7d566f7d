"""Text forms: fixed-width fields, keys, six-decimal numbers."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 10


def padded_number(value: Column, width: int = WIDTH) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def padded_name(name: Column, width) -> Column:
    return F.lpad(name, width, "_")


def site_key(chr_: Column, pos: Column, sep: str = "#") -> Column:
    return F.concat_ws(sep, chr_, pos.cast("string"))


def fixed_site_info(read_id: Column, ref_start: Column, ref_end: Column, chr_: Column, pos: Column, strand: Column, chr_width) -> Column:
    return F.concat_ws("\t", read_id, padded_number(ref_start), padded_number(ref_end), padded_name(chr_, chr_width), padded_number(pos), strand)


def tab_keys(values: Column) -> Column:
    """array of numbers -> one tab-separated string."""
    return F.concat_ws("\t", F.transform(values, lambda x: x.cast("string")))


def split_all(text: Column, sep: str) -> Column:
    """Parts between separators, empty ones too, the rest last."""
    return F.split(text, "\\Q" + sep + "\\E", -1)


def six_decimals(value: Column) -> Column:
    """A number as C's %f writes it. For sinks only: rounding of the exact binary value isn't what Spark's own formatter does."""

    def write(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else "%f" % v)

    return F.pandas_udf(write, "string")(value)
