"""Abundance annotations of headers, and headers as the outputs print them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNDERSCORE = r"(?s)_[0-9]{0,20}\z"
_SIZE = r"(?s)^(.*?)(?:^|;)size=([0-9]+)(?:;|\z)(.*)\z"


def annotate(df: DataFrame, usearch: bool = False, header: str = "header") -> DataFrame:
    """Adds found (an annotation is there), number (its digits), before and after (the text around it), id and label.

    Plain style: the digits after the last underscore, 20 at most; no digits count as found. usearch style: the first
    size= field. id is what must be unique: the text before the annotation, or the one after it if it comes first.
    A null header is an empty one.
    """
    h = F.coalesce(F.col(header), F.lit(""))
    if usearch:
        found = h.rlike(_SIZE)
        number, before, after = (F.regexp_extract(h, _SIZE, k) for k in (2, 1, 3))
    else:
        found = h.rlike(_UNDERSCORE)
        number, before, after = F.substring_index(h, "_", -1), F.regexp_replace(h, _UNDERSCORE, ""), F.lit("")
    out = df.withColumns({
        "found": found,
        "number": F.when(found, number),
        "before": F.when(found, before).otherwise(h),
        "after": F.when(found, after).otherwise(F.lit("")),
    })
    both = F.when((F.col("before") != "") & (F.col("after") != ""), ";").otherwise("")
    return out.withColumns({"id": F.when(F.col("before") != "", F.col("before")).otherwise(F.col("after")), "label": F.concat("before", both, "after")})


def printed(usearch: bool, appended: Column, header: Column, abundance: Column) -> Column:
    """The header with its abundance, appended where it had none."""
    number = abundance.cast("string")
    return F.when(appended, F.concat(header, F.lit(";size="), number, F.lit(";")) if usearch else F.concat(header, F.lit("_"), number)).otherwise(header)


def renumbered(usearch: bool, before: Column, after: Column, abundance: Column) -> Column:
    """The header with another abundance in place of its own."""
    number = abundance.cast("string")
    if not usearch:
        return F.concat(before, F.lit("_"), number)
    return F.concat(before, F.when(before != "", ";").otherwise(""), F.lit("size="), number, F.lit(";"), after)
