"""Control over what Spark computes more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns fixed as they are at this point.

    Spark moves a filter below the projection that computes its column and repeats the whole expression there.
    For expensive columns (parsed pages) that costs far more than it saves; a filter on a generated column stays
    above, so the expression runs once per row.
    """
    others = [name for name in df.columns if name not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names)))).select(*df.columns)
