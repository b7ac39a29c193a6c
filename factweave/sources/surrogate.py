"""Row identities for tables that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows and keep the numbered table in the shared folder.

    Numbers are unique, not gapless; they are computed once, in parallel, and
    read from then on, so a lost executor can't change them.
    """
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}")
    return materialise(df.select(F.monotonically_increasing_id().alias(name), "*"), name)
