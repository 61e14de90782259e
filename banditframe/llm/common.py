"""What the training-data operators share: the written table that cuts lineage, and word counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from banditframe.plans.tables import cut, shared_dir, table

__all__ = ["WORD", "cut", "n_words", "shared_dir", "table"]

#: A word, as every contract of this subpackage counts it: ASCII white space separates, nothing else does.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
