"""Text normalisation and the hash order used for reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s cover every Unicode space; the four ASCII separators are
# whitespace for the reference's text rules but not for the JVM.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def collapse_whitespace(text: Column) -> Column:
    """Every whitespace run becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def sample_hash(seed: int, row_id: Column) -> Column:
    """Uniform, partition-independent order of rows: md5 of ``seed:id``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))
