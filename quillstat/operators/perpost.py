"""Per-post values on comment rows without gathering a post in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts a post's comments are dealt to when a per-post table is joined on.
PARTS = 32


def per_post(df: DataFrame, table: DataFrame, how: str = "left", parts: int = PARTS, on: tuple[str, ...] = ("post_id",), salt_by: str | None = None) -> DataFrame:
    """Join ``table`` (one row per ``post_id``, or per other ``on``) onto the comments ``df``.

    The per-post rows are repeated for ``parts`` salts and each comment takes
    the salt of its id (other rows that of their column ``salt_by``), so the comments of one busy post spread over as many
    tasks.  Where the table is small enough, Spark broadcasts it instead.
    """
    salt = F.pmod(F.xxhash64(salt_by or ("cid" if "cid" in df.columns else "comment_id")), F.lit(parts)).cast("int")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return df.withColumn("_salt", salt).join(spread, [*on, "_salt"], how).drop("_salt")
