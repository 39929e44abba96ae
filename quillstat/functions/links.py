"""FN9: object id from a link, over a table of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import LINK_ID_PATTERNS, RAW_ID_PATTERN
from .text import stripped


def object_id(url) -> Column:
    """First matching URL shape wins; groups give '<group>_<post>'; a bare id passes."""
    u = stripped(url)
    out = None
    for pat, groups in LINK_ID_PATTERNS:
        if groups == 1:
            val = F.regexp_extract(u, pat, 1)
        else:
            val = F.concat_ws("_", F.regexp_extract(u, pat, 1), F.regexp_extract(u, pat, 2))
        hit = F.when(u.rlike(pat), val)
        out = hit if out is None else F.coalesce(out, hit)
    raw = F.when(u.rlike(RAW_ID_PATTERN), u)
    return F.when(F.coalesce(F.length(u), F.lit(0)) == 0, F.lit(None).cast("string")).otherwise(
        F.coalesce(out, raw))
