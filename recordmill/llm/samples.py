"""Bounded samples that follow from the rows alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.session import materialize

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def smallest_hashes(df: DataFrame, rows: int, *order: str, also: Mapping[str, int] | None = None) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of the columns ``order``, repeated ones once.

    ``also`` names flags and how many of the rows with that flag are wanted besides.  Hashes
    are first cut where about four times as many different ones are left, so no task and not
    the driver gathers more than that.  Where the cut leaves too few, it is widened until
    there are enough or all rows are in.
    """
    wanted = [(F.lit(True), rows), *((F.coalesce(F.col(flag), F.lit(False)), n) for flag, n in (also or {}).items())]
    hashed = df.select("*", F.xxhash64(*order).alias("__hash"))
    found = hashed.agg(*[F.approx_count_distinct(F.when(flag, F.col("__hash"))) for flag, _ in wanted]).first()
    share = [4 * n / max(count, 1) for (_, n), count in zip(wanted, found, strict=True)]
    while True:
        bound = [_HIGH if s >= 1 else _LOW + int(s * (1 << 64)) for s in share]
        below = [flag & (F.col("__hash") <= b) for (flag, _), b in zip(wanted, bound, strict=True)]
        near = below[0]
        for more in below[1:]:
            near = near | more
        drawn = materialize(hashed.where(near).distinct(), "sample")
        found = drawn.agg(*[F.count_if(b) for b in below]).first()
        few = [s < 1 and count < n for s, (_, n), count in zip(share, wanted, found, strict=True)]
        if not any(few):
            break
        share = [s * max(4, 4 * n / max(c, 1)) if f else s for f, s, (_, n), c in zip(few, share, wanted, found, strict=True)]
    picked = drawn.where(below[0]).orderBy("__hash", *order).limit(rows)
    for part, (_, n) in zip(below[1:], wanted[1:], strict=True):
        picked = picked.unionByName(drawn.where(part).orderBy("__hash", *order).limit(n))
    return picked.distinct().orderBy("__hash", *order).drop("__hash")
