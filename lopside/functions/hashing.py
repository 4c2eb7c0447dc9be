"""Seeded, engine-independent ordering and uniform numbers.

Every random choice in the library is a function of (seed, key), so a result
does not depend on partitioning, on retries, or on the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part...`` as 32 hex digits."""
    pieces = [F.lit(str(seed))]
    for part in parts:
        column = F.col(part) if isinstance(part, str) else part
        pieces.append(column.cast("string"))
    return F.md5(F.concat_ws(":", *pieces))


def hash_to_int(digest: Column) -> Column:
    """The first 8 hex digits as a BIGINT."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_to_uniform(digest: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits."""
    return hash_to_int(digest) / F.lit(4294967296.0)
