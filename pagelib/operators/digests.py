"""Digests of row sets that combine map-side.

Each row hashes alone; the hashes add up exactly. Rows that carry their own
place (window and position, or rank) make the sum stand for the ordered list,
without any task holding the list.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PIECES = 4
_HEX = 15


def set_digest(*fields: Column) -> Column:
    """Aggregate: SHA-256 over the count and the summed row hashes."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + i * _HEX, _HEX), 16, 10).cast("decimal(38,0)"))
            for i in range(_PIECES)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[s.cast("string") for s in sums]), 256)
