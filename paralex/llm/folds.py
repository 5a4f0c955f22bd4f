"""The fold of a document, and bounded samples to learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 5
#: Shares are told apart down to one in this number.
_MARKS = 1_000_000_000_039


def held_out(doc_id: Column) -> Column:
    """Whether nothing may be learned from this row: crc32 of the id as text, modulo
    five, is zero.  A row without id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sampled(key: Column, share: float | Column, seed: int) -> Column:
    """About ``share`` of the keys, the same ones however the rows are dealt."""
    least = (F.least(F.lit(1.0), share) * _MARKS).cast("long") + 1 if isinstance(share, Column) else int(min(1.0, share) * _MARKS) + 1
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_MARKS)) < least
