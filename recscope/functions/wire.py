"""Values as the bytes of a record's payload, as Columns: the inverse of ``sources.values``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 127


def little_endian(value: Column, size: int) -> Column:
    """The low ``size`` bytes of a whole number, the lowest first; negative numbers as two's complement."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def double_bytes(value: Column) -> Column:
    return little_endian(F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double")).cast("bigint"), 8)


def text_bytes(text: Column) -> Column:
    """A text, or bytes, in pieces of up to 127 bytes after their lengths; the high bit of a length says that another piece follows."""
    data = text.cast("binary")
    pieces = F.greatest(F.ceil(F.octet_length(data) / PIECE), F.lit(1)).cast("int")

    def piece(k: Column) -> Column:
        own = F.substring(data, k * PIECE + 1, F.lit(PIECE))
        size = F.octet_length(own) + F.when(k < pieces - 1, 128).otherwise(0)
        return F.concat(F.lpad(F.hex(size.cast("bigint")), 2, "0"), F.hex(own))

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), pieces - 1), piece), ""))


def payload(log_id: Column, *values: Column) -> Column:
    """The payload of a record: its descriptor's number, then its values' bytes."""
    return F.concat(little_endian(log_id, 4), *values)
