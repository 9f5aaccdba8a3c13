"""Message wire format: varints, tags, length-delimited fields, base64.

Messages are put together in Arrow-batched functions, from plain bytes; ``varint`` is also a column.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

VARINT, BYTES = 0, 2


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_SHORT = [_varint(n) for n in range(1 << 10)]


def varint_bytes(n: int) -> bytes:
    """Base-128, low group first; a negative number takes ten bytes, as 64-bit two's complement."""
    return _SHORT[n] if 0 <= n < len(_SHORT) else _varint(n)


@functools.cache
def tag(number: int, kind: int) -> bytes:
    return varint_bytes(number << 3 | kind)


@functools.lru_cache(1 << 14)
def number_field(number: int, value: int | None, *, keep_zero: bool = False) -> bytes:
    """A varint field; None is absent, and so is 0 unless it has presence."""
    return b"" if value is None or not (value or keep_zero) else tag(number, VARINT) + varint_bytes(value)


def bytes_field(number: int, payload: bytes | str | None) -> bytes:
    """A length-delimited field, also when it is empty; None is absent."""
    if payload is None:
        return b""
    body = payload.encode() if isinstance(payload, str) else payload
    return tag(number, BYTES) + varint_bytes(len(body)) + body


def text_field(number: int, text: str | None) -> bytes:
    """A string without presence: the empty string is absent."""
    return bytes_field(number, text) if text else b""


def packed_field(number: int, values: Iterable[int | None] | None) -> bytes:
    """Packed varints; an empty list is absent, and so is one with a missing value."""
    values = list(values or ())
    return b"" if not values or None in values else bytes_field(number, b"".join(map(varint_bytes, values)))


def varint(value: Column) -> Column:
    """``varint_bytes`` as a column expression."""
    v = value.cast("bigint")
    last = F.floor((F.length(F.bin(v)) - 1) / 7).cast("int")
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    group = lambda i: F.call_function("shiftrightunsigned", v, i * 7).bitwiseAND(F.lit(127))
    long = F.aggregate(F.sequence(F.lit(0), last), F.lit(b""), lambda out, i: F.concat(out, byte(group(i) + F.when(i < last, F.lit(128).cast("bigint")).otherwise(F.lit(0).cast("bigint")))))
    return F.when((v >= 0) & (v < 128), byte(v)).otherwise(long)


def base64_standard(data: Column) -> Column:
    """Padded, and never broken into lines, whatever the session's setting is."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def base64_url(data: Column) -> Column:
    """URL-safe without padding."""
    return F.translate(F.rtrim(base64_standard(data), F.lit("=")), "+/", "-_")
