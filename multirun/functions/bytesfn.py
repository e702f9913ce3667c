"""Lengths, run encodings, CRC-32C and the 16-digit key format."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def width(c: str | Column) -> Column:
    return F.octet_length(F.col(c) if isinstance(c, str) else c)


def varint_length(n: Column) -> Column:
    """Bytes of a 7-bit varint of ``n``."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def stored_length(n: Column) -> Column:
    """A value of ``n`` bytes with its length prefix."""
    return n + varint_length(n)


def digits16(n: Column) -> Column:
    """Sixteen decimal digits, so that text order is number order."""
    return F.lpad(n.cast("string"), 16, "0")


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value and the place after it; a cut-off varint is refused."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("varint ends early")
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def encode_run(values: list[bytes]) -> tuple[bytes, bool]:
    """A run and whether it is of one width, stored without prefixes."""
    widths = {len(v) for v in values}
    if len(widths) == 1 and 0 not in widths:
        return b"".join(values), True
    return b"".join(encode_varint(len(v)) + v for v in values), False


def decode_run(data: bytes, count: int, fixed: bool) -> list[bytes]:
    if fixed:
        w = len(data) // count if count else 0
        return [data[i * w : (i + 1) * w] for i in range(count)]
    out, at = [], 0
    for _ in range(count):
        n, at = decode_varint(data, at)
        out.append(data[at : at + n])
        at += n
    return out


#: The reflected polynomial of CRC-32C (Castagnoli); fixed by that checksum's definition.
CASTAGNOLI = 0x82F63B78


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


def crc32c(data: bytes, crc: int = 0, table: list[int] = _table()) -> int:
    """CRC-32C, resumable through ``crc``."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_combine(a: int, b: int, n: int, table: list[int] = _table()) -> int:
    """CRC-32C of two strings back to back, from their own and the second one's length: ``a`` is carried over ``n`` zero bytes by squaring."""
    # the effect of a zero byte on each bit, then of 2, 4, 8, ... of them
    step = [table[1 << i & 0xFF] ^ (1 << i) >> 8 for i in range(32)]

    def apply(m: list[int], x: int) -> int:
        out, i = 0, 0
        while x:
            if x & 1:
                out ^= m[i]
            x, i = x >> 1, i + 1
        return out

    while n:
        if n & 1:
            a = apply(step, a)
        step = [apply(step, x) for x in step]
        n >>= 1
    return a ^ b


#: Values still unfinished below which they are finished one by one.
FEW = 16


def crc32c_each(values: list[bytes]) -> list[int]:
    """CRC-32C of every value, a byte place of all of them at a time; longest first, so the unfinished ones stand in front."""
    size = np.asarray([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data, start = np.frombuffer(b"".join(values), np.uint8), (np.cumsum(size) - size)[order]
    longest, table = size[order], np.asarray(_table(), np.uint32)
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    at = 0
    while (n := int(np.searchsorted(-longest, -at, "left"))) >= FEW:
        c = crc[:n]
        crc[:n] = table[(c ^ data[start[:n] + at]) & 0xFF] ^ c >> 8
        at += 1
    crc ^= 0xFFFFFFFF
    out = np.empty(len(values), np.int64)
    out[order] = crc
    for k in order[:n].tolist():
        out[k] = crc32c(values[k][at:], int(out[k]))
    return out.tolist()


def crc32c_udf():
    """Column form, Arrow-batched; null stays null. Spark's own crc32 is another polynomial."""
    @F.pandas_udf("bigint")
    def f(s: pd.Series) -> pd.Series:
        found = iter(crc32c_each([bytes(v) for v in s if v is not None]))
        return pd.Series([None if v is None else next(found) for v in s], dtype="Int64")

    return f
