"""Order-preserving encodings of typed values as binary keys: bytes compare as the values do."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = 1 << 63


def encode_long(x: int) -> bytes:
    return (x + SIGN).to_bytes(8, "big")


def decode_long(b: bytes) -> int:
    return int.from_bytes(b, "big") - SIGN


def encode_double(x: float) -> bytes:
    bits = int.from_bytes(struct.pack(">d", x), "big")
    return (bits ^ (2 * SIGN - 1) if bits & SIGN else bits | SIGN).to_bytes(8, "big")


def decode_double(b: bytes) -> float:
    bits = int.from_bytes(b, "big")
    return struct.unpack(">d", (bits & ~SIGN if bits & SIGN else bits ^ (2 * SIGN - 1)).to_bytes(8, "big"))[0]


def encode_text(x: str) -> bytes:
    """UTF-8 that may be followed by more parts: 00 becomes 00 FF, and 00 01 ends it."""
    return x.encode().replace(b"\x00", b"\x00\xff") + b"\x00\x01"


def decode_text(b: bytes) -> tuple[str, bytes]:
    """The text and what follows it."""
    at = 0
    while True:
        at = b.index(b"\x00", at)
        if b[at + 1] == 1:
            return b[:at].replace(b"\x00\xff", b"\x00").decode(), b[at + 2 :]
        at += 2


def long_key(c: Column) -> Column:
    """encode_long as a column expression."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-SIGN).cast("long"))), 16, "0"))


def text_key(c: Column) -> Column:
    """encode_text as a column expression."""
    pairs = F.regexp_extract_all(F.hex(c.cast("binary")), F.lit("(..)"), F.lit(1))
    out = F.array_join(F.transform(pairs, lambda p: F.when(p == "00", F.lit("00FF")).otherwise(p)), "")
    return F.unhex(F.concat(out, F.lit("0001")))
