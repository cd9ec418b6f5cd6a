"""Keyed hashes as column expressions: surrogates and draws that repeat for one key and can't be guessed without it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(key: bytes) -> tuple[str, str]:
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text's UTF-8 bytes, as lower-case hex."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def keyed_int(mac: Column, at: int | Column = 0) -> Column:
    """A number from 0 to 2**28 - 1 from the hex digits of a MAC, seven from position ``at`` on."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.conv(mac.substr(place + 1, F.lit(7)), 16, 10).cast("long")


def pick(pool: list[str], number: Column) -> Column:
    """An entry of a fixed pool."""
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (F.pmod(number, F.lit(len(pool))) + 1).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), in which ``value`` is computed once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def subkey(key: bytes, label: str) -> bytes:
    """A key for one purpose."""
    import hashlib
    import hmac

    return hmac.new(key, label.encode(), hashlib.sha256).digest()
