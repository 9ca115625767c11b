"""Keyed pseudo-random columns: HMAC-SHA256 from built-in functions, so everything stays in generated code."""

from __future__ import annotations

import hashlib
import hmac
import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 32


def generate_key() -> bytes:
    """32 bytes from the operating system; never a column, which could be evaluated twice."""
    return os.urandom(KEY_BYTES)


def save_key(key: bytes, path: str) -> None:
    Path(path).write_bytes(key)


def load_key(path: str) -> bytes:
    key = Path(path).read_bytes()
    if len(key) != KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes, this file {len(key)}")
    return key


def key_fingerprint(key: bytes) -> str:
    return key[:4].hex()


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 (RFC 2104)."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_hex(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary column."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def u64(number: Column) -> Column:
    """Eight big-endian bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def unit(digest: Column, at: int) -> Column:
    """Eight bytes of a hex digest, from byte ``at``, as a number in [0, 1]."""
    return F.conv(F.substring(digest, 2 * at + 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def prf_coordinates(key: bytes, index: Column, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> Column:
    """struct<x,y> inside (x_min, y_min, x_max, y_max) for each index."""
    d = hmac_hex(key, u64(index))
    return F.struct((F.lit(box[0]) + unit(d, 0) * (box[2] - box[0])).alias("x"), (F.lit(box[1]) + unit(d, 8) * (box[3] - box[1])).alias("y"))


def keyed_phase(key: bytes, face: Column, k: Column) -> Column:
    """Phase in [0, 2 pi] of component k of a face's outline."""
    return F.lit(2.0) * F.pi() * unit(hmac_hex(key, F.concat(u64(face), u64(k))), 0)


def checksum(key: bytes, graph_hash: str, attribute_hash: str) -> str:
    return hmac.new(key, f"{graph_hash}|{attribute_hash}".encode(), hashlib.sha256).hexdigest()


def checksum_column(key: bytes, graph_hash: Column, attribute_hash: Column) -> Column:
    return hmac_hex(key, F.concat_ws("|", graph_hash, attribute_hash).cast("binary"))


def verify_checksum(key: bytes, graph_hash: str, attribute_hash: str, given: str) -> bool:
    return hmac.compare_digest(checksum(key, graph_hash, attribute_hash), given)
