"""Deterministic splits, buckets and keys from SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def _head(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10)


def unit_interval(key: Column, seed: int) -> Column:
    """The first eight bytes of SHA-256("seed:key") as a share of 2^64."""
    return _head(F.concat(F.lit(f"{seed}:"), key), 16).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_for(key: Column, seed: int = 42) -> Column:
    u = unit_interval(key, seed)
    return F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test")


def bucket_for(key: Column, buckets: int = 32) -> Column:
    return (_head(key, 8).cast("long") % buckets).cast("int")


def seed_for(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fingerprint(path: str, chunk: int = 8 << 20) -> str:
    """SHA-256 of a local file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(chunk):
            h.update(piece)
    return h.hexdigest()
