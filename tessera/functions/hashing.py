"""Deterministic pseudo-randomness and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_mod(parts: list[Column | str], modulus: int) -> Column:
    """SHA-256 of the parts joined by '::', as a 256-bit number, modulo `modulus`.

    Horner's rule over the digest's eight 32-bit words keeps every step within a long."""
    digest = F.sha2(F.concat_ws("::", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)
    step = (1 << 32) % modulus
    acc = F.lit(0).cast("bigint")
    for i in range(8):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * F.lit(step) + word, F.lit(modulus))
    return acc


def hash_mod_sql(key: str, modulus: int) -> str:
    """The same for DuckDB; key: an expression of the joined parts."""
    step = (1 << 32) % modulus
    acc = "0"
    for i in range(8):
        acc = f"(({acc} * {step} + ('0x' || substr(sha256({key}), {8 * i + 1}, 8))::BIGINT) % {modulus})"
    return acc


def pool_pick(pool: list[str], parts: list[Column | str]) -> Column:
    """The element of a fixed list that the hash of the parts points at."""
    return F.element_at(F.array(*(F.lit(p) for p in pool)), (hash_mod(parts, len(pool)) + 1).cast("int"))


def uuid5(namespace: str, key: Column) -> Column:
    """A version-5 UUID of the key within a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def holdout(group: Column, percent: int, salt: str = "split") -> Column:
    """Whether a whole group falls in the held-out part, so that no group is on both sides."""
    return hash_mod([salt, group], 100) < percent
