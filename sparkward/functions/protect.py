"""Keyed pseudonyms, encryption, hash chains and deterministic random numbers as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: str) -> Column:
    """A number in 0..1 that depends on key and seed alone, with 52 random bits, kept off both ends."""
    bits = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + seed))), 1, 13), 16, 10).cast("long")
    return F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), bits.cast("double") / float(1 << 52)))


def hmac_sha256(key: bytes, value: Column) -> Column:
    """HMAC-SHA256 in hex of a text or binary column."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def encrypt(value: Column, key: bytes) -> Column:
    """AES-GCM ciphertext in base64; each call has its own initialization vector."""
    return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key)))


def decrypt(value: Column, key: bytes, strict: bool = False) -> Column:
    """The text of a ciphertext. What isn't one under this key is null, or an error if strict."""
    read = F.aes_decrypt if strict else F.try_aes_decrypt
    return read(F.unbase64(value), F.lit(key)).cast("string")


def pseudonym(value: Column, salt: bytes) -> Column:
    """A value's keyed pseudonym with what is needed to check it later: the salt in hex and the value's length in bytes."""
    return F.struct(hmac_sha256(salt, value).alias("pseudonym"), F.lit(salt.hex()).alias("salt"), F.octet_length(value).alias("original_length"))


def one_way(value: Column, salt: bytes = b"") -> Column:
    """SHA-256 in hex of a value, after a salt if there is one: the form of values that nobody needs to read again."""
    return F.sha2(F.concat(F.lit(salt), value.cast("binary")), 256)


def protected(value: Column, level: str, key: bytes, salt: bytes = b"") -> Column:
    """A value at a level of protection: UNPROTECTED stays, ENCRYPTED can be read with the key, PSEUDONYMIZED and ANONYMIZED are hashed (the former after a salt)."""
    made = {
        "UNPROTECTED": lambda: value.cast("string"), "ENCRYPTED": lambda: encrypt(value, key),
        "PSEUDONYMIZED": lambda: one_way(value, salt), "ANONYMIZED": lambda: one_way(value)
    }
    if level not in made:
        raise ValueError(f"unknown level {level}")
    return made[level]()


def signature(key: bytes, row_hash: Column) -> Column:
    return F.base64(F.unhex(hmac_sha256(key, row_hash)))


def laplace(u: Column, scale: Column) -> Column:
    """Laplace noise by the inverse of its distribution."""
    return -scale * F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5))


def gaussian(u: Column, v: Column, sigma: Column) -> Column:
    """Normal noise of two uniform numbers."""
    return sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
