"""Signatures and encryption with the JVM's own functions; no Python runs on rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Lower-case hex HMAC-SHA-256 (RFC 2104) of a binary or string column."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signing_base(topic: Column, seq: Column, wire: Column, publisher: Column | None = None) -> Column:
    """What is signed: topic, a zero byte, the number and the message's bytes; a publisher stands between two more zero bytes."""
    zero = F.lit(bytearray(1))
    who = [] if publisher is None else [zero, publisher.cast("binary"), zero]
    return F.concat(topic.cast("binary"), zero, seq.cast("string").cast("binary"), *who, wire.cast("binary"))


def key_active(retired_at_ms: int | None, now_ms: int, grace_ms: int) -> bool:
    """A retired key still verifies until the end of its grace, included."""
    return retired_at_ms is None or now_ms - retired_at_ms <= grace_ms


def _by_key(kid: Column, keys: dict, make) -> Column:
    got = F.lit(None)
    for name, secret in keys.items():
        got = F.when(kid == name, make(secret)).otherwise(got)
    return got


def verify(message: Column, kid: Column, signature: Column, keys: dict[str, bytes]) -> Column:
    """Whether the signature is the named key's; false for a missing or malformed one and an unknown key."""
    return F.coalesce(signature.rlike("^[0-9a-f]{64}$") & (_by_key(kid, keys, lambda s: hmac_sha256(message, s)) == signature), F.lit(False))


def encrypt(text: Column, key: bytes) -> Column:
    """AES-GCM with a random initial vector before, and a tag behind, the cipher text."""
    return F.aes_encrypt(text, F.lit(bytearray(key)), F.lit("GCM"))


def decrypt(data: Column, kid: Column, keys: dict[str, bytes]) -> Column:
    """The text under the named key; null if the key isn't held any more or the data was tampered with."""
    return _by_key(kid, keys, lambda k: F.try_aes_decrypt(data, F.lit(bytearray(k)), F.lit("GCM")).cast("string"))
