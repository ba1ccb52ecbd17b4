"""Hashes, stable ids, deduplication keys and payload signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "0123456789ABCDEF"
_BLOCK_BYTES = 64


def hash_api_key(col: Column) -> Column:
    """SHA-256 of the UTF-8 text, lower-case hex."""
    return F.sha2(col.cast("binary"), 256)


def stable_id(*cols: Column) -> Column:
    """The same id for the same identifying values; nulls and shifted values do not collide."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in cols])).cast("binary"), 256)


def dedup_key(project_id: Column, service_id: Column, kind: str, when: Column) -> Column:
    """``project:service:kind:instant``."""
    return F.concat_ws(
        ":",
        F.coalesce(project_id.cast("string"), F.lit("null")),
        F.coalesce(service_id, F.lit("null")),
        F.lit(kind),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )


def _xor_hex(hex_text: Column, mask: int) -> Column:
    """XOR every byte of an upper-case hex text of one block with a constant byte."""
    high = "".join(_HEX[i ^ (mask >> 4)] for i in range(16))
    low = "".join(_HEX[i ^ (mask & 15)] for i in range(16))

    def one_byte(i: Column) -> Column:
        return F.concat(
            F.translate(F.substring(hex_text, i * 2 + 1, F.lit(1)), _HEX, high),
            F.translate(F.substring(hex_text, i * 2 + 2, F.lit(1)), _HEX, low),
        )

    indexes = F.sequence(F.lit(0), F.lit(_BLOCK_BYTES - 1))
    return F.array_join(F.transform(indexes, one_byte), "")


def hmac_pads(secret: Column) -> tuple[Column, Column]:
    """Inner and outer HMAC-SHA256 key pads as binary: one evaluation per secret, not per payload."""
    raw = secret.cast("binary")
    key = F.when(F.octet_length(raw) > _BLOCK_BYTES, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    block = F.rpad(F.hex(key), 2 * _BLOCK_BYTES, "0")
    return F.unhex(_xor_hex(block, 0x36)), F.unhex(_xor_hex(block, 0x5C))


def hmac_sha256(inner_pad: Column, outer_pad: Column, payload: Column) -> Column:
    """Hex HMAC-SHA256 from prepared pads."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, payload.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)
