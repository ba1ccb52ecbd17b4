"""Secret scans: lexical rules, and candidates that count only once their decoded structure is confirmed.

A base64 or hex run is reported if its bytes are a private key whose nested lengths agree: DER (RSA, elliptic curve, PKCS #8,
encrypted PKCS #8) or the OpenSSH key format. A dotted run is reported if it is a signed token: its header decodes to JSON
that names an algorithm, and the signature has that algorithm's length. An encoded run may also hold such a token as text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.llm.common import text_of

#: Kinds in the order in which spans that start together are listed; the first three are lexical.
KINDS = ("assign", "access", "hex", "token", "key")
BASE = KINDS[:3]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates: dotted runs, and base64 or hex runs, of which base64 may be broken into lines.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}")
BODY64 = re.compile(r"[A-Za-z0-9+/]+(?:\r?\n[A-Za-z0-9+/]+)*")
RUN16 = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{48,}|[0-9A-F]{48,})(?![0-9A-Za-z])")
BREAKS = re.compile(r"[\r\n]")
OPENSSH = b"openssh-key-v1\0"
#: No private key is longer; an encoded one is looked for in this many bytes from its first character.
MOST_KEY = 1 << 16
#: Bytes of a signature by algorithm; None: any length but zero.
SIGNATURE = {
    "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
    "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it is none."""
    plain = text.rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at ``at``, if it lies before ``end``."""
    if at + 2 > end:
        return None
    size, start = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size, start = int.from_bytes(data[start: start + n], "big"), start + n
        if size < 128 or size >> 8 * (n - 1) == 0:
            return None
    return (data[at], start, start + size) if start + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill ``at`` to ``end`` exactly."""
    found = []
    while at < end:
        one = element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def _algorithm(data: bytes, outer: tuple[int, int, int]) -> bool:
    """Whether an element is an algorithm identifier: a sequence that begins with an object identifier."""
    inner = elements(data, outer[1], outer[2]) if outer[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1] and len(inner) <= 2


def der_key(data: bytes) -> int | None:
    """The length of the DER private key that ``data`` begins with."""
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != 0x30:
        return None
    parts = elements(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [tag for tag, _, _ in parts]
    version = data[parts[0][1]: parts[0][2]] if tags[0] == 0x02 else None
    if version in (b"\0", b"\1") and tags[:9] == [0x02] * 9 and len(parts) <= 10:
        # RSA: modulus, exponents, primes; the primes are half as long as the modulus
        sizes = [end - start for _, start, end in parts]
        if sizes[1] >= 32 and sizes[3] > 0 and abs(sizes[1] - sizes[4] - sizes[5]) <= 2:
            return outer[2]
    if version in (b"\0", b"\1") and len(parts) >= 3 and _algorithm(data, parts[1]) and tags[2] == 0x04:
        return outer[2]
    if version == b"\1" and len(parts) >= 2 and tags[1] == 0x04 and 14 <= parts[1][2] - parts[1][1] <= 66 and set(
            tags[2:]) <= {0xA0, 0xA1} and len(parts) > 2:
        return outer[2]
    if len(parts) == 2 and _algorithm(data, parts[0]) and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 32:
        return outer[2]
    return None


def openssh_key(data: bytes) -> int | None:
    """The length of the OpenSSH private key that ``data`` begins with: cipher, derivation, its options, public keys, private part."""
    at = len(OPENSSH)
    if data[:at] != OPENSSH:
        return None

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at: at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size: at]

    if not string() or not string() or string() is None:
        return None
    n_keys = int.from_bytes(data[at: at + 4], "big")
    at += 4
    if not 1 <= n_keys <= 64 or any(not string() for _ in range(n_keys)) or not string():
        return None
    return at


def signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether three base64url parts are a token signed by the algorithm that its header names."""
    if not header.startswith("e"):  # base64 of '{'
        return False
    try:
        said = json.loads(unbase64(header) or b"")
        algorithm = said.get("alg") if isinstance(said, dict) else None
        if algorithm not in SIGNATURE:
            return False
        signed, content = unbase64(signature), unbase64(payload)
        if str(said.get("typ", "")).upper() == "JWT" and not isinstance(json.loads(content or b""), dict):
            return False
    except (ValueError, RecursionError):
        return False
    want = SIGNATURE[algorithm]
    return bool(signed) and content is not None and (want is None or len(signed) == want)


def inside(data: bytes) -> tuple[str, int] | None:
    """Kind and length of the secret that decoded bytes begin with."""
    size = der_key(data) or openssh_key(data)
    if size:
        return "key", size
    if data[:1] == b"e" and data.isascii():
        found = DOTTED.match(data.decode())
        if found and signed_token(*found.groups()):
            return "token", found.end()
    return None


def _promising(first: bytes | None) -> bool:
    return bool(first) and (first[0] == 0x30 or first.startswith(OPENSSH[:9]) or first[:2] == b"ey")


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the candidates whose structure is confirmed."""
    for found in DOTTED.finditer(text) if "." in text else ():
        if signed_token(*found.groups()):
            yield "token", found.start(), found.end()
    done = 0
    for found in RUN64.finditer(text):
        start = found.start()
        if start < done or not _promising(unbase64(found.group()[:24])):
            continue
        # one alphabet: plain base64 over several lines, or the URL form in one run
        url = "-" in found.group() or "_" in found.group()
        body = found.group()[: MOST_KEY * 3 // 2] if url else BODY64.match(text, start, start + MOST_KEY * 3 // 2).group()
        plain = BREAKS.sub("", body)
        secret = inside(unbase64(plain[: len(plain) // 4 * 4] if len(plain) % 4 == 1 else plain) or b"")
        if secret:
            left, done = -(-secret[1] * 4 // 3), start  # characters that hold the secret's bytes
            while left:
                left -= text[done] not in "\r\n"
                done += 1
            while text[done: done + 1] == "=":
                done += 1
            yield secret[0], start, done
    for found in RUN16.finditer(text):
        run = found.group()
        if _promising(bytes.fromhex(run[:20])):
            secret = inside(bytes.fromhex(run[: min(len(run) // 2, MOST_KEY) * 2]))
            if secret:
                yield secret[0], found.start(), found.start() + 2 * secret[1]


def lexical(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the spans of the lexical rules."""
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for found in ASSIGN.finditer(text):
            if len(found.group(2)) >= 12:
                yield "assign", found.start(), found.end()
    if "AKIA" in text:
        for found in ACCESS.finditer(text):
            yield "access", found.start(), found.end()
    for found in HEX.finditer(text):
        yield "hex", found.start(), found.end()


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind; equal spans once."""
    found = {*lexical(text), *confirmed(text)}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans`` (kind, start, end in code points, end exclusive).

    Null texts are empty. Rows are independent, so repeated rows give repeated results; whole texts are read, an empty table
    gives an empty result, extra columns are not read. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(text.as_py())] for text in batch.column("text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(found, kind)})

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("spans", SPANS)])
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan`: doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_token, n_key."""
    def counted(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(docs).select(
        "doc_id", *[counted(kind) for kind in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), counted("token"), counted("key"))
