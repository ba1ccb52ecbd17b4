"""WARC round trips and packing."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparklog.llm import packing, warc
from sparklog.llm.queries import token_file


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "ü<p>" + "x" * 1500, "y" * 3000
    rows = [(1, "http://a/1", big), (2, "http://a/2 b\r\nX: y", big), (3, None, big), (4, "http://a", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (3, "again", big), (9, "é", "z" * 300_000),
            (None, None, "w" * 1200), (None, None, "w" * 1200)]
    return rows, spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(pages):
    rows, frame = pages
    latest = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            latest[html] = max(latest.get(html, page_id), page_id)
    want = Counter()
    for page_id, _, html in rows:
        data, last = (html or "").encode(), latest.get(html)
        refers = last if last is not None and (page_id is None or page_id < last) else None
        want[page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers, True] += 1
    got = Counter(tuple(r) for r in warc.round_trip(frame).collect())
    assert got == want
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_payloads_come_back_whole(pages, tmp_path):
    rows, frame = pages
    manifest = warc.write_archives(warc.classify(frame), f"file://{tmp_path}/warc")
    found = warc.read_archives(manifest, with_payload=True).collect()
    whole = Counter(bytes(r.payload) for r in found if r.record_type == "response")
    assert set(whole) == {(r[2] or "").encode() for r in rows}
    assert sum(m.records for m in manifest.collect()) == len(rows) == len(found)


def test_records_are_members_and_damage_is_found():
    a, b = warc.record(1, "http://a", b"p" * 5000, None), warc.record(2, None, b"q", 1)
    plain = gzip.decompress(a + b)
    assert plain.count(b"WARC/1.1\r\n") == 2
    assert [r["record_type"] for r in warc.read_stream(io.BytesIO(a + b))] == ["response", "revisit"]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_stream(io.BytesIO(a[:-9])))
    changed = gzip.compress(gzip.decompress(a).replace(b"pppp", b"pppq", 1))
    assert not next(iter(warc.read_stream(io.BytesIO(changed))))["verified"]
    longer = gzip.compress(gzip.decompress(a) + b"more")
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.read_stream(io.BytesIO(longer)))


def test_records_of_other_writers():
    """A warcinfo record without digests, other digest algorithms, an HTTP record with one digest only."""
    def member(kind, block, *lines, content="application/http; msgtype=response"):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"Content-Type: {content}", *lines, f"Content-Length: {len(block)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody text"
    sha = __import__("base64").b32encode(hashlib.sha1(b"body text").digest()).decode()
    data = [member("warcinfo", b"software: x\r\n\r\nmore\r\n", content="application/warc-fields"), member("response", http, "WARC-Block-Digest: sha256:abc"),
            member("response", http, f"WARC-Payload-Digest: sha1:{sha}"), member("response", http, f"WARC-Payload-Digest: sha1:{'A' * 32}"),
            member("request", b"GET / HTTP/1.1\r\n\r\n"), member("metadata", b"", content="text/plain"), member("revisit", http, "WARC-Record-ID: <urn:x>")]
    found = list(warc.read_stream(io.BytesIO(b"".join(data)), with_payload=True))
    assert [(r["record_type"], r["payload_bytes"], r["verified"], r["payload"]) for r in found] == [
        ("warcinfo", 21, None, b"software: x\r\n\r\nmore\r\n"), ("response", 9, None, b"body text"), ("response", 9, True, b"body text"),
        ("response", 9, False, b"body text"), ("request", 0, None, b""), ("metadata", 0, None, b""), ("revisit", 9, None, None)]


def test_packing(docs, rows, empty):
    whole = Tokenizer.from_file(token_file())
    want = Counter()
    for doc_id, text, *_ in rows:
        want[doc_id, tuple([*whole.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    found = packing.pack(docs, token_file(), with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens].append(r)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]]))
        n = sum(r.length for r in own)
        assert n <= 2048 and {r.tier for r in own} == {n}
        padding, total = padding + (0 if n & (n - 1) == 0 else 2048 - n), total + n
    assert padding == 0 and total == sum(len(ids) * k for (_, ids), k in want.items())
    texts = defaultdict(list)
    for (doc_id, ids), copies in want.items():
        texts[doc_id, len(ids)].append((ids, copies))
    assert pieces.keys() == texts.keys()
    for key, own in pieces.items():
        assert len(texts[key]) == 1
        (ids, copies), = texts[key]
        times = np.zeros(len(ids), int)
        for r in own:
            assert tuple(r.ids) == ids[r.start: r.start + r.length]
            times[r.start: r.start + r.length] += 1
        assert (times == copies).all()
    assert packing.pack(empty, token_file()).count() == 0


def test_remembered_ids_equal_the_tokenizer(sf):
    import duckdb

    tokenizer, whole = packing.Tokenizer(token_file()), Tokenizer.from_file(token_file())
    assert tokenizer.by_chunk
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    texts += ["", "It's WE'LL don't  x\n\ny\tz", "a b", "İI ŉ ǅ ß ª²½", "…“quoted” — dash", "\x1c\x85x", "naïve é", "<|endoftext|> a",
              "#$%&&& 12345 a1b2", "日本語 テスト", "ΑΣ ΣΑΣ", "hello <|endoftext|> there <|startoftext|>", "<|ENDOFTEXT|> x", "a<b <|x|>", "q" * 5000 + " w"]
    for text in texts:
        want = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert tokenizer.encode(text) == want, text[:80]


def test_remembered_ids_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    tokenizer = packing.Tokenizer(token_file())
    for i in range(300):
        tokenizer.encode(f"word{i} and{i} " + "x" * 50_000)
        assert tokenizer.held <= 21_000 and sum(len(k) + len(v) for k, v in tokenizer.ids.items()) <= 21_000


def test_small_groups_are_carried_over(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    windows, left = packing.fill([(n, n, 0) for n in (2000, 1500, 700, 300, 200, 90, 40, 7)], packing.TIERS)
    assert all(tier == sum(p[0] for p in window) for tier, window in windows)
    rest = packing.ladder(left, 2048)
    assert sum(tier for tier, _ in windows + rest) == 2000 + 1500 + 700 + 300 + 200 + 90 + 40 + 7
    assert all(tier == sum(p[0] for p in window) and tier & (tier - 1) == 0 for tier, window in rest)
