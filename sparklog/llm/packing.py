"""Hierarchical multi-length packing of tokenised documents.

Documents are cut at the longest context and the rest is routed to the tier of the smallest context that holds it. Each
tier is packed from the longest down: a document opens a window of its tier, shorter ones fill the gap, the longest that
fits first, and the last gap is closed with the head of the shortest one. So every sequence is exactly as long as its
tier. Tasks work on the documents as they are read, a bounded group at a time, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that a task packs together, and tokens of a step group.
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 64 * 2048
#: Bytes of chunks and ids that a worker remembers, and characters of a remembered chunk.
REMEMBERED, CHUNK = 128 << 20, 40
#: The split pattern of the tokenizer that the remembered path knows; fixed values.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that no normaliser composes, expands or takes for a space: Latin letters, digits, signs, ASCII space.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ňŊ-ɏ]*")


class Tokenizer:
    """Ids as little-endian unsigned 32-bit bytes, END_ID included.

    No token of a lower-casing word tokenizer spans white space, so the ids of each chunk between spaces are remembered.
    Texts with characters outside PLAIN or with a special token, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.held = 0
        with open(path) as file:
            spec = json.load(file)
        parts = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        added = {t["content"].lower() for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, sorted(added))), re.IGNORECASE) if added else None
        self.by_chunk = parts[:1] == [WORDS] and kinds == ["NFC", "Replace", "Lowercase"]
        self.end = array("I", [END_ID]).tobytes()

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, from one call on all of them: a token belongs to the chunk in which it starts."""
        encoded = self.whole.encode(" ".join(chunks), add_special_tokens=False)
        ids, starts = array("I", encoded.ids), [start for start, _ in encoded.offsets]
        found, at, place = [], 0, 0
        for chunk in chunks:
            place += len(chunk) + 1
            upto = bisect_left(starts, place, at)
            found.append(ids[at:upto].tobytes())
            at = upto
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or not PLAIN.fullmatch(text) or self.special and "<" in text and self.special.search(text):
            return self.encode_whole(text) + self.end
        known, chunks = self.ids, text.lower().split()
        found = list(map(known.get, chunks))
        if None in found:
            fresh = list({chunk for chunk, value in zip(chunks, found) if value is None})
            new = dict(zip(fresh, self.encode_chunks(fresh)))
            found = [new[chunk] if value is None else value for chunk, value in zip(chunks, found)]
            if self.held > REMEMBERED:
                known.clear()
                self.held = 0
            for chunk, value in new.items():
                if len(chunk) <= CHUNK:
                    known[chunk] = value
                    self.held += 200 + len(chunk) + len(value)  # with what a dictionary entry takes
        found.append(self.end)
        return b"".join(found)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def fill(pieces: list[tuple], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Packs pieces (length, number, start), all shorter than tiers[0], into full windows (tier, pieces); the second part
    is what is left for want of pieces."""
    rest, windows = sorted(pieces), []
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while rest and rest[-1][0] > below:
            window = [rest.pop()]
            room = tier - window[0][0]
            while room and rest:
                at = bisect_right(rest, (room, float("inf"))) - 1
                if at >= 0:
                    piece = rest.pop(at)
                else:
                    length, number, start = rest.pop(0)
                    piece = (room, number, start)
                    insort(rest, (length - room, number, start + room))
                window.append(piece)
                room -= piece[0]
            if room:
                return windows, window
            windows.append((tier, window))
    return windows, []


def ladder(pieces: list[tuple], longest: int) -> list[tuple[int, list[tuple]]]:
    """The last pieces of a task, cut into windows of powers of two, which need no padding."""
    windows, left = [], list(reversed(pieces))
    total = sum(p[0] for p in pieces)
    while total:
        tier = min(longest, 1 << (total.bit_length() - 1))
        window, room = [], tier
        while room:
            length, number, start = left.pop()
            taken = min(length, room)
            window.append((taken, number, start))
            if length > taken:
                left.append((length - taken, number, start + taken))
            room -= taken
        windows.append((tier, window))
        total -= tier
    return windows


def step_groups(lengths: list[int]) -> list[int]:
    """A group for each sequence, so that groups hold nearly equal tokens: the longest first, to the lightest group."""
    groups = [(0, g) for g in range(max(1, round(sum(lengths) / STEP_TOKENS)))]
    found = [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, group = groups[0]
        heapq.heapreplace(groups, (load + lengths[at], group))
        found[at] = group
    return found


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's length),
    step_group and, if asked, ids (the piece's token ids).

    Null texts are empty, and an empty text is its end id alone. Repeated rows are packed once each. Extra columns are
    not read; an empty table gives an empty result. Sequences are numbered by task, so a task that is run again gives
    the same rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, longest = tokenizer(path).encode, tiers[0]
        base = TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # number -> doc_id, ids
        pieces: list[tuple] = []
        whole: list[tuple[int, list[tuple]]] = []
        count = waiting = sequences = steps = 0

        def rows(windows: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
            nonlocal sequences, steps
            groups = step_groups([tier for tier, _ in windows])
            columns: list[list] = [[] for _ in range(10)]
            for (tier, window), group in zip(windows, groups):
                offset = 0
                for length, number, start in window:
                    doc_id, ids = held[number]
                    part = ids[4 * start: 4 * (start + length)]
                    values = (doc_id, start, length, zlib.crc32(part), len(ids) // 4, base + sequences, offset, tier,
                              base + steps + group, array("I", part) if with_ids else None)
                    for column, value in zip(columns, values):
                        column.append(value)
                    offset += length
                sequences += 1
            steps += max(groups, default=-1) + 1
            kinds = [kind, *[pa.int64()] * 8, pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.record_batch(arrays if with_ids else arrays[:-1], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "")
                held[count] = (doc_id, ids)
                n = len(ids) // 4
                cut = n - n % longest
                whole += [(longest, [(longest, count, at)]) for at in range(0, cut, longest)]
                if n > cut:
                    pieces.append((n - cut, count, cut))
                count, waiting = count + 1, waiting + n
                if waiting >= GROUP_TOKENS:
                    windows, pieces = fill(pieces, tiers)
                    yield rows(whole + windows)
                    held = {number: held[number] for _, number, _ in pieces}
                    whole, waiting = [], 0
        if held:
            windows, pieces = fill(pieces, tiers)
            yield rows(whole + windows + ladder(pieces, longest))

    kind_name = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    names += ["ids"] * with_ids
    schema = f"doc_id {kind_name}, " + ", ".join(f"{n} long" for n in names[1:9]) + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)

