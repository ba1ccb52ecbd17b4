"""SimHash and line deduplication against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm.conftest import SCHEMA
from pyspark.sql import functions as F

from sparklog.llm import line_dedup, simhash


def plain_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(gap, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps, bits=4):
    """The index of the component of each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(docs, rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(fps)
    least = {}
    for (doc_id, *_), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = Counter((row[0], fp, least.get(r)) for row, fp, r in zip(rows, fps, roots))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert len(set(roots)) < len(set(fps))


def test_one_document_of_each_component_stays(docs, rows):
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    assert kept.count() == len(set(plain_components(fps)))
    found = {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}
    assert found <= {r.doc_id for r in kept.collect()}


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.distinct_documents(empty).columns == empty.columns
    assert line_dedup.repeated_spans(empty).count() == 0
    assert line_dedup.deduplicate(empty).columns == empty.columns


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_clustered_fingerprints(spark, bits):
    """Families of fingerprints a few bits apart: every link counts, chains included."""
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**63, 6)
    fps = {int(c) ^ (sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5)))) for c in centres for _ in range(60)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, bits)).collect()}
    want = plain_components(fps, bits)
    assert [roots.get(f, f) for f in fps] == [min(g for g, x in zip(fps, want) if x == w) for w in want]


def test_large_cells_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    fps = sorted({int(sum(1 << int(b) for b in rng.integers(0, 12, 3))) for _ in range(400)})
    rows = [pa.record_batch({"cell": pa.array([7] * len(part), pa.int64()), "fp": pa.array(part, pa.int64())})
            for part in (fps[:50], fps[50:])]
    blocks = pa.Table.from_batches(list(simhash._edges(iter(rows), 4))).to_pylist()
    passed = [r for r in blocks if r["cell"] is not None]
    assert sorted(r["a"] for r in passed) == fps
    assert max(Counter(r["block"] for r in passed).values()) <= 16
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    grid = simhash.grid
    monkeypatch.setattr(simhash, "grid", lambda n, b: grid(n, b).select("fp").distinct().select(F.lit(1).cast("long").alias("cell"), "fp"))
    monkeypatch.setattr(simhash, "_edges", _small_edges(simhash._edges))
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 2)).collect()}
    want = plain_components(fps, 2)
    assert [roots.get(f, f) for f in fps] == [min(g for g, x in zip(fps, want) if x == w) for w in want]


def _small_edges(edges):
    def run(batches, bits):
        from sparklog.llm import simhash as module

        module.BLOCK = 16
        return edges(batches, bits)
    return run


def test_components_of_long_chains(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in simhash.components(frame).collect()}
    assert roots == {**{i: 0 for i in range(1, n + 1)}, **{1000 + i: 1000 for i in range(1, 50)}}


def plain_clauses(text):
    """Clauses of a text as (start, end, words, whether a sentence ends), word by word."""
    found, start = [], 0
    for line in text.split("\n"):
        own, words, begin = [], [], 0
        for m in re.finditer(r"\S+", line):
            if not words:
                begin = m.start() if own else 0
            words.append(m.group().lower())
            if re.search("[.!?,;:][\"')\\]]*$", m.group()) and m.end() < len(line):
                own.append((begin, m.end(), words))
                words = []
        if words:
            own.append((begin, len(line), words))
        if own:
            own[-1] = (own[-1][0], len(line), own[-1][2])
        found += [(start + x, start + y, w, bool(re.search("[.!?][\"')\\]]*$", w[-1]))) for x, y, w in own]
        start += len(line) + 1
    return found


def plain_spans(rows, least=50):
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, spans = {}, []
    for none, doc_id, text in docs:
        run = []
        for unit, one in enumerate([*plain_clauses(text), None]):
            key = one and " ".join(one[2])
            if key is not None and key in seen and seen[key] != (none, doc_id, text, unit):
                run.append(one)
                continue
            n = sum(len(x[2]) for x in run)
            if n >= least or 2 * n >= least and sum(x[3] for x in run) >= 2:
                spans.append((None if none else doc_id, run[0][0], run[-1][1]))
            run = []
            if key is not None:
                seen.setdefault(key, (none, doc_id, text, unit))
    return Counter(spans)


def plain_cut(text, spans):
    """A text without its spans; each takes the white space after it, but no line break that parts what is left of two lines."""
    rest, at = "", 0
    for start, end in sorted(spans):
        rest += text[at:start]
        at = end if text[end: end + 1] == "\n" and start > 0 and text[start - 1] != "\n" else end + 1
    return rest + text[at:]


def punctuated(text):
    """The text with marks that follow from its words, so that equal passages stay equal."""
    marks = {"a": ",", "b": ".", "c": "?\"", "d": ";", "e": "...", "f": "!)", "g": ".x"}
    return text and re.sub(r"[a-p]+", lambda m: m.group() + (marks.get(m.group()[-1], "") if len(m.group()) % 2 else ""), text)


@pytest.fixture(scope="module")
def marked(spark, rows):
    """The corpus with punctuation, and near copies with a changed word."""
    own = [(r[0], punctuated(r[1]), *r[2:]) for r in rows]
    rng = random.Random(9)
    for i in range(40):
        words = rng.choice([r[1] for r in own[:120] if r[1] and len(r[1].split(" ")) > 60]).split(" ")
        words[rng.randrange(len(words))] = "changed"
        own.append((2000 + i, " ".join(words[rng.randrange(8):]), "en", "a", 0))
    return own, spark.createDataFrame(own, SCHEMA).repartition(3)


def test_spans_equal_brute_force(docs, rows, marked):
    for frame, own in ((docs, rows), (marked[1], marked[0])):
        got = Counter((r.doc_id, r.start, r.end) for r in line_dedup.repeated_spans(frame).collect())
        assert got == plain_spans(own)
        assert got
    texts = {r[0]: r[1] for r in marked[0]}
    assert any(len(texts[i][a:b].split()) < 50 for i, a, b in got), "no run of two sentences"
    assert any(a > 0 and texts[i][a - 1] != "\n" for i, a, b in got), "no passage inside a line"


def test_removed_text(docs, rows, marked):
    for frame, own in ((docs, rows), (marked[1], marked[0])):
        out = line_dedup.deduplicate(frame)
        assert out.columns == frame.columns
        cuts, want = defaultdict(list), Counter()
        by_text = defaultdict(set)
        for doc_id, start, end in plain_spans(own):
            cuts[doc_id].append((start, end))
        for doc_id, text, *_ in own:
            by_text[doc_id].add(text)
        for doc_id, text, *_ in own:
            assert len(by_text[doc_id]) == 1 or not cuts[doc_id]
            rest = None if text is None else plain_cut(text, cuts[doc_id])
            if not cuts[doc_id] or rest.split():
                want[doc_id, rest] += 1
        assert Counter((r.doc_id, r.text) for r in out.collect()) == want
        changed = [r for r in out.collect() if cuts.get(r.doc_id)]
        assert changed and all(r.n_chars == len(r.text) for r in changed)


def test_short_repeats_stay(spark):
    line = "one two three four"
    docs = spark.createDataFrame([(i, f"own {i}\n{line}\nother {i}", None, None, 0) for i in range(50)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert line_dedup.repeated_spans(docs).count() == 0
    assert line_dedup.repeated_spans(docs, 4).count() == 49


def test_passage_that_begins_inside_a_line_or_has_a_changed_word(spark):
    """Clauses are the unit: neighbours in the line and one changed word do not keep a repeated passage."""
    sentence = "They walked the long road to the {} market, bought seven sacks of grain, and came home before dark."
    passage = " ".join(sentence.format(w) for w in ("old", "new", "fish", "wool"))
    assert len(passage.split()) == 76
    changed = passage.replace("fish", "salt")
    texts = [passage, f"Own opening here. {passage} Own ending there.\nLast line.", f"{changed}\nSome tail.", f"Head one: {passage}\nTail."]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r.doc_id: [] for r in line_dedup.repeated_spans(docs).collect()}
    for r in line_dedup.repeated_spans(docs).orderBy("start").collect():
        spans[r.doc_id].append(texts[r.doc_id][r.start:r.end])
        assert r.kept_doc_id == 0 and r.lines == 1
    first, rest = changed.split(" They walked the long road to the salt market, ")
    assert spans == {1: [passage], 2: [first, rest], 3: [passage]}
    left = {r.doc_id: r.text for r in line_dedup.deduplicate(docs).collect()}
    assert left == {0: passage, 1: "Own opening here. Own ending there.\nLast line.",
                    2: "They walked the long road to the salt market, \nSome tail.", 3: "Head one: \nTail."}
