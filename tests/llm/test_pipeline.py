"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from llm.test_dedup import plain_components, plain_cut, plain_fingerprint, plain_spans, punctuated
from llm.test_native import WORD, measured, plain_mix
from tokenizers import Tokenizer

from sparklog.llm import common
from sparklog.llm.queries import token_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    return "".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) + ("\n" if rng.random() < 0.08 else " ") for _ in range(n)).strip()


def texts():
    rng = random.Random(3)
    passage, rows = sentences(rng, 70).replace("\n", " "), []
    for i in range(60):
        text = sentences(rng, rng.randint(20, 300))
        if i % 6 == 4:
            text = rows[-2][1]
        if i % 6 == 5:
            text = f"{text}\n{passage}\n{sentences(rng, 60)}"
        text = punctuated(text) if i % 3 else text
        if i % 12 == 7:
            long = max(text.split("\n"), key=len)
            text = f"{long}\n{text}\n{long}" if i % 24 == 7 else f"Short line.\n{text}\nShort line."
        if i % 10 == 1:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", (None, "a", "b", "c")[i % 4 if i > 20 else 1], len(text)))
    return [*rows, (60, None, None, None, None), (61, "", "en", "a", 0)]


def plain(rows):
    def good(text):
        n, chars, symbols, _, repeated = measured(text)
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        letters, capitals = len(re.findall(r"[^\W\d_]", text or "")), sum(c.isupper() for c in text or "")
        whole, own = (len("".join(x)) for x in (lines, set(lines)))
        return not (n < 50 or 2 * repeated > n or not 2 * n <= chars <= 16 * n or 10 * symbols > n
                    or 100 * (whole - own) > 30 * whole or 2 * capitals > letters or 2 * letters < chars)

    rows = [r for r in rows if good(r[1])]
    roots, first = plain_components([plain_fingerprint(r[1]) for r in rows]), {}
    for row, root in zip(rows, roots):
        first[root] = min(first.get(root, row), row, key=lambda r: r[0])
    rows, cuts = list(first.values()), defaultdict(list)
    for doc_id, start, end in plain_spans(rows):
        cuts[doc_id].append((start, end))
    cut = []
    for doc_id, text, lang, source, _ in rows:
        rest = plain_cut(text, cuts[doc_id])
        if rest.split():
            cut.append((doc_id, rest, lang, source, len(rest)))
    size, target = plain_mix(cut)
    times, ahead = [], Counter()
    for r in sorted(cut, key=lambda r: hashlib.md5(f"{r[0]}:mix-1".encode()).hexdigest()):
        n = len(WORD.findall(r[1]))
        ahead[r[3]] += n
        times += [((e * size[r[3]] + ahead[r[3]]) / target[r[3]], n, r) for e in range(3)
                  if e * size[r[3]] + ahead[r[3]] - n < target[r[3]]]
    taken, total = Counter(), 0
    for _, n, r in sorted(times, key=lambda x: x[0]):
        total += n
        if total > sum(size.values()):
            break
        taken[r[0], r[1]] += 1
    return taken


def test_pipeline(spark, tmp_path, monkeypatch):
    rows = texts()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(common, "_OPEN", [f"file://{tmp_path}/shared"])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [f.name[:10] for f in (tmp_path / "shared").iterdir()] == ["pipeline-4"]  # no other table is left behind
    whole, want = Tokenizer.from_file(token_file()), Counter()
    for (doc_id, text), copies in plain(rows).items():
        want[doc_id, len(whole.encode(text, add_special_tokens=False).ids) + 1] += copies
    tokens = Counter()
    for r in found:
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert {k: n // k[1] for k, n in tokens.items()} == want
    assert len(want) < len(rows) and max(want.values()) > 1


def test_stages_keep_the_columns(spark, empty):
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["quality rules", "SimHash near-dedup"]
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == empty.columns


def test_sequences_hold_their_token_ids(spark):
    docs = spark.createDataFrame([(1, "some words to pack", "en", "a", 18)], SCHEMA)
    ids = Tokenizer.from_file(token_file()).encode("some words to pack", add_special_tokens=False).ids
    found = sorted(corpus_pipeline.sequences(spark, docs, "").collect(), key=lambda r: r.start)
    assert [i for r in found for i in r.ids] == [*ids, 1]
