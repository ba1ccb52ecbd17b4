"""Held-out accuracy of the classifiers, and the queries against their check SQL."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from check_oracle import compare, duck

from sparklog.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_check_sql(spark, name):
    _, problem = compare(spark, duck(SF), name, SF, queries.queries()[name], queries.oracle_sql()[name])
    assert not problem, problem


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(docs, rows, empty):
    found = langid.predict(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r.lang_pred for r in found if r.doc_id is not None}
    assert by_id[120] == by_id[121] == by_id[122] == "und" and by_id[123] in {"en", "fr"}
    assert langid.predict(empty).count() == 0


def test_repeated_rows_and_letters(spark):
    """2,000 equal rows are one training row, and characters that are no letters make no language."""
    import duckdb

    some = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' WHERE lang IN ('en', 'de') LIMIT 120").fetchall()
    odd = [(9000 + i, t, "en") for i, t in enumerate(["²", "½ 12", "Ⅷ", "_", "\U0001f600"])] + [(9100, "ª", None), (9101, "日", None)]
    rows = some + [some[0]] * 2000 + [(some[0][0], "another text of the same id", "en")] + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.predict(docs)
    assert found.count() == len(rows)
    by_id = {r.doc_id: r.lang_pred for r in found.distinct().collect()}
    assert all((by_id[i] == "und") == (i < 9100) for i in by_id if i >= 9000)


def plain_logits(model, text):
    """Scores of a text from the definition: TF-IDF of its n-grams, each looked at by itself."""
    from collections import Counter as Bag

    padded, bag = f" {text.lower()} ", Bag()
    mul = {1: 0x27D4EB2F, 2: 0xC2B2AE3D, 3: 0x165667B1}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            h = 0
            for k, char in enumerate(padded[i: i + n]):
                h = ord(char) if k == 0 else (h * (0x9E3779B1 if k == 1 else 0x85EBCA77) + ord(char)) & 0xFFFFFFFF
            h = h * mul[n] & 0xFFFFFFFF
            bag[((h ^ (h >> 15)) >> 4) & (langid.BINS - 1)] += 1
    value = {b: __import__("math").log1p(n) * model.idf[b] for b, n in bag.items()}
    norm = sum(v * v for v in value.values()) ** 0.5 or 1.0
    return [sum(w[b] * v / norm for b, v in value.items()) / model.temperature for w in model.weights]


def test_predictions_equal_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        if r.text and len(r.text) < 20_000 and found[r.doc_id].lang_pred != "und":
            z = plain_logits(model, r.text)
            e = [2.718281828459045 ** (v - max(z)) for v in z]
            assert found[r.doc_id].lang_pred == model.langs[z.index(max(z))]
            assert abs(found[r.doc_id].score - max(e) / sum(e)) < 1e-6


def test_blocks_count_alike(monkeypatch):
    text = "Größe und Maß, " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (langid.counts(text) == whole).all()


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    held = [(found[r.doc_id].score, r.toxic) for r in labels.collect() if found[r.doc_id].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.8
    assert sum(s >= 0.7 for s, x in held if not x) < 0.1 * len(held)


def test_toxicity_equals_the_definition(spark):
    """Markers and scores recomputed from the rules, text by text; a long training text counts to its end."""
    from collections import Counter as Bag

    import numpy as np
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic_words = " ".join(f"zorblax{i % 7} gr{i}" for i in range(4000))
    ends = [i for i in range(50_000, 50_200) if zlib.crc32(str(i).encode()) % 3 != 1][:30]
    long = spark.createDataFrame([(i, "calm words " * 3000 + toxic_words[: 800 + i % 90]) for i in ends], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(long)
    labels = labels.select("doc_id", "toxic").unionByName(long.selectExpr("doc_id", "1 as toxic"))
    sampled, share = toxicity.sample(docs, labels)
    rows = sampled.collect()

    def contexts(mark, halves):
        seen = set()
        for r in rows:
            if r.toxic == mark and r.half in halves:
                for part in toxicity.windows(r.text):
                    words = toxicity.WORD.findall(part)
                    seen |= {(a, w, b) for a, w, b in zip([b"", *words], words, [*words[1:], b""])}
        return Bag(w for _, w, _ in seen)

    got = toxicity.markers(sampled)
    for half, halves in ((0, {0}), (1, {1}), (2, {0, 1})):
        ours, theirs, stems = contexts(1, halves), contexts(0, halves), [Bag(), Bag()]
        for bag, own in zip(stems, (ours, theirs)):
            for w, n in own.items():
                for k in range(4, len(w) + 1):
                    bag[w[:k]] += n
        n_toxic, size = sum(r.toxic for r in rows if r.half in halves), max(1, theirs.total()) / max(1, ours.total())
        marks = {s for s, n in stems[0].items() if n >= max(4, 0.005 * n_toxic) and n * size >= 20 * (stems[1][s] + 0.5)}
        want = sorted((w for w in ours if any(w[:k] in marks for k in range(4, len(w) + 1))), key=lambda w: (ours[w], w))[-400:]
        assert got[half] == want
    assert any(w.startswith(b"zorblax") for w in got[2])

    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, labels, model).collect()}
    tools = [zstandard.ZstdCompressor(level=5, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(
        d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (model.dictionaries.ordinary, model.dictionaries.toxic)]
    for r in docs.limit(150).collect():
        gains = [len(tools[0].compress(w)) - len(tools[1].compress(w)) for w in toxicity.windows(r.text or "")]
        x = [0.0] * 12
        if gains:
            over = [sum(g >= t for g in gains) for t in (2, 3, 4, 5, 6)]
            x = [(n / len(gains)) ** 0.5 for n in over] + [np.log(1 + n) for n in over]
            x += [max(*gains, 0), max(sum(sorted(gains)[-3:]) / len(gains[-3:]), 0)]
        z = model.bias + sum((v - c) / s * w for v, c, s, w in zip(x, model.centre, model.scale, model.weights))
        assert abs(found[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
    assert share == pytest.approx(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").groupBy("doc_id").agg({"toxic": "max"}).agg(
        {"max(toxic)": "avg"}).first()[0])


def test_toxicity_of_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 7 == 0) for i in range(100)], "doc_id long, bad boolean").selectExpr(
        "doc_id", "cast(bad as int) as toxic")
    found = toxicity.score(docs, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert all(r.score is not None for r in found)
    assert toxicity.score(empty, labels).count() == 0
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.0}
