"""Quality rules: every rule is evaluated once, its failure kept as a bit beside the measurements it used.

Policies are versioned bit masks over that ledger, so a new policy or an ablation reads the ledger and never a text.
Built-in expressions only; no shuffle, no state between rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import GAP, let, text_of

#: Bit numbers of the rules; a number is never given to another rule.
RULES = {
    "few_words": 0,
    "repeated_words": 1,
    "word_length": 2,
    "symbols": 3,
    "duplicate_lines": 4,
    "capitals": 5,
    "few_letters": 6,
    "duplicate_text": 7,
}
BASE = ("few_words", "repeated_words")
#: Rules that reject a document, by version. Later versions are added, none is changed.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "few_letters"),
    "v2": (*BASE, "word_length", "symbols", "duplicate_lines", "capitals", "few_letters"),
    "v3": (*BASE, "word_length", "symbols", "duplicate_text", "capitals", "few_letters"),
}
LATEST = "v3"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << RULES[name] for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; windows are compared as strings, not as hashes."""
    windows = F.slice(
        F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)),
    )

    def covered(every: Column) -> Column:
        ordered = F.sort_array(F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        places = let(ordered, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, j: F.when(
                F.get(s, j - 1)["w"].eqNullSafe(x["w"]) | F.get(s, j + 1)["w"].eqNullSafe(x["w"]), x["i"])),
            lambda place: place.isNotNull(),
        )))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + 3 - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + 3).alias("end")))["n"]

    return let(windows, lambda every: F.when(
        F.size(F.array_distinct(every)) < F.size(every), covered(every)).otherwise(F.lit(0).cast("long")))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with its measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, line_chars,
    dup_line_chars (of lines that stand before), n_repeat_words, n_letters, n_capitals.

    Null and empty texts measure zero. Rows are independent, so repeated rows give repeated results. Columns of
    ``docs`` with these names are replaced.
    """
    text = text_of(docs)
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    counts = let(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        _repeat_words(ws).alias("n_repeat_words"),
    ))

    def chars(ls: Column) -> Column:
        return F.length(F.array_join(ls, "")).cast("long")

    by_line = let(lines, lambda ls: let(F.array_distinct(ls), lambda own: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(own)).cast("long").alias("n_dup_lines"),
        chars(ls).alias("line_chars"),
        (chars(ls) - chars(own)).alias("dup_line_chars"),
    )))
    found = docs.withColumns({"_counts": counts, "_lines": by_line})
    return found.withColumns({
        **{name: F.col(f"_counts.{name}") for name in ("n_words", "word_chars", "n_repeat_words")},
        **{name: F.col(f"_lines.{name}") for name in ("n_lines", "n_dup_lines", "line_chars", "dup_line_chars")},
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
    }).drop("_counts", "_lines")


def failures() -> dict[str, Column]:
    """Each rule as a condition on the measurements; integers only, so that no rounding decides."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 16 * c("n_words")),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "capitals": 2 * c("n_capitals") > c("n_letters"),
        "few_letters": 2 * c("n_letters") < c("word_chars"),
        "duplicate_text": 100 * c("dup_line_chars") > 30 * c("line_chars"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with measurements and ``failed``, the bits of the rules that each document fails."""
    bits = [F.when(failed, F.lit(1 << RULES[name])).otherwise(F.lit(0)) for name, failed in failures().items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs).withColumn("failed", total.cast("long"))


def passes(policy: str = LATEST) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = LATEST) -> DataFrame:
    """The documents that pass, with their own columns, whatever those are named."""
    whole = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"), "text")
    return ledger(whole).filter(passes(policy)).select("doc.*")


def ablation(found: DataFrame, policy: str = LATEST) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail no other rule of it, and kept without that rule.

    One aggregate over the ledger; combined in each task before one row per task is shuffled. An empty ledger gives
    zero counts.
    """
    held = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << RULES[name]
        sums.append(F.struct(
            F.lit(name).alias("rule"),
            F.count_if(held.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
            F.count_if(held == bit).alias("n_only"),
            F.count_if(held.bitwiseAND(F.lit(~bit)) == 0).alias("n_kept_without"),
        ))
    return found.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))
