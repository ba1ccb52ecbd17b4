"""The registered queries of the operators, and check SQL where SQL can express them."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import (
    fair_mix, iblt, jump_shards, langid, line_dedup, packing, quality_ledger, secret_scan, simhash, source_audit, toxicity,
    turn_repair, warc,
)
from sparklog.llm.check_sql import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once, unless they find it where the driver does (PYTHONPATH or working folder)."""
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if not any(p and Path(p).resolve() == root for p in known) and not any(
            "sparklog-" in str(f) for f in context._python_includes):
        name = Path(tempfile.mkdtemp()) / f"sparklog-{os.getpid()}"
        context.addPyFile(shutil.make_archive(str(name), "zip", root, "sparklog"))


def token_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_file())


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.place(table(spark, sf_dir, "documents"))


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_ledger.passes("base")).alias("base_failed"), quality_ledger.passes().alias("kept"), "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with the others."""
    return quality_ledger.ablation(quality_ledger.ledger(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def op10_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.versions(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(table(spark, sf_dir, "documents"))


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = (op1_simhash, op2_warc, op3_toxicity, op4_fair_mix, op5_langid, op6_packing, op7_jump_shards, op8_quality_ledger,
           op9_line_dedup, op10_iblt, op11_turn_repair, op12_secret_scan, op13_source_audit,
           quality_ablation)
    return {fn.__name__: _shipped(fn) for fn in fns}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
