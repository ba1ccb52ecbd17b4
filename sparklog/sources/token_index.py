"""Token postings beside a document store: which files hold which tokens, so that a search opens only those files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog import schemas
from sparklog.operators.search import search_logs
from sparklog.sources.sinks import documents_store
from sparklog.sources.store import Store

POSTINGS = schemas.table(token="string", project_id="long", file="string", day="timestamp")
#: What stands between tokens.
BETWEEN = r"[^\p{L}\p{N}_]+"


def postings_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, f"{path}-tokens", POSTINGS, "day")


def update_postings(spark: SparkSession, path: str) -> int:
    """Adds the postings of the runs of a document store that have none yet; returns their number.

    A file is read once in its life. Its tokens are made distinct in its task and per file before they are written; postings lie in the
    day of their file, so they expire with it (``postings_store(...).expire``).
    """
    documents, postings = documents_store(spark, path), postings_store(spark, path)
    now = documents.manifest()
    known = set(postings.meta("runs", []))
    fresh = [r for r in now.runs if r["path"] not in known]
    if fresh:
        rows = documents.load(fresh).select(
            "project_id", "message", "log_date", F.concat(F.lit("run="), F.substring_index(F.input_file_name(), "/run=", -1)).alias("file"))
        tokens = rows.select(F.explode(F.array_distinct(F.split(F.lower("message"), BETWEEN))).alias("token"), "project_id", "file",
                             F.col("log_date").cast("timestamp").alias("day")).where("token <> ''").distinct()
        postings.commit(tokens, now.number, app="postings", meta={"runs": [r["path"] for r in now.runs]}, order=["token"])
    return len(fresh)


def matching_documents(spark: SparkSession, path: str, project_id: int, word: str) -> DataFrame:
    """The documents of the files in which a token of the project contains ``word``, and of runs without postings yet."""
    documents, postings = documents_store(spark, path), postings_store(spark, path)
    known, runs = set(postings.meta("runs", [])), documents.manifest().runs
    hits = postings.read().where((F.col("project_id") == project_id) & F.contains("token", F.lit(word.lower()))).select("file").distinct()
    in_force = {r["path"] for r in runs}
    files = [r.file for r in hits.collect() if r.file.rpartition("/")[0] in in_force]
    return documents.load([{"path": f} for f in files] + [r for r in runs if r["path"] not in known])


def search_indexed(spark: SparkSession, path: str, project_id: int, query: str) -> DataFrame:
    """``search_logs`` in token mode over a document store: same rows, but only matching files are opened.

    A blank query, and one with characters that no token has, is answered without the postings.
    """
    word = query.strip()
    if word and all(char.isalnum() or char == "_" for char in word):
        return search_logs(matching_documents(spark, path, project_id, word), project_id, word, "token")
    return search_logs(documents_store(spark, path).versions(), project_id, query, "token")
