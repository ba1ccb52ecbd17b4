"""Adapters: log, tenant and delivery tables derived from the star-schema test tables.

The test tables hold no logs, so every input of the library is derived from them row by row: logs and raw
records from ``events``, projects from ``supplier``, users from ``customer``, metric definitions and
subscriptions from ``nation``, deliveries and attempt outcomes from ``orders``. All of them grow with the
tables they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.keys import hash_api_key

AS_OF = "2024-01-31T00:00:00"
ORDERS_AS_OF = "2001-08-01T12:00:00"

_LEVEL = """
    case when event_type = 'error' and value > 4 * (user_id % 5) and value <= 30 + 10 * (user_id % 5)
              and user_id % 5 < 3 then 'ERROR'
         when event_type = 'error' and value > 40 * (user_id % 5) then 'FATAL'
         when event_type in ('error', 'view') and value > 20 then 'WARN'
         when event_type = 'click' then 'DEBUG'
         else 'INFO' end
"""

_MESSAGE = r"""
    case when event_type = 'error' then
           case event_id % 5
             when 0 then concat('Database connection refused for u', user_id, '@example.com from 10.0.', user_id % 256, '.', event_id % 256)
             when 1 then concat('java.lang.OutOfMemoryError: Java heap space', chr(10), chr(9), 'at org.springframework.Worker.run(Worker.java:', event_id % 500, ')')
             when 2 then concat('NullPointerException at step ', event_id % 97, chr(10), chr(9), 'at app.Main')
             when 3 then 'Timeout waiting for firewall handshake'
             else concat('payment failed with card 4111 1111 1111 ', 1000 + event_id % 9000) end
         when event_type = 'view' then concat('High latency   detected ==== on page ', event_id % 40, ' (', cast(floor(value) as bigint), 'ms), ', repeat('slow ', cast(event_id % 30 as int)))
         when event_type = 'signup' then concat('userid ', user_id, ' request for login')
         when event_type = 'purchase' then
           case when event_id % 5 = 0 then concat('userid ', user_id, ' request for login, order A', event_id, ' created')
                else concat('order A', event_id, ' created') end
         else concat('clicked with props ', props) end
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs_of(events: DataFrame) -> DataFrame:
    """Log entries from event rows; works on a stream of events as well."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("svc-"), F.expr("user_id % 5")).alias("service_id"),
        F.expr(_LEVEL).alias("level"),
        F.expr(_MESSAGE).alias("message"),
        F.concat(F.lit("host-"), F.expr("user_id % 7")).alias("host"),
        F.expr("user_id % 3 + 1").alias("project_id"),
        F.expr("case when event_id % 5 <> 0 then md5(concat('t', event_id div 4)) end").alias("trace_id"),
        F.expr("substr(md5(concat('s', event_id)), 1, 16)").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


_RAW_MESSAGE = r"""
    case when event_id % 50 = 7 then '   '
         else case event_id % 8
           when 0 then concat('{"message":"call by u', user_id, '@example.com","level":"', case event_id % 3 when 0 then 'warn' when 1 then 'Error' else 'loud' end,
                              '","timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","spanId":"sp-', event_id, '"}')
           when 1 then concat('{"level":"loud","n":', event_id, '}')
           when 2 then concat('database unavailable ', event_id, ' at 10.1.', user_id % 256, '.9')
           when 3 then concat('  {"message":"auto ', event_id, '","traceId":"tr-', event_id, '","level":null}')
           when 4 then concat('plain text of ', user_id, ' card 4111-1111-1111-', 1000 + event_id % 9000)
           when 5 then concat('<34>1 syslog line ', event_id)
           when 6 then concat('{"message":{"nested":', event_id, '},"level":"debug"}')
           else concat('{"timestamp":"yesterday","trace_id":"t', event_id, '"}') end end
"""


def raw_logs_of(events: DataFrame) -> DataFrame:
    """Raw ingest records: every format, every parse branch, bad records and bad keys."""
    return events.select(
        F.concat(F.lit("r"), "event_id").alias("record_id"),
        F.expr(_RAW_MESSAGE).alias("message"),
        F.expr("case when event_id % 61 = 3 then '' else concat('svc-', user_id % 5) end").alias("service_id"),
        F.expr(
            "case when event_id % 67 = 5 then null when event_id % 8 in (3, 4) then 'AUTO_DETECT' "
            "when event_id % 8 = 5 then 'SYSLOG' else 'JSON' end"
        ).alias("format"),
        F.expr("case event_id % 4 when 0 then 'error' when 1 then 'odd' when 2 then 'fatal' end").alias("level"),
        F.expr("""case when event_id % 3 = 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
                       when event_id % 3 = 1 then date_format(ts, 'yyyy-MM-dd') end""").alias("timestamp"),
        F.concat(F.lit("host-"), F.expr("user_id % 7")).alias("host"),
        F.expr(
            "case event_id % 11 when 0 then null when 1 then '  ' when 2 then 'bogus' "
            "else concat('key-', user_id % 5) end"
        ).alias("api_key"),
        F.expr(
            "case event_id % 9 "
            "when 0 then concat('00-', md5(concat('t', event_id)), '-', substr(md5(concat('p', event_id)), 1, 16), '-01') "
            "when 1 then concat('00-', md5(concat('t', event_id)), '-0000000000000000-01') "
            "when 2 then concat('01-', md5(concat('t', event_id)), '-', substr(md5(concat('p', event_id)), 1, 16), '-01') "
            "when 3 then concat('00-', upper(md5(concat('t', event_id))), '-', substr(md5(concat('p', event_id)), 1, 16), '-01') "
            "when 4 then concat(' 00-', md5(concat('t', event_id)), '-', substr(md5(concat('p', event_id)), 1, 16), '-00 ') "
            "when 5 then concat('00-', md5(concat('t', event_id))) "
            "when 6 then ' ' end"
        ).alias("traceparent"),
        F.lit(99).cast("bigint").alias("project_id"),
        F.expr("concat('req-', event_id)").alias("trace_id"),
        F.expr("case when event_id % 2 = 0 then concat('rs-', event_id) end").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_logs_of(table(spark, sf_dir, "events"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("bigint").alias("owner_id"),
        hash_api_key(F.concat(F.lit("key-"), "s_suppkey")).alias("api_key_hash"),
        F.expr("s_suppkey % 4 <> 3").alias("api_key_active"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("user"), "c_custkey", F.lit("@example.com")).alias("email"),
        F.expr("c_mktsegment = 'BUILDING'").alias("is_external"),
    )


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.expr("case when c_nationkey = 0 then array('USER', 'ADMIN') else array('USER') end")).alias("role"),
    )


def custom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.expr("cast(n_nationkey + 1 as bigint)").alias("id"),
        F.expr("cast(n_nationkey % 3 + 1 as bigint)").alias("project_id"),
        F.expr("case when n_nationkey = 11 then '  ' else n_name end").alias("name"),
        F.expr(
            "case n_nationkey % 7 when 0 then 'order A[0-9]+ created' when 1 then '(?s).*heap space.*' "
            "when 2 then '([' when 3 then '.*firewall.*' when 4 then 'userid [0-9]+ request.*' "
            "when 5 then 'clicked' else concat('clicked.*\"k\": ', n_nationkey, '.*') end"
        ).alias("regex_pattern"),
        F.lit("2023-12-01").cast("timestamp_ntz").alias("created_at"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.expr("cast(n_nationkey + 1 as bigint)").alias("id"),
        F.expr("cast(n_nationkey % 4 + 1 as bigint)").alias("project_id"),
        F.expr("concat('https://hooks.example.com/', lower(n_name))").alias("url"),
        F.expr("repeat(concat('secret-', n_nationkey), n_nationkey % 9 + 1)").alias("secret"),
        F.expr("n_nationkey % 5 <> 0").alias("active"),
        F.expr("timestamp_seconds(1700000000 + n_nationkey)").alias("created_at"),
        F.expr("timestamp_seconds(1700000000 + 2 * n_nationkey)").alias("updated_at"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.expr("o_custkey % 25 + 1").alias("subscription_id"),
        F.concat(F.lit("evt-"), "o_orderkey").alias("event_id"),
        F.expr("concat('{\"order\":', o_orderkey, '}')").alias("payload"),
        F.expr(
            "case o_orderstatus when 'F' then case when o_orderkey % 3 = 0 then 'FAILED' else 'DELIVERED' end "
            "when 'O' then 'PENDING' else 'RETRY_PENDING' end"
        ).alias("status"),
        F.expr("cast(case when o_orderstatus = 'O' then 0 else o_orderkey % 5 end as int)").alias("attempts"),
        F.expr(
            "cast(case when o_orderstatus = 'F' then case when o_orderkey % 3 = 0 then 404 else 200 end "
            "when o_orderstatus = 'P' then 503 end as int)"
        ).alias("http_status"),
        F.expr("case when o_orderstatus <> 'O' then o_orderkey % 900 + 20 end").alias("latency_ms"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 3600)").alias("next_attempt_at"),
        F.expr("case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) end").alias("delivered_at"),
        F.expr("case when o_orderstatus = 'P' then 'HTTP 503: ' end").alias("last_error"),
        F.expr("cast(o_orderdate as timestamp) - make_dt_interval(0, o_orderkey % 24, 0, 0)").alias("created_at"),
        F.expr("cast(o_orderdate as timestamp)").alias("updated_at"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt outcomes of the waiting deliveries; those of low priority were not tried."""
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F' and o_orderpriority <> '5-LOW'")
    return waiting.select(
        F.col("o_orderkey").cast("string").alias("delivery_id"),
        F.expr(
            "cast(case o_orderkey % 7 when 0 then 200 when 1 then 500 when 2 then 429 when 3 then 404 "
            "when 4 then 408 when 5 then 204 end as int)"
        ).alias("http_status"),
        F.expr("case when o_orderkey % 7 = 6 then 'HttpTimeoutException: request timed out' end").alias("error"),
        F.expr("o_orderkey % 4000").alias("latency_ms"),
        F.expr("concat('body ', o_orderkey % 10)").alias("body"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 1, 0, 0)").alias("finished_at"),
    )


def dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters: the urgent orders that are finished."""
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return failed.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.expr("o_custkey % 25 + 1").alias("subscription_id"),
        F.concat(F.lit("evt-"), "o_orderkey").alias("event_id"),
        F.expr("concat('{\"order\":', o_orderkey, '}')").alias("payload"),
        F.lit(5).alias("attempts"),
        F.lit(503).alias("last_http_status"),
        F.lit("HTTP 503: ").alias("last_error"),
        F.expr("cast(o_orderdate as timestamp)").alias("failed_at"),
        F.expr("cast(o_orderdate as timestamp) - make_dt_interval(0, o_orderkey % 24, 0, 0)").alias("original_created_at"),
    )


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from conversations: one trace per conversation, the turn as the time."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.lit("chat-"), "role").alias("service_id"),
        F.expr("case role when 'system' then 'WARN' when 'assistant' then 'INFO' else 'DEBUG' end").alias("level"),
        F.expr("conv_id % 3 + 1").alias("project_id"),
        F.col("text").alias("message"),
        F.expr("timestamp_seconds(1704067200 + turn * 60)").alias("timestamp"),
        F.expr("md5(cast(conv_id as string))").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
    )
