"""Queries of retrieval-log analytics, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.sources.tables import SCHEMAS, VIEWS, load_views, with_views
from folioflow.streaming import logs as lg

from .registry import Registry

R = Registry()
add = R.add
T = lambda t: t("v_attempts")
LATCH = (
    "la as (select *, coalesce(bool_or(status = 'RATE_LIMITED') over (partition by operation_id, provider order by ts, attempt_id "
    "rows between unbounded preceding and 1 preceding), false) as suppressed from v_attempts)"
)
add(
    "q01_attempt_rollup",
    lambda t: lg.attempt_rollup(T(t)),
    "select provider, purpose, count(*) as calls, count(*) filter (status <> 'OK') as failures, sum(result_count)::bigint as results, "
    "round(avg(latency_ms), 6) as mean_latency, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency from v_attempts group by "
    "1, 2",
)
add(
    "q02_degradation_latch",
    lambda t: lg.degradation_latch(T(t)).select("attempt_id", "suppressed"),
    f"with {LATCH} select attempt_id, suppressed from la",
)
add(
    "q03_call_budget",
    lambda t: lg.call_budget(T(t), 2, 3).select("attempt_id", "provider_calls", "operation_calls", "exhausted"),
    f"with {LATCH}, c as (select attempt_id, row_number() over (partition by operation_id, provider order by ts, attempt_id) as provider_calls, "
    f"row_number() over (partition by operation_id order by ts, attempt_id) as operation_calls from la where not suppressed) select "
    f"*, provider_calls > 2 or operation_calls > 3 as exhausted from c",
)
add(
    "q04_degradation_list",
    lambda t: lg.degradation_list(T(t)),
    "with f as (select operation_id, provider || ':' || status as d, min(struct_pack(ts := ts, a := attempt_id)) as first_at from "
    "v_attempts where status = 'RATE_LIMITED' group by 1, 2) select operation_id, string_agg(d, ',' order by first_at) as degradations "
    "from f group by 1",
)
CACHE_KEY = lambda: F.concat("provider", F.lit("::"), "purpose", F.lit("::"), F.lower(F.regexp_extract("operation_id", r"^op_(\d+)_", 1)))
add(
    "q05_fresh_hit",
    lambda t: lg.fresh_hit(T(t).withColumn("cache_key", CACHE_KEY())),
    """with recursive c as (select attempt_id, ts, provider || '::' || purpose || '::' || regexp_extract(operation_id, '^op_([0-9]+)_', 1) as k, ts + case when status = 'OK' then interval 7 days else interval 6 hours end as until from v_attempts),
    g as (select k, ts, min(attempt_id) as attempt_id from c group by 1, 2), h as (select g.*, c.until from g join c using (attempt_id)),
    nt as (select h.k, h.attempt_id, min(n.ts) as ts from h join h n on h.k = n.k and n.ts >= h.until group by 1, 2),
    nx as (select nt.attempt_id, h.attempt_id as next_id from nt join h on nt.k = h.k and nt.ts = h.ts),
    f as (select arg_min(attempt_id, ts) as attempt_id from h group by k union all select next_id from f join nx using (attempt_id))
    select attempt_id, attempt_id not in (select attempt_id from f) as hit from c""",
)
add(
    "q06_ingest_dedup",
    lambda t: lg.first_of_key(T(t), "operation_id"),
    "select operation_id, arg_min(attempt_id, struct_pack(ts := ts, a := attempt_id)) as attempt_id from v_attempts group by 1",
)
add(
    "q07_attempt_windows",
    lambda t: lg.attempt_windows(T(t)),
    "select time_bucket(interval 1 hour, ts) as start, provider, count(*) as calls, count(*) filter (status <> 'OK') as failures from "
    "v_attempts group by 1, 2",
)
add(
    "q08_operation_sessions",
    lambda t: lg.operation_sessions(T(t)),
    "with g as (select operation_id, ts, attempt_id, status, case when ts - lag(ts) over (partition by operation_id order by ts) < interval 2 hours then "
    "0 else 1 end as n from v_attempts), s as (select *, sum(n) over (partition by operation_id order by ts rows unbounded preceding) "
    "as k from g) select operation_id, min(ts) as start, count(*) as calls, "
    "arg_max(status, struct_pack(ts := ts, a := attempt_id)) = 'RATE_LIMITED' as interrupted from s group by operation_id, k",
)
LATEST = "select operation_id, arg_max(status, struct_pack(ts := ts, a := attempt_id)) as status, count(*) as calls from v_attempts group by 1"
add(
    "q09_latest_state",
    lambda t: lg.latest_state(T(t)),
    LATEST,
)
add(
    "q07_sliding_windows",
    lambda t: lg.attempt_windows(T(t), "1 hour", "20 minutes"),
    "select start, provider, count(*) as calls, count(*) filter (status <> 'OK') as failures from (select *, unnest([b, b - interval 20 minutes, b - interval 40 minutes]) as start from (select *, time_bucket(interval 20 minutes, ts) as b from v_attempts)) group by 1, 2",
)
WORKS = lambda t: t("v_works").where("provider = 'OPENALEX'").select("work_key", "title")
add(
    "q10_enrich",
    lambda t: lg.enrich(T(t).withColumn("work_key", F.col("attempt_id") % 3000), WORKS(t)).select("attempt_id", "title"),
    "select attempt_id, title from (select attempt_id, attempt_id % 3000 as k from v_attempts) left join (select work_key, title from v_works where provider = 'OPENALEX') on k = work_key",
)


def _stream(name, build, finish=lambda d: d):
    """A streaming twin with the batch operators' code, run over the log and then closed, from one checkpoint."""

    def run(spark, sf_dir):
        load_views(spark, sf_dir)
        log = lg.LogStream(spark, f"{sf_dir}/events.parquet", SCHEMAS["events"], name)
        log.events.createOrReplaceTempView("events")
        out = finish(log.drain(build(spark.sql(VIEWS["v_attempts"]), WORKS(spark.table))))
        return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in out.dtypes])

    return run


STREAMS = {
    "q06_stream_dedup": _stream("q06_stream_dedup", lambda a, w: lg.first_attempts(a, "operation_id")),
    "q07_stream_windows": _stream("q07_stream_windows", lambda a, w: lg.attempt_windows(a)),
    "q07_stream_sliding": _stream("q07_stream_sliding", lambda a, w: lg.attempt_windows(a, "1 hour", "20 minutes")),
    "q08_stream_sessions": _stream("q08_stream_sessions", lambda a, w: lg.operation_sessions(a)),
    "q09_stream_state": _stream("q09_stream_state", lambda a, w: lg.running_state(a), lg.last_state),
    "q10_stream_enrich": _stream("q10_stream_enrich", lambda a, w: lg.enrich(a.where("operation_id is not null").withColumn("work_key", F.col("attempt_id") % 3000), w).select("attempt_id", "title")),
}
QUERIES = dict(R.QUERIES) | STREAMS
ORACLE = dict(R.ORACLE) | {
    "q06_stream_dedup": R.ORACLE["q06_ingest_dedup"],
    "q07_stream_windows": R.ORACLE["q07_attempt_windows"],
    "q07_stream_sliding": R.ORACLE["q07_sliding_windows"],
    "q08_stream_sessions": R.ORACLE["q08_operation_sessions"],
    "q09_stream_state": with_views(f"select operation_id, case when status = 'RATE_LIMITED' then 'FAILED' else status end as status, calls from ({LATEST})"),
    "q10_stream_enrich": R.ORACLE["q10_enrich"],
}
