"""Streams over files of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import recipes as r
from checks.recipes import sql
from checks.registry import h_sql, r6, register
from tandem.session import new_path
from tandem.streaming import jobs


def _session(spark):
    """A session of the same application whose state is cut to the cores at hand."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def _in_files(df, key: str, label: str) -> str:
    """Four appends by key; the last also repeats a part of the first."""
    path = new_path(df.sparkSession, label)
    part = F.col(key) % 4
    for at in range(4):
        rows = df.filter(part == at)
        if at == 3:
            rows = rows.unionByName(df.filter(F.col(key) % 8 == 0))
        rows.write.mode("append").parquet(path)
    return path


_REPLAYED = """select * from events union all select * from events where event_id % 8 = 0"""


@register(
    "stream_judge_mean",
    f"""select event_type as model, count(*) as rows, count(*) filter (score is null) as failures,
          {r6("avg(coalesce(score, 0))")} as judge_score
        from (select *, case when event_id % 10 <> 0 then value end as score from ({_REPLAYED}))
        group by event_type""",
)
def stream_judge_mean(spark, d):
    spark = _session(spark)
    scores = r.table(spark, d, "events").select(
        "event_id",
        F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("score"),
    )
    source = jobs.follow(spark, _in_files(scores, "event_id", "scores"), "model string, score double", 1)
    out = new_path(spark, "means")
    jobs.running_judge_mean(source, out, new_path(spark, "state")).awaitTermination()
    return jobs.read_judge_mean(spark, out)


@register("stream_dedupe", "select distinct user_id from events")
def stream_dedupe(spark, d):
    spark = _session(spark)
    rows = r.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source = jobs.follow(
        spark, _in_files(rows, "event_id", "texts"), "event_id bigint, user_id bigint, ts timestamp", 1
    )
    kept = jobs.dedupe_stream(source, ["user_id"], "ts", "3650 days", ["event_id"])
    out = new_path(spark, "kept")
    jobs.write_stream(kept, out, new_path(spark, "state")).awaitTermination()
    return spark.read.schema(kept.schema).parquet(out).select("user_id")


@register(
    "stream_enrich",
    sql(
        f"""select distinct biased, {r.ANSWER_SQL.format("biased")} as response
            from pairs where {h_sql("biased")} % 10 <> 0""",
        "pairs",
    ),
)
def stream_enrich(spark, d):
    spark = _session(spark)
    rows = r.pairs(spark, d).select("sample_id", "biased")
    source = jobs.follow(spark, _in_files(rows, "sample_id", "arrivals"), "biased string", 1)
    out = new_path(spark, "answers")
    jobs.enrich_stream(
        source, "biased", r.answer_call, "response string", out, new_path(spark, "state")
    ).awaitTermination()
    return jobs.read_enriched(spark, out, "string", "biased", "response string")


@register(
    "stream_latest",
    f"""select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type
        from ({_REPLAYED}) group by user_id""",
)
def stream_latest(spark, d):
    spark = _session(spark)
    rows = r.table(spark, d, "events").select("event_id", "user_id", "event_type")
    schema = "event_id bigint, user_id bigint, event_type string"
    source = jobs.follow(spark, _in_files(rows, "event_id", "responses"), schema, 1)
    out = new_path(spark, "latest")
    jobs.latest_stream(source, ["user_id"], "event_id", out, new_path(spark, "state")).awaitTermination()
    return jobs.read_latest(spark, out, schema, ["user_id"], "event_id").select(
        "user_id", "event_id", "event_type"
    )
