"""Jobs around outside functions, with digests standing in for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import recipes as r
from checks.recipes import sql
from checks.registry import fill_sql, h_sql, r6, register, text_sql
from checks.texts import QUIET_SQL
from tandem.functions import prompt_texts as fixed
from tandem.functions.judging import SCORES
from tandem.functions.text import strip_think
from tandem.operators import enrich
from tandem.plans import judging, reasoning
from tandem.plans.preferences import iteration_pairs, plan_iteration
from tandem.session import new_path
from tandem.sources import logs
from tandem.sources.keyed_log import KeyedLog

_SHOWN = ", ".join(f"case when answered then {name} end as {name}" for name in SCORES)


def _judge_rows(spark, d):
    return r.predicted(spark, d).select(
        "sample_id", "biased", F.col("predicted").alias("output"), F.col("neutral").alias("reference")
    )


@register(
    "judge_enrich",
    sql(
        f"""select sample_id, {_SHOWN}, ok, {r6("score")} as score,
              case when sample_id % 3 <> 0 then 9007199254740993 + sample_id end as tag
            from judged_rows""",
        "judged_rows",
    ),
)
def judge_enrich(spark, d):
    """A nullable integer beyond what a double holds passes through the call."""
    tag = F.when(F.col("sample_id") % 3 != 0, F.col("sample_id") + F.lit(9007199254740993))
    scored = judging.judge(_judge_rows(spark, d).withColumn("tag", tag), r.judge_call, "judge-1")
    return scored.select("sample_id", *SCORES, "ok", "score", "tag")


def _fails(row: dict) -> dict | None:
    """Every third text has no answer, every fifth an error."""
    if row["sample_id"] % 5 == 0:
        raise ValueError("no room")
    return None if row["sample_id"] % 3 == 0 else {"n": row["sample_id"]}


@register(
    "failed_calls",
    sql(
        """select sample_id, case when sample_id % 5 <> 0 and sample_id % 3 <> 0 then sample_id end as n,
             sample_id % 5 <> 0 and sample_id % 3 <> 0 as ok, case
               when sample_id % 5 = 0 then '[' || chr(39) || substr(shown, 1, 50) || chr(39) || ']: no room'
               when sample_id % 3 = 0 then 'no answer' end as error
           from (select sample_id, regexp_replace(biased, '[^a-zA-Z]', '_', 'g') as shown from pairs)""",
        "pairs",
    ),
)
def failed_calls(spark, d):
    """What is kept of calls that fail: the first signs of the key and the message."""
    shown = F.regexp_replace("biased", "[^a-zA-Z]", "_").alias("shown")
    rows = r.pairs(spark, d).select("sample_id", shown)
    called = r.staged(enrich.call_rows(rows, _fails, "n bigint", ["shown"]))
    return called.drop("shown")


@register(
    "judge_log",
    sql(
        f"""select predicted as model_output, {", ".join(SCORES)}, {r6("score")} as total_score,
              biased as biased_text, neutral as reference_text, 'ok' as overall_reasoning,
              'org_judge-10' as model_slug from judged_rows where ok""",
        "judged_rows",
    ),
)
def judge_log(spark, d):
    path = new_path(spark, "judge_log")
    scored = judging.judge(_judge_rows(spark, d), r.judge_call, "org/judge-1.0", path)
    return spark.read.schema(logs.judge_rows(scored).schema).parquet(path)


# The judge depends on the sample only, so rewards equal the scores above; the
# text it was given is what shows the cleaning.
@register("reward_batch", sql(f"select sample_id, {r6("score")} as reward from judged_rows", "judged_rows"))
def reward_batch(spark, d):
    message = F.struct(
        F.lit("assistant").alias("role"),
        F.concat(F.lit("<think>hm\n</think> "), F.col("predicted")).alias("content"),
    )
    rows = r.predicted(spark, d).withColumn("completions", F.array(message))
    return judging.reward_batch(rows, r.judge_call, "judge-1")


r.cte(
    "pending", "select * from pairs where biased not in (select input from logged)", "pairs", "logged"
)


@register("resume_anti_join", sql("select sample_id, biased as input from pending", "pending"))
def resume_anti_join(spark, d):
    source = r.pairs(spark, d).select("sample_id", F.col("biased").alias("input"))
    return enrich.not_logged(source, r.log_rows(spark, d), "input")


@register(
    "latest_by_key",
    sql(
        """select input, max(revision) as revision, arg_max(response, revision) as response
           from logged group by input""",
        "logged",
    ),
)
def latest_by_key(spark, d):
    log = r.log_rows(spark, d).select("input", "response", "revision")
    return enrich.latest_by_key(log.withColumn("at", F.col("revision")), ["input"], "at").select(
        "input", "revision", "response"
    )


_ANSWERED = f"{h_sql("biased")} % 10 <> 0"


@register(
    "cot_increment",
    sql(
        f"""select true as stamped, biased as input, {text_sql(fixed.COT_STYLE)} as style,
              {fill_sql(fixed.COT_USER, text="biased", style=text_sql(fixed.COT_STYLE))} as prompt,
              {r.ANSWER_SQL.format("biased")} as response, 'm' as model
            from pending where {_ANSWERED}""",
        "pending",
    ),
)
def cot_increment(spark, d):
    records = reasoning.increment(r.pairs(spark, d), r.log_rows(spark, d), r.answer_call, "m")
    stamped = F.col("timestamp").isNotNull().alias("stamped")
    return records.select(stamped, "input", "style", "prompt", "response", "model")


@register(
    "resume_union",
    sql(
        f"""select input, response from logged union all
            select biased, {r.ANSWER_SQL.format("biased")} from pending where {_ANSWERED}""",
        "pending",
        "logged",
    ),
)
def resume_union(spark, d):
    """Two runs: the second finds nothing left but the failed texts."""
    path = new_path(spark, "cot")
    none = F.lit("")
    earlier = r.log_rows(spark, d).select(
        none.alias("timestamp"), "input", none.alias("style"), none.alias("prompt"), "response", none.alias("model")
    )
    logs.append_cot(earlier, path)
    pairs = r.staged(r.pairs(spark, d))
    reasoning.generate(pairs, path, r.answer_call, "m")
    return reasoning.generate(pairs, path, r.answer_call, "m").select("input", "response")


@register(
    "cached_enrich",
    sql(
        f"""select sample_id, biased, case
              when biased in (select input from logged)
                then (select arg_max(response, revision) from logged l where l.input = biased)
              when {_ANSWERED} then {r.ANSWER_SQL.format("biased")} end as response
            from pairs""",
        "pairs",
        "logged",
    ),
)
def cached_enrich(spark, d):
    path = new_path(spark, "cache")
    known = r.log_rows(spark, d).select(
        F.col("input").alias("biased"), "response", F.col("revision").cast("bigint").alias("revision")
    )
    log = KeyedLog(spark, path, "biased", "string", "response string", fan=2)
    for at in range(2):  # two commits, which are merged
        log.append(known.where(F.pmod(F.xxhash64("response"), F.lit(2)) == at))
    source = r.pairs(spark, d).select("sample_id", "biased")
    return enrich.cached_enrich(source, "biased", path, r.answer_call, "response string")


def _respond(row: dict) -> dict:
    """The source text after a reasoning block, marked with the temperature."""
    return {"response": f"<think>{row['temp_idx']}</think> {row['temperature']} {row['biased']}\n"}


@register(
    "sample_fanout",
    sql(
        f"""select sample_id, t.seq::BIGINT as temp_idx,
              regexp_replace(t.name || ' ' || biased, '^\\s+|\\s+$', '', 'g') as response
            from clean, (values (0, '0.7'), (1, '1.0'), (2, '1.5')) t(seq, name)""",
        "clean",
    ),
)
def sample_fanout(spark, d):
    prompts = r.clean(spark, d).select("sample_id", "biased")
    return enrich.sample_responses(prompts, _respond, strip_think).select(
        "sample_id", F.posexplode("responses").alias("temp_idx", "response")
    )


def _predict(texts: list[str]) -> list[str]:
    import hashlib

    return [
        " ".join(w for w in text.split(" ") if not hashlib.md5(w.encode()).hexdigest().startswith("0"))
        for text in texts
    ]


@register("batch_predict", sql("select sample_id, predicted from pred", "pred"))
def batch_predict(spark, d):
    rows = r.clean(spark, d)
    return enrich.batch_predict(rows, _predict, text="neutral").select("sample_id", "predicted")


r.cte("dpo_prompts", f"select sample_id, {QUIET_SQL} as prompt from clean", "clean")


def _rank(row: dict) -> dict | None:
    """Longest text first; every thirteenth sample fails."""
    if row["sample_id"] % 13 == 0:
        return None
    order = sorted(row["candidates"], key=lambda c: (-len(c["text"]), c["id"]))
    return {
        "judged": [{"id": c["id"], "rank": at} for at, c in enumerate(order)],
        "reasoning": "length",
    }


@register(
    "iteration_pairs",
    sql(
        """WITH b as (select * from (select *, (row_number() over (order by sample_id) - 1) // 25 as it
               from clean) where it = 1),
             c as (select sample_id, biased, u.id, u.text from b, lateral (select unnest(range(4)) as id,
               unnest([neutral] || list_transform(['0.7', '1.0', '1.5'], lambda t:
                 regexp_replace(t || ' ' || biased, '^\\s+|\\s+$', '', 'g'))) as text) u),
             p as (select *, row_number() over (partition by sample_id order by
               case when sample_id % 13 = 0 then 0 else -len(text) end, id) - 1 as place from c)
           select sample_id, md5(prompt) as prompt, chosen, rejected from (
             select a.sample_id, a.text as chosen, b.text as rejected from p a join p b using (sample_id)
               where (a.place, b.place) in ((0, 1), (0, 3), (1, 3))
             union all select sample_id, text, biased from p where place < 3)
           join dpo_prompts using (sample_id)""",
        "clean",
        "dpo_prompts",
    ),
)
def one_iteration(spark, d):
    planned = plan_iteration(r.clean(spark, d), 1)
    rows = iteration_pairs(planned, 1, _respond, _rank)
    return rows.select("sample_id", F.md5("prompt").alias("prompt"), "chosen", "rejected")
