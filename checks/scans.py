"""Scans, sinks, projections and splits."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from checks import recipes as r
from checks.recipes import sql
from checks.registry import r6, register
from tandem.functions.judging import SCORES, judge_total
from tandem.functions.text import path_slug
from tandem.operators.ordinals import with_ordinals
from tandem.operators.ranking import rank_candidates, rank_rows
from tandem.operators.splits import assign_batches, split_overlap, split_pairs, take_split
from tandem.session import new_path, stage
from tandem.sources import corpus, logs

# Every pair as a TSV line; some lines are too long, short, or hold a missing mark.
FLAT = "replace(replace(replace({}, chr(10), ' '), chr(9), ' '), chr(13), ' ')"


def _tsv(spark, sf_dir) -> str:
    def flat(name):
        return F.regexp_replace(name, "[\t\n\r]", " ")

    kind = F.col("sample_id") % 10
    key = F.col("sample_id").cast("string")
    pairs = r.pairs(spark, sf_dir)
    target = F.coalesce(flat("neutral"), F.lit("NA"))
    target = F.when(kind == 5, F.concat(F.lit('"'), target)).otherwise(target)
    fields = [key, F.lit("s"), F.lit("t"), flat("biased"), target, F.lit("P"), F.lit("Q")]
    short = F.concat_ws("\t", *fields[:4])
    full = F.concat_ws("\t", *fields)
    line = F.when(kind == 2, short).when(kind == 4, F.concat(full, F.lit("\textra")))
    path = new_path(spark, "corpus")
    pairs.select(line.otherwise(full).alias("value")).write.text(path)
    return path


_TARGET = f"""case when sample_id % 10 = 2 then null
  when sample_id % 10 = 5 then '"' || coalesce({FLAT.format("neutral")}, 'NA')
  else coalesce({FLAT.format("neutral")}, 'NA') end"""
_SCANNED = f"""select sample_id::VARCHAR as id, {FLAT.format("biased")} as src_raw,
  {_TARGET} as tgt_raw from pairs where sample_id % 10 <> 4"""
r.cte("scanned", _SCANNED, "pairs")
r.cte(
    "normal",
    """select id, src_raw, case when tgt_raw = 'NA' then null else tgt_raw end as tgt_raw
       from scanned""",
    "scanned",
)


@register(
    "scan_tsv",
    sql(
        """select *, case when tgt_raw is not null then 's' || 't' || 'P' || 'Q' end as rest
           from scanned""",
        "scanned",
    ),
)
def scan_tsv(spark, d):
    rows = corpus.scan_corpus(spark, _tsv(spark, d))
    rest = F.concat("src_tok", "tgt_tok", "src_POS_tags", "tgt_parse_tags")
    return rows.select("id", "src_raw", "tgt_raw", rest.alias("rest"))


@register("scan_na_tokens", sql("select * from normal", "normal"))
def scan_na_tokens(spark, d):
    rows = corpus.normalise_missing(
        corpus.scan_corpus(spark, _tsv(spark, d)), ["src_raw", "tgt_raw"]
    )
    return rows.select("id", "src_raw", "tgt_raw")


@register(
    "bad_lines",
    sql(
        f"""select sample_id::VARCHAR || chr(9) || 's' || chr(9) || 't' || chr(9) ||
            {FLAT.format("biased")} || chr(9) || coalesce({FLAT.format("neutral")}, 'NA') ||
            chr(9) || 'P' || chr(9) || 'Q' || chr(9) || 'extra' as line
            from pairs where sample_id % 10 = 4""",
        "pairs",
    ),
)
def bad_lines(spark, d):
    return corpus.scan_over_long(spark, _tsv(spark, d))


@register(
    "project_pairs",
    sql("select id, src_raw as biased, tgt_raw as neutral from normal", "normal"),
)
def project_pairs(spark, d):
    rows = corpus.normalise_missing(
        corpus.scan_corpus(spark, _tsv(spark, d)), ["src_raw", "tgt_raw"]
    )
    return corpus.project_pairs(rows, keep=["id"])


@register(
    "drop_null_pairs",
    sql(
        """select id, src_raw as biased, tgt_raw as neutral from normal
           where src_raw is not null and tgt_raw is not null""",
        "normal",
    ),
)
def drop_null_pairs(spark, d):
    return corpus.load_pairs(spark, _tsv(spark, d))


@register(
    "scan_predictions",
    sql(
        """WITH t as (select * from (select * from pairs order by sample_id desc limit 300)
             where neutral is not null)
           select row_number() over (order by sample_id) - 1 as row_idx, sample_id, neutral,
             """
        + r.thinned_sql("string_split(neutral, ' ')", "0")
        + """ as predicted from t""",
        "pairs",
    ),
)
def scan_predictions(spark, d):
    test = split_pairs(r.pairs(spark, d), "test")
    numbered = with_ordinals(test, ["sample_id"])
    path = new_path(spark, "predictions")
    made = numbered.withColumn("predicted", r.thinned(F.split("neutral", " ", -1), "0"))
    logs.write_predictions(made.orderBy("sample_id"), path)
    return logs.scan_predictions(spark, path).join(
        numbered.select("row_idx", "sample_id", "neutral"), "row_idx"
    )


def _teacher_log(spark, d) -> str:
    """Teacher records with an empty list, an empty key, or no list at all."""
    path = new_path(spark, "teacher")
    vec = F.col("vec_id")
    entry = F.struct(
        F.col("chosen.token").cast("string").alias("token"),
        F.col("chosen.logprob").alias("logprob"),
        F.transform(
            "top",
            lambda t: F.struct(t["token"].cast("string").alias("token"), t["logprob"].alias("logprob")),
        ).alias("top_logprobs"),
    )
    none = F.expr(f"cast(array() as {logs.LOGPROBS_TYPE})")
    listed = F.when(vec % 17 == 0, none).when(vec % 19 != 0, F.array(entry))
    rows = r.teacher(spark, d).select(
        F.when(vec % 23 == 0, "").otherwise(F.format_string("text %d", vec)).alias("biased_text"),
        F.lit(None).cast("string").alias("neutralized_text"),
        listed.alias("logprobs"),
        F.lit("teacher").alias("model"),
    )
    logs.append_teacher(rows, path)
    return path


@register(
    "teacher_lines",
    sql(
        """WITH v as (select distinct vec_id from teach)
           select (select count(*) from v where vec_id % 29 = 0) as blank, (select count(*) from v where vec_id % 31 = 0) as broken,
             count(*) filter (vec_id % 17 = 0 or vec_id % 19 = 0 or vec_id % 23 = 0) as empty,
             count(*) filter (vec_id % 17 <> 0 and vec_id % 19 <> 0 and vec_id % 23 <> 0) as used from v""",
        "teach",
    ),
)
def teacher_lines(spark, d):
    """Counts of the lines of a log, taken while its rows are read and written."""
    path = _teacher_log(spark, d)
    vec = F.col("vec_id")
    others = r.teacher(spark, d).select(F.when(vec % 29 == 0, "  ").alias("a"), F.when(vec % 31 == 0, '{"biased_text": ').alias("b"))
    others.select(F.explode(F.array("a", "b")).alias("value")).where("value IS NOT NULL").write.mode("append").text(path)
    counts = Observation("teacher")
    stage(logs.scan_teacher(spark, path, counts), "teacher-rows")
    found = counts.get
    names = ("blank", "broken", "empty", "used")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@register(
    "scan_teacher",
    sql(
        f"""select 'text ' || vec_id as biased_text, max(case when seq = 0 then token end)::VARCHAR as token,
            {r6("max(case when seq = 0 then logprob end)")} as logprob, count(*) as tops
            from teach where vec_id % 17 <> 0 and vec_id % 19 <> 0 and vec_id % 23 <> 0
            group by vec_id""",
        "teach",
    ),
)
def scan_teacher(spark, d):
    first = F.col("logprobs")[0]
    return logs.scan_teacher(spark, _teacher_log(spark, d)).select(
        "biased_text",
        first["token"].alias("token"),
        first["logprob"].alias("logprob"),
        F.size(first["top_logprobs"]).alias("tops"),
    )


@register(
    "path_slug",
    sql("select doc_id, replace(replace(replace('out/' || source || '.v1 ' || lang, '.', ''), '/', '_'), ' ', '_') as slug from documents"),
)
def slugs(spark, d):
    name = F.concat(F.lit("out/"), "source", F.lit(".v1 "), "lang")
    return r.table(spark, d, "documents").select("doc_id", path_slug(name).alias("slug"))


# --- judge columns ------------------------------------------------------------

_VALID = " and ".join(f"{name} between -3 and 3" for name in SCORES)


@register(
    "judge_validate",
    sql(f"select sample_id, {", ".join(SCORES)}, {_VALID} as valid from scores", "scores"),
)
def judge_validate(spark, d):
    from tandem.functions.judging import judge_valid

    scored = r.score_columns(r.predicted(spark, d))
    return scored.select("sample_id", *SCORES, judge_valid().alias("valid"))


@register("judge_total", sql(f"select sample_id, {r6(r.TOTAL_SQL)} as total from scores", "scores"))
def totals(spark, d):
    scored = r.score_columns(r.predicted(spark, d))
    return scored.select("sample_id", judge_total().alias("total"))


# --- splits: the event log is long enough for every slice ----------------------

r.cte("rows_", "select event_id as sample_id, event_type, case when event_id % 7 = 3 then null else props end as props from events")


def _events(spark, d):
    key = F.col("event_id")
    return r.table(spark, d, "events").select(
        key.alias("sample_id"), "event_type", F.when(key % 7 != 3, F.col("props")).alias("props")
    )


_SLICES = {
    "train": "select * from rows_ order by sample_id limit 3000",
    "validation": "select * from rows_ order by sample_id limit 300 offset 3000",
    "test": "select * from rows_ order by sample_id desc limit 300",
    "full": "select * from rows_",
}


def _register_split(name: str) -> None:
    @register(f"split_{name}", sql(_SLICES[name], "rows_"))
    def build(spark, d):
        return take_split(_events(spark, d), name)


for _name in _SLICES:
    _register_split(_name)


@register(
    "split_then_dropna",
    sql(
        f"""select sample_id, event_type as biased, props as neutral
            from ({_SLICES["train"]}) where props is not null""",
        "rows_",
    ),
)
def split_then_dropna(spark, d):
    rows = _events(spark, d).select(
        "sample_id", F.col("event_type").alias("biased"), F.col("props").alias("neutral")
    )
    return split_pairs(rows, "train")


@register(
    "batch_assign",
    sql(
        """select sample_id, row_idx, row_idx // 25 as iteration, row_idx % 25 as sample_idx
           from (select sample_id, row_number() over (order by sample_id) - 1 as row_idx from clean)""",
        "clean",
    ),
)
def batch_assign(spark, d):
    return assign_batches(r.clean(spark, d)).select(
        "sample_id", "row_idx", "iteration", "sample_idx"
    )


_PART = "select doc_id, text, '{0}' as s from ({1})"
_SHARED = """select '{a}' as split_a, '{b}' as split_b, '{kind}' as shared,
  count(*) as rows from parts where s = '{a}' and {by} in (select {by} from parts where s = '{b}')"""


@register(
    "split_overlap",
    sql(
        "WITH parts as ("
        + " union all ".join(
            _PART.format(name, _SLICES[name].replace("rows_", "documents").replace("sample_id", "doc_id"))
            for name in ("train", "validation", "test")
        )
        + ") "
        + " union all ".join(
            _SHARED.format(a=a, b=b, kind=kind, by=by)
            for kind, by in (("row", "doc_id"), ("text", "text"))
            for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
        )
    ),
)
def overlap(spark, d):
    return split_overlap(r.table(spark, d, "documents"), "doc_id", "text")


# --- ranked log ---------------------------------------------------------------


@register(
    "ranked_rows",
    sql(
        """select 3::BIGINT as iteration, sample_id as sample_idx, biased as biased_text,
             id as response_id, id as original_rank, judge_rank, text as response_text from merged""",
        "merged",
    ),
)
def ranked_rows(spark, d):
    ranked = rank_candidates(r.ranked_input(spark, d))
    rows = rank_rows(
        ranked.withColumns({"iteration": F.lit(3), "sample_idx": F.col("sample_id")})
    )
    path = new_path(spark, "rankings")
    logs.append_rankings(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@register(
    "metrics_long",
    sql(
        f"""WITH m as (select avg(n_chars) as mean_chars, count(*)::DOUBLE as documents_seen, lang, doc_id % 3 as epoch
              from documents group by lang, epoch), l as (select distinct lang from documents)
            select 'eval_' || lang as run, 'param' as kind, 'base_model_name' as key, null::BIGINT as step,
              null::DOUBLE as number, 'base' as text from l
            union all select 'eval_' || lang, 'tag', 'task', null, null, 'evaluation' from l
            union all select 'eval_' || lang, 'metric', 'mean_chars', epoch, {r6("mean_chars")}, null from m
            union all select 'eval_' || lang, 'metric', 'documents_seen', epoch, {r6("documents_seen")}, null from m"""
    ),
)
def run_log(spark, d):
    path = new_path(spark, "runs")
    measured = (
        r.table(spark, d, "documents")
        .groupBy("lang", (F.col("doc_id") % 3).alias("epoch"))
        .agg(F.avg("n_chars").alias("mean_chars"), F.count(F.lit(1)).alias("documents_seen"))
    )
    rows = logs.metrics_long(
        measured,
        F.concat(F.lit("eval_"), "lang"),
        {"base_model_name": "base"},
        {"task": "evaluation"},
        metrics=["mean_chars", "documents_seen"],
        step=F.col("epoch"),
    )
    logs.append_run_log(rows, path)
    return spark.read.schema(rows.schema).parquet(path)

