"""Inputs of the registered queries, derived from the given tables in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import h, h_col, h_sql
from tandem.functions.judging import SCORES
from tandem.functions.text import words
from tandem.operators.ranking import candidates
from tandem.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- common table expressions, each with those it reads -----------------------

CTES: dict[str, tuple[str, ...]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, *needs)


def sql(body: str, *needs: str) -> str:
    """``body`` after the named expressions and all that they read.

    A body that starts with WITH has its own expressions appended.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][1:]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({CTES[name][0]})" for name in ordered]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


WORDS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def words_sql(text: str) -> str:
    return WORDS_SQL.format(text)


def thinned_sql(tokens: str, digit: str) -> str:
    """Text of the tokens whose digest does not start with ``digit``."""
    return (
        f"array_to_string(list_filter({tokens}, "
        f"lambda w: substr(md5(w), 1, 1) <> '{digit}'), ' ')"
    )


def thinned(tokens, digit: str):
    kept = F.filter(tokens, lambda w: F.substring(F.md5(w), 1, 1) != digit)
    return F.array_join(kept, " ")


# --- text pairs ---------------------------------------------------------------

cte(
    "pairs",
    """select u.conv_id*1000+u.turn as sample_id, u.text as biased,
       case when (u.conv_id*1000+u.turn)%7=3 then null else a.text end as neutral
       from conversations u join conversations a
         on a.conv_id=u.conv_id and a.turn=u.turn+1
       where u.role='user' and a.role='assistant'""",
)
cte("clean", "select * from pairs where neutral is not null", "pairs")
cte(
    "pred",
    "select *, " + thinned_sql("string_split(neutral, ' ')", "0") + " as predicted from clean",
    "clean",
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("biased")
    )
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    key = F.col("conv_id") * 1000 + F.col("turn")
    return asked.join(answered, ["conv_id", "turn"]).select(
        key.alias("sample_id"), "biased", F.when(key % 7 != 3, F.col("answer")).alias("neutral")
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).filter("neutral is not null")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).withColumn(
        "predicted", thinned(F.split("neutral", " ", -1), "0")
    )


# --- judge --------------------------------------------------------------------


def judge_call(row: dict) -> dict | None:
    """Scores by digest; every tenth sample fails, the one after is silent."""
    sample = row["sample_id"]
    if sample % 10 == 0:
        raise RuntimeError("judge failed")
    if sample % 10 == 1:
        return None
    return {name: h(f"{sample}|{name}") % 9 - 4 for name in SCORES} | {"overall_reasoning": "ok"}


_SCORE_COLUMNS = ", ".join(
    f"{h_sql(f"sample_id || '|{name}'")} % 9 - 4 as {name}" for name in SCORES
)
_IN_RANGE = " and ".join(f"{name} between -3 and 3" for name in SCORES)
TOTAL_SQL = "(neutrality + meaning_preservation + 0.5*fluency + 0.5*edit_minimality)::DOUBLE / 9.0"
cte("scores", f"select sample_id, biased, neutral, predicted, {_SCORE_COLUMNS} from pred", "pred")
cte(
    "judged_rows",
    f"""select *, answered and {_IN_RANGE} as ok,
        case when answered and {_IN_RANGE} then {TOTAL_SQL} else 0.0 end as score
        from (select *, sample_id % 10 not in (0, 1) as answered from scores)""",
    "scores",
)


def score_columns(df: DataFrame) -> DataFrame:
    """The digest scores as columns, without a call."""
    return df.withColumns(
        {
            name: (
                h_col(F.concat(F.col("sample_id").cast("string"), F.lit(f"|{name}"))) % 9 - 4
            ).cast("int")
            for name in SCORES
        }
    )


# --- ranked candidates --------------------------------------------------------

_REF = words_sql("neutral")
cte(
    "cands",
    f"""select sample_id, biased, neutral, u.id, u.text from (
          select *, [neutral, {thinned_sql(_REF, "1")}, {thinned_sql(_REF, "2")},
                     {thinned_sql(_REF, "3")}] as texts from clean) t,
        lateral (select unnest(range(4)) as id, unnest(texts) as text) u""",
    "clean",
)
cte(
    "judged",
    f"""select sample_id, id as seq, id, {h_sql("sample_id || '|rank|' || id")} % 4 as rank
          from cands where {h_sql("sample_id || '|miss|' || id")} % 11 <> 0 and sample_id % 13 <> 0
        union all
        select sample_id, 10, 9, 0 from clean where sample_id % 5 = 0 and sample_id % 13 <> 0
        union all
        select sample_id, 11, 1, {h_sql("sample_id || '|dup|1'")} % 4
          from clean where sample_id % 6 = 0 and sample_id % 13 <> 0""",
    "cands",
    "clean",
)
cte(
    "merged",
    """select c.*, coalesce(j.rank, c.id) as judge_rank from cands c
       left join (select sample_id, id, arg_max(rank, seq) as rank from judged group by all) j
         on j.sample_id = c.sample_id and j.id = c.id""",
    "cands",
    "judged",
)
cte(
    "places",
    """select *, row_number() over (partition by sample_id order by judge_rank, id) - 1 as place
       from merged""",
    "merged",
)
cte(
    "said",
    """select sample_id, seq, id, rank from judged
       union all select sample_id, id, id, id from cands where sample_id % 13 = 0""",
    "judged",
    "cands",
)


def response_texts():
    tokens = words(F.col("neutral"))
    return F.array(*(thinned(tokens, digit) for digit in "123"))


def ranked_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a judge's list: gaps, ties, unknown and repeated ids, failures."""

    def chance(kind: str, at: int):
        return h_col(F.concat(F.col("sample_id").cast("string"), F.lit(f"|{kind}|{at}")))

    def entry(id_: int, rank):
        return F.struct(F.lit(id_).alias("id"), rank.cast("int").alias("rank"))

    def when(condition, id_: int, rank):
        return F.when(condition, F.array(entry(id_, rank))).otherwise(
            F.expr("cast(array() as array<struct<id:int,rank:int>>)")
        )

    sample = F.col("sample_id")
    parts = [when(chance("miss", at) % 11 != 0, at, chance("rank", at) % 4) for at in range(4)]
    parts.append(when(sample % 5 == 0, 9, F.lit(0)))
    parts.append(when(sample % 6 == 0, 1, chance("dup", 1) % 4))
    return clean(spark, sf_dir).select(
        "sample_id",
        "biased",
        "neutral",
        candidates(F.col("neutral"), response_texts()).alias("candidates"),
        F.when(sample % 13 != 0, F.concat(*parts)).alias("judged"),
        F.when(sample % 13 != 0, F.lit("short reason")).alias("reasoning"),
    )


# --- model answers with reasoning tags ----------------------------------------

cte(
    "resp",
    """select sample_id, biased, neutral, case sample_id % 4
         when 0 then '<think>a' || chr(10) || 'b</think>' || chr(10) || ' ' || biased
         when 1 then '<think>x</think>' || biased || '<think>y</think> '
         when 2 then '<think>open ' || biased
         else biased end as response from pairs""",
    "pairs",
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.col("sample_id") % 4, F.col("biased")
    return pairs(spark, sf_dir).withColumn(
        "response",
        F.when(kind == 0, F.concat(F.lit("<think>a\nb</think>\n "), text))
        .when(kind == 1, F.concat(F.lit("<think>x</think>"), text, F.lit("<think>y</think> ")))
        .when(kind == 2, F.concat(F.lit("<think>open "), text))
        .otherwise(text),
    )


# --- vectors and logits -------------------------------------------------------

SCALE, TOP = 8, 5

cte("vecs", "select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings")
cte(
    "nexts",
    """select a.vec_id, a.v as a, b.v as b from vecs a join vecs b
       on b.vec_id = (a.vec_id + 1) % (select count(*) from vecs)""",
    "vecs",
)
cte("logits", f"select vec_id, list_transform(v, lambda x: x * {SCALE}) as z from vecs", "vecs")
cte(
    "logit_rows",
    "select vec_id, unnest(range(len(z))) as token, unnest(z) as z from logits",
    "logits",
)
cte(
    "logprob_rows",
    """select vec_id, token, z - ln(sum(exp(z)) over w) as logprob,
         row_number() over (partition by vec_id order by z desc, token) - 1 as seq
       from logit_rows window w as (partition by vec_id)""",
    "logit_rows",
)
# The teacher of vector v is vector v+1; every third one repeats a token.
cte(
    "teach",
    f"""select n.vec_id, n.vec_id // 5 as sample_id, n.vec_id % 5 as pos, p.seq, p.token, p.logprob
        from nexts n join logprob_rows p
          on p.vec_id = (n.vec_id + 1) % (select count(*) from vecs) and p.seq < {TOP}
        union all
        select n.vec_id, n.vec_id // 5, n.vec_id % 5, {TOP}, p.token, p.logprob - 0.5
        from nexts n join logprob_rows p
          on p.vec_id = (n.vec_id + 1) % (select count(*) from vecs) and p.seq = 2
        where n.vec_id % 3 = 0""",
    "nexts",
    "logprob_rows",
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    total = own.count()
    following = own.select(
        F.pmod(F.col("vec_id") - 1, F.lit(total)).alias("vec_id"), F.col("a").alias("b")
    )
    return own.join(following, "vec_id")


def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, sample_id, pos, chosen, top): the five best tokens of the next vector."""
    from tandem.functions.arrays import log_softmax

    logits = F.transform("b", lambda x: x.cast("double") * SCALE)
    listed = F.transform(
        log_softmax(logits), lambda lp, at: F.struct((-lp).alias("down"), at.alias("token"))
    )
    best = F.transform(
        F.slice(F.array_sort(listed), 1, TOP),
        lambda e: F.struct(e["token"].alias("token"), (-e["down"]).alias("logprob")),
    )
    repeat = F.transform(
        F.slice("best", 3, 1),
        lambda e: F.struct(e["token"].alias("token"), (e["logprob"] - 0.5).alias("logprob")),
    )
    vec = F.col("vec_id")
    return (
        vectors(spark, sf_dir)
        .select("vec_id", best.alias("best"))
        .select(
            "vec_id",
            F.floor(vec / 5).cast("bigint").alias("sample_id"),
            (vec % 5).cast("int").alias("pos"),
            F.col("best")[0].alias("chosen"),
            F.when(vec % 3 == 0, F.concat("best", repeat)).otherwise(F.col("best")).alias("top"),
        )
    )


def student(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 5).cast("bigint").alias("sample_id"),
        (vec % 5).cast("int").alias("student_pos"),
        F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("logits"),
    )


# Five labels per sample, masked up to sample % 4; every seventh sample has none.
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.col("sample_id")
    samples = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("sample_id")
    )
    masked = F.when(sample % 7 == 6, 5).otherwise((sample % 4).cast("int"))
    return samples.distinct().select(
        sample,
        F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda at: F.when(at < masked, -100).otherwise(at),
        ).alias("labels"),
    )


cte(
    "starts",
    """select distinct vec_id // 5 as sample_id,
         case when (vec_id // 5) % 7 = 6 then null else (vec_id // 5) % 4 end as start
       from embeddings""",
)


# --- classifier rows and logs -------------------------------------------------

cte(
    "cls",
    f"""select doc_id, quality as label,
        case when {h_sql("doc_id || '|pred'")} % 5 = 0 then 1 - quality else quality end as pred
        from labels""",
)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = h_col(F.concat(F.col("doc_id").cast("string"), F.lit("|pred"))) % 5 == 0
    quality = F.col("quality")
    return table(spark, sf_dir, "labels").select(
        "doc_id", quality.alias("label"), F.when(wrong, 1 - quality).otherwise(quality).alias("pred")
    )


cte(
    "logged",
    """select biased as input, r * 1000000000 + sample_id as revision, sample_id,
         'answer ' || r || ' ' || sample_id as response
       from pairs, (values (1), (2)) v(r) where sample_id % 3 = 0""",
    "pairs",
)


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resume log holding a third of the pairs, each twice; revisions are unique."""
    return (
        pairs(spark, sf_dir)
        .filter("sample_id % 3 = 0")
        .select(
            F.col("biased").alias("input"),
            F.explode(F.array(F.lit(1), F.lit(2))).alias("r"),
            "sample_id",
        )
        .select(
            "input",
            (F.col("r") * F.lit(1_000_000_000).cast("bigint") + F.col("sample_id")).alias("revision"),
            "sample_id",
            F.format_string("answer %d %d", "r", "sample_id").alias("response"),
        )
    )


def answer_call(row: dict) -> dict | None:
    """A digest as answer; one text in ten fails."""
    text = row.get("input") or row.get("biased")
    if h(text) % 10 == 0:
        raise RuntimeError("no connection")
    return {"response": f"{h(text)} [Transferred]: done"}


ANSWER_SQL = h_sql("{0}") + " || ' [Transferred]: done'"


def staged(df: DataFrame) -> DataFrame:
    return stage(df, "input")
