"""Evaluation metrics, classifier scores and distillation losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import recipes as r
from checks.recipes import sql
from checks.registry import r6, register, text_sql
from tandem.functions import arrays
from tandem.operators import classify, distil
from tandem.operators.overlap import bleu, bleu_statistics, overlap_by_sample, rouge_n
from tandem.operators.sequences import meteor_by_sample, rouge_l_by_sample
from tandem.operators.similarity import greedy_match_by_sample, similarity_by_sample
from tandem.plans.evaluate import evaluate, metrics_record
from tandem.plans.judging import judge_mean
from tandem.session import stage

# --- BLEU and ROUGE -----------------------------------------------------------


def tokens_13a_sql(text: str) -> str:
    """The published rules, spelled out in SQL's own patterns."""
    for plain, to in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, {text_sql(plain)}, {text_sql(to)})"
    text = f"(' ' || {text} || ' ')"
    signs = r"[!\"#$%&()*+/:;<=>?@\[\\\]^_`{|}~ ]"
    for pattern, shown in (
        (f"({signs})", r" \1 "),
        (r"(\D)([.,])", r"\1 \2 "),
        (r"([.,])(\D)", r" \1 \2"),
        (r"(\d)(-)", r"\1 \2 "),
    ):
        text = f"regexp_replace({text}, {text_sql(pattern)}, {text_sql(shown)}, 'g')"
    return f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')"


def grams_cte(name: str, tokens, orders) -> None:
    """Rows (sample_id, n, gram, p, r) of multiset counts on both sides."""
    r.cte(
        f"{name}_side",
        f"""select sample_id, {tokens("predicted")} as t, 1 as is_p from pred
            union all select sample_id, {tokens("neutral")}, 0 from pred""",
        "pred",
    )
    r.cte(
        f"{name}_at",
        f"""select sample_id, is_p, t, n, unnest(range(1, len(t) - n + 2)) as i
            from {name}_side, (values {", ".join(f"({n})" for n in orders)}) o(n)""",
        f"{name}_side",
    )
    r.cte(
        f"{name}_grams",
        f"""select sample_id, n, array_to_string(list_slice(t, i, i + n - 1), ' ') as gram,
              sum(is_p) as p, sum(1 - is_p) as r
            from {name}_at group by all""",
        f"{name}_at",
    )


grams_cte("bleu", tokens_13a_sql, (1, 2, 3, 4))
grams_cte("rouge", r.words_sql, (1, 2))
r.cte(
    "bleu_stats",
    """select n::BIGINT as n, sum(least(p, r))::BIGINT as matched, sum(p)::BIGINT as total,
         sum(r)::BIGINT as reference from bleu_grams group by n""",
    "bleu_grams",
)
_BLEU = """(select case when min(matched) > 0 and count(*) = 4 then exp(avg(ln(matched / total)))
    * max(case when n = 1 then case when total > reference then 1 else exp(1 - reference / total) end end)
    else 0 end from bleu_stats)"""


@register("bleu_ngram_stats", sql("select * from bleu_stats", "bleu_stats"))
def bleu_ngram_stats(spark, d):
    return bleu_statistics(overlap_by_sample(r.predicted(spark, d), families=["bleu"]))


@register("bleu", sql(f"select {r6(_BLEU)} as bleu", "bleu_stats"))
def bleu_score(spark, d):
    return bleu(overlap_by_sample(r.predicted(spark, d), families=["bleu"]))


r.cte(
    "rouge_f",
    """select sample_id, n, case when sum(least(p, r)) > 0
         then 2.0 * sum(least(p, r)) / (sum(p) + sum(r)) else 0 end as f
       from rouge_grams group by sample_id, n""",
    "rouge_grams",
)
_ROUGE = "((select sum(f) from rouge_f where n = {}) / (select count(*) from pred))"


@register(
    "rouge_n",
    sql(f"select {r6(_ROUGE.format(1))} as rouge1, {r6(_ROUGE.format(2))} as rouge2", "rouge_f"),
)
def rouge(spark, d):
    return rouge_n(overlap_by_sample(r.predicted(spark, d), families=["rouge"]))


# Row by row of the subsequence table: a running maximum replaces the left neighbour.
_LCS = f"""WITH RECURSIVE lists as (select sample_id, {r.words_sql("predicted")} as p, {r.words_sql("neutral")} as t from pred),
  left_words as (select sample_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as word from lists),
  cells(sample_id, i, j, word, best) as (
    select sample_id, 0::BIGINT, unnest(range(1, len(t) + 1)), unnest(t), 0::BIGINT from lists
    union all
    select sample_id, i + 1, j, word,
      max(greatest(best, case when found then before + 1 else 0 end))
        over (partition by sample_id order by j)
    from (select c.*, l.word = c.word as found,
            coalesce(lag(best) over (partition by c.sample_id order by j), 0) as before
          from cells c join left_words l on l.sample_id = c.sample_id and l.i = c.i + 1)),
  ends as (select sample_id, max(best) as m from cells group by sample_id),
  rl as (select sample_id, case when m > 0 then 2.0 * m / (len(p) + len(t)) else 0 end as f
         from lists left join ends using (sample_id))"""


@register("rouge_l", sql(f'{_LCS} select sample_id, {r6("f")} as "rougeL" from rl', "pred"))
def rouge_l(spark, d):
    return rouge_l_by_sample(r.predicted(spark, d))


# --- METEOR -------------------------------------------------------------------

r.cte(
    "met_words",
    f"""select sample_id, 1 as is_p, unnest(range(len(t))) as pos, unnest(t) as word
          from (select sample_id, {r.words_sql("predicted")} as t from pred)
        union all
        select sample_id, 0, unnest(range(len(t))), unnest(t)
          from (select sample_id, {r.words_sql("neutral")} as t from pred)""",
    "pred",
)
r.cte(
    "met_nth",
    """select *, row_number() over (partition by sample_id, is_p, word order by pos desc) as nth
       from met_words""",
    "met_words",
)
r.cte(
    "met_matches",
    """select p.sample_id, p.pos as i, t.pos as j,
         lag(p.pos) over w as i0, lag(t.pos) over w as j0
       from met_nth p join met_nth t
         on p.sample_id = t.sample_id and p.word = t.word and p.nth = t.nth
       where p.is_p = 1 and t.is_p = 0
       window w as (partition by p.sample_id order by p.pos)""",
    "met_nth",
)
r.cte(
    "met",
    """select s.sample_id, coalesce(m, 0) as matches, coalesce(c, 0) as chunks,
         coalesce(np, 0) as predicted_words, coalesce(nt, 0) as reference_words,
         case when m > 0 then (1 - 0.5 * pow(c / m, 3)) *
           (m / np) * (m / nt) / (0.9 * (m / np) + 0.1 * (m / nt)) else 0 end as meteor
       from pred s
       left join (select sample_id, count(*) as m,
                    count(*) filter (not coalesce(i = i0 + 1 and j = j0 + 1, false)) as c
                  from met_matches group by sample_id) using (sample_id)
       left join (select sample_id, sum(is_p)::BIGINT as np, sum(1 - is_p)::BIGINT as nt
                  from met_words group by sample_id) using (sample_id)""",
    "met_matches",
)


@register(
    "meteor_exact",
    sql(
        f"""select sample_id, matches, chunks, predicted_words, reference_words,
            {r6("meteor")} as meteor from met""",
        "met",
    ),
)
def meteor_exact(spark, d):
    return meteor_by_sample(r.predicted(spark, d))


# --- vectors ------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1] * x[2]))"
r.cte(
    "cosines",
    f"""select vec_id, {_DOT.format("a", "b")} /
          (sqrt({_DOT.format("a", "a")}) * sqrt({_DOT.format("b", "b")})) as similarity
        from nexts""",
    "nexts",
)


@register(
    "semantic_similarity",
    sql(f"select {r6("avg(similarity)")} as semantic_similarity, count(*) as pairs from cosines", "cosines"),
)
def semantic_similarity(spark, d):
    return similarity_by_sample(r.vectors(spark, d), "vec_id", "a", "b").agg(
        F.avg("similarity").alias("semantic_similarity"), F.count(F.lit(1)).alias("pairs")
    )


# Five vectors make one document; the other document holds their successors.
r.cte(
    "cross_cos",
    f"""select x.vec_id // 5 as doc, x.vec_id as i, y.vec_id as j,
          {_DOT.format("x.a", "y.b")} / (sqrt({_DOT.format("x.a", "x.a")}) * sqrt({_DOT.format("y.b", "y.b")})) as c
        from nexts x join nexts y on x.vec_id // 5 = y.vec_id // 5""",
    "nexts",
)
r.cte(
    "greedy",
    """select doc, 2 * p * t / (p + t) as f from
         (select doc, avg(best) as p from
            (select doc, i, max(c) as best from cross_cos group by doc, i) group by doc)
         join (select doc, avg(best) as t from
            (select doc, j, max(c) as best from cross_cos group by doc, j) group by doc)
         using (doc)""",
    "cross_cos",
)


def _vector_documents(spark, d):
    def listed(name):
        entries = F.array_sort(F.collect_list(F.struct("vec_id", F.col(name).alias("v"))))
        return F.transform(entries, lambda e: e["v"])

    return (
        r.vectors(spark, d)
        .groupBy(F.floor(F.col("vec_id") / 5).cast("bigint").alias("doc"))
        .agg(listed("a").alias("a"), listed("b").alias("b"))
    )


@register(
    "greedy_match_f1", sql(f"select doc, {r6("f")} as bertscore_f1 from greedy", "greedy")
)
def greedy_match(spark, d):
    return greedy_match_by_sample(_vector_documents(spark, d), "doc", "a", "b")


# --- judge and full record ----------------------------------------------------

r.cte(
    "judge_sum",
    """select avg(score) as all_rows, avg(score) filter (ok) as ok_rows,
         count(*) filter (not ok) as failures from judged_rows""",
    "judged_rows",
)


@register(
    "judge_mean",
    sql(
        f"""select {r6("all_rows")} as judge_score, {r6("ok_rows")} as judge_score_ok, failures
            from judge_sum""",
        "judge_sum",
    ),
)
def judge_means(spark, d):
    return judge_mean(_judged(spark, d))


def _judged(spark, d):
    from tandem.plans.judging import judge

    rows = r.predicted(spark, d).select(
        "sample_id", "biased", F.col("predicted").alias("output"), F.col("neutral").alias("reference")
    )
    return judge(rows, r.judge_call, "judge-1")


# Each pair takes the vectors and the vector document with its row's remainder.
_AT = "sample_id % (select count(*) from {})"
r.cte(
    "vec_scores",
    f"""select sample_id, similarity, f from pred
        join cosines on vec_id = {_AT.format("embeddings")}
        join greedy on doc = ({_AT.format("embeddings")}) // 5""",
    "pred",
    "cosines",
    "greedy",
)


def _vectors_for(texts, spark, d):
    """Vectors of each text, by remainder; every text has exactly one row."""
    vectors = r.vectors(spark, d)
    total = vectors.count()
    documents = _vector_documents(spark, d).select(
        "doc", F.col("a").alias("predicted_vecs"), F.col("b").alias("neutral_vecs")
    )
    return (
        texts.select("sample_id", (F.col("sample_id") % total).alias("vec_id"))
        .join(vectors.select("vec_id", F.col("a").alias("predicted_vec"), F.col("b").alias("neutral_vec")), "vec_id")
        .withColumn("doc", F.floor(F.col("vec_id") / 5).cast("bigint"))
        .join(documents, "doc")
    )


_EVALUATE = f"""select {r6("100 * " + _BLEU)} as bleu,
  {r6("(select 100 * avg(meteor) from met)")} as meteor,
  {r6("100 * " + _ROUGE.format(1))} as rouge1, {r6("100 * " + _ROUGE.format(2))} as rouge2,
  {r6("(select 100 * avg(f) from rl)")} as "rougeL",
  {r6("(select 100 * avg(similarity) from vec_scores)")} as semantic_similarity,
  {r6("(select 100 * avg(f) from vec_scores)")} as bertscore_f1,
  {r6("(select all_rows from judge_sum)")} as judge_score"""


@register(
    "evaluate",
    sql(f"{_LCS} {_EVALUATE}", "pred", "bleu_stats", "rouge_f", "met", "vec_scores", "judge_sum"),
)
def evaluation(spark, d):
    texts = stage(r.predicted(spark, d), "pairs")
    rows = texts.select(
        "sample_id", "biased", F.col("predicted").alias("output"), F.col("neutral").alias("reference")
    )
    from tandem.plans.judging import judge

    return evaluate(texts, judge(rows, r.judge_call, "judge-1"), _vectors_for(texts, spark, d))


@register(
    "metrics_record",
    sql(
        f"""select lang, {r6("avg(n_chars) * 100")} as bleu, {r6("-1.0")} as meteor,
              {r6("max(n_chars) * 100")} as rouge1, {r6("min(n_chars) * 100")} as rouge2,
              {r6("-1.0")} as "rougeL", {r6("count(*) * 100")} as semantic_similarity,
              {r6("0.0")} as bertscore_f1, {r6("avg(doc_id)")} as judge_score
            from documents group by lang"""
    ),
)
def record(spark, d):
    none = F.lit(None).cast("double")
    raw = (
        r.table(spark, d, "documents")
        .groupBy("lang")
        .agg(
            F.avg("n_chars").alias("bleu"),
            F.max("n_chars").alias("rouge1"),
            F.min("n_chars").alias("rouge2"),
            F.count(F.lit(1)).alias("semantic_similarity"),
            F.avg("doc_id").alias("judge_score"),
        )
        .withColumns({"meteor": none, "rougeL": none, "bertscore_f1": none})
    )
    return metrics_record(raw, keep=["lang"])


# --- classifier ---------------------------------------------------------------


@register("cls_accuracy", sql(f"select {r6("avg((label = pred)::INT)")} as accuracy from cls", "cls"))
def cls_accuracy(spark, d):
    return classify.accuracy(r.classified(spark, d))


@register(
    "cls_weighted_f1",
    sql(
        f"""WITH c as (select distinct label as k from cls),
            s as (select k, (select count(*) from cls where label = k and pred = k) as tp,
                (select count(*) from cls where pred = k) as predicted,
                (select count(*) from cls where label = k) as support from c)
            select {r6("sum(support * 2.0 * tp / (predicted + support)) / sum(support)")} as f1 from s""",
        "cls",
    ),
)
def cls_f1(spark, d):
    return classify.weighted_f1(r.classified(spark, d))


@register(
    "argmax_class",
    sql("select vec_id, list_position(v, list_max(v)) - 1 as class from vecs", "vecs").replace(
        "list_position(v, list_max(v)) - 1", "(list_position(v, list_max(v)) - 1)::BIGINT"
    ),
)
def argmax_class(spark, d):
    return r.table(spark, d, "embeddings").select(
        "vec_id", arrays.argmax(F.col("embedding")).alias("class")
    )


@register(
    "loss_summary",
    sql(
        f"""select 'epoch' as kind, event_id // 1000 as "at", {r6("avg(value)")} as loss from events group by all
            union all select 'step', event_id, {r6("value")} from events where event_id % 10 = 0"""
    ),
)
def loss_summary(spark, d):
    step = F.col("event_id")
    steps = r.table(spark, d, "events").select(
        step.alias("step"), F.floor(step / 1000).alias("epoch"), F.col("value").alias("loss")
    )
    return classify.loss_summary(steps)


# Every fifth pair is held out; three passes over the others, step by step.
_RATE, _PASSES = 0.5, 3
r.cte(
    "cl_texts",
    """select sample_id, sample_id % 5 = 0 as held, 1 as label, biased as text from clean
       union all select sample_id, sample_id % 5 = 0, 0, neutral from clean""",
    "clean",
)
r.cte(
    "cl_shares",
    f"""select sample_id, held, label, word, count(*) / any_value(n)::DOUBLE as x
        from (select sample_id, held, label, len(t) as n, unnest(t) as word
              from (select *, {r.words_sql("text")} as t from cl_texts)) group by sample_id, held, label, word""",
    "cl_texts",
)
r.cte("cl_words", "select word from cl_shares where not held group by word having count(*) >= 2", "cl_shares")
r.cte("cl_rows", "select count(*) as rows from cl_texts where not held", "cl_texts")
r.cte("cl_weight_0", "select word, 0.0::DOUBLE as weight, 0.0::DOUBLE as constant from cl_words", "cl_words")
for _at in range(1, _PASSES + 1):
    r.cte(
        f"cl_apart_{_at}",
        f"""select sample_id, label, 1 / (1 + exp(-(coalesce(m, 0) + coalesce((select any_value(constant) from cl_weight_{_at - 1}), 0)))) - label as apart
            from cl_texts left join (select sample_id, label, sum(x * weight) as m from cl_shares join cl_weight_{_at - 1} using (word)
              group by all) using (sample_id, label) where not held""",
        "cl_texts",
        "cl_shares",
        f"cl_weight_{_at - 1}",
    )
    r.cte(
        f"cl_weight_{_at}",
        f"""select word, weight - {_RATE} / (select rows from cl_rows) * slope as weight,
              constant - {_RATE} / (select rows from cl_rows) * (select sum(apart) from cl_apart_{_at}) as constant
            from cl_weight_{_at - 1} join (select word, sum(x * apart) as slope
              from cl_shares join cl_apart_{_at} using (sample_id, label) where not held group by word) using (word)""",
        f"cl_weight_{_at - 1}",
        f"cl_apart_{_at}",
        "cl_shares",
        "cl_rows",
    )


@register(
    "train_text_classifier",
    sql(
        f"""select sample_id, label::BIGINT as label, {r6("1000 * (coalesce(m, 0) + constant)")} as margin,
              (coalesce(m, 0) + constant >= 0)::BIGINT as pred
            from cl_texts left join (select sample_id, label, sum(x * weight) as m from cl_shares join cl_weight_{_PASSES} using (word)
              group by all) using (sample_id, label), (select any_value(constant) as constant from cl_weight_{_PASSES}) where held""",
        f"cl_weight_{_PASSES}",
    ),
)
def text_classifier(spark, d):
    pairs = r.staged(r.clean(spark, d))
    held = F.col("sample_id") % 5 == 0
    model = classify.train_text_classifier(pairs.where(~held), _PASSES, _RATE)
    scored = classify.classify_pairs(model, pairs.where(held))
    return scored.withColumn("margin", 1000 * F.col("margin"))


# --- teacher and student ------------------------------------------------------


@register(
    "logprob_flatten",
    sql(
        f"""select t.vec_id as sample_id, 0::BIGINT as pos, c.token::VARCHAR as token,
              {r6("c.logprob")} as logprob, t.seq::BIGINT as top_idx, t.token::VARCHAR as top_token,
              {r6("t.logprob")} as top_logprob
            from teach t join teach c on c.vec_id = t.vec_id and c.seq = 0 where t.vec_id % 17 <> 0
            union all select vec_id, 0, token::VARCHAR, {r6("logprob")}, null, null, null
            from teach t where t.seq = 0 and vec_id % 17 = 0""",
        "teach",
    ),
)
def logprob_flatten(spark, d):
    def entry(c):
        return [c["token"].cast("string").alias("token"), c["logprob"].alias("logprob")]

    tops = F.transform("top", lambda t: F.struct(*entry(t)))
    response = F.struct(
        *entry(F.col("chosen")),
        F.when(F.col("vec_id") % 17 != 0, tops).alias("top_logprobs"),
    )
    rows = r.teacher(spark, d).select(
        F.col("vec_id").alias("sample_id"), F.array(response).alias("logprobs")
    )
    return distil.flatten_logprobs(rows)


@register(
    "teacher_token_ids",
    sql(
        f"""select vec_id as sample_id, seq - 1 as place,
              case when token % 5 <> 0 then token + 2 end as id, {r6("logprob")} as logprob
            from (select vec_id, 0 as seq, token, logprob from teach where seq = 0
                  union all select vec_id, seq + 1, token, logprob from teach)""",
        "teach",
    ),
)
def teacher_token_ids(spark, d):
    """Token texts, after a space and with further pieces, to ids; every fifth is not in the vocabulary."""
    from tandem.plans.distillation import with_token_ids

    def named(c):
        rest = F.when(c["token"] % 2 == 0, "-more").otherwise(" ")
        return [F.concat(F.lit(" "), c["token"].cast("string"), rest).alias("token"), c["logprob"].alias("logprob")]

    tops = F.transform("top", lambda t: F.struct(*named(t))).alias("top_logprobs")
    rows = r.staged(r.teacher(spark, d)).select(
        F.col("vec_id").alias("sample_id"),
        F.array(F.struct(*named(F.col("chosen")), tops)).alias("logprobs"),
    )
    token = F.explode_outer(F.transform("embedding", lambda x, at: at)).alias("id")
    vocabulary = (
        r.table(spark, d, "embeddings")
        .select(token)
        .distinct()
        .filter("id % 5 <> 0")
        .select(F.col("id").cast("string").alias("token"), (F.col("id") + 2).alias("token_id"))
    )
    all_entries = F.concat(F.array("chosen"), "top")
    return (
        with_token_ids(rows, vocabulary)
        .select("sample_id", F.posexplode_outer(all_entries).alias("place", "e"))
        .select(
            "sample_id",
            (F.col("place") - 1).cast("int").alias("place"),
            F.col("e.token").cast("bigint").alias("id"),
            "e.logprob",
        )
    )


T = distil.TEMPERATURE
# The chosen token is the first entry; it is not counted again among the others.
r.cte("entries", f"select *, exp(logprob / {T}) as p from teach", "teach")
r.cte(
    "dist",
    """select vec_id, sample_id, pos, token, arg_max(p, seq) as p from entries group by all""",
    "entries",
)
r.cte(
    "cover",
    "select vec_id, sample_id, pos, sum(p) as coverage from entries group by all",
    "entries",
)


@register(
    "teacher_distribution",
    sql(
        f"""select vec_id, d.token::BIGINT as token, {r6("d.p")} as p, {r6("coverage")} as coverage
            from dist d join cover using (vec_id)""",
        "dist",
        "cover",
    ),
)
def teacher_distribution(spark, d):
    return (
        distil.teacher_distribution(r.teacher(spark, d))
        .select("vec_id", "coverage", F.explode_outer("dist").alias("e"))
        .select("vec_id", "e.token", "e.p", "coverage")
    )


r.cte(
    "soft",
    f"""select vec_id, token, z / {T} - ln(sum(exp(z / {T})) over w) as s
        from logit_rows window w as (partition by vec_id)""",
    "logit_rows",
)


@register(
    "log_softmax",
    sql(f"select vec_id, token::BIGINT as token, {r6("s")} as s from soft", "soft"),
)
def log_softmax(spark, d):
    logits = F.transform("embedding", lambda x: x.cast("double") * r.SCALE)
    return r.table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(arrays.log_softmax(logits, T)).alias("token", "s")
    )


# Teacher positions without a top list, where vec_id % 17 = 0, are skipped.
def _teacher(spark, d):
    none = F.expr("cast(array() as array<struct<token:int,logprob:double>>)")
    return r.teacher(spark, d).withColumn(
        "top", F.when(F.col("vec_id") % 17 == 0, none).otherwise(F.col("top"))
    )


r.cte(
    "aligned",
    """select t.vec_id, t.sample_id, t.pos, s.start - 1 + t.pos as student_pos
       from (select distinct vec_id, sample_id, pos from teach) t
       join starts s using (sample_id) where s.start is not null and s.start - 1 + t.pos >= 0""",
    "teach",
    "starts",
)
r.cte(
    "kl_pos",
    """with used as (select a.*, a.sample_id * 5 + a.student_pos as student_vec from aligned a
         where a.student_pos < 5 and a.vec_id % 17 <> 0
           and a.sample_id * 5 + a.student_pos in (select vec_id from embeddings)),
       mass as (select vec_id, sum(p) as total from dist group by vec_id)
       select u.sample_id, u.pos, any_value(c.coverage) as coverage,
         any_value(c.coverage) < 0.8 as low_coverage,
         case when any_value(c.coverage) < 0.8 then -sum(coalesce(d.p, 0) * s.s)
           else sum(greatest(coalesce(d.p / m.total, 0), 1e-8) *
             (ln(greatest(coalesce(d.p / m.total, 0), 1e-8)) - s.s)) end as loss
       from used u join soft s on s.vec_id = u.student_vec
       left join dist d on d.vec_id = u.vec_id and d.token = s.token
       join mass m on m.vec_id = u.vec_id
       join cover c on c.vec_id = u.vec_id
       group by u.sample_id, u.pos""",
    "aligned",
    "dist",
    "cover",
    "soft",
)
r.cte(
    "kl",
    f"""select s.sample_id, k from starts s left join
        (select sample_id, avg(loss) * {T * T} as k from kl_pos group by sample_id) using (sample_id)""",
    "kl_pos",
    "starts",
)


def _positions(spark, d):
    return distil.position_losses(_teacher(spark, d), r.student(spark, d), r.labels(spark, d))


@register(
    "logit_align",
    sql("select sample_id, pos::BIGINT as pos, student_pos::BIGINT as student_pos from aligned", "aligned"),
)
def logit_align(spark, d):
    return distil.align(r.teacher(spark, d), r.labels(spark, d)).select(
        "sample_id", "pos", "student_pos"
    )


@register(
    "kl_positions",
    sql(
        f"""select sample_id, pos::BIGINT as pos, {r6("coverage")} as coverage, low_coverage,
            {r6("loss")} as loss from kl_pos""",
        "kl_pos",
    ),
)
def kl_positions(spark, d):
    return _positions(spark, d)


@register("kl_sample", sql(f"select sample_id, {r6("k")} as kl from kl", "kl"))
def kl_sample(spark, d):
    return distil.sample_losses(_positions(spark, d), r.labels(spark, d))


@register(
    "kl_coverage",
    sql(
        f"""WITH t as (select sample_id, count(distinct vec_id) as total from teach group by sample_id),
            u as (select sample_id, count(*) as used, avg(low_coverage::INT) as low_share
                  from kl_pos group by sample_id)
            select sample_id, coalesce(used, 0) as used, total,
              {r6("coalesce(used, 0) / total")} as used_share, {r6("low_share")} as low_share,
              coalesce(used, 0) / total < 0.5 as few_used
            from t left join u using (sample_id)""",
        "teach",
        "kl_pos",
    ),
)
def kl_coverage(spark, d):
    return distil.coverage_report(_positions(spark, d), _teacher(spark, d))


@register(
    "kl_summary",
    sql(
        f"""select sample_id // 4 as batch, {r6("min(k)")} as kl_min, {r6("max(k)")} as kl_max,
              {r6("avg(k)")} as kl_mean, count(k) as used, count(*) as total
            from kl group by batch""",
        "kl",
    ),
)
def kl_summary(spark, d):
    losses = distil.sample_losses(_positions(spark, d), r.labels(spark, d))
    return distil.batch_summary(losses, F.floor(F.col("sample_id") / 4))


@register(
    "loss_mix",
    sql(
        f"""select sample_id, {r6("k")} as kl, {r6("(sample_id % 10) / 4.0")} as hard,
              {r6("coalesce(0.5 * k + 0.5 * (sample_id % 10) / 4.0, (sample_id % 10) / 4.0)")} as loss
            from kl""",
        "kl",
    ),
)
def loss_mix(spark, d):
    from tandem.plans.distillation import distillation_losses

    hard = r.labels(spark, d).select("sample_id", ((F.col("sample_id") % 10) / 4.0).alias("hard"))
    return distillation_losses(_teacher(spark, d), r.student(spark, d), r.labels(spark, d), hard)


_BATCH = "case when sample_id % 2 = 0 then sample_id % 7 else 7 + sample_id % 3 end"


@register(
    "batch_loss",
    sql(
        f"""WITH b as (select {_BATCH} as batch, avg(k) as kl, avg((sample_id % 10) / 4.0) as hard
              from kl group by batch)
            select batch, {r6("kl")} as kl, {r6("hard")} as hard,
              {r6("case when kl is null then hard else 0.5 * kl + 0.5 * hard end")} as loss from b""",
        "kl",
    ),
)
def batch_loss(spark, d):
    """Batches with some, all and no divergences, and hard losses of 0."""
    return distil.batch_loss(loss_mix(spark, d), F.expr(_BATCH))
