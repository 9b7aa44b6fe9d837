"""Evaluation from test split to run log, METEOR by stems, and metrics by epoch."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import recipes as r
from checks.metrics import _EVALUATE, _LCS, _vectors_for
from checks.recipes import sql
from checks.registry import r6, register
from tandem.functions.stems import stems
from tandem.functions.text import words
from tandem.operators import classify
from tandem.operators.sequences import meteor_by_sample
from tandem.plans.evaluation import eval_model
from tandem.session import new_path
from tandem.sources import logs

# --- METEOR: exact words, then stems ------------------------------------------

_ENDINGS = {"1": "s", "2": "ed", "3": "ing", "4": "ly"}
_DIGIT = "substr(md5(w), 1, 1)"
_INFLECTED = "array_to_string(list_transform(list_filter({0}, lambda w: {1} <> '0'), lambda w: w || case {1} {2} else '' end), ' ')".format(
    r.words_sql("neutral"), _DIGIT, " ".join(f"when '{k}' then '{v}'" for k, v in _ENDINGS.items())
)
r.cte("inflected", f"select sample_id, neutral, {_INFLECTED} as predicted from clean", "clean")
r.cte(
    "stem_words",
    f"""select distinct unnest({r.words_sql("predicted")}) as word from inflected
        union select distinct unnest({r.words_sql("neutral")}) from inflected""",
    "inflected",
)


def _kinds(text: str) -> str:
    """One sign per letter, v or c, from the left."""
    return f"""list_reduce([''] || string_split({text}, ''), lambda seen, x: seen || case
        when x in ('a', 'e', 'i', 'o', 'u') then 'v' when x = 'y' and seen[-1:] = 'c' then 'v' else 'c' end)"""


def _measure(kinds: str) -> str:
    return f"((length({kinds}) - length(replace({kinds}, 'vc', ''))) // 2)"


def _stem_step(at: int, body: str) -> None:
    """The next form of each word; ``s`` is the form so far, ``k`` its letters' kinds."""
    r.cte(
        f"stem_{at}",
        f"select word, {body} as s from (select word, s, {_kinds('s')} as k from stem_{at - 1})",
        f"stem_{at - 1}",
    )


def _listed(rules: str, condition: str) -> str:
    """The first rule of a list (place, ending, result) whose ending fits, if its condition holds."""
    return f"""coalesce((select case when {condition} then stem || result else s end
        from (select place, ending, result, s[:-1 - length(ending)] as stem, k[:-1 - length(ending)] as kinds
              from (values {rules}) t(place, ending, result) where ends_with(s, ending)) order by place limit 1), s)"""


def _numbered(rules: str) -> str:
    pairs = [rule.split(":") for rule in rules.split()]
    return ", ".join(f"({at}, '{ending}', '{result}')" for at, (ending, result) in enumerate(pairs))


_SHORT = "((kinds[-3:] = 'cvc' and stem[-1:] not in ('w', 'x', 'y')) or kinds = 'vc')"
r.cte("stem_0", "select word, word as s from stem_words", "stem_words")
_stem_step(1, f"case when s like '%ies' and length(s) = 4 then s[:1] || 'ie' else {_listed(_numbered('sses:ss ies:i ss:ss s:'), 'true')} end")
_PAST = _listed(
    _numbered("ied:i eed:ee ed:! ing:!"),
    f"case ending when 'ied' then true when 'eed' then {_measure('kinds')} > 0 else contains(kinds, 'v') end",
)
_stem_step(2, f"case when s like '%ied' and length(s) = 4 then s[:1] || 'ie' else {_PAST} end")
_stem_step(
    3,
    f"""case when s not like '%!' then s else (select case
          when stem[-2:] in ('at', 'bl', 'iz') then stem || 'e'
          when kinds[-1:] = 'c' and length(stem) > 1 and stem[-1:] = stem[-2:-2] then case when stem[-1:] in ('l', 's', 'z') then stem else stem[:-2] end
          when {_measure("kinds")} = 1 and {_SHORT} then stem || 'e' else stem end
        from (select s[:-2] as stem, k[:-2] as kinds)) end""",
)
_stem_step(4, _listed("(0, 'y', 'i')", "length(stem) > 1 and kinds[-1:] = 'c'"))
_stem_step(5, f"case when s like '%alli' and {_measure('k[:-5]')} > 0 then s[:-3] else s end")
_stem_step(
    6,
    _listed(
        _numbered(
            "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
            "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful logi:log"
        ),
        f"{_measure("(case when ending = 'logi' then k[:-4] else kinds end)")} > 0",
    ),
)
_stem_step(7, _listed(_numbered("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"), f"{_measure('kinds')} > 0"))
_stem_step(
    8,
    _listed(
        _numbered("al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"),
        f"{_measure('kinds')} > 1 and (ending <> 'ion' or stem[-1:] in ('s', 't'))",
    ),
)
_stem_step(9, _listed("(0, 'e', '')", f"{_measure('kinds')} > 1 or ({_measure('kinds')} = 1 and not {_SHORT})"))
_stem_step(10, f"case when s like '%ll' and {_measure('k[:-2]')} > 1 then s[:-2] else s end")
r.cte(
    "word_stems",
    """select w.word, coalesce(i.stem, case when length(w.word) <= 2 then w.word else s end) as class
       from stem_10 w left join (values ('sky', 'sky'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'),
         ('news', 'news'), ('innings', 'inning'), ('inning', 'inning'), ('outings', 'outing'), ('outing', 'outing'),
         ('cannings', 'canning'), ('canning', 'canning'), ('howe', 'howe'), ('proceed', 'proceed'), ('exceed', 'exceed'),
         ('succeed', 'succeed')) i(word, stem) on i.word = w.word""",
    "stem_10",
)


@register("word_stems", sql("select word, class from word_stems", "word_stems"))
def word_stems(spark, d):
    return stems(_inflected_words(spark, d))


def _inflected(spark, d):
    def ended(w):
        digit = F.substring(F.md5(w), 1, 1)
        ending = F.lit("")
        for k, v in _ENDINGS.items():
            ending = F.when(digit == k, v).otherwise(ending)
        return F.concat(w, ending)

    kept = F.filter(words(F.col("neutral")), lambda w: F.substring(F.md5(w), 1, 1) != "0")
    predicted = F.array_join(F.transform(kept, ended), " ")
    return r.clean(spark, d).select("sample_id", "neutral", predicted.alias("predicted"))


def _inflected_words(spark, d):
    both = F.concat(words(F.col("predicted")), words(F.col("neutral")))
    return _inflected(spark, d).select(F.explode(both).alias("word"))


r.cte(
    "stem_tokens",
    f"""select sample_id, 1 as is_p, unnest(range(len(t))) as pos, unnest(t) as word
          from (select sample_id, {r.words_sql("predicted")} as t from inflected)
        union all
        select sample_id, 0, unnest(range(len(t))), unnest(t)
          from (select sample_id, {r.words_sql("neutral")} as t from inflected)""",
    "inflected",
)
r.cte(
    "stem_nth",
    """select *, row_number() over (partition by sample_id, is_p, word order by pos desc) as nth from stem_tokens""",
    "stem_tokens",
)
r.cte(
    "stem_exact",
    """select p.sample_id, p.pos as i, t.pos as j from stem_nth p join stem_nth t using (sample_id, word, nth)
       where p.is_p = 1 and t.is_p = 0""",
    "stem_nth",
)
r.cte(
    "stem_free",
    """select f.*, row_number() over (partition by sample_id, is_p, class order by pos desc) as mth
       from (select t.sample_id, t.is_p, t.pos, w.class from stem_tokens t join word_stems w using (word)
             where not exists (select 1 from stem_exact e where e.sample_id = t.sample_id
               and case t.is_p when 1 then e.i else e.j end = t.pos)) f""",
    "stem_tokens",
    "word_stems",
    "stem_exact",
)
r.cte(
    "stem_met",
    """with m as (select *, lag(i) over w as i0, lag(j) over w as j0 from (
           select *, 0 as by_stem from stem_exact union all
           select p.sample_id, p.pos, t.pos, 1 from stem_free p join stem_free t using (sample_id, class, mth)
           where p.is_p = 1 and t.is_p = 0) window w as (partition by sample_id order by i))
       select s.sample_id, coalesce(n, 0) as matches, coalesce(c, 0) as chunks, coalesce(by_stem, 0)::BIGINT as by_stem,
         coalesce(np, 0) as predicted_words, coalesce(nt, 0) as reference_words,
         case when n > 0 then (1 - 0.5 * pow(c / n, 3)) * (n / np) * (n / nt) / (0.9 * (n / np) + 0.1 * (n / nt)) else 0 end as meteor
       from inflected s
       left join (select sample_id, count(*) as n, sum(by_stem) as by_stem,
                    count(*) filter (not coalesce(i = i0 + 1 and j = j0 + 1, false)) as c from m group by sample_id) using (sample_id)
       left join (select sample_id, sum(is_p)::BIGINT as np, sum(1 - is_p)::BIGINT as nt from stem_tokens group by sample_id) using (sample_id)""",
    "stem_free",
)


@register(
    "meteor_stem",
    sql(
        f"""select sample_id, matches, by_stem, chunks, predicted_words, reference_words, {r6("meteor")} as meteor
            from stem_met""",
        "stem_met",
    ),
)
def meteor_stem(spark, d):
    texts = r.staged(_inflected(spark, d))
    both = F.concat(words(F.col("predicted")), words(F.col("neutral")))
    table = r.staged(stems(texts.select(F.explode(both).alias("word"))))
    exact = meteor_by_sample(texts).select("sample_id", F.col("matches").alias("_exact"))
    scored = meteor_by_sample(texts, classes=[table]).join(exact, "sample_id")
    return scored.withColumn("by_stem", F.col("matches") - F.col("_exact")).drop("_exact")


# --- from test split to run log -----------------------------------------------

TEST_ROWS = 100
_TEST_PRED = (
    "select *, "
    + r.thinned_sql("string_split(biased, ' ')", "0")
    + f" as predicted from (select * from pairs order by sample_id desc limit {TEST_ROWS}) where neutral is not null"
)


def _prompted(prompts: list[str]) -> list[str]:
    """The asked text without words whose digest starts with 0, if the prompt is as it should be."""
    import hashlib

    out = []
    for prompt in prompts:
        head, _, rest = prompt.partition("<|im_end|>\n<|im_start|>user\nMake this neutral: ")
        text, _, end = rest.rpartition("<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n")
        good = head.startswith("<|im_start|>system\n") and not end
        kept = [w for w in text.split(" ") if not hashlib.md5(w.encode()).hexdigest().startswith("0")]
        out.append(" ".join(kept) if good else "bad prompt")
    return out


_PRED = f"pred AS ({r.CTES['pred'][0]})"
_RUN_SQL = sql(
    f"""{_LCS}, record as ({_EVALUATE})
      select 'param' as kind, 'checkpoint_path' as key, null::BIGINT as step, null::DOUBLE as number, 'org/model 1.0' as text
      union all select 'param', 'base_model_name', null, null, 'base'
      union all select 'param', 'judge_model_name', null, null, 'judge-1'
      union all select 'param', 'test_dataset_size', null, null, (select count(*) from pred)::VARCHAR
      union all select 'tag', 'task', null, null, 'evaluation'
      union all select 'metric', name, null, number, null
        from (unpivot (select * from record) on columns(*) into name name value number)
      union all select 'file', 'rows', null, (select count(*) from pred)::DOUBLE,
        (select md5(string_agg(predicted, chr(10) order by sample_id)) from pred)""",
    "pred",
    "bleu_stats",
    "rouge_f",
    "met",
    "vec_scores",
    "judge_sum",
)
assert _PRED in _RUN_SQL


@register("eval_model", _RUN_SQL.replace(_PRED, f"pred AS ({_TEST_PRED})"))
def evaluate_model(spark, d):
    """The run's log, and its prediction file in file order."""
    folder = new_path(spark, "eval_model")
    pairs = r.staged(r.pairs(spark, d))
    rows = eval_model(
        pairs,
        folder,
        "org/model 1.0",
        _prompted,
        r.judge_call,
        "judge-1",
        base_model="base",
        vectors=lambda predicted: _vectors_for(predicted, spark, d),
        sizes={"test": TEST_ROWS},
    )
    file = logs.scan_predictions(spark, f"{folder}/predictions/{logs.slug('org/model 1.0')}")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "predicted"))), lambda e: e["predicted"])
    shown = file.agg(F.count(F.lit(1)).cast("double").alias("number"), F.md5(F.array_join(listed, "\n")).alias("text"))
    none = F.lit(None).cast("bigint").alias("step")
    return rows.select("kind", "key", "step", "number", "text").unionByName(
        shown.select(F.lit("file").alias("kind"), F.lit("rows").alias("key"), none, "number", "text")
    )


# --- validation scores by epoch -----------------------------------------------

r.cte("epochs", "select doc_id % 3 as epoch, label, case when doc_id % 3 = 2 then label else pred end as pred from cls", "cls")


@register(
    "epoch_scores",
    sql(
        f"""WITH c as (select epoch, label as k, count(*) as support from epochs group by all),
            s as (select *, (select count(*) from epochs e where e.epoch = c.epoch and label = k and pred = k) as tp,
                (select count(*) from epochs e where e.epoch = c.epoch and pred = k) as predicted from c),
            f as (select epoch, sum(support * 2.0 * tp / (predicted + support)) / sum(support) as val_f1 from s group by epoch),
            a as (select epoch, avg((label = pred)::INT) as val_accuracy from epochs group by epoch)
            select 'val_accuracy' as key, epoch as step, {r6("val_accuracy")} as number from a
            union all select 'val_f1', epoch, {r6("val_f1")} from f""",
        "epochs",
    ),
)
def epoch_scores(spark, d):
    epoch = F.col("doc_id") % 3
    rows = r.classified(spark, d).withColumn("epoch", epoch)
    rows = rows.withColumn("pred", F.when(F.col("epoch") == 2, F.col("label")).otherwise(F.col("pred")))
    scores = classify.scores_by(rows, "epoch")
    log = logs.metrics_long(scores, F.lit("train"), {}, {}, ["val_accuracy", "val_f1"], F.col("epoch"))
    return log.select("key", "step", "number")
