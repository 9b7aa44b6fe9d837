"""Token tables, training sets, rankings and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import recipes as r
from checks.recipes import sql
from checks.registry import r6, register, text_sql
from checks.texts import PROMPT_TURNS, QUIET_FULL_SQL, QUIET_SQL, rendered_sql
from tandem.functions import arrays
from tandem.functions.prompts import ChatTags
from tandem.functions.text import chat_tokens
from tandem.operators import builders, ranking
from tandem.operators.blocks import TokenBlocks
from tandem.operators.vocabulary import FIRST_ID, block_vocabulary


def tokens_sql(text: str) -> str:
    """Tags, runs of line ends, runs of letters and digits, and single signs that are no white space."""
    kinds = (r"<\|[_a-z]+\|>", "[\\n]+", "[0-9a-zA-Z]+", "[^\\s0-9a-zA-Z]")
    return f"regexp_extract_all({text}, {text_sql('|'.join(kinds))})"


r.cte(
    "doc_tokens",
    f"""select doc_id, unnest(range(len(t))) as pos, unnest(t) as token
        from (select doc_id, {tokens_sql("text")} as t from documents)""",
)
r.cte(
    "doc_vocab",
    f"""select token, count(*) as n,
          row_number() over (order by count(*) desc, token) - 1 + {FIRST_ID} as token_id
        from doc_tokens group by token""",
    "doc_tokens",
)


def _documents(spark, d):
    return r.table(spark, d, "documents").select("doc_id", "text")


@register("vocab_build", sql("select * from doc_vocab", "doc_vocab"))
def vocab_build(spark, d):
    return block_vocabulary(TokenBlocks.of(_documents(spark, d), [], {"tokens": chat_tokens(F.col("text"))})).table


@register(
    "vocab_encode",
    sql(
        """select doc_id, count(*) as tokens, md5(string_agg(token_id, ',' order by pos)) as digest
           from doc_tokens join doc_vocab using (token) group by doc_id""",
        "doc_vocab",
    ),
)
def vocab_encode(spark, d):
    documents = _documents(spark, d)
    tokens = chat_tokens(F.col("text"))
    blocks = TokenBlocks.of(documents, ["doc_id"], {"ids": tokens})
    encoded = block_vocabulary(blocks).encode_blocks(blocks)
    return encoded.select(
        "doc_id",
        F.size("ids").alias("tokens"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"),
    )


# Ids by rule: the length of each word of the source, 0 standing for filling.
_IDS = f"list_transform({r.words_sql('biased')}, lambda w: len(w))"


def _ids(text: str):
    from tandem.functions.text import words

    return F.transform(words(F.col(text)), lambda w: F.length(w))


def _padded_sql(ids: str, n: int, side: str) -> str:
    fill = f"list_resize([]::BIGINT[], greatest({n} - len({ids}), 0)::BIGINT, 0)"
    kept = f"list_slice({ids}, 1, {n})"
    return f"list_concat({fill}, {kept})" if side == "left" else f"list_concat({kept}, {fill})"


@register(
    "pad_truncate",
    sql(
        f"""WITH t as (select sample_id, {_IDS} as ids from pairs)
            select sample_id,
              array_to_string({_padded_sql("ids", 512, "right")}, ',') as padded,
              array_to_string({_padded_sql("ids", 32, "left")}, ',') as padded_left,
              array_to_string(list_transform(range(512),
                lambda i: case when i < len(ids) then 1 else 0 end), ',') as attention
            from t""",
        "pairs",
    ),
)
def pad_truncate(spark, d):
    rows = r.pairs(spark, d).select("sample_id", _ids("biased").alias("ids"))
    ids = F.col("ids")
    return rows.select(
        "sample_id",
        arrays.pad_truncate(ids, 512).alias("padded"),
        arrays.pad_truncate(ids, 32, side="left").alias("padded_left"),
        arrays.attention_mask(ids, 512).alias("attention"),
    )


@register(
    "pad_or_end",
    sql(
        f"""WITH t as (select sample_id, {_IDS} as ids, case when sample_id % 2 = 0 then 7 end as pad, 99 as eos from pairs)
            select sample_id, array_to_string(list_concat(list_slice(ids, 1, 16),
              list_transform(range(16 - least(len(ids), 16)), lambda i: coalesce(pad, eos))), ',') as padded from t""",
        "pairs",
    ),
)
def pad_or_end(spark, d):
    """Rows of a tokenizer without a padding id are filled with the end id."""
    rows = r.pairs(spark, d).select("sample_id", _ids("biased").alias("ids"))
    pad = arrays.pad_id_or_eos(F.when(F.col("sample_id") % 2 == 0, 7), F.lit(99))
    return rows.select("sample_id", arrays.pad_truncate(F.col("ids"), 16, pad).alias("padded"))


# The prompt is the first words of the same text; ids 2 and 3 count as newlines.
_LABELS = f"""WITH t as (select sample_id, {_padded_sql("ids", 512, "right")} as full_ids,
    least(sample_id % 40, len(ids), 512) as prompt_len
    from (select sample_id, {_IDS} as ids from pairs)),
  u as (select *, coalesce(list_min(list_filter(range(512),
      lambda i: i >= prompt_len and full_ids[i + 1] not in (2, 3))), 512) as start from t)"""


def _labelled(spark, d):
    rows = r.pairs(spark, d).select("sample_id", _ids("biased").alias("ids"))
    rows = rows.withColumn("full", arrays.pad_truncate(F.col("ids"), 512))
    prompt = F.slice("ids", F.lit(1), F.least(F.col("sample_id") % 40, F.lit(512)).cast("int"))
    labels = arrays.label_mask(F.col("full"), prompt, 0, newlines=(2, 3))
    return rows.select("sample_id", labels.alias("labels"))


@register(
    "label_mask",
    sql(
        _LABELS
        + """ select sample_id, array_to_string(list_transform(range(512),
               lambda i: case when i < start then -100 else full_ids[i + 1] end), ',') as labels
             from u""",
        "pairs",
    ),
)
def label_mask(spark, d):
    return _labelled(spark, d)


@register(
    "response_start",
    sql(
        _LABELS
        + """ select sample_id, case when start < 512 then start end as start from u""",
        "pairs",
    ),
)
def response_start(spark, d):
    return _labelled(spark, d).select(
        "sample_id", arrays.response_start(F.col("labels")).alias("start")
    )


# --- training sets ------------------------------------------------------------

def _token_tables(end: str, full: str, prompt: str) -> None:
    r.cte(
        f"parts{end}",
        f"""select sample_id, 'full' as part, {full} as text from clean
            union all select sample_id, 'prompt', {prompt} from clean
            union all select sample_id, 'source', biased from clean""",
        "clean",
    )
    r.cte(
        f"part_tokens{end}",
        f"""select sample_id, part, unnest(range(len(t))) as pos, unnest(t) as token
            from (select sample_id, part, {tokens_sql("text")} as t from parts{end})""",
        f"parts{end}",
    )
    r.cte(
        f"pair_vocab{end}",
        f"""select token, row_number() over (order by count(*) desc, token) - 1 + {FIRST_ID} as token_id
            from part_tokens{end} group by token""",
        f"part_tokens{end}",
    )
    r.cte(
        f"part_ids{end}",
        f"""select sample_id,
             list(token_id order by pos) filter (part = 'full') as full_ids,
             list(token_id order by pos) filter (part = 'prompt') as prompt_ids,
             coalesce(list(token_id order by pos) filter (part = 'source'), []) as source_ids
           from part_tokens{end} join pair_vocab{end} using (token) group by sample_id""",
        f"part_tokens{end}",
        f"pair_vocab{end}",
    )
    r.cte(
        f"tokenised{end}",
        f"""select *, case when i < start then -100 else padded[i + 1] end as label
            from (select *, coalesce(list_min(list_filter(range(512), lambda j: j >= prompt_len
                    and not list_contains(newlines, padded[j + 1]))), 512) as start
                  from (select sample_id, {_padded_sql("full_ids", 512, "right")} as padded,
                          {_padded_sql("source_ids", 512, "right")} as source_padded,
                          least(len(prompt_ids), 512) as prompt_len, len(full_ids) as n,
                          (select list(token_id) from pair_vocab{end}
                            where token in (chr(10), chr(10) || chr(10))) as newlines
                        from part_ids{end})), lateral (select unnest(range(512)) as i)""",
        f"part_ids{end}",
    )


_token_tables("", QUIET_FULL_SQL, QUIET_SQL)
_OTHER = ChatTags("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>")
_OTHER_SQL = ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>")
_token_tables(
    "_other",
    rendered_sql(*PROMPT_TURNS, ("assistant", "neutral"), tags=_OTHER_SQL),
    rendered_sql(*PROMPT_TURNS, ending="<|start_header_id|>assistant<|end_header_id|>\n\n", tags=_OTHER_SQL),
)
_SETS = """select sample_id, array_to_string(any_value(padded), ',') as input_ids,
    string_agg(case when i < n then 1 else 0 end, ',' order by i) as attention_mask,
    string_agg(label, ',' order by i) as labels{extra} from tokenised {join} group by sample_id"""
_SOURCE = ", array_to_string(any_value(source_padded), ',') as tokenized_input"


def _set(task, **template):
    def run(spark, d):
        pairs = r.staged(r.clean(spark, d))
        return builders.build_dataset(pairs, task, **template)

    return run


register("build_sft", sql(_SETS.format(extra="", join=""), "tokenised"))(_set("SFT"))
register(
    "build_sft_tags",
    sql(_SETS.replace("from tokenised", "from tokenised_other").format(extra="", join=""), "tokenised_other"),
)(_set("SFT", tags=_OTHER, thinking_off=False))
register(
    "build_eval",
    sql(
        _SETS.format(
            extra=_SOURCE + ", any_value(biased) as biased, any_value(neutral) as neutral",
            join="join clean using (sample_id)",
        ),
        "tokenised",
    ),
)(_set("EVAL"))
register(
    "build_distil",
    sql(
        _SETS.format(
            extra=_SOURCE + ", any_value(biased) as biased", join="join clean using (sample_id)"
        ),
        "tokenised",
    ),
)(_set("DISTIL"))


@register(
    "build_binary",
    sql(
        f"""WITH texts as (select sample_id, 1::BIGINT as labels, biased as text from clean
              union all select sample_id, 0, neutral from clean),
            toks as (select sample_id, labels, unnest(range(len(t))) as pos, unnest(t) as token
              from (select sample_id, labels, {tokens_sql("text")} as t from texts)),
            ids as (select sample_id, labels, list(coalesce(token_id, 1) order by pos) as ids
              from toks left join pair_vocab using (token) group by sample_id, labels)
            select sample_id, labels, array_to_string({_padded_sql("ids", 1024, "right")}, ',') as input_ids,
              array_to_string(list_transform(range(1024),
                lambda i: case when i < len(ids) then 1 else 0 end), ',') as attention_mask
            from (select sample_id, labels, coalesce(ids, []) as ids
                  from texts left join ids using (sample_id, labels))""",
        "pair_vocab",
    ),
)
def build_binary(spark, d):
    return _set("BinaryClassification")(spark, d)


# --- ranking ------------------------------------------------------------------


def _ranked(spark, d):
    return ranking.rank_candidates(r.ranked_input(spark, d))


@register("candidates", sql("select sample_id, id, id as rank, text from cands", "cands"))
def candidates(spark, d):
    return r.ranked_input(spark, d).select("sample_id", F.inline_outer("candidates"))


@register(
    "rank_merge",
    sql("select sample_id, id, id as original_rank, judge_rank, text from merged", "merged"),
)
def rank_merge(spark, d):
    return _ranked(spark, d).select("sample_id", F.inline_outer("merged"))


@register("rank_sort", sql("select sample_id, place, id, judge_rank, text from places", "places"))
def rank_sort(spark, d):
    return _ranked(spark, d).select("sample_id", F.posexplode_outer("ranked").alias("place", "c")).select(
        "sample_id", "place", "c.id", "c.judge_rank", "c.text"
    )


_FIRST_BY = """(select id from said s where s.sample_id = c.sample_id
                 order by rank {}, seq limit 1)"""


@register(
    "rank_extremes",
    sql(
        f"""select sample_id, {_FIRST_BY.format("asc")} as best_id,
            {_FIRST_BY.format("desc")} as worst_id from clean c""",
        "said",
    ),
)
def rank_extremes(spark, d):
    judged = F.col("judged")
    return _ranked(spark, d).select(
        "sample_id",
        ranking.best_id(judged).alias("best_id"),
        ranking.worst_id(judged).alias("worst_id"),
    )


_GT = "(select rank from said s where s.sample_id = c.sample_id and id = 0 order by seq limit 1)"


@register("gt_rank", sql(f"select sample_id, {_GT} as gt_rank from clean c", "said"))
def gt_rank(spark, d):
    return _ranked(spark, d).select(
        "sample_id", ranking.reference_rank(F.col("judged")).alias("gt_rank")
    )


@register(
    "gt_win_rate",
    sql(
        f"""select {r6("avg((p.text = p.neutral)::INT)")} as win_rate,
              count(*) filter ({_GT.replace("c.", "p.")} is null) as unranked,
              count(*) filter (sample_id % 13 = 0) as fallbacks
            from places p where place = 0""",
        "places",
        "said",
    ),
)
def gt_win_rate(spark, d):
    return ranking.win_rate(_ranked(spark, d))


@register(
    "rank_fallback",
    sql(
        """select sample_id, sample_id % 13 = 0 as fallback,
             string_agg(id || ':' || rank, ',' order by seq) as judged
           from said group by sample_id""",
        "said",
    ),
)
def rank_fallback(spark, d):
    shown = F.transform("judged", lambda j: F.concat_ws(":", j["id"].cast("string"), j["rank"].cast("string")))
    rows = ranking.with_fallback(r.ranked_input(spark, d))
    return rows.filter(F.size("judged") > 0).select("sample_id", "fallback", shown.alias("judged"))


@register(
    "ranking_report",
    sql(
        """WITH o as (select sample_id, biased, list({'id': id, 'text': text, 'original_rank': id}
               order by id) as original_list from cands group by sample_id, biased),
             j as (select sample_id, list({'id': id, 'judge_rank': rank} order by rank desc, seq)
               as judge_sorted_list from said group by sample_id)
           select sample_id, to_json({'biased_text': biased, 'original_list': original_list,
               'judge_sorted_list': coalesce(judge_sorted_list, []),
               'reasoning': case when sample_id % 13 <> 0 then 'short reason' end})::VARCHAR as report
           from o left join j using (sample_id)""",
        "cands",
        "said",
    ),
)
def ranking_report(spark, d):
    return ranking.ranking_report(_ranked(spark, d))


_PAIRS = " union all ".join(
    f"""select a.sample_id, {at}::BIGINT as pair_idx, a.text as chosen, b.text as rejected
        from places a join places b using (sample_id) where a.place = {x} and b.place = {y}"""
    for at, (x, y) in enumerate(((0, 1), (0, 3), (1, 3)))
) + "".join(
    f""" union all select sample_id, {at + 3}::BIGINT, text, biased from places where place = {x}"""
    for at, x in enumerate((0, 1, 2))
)


@register("preference_pairs", sql(_PAIRS, "places"))
def preference_pairs(spark, d):
    return ranking.preference_pairs(_ranked(spark, d))
