"""Prompts, chats and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import recipes as r
from checks.recipes import sql
from checks.registry import fill_sql, register, text_sql
from tandem.functions import prompt_texts as fixed
from tandem.functions import prompts
from tandem.functions.text import clean_output, strip_think, transferred
from tandem.operators.builders import build_dpo, build_grpo, label_texts

# Turns as rows: (sample_id, seq, role, content).
_SYSTEM = text_sql(fixed.SYSTEM_PROMPT)
_TRAIN = fill_sql(fixed.TRAINING_USER, text="biased")


def turns_sql(*turns: tuple[str, str]) -> str:
    return sql(
        " union all ".join(
            f"select sample_id, {at}::BIGINT as seq, '{role}' as role, {content} as content from clean"
            for at, (role, content) in enumerate(turns)
        ),
        "clean",
    )


def turn_rows(df, chat="prompt"):
    return df.select("sample_id", F.posexplode_outer(chat).alias("seq", "turn")).select(
        "sample_id", "seq", "turn.role", "turn.content"
    )


@register(
    "chat_sft",
    turns_sql(("system", _SYSTEM), ("user", _TRAIN), ("assistant", "neutral")),
)
def chat_sft(spark, d):
    chat = prompts.sft_messages(F.col("biased"), F.col("neutral"))
    return turn_rows(r.clean(spark, d).withColumn("prompt", chat))


@register("chat_grpo", turns_sql(("system", _SYSTEM), ("user", _TRAIN), ("assistant", "' '")))
def chat_grpo(spark, d):
    return turn_rows(build_grpo(r.clean(spark, d)))


_OPEN = prompts.CHATML.turn_open


def rendered_sql(
    *turns: tuple[str, str],
    ending: str = "",
    tags: tuple[str, str, str] = ("<|im_start|>", "\n", "<|im_end|>\n"),
) -> str:
    parts = [
        f"{text_sql(tags[0] + role + tags[1])} || {content} || {text_sql(tags[2])}"
        for role, content in turns
    ]
    if ending:
        parts.append(text_sql(ending))
    return " || ".join(parts)


PROMPT_TURNS = (("system", _SYSTEM), ("user", _TRAIN))
FULL_SQL = rendered_sql(*PROMPT_TURNS, ("assistant", "neutral"))
PROMPT_SQL = rendered_sql(*PROMPT_TURNS, ending=_OPEN + "assistant\n")
_EMPTY = text_sql("<think>\n\n</think>\n\n")
QUIET_FULL_SQL = rendered_sql(*PROMPT_TURNS, ("assistant", f"{_EMPTY} || neutral"))
QUIET_SQL = rendered_sql(*PROMPT_TURNS, ending=_OPEN + "assistant\n<think>\n\n</think>\n\n")


@register(
    "chat_dpo",
    sql(f"select sample_id, {QUIET_SQL} as formatted_prompt, biased, neutral from clean", "clean"),
)
def chat_dpo(spark, d):
    return build_dpo(r.clean(spark, d)).drop("prompt")


@register(
    "chat_eval",
    turns_sql(("system", _SYSTEM), ("user", fill_sql(fixed.INFERENCE_USER, text="biased"))),
)
def chat_eval(spark, d):
    chat = prompts.inference_messages(F.col("biased"))
    return turn_rows(r.clean(spark, d).withColumn("prompt", chat))


@register(
    "chat_teacher",
    turns_sql(("system", _SYSTEM), ("user", fill_sql(fixed.TEACHER_USER, text="biased"))),
)
def chat_teacher(spark, d):
    chat = prompts.teacher_messages(F.col("biased"))
    return turn_rows(r.clean(spark, d).withColumn("prompt", chat))


@register(
    "chat_render",
    sql(
        f"""select sample_id, {FULL_SQL} as whole, {PROMPT_SQL} as opened,
            {QUIET_SQL} as quiet from clean""",
        "clean",
    ),
)
def chat_render(spark, d):
    chat = prompts.sft_messages(F.col("biased"), F.col("neutral"))
    prompt = prompts.first_turns(chat, 2)
    return r.clean(spark, d).select(
        "sample_id",
        prompts.render_chat(chat).alias("whole"),
        prompts.render_chat(prompt, generation_prompt=True).alias("opened"),
        prompts.render_chat(prompt, generation_prompt=True, thinking_off=True).alias("quiet"),
    )


@register(
    "prompt_judge",
    sql(
        f"""select sample_id, {text_sql(fixed.JUDGE_SYSTEM)} as system,
            {fill_sql(fixed.JUDGE_USER, biased="biased", output="predicted", reference="neutral")}
              as content from pred""",
        "pred",
    ),
)
def prompt_judge(spark, d):
    chat = prompts.judge_messages(F.col("biased"), F.col("predicted"), F.col("neutral"))
    return r.predicted(spark, d).select(
        "sample_id", chat[0]["content"].alias("system"), chat[1]["content"].alias("content")
    )


def _quoted_sql(text: str) -> str:
    body = f"replace({text}, '\\', '\\\\')"
    for sign, escape in (("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        body = f"replace({body}, {sign}, '{escape}')"
    return f"""case when contains({text}, '''') and not contains({text}, '"')
      then '"' || {body} || '"'
      else '''' || replace({body}, '''', '\\''') || '''' end"""


_CANDIDATE = fill_sql(fixed.RANK_CANDIDATE, id="id", rank="id", text=_quoted_sql("text"))


@register(
    "prompt_rank",
    sql(
        f"""WITH listed as (select sample_id, biased,
              '[' || string_agg({_CANDIDATE}, ', ' order by id) || ']' as responses
              from cands group by sample_id, biased)
            select sample_id, {fill_sql(fixed.RANK_USER, text="biased", responses="responses")}
              as content from listed""",
        "cands",
    ),
)
def prompt_rank(spark, d):
    prompt = prompts.rank_prompt(F.col("biased"), F.col("candidates"))
    return r.ranked_input(spark, d).select("sample_id", prompt.alias("content"))


@register(
    "prompt_cot",
    sql(
        "select sample_id, "
        + fill_sql(fixed.COT_USER, text="biased", style=text_sql(fixed.COT_STYLE))
        + " as prompt from clean",
        "clean",
    ),
)
def prompt_cot(spark, d):
    return r.clean(spark, d).select("sample_id", prompts.cot_prompt(F.col("biased")).alias("prompt"))


# The SQL has rules of its own: the code points of white space, and the openers one by one.
_SPACES = " || ".join(
    f"chr({point})"
    for point in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)
_STOCK = " or ".join(f"starts_with(l, '{opener}')" for opener in ("Okay", "Let me", "I need to", "First", "The user"))


def strip_sql(text: str) -> str:
    return f"trim({text}, {_SPACES})"


@register(
    "strip_think",
    sql(
        "select sample_id, "
        + strip_sql("regexp_replace(response, '<think>(.|\\n)*?</think>', '', 'g')")
        + " as text from resp",
        "resp",
    ),
)
def thinking(spark, d):
    return r.responses(spark, d).select("sample_id", strip_think(F.col("response")).alias("text"))


_AFTER = "substr(response, strpos(response, '<think>') + 7)"


@register(
    "clean_output",
    sql(
        f"""select sample_id, case
              when contains(response, '</think>') then {strip_sql("list_extract(string_split(response, '</think>'), -1)")}
              when contains(response, '<think>') then coalesce(
                list_extract(list_filter(list_transform(string_split({_AFTER}, chr(10)),
                    lambda l: {strip_sql("l")}),
                  lambda l: l <> '' and not ({_STOCK})), 1),
                {strip_sql("split_part(response, '<think>', 1)")})
              else {strip_sql("response")} end as text from resp""",
        "resp",
    ),
)
def cleaned(spark, d):
    return r.responses(spark, d).select("sample_id", clean_output(F.col("response")).alias("text"))


@register(
    "cot_extract",
    sql(
        f"""select sample_id, case when sample_id % 3 <> 0
              then {strip_sql("biased")} end as answer from pairs""",
        "pairs",
    ),
)
def cot_extract(spark, d):
    text, kind = F.col("biased"), F.col("sample_id") % 3
    answer = (
        F.when(kind == 1, F.concat(F.lit("why [Transferred]: "), text))
        .when(kind == 2, F.concat(F.lit("a [Transferred]: b\n[Transferred]:\n"), text))
        .otherwise(text)
    )
    return r.pairs(spark, d).select("sample_id", transferred(answer).alias("answer"))


@register(
    "binary_texts",
    sql(
        """select sample_id, biased as text, 1::BIGINT as label from clean
           union all select sample_id, neutral, 0 from clean""",
        "clean",
    ),
)
def binary_texts(spark, d):
    return label_texts(r.clean(spark, d))
