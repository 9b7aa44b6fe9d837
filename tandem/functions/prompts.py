"""Prompt and chat-message expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import prompt_texts as fixed

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def fill(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled by columns."""
    pieces = re.split(r"\{(" + "|".join(parts) + r")\}", template)
    return F.concat(
        *(parts[piece] if at % 2 else F.lit(piece) for at, piece in enumerate(pieces))
    )


def messages(*turns: tuple[str, Column]) -> Column:
    """A chat: an array of (role, content)."""
    return F.array(
        *(
            F.struct(F.lit(role).alias("role"), content.alias("content"))
            for role, content in turns
        )
    )


def user_prompt(
    text: Column, template: str = fixed.TRAINING_USER, system: str = fixed.SYSTEM_PROMPT
) -> Column:
    """System and user turn around one source text."""
    return messages(("system", F.lit(system)), ("user", fill(template, text=text)))


def sft_messages(biased: Column, neutral: Column) -> Column:
    """Training chat that ends in the wanted answer."""
    return F.concat(user_prompt(biased), messages(("assistant", neutral)))


def grpo_messages(biased: Column) -> Column:
    """Training chat whose answer is a single space, to be generated."""
    return F.concat(user_prompt(biased), messages(("assistant", F.lit(" "))))


def inference_messages(biased: Column) -> Column:
    return user_prompt(biased, fixed.INFERENCE_USER)


def teacher_messages(biased: Column) -> Column:
    return user_prompt(biased, fixed.TEACHER_USER)


def judge_prompt(biased: Column, output: Column, reference: Column) -> Column:
    return fill(fixed.JUDGE_USER, biased=biased, output=output, reference=reference)


def judge_messages(biased: Column, output: Column, reference: Column) -> Column:
    return messages(
        ("system", F.lit(fixed.JUDGE_SYSTEM)),
        ("user", judge_prompt(biased, output, reference)),
    )


def quoted(text: Column) -> Column:
    """Text as a Python literal: escapes, and the quote sign it does not hold."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(sign), F.lit(escape))
    single, double = F.lit("'"), F.lit('"')
    in_double = F.contains(text, single) & ~F.contains(text, double)
    return F.when(in_double, F.concat(double, body, double)).otherwise(
        F.concat(single, F.replace(body, single, F.lit("\\'")), single)
    )


def rank_prompt(biased: Column, candidates: Column) -> Column:
    """Ranking request; ``candidates`` is an array of structs (id, rank, text)."""
    shown = F.transform(
        candidates,
        lambda c: fill(
            fixed.RANK_CANDIDATE,
            id=c["id"].cast("string"),
            rank=c["rank"].cast("string"),
            text=quoted(c["text"]),
        ),
    )
    listed = F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
    return fill(fixed.RANK_USER, text=biased, responses=listed)


def rank_messages(biased: Column, candidates: Column) -> Column:
    return messages(
        ("system", F.lit(fixed.RANK_SYSTEM)), ("user", rank_prompt(biased, candidates))
    )


def cot_prompt(text: Column, style: Column | None = None) -> Column:
    """Few-shot request for reasoning followed by a marked answer."""
    return fill(fixed.COT_USER, text=text, style=F.lit(fixed.COT_STYLE) if style is None else style)


@dataclass(frozen=True)
class ChatTags:
    """How a chat is written as one text; the default is ChatML."""

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"
    answer_role: str = "assistant"
    no_thinking: str = "<think>\n\n</think>\n\n"


CHATML = ChatTags()


def render_chat(
    chat: Column,
    generation_prompt: bool = False,
    thinking_off: bool = False,
    tags: ChatTags = CHATML,
) -> Column:
    """A chat as text, optionally opened for the answer to be generated."""
    turns = F.transform(
        chat,
        lambda turn: F.concat(
            F.lit(tags.turn_open),
            turn["role"],
            F.lit(tags.role_end),
            turn["content"],
            F.lit(tags.turn_close),
        ),
    )
    text = F.array_join(turns, "")
    if not generation_prompt:
        return text
    opening = tags.turn_open + tags.answer_role + tags.role_end
    if thinking_off:
        opening += tags.no_thinking
    return F.concat(text, F.lit(opening))


def first_turns(chat: Column, turns: int) -> Column:
    """The leading turns of a chat."""
    return F.slice(chat, 1, turns)

