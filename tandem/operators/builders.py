"""Training tables for each task, from cleaned text pairs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import arrays, prompts
from tandem.functions import prompt_texts as fixed
from tandem.functions.text import CHAT_TOKEN_PATTERN, chat_tokens
from tandem.operators.blocks import TokenBlocks
from tandem.operators.vocabulary import PAD_ID, UNKNOWN_ID, Vocabulary, number_tokens

# Token lengths for rewriting and for classification.
SEQUENCE_LENGTH, CLASSIFIER_LENGTH = 512, 1024

KEY = "sample_id"


@dataclass(frozen=True)
class Template:
    """A training chat as token lists around its two texts.

    It is cut where tokens end whatever the texts are; only the last token before the
    answer may run on, so its text, ``lead``, is read with the answer.
    """

    before: list[str]
    between: list[str]
    after: list[str]
    lead: str

    def answer_tokens(self) -> Column:
        return chat_tokens(F.concat(F.lit(self.lead), F.col("neutral")))


def training_template(tags: prompts.ChatTags = prompts.CHATML, thinking_off: bool = True) -> Template:
    """What a training chat says before the source, between the texts, and after."""
    user = fixed.TRAINING_USER.removesuffix("{text}")
    before = (
        tags.turn_open + "system" + tags.role_end + fixed.SYSTEM_PROMPT + tags.turn_close
        + tags.turn_open + "user" + tags.role_end + user
    )
    between = tags.turn_close + tags.turn_open + tags.answer_role + tags.role_end
    if thinking_off:
        between += tags.no_thinking
    *_, last = re.finditer(CHAT_TOKEN_PATTERN, between)
    parts = (re.findall(CHAT_TOKEN_PATTERN, part) for part in (before, between, tags.turn_close))
    return Template(*parts, between[last.start() :])


def _source_tokens() -> Column:
    return chat_tokens(F.col("biased"))


def pair_blocks(
    pairs: DataFrame,
    keep: Sequence[str] = (),
    tags: prompts.ChatTags = prompts.CHATML,
    thinking_off: bool = True,
    rewrite: bool = False,
) -> TokenBlocks:
    """The texts of the pairs, tokenised in one reading; ``rewrite`` adds the bare rewritten text."""
    parts = {"source": _source_tokens(), "answer": training_template(tags, thinking_off).answer_tokens()}
    if rewrite:
        parts["rewrite"] = chat_tokens(F.col("neutral"))
    return TokenBlocks.of(pairs, [KEY, *keep], parts)


def blocks_vocabulary(
    blocks: TokenBlocks, tags: prompts.ChatTags = prompts.CHATML, thinking_off: bool = True
) -> Vocabulary:
    """A vocabulary over what the builders write: chats, prompts and sources.

    Only the dictionaries of the blocks are counted; the fixed wording is counted
    once and weighed by the number of pairs.
    """
    chat = training_template(tags, thinking_off)
    counts = blocks.counts({"source": 3, "answer": 1})
    rows = blocks.rows()
    wording = Counter(chat.before + chat.between[:-1] + chat.after) + Counter(
        chat.before + chat.between
    )
    fixed_counts = blocks.table.sparkSession.createDataFrame(
        [(token, n * rows) for token, n in wording.items()], "token string, n long"
    )
    total = counts.unionByName(fixed_counts).groupBy("token").agg(F.sum("n").alias("n"))
    return Vocabulary(number_tokens(total))


def pair_vocabulary(
    pairs: DataFrame, tags: prompts.ChatTags = prompts.CHATML, thinking_off: bool = True
) -> Vocabulary:
    """The vocabulary of pairs that may be encoded later, or of others than are encoded."""
    return blocks_vocabulary(pair_blocks(pairs, (), tags, thinking_off), tags, thinking_off)


def tokenize_pairs(
    pairs: DataFrame,
    vocabulary: Vocabulary | None = None,
    source: bool = True,
    keep: Sequence[str] = (),
    length: int = SEQUENCE_LENGTH,
    side: str = "right",
    newlines: tuple[int, ...] | None = None,
    mask_pads: bool = False,
    tags: prompts.ChatTags = prompts.CHATML,
    thinking_off: bool = True,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` of each pair.

    ``source`` adds ``tokenized_input``, the source text alone; ``keep`` names
    columns of ``pairs`` to carry along. ``newlines`` are the ids skipped at the
    start of an answer, by default those of one and two line ends. ``tags`` and
    ``thinking_off`` (an empty reasoning block before the answer) shape the whole
    chat and its prompt, and are the ones the vocabulary was counted with. Without a
    ``vocabulary`` it is counted from the pairs, in the same reading.
    """
    chat = training_template(tags, thinking_off)
    blocks = pair_blocks(pairs, keep, tags, thinking_off)
    vocabulary = vocabulary or blocks_vocabulary(blocks, tags, thinking_off)
    before, between, after, line_ends = vocabulary.constants(
        chat.before, chat.between, chat.after, ("\n\n", "\n")
    )
    if newlines is None:
        newlines = tuple(i for i in line_ends if i != UNKNOWN_ID)
    ids = vocabulary.encode_blocks(blocks)
    ids = ids.withColumns(
        {
            "full": F.concat(
                F.lit(before), "source", F.lit(between[:-1]), "answer", F.lit(after)
            ),
            "prompt": F.concat(F.lit(before), "source", F.lit(between)),
        }
    )

    def padded(part: str) -> Column:
        return arrays.pad_truncate(F.col(part), length, PAD_ID, side)

    labels = arrays.label_mask(
        F.col("input_ids"), F.slice("prompt", 1, length), PAD_ID, newlines, mask_pads
    )
    rows = (
        ids.withColumn("input_ids", padded("full"))
        .withColumn("attention_mask", arrays.attention_mask(F.col("full"), length, side))
        .withColumn("labels", labels)
    )
    if source:
        rows = rows.withColumn("tokenized_input", padded("source"))
    return rows.drop("source", "answer", "full", "prompt")


def build_eval(pairs: DataFrame, vocabulary: Vocabulary | None = None, **options) -> DataFrame:
    return tokenize_pairs(pairs, vocabulary, keep=("biased", "neutral"), **options)


def build_sft(pairs: DataFrame, vocabulary: Vocabulary | None = None, **options) -> DataFrame:
    return tokenize_pairs(pairs, vocabulary, source=False, **options)


def build_distil(pairs: DataFrame, vocabulary: Vocabulary | None = None, **options) -> DataFrame:
    return tokenize_pairs(pairs, vocabulary, keep=("biased",), **options)


def build_grpo(pairs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    return pairs.withColumn("prompt", prompts.grpo_messages(F.col("biased")))


def build_dpo(pairs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    prompt = prompts.user_prompt(F.col("biased"))
    return pairs.withColumns(
        {
            "prompt": prompt,
            "formatted_prompt": prompts.render_chat(
                prompt, generation_prompt=True, thinking_off=True
            ),
        }
    )


def label_texts(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: the source with label 1 and the rewrite with label 0."""

    def row(text: str, label: int) -> Column:
        return F.struct(F.col(text).alias("text"), F.lit(label).alias("label"))

    return pairs.select(KEY, F.inline(F.array(row("biased", 1), row("neutral", 0))))


def build_binary(
    pairs: DataFrame, vocabulary: Vocabulary | None = None, length: int = CLASSIFIER_LENGTH
) -> DataFrame:
    """Padded token rows of both texts with ``labels`` 1 (source) and 0 (rewrite)."""
    blocks = pair_blocks(pairs, rewrite=True)
    vocabulary = vocabulary or blocks_vocabulary(blocks)
    ids = vocabulary.encode_blocks(blocks)
    ids = label_texts(ids.select(KEY, F.col("source").alias("biased"), F.col("rewrite").alias("neutral")))
    return ids.select(
        KEY,
        arrays.pad_truncate(F.col("text"), length, PAD_ID).alias("input_ids"),
        arrays.attention_mask(F.col("text"), length).alias("attention_mask"),
        F.col("label").alias("labels"),
    )


BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "SFT": build_sft,
    "EVAL": build_eval,
    "GRPO": build_grpo,
    "DISTIL": build_distil,
    "DPO": build_dpo,
    "BinaryClassification": build_binary,
}


def build_dataset(pairs: DataFrame, task: str, vocabulary: Vocabulary | None = None, **options):
    """The training table of one task type."""
    return pairs.transform(BUILDERS[task], vocabulary, **options)
