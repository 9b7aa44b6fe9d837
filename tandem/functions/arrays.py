"""Row-local expressions over token arrays, vectors and score arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASKED = -100  # Fixed value: the label that a loss ignores.
NEWLINE_IDS = (271, 198)  # Fixed values: newline token ids of the default tokenizer.


def pad_id_or_eos(pad: Column, eos: Column) -> Column:
    """The padding id, or the end id where a tokenizer has none."""
    return F.coalesce(pad, eos)


def pad_truncate(ids: Column, length: int, pad: Column | int = 0, side: str = "right") -> Column:
    """Exactly ``length`` ids: cut at the end, filled with ``pad`` on one side."""
    pad = F.lit(pad) if isinstance(pad, int) else pad
    kept = F.slice(ids, 1, length)
    filling = F.array_repeat(pad, F.lit(length) - F.size(kept))
    return F.concat(filling, kept) if side == "left" else F.concat(kept, filling)


def attention_mask(ids: Column, length: int, side: str = "right") -> Column:
    """1 for a real token and 0 for filling, after ``pad_truncate``."""
    kept = F.least(F.size(ids), F.lit(length))
    ones = F.array_repeat(F.lit(1), kept)
    zeros = F.array_repeat(F.lit(0), F.lit(length) - kept)
    return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)


def answer_offset(
    full: Column, prompt: Column, pad: Column | int, newlines: tuple[int, ...] = NEWLINE_IDS
) -> Column:
    """Where the answer starts: after the prompt and the newlines that follow."""
    prompt_length = F.size(F.filter(prompt, lambda t: t != pad))
    after = F.slice(full, prompt_length + 1, F.size(full))
    seen = F.transform(after, lambda t: ~t.isin(*newlines) if newlines else F.lit(True))
    first = F.array_position(seen, True)
    return F.least(
        prompt_length + F.when(first > 0, first - 1).otherwise(F.size(after)), F.size(full)
    ).cast("int")


def label_mask(
    full: Column,
    prompt: Column,
    pad: Column | int = 0,
    newlines: tuple[int, ...] = NEWLINE_IDS,
    mask_pads: bool = False,
) -> Column:
    """Labels: masked up to the answer, then the ids (filling too by default)."""
    start = answer_offset(full, prompt, pad, newlines)
    answer = F.slice(full, start + 1, F.size(full))
    if mask_pads:
        answer = F.transform(answer, lambda t: F.when(t == pad, MASKED).otherwise(t))
    return F.concat(F.array_repeat(F.lit(MASKED), start), answer)


def response_start(labels: Column) -> Column:
    """Index of the first label that counts; null when all are masked."""
    found = F.array_position(F.transform(labels, lambda label: label != MASKED), True)
    return F.when(found > 0, (found - 1).cast("int"))


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a vector of zeros gives 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x.cast("double") / temperature)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials, shifted by the largest value."""

    def summed(values: Column, top: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda total, x: total + F.exp(x - top))

    return let(
        values, lambda v: let(F.array_max(v), lambda top: top + F.log(summed(v, top)))
    )


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Log-probabilities of a logit vector at a temperature."""
    return let(
        scaled(logits, temperature),
        lambda v: let(log_sum_exp(v), lambda shift: F.transform(v, lambda x: x - shift)),
    )
