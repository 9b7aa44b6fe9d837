"""Text expressions: tag removal, tokens, path slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Python str.strip() removes, the stock openers of
# reasoning lines, and the tags around reasoning.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STOCK_OPENERS = ("Okay", "Let me", "I need to", "First", "The user")
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
TRANSFER_MARK = "[Transferred]:"

STRIP_PATTERN = rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z"
THINK_PATTERN = r"(?s)<think>.*?</think>"
OPENER_PATTERN = r"\A(" + "|".join(STOCK_OPENERS) + ")"

# The public "13a" tokenisation rules, in their order. The second
# list applies after one space is put on either side of the text.
CLEAN_13A = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
)
SPLIT_13A = (
    (r"([{-~\[-` -&(-+:-@/])", r" {1} "),
    (r"([^0-9])([.,])", r"{1} {2} "),
    (r"([.,])([^0-9])", r" {1} {2}"),
    (r"([0-9])(-)", r"{1} {2} "),
)

# One token per tag, run of newlines, run of letters or digits, or other sign.
CHAT_TOKEN_PATTERN = r"<\|[a-z_]+\|>|\n+|[A-Za-z0-9]+|[^A-Za-z0-9\s]"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def strip_think(text: Column) -> Column:
    """Remove closed reasoning blocks, then outer white space."""
    return strip(F.regexp_replace(text, THINK_PATTERN, ""))


def clean_output(text: Column) -> Column:
    """Keep the answer part of a model output, also when a block is unclosed."""
    opened = F.instr(text, THINK_OPEN)
    after_open = F.substr(text, opened + F.lit(len(THINK_OPEN)))
    answers = F.filter(
        F.transform(F.split(after_open, "\n"), strip),
        lambda line: (line != "") & ~line.rlike(OPENER_PATTERN),
    )
    return (
        F.when(F.contains(text, F.lit(THINK_CLOSE)), strip(F.substring_index(text, THINK_CLOSE, -1)))
        .when(
            opened > 0,
            F.coalesce(F.get(answers, F.lit(0)), strip(F.substring_index(text, THINK_OPEN, 1))),
        )
        .otherwise(strip(text))
    )


def transferred(text: Column) -> Column:
    """The text after the last answer mark; null where there is none."""
    return F.when(
        F.contains(text, F.lit(TRANSFER_MARK)), strip(F.substring_index(text, TRANSFER_MARK, -1))
    )


def path_slug(name: Column) -> Column:
    """File-safe form of a model name: dots go, slash and space become ``_``."""
    return F.translate(name, "/ .", "__")


def words(text: Column) -> Column:
    """Lower-case runs of ``a-z0-9``."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def tokens_13a(text: Column) -> Column:
    """Tokens of the machine-translation "13a" scheme, case kept."""
    for pattern, plain in CLEAN_13A:
        text = F.regexp_replace(text, pattern, plain)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, template in SPLIT_13A:
        text = F.regexp_replace(text, pattern, template.format("", "$1", "$2"))
    return F.filter(F.split(text, rf"{SPACE_CLASS}+"), lambda w: w != "")


def chat_tokens(text: Column) -> Column:
    """Tokens of a rendered chat, with tags and newline runs as tokens."""
    return F.regexp_extract_all(text, F.lit(CHAT_TOKEN_PATTERN), F.lit(0))
