"""Token vocabularies: ids by frequency, and texts as id arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.blocks import TokenBlocks
from tandem.operators.ordinals import with_ordinals

PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2

def count_tokens(weighted: DataFrame, column: str) -> DataFrame:
    """(token, n): summed weights of an array column of structs (token, weight).

    Sums combine on the map side, so a token holding a third of all occurrences
    costs one row per task.
    """
    # The outer form: the plain one adds a size filter that tokenises twice.
    return (
        weighted.select(F.explode_outer(column).alias("t"))
        .filter(F.col("t").isNotNull())
        .groupBy("t.token")
        .agg(F.sum("t.weight").alias("n"))
    )


def weigh(tokens: Column, weight: int = 1) -> Column:
    """Tokens as structs (token, weight)."""
    return F.transform(
        tokens,
        lambda token: F.struct(token.alias("token"), F.lit(weight).cast("bigint").alias("weight")),
    )


def number_tokens(counts: DataFrame) -> DataFrame:
    """(token, n, token_id): ids by falling count, then by token."""
    numbered = with_ordinals(counts, [F.desc("n"), "token"], "_rank")
    return numbered.select("token", "n", (F.col("_rank") + FIRST_ID).alias("token_id"))


def build_vocabulary(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """(token, n, token_id) of an array column, most frequent token first."""
    weighted = tokens.select(weigh(F.col(column)).alias("weighted"))
    return number_tokens(count_tokens(weighted, "weighted"))


@dataclass(frozen=True)
class Vocabulary:
    """Tokens and their ids."""

    table: DataFrame

    @classmethod
    def of(cls, tokens: DataFrame, column: str = "tokens") -> Vocabulary:
        return cls(build_vocabulary(tokens, column))

    def ids_of(self, tokens: Sequence[str]) -> dict[str, int]:
        """Ids of a few named tokens, those that occur."""
        found = self.table.filter(F.col("token").isin(*set(tokens))).select("token", "token_id")
        return {row.token: row.token_id for row in found.collect()}

    def constants(self, *lists: Sequence[str]) -> list[list[int]]:
        """The ids of fixed token lists, found together."""
        ids = self.ids_of([token for tokens in lists for token in tokens])
        return [[ids.get(token, UNKNOWN_ID) for token in tokens] for tokens in lists]

    def encode_blocks(self, blocks: TokenBlocks) -> DataFrame:
        """The rows of ``blocks`` with an id array per part."""
        return blocks.encoded(self.table, UNKNOWN_ID)

    def encode(self, df: DataFrame, keep: str | Sequence[str], parts: Mapping[str, Column]) -> DataFrame:
        """The columns of ``keep`` and one id array per part, each a token array of ``df``."""
        return self.encode_blocks(TokenBlocks.of(df, [keep] if isinstance(keep, str) else keep, parts))


def block_vocabulary(blocks: TokenBlocks) -> Vocabulary:
    """The vocabulary of the rows of ``blocks``, counted from their dictionaries."""
    return Vocabulary(number_tokens(blocks.counts()))
