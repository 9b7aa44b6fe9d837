"""Ranked candidates and preference pairs; every step stays within its row.

A ranked frame has one row per sample with ``candidates``, an array of structs
(id, rank, text) whose id is the position, and ``judged``, an array of structs
(id, rank) as the judge returned it, or null where the judge failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places in the sorted list that make (chosen, rejected) pairs, and
# the places that are set against the source text.
BETTER_WORSE = ((0, 1), (0, 3), (1, 3))
AGAINST_SOURCE = (0, 1, 2)

UNKNOWN_RANK = -1


def candidates(reference: Column, responses: Column) -> Column:
    """The reference text and then the responses, with id and rank = position."""
    return F.transform(
        F.concat(F.array(reference), responses),
        lambda text, at: F.struct(at.alias("id"), at.alias("rank"), text.alias("text")),
    )


def with_fallback(df: DataFrame) -> DataFrame:
    """Where the judge gave nothing, the original order stands; ``fallback`` tells."""
    identity = F.transform(
        "candidates", lambda c: F.struct(c["id"].alias("id"), c["rank"].alias("rank"))
    )
    return df.withColumns(
        {
            "fallback": F.col("judged").isNull(),
            "judged": F.coalesce("judged", identity),
        }
    )


def merged_ranks(candidates: Column, judged: Column) -> Column:
    """Candidates with the judge's last rank for their id, else their own."""

    def rank(candidate: Column) -> Column:
        said = F.filter(judged, lambda j: j["id"] == candidate["id"])
        last = F.try_element_at(said, F.lit(-1))["rank"]
        return F.coalesce(last, candidate["rank"])

    return F.transform(
        candidates,
        lambda c: F.struct(
            c["id"].alias("id"),
            c["rank"].alias("original_rank"),
            rank(c).alias("judge_rank"),
            c["text"].alias("text"),
        ),
    )


def sorted_by_rank(merged: Column) -> Column:
    """Merged candidates by ascending rank, ties by id."""
    order = F.array_sort(
        F.transform(
            merged,
            lambda c: F.struct(
                c["judge_rank"].alias("judge_rank"), c["id"].alias("id"), c["text"].alias("text")
            ),
        )
    )
    return order


def rank_candidates(df: DataFrame) -> DataFrame:
    """Add ``merged`` (by id) and ``ranked`` (by rank) to a ranked frame."""
    return (
        with_fallback(df)
        .withColumn("merged", merged_ranks(F.col("candidates"), F.col("judged")))
        .withColumn("ranked", sorted_by_rank(F.col("merged")))
    )


def rank_rows(ranked: DataFrame) -> DataFrame:
    """Log rows, one per candidate."""
    # The outer form: the plain one adds a size filter that merges the ranks twice.
    rows = ranked.select(
        "iteration",
        "sample_idx",
        F.col("biased").alias("biased_text"),
        F.explode_outer("merged").alias("c"),
    )
    return rows.filter(F.col("c").isNotNull()).select(
        "iteration",
        "sample_idx",
        "biased_text",
        F.col("c.id").alias("response_id"),
        F.coalesce("c.original_rank", F.lit(UNKNOWN_RANK)).alias("original_rank"),
        F.col("c.judge_rank").alias("judge_rank"),
        F.col("c.text").alias("response_text"),
    )


def _by_rank(judged: Column, worst: bool) -> Column:
    """First judged entry with the smallest (or largest) rank."""
    ranks = F.transform(judged, lambda j: j["rank"])
    edge = F.array_max(ranks) if worst else F.array_min(ranks)
    return F.get(F.filter(judged, lambda j: j["rank"] == edge), F.lit(0))


def best_id(judged: Column) -> Column:
    return _by_rank(judged, worst=False)["id"]


def worst_id(judged: Column) -> Column:
    return _by_rank(judged, worst=True)["id"]


def reference_rank(judged: Column) -> Column:
    """The rank first given to the reference (id 0); null where it is absent."""
    return F.get(F.filter(judged, lambda j: j["id"] == 0), F.lit(0))["rank"]


def reference_wins(candidates: Column, ranked: Column) -> Column:
    """True when the best text equals the reference text."""
    return F.get(ranked, F.lit(0))["text"] == F.get(candidates, F.lit(0))["text"]


def win_rate(ranked: DataFrame) -> DataFrame:
    """Share of samples whose reference wins, and samples whose reference is unranked."""
    wins = reference_wins(F.col("candidates"), F.col("ranked"))
    return ranked.agg(
        F.avg(wins.cast("int")).alias("win_rate"),
        F.count_if(reference_rank(F.col("judged")).isNull()).alias("unranked"),
        F.count_if("fallback").alias("fallbacks"),
    )


def ranking_report(ranked: DataFrame, key: str = "sample_id") -> DataFrame:
    """One JSON text per sample: candidates by id, the judge's list from worst to best."""
    original = F.transform(
        "candidates",
        lambda c: F.struct(
            c["id"].alias("id"), c["text"].alias("text"), c["rank"].alias("original_rank")
        ),
    )
    # Descending by rank; equal ranks keep the judge's order.
    falling = F.transform(
        F.array_sort(
            F.transform(
                "judged",
                lambda j, at: F.struct(
                    (-j["rank"]).alias("key"), at.alias("at"), j["id"].alias("id"), j["rank"].alias("rank")
                ),
            )
        ),
        lambda j: F.struct(j["id"].alias("id"), j["rank"].alias("judge_rank")),
    )
    report = F.struct(
        F.col("biased").alias("biased_text"),
        original.alias("original_list"),
        falling.alias("judge_sorted_list"),
        F.col("reasoning"),
    )
    return ranked.select(key, F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def preference_pairs(ranked: DataFrame, keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Six (chosen, rejected) rows per sample. Equal texts are not filtered out."""

    def text(place: int) -> Column:
        return F.get("ranked", F.lit(place))["text"]

    def pair(at: int, chosen: Column, rejected: Column) -> Column:
        return F.struct(
            F.lit(at).alias("pair_idx"), chosen.alias("chosen"), rejected.alias("rejected")
        )

    rows = [(text(a), text(b)) for a, b in BETTER_WORSE]
    rows += [(text(a), F.col("biased")) for a in AGAINST_SOURCE]
    pairs = F.array(*(pair(at, chosen, rejected) for at, (chosen, rejected) in enumerate(rows)))
    return ranked.select(*keep, F.inline(pairs))
