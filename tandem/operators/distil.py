"""Teacher distributions and their divergence from student logits.

``teacher`` rows are (sample_id, pos, chosen, top): ``chosen`` a struct (token,
logprob) and ``top`` an array of them, tokens being ids or null where a text has
no id. ``student`` rows are (sample_id, student_pos, logits). ``labels`` rows are
(sample_id, labels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.arrays import log_sum_exp, response_start, scaled

# Temperature, mixing weight, coverage limits, probability floor.
TEMPERATURE, ALPHA = 1.5, 0.5
COVERAGE, POSITION_COVERAGE, FLOOR = 0.8, 0.5, 1e-8


def flatten_logprobs(responses: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per position and top entry; positions without a top list stay once."""
    return (
        responses.select(key, F.posexplode_outer("logprobs").alias("pos", "chosen"))
        .filter(F.col("pos").isNotNull())
        .select(
            key,
            "pos",
            F.col("chosen.token").alias("token"),
            F.col("chosen.logprob").alias("logprob"),
            F.posexplode_outer("chosen.top_logprobs").alias("top_idx", "top"),
        )
        .select(
            key,
            "pos",
            "token",
            "logprob",
            "top_idx",
            F.col("top.token").alias("top_token"),
            F.col("top.logprob").alias("top_logprob"),
        )
    )


def _entries(temperature: float) -> Column:
    """Chosen token, then the top tokens that differ from it, with probabilities."""
    chosen = F.col("chosen")
    others = F.filter(
        F.coalesce("top", F.expr("cast(array() as array<struct<token:int,logprob:double>>)")),
        lambda t: t["token"].isNotNull()
        & (chosen["token"].isNull() | (t["token"] != chosen["token"])),
    )
    first = F.filter(F.array(chosen), lambda t: t["token"].isNotNull())
    return F.transform(
        F.concat(first, others),
        lambda t: F.struct(
            t["token"].alias("token"), F.exp(t["logprob"] / temperature).alias("p")
        ),
    )


def _last_per_token(entries: Column) -> Column:
    """Entries whose token does not come again: a repeat overwrites."""
    return F.filter(
        entries,
        lambda e, at: ~F.exists(
            F.slice(entries, at + 2, F.size(entries)), lambda later: later["token"] == e["token"]
        ),
    )


def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["p"])


def teacher_distribution(teacher: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Add ``dist`` (token, p) and ``coverage``.

    A repeated token overwrites its probability but counts again in coverage.
    """
    return (
        teacher.withColumn("_entries", _entries(temperature))
        .withColumn("coverage", _total(F.col("_entries")))
        .withColumn("dist", _last_per_token(F.col("_entries")))
        .drop("_entries")
    )


def align(teacher: DataFrame, labels: DataFrame) -> DataFrame:
    """Teacher rows with the student position that predicts them.

    Samples without a counted label, and positions before the first, drop out.
    """
    starts = labels.select("sample_id", response_start(F.col("labels")).alias("start"))
    return (
        teacher.join(starts.filter(F.col("start").isNotNull()), "sample_id")
        .withColumn("student_pos", F.col("start") - 1 + F.col("pos"))
        .filter(F.col("student_pos") >= 0)
        .drop("start")
    )


def position_losses(
    teacher: DataFrame,
    student: DataFrame,
    labels: DataFrame,
    temperature: float = TEMPERATURE,
    threshold: float = COVERAGE,
) -> DataFrame:
    """(sample_id, pos, coverage, low_coverage, loss) per usable position.

    Well-covered positions give a divergence over the whole vocabulary, whose
    unobserved part has the closed form floor * (n ln floor - sum of their
    log-probabilities); the others a cross-entropy over the observed tokens.
    """
    usable = align(teacher, labels).filter(F.size(F.coalesce("top", F.array())) > 0)
    joined = teacher_distribution(usable, temperature).join(student, ["sample_id", "student_pos"])
    measured = (
        joined.withColumn("_x", scaled(F.col("logits"), temperature))
        .withColumn("_shift", log_sum_exp(F.col("_x")))
        .withColumn("_size", F.size("_x"))
        .withColumn("_sum", F.aggregate("_x", F.lit(0.0), lambda t, x: t + x))
        .withColumn("_mass", _total(F.col("dist")))
        .withColumn(
            "_seen",
            F.transform(
                "dist",
                lambda e: F.struct(
                    e["p"].alias("p"),
                    F.greatest(
                        F.when(F.col("_mass") > 0, e["p"] / F.col("_mass")), F.lit(FLOOR)
                    ).alias("q"),
                    (F.get("_x", e["token"]) - F.col("_shift")).alias("s"),
                ),
            ),
        )
    )

    def over_seen(term) -> Column:
        return F.aggregate("_seen", F.lit(0.0), lambda total, e: total + term(e))

    unseen_count = F.col("_size") - F.size("_seen")
    unseen_sum = F.col("_sum") - F.col("_size") * F.col("_shift") - over_seen(lambda e: e["s"])
    divergence = over_seen(lambda e: e["q"] * (F.log(e["q"]) - e["s"])) + F.lit(FLOOR) * (
        unseen_count * F.log(F.lit(FLOOR)) - unseen_sum
    )
    cross_entropy = -over_seen(lambda e: F.when(e["p"] > 0, e["p"] * e["s"]).otherwise(0.0))
    low = F.col("coverage") < threshold
    return measured.select(
        "sample_id",
        "pos",
        "coverage",
        low.alias("low_coverage"),
        F.when(low, cross_entropy).otherwise(divergence).alias("loss"),
    )


def sample_losses(
    positions: DataFrame, samples: DataFrame, temperature: float = TEMPERATURE
) -> DataFrame:
    """(sample_id, kl) for every row of ``samples``: mean position loss times T squared."""
    means = positions.groupBy("sample_id").agg(
        (F.avg("loss") * temperature * temperature).alias("kl")
    )
    return samples.select("sample_id").distinct().join(means, "sample_id", "left")


def coverage_report(positions: DataFrame, teacher: DataFrame) -> DataFrame:
    """Per sample: used and total positions, shares, and a flag for few used."""
    used = positions.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("used"), F.avg(F.col("low_coverage").cast("int")).alias("low_share")
    )
    totals = teacher.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))
    share = F.coalesce("used", F.lit(0)) / F.col("total")
    return totals.join(used, "sample_id", "left").select(
        "sample_id",
        F.coalesce("used", F.lit(0)).alias("used"),
        "total",
        share.alias("used_share"),
        "low_share",
        (share < POSITION_COVERAGE).alias("few_used"),
    )


def batch_summary(losses: DataFrame, batch: Column) -> DataFrame:
    """Smallest, largest and mean divergence per batch, and how many samples had one."""
    return losses.groupBy(batch.alias("batch")).agg(
        F.min("kl").alias("kl_min"),
        F.max("kl").alias("kl_max"),
        F.avg("kl").alias("kl_mean"),
        F.count("kl").alias("used"),
        F.count(F.lit(1)).alias("total"),
    )


def mixed_loss(kl: Column, hard: Column, alpha: float = ALPHA) -> Column:
    """Weighted sum of both losses; the hard loss alone where there is no divergence."""
    return F.coalesce(alpha * kl + (1 - alpha) * hard, hard)


def batch_loss(losses: DataFrame, batch: Column, alpha: float = ALPHA) -> DataFrame:
    """(batch, kl, hard, loss): the losses averaged over each batch, then mixed.

    ``losses`` has one row per sample with kl and hard. Samples without a divergence count in the
    hard mean alone; a batch without any divergence has its hard loss.
    """
    means = losses.groupBy(batch.alias("batch")).agg(F.avg("kl").alias("kl"), F.avg("hard").alias("hard"))
    return means.withColumn("loss", mixed_loss(F.col("kl"), F.col("hard"), alpha))
