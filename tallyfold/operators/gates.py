"""Contracts as frames of violations: raised, or kept apart with a reason."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.errors import ContractError


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds (is broken); an unknown outcome counts as broken."""
    out = F.lit(None).cast("string")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), reason).otherwise(out)
    return out


def split(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined ones."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def strict(rows: DataFrame, what: str, reason: str = "reason", shown: int = 5) -> DataFrame:
    """The rows, if none has a reason; else a ContractError with some of the reasons. One small action."""
    bad = rows.where(F.col(reason).isNotNull()).limit(shown).collect()
    if bad:
        raise ContractError(f"{what}: " + "; ".join(str(r[reason]) for r in bad))
    return rows.drop(reason)


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """Violations: keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Violations: keys of rows that others lack."""
    return rows.select(key).distinct().join(others.select(key), key, "left_anti")


def one_to_one(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The join of two frames of which each has every key exactly once; a repeated or lacking key raises as the rows are read."""
    left = rows.groupBy(key).agg(*[F.first(c).alias(c) for c in rows.columns if c != key], F.count("*").alias("n_left"))
    right = others.groupBy(key).agg(*[F.first(c).alias(c) for c in others.columns if c != key], F.count("*").alias("n_right"))
    both = left.join(right, key, "full")
    bad = F.concat(F.lit(f"{key} isn't one to one: "), F.col(key).cast("string"))
    fine = F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean"))
    return both.where(fine).drop("n_left", "n_right")


def require_none(violations: DataFrame, what: str) -> None:
    bad = violations.limit(5).collect()
    if bad:
        raise ContractError(f"{what}: {[tuple(r) for r in bad]}")


def timeline_violations(timeline: DataFrame) -> DataFrame:
    """One row of counts: null dates, unranked rounds, gaps or repeats of t_idx."""
    return timeline.agg(
        F.count_if(F.col("date").isNull()).alias("null_dates"), F.count_if(F.col("round_rank").isNull()).alias("unranked"),
        (F.count("*") - F.count_distinct("t_idx")).alias("repeated_idx"), (F.coalesce(F.max("t_idx") + 1, F.lit(0)) - F.count("*")).alias("missing_idx"),
    )


def component_seeds(components: DataFrame, seeds: DataFrame) -> DataFrame:
    """Violations: components (node, label) without exactly one seed (node, discipline)."""
    return components.join(F.broadcast(seeds), "node", "left").groupBy("label").agg(F.count("discipline").alias("n_seeds")).where("n_seeds <> 1")
