"""One strictly ordered calendar of matches: order, duplicates, disciplines."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(matches: DataFrame, by: tuple[str, ...] = ("round_rank", "match_uid")) -> DataFrame:
    """matches with t_idx from 0 in the order of date and `by`.

    Days are counted first, so only one row a day passes through one task; rows are
    numbered within their day.
    """
    days = matches.groupBy("date").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)))
    days = days.select(F.col("date").alias("__day"), F.coalesce("before", F.lit(0)).alias("before"))
    own = matches.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(*by)))
    return own.join(days, own.date == F.col("__day")).withColumn("t_idx", (F.col("before") + F.col("place") - 1).cast("long")).drop("__day", "before", "place")


def pair(a: str = "winner", b: str = "loser") -> list:
    return [F.least(a, b).alias("p_lo"), F.greatest(a, b).alias("p_hi")]


def with_priority(matches: DataFrame, priorities: dict[str, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    return matches.select("*", F.try_element_at(table, F.col("source")).alias("priority"), *pair())


def dedup(matches: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """Rows of the same pair and day with kept_match_uid, the one of the best source; rows with a day precision only, dates not null."""
    w = Window.partitionBy("p_lo", "p_hi", "date").orderBy("priority", "match_uid")
    return with_priority(matches, priorities).withColumn("kept_match_uid", F.first("match_uid").over(w))


def conflicts(matches: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """Pairs and days whose sources disagree on the winner."""
    return with_priority(matches, priorities).groupBy("p_lo", "p_hi", "date").agg(F.min("winner").alias("w1"), F.max("winner").alias("w2")).where("w1 <> w2")


def near_misses(matches: DataFrame, days: int = 3) -> DataFrame:
    """Successive matches of a pair at most `days` days apart, not on the same day."""
    w = Window.partitionBy("p_lo", "p_hi").orderBy("date", "match_uid")
    seen = matches.select("match_uid", "date", *pair()).withColumn("prev_uid", F.lag("match_uid").over(w)).withColumn("gap_days", F.datediff("date", F.lag("date").over(w)))
    return seen.where(F.col("gap_days").between(1, days))


def components(edges: DataFrame, a: str = "winner", b: str = "loser", rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable; labels spread to neighbours and jump to their label's label."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        done = step.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")).checkpoint()
        changed = done.where("next <> label").limit(1).count()
        labels = done.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
