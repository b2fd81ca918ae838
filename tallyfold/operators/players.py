"""Point-in-time features of players: every frame ends before the match itself."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_player():
    return Window.partitionBy("player").orderBy("t_idx")


def prior():
    return by_player().rowsBetween(Window.unboundedPreceding, -1)


def last(n: int):
    return by_player().rowsBetween(-n, -1)


def player_long(timeline: DataFrame) -> DataFrame:
    """Two rows a match, one a player."""
    side = lambda p, o, won: F.struct(F.col(p).alias("player"), F.col(o).alias("opp"), F.lit(won).alias("won"))
    both = F.explode(F.array(side("winner", "loser", 1), side("loser", "winner", 0)))
    return timeline.select("t_idx", "match_uid", "date", "discipline", "n_sets", both.alias("s")).select("t_idx", "match_uid", "date", "discipline", "n_sets", "s.*")


def shrunk_form(n: int) -> Column:
    """(wins + 2) / (matches + 4) over the last n matches, null without any."""
    k = F.count("*").over(last(n))
    return F.when(k > 0, (F.sum("won").over(last(n)) + 2) / (k + 4))


def decayed(value: Column, half_life: float, window=None) -> Column:
    """Sum of the prior values halved every half_life days: a prefix sum of values scaled up by their day.

    Days count from the player's first match; a double holds about a thousand half-lives.
    """
    day = F.datediff("date", F.min("date").over(Window.partitionBy("player")))
    up = F.pow(F.lit(2.0), day / half_life)
    return F.coalesce(F.sum(value * up).over(window or prior()), F.lit(0.0)) / up


def with_history(pl: DataFrame, half_life: float = 540.0, prior_wins: float = 5.0, prior_games: float = 10.0) -> DataFrame:
    """Counts, days off, form, streak, game share and the log5 rate before each match."""
    first = pl.withColumn("n_prior", F.row_number().over(by_player()) - 1).withColumn("days_off", F.datediff("date", F.lag("date").over(by_player())))
    first = first.withColumn("form5", shrunk_form(5)).withColumn("form10", shrunk_form(10))
    first = first.withColumn("turn", F.sum(F.when(F.col("won") == F.lag("won").over(by_player()), 0).otherwise(1)).over(by_player()))
    run = F.count("*").over(Window.partitionBy("player", "turn").orderBy("t_idx")) * F.when(F.col("won") == 1, 1).otherwise(-1)
    games = F.when(F.col("won") == 1, 2).otherwise(F.col("n_sets") - 2)
    played = F.sum("n_sets").over(prior())
    rate = (decayed(F.col("won").cast("double"), half_life) + prior_wins) / (decayed(F.lit(1.0), half_life) + prior_games)
    out = first.withColumn("run", run).withColumn("streak", F.lag("run").over(by_player()))
    return out.withColumn("game_share", (F.sum(games).over(prior()) + 2) / (played + 4)).withColumn("rate", rate).drop("run", "turn")


def head_to_head(timeline: DataFrame) -> DataFrame:
    """match_uid and h2h_lo: earlier wins of the pair's smaller name less those of the larger."""
    lo, hi = F.least("winner", "loser"), F.greatest("winner", "loser")
    w = Window.partitionBy("p_lo", "p_hi").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = timeline.select("match_uid", "t_idx", "winner", lo.alias("p_lo"), hi.alias("p_hi"))
    return rows.withColumn("h2h_lo", F.coalesce(F.sum(F.when(F.col("winner") == F.col("p_lo"), 1).otherwise(-1)).over(w), F.lit(0)))


def by_side(rows: DataFrame, own: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns of each match's two players (match_uid, player) as <column>0 and <column>1, in one grouping."""
    held = own.join(rows.select("match_uid", "side0"), "match_uid")
    mine = lambda k: (F.col("player") == F.col("side0")) if k == 0 else (F.col("player") != F.col("side0"))
    both = held.groupBy("match_uid").agg(*[F.max(F.when(mine(k), F.col(n))).alias(f"{n}{k}") for n in columns for k in (0, 1)])
    return rows.join(both, "match_uid")
