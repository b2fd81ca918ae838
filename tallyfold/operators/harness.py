"""The walk-forward harness: predictors by name, the gates of their probabilities, runs and their reports.

A predictor is any object with a `name` and a `predict(walk)` that gives match_uid and p,
the probability that side0 wins, made of earlier matches alone. Predictors are declared
over the whole timeline (windows, folds, refits), not called match by match.
"""

import dataclasses
import hashlib
import importlib.metadata
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.errors import ContractError
from tallyfold.functions import rulebook
from tallyfold.functions.config import Harness
from tallyfold.operators import gates, players, ratings, scoring

c = F.col


@dataclass(frozen=True)
class Walk:
    """What predictors may see: the timeline with sides (side0, side1; y only to learn from), and features a match."""

    rows: DataFrame
    config: Harness
    features: DataFrame | None = None


class Predictor(Protocol):
    name: str

    def predict(self, walk: Walk) -> DataFrame: ...


def sided(timeline: DataFrame, seed: int, coin: Callable[[Column], Column] = rulebook.blake2b_bit) -> DataFrame:
    """timeline with y (1: side0 won), side0 and side1 by the coin of seed and match_uid."""
    first = c("y") == 1
    tossed = timeline.withColumn("y", coin(F.concat(F.lit(f"{seed}:"), c("match_uid"))))
    return tossed.withColumn("side0", F.when(first, c("winner")).otherwise(c("loser"))).withColumn("side1", F.when(first, c("loser")).otherwise(c("winner")))


class CoinFlip:
    name = "coinflip"

    def predict(self, walk: Walk) -> DataFrame:
        return walk.rows.select("match_uid", F.lit(0.5).alias("p"))


class EloPredictor:
    name = "elo"

    def predict(self, walk: Walk) -> DataFrame:
        params = walk.config.elo.params()
        e = walk.rows.select("match_uid", "y").join(ratings.elo(walk.rows, params).select("match_uid", "elo_w", "elo_l"), "match_uid")
        own, other = F.when(c("y") == 1, c("elo_w")).otherwise(c("elo_l")), F.when(c("y") == 1, c("elo_l")).otherwise(c("elo_w"))
        return e.select("match_uid", ratings.expectation(own, other, params.scale).alias("p"))


class Log5Predictor:
    name = "log5"

    def predict(self, walk: Walk) -> DataFrame:
        p = walk.config.log5
        h = players.with_history(players.player_long(walk.rows), p.half_life_days, p.prior_wins, p.prior_games).select("match_uid", "player", "rate")
        return players.by_side(walk.rows.select("match_uid", "side0"), h, ["rate"]).select("match_uid", ratings.log5(c("rate0"), c("rate1")).alias("p"))


#: Predictors by name; register() adds to them.
PREDICTORS: dict[str, Callable[[], Predictor]] = {"coinflip": CoinFlip, "elo": EloPredictor, "log5": Log5Predictor}


def register(name: str, make: Callable[[], Predictor]) -> None:
    if name in PREDICTORS:
        raise ContractError(f"a predictor named {name} is registered already")
    PREDICTORS[name] = make


def make_predictors(names: Sequence[str]) -> list[Predictor]:
    if unknown := sorted(set(names) - set(PREDICTORS)):
        raise ContractError(f"unknown predictors: {unknown}; known: {sorted(PREDICTORS)}")
    return [PREDICTORS[n]() for n in names]


def walk_forward(timeline: DataFrame, predictors: Sequence[Predictor], config: Harness = Harness(), features: DataFrame | None = None, coin: Callable[[Column], Column] = rulebook.blake2b_bit) -> DataFrame:
    """One row a match and predictor with p, y, prior matches of both sides, scores and whether it counts in the scored window.

    Raises for predictors of one name, a timeline with gaps and (as rows are read) a
    probability that is missing or not strictly between 0 and 1.
    """
    names = [p.name for p in predictors]
    if not names or len(set(names)) != len(names):
        raise ContractError(f"predictors must be there and have different names: {names}")
    bad = gates.timeline_violations(timeline).first().asDict()
    if any(bad.values()):
        raise ContractError(f"the timeline isn't one order from 0: {bad}")
    rows = sided(timeline, config.seed, coin)
    prior = players.player_long(timeline).withColumn("n_prior", (F.row_number().over(players.by_player()) - 1).cast("long"))
    about = players.by_side(rows, prior.select("match_uid", "player", "n_prior"), ["n_prior"])
    about = about.select("match_uid", "t_idx", "date", "discipline", "side0", "side1", "y", c("n_prior0").alias("n_prior_side0"), c("n_prior1").alias("n_prior_side1"))
    walk, out = Walk(rows, config, features), None
    for p in predictors:
        said = p.predict(walk).select("match_uid", c("p").cast("double").alias("p"))
        told = F.concat(F.lit(f"{p.name} gave "), F.coalesce(c("p").cast("string"), F.lit("nothing")), F.lit(" for "), c("match_uid"))
        inside = F.when((c("p") > 0) & (c("p") < 1), c("p")).otherwise(F.raise_error(told).cast("double"))
        one = about.join(said, "match_uid", "left").withColumn("p", inside).withColumn("predictor", F.lit(p.name))
        out = one if out is None else out.unionByName(one)
    least = config.scored_min_history
    return scoring.scores(out).withColumn("scored", (c("n_prior_side0") >= least) & (c("n_prior_side1") >= least))


def timeline_digest(timeline: DataFrame) -> str:
    """SHA-256 of the ordered matches, folded day by day, so one short text a day passes one task."""
    row = F.concat_ws("|", "match_uid", c("date").cast("string"), "winner", "loser")
    days = timeline.groupBy("date").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_idx", row.alias("r")))), lambda x: x["r"]), "\n"), 256).alias("d"))
    return days.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "d"))), lambda x: x["d"]), "\n"), 256)).first()[0]


def manifest(timeline: DataFrame, names: Sequence[str], config: Harness) -> dict:
    text = json.dumps(dataclasses.asdict(config), sort_keys=True)
    return {
        "config_version": config.version, "config_sha256": hashlib.sha256(text.encode()).hexdigest(), "config": dataclasses.asdict(config), "seed": config.seed, "timeline_digest": timeline_digest(timeline),
        "n_matches": timeline.count(), "predictors": list(names), "packages": {n: importlib.metadata.version(n) for n in ("pyspark", "numpy", "pandas")}, "created_at": datetime.now().isoformat(timespec="seconds"),
    }


def report(log: DataFrame, config: Harness = Harness()) -> dict:
    """Summaries of the full and the scored window, and the scored window's calibration, by predictor."""
    scored = log.where("scored")
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    windows = {"full": rows(scoring.summarize(log), "predictor"), "scored": rows(scoring.summarize(scored), "predictor")}
    table: dict[str, list] = {}
    for r in rows(scoring.calibration(scored, config.calibration_buckets), "predictor", "bucket"):
        table.setdefault(r.pop("predictor"), []).append(r)
    return {"windows": windows, "calibration": table}
