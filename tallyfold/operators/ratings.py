"""Elo with an adaptive K as an ordered fold, and log5 probabilities."""

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EloParams:
    initial: float = 1500.0
    scale: float = 400.0
    k_new: float = 40.0
    k_known: float = 20.0
    new_matches: int = 10


def fold(part: pd.DataFrame, p: EloParams, state: dict | None = None) -> pd.DataFrame:
    """Ratings before and after each match of one rating pool; state maps a player to (rating, matches)."""
    state = {} if state is None else state
    rows = []
    for uid, t, w, lo in part.sort_values("t_idx")[["match_uid", "t_idx", "winner", "loser"]].itertuples(index=False):
        (rw, nw), (rl, nl) = state.get(w, (p.initial, 0)), state.get(lo, (p.initial, 0))
        surprise = 1 - 1 / (1 + 10 ** ((rl - rw) / p.scale))
        after_w = rw + (p.k_new if nw < p.new_matches else p.k_known) * surprise
        after_l = rl - (p.k_new if nl < p.new_matches else p.k_known) * surprise
        state[w], state[lo] = (after_w, nw + 1), (after_l, nl + 1)
        rows.append((uid, t, rw, rl, after_w, after_l))
    return pd.DataFrame(rows, columns=["match_uid", "t_idx", "elo_w", "elo_l", "elo_w_after", "elo_l_after"])


def elo(timeline: DataFrame, params: EloParams = EloParams(), pool: str = "discipline") -> DataFrame:
    """Ratings around each match. The recursion is sequential within a pool of players
    who can meet, so a pool is one task: give connected components as `pool` for many."""
    schema = "match_uid string, t_idx long, elo_w double, elo_l double, elo_w_after double, elo_l_after double"
    return timeline.select(pool, "match_uid", "t_idx", "winner", "loser").groupBy(pool).applyInPandas(lambda part: fold(part, params), schema)


def expectation(own: Column, other: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / scale))


def log5(r0: Column, r1: Column) -> Column:
    return r0 * (1 - r1) / (r0 * (1 - r1) + r1 * (1 - r0))
