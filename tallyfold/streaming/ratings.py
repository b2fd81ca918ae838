"""Elo as a stream: predict from state, emit, then update; late rows are marked, not folded."""

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfold.operators.ratings import EloParams, fold

OUT = "discipline string, match_uid string, t_idx long, elo_w double, elo_l double, late boolean"


def streaming_elo(matches: DataFrame, params: EloParams = EloParams()) -> DataFrame:
    """Ratings before each match of a stream of (discipline, match_uid, t_idx, winner, loser).

    State is one row a discipline: the ratings, and the last t_idx folded. Rows of a
    micro-batch are folded in t_idx order; a row not beyond the last one is late.
    """

    def run(key, parts, state: GroupState):
        ratings, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, -1)
        rows = pd.concat(list(parts), ignore_index=True)
        late = rows[rows["t_idx"] <= last]
        fresh = rows[rows["t_idx"] > last]
        held = {p: tuple(v) for p, v in ratings.items()}
        done = fold(fresh, params, held)
        state.update((json.dumps(held), int(max(last, fresh["t_idx"].max() if len(fresh) else -1))))
        out = pd.concat([done[["match_uid", "t_idx", "elo_w", "elo_l"]].assign(late=False), late[["match_uid", "t_idx"]].assign(elo_w=None, elo_l=None, late=True)], ignore_index=True) if len(late) else done[["match_uid", "t_idx", "elo_w", "elo_l"]].assign(late=False)
        out.insert(0, "discipline", key[0])
        yield out

    cols = matches.select("discipline", "match_uid", "t_idx", "winner", "loser")
    return cols.groupBy("discipline").applyInPandasWithState(run, OUT, "ratings string, last long", "append", GroupStateTimeout.NoTimeout)
