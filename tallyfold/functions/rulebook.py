"""Scoring rules, identities and other row-wise rules, as columns."""

import hashlib
import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Rounds within one day, earliest first.
ROUND_RANK = {"Group-Stage": 0, "R32": 1, "R16": 2, "Quarter-finals": 3, "QF": 3, "Semi-finals": 4, "SF": 4, "Finals": 5, "F": 5}


def round_rank(name: Column) -> Column:
    """The rank, or null for a name that has none."""
    table = F.create_map(*[F.lit(x) for kv in ROUND_RANK.items() for x in kv])
    return F.try_element_at(table, name)


def legal_score(a: Column, b: Column) -> Column:
    """21 to at most 19, 22 to 30 by exactly 2, or 30-29."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (lo >= 0) & (((hi == 21) & (lo <= 19)) | (hi.between(22, 30) & (hi - lo == 2)) | ((hi == 30) & (lo == 29)))


def would_win_game(own: Column, opponent: Column) -> Column:
    """Whether one more point ends the game: with 21 to 30 points and a lead of two, or at 30-29."""
    lead = own - opponent + 1
    return own.between(20, 29) & ((lead >= 2) | ((own == 29) & (lead == 1)))


def extract_winner(games_1: Column, points_1: Column, games_2: Column, points_2: Column) -> Column:
    """'T1P1' or 'T2P1' if exactly that side can end the match with one more point, else null."""
    one = (games_1 == 1) & would_win_game(points_1, points_2)
    two = (games_2 == 1) & would_win_game(points_2, points_1)
    return F.when(one & ~two, "T1P1").when(two & ~one, "T2P1")


def coerce_int(x: Column) -> Column:
    """The integer of a text such as '2022' or '2022.0', else null."""
    d = x.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("int"))


def safe_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")), "yyyy-M-d")


def iso_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week."""
    return F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (7 * (week - 1)).cast("int"))


#: Characters whose case folding isn't their lower case, such as sharp s and final sigma.
FOLDED = {ch: ch.casefold() for ch in map(chr, range(128, 0x110000)) if ch.casefold() != ch.lower()}


def casefold(x: Column) -> Column:
    """Full case folding: character by character only where a text has any beyond ASCII."""
    table = F.from_json(F.lit(json.dumps(FOLDED)), "map<string,string>")
    each = F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), F.lower(ch)))
    return F.when(x.rlike("[^\\x00-\\x7f]"), F.array_join(each, "")).otherwise(F.lower(x))


def normalize_name(x: Column) -> Column:
    """Case folded, with single spaces for runs of Unicode white space and none at the ends."""
    return casefold(F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " ")))


def md5_bit(key: Column) -> Column:
    """A fair coin from the last hex digit of the key's MD5."""
    return F.substring(F.md5(key), 32, 1).isin(*"13579bdf").cast("int")


def _coins(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else hashlib.blake2b(k.encode(), digest_size=8).digest()[-1] & 1).astype("Int32")


def blake2b_bit(key: Column) -> Column:
    """A fair coin from the lowest bit of the key's 64-bit BLAKE2b."""
    return pandas_udf(_coins, "int")(key)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def name_ratio(a: Column | str, b: Column | str) -> Column:
    """difflib's ratio of two names."""
    return pandas_udf(_ratios, "double")(a, b)


def match_reason(today: Column) -> Column:
    """The first rule a match row breaks (null: none), over match_type, side_a, side_b (arrays), winner_side, played_at and games (a, b)."""
    c = F.col
    names = F.transform(F.concat("side_a", "side_b"), normalize_name)
    size = F.when(c("match_type") == "singles", 1).otherwise(2)
    won = F.size(F.filter("games", lambda g: F.when(c("winner_side") == "a", g["a"] > g["b"]).otherwise(g["b"] > g["a"])))
    last = F.element_at("games", -1)
    rules = [
        (~c("match_type").isin("singles", "doubles"), "type"),
        ((F.size("side_a") != size) | (F.size("side_b") != size), "roster"),
        (~c("winner_side").isin("a", "b"), "winner_side"),
        (F.size(F.array_distinct(names)) != F.size(names), "duplicate_player"),
        (c("played_at").isNull(), "date"),
        (c("played_at") > today, "future"),
        (c("played_at") < F.lit("2020-01-01").cast("date"), "too_early"),
        (~F.size("games").between(2, 3), "game_count"),
        (F.exists("games", lambda g: ~legal_score(g["a"], g["b"])), "score"),
        (won != 2, "winner_games"),
        (F.when(c("winner_side") == "a", last["a"] < last["b"]).otherwise(last["b"] < last["a"]), "last_game"),
    ]
    out = F.lit(None).cast("string")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), reason).otherwise(out)
    return out
