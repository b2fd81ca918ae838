"""Queries over stroke events."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators import gates, players, strokes
from tallyfold.plans import records
from tallyfold.plans.records import query, rnd, tl
from tallyfold.plans.sql import COUNTS, S, T, r6
from tallyfold.session import written
from tallyfold.sources import driver

c = F.col


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = strokes.labelled(driver.strokes(spark, d))
    return s, strokes.rallies(s)


def player_counters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, r = parts(spark, d)
    return strokes.player_counters(tl(spark, d), strokes.counters(s, r)), r


PLACES = "frame_num, player_location_x, player_location_y, opponent_location_x, opponent_location_y, landing_x, landing_y"


@query(f"{T}, {records.SIDES}, {S} SELECT match_uid, set_no::BIGINT AS set_no, rally, ball_round, token::BIGINT AS token, backhand::BIGINT AS backhand, aroundhead::BIGINT AS aroundhead, {PLACES}, CASE WHEN (player = 'A') = (y = 1) THEN 'side0' ELSE 'side1' END AS side FROM s JOIN sides USING (match_uid)")
def pre_outcome_view(spark, d):
    """Strokes without what tells the outcome; strikers are sides by the match's coin."""
    view = strokes.pre_outcome(driver.strokes(spark, d), records.with_sides(tl(spark, d)))
    return view.withColumns({n: c(n).cast("long") for n in ("set_no", "ball_round", "token", "backhand", "aroundhead")})


@query(f"{T}, {S} SELECT s.match_uid, rally, ball_round, CASE player WHEN 'A' THEN winner ELSE loser END AS player, CASE getpoint_player WHEN 'A' THEN winner WHEN 'B' THEN loser END AS getpoint_player FROM s JOIN t USING (match_uid)")
def historical_view(spark, d):
    view = strokes.historical(driver.strokes(spark, d), driver.matches(spark, d))
    return view.select("match_uid", "rally", c("ball_round").cast("long").alias("ball_round"), "player", "getpoint_player")


@query(f"{S} SELECT shot_class, shot_group, is_unknown, count(*) AS n FROM ls GROUP BY ALL")
def apply_labels(spark, d):
    return strokes.labelled(driver.strokes(spark, d)).groupBy("shot_class", "shot_group", "is_unknown").agg(F.count("*").alias("n"))


@query(f"{T}, {S} SELECT count(*) AS n FROM s WHERE match_uid IN (SELECT match_uid FROM t WHERE discipline <> 'WS')")
def elite_strokes(spark, d):
    m = driver.matches(spark, d).where("discipline <> 'WS'").select("match_uid")
    return driver.strokes(spark, d).join(m, "match_uid", "left_semi").agg(F.count("*").alias("n"))


@query(f"{T}, {S} SELECT match_uid FROM t WHERE match_uid NOT IN (SELECT match_uid FROM s WHERE token = 5)")
def missing_strokes(spark, d):
    """Matches without a stroke of one class."""
    return driver.matches(spark, d).select("match_uid").join(driver.strokes(spark, d).where("token = 5").select("match_uid"), "match_uid", "left_anti")


@query(f"{S} SELECT match_uid, set_no::BIGINT AS set_no, rally, len, server, last_player, last_class, last_group, winner, third_player, third_group FROM r")
def rally_rollup(spark, d):
    return parts(spark, d)[1].withColumn("set_no", c("set_no").cast("long"))


@query(f"{COUNTS.split(', pc AS')[0].split('pc AS')[0].rstrip().rstrip(',')} SELECT match_uid, side, {', '.join(strokes.COUNTERS)} FROM cnt")
def tactical_counters(spark, d):
    return strokes.counters(*parts(spark, d)).select("match_uid", "side", *strokes.COUNTERS)


PRIOR = ", pp AS (SELECT t_idx, " + ", ".join(f"CASE WHEN coalesce(sum({d}) OVER w, 0) = 0 THEN 0.5 ELSE sum({n}) OVER w / sum({d}) OVER w END AS prior_{r}" for r, n, d in strokes.RATES) + " FROM (SELECT t_idx, " + ", ".join(f"sum({x}) AS {x}" for x in sorted({y for _, n, d in strokes.RATES for y in (n, d)})) + " FROM pc GROUP BY 1) WINDOW w AS (ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"{T}, {COUNTS}{PRIOR} SELECT t_idx, {', '.join(f'{r6(f'prior_{r}')} AS prior_{r}' for r, _, _ in strokes.RATES)} FROM pp")
def pooled_prior(spark, d):
    out = strokes.pooled_priors(player_counters(spark, d)[0])
    return out.select("t_idx", *[rnd(c(x)).alias(x) for x in out.columns if x != "t_idx"])


HISTORY = ", hs AS (SELECT a.match_uid, a.t_idx, a.player, a.side, count(b.t_idx) AS n_prior, " + ", ".join(f"coalesce(sum(b.{x} * pow(0.5, date_diff('day', b.date, a.date) / 300.0)), 0) AS {x}" for x in strokes.COUNTERS) + " FROM pc a LEFT JOIN pc b ON a.player = b.player AND b.t_idx < a.t_idx GROUP BY a.match_uid, a.t_idx, a.player, a.side)"


@query(f"{T}, {COUNTS}{HISTORY} SELECT match_uid, player, n_prior, {', '.join(f'{r6(x)} AS {x}' for x in strokes.COUNTERS)} FROM hs")
def decayed_history(spark, d):
    out = strokes.decayed_history(player_counters(spark, d)[0])
    return out.select("match_uid", "player", c("n_prior").cast("long").alias("n_prior"), *[rnd(c(x)).alias(x) for x in strokes.COUNTERS])


MEDIAN = """, mass AS (SELECT a.player, a.t_idx, len, sum(pow(0.5, date_diff('day', b.date, a.date) / 300.0)) AS w FROM pc a JOIN pc b ON a.player = b.player AND b.t_idx < a.t_idx JOIN r ON r.match_uid = b.match_uid GROUP BY ALL),
md AS (SELECT player, t_idx, min(len)::DOUBLE AS median_rally_len FROM (SELECT *, sum(w) OVER (PARTITION BY player, t_idx ORDER BY len) AS cum, sum(w) OVER (PARTITION BY player, t_idx) AS total FROM mass) WHERE cum >= total / 2 - 1e-9 GROUP BY ALL)"""


@query(f"{T}, {COUNTS}{MEDIAN} SELECT * FROM md")
def weighted_median(spark, d):
    return strokes.weighted_medians(*player_counters(spark, d))


def _rate(r: str, n: str, dn: str) -> str:
    serve = r in strokes.SERVE_RATES
    k = 10.0 if serve else 30.0
    return f"CASE WHEN n_prior > 0 AND strokes_total >= 150 {'AND serves >= 30 ' * serve}THEN ({n} + {k} * prior_{r}) / ({dn} + {k}) END AS {r}"


TACTICAL = PRIOR + HISTORY + MEDIAN + ", tr AS (SELECT hs.match_uid, hs.player, hs.side, " + ", ".join(_rate(*x) for x in strokes.RATES) + """, CASE WHEN n_prior > 0 AND strokes_total >= 150 THEN median_rally_len END AS median_rally_len,
  CASE WHEN n_prior > 0 AND strokes_total >= 150 AND serves >= 30 AND serve_rallies > 0 AND receive_rallies > 0 THEN serve_rally_wins / serve_rallies - receive_rally_wins / receive_rallies END AS serve_advantage
  FROM hs JOIN pp USING (t_idx) LEFT JOIN md ON md.player = hs.player AND md.t_idx = hs.t_idx)"""


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Counters and rallies are read three times, so they are made once and written."""
    s, r = parts(spark, d)
    r = written(spark, r)
    pc = written(spark, strokes.player_counters(tl(spark, d), strokes.counters(s, r)))
    return strokes.tactical_rates(strokes.decayed_history(pc), strokes.pooled_priors(pc), strokes.weighted_medians(pc, r))


@query(f"{T}, {COUNTS}{TACTICAL} SELECT match_uid, player, {', '.join(f'{r6(x)} AS {x}' for x in strokes.FEATURES)} FROM tr")
def tactical_rates(spark, d):
    return rates(spark, d).select("match_uid", "player", *[rnd(c(x)).alias(x) for x in strokes.FEATURES])


def tactical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the 13 features, side 0 less side 1."""
    s = records.with_sides(tl(spark, d)).select("match_uid", "side0")
    s = players.by_side(s, rates(spark, d), strokes.FEATURES)
    return s.select("match_uid", *[(c(f"{x}0") - c(f"{x}1")).alias(f"{x}_diff") for x in strokes.FEATURES])


DIFFS = f"{T}, {COUNTS}{TACTICAL}, " + records.SIDES + " SELECT s.match_uid, " + ", ".join(f"{r6(f'a.{x} - b.{x}')} AS {x}_diff" for x in strokes.FEATURES) + " FROM sides s JOIN tr a ON a.match_uid = s.match_uid AND a.player = side0 JOIN tr b ON b.match_uid = s.match_uid AND b.player = side1"


@query(DIFFS)
def tactical_features(spark, d):
    out = tactical_rows(spark, d)
    return out.select("match_uid", *[rnd(c(x)).alias(x) for x in out.columns[1:]])


@query(f"{T}, {COUNTS}{TACTICAL}, " + records.FEATS.removeprefix(T + ", ") + f" SELECT s.match_uid, {r6('elo_diff')} AS elo_diff, {r6('a.attack_share - b.attack_share')} AS attack_share_diff FROM sides s JOIN feats USING (match_uid) JOIN tr a ON a.match_uid = s.match_uid AND a.player = side0 JOIN tr b ON b.match_uid = s.match_uid AND b.player = side1", recursive=True)
def feature_merge(spark, d):
    """Records and tactical features, one to one by match."""
    return gates.one_to_one(records.match_feature_rows(tl(spark, d)), tactical_rows(spark, d), "match_uid").select("match_uid", rnd(c("elo_diff")).alias("elo_diff"), rnd(c("attack_share_diff")).alias("attack_share_diff"))


@query(f"{S} SELECT match_uid, rally, ball_round, dense_rank() OVER (PARTITION BY match_uid ORDER BY set_no, rally) - 1 AS rally_idx, row_number() OVER (PARTITION BY match_uid, set_no, rally ORDER BY ball_round) - 1 AS shot_idx FROM s")
def events_flat(spark, d):
    w = Window.partitionBy("match_uid")
    return driver.strokes(spark, d).select("match_uid", "rally", c("ball_round").cast("long").alias("ball_round"), (F.dense_rank().over(w.orderBy("set_no", "rally")) - 1).cast("long").alias("rally_idx"), (F.row_number().over(Window.partitionBy("match_uid", "set_no", "rally").orderBy("ball_round")) - 1).cast("long").alias("shot_idx"))


def event_documents(spark: SparkSession, d: str) -> DataFrame:
    return strokes.event_documents(strokes.labelled(driver.strokes(spark, d)), records.with_sides(tl(spark, d)), "shot_labels_v1")


EVENTS = f"""{T}, {records.SIDES}, {S} SELECT match_uid, date, discipline, side0 AS side0_player, side1 AS side1_player, CASE y WHEN 1 THEN 'side0' ELSE 'side1' END AS winner_side,
  dense_rank() OVER (PARTITION BY match_uid ORDER BY set_no, rally) - 1 AS rally_idx, row_number() OVER (PARTITION BY match_uid, set_no, rally ORDER BY ball_round) - 1 AS shot_idx, frame_num AS frame_hit,
  CASE WHEN (player = 'A') = (y = 1) THEN 'side0' ELSE 'side1' END AS striker, shot_class, 'shot_labels_v1' AS shot_class_version, aroundhead = 1 AS around_head, backhand = 1 AS backhand, 'human_annotation' AS source,
  {", ".join(f"CASE WHEN {p}_x IS NOT NULL AND {p}_y IS NOT NULL THEN {p}_{k} END AS {n}_{k}" for p, n in (("player_location", "striker"), ("opponent_location", "receiver"), ("landing", "landing")) for k in ("x", "y"))}
  FROM ls JOIN sides USING (match_uid)"""


def _flat(documents: DataFrame) -> DataFrame:
    rows = strokes.shots_of(documents)
    for n in ("striker", "receiver", "landing"):
        rows = rows.withColumn(f"{n}_x", c(f"{n}_xy")[0]).withColumn(f"{n}_y", c(f"{n}_xy")[1]).drop(f"{n}_xy")
    return rows.withColumns({n: c(n).cast("long") for n in ("rally_idx", "shot_idx")})


@query(EVENTS)
def events_nested(spark, d):
    """The nested documents, read out shot by shot."""
    return _flat(event_documents(spark, d))


@query(EVENTS)
def events_json_roundtrip(spark, d):
    """The same after a round trip through JSON texts."""
    docs = event_documents(spark, d)
    return _flat(docs.select(F.from_json(F.to_json(F.struct(*docs.columns)), docs.schema).alias("e")).select("e.*"))
