"""Common table expressions of the DuckDB texts: the derived matches, players and strokes."""

from tallyfold.functions.labels import CLASSES

M = """m AS (
  SELECT mid, 'm:' || mid AS match_uid, date, round_rank, CASE WHEN mid % 2 = 0 THEN 'MS' ELSE 'WS' END AS discipline,
         'P' || CASE WHEN aw THEN a ELSE b END AS winner, 'P' || CASE WHEN aw THEN b ELSE a END AS loser, 2 + mid % 2 AS n_sets
  FROM (SELECT *, st = 'O' OR (st <> 'F' AND a < b) AS aw FROM (
    SELECT o_orderkey // 20 AS mid, cast(o_orderdate AS DATE) AS date, cast(o_orderpriority[1] AS INT) AS round_rank, o_orderstatus AS st,
           (o_orderkey // 20) % 2 * 16 + o_custkey % 16 AS a, (o_orderkey // 20) % 2 * 16 + (o_custkey % 16 + 1 + (o_orderkey // 20) % 15) % 16 AS b
    FROM orders WHERE o_orderkey % 20 = 0)))"""
T = M + """, t AS (SELECT *, row_number() OVER (ORDER BY date, round_rank, match_uid) - 1 AS t_idx FROM m)"""
P = T + """, pl AS (
  SELECT t_idx, match_uid, date, discipline, n_sets, winner AS player, loser AS opp, 1 AS won FROM t
  UNION ALL SELECT t_idx, match_uid, date, discipline, n_sets, loser, winner, 0 FROM t)"""
#: Sides by the MD5 coin.
SIDES = """sides AS (SELECT *, CASE WHEN bit = 1 THEN winner ELSE loser END AS side0, CASE WHEN bit = 1 THEN loser ELSE winner END AS side1, bit AS y
  FROM (SELECT *, CASE WHEN md5('7:' || match_uid)[32] IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE 0 END AS bit FROM t))"""
#: log5 rates in closed form, every earlier match weighted anew.
RATE = """rate AS (SELECT a.match_uid, a.player,
    (coalesce(sum(pow(0.5, date_diff('day', b.date, a.date) / 540.0) * b.won), 0) + 5) / (coalesce(sum(pow(0.5, date_diff('day', b.date, a.date) / 540.0)), 0) + 10) AS r
  FROM pl a LEFT JOIN pl b ON a.player = b.player AND b.t_idx < a.t_idx GROUP BY ALL)"""
#: Elo step by step, the ratings in a map.
ELO = """pri AS (SELECT match_uid, player, row_number() OVER (PARTITION BY player, discipline ORDER BY t_idx) - 1 AS n FROM pl),
seq AS (SELECT t.*, row_number() OVER (PARTITION BY discipline ORDER BY t_idx) AS i, w.n AS nw, l.n AS nl FROM t JOIN pri w ON w.match_uid = t.match_uid AND w.player = winner JOIN pri l ON l.match_uid = t.match_uid AND l.player = loser),
walk AS (
  SELECT discipline, 0::BIGINT AS i, ''::VARCHAR AS match_uid, 0.0::DOUBLE AS elo_w, 0.0::DOUBLE AS elo_l, MAP {'': 0.0::DOUBLE} AS state FROM (SELECT DISTINCT discipline FROM t)
  UNION ALL
  SELECT discipline, i, match_uid, rw, rl, map_concat(state, MAP {winner: rw + (CASE WHEN nw < 10 THEN 40.0 ELSE 20.0 END) * s, loser: rl - (CASE WHEN nl < 10 THEN 40.0 ELSE 20.0 END) * s})
  FROM (SELECT *, 1 - 1 / (1 + pow(10.0, (rl - rw) / 400.0)) AS s FROM (
    SELECT s.discipline, s.i, s.match_uid, s.winner, s.loser, s.nw, s.nl, walk.state, coalesce(walk.state[s.winner], 1500.0) AS rw, coalesce(walk.state[s.loser], 1500.0) AS rl
    FROM walk JOIN seq s ON s.discipline = walk.discipline AND s.i = walk.i + 1))),
elo AS (SELECT match_uid, elo_w, elo_l FROM walk WHERE i > 0)"""
#: Predictions of the three baselines.
PRED = SIDES + ", " + RATE + ", " + ELO + """, pred AS (
  SELECT s.match_uid, s.t_idx, s.y, 'coinflip' AS predictor, 0.5::DOUBLE AS p FROM sides s
  UNION ALL SELECT s.match_uid, s.t_idx, s.y, 'elo', 1 / (1 + pow(10.0, ((CASE WHEN y = 1 THEN elo_l ELSE elo_w END) - (CASE WHEN y = 1 THEN elo_w ELSE elo_l END)) / 400.0)) FROM sides s JOIN elo USING (match_uid)
  UNION ALL SELECT s.match_uid, s.t_idx, s.y, 'log5', a.r * (1 - b.r) / (a.r * (1 - b.r) + b.r * (1 - a.r)) FROM sides s JOIN rate a ON a.match_uid = s.match_uid AND a.player = side0 JOIN rate b ON b.match_uid = s.match_uid AND b.player = side1),
np AS (SELECT match_uid, min(n) AS least FROM (SELECT match_uid, row_number() OVER (PARTITION BY player ORDER BY t_idx) - 1 AS n FROM pl) GROUP BY 1),
sc AS (SELECT pred.*, least >= 3 AS scored, (p - y) * (p - y) AS brier, -(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM pred JOIN np USING (match_uid))"""
LABELS = "lab(token, shot_class, shot_group) AS (VALUES " + ", ".join(f"({i}, '{c}', '{g}')" for i, (c, g, _) in enumerate(CLASSES)) + ")"
S = """s0 AS (
  SELECT 'm:' || l_orderkey // 20 AS match_uid, l_orderkey % 20 AS rally, CASE WHEN l_orderkey % 20 < 10 THEN 1 ELSE 2 END AS set_no,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ball_round, count(*) OVER (PARTITION BY l_orderkey) AS n,
    l_orderkey, l_partkey % 19 AS token, CASE WHEN l_discount <> 0 THEN l_suppkey % 2 END AS backhand, CASE WHEN l_tax <> 0 THEN l_linenumber % 2 END AS aroundhead, l_returnflag AS rf,
    l_partkey, l_suppkey, l_partkey + l_linenumber AS gap FROM lineitem),
s AS (SELECT match_uid, set_no, rally, ball_round, CASE WHEN (ball_round + l_orderkey) % 2 = 0 THEN 'A' ELSE 'B' END AS player, token, backhand, aroundhead,
    CASE WHEN ball_round = n THEN CASE rf WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' END END AS getpoint_player, ball_round * 30 + l_partkey % 7 AS frame_num,
    CASE WHEN gap % 3 <> 0 THEN (l_partkey % 170)::DOUBLE END AS player_location_x, CASE WHEN gap % 5 <> 0 THEN (l_suppkey % 300)::DOUBLE END AS player_location_y,
    CASE WHEN gap % 4 <> 0 THEN (l_suppkey % 171)::DOUBLE END AS opponent_location_x, CASE WHEN gap % 6 <> 0 THEN (l_partkey % 301)::DOUBLE END AS opponent_location_y,
    CASE WHEN gap % 7 <> 0 THEN (l_partkey % 172)::DOUBLE END AS landing_x, CASE WHEN gap % 9 <> 0 THEN (l_suppkey % 302)::DOUBLE END AS landing_y FROM s0),
""" + LABELS + """,
ls AS (SELECT s.*, shot_class, shot_group, shot_class IS NULL AS is_unknown FROM s LEFT JOIN lab USING (token)),
r AS (SELECT match_uid, set_no, rally, count(*) AS len, arg_min(player, ball_round) AS server, arg_max(player, ball_round) AS last_player,
    max(CASE WHEN ball_round = n THEN shot_class END) AS last_class, max(CASE WHEN ball_round = n THEN shot_group END) AS last_group, max(getpoint_player) AS winner,
    max(CASE WHEN ball_round = 3 THEN player END) AS third_player, max(CASE WHEN ball_round = 3 THEN shot_group END) AS third_group
  FROM (SELECT *, max(ball_round) OVER (PARTITION BY match_uid, set_no, rally) AS n FROM ls) GROUP BY ALL)"""
COUNTS = S + """, side AS (SELECT unnest(['A', 'B']) AS side),
own AS (SELECT match_uid, player AS side, count(*)::DOUBLE AS strokes_total, count(shot_class)::DOUBLE AS classified_strokes, count(*) FILTER (shot_class IN ('smash', 'wrist_smash'))::DOUBLE AS smash_strokes,
    count(*) FILTER (shot_group = 'net')::DOUBLE AS net_strokes, count(*) FILTER (shot_group = 'attack')::DOUBLE AS attack_strokes, count(*) FILTER (shot_class = 'short_service')::DOUBLE AS short_serves, count(*) FILTER (shot_class = 'long_service')::DOUBLE AS long_serves,
    count(*) FILTER (backhand + aroundhead IS NOT NULL)::DOUBLE AS flagged_strokes, count(*) FILTER (backhand + aroundhead IS NOT NULL AND backhand = 1)::DOUBLE AS backhand_strokes, count(*) FILTER (backhand + aroundhead IS NOT NULL AND aroundhead = 1)::DOUBLE AS aroundhead_strokes
  FROM ls GROUP BY ALL),
per AS (SELECT match_uid, side, count(*) FILTER (server = side)::DOUBLE AS serves, count(*) FILTER (last_player = side AND winner <> side)::DOUBLE AS last_stroke_losses, count(*) FILTER (last_player = side AND winner <> side AND last_group = 'net')::DOUBLE AS net_last_losses,
    count(*) FILTER (last_player = side AND winner = side AND last_class IN ('smash', 'wrist_smash'))::DOUBLE AS smash_kills, count(*) FILTER (len = 1 AND winner <> server AND server = side)::DOUBLE AS serve_faults,
    count(*) FILTER (winner IS NOT NULL AND server = side)::DOUBLE AS serve_rallies, count(*) FILTER (winner IS NOT NULL AND server <> side)::DOUBLE AS receive_rallies, count(*) FILTER (winner = side AND server = side)::DOUBLE AS serve_rally_wins, count(*) FILTER (winner = side AND server <> side)::DOUBLE AS receive_rally_wins,
    count(*) FILTER (winner IS NOT NULL AND len >= 9)::DOUBLE AS long_played, count(*) FILTER (winner = side AND len >= 9)::DOUBLE AS long_won, count(*) FILTER (winner IS NOT NULL AND len <= 4)::DOUBLE AS short_played, count(*) FILTER (winner = side AND len <= 4)::DOUBLE AS short_won,
    count(*) FILTER (len >= 3 AND third_player = server AND server = side)::DOUBLE AS third_stroke_chances, count(*) FILTER (len >= 3 AND third_player = server AND server = side AND third_group = 'attack')::DOUBLE AS third_stroke_attacks
  FROM r, side GROUP BY ALL),
cnt AS (SELECT per.*, COLUMNS(own.* EXCLUDE (match_uid, side)) FROM per LEFT JOIN own USING (match_uid, side)),
pc AS (SELECT cnt.*, t_idx, date, CASE WHEN side = 'A' THEN t.winner ELSE t.loser END AS player FROM cnt JOIN t USING (match_uid))"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
