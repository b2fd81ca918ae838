"""Queries over row rules, names, and the club tables derived from customers, orders and lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import rulebook
from tallyfold.plans.records import query
from tallyfold.plans.sql import M
from tallyfold.sources import driver

c = F.col


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey END AS n FROM lineitem")
def coerce_int(spark, d):
    text = F.concat(c("l_partkey").cast("string"), F.when(c("l_partkey") % 3 == 0, ".5").otherwise(".0"))
    return driver.table(spark, d, "lineitem").select("l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", rulebook.coerce_int(text).cast("long").alias("n"))


@query("SELECT o_orderkey, try_cast('2021-' || lpad((o_custkey % 13 + 1)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS DATE) AS d FROM orders")
def safe_date(spark, d):
    return driver.table(spark, d, "orders").select("o_orderkey", rulebook.safe_date(F.lit(2021), c("o_custkey") % 13 + 1, c("o_orderkey") % 31 + 1).alias("d"))


POINTS = "SELECT o_orderkey, (o_orderkey % 31)::INT AS a, (o_custkey % 31)::INT AS b, (o_orderkey % 2)::INT AS g1, (o_custkey % 2)::INT AS g2 FROM orders"


def points(spark: SparkSession, d: str) -> DataFrame:
    i = lambda x: x.cast("int")
    return driver.table(spark, d, "orders").select("o_orderkey", i(c("o_orderkey") % 31).alias("a"), i(c("o_custkey") % 31).alias("b"), i(c("o_orderkey") % 2).alias("g1"), i(c("o_custkey") % 2).alias("g2"))


WOULD = "(({0} + 1 = 30 AND {1} = 29) OR ({0} + 1 BETWEEN 21 AND 30 AND {0} + 1 - {1} >= 2))"
LEGAL = "((greatest({0}, {1}) = 21 AND least({0}, {1}) <= 19) OR (greatest({0}, {1}) BETWEEN 22 AND 30 AND abs({0} - {1}) = 2) OR (greatest({0}, {1}) = 30 AND least({0}, {1}) = 29))"


@query(f"p AS ({POINTS}) SELECT o_orderkey, {WOULD.format('a', 'b')} AS ends FROM p")
def would_win_game(spark, d):
    return points(spark, d).select("o_orderkey", rulebook.would_win_game(c("a"), c("b")).alias("ends"))


@query(f"p AS ({POINTS}), q AS (SELECT *, g1 = 1 AND {WOULD.format('a', 'b')} AS x, g2 = 1 AND {WOULD.format('b', 'a')} AS y FROM p) SELECT o_orderkey, CASE WHEN x AND NOT y THEN 'T1P1' WHEN y AND NOT x THEN 'T2P1' END AS winner FROM q")
def extract_winner(spark, d):
    return points(spark, d).select("o_orderkey", rulebook.extract_winner(c("g1"), c("a"), c("g2"), c("b")).alias("winner"))


@query(f"p AS ({POINTS}) SELECT o_orderkey, {LEGAL.format('a', 'b')} AS legal FROM p")
def legal_score(spark, d):
    return points(spark, d).select("o_orderkey", rulebook.legal_score(c("a"), c("b")).alias("legal"))


@query("SELECT o_orderkey, week(o_orderdate)::BIGINT AS w, date_trunc('week', make_date(isoyear(o_orderdate), 1, 4))::DATE + (7 * (week(o_orderdate) - 1))::INT AS monday FROM orders")
def iso_week(spark, d):
    week, year = F.weekofyear("o_orderdate"), F.extract(F.lit("YEAROFWEEK"), c("o_orderdate"))
    return driver.table(spark, d, "orders").select("o_orderkey", week.cast("long").alias("w"), rulebook.iso_monday(year.cast("int"), week).alias("monday"))


@query("SELECT c_custkey, lower(trim(regexp_replace('  ' || replace(c_name, '#', ' \t '), '\\s+', ' ', 'g'))) AS name FROM customer")
def normalize_name(spark, d):
    return driver.table(spark, d, "customer").select("c_custkey", rulebook.normalize_name(F.concat(F.lit("  "), F.replace(c("c_name"), F.lit("#"), F.lit(" \t ")))).alias("name"))


@query()
def name_guard(spark, d):
    """New names close to an existing one: the roster (25 nations) is the small side; equal normalised names are no twins."""
    nations = driver.table(spark, d, "nation")
    nation = nations.select(rulebook.normalize_name(c("n_name")).alias("known"))
    typed = F.concat(c("n_name"), F.when(c("c_custkey") % 2 == 0, "s").otherwise("  "))
    new = driver.table(spark, d, "customer").join(F.broadcast(nations), c("c_nationkey") == c("n_nationkey")).select("c_custkey", rulebook.normalize_name(typed).alias("name"))
    names = new.select("name").distinct().join(F.broadcast(nation), c("name") != c("known")).withColumn("ratio", rulebook.name_ratio("name", "known")).where("ratio >= 0.85")
    return new.join(names.groupBy("name").agg(F.max("ratio").alias("ratio")), "name").select("c_custkey", "name", F.round("ratio", 6).alias("ratio"))


OVERRIDE = M + """, ov AS (SELECT match_uid, CASE WHEN mid % 7 = 0 THEN NULL ELSE winner END AS own, CASE WHEN mid % 4 = 0 THEN winner WHEN mid % 9 = 0 THEN loser END AS over FROM m)"""


@query(OVERRIDE + " SELECT match_uid, coalesce(own, over) AS winner, CASE WHEN own <> over THEN 'disagrees' WHEN coalesce(own, over) IS NULL THEN 'no winner' END AS reason FROM ov")
def override_reconcile(spark, d):
    m = driver.matches(spark, d)
    over = m.select("match_uid", F.when(c("mid") % 4 == 0, c("winner")).when(c("mid") % 9 == 0, c("loser")).alias("over")).where("over IS NOT NULL")
    rows = m.select("match_uid", F.when(c("mid") % 7 != 0, c("winner")).alias("own")).join(over, "match_uid", "left")
    winner = F.coalesce("own", "over")
    return rows.select("match_uid", winner.alias("winner"), F.when(c("own") != c("over"), "disagrees").when(winner.isNull(), "no winner").alias("reason"))


# The club's tables: players are customers, matches orders, games their first lines.
CLUB = f"""g AS (SELECT o_orderkey, l_linenumber AS k, 21 AS hi, (l_partkey % 22)::INT AS lo, l_suppkey % 3 = 0 AS flip FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) l ON l_orderkey = o_orderkey AND rn = 1 AND l_linenumber <= 3),
gm AS (SELECT o_orderkey, k, CASE WHEN flip THEN lo ELSE hi END AS a, CASE WHEN flip THEN hi ELSE lo END AS b FROM g),
cm AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 3 THEN 'mixed' ELSE 'singles' END AS match_type, 'C' || o_custkey AS pa, 'C' || (o_custkey + o_orderkey % 40) AS pb, CASE WHEN o_orderstatus = 'F' THEN 'b' ELSE 'a' END AS ws, o_orderdate::DATE AS played_at FROM orders),
agg AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER ({LEGAL.format('a', 'b')}) AS ok, count(*) FILTER (a > b) AS won_a, count(*) FILTER (b > a) AS won_b, arg_max(a - b, k) AS last FROM gm GROUP BY 1),
val AS (SELECT cm.*, coalesce(n, 0) AS n, CASE WHEN match_type <> 'singles' THEN 'type' WHEN pa = pb THEN 'duplicate_player' WHEN played_at > DATE '2024-06-30' THEN 'future' WHEN played_at < DATE '2020-01-01' THEN 'too_early'
  WHEN coalesce(n, 0) NOT BETWEEN 2 AND 3 THEN 'game_count' WHEN ok < n THEN 'score' WHEN (CASE ws WHEN 'a' THEN won_a ELSE won_b END) <> 2 THEN 'winner_games' WHEN (CASE ws WHEN 'a' THEN last < 0 ELSE last > 0 END) THEN 'last_game' END AS reason
  FROM cm LEFT JOIN agg USING (o_orderkey))"""


def club(spark: SparkSession, d: str) -> DataFrame:
    """Club matches with their games in order."""
    li = driver.table(spark, d, "lineitem").where("l_linenumber <= 3")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = li.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    lo, flip = (c("l_partkey") % 22).cast("int"), c("l_suppkey") % 3 == 0
    game = F.struct(c("l_linenumber").alias("k"), F.when(flip, lo).otherwise(21).alias("a"), F.when(flip, 21).otherwise(lo).alias("b"))
    games = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(game)).alias("games"))
    name = lambda x: F.array(F.concat(F.lit("C"), x.cast("string")))
    o = driver.table(spark, d, "orders").select(
        "o_orderkey", F.when(c("o_orderkey") % 50 == 3, "mixed").otherwise("singles").alias("match_type"), name(c("o_custkey")).alias("side_a"), name(c("o_custkey") + c("o_orderkey") % 40).alias("side_b"),
        F.when(c("o_orderstatus") == "F", "b").otherwise("a").alias("winner_side"), c("o_orderdate").cast("date").alias("played_at"),
    )
    none = F.array().cast("array<struct<k:int,a:int,b:int>>")
    out = o.join(games, c("o_orderkey") == c("l_orderkey"), "left").drop("l_orderkey").withColumn("games", F.coalesce("games", none))
    return out.withColumn("reason", rulebook.match_reason(F.lit("2024-06-30").cast("date")))


@query(CLUB + " SELECT o_orderkey, reason FROM val")
def validate_match(spark, d):
    return club(spark, d).select("o_orderkey", "reason")


@query(CLUB + " SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n, min(o_orderkey) AS first_line FROM val GROUP BY 1")
def csv_quarantine(spark, d):
    """Accepted rows and quarantined ones by reason, with the first line of each."""
    return club(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_line"))


@query(CLUB + " SELECT 'club:' || o_orderkey AS match_uid, played_at AS date, CASE ws WHEN 'a' THEN pa ELSE pb END AS winner, CASE ws WHEN 'a' THEN pb ELSE pa END AS loser, n AS n_sets FROM val WHERE match_type = 'singles'")
def club_match_table(spark, d):
    a, b = c("side_a")[0], c("side_b")[0]
    won = c("winner_side") == "a"
    return club(spark, d).where("match_type = 'singles'").select(F.concat(F.lit("club:"), c("o_orderkey").cast("string")).alias("match_uid"), c("played_at").alias("date"), F.when(won, a).otherwise(b).alias("winner"), F.when(won, b).otherwise(a).alias("loser"), F.size("games").cast("long").alias("n_sets"))


@query(CLUB + " SELECT 'club:' || o_orderkey AS match_uid, row_number() OVER (ORDER BY played_at, 'club:' || o_orderkey) - 1 AS t_idx FROM val WHERE match_type = 'singles'")
def club_timeline(spark, d):
    from tallyfold.operators import timeline

    return timeline.ordered(club_match_table(spark, d), by=("match_uid",)).select("match_uid", "t_idx")


@query(CLUB + " SELECT o_orderkey, c.c_name AS name_a, reason FROM val JOIN customer c ON 'C' || c.c_custkey = pa WHERE reason IS NOT NULL")
def club_revalidate(spark, d):
    """Stored rows that break a rule, with the name of side a."""
    names = driver.table(spark, d, "customer").select(F.concat(F.lit("C"), c("c_custkey").cast("string")).alias("key"), c("c_name").alias("name_a"))
    return club(spark, d).where("reason IS NOT NULL").join(names, c("side_a")[0] == c("key")).select("o_orderkey", "name_a", "reason")
