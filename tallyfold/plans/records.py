"""Queries over match records: timeline, windows, ratings, walk-forward evaluation."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import rulebook
from tallyfold.operators import players, ratings, scoring, timeline
from tallyfold.plans.sql import ELO, M, P, PRED, RATE, SIDES, T, r6
from tallyfold.session import ensure_checkpoints
from tallyfold.sources import driver

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, recursive: bool = False):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = f"WITH {'RECURSIVE ' * recursive}{sql}" if not sql.startswith("SELECT") else sql
        return f

    return add


def rnd(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def tl(spark: SparkSession, d: str) -> DataFrame:
    return timeline.ordered(driver.matches(spark, d))


def pl(spark: SparkSession, d: str) -> DataFrame:
    return players.player_long(tl(spark, d))


def with_sides(t: DataFrame, seed: int = 7) -> DataFrame:
    bit = rulebook.md5_bit(F.concat(F.lit(f"{seed}:"), c("match_uid")))
    return t.withColumn("y", bit).withColumn("side0", F.when(c("y") == 1, c("winner")).otherwise(c("loser"))).withColumn("side1", F.when(c("y") == 1, c("loser")).otherwise(c("winner")))


def predictions(t: DataFrame) -> DataFrame:
    """match_uid, t_idx, y, predictor, p, scored of the three baselines."""
    h = players.with_history(players.player_long(t)).select("match_uid", "player", "rate", "n_prior")
    s = with_sides(t).select("match_uid", "t_idx", "y", "side0", "side1")
    s = players.by_side(s, h, ["rate", "n_prior"])
    e = ratings.elo(t).select("match_uid", "elo_w", "elo_l")
    s = s.join(e, "match_uid")
    own, other = F.when(c("y") == 1, c("elo_w")).otherwise(c("elo_l")), F.when(c("y") == 1, c("elo_l")).otherwise(c("elo_w"))
    each = [("coinflip", F.lit(0.5)), ("elo", ratings.expectation(own, other)), ("log5", ratings.log5(c("rate0"), c("rate1")))]
    ps = F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), p.alias("p")) for n, p in each]))
    return s.select("match_uid", "t_idx", "y", ((c("n_prior0") >= 3) & (c("n_prior1") >= 3)).alias("scored"), ps.alias("x")).select("match_uid", "t_idx", "y", "scored", "x.*")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scores(predictions(tl(spark, d)))


@query(T + " SELECT t_idx, match_uid, date, round_rank, discipline, winner, loser, n_sets FROM t", name="timeline")
def q_timeline(spark, d):
    return tl(spark, d).select("t_idx", "match_uid", "date", "round_rank", "discipline", "winner", "loser", c("n_sets").cast("long").alias("n_sets"))


@query(T + " SELECT t_idx, match_uid FROM t ORDER BY t_idx DESC LIMIT 10")
def timeline_tail(spark, d):
    return tl(spark, d).select("t_idx", "match_uid").orderBy(F.desc("t_idx")).limit(10)


@query(T + " SELECT sha256(string_agg(match_uid || '|' || date || '|' || winner || '|' || loser, '' ORDER BY t_idx)) AS digest FROM t")
def timeline_hash(spark, d):
    """One ordered digest: it is of one string by definition, so its rows meet in one task."""
    row = F.concat_ws("|", "match_uid", c("date").cast("string"), "winner", "loser")
    return tl(spark, d).withColumn("row", row).selectExpr("sha2(listagg(row, '') WITHIN GROUP (ORDER BY t_idx), 256) AS digest")


@query(T + " SELECT match_uid, row_number() OVER (ORDER BY date, round_rank, match_uid) - 1 AS t_idx FROM t WHERE discipline <> 'WS'")
def elite_timeline(spark, d):
    return timeline.ordered(tl(spark, d).where("discipline <> 'WS'").drop("t_idx", "place")).select("match_uid", "t_idx")


@query(P + " SELECT match_uid, player, row_number() OVER (PARTITION BY player ORDER BY t_idx) - 1 AS n_prior FROM pl")
def prior_counts(spark, d):
    return pl(spark, d).select("match_uid", "player", (F.row_number().over(players.by_player()) - 1).cast("long").alias("n_prior"))


@query(P + " SELECT match_uid, player, date_diff('day', lag(date) OVER (PARTITION BY player ORDER BY t_idx), date) AS days_off FROM pl")
def days_since_last(spark, d):
    return players.with_history(pl(spark, d)).select("match_uid", "player", c("days_off").cast("long").alias("days_off"))


FORM = "CASE WHEN count(*) OVER w{0} > 0 THEN (sum(won) OVER w{0} + 2.0) / (count(*) OVER w{0} + 4) END"


@query(P + f" SELECT match_uid, player, {r6(FORM.format(5))} AS form5, {r6(FORM.format(10))} AS form10 FROM pl WINDOW w5 AS (PARTITION BY player ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY player ORDER BY t_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def form_rates(spark, d):
    return players.with_history(pl(spark, d)).select("match_uid", "player", rnd(c("form5")).alias("form5"), rnd(c("form10")).alias("form10"))


STREAK = """st AS (SELECT match_uid, player, lag(run) OVER (PARTITION BY player ORDER BY t_idx) AS streak FROM (
  SELECT *, (CASE WHEN won = 1 THEN 1 ELSE -1 END) * row_number() OVER (PARTITION BY player, won, a - b ORDER BY t_idx) AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY player ORDER BY t_idx) AS a, row_number() OVER (PARTITION BY player, won ORDER BY t_idx) AS b FROM pl)))"""


@query(P + ", " + STREAK + " SELECT * FROM st")
def streaks(spark, d):
    return players.with_history(pl(spark, d)).select("match_uid", "player", c("streak").cast("long").alias("streak"))


SHARE = "(sum(CASE WHEN won = 1 THEN 2 ELSE n_sets - 2 END) OVER w + 2.0) / (sum(n_sets) OVER w + 4)"


@query(P + f" SELECT match_uid, player, {r6(SHARE)} AS game_share FROM pl WINDOW w AS (PARTITION BY player ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def game_share(spark, d):
    return players.with_history(pl(spark, d)).select("match_uid", "player", rnd(c("game_share")).alias("game_share"))


H2H = "h2h AS (SELECT match_uid, coalesce(sum(CASE WHEN winner < loser THEN 1 ELSE -1 END) OVER (PARTITION BY least(winner, loser), greatest(winner, loser) ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS h2h_lo FROM t)"


@query(T + ", " + H2H + " SELECT * FROM h2h")
def h2h(spark, d):
    return players.head_to_head(tl(spark, d)).select("match_uid", c("h2h_lo").cast("long").alias("h2h_lo"))


@query(P + f" SELECT a.match_uid, a.player, max(b.t_idx) AS last_idx, count(b.t_idx) AS n_prior, coalesce(sum(b.won), 0)::BIGINT AS wins FROM pl a LEFT JOIN pl b ON a.player = b.player AND b.t_idx < a.t_idx GROUP BY ALL")
def asof_state(spark, d):
    prior = players.prior()
    return pl(spark, d).select("match_uid", "player", F.max("t_idx").over(prior).alias("last_idx"), F.count("*").over(prior).alias("n_prior"), F.coalesce(F.sum("won").over(prior), F.lit(0)).cast("long").alias("wins"))


@query(P + ", " + RATE + f" SELECT match_uid, player, {r6('r')} AS rate FROM rate")
def log5_walk(spark, d):
    return players.with_history(pl(spark, d)).select("match_uid", "player", rnd(c("rate")).alias("rate"))


@query(P + ", " + ELO + f" SELECT match_uid, {r6('elo_w')} AS elo_w, {r6('elo_l')} AS elo_l FROM elo", recursive=True)
def elo_walk(spark, d):
    return ratings.elo(tl(spark, d)).select("match_uid", rnd(c("elo_w")).alias("elo_w"), rnd(c("elo_l")).alias("elo_l"))


OPPQ = """oq AS (SELECT pl.match_uid, player, avg(CASE WHEN won = 1 THEN elo_l ELSE elo_w END) OVER (PARTITION BY player ORDER BY pl.t_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS opp_quality FROM pl JOIN elo USING (match_uid))"""


def opponent_quality(t: DataFrame, e: DataFrame) -> DataFrame:
    """The rows of both players with their own rating and the mean rating of the last ten opponents."""
    rows = players.player_long(t).join(e.select("match_uid", "elo_w", "elo_l"), "match_uid")
    own, opp = F.when(c("won") == 1, c("elo_w")).otherwise(c("elo_l")), F.when(c("won") == 1, c("elo_l")).otherwise(c("elo_w"))
    return rows.withColumn("elo", own).withColumn("opp_quality", F.avg(opp).over(players.last(10))).drop("elo_w", "elo_l")


@query(P + ", " + ELO + ", " + OPPQ + f" SELECT match_uid, player, {r6('opp_quality')} AS opp_quality FROM oq", recursive=True)
def opp_quality(spark, d):
    t = tl(spark, d)
    return opponent_quality(t, ratings.elo(t)).select("match_uid", "player", rnd(c("opp_quality")).alias("opp_quality"))


DIFFS = [("n_prior", "n_matches_diff"), ("days_off", "days_since_last_diff"), ("form5", "winrate5_diff"), ("form10", "winrate10_diff"), ("streak", "streak_diff"), ("game_share", "game_win_share_diff"), ("opp_quality", "opp_quality_diff"), ("elo", "elo_diff")]
FEATURES = [n for _, n in DIFFS] + ["log5_logit", "h2h_net_wins", "round_rank", "is_ws"]


def match_feature_rows(t: DataFrame, bit: int | None = None) -> DataFrame:
    """The twelve record features of each match, side 0 less side 1; all from before the match."""
    h = players.with_history(opponent_quality(t, ratings.elo(t)))
    cols = [n for n, _ in DIFFS] + ["rate"]
    h = h.select("match_uid", "player", *cols)
    s = with_sides(t).join(players.head_to_head(t).select("match_uid", "h2h_lo"), "match_uid")
    s = players.by_side(s, h, cols)
    p = ratings.log5(c("rate0"), c("rate1"))
    return s.select(
        "match_uid", "t_idx", "y", *[(c(f"{n}0") - c(f"{n}1")).cast("double").alias(out) for n, out in DIFFS], F.ln(p / (1 - p)).alias("log5_logit"),
        (c("h2h_lo") * F.when(c("side0") < c("side1"), 1).otherwise(-1)).cast("double").alias("h2h_net_wins"), c("round_rank").cast("double").alias("round_rank"), (c("discipline") == "WS").cast("double").alias("is_ws"),
    )


HIST = f"""hist AS (SELECT pl.match_uid, pl.player, (row_number() OVER o - 1)::DOUBLE AS n_prior, date_diff('day', lag(date) OVER o, date)::DOUBLE AS days_off, {FORM.format(5)} AS form5, {FORM.format(10)} AS form10,
    {SHARE} AS game_share, CASE WHEN won = 1 THEN elo_w ELSE elo_l END AS elo FROM pl JOIN elo USING (match_uid)
  WINDOW o AS (PARTITION BY player ORDER BY t_idx), w AS (PARTITION BY player ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    w5 AS (PARTITION BY player ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY player ORDER BY t_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
full_h AS (SELECT hist.*, streak::DOUBLE AS streak, opp_quality, r FROM hist JOIN st USING (match_uid, player) JOIN oq USING (match_uid, player) JOIN rate USING (match_uid, player))"""
FEATS = ", ".join([P, SIDES, RATE, ELO, OPPQ, STREAK, H2H, HIST]) + """, feats AS (SELECT s.match_uid, s.t_idx, s.y, """ + ", ".join(f"a.{n} - b.{n} AS {out}" for n, out in DIFFS) + """,
  ln(a.r * (1 - b.r) / (b.r * (1 - a.r))) AS log5_logit, (h2h_lo * CASE WHEN side0 < side1 THEN 1 ELSE -1 END)::DOUBLE AS h2h_net_wins, round_rank::DOUBLE AS round_rank, CASE WHEN discipline = 'WS' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_ws
  FROM sides s JOIN full_h a ON a.match_uid = s.match_uid AND a.player = side0 JOIN full_h b ON b.match_uid = s.match_uid AND b.player = side1 JOIN h2h ON h2h.match_uid = s.match_uid)"""


@query(FEATS + " SELECT match_uid, y::BIGINT AS y, " + ", ".join(f"{r6(n)} AS {n}" for n in FEATURES) + " FROM feats", recursive=True)
def match_features(spark, d):
    return match_feature_rows(tl(spark, d)).select("match_uid", c("y").cast("long").alias("y"), *[rnd(c(n)).alias(n) for n in FEATURES])


@query(", ".join([T, SIDES]) + " SELECT match_uid, side0, side1, y::BIGINT AS y FROM sides")
def assign_sides_md5(spark, d):
    return with_sides(tl(spark, d)).select("match_uid", "side0", "side1", c("y").cast("long").alias("y"))


@query()
def assign_sides_blake2b(spark, d):
    t = driver.matches(spark, d)
    return t.select("match_uid", rulebook.blake2b_bit(F.concat(F.lit("7:"), c("match_uid"))).alias("y"))


SC = P + ", " + PRED


@query(SC + " SELECT match_uid, predictor, " + r6("p") + " AS p FROM pred", recursive=True)
def baseline_predictions(spark, d):
    return predictions(tl(spark, d)).select("match_uid", "predictor", rnd(c("p")).alias("p"))


@query(SC + f" SELECT match_uid, predictor, {r6('brier')} AS brier, {r6('log_loss')} AS log_loss FROM sc", name="scores", recursive=True)
def q_scores(spark, d):
    return scored(spark, d).select("match_uid", "predictor", rnd(c("brier")).alias("brier"), rnd(c("log_loss")).alias("log_loss"))


@query(SC + f" SELECT t_idx, match_uid, predictor, y::BIGINT AS y, scored, {r6('p')} AS p, {r6('brier')} AS brier, {r6('log_loss')} AS log_loss FROM sc", recursive=True)
def walk_forward(spark, d):
    return scored(spark, d).select("t_idx", "match_uid", "predictor", c("y").cast("long").alias("y"), "scored", *[rnd(c(n)).alias(n) for n in ("p", "brier", "log_loss")])


ACC = "avg(CASE WHEN p = 0.5 THEN 0.5 WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)"
SUMM = f"count(*) AS n, {r6('avg(brier)')} AS brier, {r6('avg(log_loss)')} AS log_loss, {r6(ACC)} AS accuracy"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[rnd(c(n)).alias(n) if n in cols else c(n) for n in df.columns])


@query(SC + f" SELECT predictor, {SUMM} FROM sc GROUP BY predictor", recursive=True)
def summarize(spark, d):
    return _rounded(scoring.summarize(scored(spark, d)), "brier", "log_loss", "accuracy")


@query(SC + f" SELECT {SUMM} FROM sc WHERE predictor = 'coinflip'", recursive=True)
def coinflip(spark, d):
    return _rounded(scoring.summarize(scored(spark, d).where("predictor = 'coinflip'")).drop("predictor"), "brier", "log_loss", "accuracy")


def windows(df: DataFrame) -> DataFrame:
    """Every row in the full window, and those of players with enough history in the scored one too."""
    return df.withColumn("win", F.explode(F.when(c("scored"), F.array(F.lit("full"), F.lit("scored"))).otherwise(F.array(F.lit("full")))))


@query(SC + f" SELECT win, predictor, {SUMM} FROM (SELECT *, 'full' AS win FROM sc UNION ALL SELECT *, 'scored' FROM sc WHERE scored) GROUP BY win, predictor", recursive=True)
def report_windows(spark, d):
    return _rounded(scoring.summarize(windows(scored(spark, d)), "win", "predictor"), "brier", "log_loss", "accuracy")


CALIB = """cal AS (SELECT predictor, (CASE WHEN p >= 0.8 THEN 4 WHEN p >= 0.6000000000000001 THEN 3 WHEN p >= 0.4 THEN 2 WHEN p >= 0.2 THEN 1 ELSE 0 END) AS bucket, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM sc GROUP BY ALL),
every AS (SELECT DISTINCT predictor, b AS bucket FROM sc, (SELECT unnest([0, 1, 2, 3, 4]) AS b))"""


@query(SC + ", " + CALIB + f" SELECT predictor, bucket::BIGINT AS bucket, coalesce(n, 0) AS n, {r6('mean_p')} AS mean_p, {r6('rate')} AS rate FROM every LEFT JOIN cal USING (predictor, bucket)", name="calibration", recursive=True)
def q_calibration(spark, d):
    return _rounded(scoring.calibration(scored(spark, d)).withColumn("bucket", c("bucket").cast("long")), "mean_p", "rate")


@query(SC + f" SELECT match_uid, {', '.join(r6(f'''avg(brier) FILTER (predictor = '{x}')''') + f' AS {x}' for x in ('coinflip', 'elo', 'log5'))} FROM sc GROUP BY 1", recursive=True)
def brier_pivot(spark, d):
    wide = scored(spark, d).groupBy("match_uid").pivot("predictor", ["coinflip", "elo", "log5"]).avg("brier")
    return _rounded(wide, "coinflip", "elo", "log5")


PAIR = "df AS (SELECT match_uid, a.t_idx, a.brier - b.brier AS diff FROM sc a JOIN sc b USING (match_uid) WHERE a.predictor = 'log5' AND b.predictor = 'elo')"


@query(SC + ", " + PAIR + f" SELECT match_uid, {r6('diff')} AS diff FROM df", recursive=True)
def paired_diff(spark, d):
    return scoring.paired(scored(spark, d), "log5", "elo").select("match_uid", rnd(c("diff")).alias("diff"))


BOOT = """rk AS (SELECT diff, row_number() OVER (ORDER BY t_idx) - 1 AS i FROM df), nn AS (SELECT count(*) AS n, avg(diff) AS mean_diff FROM rk),
mean AS (SELECT b, avg(diff) AS m FROM (SELECT b, ('0x' || substr(md5('7:' || b || ':' || k), 1, 8))::BIGINT % n AS i FROM nn, range(10000) x(b), range(n) z(k)) JOIN rk USING (i) GROUP BY b)"""


@query(SC + ", " + PAIR + ", " + BOOT + f" SELECT n, {r6('mean_diff')} AS mean_diff, {r6('quantile_cont(m, 0.025)')} AS lo, {r6('quantile_cont(m, 0.975)')} AS hi, {r6('least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END)))')} AS p_value FROM mean, nn GROUP BY n, mean_diff", recursive=True)
def bootstrap_md5(spark, d):
    out = scoring.bootstrap(scoring.paired(scored(spark, d), "log5", "elo"), 10_000)
    return out.select("n", *[rnd(c(x)).alias(x) for x in ("mean_diff", "lo", "hi", "p_value")])


@query(SC + f" SELECT predictor, {SUMM} FROM sc WHERE scored GROUP BY predictor", recursive=True)
def report_run(spark, d):
    """The report of a stored run: the log is written, read again and summarised over its scored rows."""
    from tallyfold.session import written

    log = written(spark, scored(spark, d))
    return _rounded(scoring.summarize(log.where("scored")), "brier", "log_loss", "accuracy")


@query(T + " SELECT t_idx AS k, row_number() OVER (ORDER BY t_idx) - 1 AS n FROM t")
def expanding_train(spark, d):
    """Sizes of the training sets of a refit before each match; a size is an index, so no join is needed."""
    return tl(spark, d).select(c("t_idx").alias("k"), c("t_idx").alias("n"))


# sources, duplicates and gates

SOURCES = M + ", src AS (SELECT *, 'main' AS source FROM m UNION ALL SELECT mid, 'x:' || mid, date, round_rank, discipline, CASE WHEN mid % 30 = 0 THEN loser ELSE winner END, CASE WHEN mid % 30 = 0 THEN winner ELSE loser END, n_sets, 'copy' FROM m WHERE mid % 10 = 0)"
PRIORITY = {"main": 0, "copy": 1}


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The matches and a second, lower source: every tenth again, a third of those with the other winner."""
    m = driver.matches(spark, d).withColumn("source", F.lit("main"))
    swap = c("mid") % 30 == 0
    again = m.where("mid % 10 = 0").select("mid", F.concat(F.lit("x:"), c("mid").cast("string")).alias("match_uid"), "date", "round_rank", "discipline", F.when(swap, c("loser")).otherwise(c("winner")).alias("winner"), F.when(swap, c("winner")).otherwise(c("loser")).alias("loser"), "n_sets", F.lit("copy").alias("source"))
    return m.unionByName(again)


@query(SOURCES + " SELECT source, count(*) AS n FROM src GROUP BY 1")
def union_sources(spark, d):
    return sources(spark, d).groupBy("source").agg(F.count("*").alias("n"))


PAIRS = ", pr AS (SELECT *, least(winner, loser) AS p_lo, greatest(winner, loser) AS p_hi, CASE source WHEN 'main' THEN 0 ELSE 1 END AS priority FROM src)"


@query(SOURCES + PAIRS + " SELECT p_lo, p_hi, date FROM pr GROUP BY ALL HAVING count(DISTINCT winner) > 1")
def dedup_conflict(spark, d):
    return timeline.conflicts(sources(spark, d), PRIORITY).select("p_lo", "p_hi", "date")


KEPT = PAIRS + ", kp AS (SELECT *, first_value(match_uid) OVER (PARTITION BY p_lo, p_hi, date ORDER BY priority, match_uid) AS kept_match_uid FROM pr)"


@query(SOURCES + KEPT + " SELECT match_uid, source FROM kp WHERE match_uid = kept_match_uid")
def dedup_unique(spark, d):
    return timeline.dedup(sources(spark, d), PRIORITY).where("match_uid = kept_match_uid").select("match_uid", "source")


@query(SOURCES + KEPT + " SELECT match_uid, kept_match_uid FROM kp WHERE match_uid <> kept_match_uid")
def dedup_dropped(spark, d):
    return timeline.dedup(sources(spark, d), PRIORITY).where("match_uid <> kept_match_uid").select("match_uid", "kept_match_uid")


@query(M + " SELECT * FROM (SELECT match_uid, lag(match_uid) OVER w AS prev_uid, date_diff('day', lag(date) OVER w, date) AS gap_days FROM m WINDOW w AS (PARTITION BY least(winner, loser), greatest(winner, loser) ORDER BY date, match_uid)) WHERE gap_days BETWEEN 1 AND 3")
def near_miss(spark, d):
    return timeline.near_misses(driver.matches(spark, d)).select("match_uid", "prev_uid", c("gap_days").cast("long").alias("gap_days"))


REACH = M + """, e AS (SELECT DISTINCT winner AS a, loser AS b FROM m UNION SELECT DISTINCT loser, winner FROM m), reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), comp AS (SELECT a AS node, min(b) AS label FROM reach GROUP BY 1)"""


@query(REACH + " SELECT node, label FROM comp", recursive=True)
def components(spark, d):
    ensure_checkpoints(spark)
    return timeline.components(driver.matches(spark, d))


@query(REACH + " SELECT label, count(*) FILTER (node IN ('P3', 'P20')) AS n_seeds FROM comp GROUP BY 1", recursive=True)
def seed_hits(spark, d):
    ensure_checkpoints(spark)
    return timeline.components(driver.matches(spark, d)).groupBy("label").agg(F.count_if(c("node").isin("P3", "P20")).alias("n_seeds"))


@query(SOURCES + PAIRS + " SELECT a.match_uid FROM pr a WHERE EXISTS (SELECT 1 FROM pr b WHERE a.p_lo = b.p_lo AND a.p_hi = b.p_hi AND a.date = b.date AND a.match_uid <> b.match_uid)")
def sameday_rematch(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_lo", "p_hi", "date")
    return sources(spark, d).select("match_uid", "date", *timeline.pair()).withColumn("n", F.count("*").over(w)).where("n > 1").select("match_uid")


@query(M + " SELECT match_uid, CASE round_rank WHEN 1 THEN 'R32' WHEN 2 THEN 'R16' WHEN 3 THEN 'QF' WHEN 4 THEN 'SF' ELSE 'Finals' END AS round_name, round_rank::BIGINT AS round_rank FROM m")
def round_rank(spark, d):
    names = F.get(F.array(*[F.lit(x) for x in ("R32", "R16", "QF", "SF", "Finals")]), c("round_rank") - 1)
    return driver.matches(spark, d).select("match_uid", names.alias("round_name"), rulebook.round_rank(names).cast("long").alias("round_rank"))


@query(M + " SELECT match_uid, 'N' || winner[2:] AS w FROM m WHERE winner IN ('P1', 'P2') UNION ALL SELECT match_uid, winner FROM m WHERE winner NOT IN ('P1', 'P2')")
def alias_resolve(spark, d):
    aliases = spark.createDataFrame([("P1", "N1"), ("P2", "N2")], "alias string, canonical string")
    return driver.matches(spark, d).join(F.broadcast(aliases), c("winner") == c("alias"), "left").select("match_uid", F.coalesce("canonical", "winner").alias("w"))
