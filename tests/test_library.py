import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.errors import ContractError, LabelError
from tallyfold.functions import boosting, labels, rulebook
from tallyfold.operators import gates, players, ratings, scoring, timeline
from tallyfold.plans import models, records
from tallyfold.sources import driver, files

SF = "/root/testdata/sf0.001"


def synthetic(spark, n=24):
    """S against P1, P2, P3 in turn on successive days; S loses every tenth match."""
    rows = []
    for i in range(n):
        other = f"P{i % 3 + 1}"
        w, lo = (other, "S") if i % 10 == 9 else ("S", other)
        rows.append((f"syn:{i}", dt.date(2021, 1, 1) + dt.timedelta(days=i), 5, "MS", w, lo, 2))
    return timeline.ordered(spark.createDataFrame(rows, "match_uid string, date date, round_rank int, discipline string, winner string, loser string, n_sets int"))


def test_blake2b_vectors(spark):
    keys = {"7:ss:1": 1, "7:ss:7": 1, "7:ss22:9": 1, "7:bdb:2018-27": 0, "7:syn:0": 0, "7:syn:1": 0, "11:ss:7": 1, "7:club:1": 1}
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", rulebook.blake2b_bit(F.col("k")).alias("b"))
    assert {r.k: r.b for r in df.collect()} == keys


def test_elo_and_log5_goldens(spark):
    t = synthetic(spark)
    first = ratings.elo(t).orderBy("t_idx").first()
    assert (first.elo_w, first.elo_l, first.elo_w_after, first.elo_l_after) == (1500, 1500, 1520, 1480)
    h = players.with_history(players.player_long(t), half_life=1e12).where("player = 'S' AND t_idx = 1").first()
    assert abs(h.rate - 6 / 11) < 1e-9
    h = players.with_history(players.player_long(t), half_life=1.0).where("player = 'S' AND t_idx = 1").first()
    assert abs(h.rate - 5.5 / 10.5) < 1e-12


def test_streak_and_head_to_head(spark):
    t = synthetic(spark)
    h = {r.t_idx: r.streak for r in players.with_history(players.player_long(t)).where("player = 'S'").collect()}
    assert h[0] is None and h[9] == 9 and h[10] == -1 and h[11] == 1
    met = {r.t_idx: r.h2h_lo for r in players.head_to_head(t).collect()}
    assert met[0] == 0 and met[3] == -1 and met[6] == -2


def test_features_do_not_see_the_future(spark):
    t = synthetic(spark)
    full = records.match_feature_rows(t).where("t_idx < 12")
    cut = records.match_feature_rows(t.where("t_idx < 12"))
    assert sorted(map(str, full.collect())) == sorted(map(str, cut.collect()))


def test_features_change_sign_with_sides(spark):
    t = synthetic(spark)
    rows = records.match_feature_rows(t).collect()
    assert {r.y for r in rows} == {0, 1}
    e = {r.match_uid: (r.elo_w, r.elo_l) for r in ratings.elo(t).collect()}
    for r in rows:
        w, lo = e[r.match_uid]
        assert abs(r.elo_diff - (w - lo) * (1 if r.y else -1)) < 1e-9


def test_scores_and_calibration(spark):
    df = spark.createDataFrame([("a", "m1", 0.5, 1), ("a", "m2", 0.9, 1), ("a", "m3", 0.1, 0)], "predictor string, match_uid string, p double, y int")
    assert scoring.summarize(scoring.scores(df)).first().accuracy == pytest.approx(5 / 6)
    df = spark.createDataFrame([("a", 0.05, 0), ("a", 0.15, 1), ("a", 0.55, 1), ("a", 0.95, 1)], "predictor string, p double, y int")
    rows = {r.bucket: r for r in scoring.calibration(df).collect()}
    assert len(rows) == 5 and rows[0].n == 2 and rows[0].rate == 0.5 and rows[4].mean_p == 0.95 and rows[3].n == 0 and rows[3].mean_p is None


@pytest.mark.parametrize("value,want", [(0.05, (0.05, 0.05, 0.0)), (0.0, (0.0, 0.0, 1.0))])
def test_bootstrap_of_constants(spark, value, want):
    df = spark.createDataFrame([(f"m{i}", i, value) for i in range(20)], "match_uid string, t_idx long, diff double")
    r = scoring.bootstrap(df, 100).first()
    assert (r.n, r.lo, r.hi, r.p_value) == (20, pytest.approx(want[0]), pytest.approx(want[1]), want[2])


def test_bootstraps_of_several_contrasts(spark):
    """Each key's figures are those of its own bootstrap."""
    rows = [("a", i, float(np.sin(i))) for i in range(30)] + [("b", 2 * i, i / 10 - 1) for i in range(30)] + [("c", i, 0.5) for i in range(7)]
    df = spark.createDataFrame(rows, "key string, t_idx long, diff double")
    got = {r.key: r for r in scoring.bootstraps(df, 300, block=125).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for k, r in got.items():
        want = scoring.bootstrap(df.where(F.col("key") == k).select(F.lit("m").alias("match_uid"), "t_idx", "diff"), 300).first()
        assert all(r[x] == pytest.approx(want[x]) for x in ("n", "mean_diff", "lo", "hi", "p_value"))


def test_reports_hold_every_contrast_summary_and_calibration(spark, monkeypatch):
    monkeypatch.setattr(models, "fit_boost", lambda x, y, now, columns: 0.5)
    for name, contrasts, predictors in (("p4a_report", models.P4A, "coinflip elo log5 lr xgb"), ("p4b_report", models.P4B, "coinflip elo log5 lr_a lr_b lr_c xgb_a xgb_b xgb_c")):
        rows = getattr(models, name)(spark, SF).collect()
        assert sorted((r.win, r.contrast) for r in rows if r.part == "contrast") == sorted((w, f"{a}-{b}") for w in ("full", "scored") for a, b in contrasts)
        assert sorted((r.win, r.predictor) for r in rows if r.part == "summary") == sorted((w, p) for w in ("full", "scored") for p in predictors.split())
        assert sorted((r.predictor, r.bucket) for r in rows if r.part == "calibration") == sorted((p, k) for p in predictors.split() for k in range(5))
        assert len({r.n for r in rows if r.part != "calibration" and r.win == "full" and r.n}) == 1


def test_bootstrap_of_nothing(spark):
    r = scoring.bootstrap(spark.createDataFrame([], "match_uid string, t_idx long, diff double"), 10).first()
    assert r.n == 0 and r.lo is None


@pytest.mark.parametrize("score,legal", [((21, 19), 1), ((21, 0), 1), ((30, 29), 1), ((30, 28), 1), ((25, 23), 1), ((15, 21), 1), ((22, 20), 1), ((20, 22), 1), ((21, 20), 0), ((31, 5), 0), ((22, 19), 0), ((30, 27), 0), ((19, 3), 0), ((21, 21), 0), ((20, 21), 0)])
def test_legal_scores(spark, score, legal):
    assert spark.range(1).select(rulebook.legal_score(F.lit(score[0]), F.lit(score[1]))).first()[0] == bool(legal)


def test_winner_extraction(spark):
    rows = [(1, 20, 0, 15, "T1P1"), (0, 5, 0, 3, None), (1, 29, 1, 29, None)]
    df = spark.createDataFrame(rows, "a int, b int, x int, y int, want string")
    for r in df.select("want", rulebook.extract_winner(*[F.col(n) for n in "abxy"]).alias("got")).collect():
        assert r.got == r.want


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (2, "bad")], "k int, reason string")
    good, bad = gates.split(df)
    assert good.count() == bad.count() == 1
    with pytest.raises(ContractError, match="bad"):
        gates.strict(df, "rows")
    with pytest.raises(LabelError):
        files.load_label_map(spark, [("a", "g", ["x"]), ("b", "g", ["x"])], [])
    v = gates.timeline_violations(synthetic(spark)).first()
    assert (v.null_dates, v.unranked, v.repeated_idx, v.missing_idx) == (0, 0, 0, 0)


def test_unmapped_label_raises(spark):
    df = spark.createDataFrame([("殺球",), ("未知球種",)], "type string")
    got = sorted(labels.apply_labels(df, labels.dimension(spark)).select("shot_class", "is_unknown").collect(), key=str)
    assert [tuple(r) for r in got] == [("smash", False), (None, True)]
    with pytest.raises(Exception, match="unmapped token"):
        labels.apply_labels(spark.createDataFrame([("nope",)], "type string"), labels.dimension(spark)).collect()


def test_match_and_stroke_files(spark, tmp_path):
    pd.DataFrame([["1", " Alpha + Beta ", "Open", "Finals", "2021.0", "3", "4", "2", "45", "A1", "B", "", ""], ["2", "v2", "Open", "F", "2021", "2", "30", "2", "x", "C", "D", "", ""]], columns=files.MATCH_CSV).to_csv(tmp_path / "match.csv", index=False)
    (tmp_path / "aliases.csv").write_text("# note\nalias,canonical,source_note\nA1,A,x\n")
    m = files.read_match_table(spark, str(tmp_path / "match.csv"), "src", "ss", files.read_aliases(spark, str(tmp_path / "aliases.csv")))
    rows = {r.match_uid: r for r in m.collect()}
    assert rows["ss:1"].winner == "A" and rows["ss:1"].date == dt.date(2021, 3, 4) and rows["ss:1"].n_sets == 2 and rows["ss:1"].reason is None
    assert rows["ss:2"].reason == "bad date"
    good, _ = gates.split(m)
    folder = tmp_path / "set" / " Alpha + Beta "
    os.makedirs(folder)
    stroke = pd.DataFrame([[str(i + 1) if k in ("rally", "ball_round") else "" for k in files.STROKE_CSV] for i in range(3)], columns=files.STROKE_CSV)
    stroke.to_csv(folder / "set1.csv", index=False)
    s = files.read_strokes(spark, str(tmp_path / "set"), good)
    assert s.where("reason IS NULL AND match_uid = 'ss:1' AND set_no = 1").count() == 3
    assert files.set_count_violations(s, good).count() == 1
    stroke[files.STROKE_CSV[::-1]].to_csv(folder / "set2.csv", index=False)
    with pytest.raises(Exception):  # noqa: B017
        files.read_strokes(spark, str(tmp_path / "set"), good).collect()


def test_alias_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("alias,canonical,source_note\nA,B,x\nB,C,x\n")
    with pytest.raises(ContractError):
        files.read_aliases(spark, str(tmp_path / "a.csv"))


def test_point_files(spark, tmp_path):
    def doc(n, last):
        return {f"Point{i}": {"PointInfo": {"T1P1": {"Score": last[0], "Point": last[1], "Status": "", "Location": ""}, "T2P1": {"Score": last[2], "Point": last[3], "Status": "", "Location": ""}}} for i in range(1, n + 1)}

    (tmp_path / "2019-20-1QF-MS-Ann-Bob-Open Cup-1080p.json").write_text(json.dumps(doc(3, (1, 20, 0, 15))))
    (tmp_path / "2019-21-1F-MS-Ann-Cee-Open-1080p-50fps.json").write_text(json.dumps({"Point1": doc(1, (0, 1, 0, 0))["Point1"], "Point3": doc(1, (0, 1, 0, 0))["Point1"]}))
    (tmp_path / "2019-22-1SF-MS-Ann-Dee-Open-1080p.json").write_text(json.dumps(doc(2, (0, 5, 0, 3))))
    (tmp_path / "o.csv").write_text("# c\nmatch_uid,date,winner,week_mismatch_ok,provenance_url,note\nbdb:2019-22,2019-05-28,Dee,false,u,n\n")
    rows = {r.match_uid: r for r in files.read_point_files(spark, str(tmp_path), "pts", "bdb", overrides=files.read_overrides(spark, str(tmp_path / "o.csv"))).collect()}
    assert (rows["bdb:2019-20"].winner, rows["bdb:2019-20"].loser, rows["bdb:2019-20"].n_sets, rows["bdb:2019-20"].date, rows["bdb:2019-20"].date_precision) == ("Ann", "Bob", 2, dt.date(2019, 5, 13), "week")
    assert rows["bdb:2019-21"].reason == "points have gaps"
    assert rows["bdb:2019-22"].winner == "Dee" and rows["bdb:2019-22"].reason is None and rows["bdb:2019-22"].date_precision == "day"


def test_homography_and_audit(spark, tmp_path):
    pd.DataFrame([["1", "v", "[[1,0,0],[0,1,0],[0,0,1]]"], ["2", "w", "[[1,0],[0,1]]"]], columns=["id", "video", "homography_matrix"]).to_csv(tmp_path / "h.csv", index=False)
    assert {r.id: r.reason for r in files.read_homography(spark, str(tmp_path / "h.csv")).collect()} == {"1": None, "2": "matrix is not 3 by 3"}
    assert len(files.audit_tree(str(tmp_path), {".": 2})) == 2
    for run in ("a", "b"):
        (tmp_path / "runs" / run).mkdir(parents=True)
    assert files.latest_run(str(tmp_path / "runs")).endswith("b")


def test_streaming_elo_equals_batch(spark, tmp_path):
    t = records.tl(spark, SF).select("discipline", "match_uid", "t_idx", "winner", "loser")
    n = t.count()
    for k in range(3):
        t.where(F.col("t_idx").between(k * n // 3, (k + 1) * n // 3 - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t.where("t_idx = 0").coalesce(1).withColumn("match_uid", F.lit("again")).write.mode("append").parquet(str(tmp_path / "in"))
    from tallyfold.streaming.ratings import streaming_elo

    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_elo(stream).writeStream.format("memory").queryName("elo_stream").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.match_uid: (r.elo_w, r.elo_l, r.late) for r in spark.table("elo_stream").collect()}
    assert got.pop("again")[2]
    want = {r.match_uid: (r.elo_w, r.elo_l) for r in ratings.elo(records.tl(spark, SF)).collect()}
    assert {k: v[:2] for k, v in got.items()} == want


def test_logistic_refit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    x[::7, 1] = np.nan
    assert models.fit_predict(x, y, np.array([2.0, np.nan, 0.0])) > 0.9 > 0.1 > models.fit_predict(x, y, np.array([-2.0, 0.0, 0.0]))
    assert models.fit_predict(x[:5], y[:5], x[0]) == 0.5
    w = models.logistic(x[:, [0]], y)
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert abs(((p - y) * x[:, 0]).sum() + w[0]) < 1e-6 and abs((p - y).sum()) < 1e-6


@pytest.mark.parametrize(("name", "fit"), [("refit_lr", models.fit_predict), ("refit_boost", models.fit_boost)])
def test_refits_predict_every_match(spark, name, fit):
    rows = sorted(records.match_feature_rows(records.tl(spark, SF)).collect(), key=lambda r: r.t_idx)
    got = {r.t_idx: r for r in getattr(models, name)(spark, SF).collect()}
    assert sorted(got) == [r.t_idx for r in rows]
    x, y = np.array([[r[c] for c in records.FEATURES] for r in rows], dtype=float), np.array([r.y for r in rows], dtype=int)
    for i in (0, 9, 33, len(rows) - 1):
        assert (got[i].match_uid, got[i].y) == (rows[i].match_uid, y[i])
        assert got[i].p == pytest.approx(fit(x[:i], y[:i], x[i]))


def test_refits_shuffle_no_copies_of_rows(spark):
    """Rows travel once: the number of shuffled bytes doesn't grow with the square of the matches."""
    rows = spark.createDataFrame([(f"m{i}", i, i % 3 % 2, float(i % 7)) for i in range(70)], "match_uid string, t_idx long, y int, a double")
    got = models.refit_predictions(rows, ["a"], every=2, fit=lambda x, y, now: len(x) + now[0] / 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted((r.t_idx, r.match_uid, r.y, r.p) for r in got.collect()) == [(i, f"m{i}", i % 3 % 2, i + i % 7 / 10) for i in range(0, 70, 2)]
    assert models.refit_predictions(rows.limit(0), ["a"]).count() == 0


def test_successive_logistic_refits(monkeypatch):
    """Each is that of its own rows, by few passes: also where gaps, columns and their first differences come in on the way."""
    r, n = np.random.default_rng(3), 500
    x = r.normal(size=(n, 6)) * [0.5, 20, 300, 1, 1, 1]
    x[:, 5] = r.integers(0, 2, n)
    early = r.random(n) < np.minimum(0.5, 20 / (1 + np.arange(n)))
    x[early, 1] = x[early, 2] = np.nan
    x[:250, 3], x[300, 3], x[:200, 4] = 0.1, np.nan, np.nan
    y = (r.random(n) < 1 / (1 + np.exp(-x[:, 0] - np.nan_to_num(x[:, 2]) / 200))).astype(int)
    want, passes, alone = [models.fit_predict(x[:i], y[:i], x[i]) for i in range(n)], [], []
    expansion, fit = models._expansion, models.fit_predict
    monkeypatch.setattr(models, "ALONE", 64)
    monkeypatch.setattr(models, "_expansion", lambda *a, **o: passes.append(1) or expansion(*a, **o))
    monkeypatch.setattr(models, "fit_predict", lambda *a: alone.append(1) or fit(*a))
    assert list(models.logistic_walk(x, y, 0, n)) == pytest.approx(want, abs=3e-7)
    for lo, hi in ((70, 71), (195, 206), (248, 256), (299, 303), (480, 500)):
        assert list(models.logistic_walk(x, y, lo, hi)) == pytest.approx(want[lo:hi], abs=3e-7)
    assert len(alone) == 64
    long = r.normal(size=(30_040, 3))
    late, passes[:] = (r.random(30_040) < 1 / (1 + np.exp(-long[:, 0]))).astype(int), []
    assert list(models.logistic_walk(long, late, 30_000, 30_040))[-1] == pytest.approx(fit(long[:-1], late[:-1], long[-1]), abs=3e-7)
    assert len(passes) < 20  # two passes and more for each of the 40 refits otherwise


def test_constant_column_has_no_weight():
    """A gap filled with the only known value leaves a constant column, whatever rounding makes of its deviation."""
    r = np.random.default_rng(5)
    x, y = np.column_stack([r.normal(size=401), np.full(401, np.nan)]), r.integers(0, 2, 401)
    for only in r.normal(size=20):
        x[400, 1] = only
        low, high = (models.fit_predict(x, y, np.array([0.0, v])) for v in (-3.0, 3.0))
        assert low == pytest.approx(high, abs=1e-9)


def test_booster_splits_rows_before_a_drift(monkeypatch):
    """Rows more than 400 places back are told apart although later ones lie elsewhere; the fit has 150 trees."""
    r, n = np.random.default_rng(4), len(records.FEATURES)
    x = np.zeros((1200, n))
    x[:600, 0], x[600:, 0] = r.uniform(-2, -1, 600), r.uniform(5, 6, 600)
    y = np.where(x[:, 0] < 0, x[:, 0] > -1.5, r.random(1200) < 0.5).astype(int)
    now = np.zeros((2, n))
    now[:, 0] = -1.8, -1.2
    sizes, fit = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda *a: sizes.append(a[2].trees) or fit(*a))
    low, high = (models.fit_boost(x, y, row) for row in now)
    assert low < 0.3 < 0.6 < high and sizes == [150, 150]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_booster_equals_splits_by_hand(depth):
    """Sums by joint codes, a level at a time: each split is the best of all edges and sides of gaps over the rows themselves."""
    rng = np.random.default_rng(depth)
    x, y = np.round(rng.normal(size=(300, 5)), 1), rng.integers(0, 2, 300)
    x[:, 3], x[:, 4] = x[:, 3] > 0, 1.0
    x[rng.random(x.shape) < 0.1] = np.nan
    p = boosting.BoostParams(depth=depth, trees=1, rows=1.0, columns=1.0, increasing=(1,))
    passes, count = [], np.bincount

    def grow(rows, left, low, high):
        g, h = (0.5 - y)[rows], np.full(len(rows), 0.25)
        weight = lambda m: np.clip(-g[m].sum() / (h[m].sum() + p.l2), low, high)
        gain = lambda m: -(g[m].sum() * weight(m) + 0.5 * (h[m].sum() + p.l2) * weight(m) ** 2)
        whole, best = np.ones(len(rows), dtype=bool), (1e-9, None)
        for k in range(5 * bool(left)):
            v = x[rows, k]
            for edge in np.unique(v[~np.isnan(v)])[1:]:
                for gaps_left in (True, False)[: 1 + np.isnan(v).any()]:
                    m = np.where(np.isnan(v), gaps_left, v < edge)
                    if min(h[m].sum(), h[~m].sum()) < p.min_hessian or k == 1 and weight(m) > weight(~m):
                        continue
                    if (found := gain(m) + gain(~m) - gain(whole)) > best[0] + 1e-9:
                        best = (found, (k, m, (weight(m) + weight(~m)) / 2))
        if best[1] is None:
            return {int(i): float(weight(whole)) for i in rows}
        k, m, mid = best[1]
        return grow(rows[m], left - 1, low, min(high, mid) if k == 1 else high) | grow(rows[~m], left - 1, max(low, mid) if k == 1 else low, high)

    np.bincount = lambda *a, **o: passes.append(len(a[0])) or count(*a, **o)
    try:
        tree = boosting.boost(x, y, p)[0]
    finally:
        np.bincount = count
    want = grow(np.arange(300), depth, -np.inf, np.inf)
    assert tree.predict(x) == pytest.approx([want[i] for i in range(300)])
    assert sum(passes) <= 2 * 5 * 300 * depth  # two passes over the rows for each group of columns at a level, whatever its number of nodes


def test_booster_is_monotone():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 2)), 1)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    x[::9, 1] = np.nan
    trees = boosting.boost(x, y, boosting.BoostParams(trees=30, increasing=(0,)))
    grid = np.column_stack([np.linspace(-3, 3, 50), np.zeros(50)])
    p = boosting.probability(trees, grid)
    assert (np.diff(p) >= -1e-12).all() and p[-1] > 0.6 > 0.4 > p[0]


def test_components_of_a_chain(spark):
    from tallyfold.session import ensure_checkpoints

    ensure_checkpoints(spark)
    df = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "winner string, loser string")
    got = {r.node: r.label for r in timeline.components(df).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 63
    seeds = spark.createDataFrame([("n005", "MS")], "node string, discipline string")
    assert [r.label for r in gates.component_seeds(timeline.components(df), seeds).collect()] == ["z1"]


def test_command_line(spark, tmp_path):
    from tallyfold import cli

    assert cli.main(["timeline", SF, "--out", str(tmp_path / "t")]) == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == driver.matches(spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_club_import(spark, tmp_path):
    from tallyfold.sources import club

    (tmp_path / "in.csv").write_text('match_type,played_at,side_a,side_b,winner_side,games\nsingles,2024-01-05,Ann Lee,Bob,a,"21-15,21-18"\nsingles,2024-01-06,Ann Lee,Bob,a,"21-20,21-18"\ndoubles,2024-01-07,Ann Lee|Cee,Bob|Dee,b,"21-15,10-21,19-21"\nsingles,soon,Ann,Bob,a,"21-1,21-2"\nsingles,2024-01-05,ann  lee,Ann Lee,a,"21-1,21-2"\n')
    got = club.import_csv(spark, str(tmp_path / "in.csv"), F.lit("2024-06-30").cast("date"))
    assert sorted(r.line_no for r in got.accepted.collect()) == [2, 4]
    assert {r.line_no: r.reason for r in got.quarantined.collect()} == {3: "score", 5: "date", 6: "duplicate_player"}
    assert {r.name for r in got.players.collect()} == {"Ann Lee", "Bob", "Cee", "Dee"}
    assert club.match_table(got.accepted).first().winner == "Ann Lee"
    assert got.accepted.select(F.explode("games")).count() == 5
    roster = spark.createDataFrame([("ann leee", "Ann Leee")], "key string, name string")
    assert [r.key for r in club.near_twins(got.players, roster).collect()] == ["ann lee"]
