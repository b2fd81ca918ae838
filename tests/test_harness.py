"""Predictors, configurations, runs, archives, the club's store, and what must not leak."""

import dataclasses
import datetime as dt
import json
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from tallyfold import cli
from tallyfold.errors import ConfigError, ContractError, LabelError
from tallyfold.functions import config, rulebook
from tallyfold.operators import gates, harness, scoring, strokes
from tallyfold.plans import records
from tallyfold.plans import strokes as stroke_plans
from tallyfold.sources import archive, club, driver, files

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tl(spark):
    return records.tl(spark, SF).checkpoint()


def today():
    return F.lit("2024-06-30").cast("date")


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_no_column_of_the_pre_outcome_view_tells_the_winner(spark, tl):
    view = stroke_plans.pre_outcome_view(spark, SF)
    assert not set(view.columns) & {*strokes.OUTCOME_COLUMNS, "winner", "loser", "y"}
    # the winner's strokes are side0's in about half of the matches, and so are the first strokes
    sides = records.with_sides(tl).select("match_uid", "y")
    share = sides.agg(F.avg("y")).first()[0]
    assert 0.3 < share < 0.7
    rows = view.join(sides, "match_uid").groupBy("side").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    assert {r.side for r in rows} == {"side0", "side1"} and all(abs(r.y - share) < 0.1 for r in rows)
    docs = stroke_plans.event_documents(spark, SF)
    same = strokes.shots_of(docs).where("(striker = 'side0') = (winner_side = 'side0')").count() / strokes.shots_of(docs).count()
    assert 0.35 < same < 0.65


def test_views_raise_on_unknown_players(spark, tl):
    s = driver.strokes(spark, SF).limit(5).withColumn("player", F.lit("C"))
    for view in (strokes.pre_outcome(s, records.with_sides(tl)), strokes.historical(s, tl)):
        with pytest.raises(Exception, match="neither A nor B"):
            view.collect()


def test_event_documents_hold_the_contract(spark):
    docs = stroke_plans.event_documents(spark, SF)
    d = docs.first()
    assert docs.columns == ["schema_version", "match_uid", "date", "discipline", "side0_player", "side1_player", "rallies", "outcome"]
    assert [r.rally_idx for r in d.rallies] == list(range(len(d.rallies))) and all([s.shot_idx for s in r.shots] == list(range(len(r.shots))) for r in d.rallies)
    shots = strokes.shots_of(docs)
    assert shots.where("striker_xy IS NULL").count() > 0 and shots.where("size(striker_xy) = 2").count() > 0


def test_one_to_one(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int"), spark.createDataFrame([("x", 3), ("y", 4)], "k string, b int")
    assert sorted(map(tuple, gates.one_to_one(a, b, "k").collect())) == [("x", 1, 3), ("y", 2, 4)]
    for left, right in ((a.union(a), b), (a, b.limit(1)), (a.where("k = 'x'"), b)):
        with pytest.raises(Exception, match="one to one"):
            gates.one_to_one(left, right, "k").collect()


def test_names_fold_fully(spark):
    names = ["Straße", "STRASSE", "a  b\x1fc ", "ΑΣ", "ας", "İx", "ﬁn", "Ann  LEE", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(rulebook.normalize_name(F.col("n")).alias("n"))
    assert [r.n for r in df.collect()] == [" ".join(n.split()).casefold() for n in names]


def test_the_rule_of_the_last_point(spark):
    points = [(a, b) for a in range(32) for b in range(32)]
    df = spark.createDataFrame(points, "a int, b int").select("a", "b", rulebook.would_win_game(F.col("a"), F.col("b")).alias("w"))
    for r in df.collect():
        n = r.a + 1
        assert r.w == ((n == 30 and r.b == 29) or (21 <= n <= 30 and n - r.b >= 2)), (r.a, r.b)


def test_bootstrap_by_arrays_and_by_joins(spark):
    rng = np.random.default_rng(3)
    diffs = spark.createDataFrame([(3 * i, float(x)) for i, x in enumerate(rng.normal(0.02, 0.2, 150))], "t_idx long, diff double")
    one, two = scoring.bootstrap(diffs, 300).first(), scoring.bootstrap(diffs, 300, held=10).first()
    assert one.n == two.n == 150 and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in ("mean_diff", "lo", "hi", "p_value"))


# predictors and runs


class Fixed:
    def __init__(self, name, p):
        self.name, self.p = name, p

    def predict(self, walk):
        return walk.rows.select("match_uid", F.lit(self.p).alias("p"))


def test_walk_forward_equals_the_registered_predictions(spark, tl):
    log = harness.walk_forward(tl, harness.make_predictors(["elo", "coinflip", "log5"]), coin=rulebook.md5_bit)
    got = {(r.match_uid, r.predictor): (round(r.p, 9), r.y, r.scored) for r in log.collect()}
    want = {(r.match_uid, r.predictor): (round(r.p, 9), r.y, r.scored) for r in records.predictions(tl).collect()}
    assert got == want


def test_walk_forward_does_not_see_the_future(spark, tl):
    """Later matches, and the outcome of the match itself, change no probability."""
    names = ["elo", "log5"]
    full = {(r.match_uid, r.predictor): r.p for r in harness.walk_forward(tl, harness.make_predictors(names)).where("t_idx < 40").collect()}
    short = {(r.match_uid, r.predictor): r.p for r in harness.walk_forward(tl.where("t_idx < 40"), harness.make_predictors(names)).collect()}
    assert full.keys() == short.keys() and all(full[k] == pytest.approx(short[k], abs=1e-9) for k in full)


def test_gates_of_predictors(spark, tl):
    with pytest.raises(ContractError, match="unknown predictors"):
        harness.make_predictors(["elo", "oracle"])
    with pytest.raises(ContractError, match="different names"):
        harness.walk_forward(tl, [Fixed("a", 0.4), Fixed("a", 0.5)])
    with pytest.raises(ContractError, match="one order"):
        harness.walk_forward(tl.where("t_idx <> 3"), [Fixed("a", 0.4)])
    for p in (0.0, 1.0, float("nan"), None):
        with pytest.raises(Exception, match="bold gave"):
            harness.walk_forward(tl, [Fixed("bold", p)]).collect()
    harness.register("fixed", lambda: Fixed("fixed", 0.6))
    try:
        assert harness.make_predictors(["fixed"])[0].p == 0.6
        with pytest.raises(ContractError, match="registered already"):
            harness.register("fixed", lambda: Fixed("fixed", 0.6))
    finally:
        del harness.PREDICTORS["fixed"]


def test_configurations(tmp_path):
    good = json.loads(json.dumps(dataclasses.asdict(config.Harness(version="h2", seed=11))))
    path = tmp_path / "h.yaml"
    path.write_text(yaml.safe_dump(good))
    got = config.load(str(path), config.Harness)
    assert got == config.Harness(version="h2", seed=11) and got.elo.params().k_new == 40.0
    models = dataclasses.asdict(config.Models())
    (tmp_path / "m.json").write_text(json.dumps(models))
    assert config.load(str(tmp_path / "m.json"), config.Models) == config.Models()
    assert config.Models().xgb.params((1,)).trees == 150
    assert config._typed(config.Experiment, json.loads(json.dumps(dataclasses.asdict(config.Experiment()))), "") == config.Experiment()
    for change in ({"seed": "7"}, {"seed": True}, {"elo": 3}, {"elo": {"initial": 1.0}}, {"bootstrap": {"n_boot": 1.5, "seed": 1}}):
        path.write_text(yaml.safe_dump(good | change))
        with pytest.raises(ConfigError):
            config.load(str(path), config.Harness)
    for text in ("- 1", ": : :", "{"):
        path.write_text(text)
        with pytest.raises(ConfigError):
            config.load(str(path), config.Harness)
    with pytest.raises(ConfigError):
        config.load(str(tmp_path / "none.yaml"), config.Harness)


def test_runs_are_stored_and_reported(spark, tl, tmp_path, capsys):
    runs = str(tmp_path / "runs")
    assert cli.main(["run", SF, "--runs", runs, "--predictors", "coinflip,elo"]) == 0
    log, manifest = files.read_run(spark, files.latest_run(runs))
    n = tl.count()
    assert log.count() == 2 * n and manifest["n_matches"] == n and manifest["predictors"] == ["coinflip", "elo"]
    assert manifest["timeline_digest"] == harness.timeline_digest(tl) != harness.timeline_digest(tl.withColumn("winner", F.lit("x")))
    report = json.load(open(f"{files.latest_run(runs)}/report.json"))
    assert [x["predictor"] for x in report["windows"]["full"]] == ["coinflip", "elo"] and report["windows"]["full"][0]["brier"] == 0.25
    assert sum(b["n"] for b in report["calibration"]["elo"]) == log.where("scored AND predictor = 'elo'").count()
    capsys.readouterr()
    assert cli.main(["report", "--runs", runs]) == 0
    assert json.loads(capsys.readouterr().out.split("\n", 1)[1]) == report
    assert cli.main(["run", SF, "--runs", runs, "--predictors", "oracle"]) == 1 and "unknown predictors" in capsys.readouterr().err
    assert cli.main(["report", "--runs", str(tmp_path / "nothing")]) == 1
    with pytest.raises(Exception):  # noqa: B017  a run is never written over
        files.write_run(log, files.latest_run(runs), manifest)


# archives


def make_archives(root):
    """Two match tables and a point file below root; the second table repeats a match of the first."""
    (root / "layout.yaml").write_text(yaml.safe_dump({"points": ["points", "bdb", "raw/points"], "seeds": [["Ann", "MS"], ["Uma", "WS"]]}))
    layout = archive.read_layout(str(root))
    assert layout == archive.Layout(str(root), points=("points", "bdb", "raw/points"), seeds=(("Ann", "MS"), ("Uma", "WS")))
    rows = {
        "sets": [["1", "v1", "Open", "Finals", "2021", "3", "4", "2", "45", "Ann", "Bob", "", ""], ["2", "v2", "Open", "QF", "2021", "3", "2", "2", "40", "Uma", "Vera", "", ""]],
        "sets22": [["7", "w1", "Open", "Finals", "2021", "3", "4", "2", "45", "Ann", "Bobby", "", ""], ["8", "w2", "Cup", "SF", "2022", "1", "2", "2", "33", "Bob", "Cee", "", ""]],
    }
    for source, _, folder in layout.tables:
        at = root / folder
        at.mkdir(parents=True)
        pd.DataFrame(rows[source], columns=files.MATCH_CSV).to_csv(at / "match.csv", index=False)
        for r in rows[source]:
            (at / r[1]).mkdir()
            for k in (1, 2):
                stroke = pd.DataFrame([["1" if c in ("rally", "ball_round") else "A" if c == "player" else "" for c in files.STROKE_CSV]], columns=files.STROKE_CSV)
                stroke.to_csv(at / r[1] / f"set{k}.csv", index=False)
    at = root / layout.points[2]
    at.mkdir(parents=True)
    point = {"T1P1": {"Score": 1, "Point": 20}, "T2P1": {"Score": 0, "Point": 15}}
    (at / "2019-20-1QF-MS-Cee-Ann-Cup-1080p.json").write_text(json.dumps({"Point1": {"PointInfo": point}}))
    (root / "curated").mkdir()
    (root / "curated/aliases.csv").write_text("alias,canonical,source_note\nBobby,Bob,x\n")
    (root / "curated/overrides.csv").write_text("match_uid,date,winner,week_mismatch_ok,provenance_url,note\n")
    return layout


def test_timeline_of_archives(spark, tmp_path, capsys):
    layout = make_archives(tmp_path)
    rows = archive.global_timeline(spark, layout).orderBy("t_idx").collect()
    assert [(r.t_idx, r.match_uid, r.discipline) for r in rows] == [(0, "bdb:2019-20", "MS"), (1, "ss:2", "WS"), (2, "ss:1", "MS"), (3, "ss22:8", "MS")]
    elite = archive.elite_timeline(spark, layout)
    assert [r.match_uid for r in elite.orderBy("t_idx").collect()] == ["ss:2", "ss:1", "ss22:8"]
    assert archive.elite_strokes(spark, layout, elite).count() == 6
    # a folder that lacks, a source that disagrees on the winner, and a component without a seed
    os.rename(tmp_path / layout.tables[0][2] / "v2", tmp_path / "v2")
    with pytest.raises(ContractError, match="no folder"):
        archive.global_timeline(spark, layout)
    os.rename(tmp_path / "v2", tmp_path / layout.tables[0][2] / "v2")
    with pytest.raises(ContractError, match="seed"):
        archive.global_timeline(spark, dataclasses.replace(layout, seeds=(("Ann", "MS"),)))
    table = tmp_path / layout.tables[1][2] / "match.csv"
    table.write_text(table.read_text().replace("Ann,Bobby", "Bobby,Ann"))
    with pytest.raises(ContractError, match="disagree"):
        archive.global_timeline(spark, layout)


def test_file_names_with_a_fourth_part_are_refused(spark, tmp_path):
    point = {"T1P1": {"Score": 1, "Point": 20}, "T2P1": {"Score": 0, "Point": 15}}
    (tmp_path / "2019-20-1QF-MS-Ann-Bob-Cee-Cup-1080p.json").write_text(json.dumps({"Point1": {"PointInfo": point}}))
    assert [r.reason for r in files.read_point_files(spark, str(tmp_path), "pts", "bdb").collect()] == ["file name"]


def test_archives_are_unpacked_once_and_locked(tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.csv", "1")
        z.writestr("in/y.csv", "2")
    root = tmp_path / "raw"
    assert cli.main(["unpack", str(root), f"a={tmp_path}/a.zip"]) == 0
    assert sorted(os.listdir(root / "a" / "in")) == ["x.csv", "y.csv"] and not os.stat(root / "a/in/x.csv").st_mode & 0o222
    assert files.unpack({f"{tmp_path}/a.zip": "a"}, str(root)) == []
    assert cli.main(["extract-check", str(root), "--expect", "a=2"]) == 0 and cli.main(["extract-check", str(root), "--expect", "a=3"]) == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../out.csv", "1")
    with pytest.raises(ContractError, match="outside"):
        files.unpack({f"{tmp_path}/b.zip": "b"}, str(root))
    with pytest.raises(ContractError, match="can't be unpacked"):
        files.unpack({f"{tmp_path}/none.zip": "c"}, str(root))
    os.chmod(root, 0o755)


def test_label_map_files(spark, tmp_path):
    path = tmp_path / "l.yaml"
    path.write_text(yaml.safe_dump({"version": "v9", "unknown_tokens": ["?"], "classes": {"smash": {"group": "attack", "zh": ["a", "b"]}, "lob": {"group": "defense", "zh": ["c"]}}}))
    table, version = files.read_label_map(spark, str(path))
    assert version == "v9" and {(r.token, r.shot_class, r.shot_group, r.is_unknown) for r in table.collect()} == {("a", "smash", "attack", False), ("b", "smash", "attack", False), ("c", "lob", "defense", False), ("?", None, None, True)}
    for bad in ({"version": "v", "unknown_tokens": ["a"], "classes": {"x": {"group": "g", "zh": ["a"]}}}, {"version": "v", "unknown_tokens": [], "classes": {}}, {"version": "v", "unknown_tokens": [], "classes": {"x": {"zh": ["a"]}}}):
        path.write_text(yaml.safe_dump(bad))
        with pytest.raises(LabelError):
            files.read_label_map(spark, str(path))


# the club's store


def names(spark, *who):
    return spark.createDataFrame([(w,) for w in who], "name string")


def games(spark, *rows):
    return spark.createDataFrame([(i, "singles", dt.date(2024, 1, d), [a], [b], "a", g) for i, (d, a, b, g) in enumerate(rows)], "line_no int, match_type string, played_at date, side_a array<string>, side_b array<string>, winner_side string, games array<struct<a:int,b:int>>")


WON = [(21, 15), (21, 18)]


def test_club_store_keeps_its_constraints(spark, tmp_path):
    store = club.ClubStore(spark, str(tmp_path / "club"))
    with pytest.raises(ContractError, match="make it first"):
        store.players()
    store.init()
    store.add_players(names(spark, "Ann  Lee", "Bob Stone"))
    assert {(r.player_id, r.name, r.key) for r in store.players().collect()} == {(1, "Ann Lee", "ann lee"), (2, "Bob Stone", "bob stone")}
    for bad, why in ((["ANN LEE"], "exist already"), (["x y", "X  Y"], "given twice"), ([" "], "empty"), (["Ann Leee"], "close to another"), (["Quentin Abel", "Quentin Abell"], "close to another"), (["New Name", "ann lee"], "exist already")):
        with pytest.raises(ContractError, match=why):
            store.add_players(names(spark, *bad))
    assert store.players().count() == 2  # all or none
    store.add_players(names(spark, "Ann Leee"), force_new=True)
    placed, again = store.add_matches(games(spark, (5, "ann lee", "Bob Stone", WON)), today())
    assert placed.first().match_id == 1 and again.count() == 0
    placed, again = store.add_matches(games(spark, (5, "Bob Stone", "Ann Lee", WON), (6, "Ann Lee", "Ann Leee", WON)), today())
    assert [r.match_id for r in again.collect()] == [2]
    with pytest.raises(ContractError, match="unknown players"):
        store.add_matches(games(spark, (5, "Ann Lee", "Bob Stone", WON), (7, "Ann Lee", "Nobody", WON)), today())
    with pytest.raises(ContractError, match="score"):
        store.add_matches(games(spark, (7, "Ann Lee", "Bob Stone", [(21, 20), (21, 1)])), today())
    assert store.matches().count() == 3 and store.games().count() == 6
    assert store.revalidate(today()).collect() == []
    assert {(r.match_id, r.reason) for r in store.revalidate(F.lit("2024-01-05").cast("date")).collect()} == {(3, "future")}


def test_a_batch_that_was_not_named_does_not_exist(spark, tmp_path, monkeypatch):
    store = club.ClubStore(spark, str(tmp_path / "club"))
    store.init()
    with monkeypatch.context() as m:
        m.setattr(os, "rename", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            store.add_players(names(spark, "Ann"))
    assert store.players().count() == 0
    store.add_players(names(spark, "Ann"))
    assert store.players().count() == 1


def test_records_commands(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "club")]
    assert cli.main(["records", "add-player", "Ann", *at]) == 1
    for argv in (["init"], ["add-player", "Ann Lee"], ["add-player", "Bob"], ["add-match", "--type", "singles", "--date", "2024-01-05", "--side-a", "Ann Lee", "--side-b", "bob", "--games", "21-15,21-18", "--winner", "A"]):
        assert cli.main(["records", *argv, *at]) == 0
    assert cli.main(["records", "add-player", "ann lee", *at]) == 1
    assert cli.main(["records", "add-match", "--type", "singles", "--date", "soon", "--side-a", "Ann Lee", "--side-b", "Bob", "--games", "21-15,21-18", "--winner", "A", *at]) == 1
    (tmp_path / "in.csv").write_text('match_type,played_at,side_a,side_b,winner_side,games\nsingles,2024-01-06,Ann Lee,Bob,A,"21-15,21-18"\n# a note\nsingles,2024-01-07,Ann Lee,Stranger,A,"21-15,21-18"\nsingles,2024-01-08,Ann Lee,Bob,A,"21-20,21-18"\n')
    capsys.readouterr()
    assert cli.main(["records", "import-csv", str(tmp_path / "in.csv"), *at]) == 0
    said = capsys.readouterr().out
    assert "added 1" in said and "unknown_player" in said and "score" in said
    assert cli.main(["records", "validate", *at]) == 0
    assert club.ClubStore(spark, str(tmp_path / "club")).matches().count() == 2
