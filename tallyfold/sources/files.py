"""Readers of match archives: CSV trees, per-match JSON, curated tables; and sinks.

Each reader gives rows with a `reason` (null: fine) for gates.split or gates.strict.
"""

import json
import os
import shutil
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyfold.errors import ContractError, LabelError
from tallyfold.functions import config, rulebook
from tallyfold.operators import gates

# The column contracts of the archives.
MATCH_CSV = ["id", "video", "tournament", "round", "year", "month", "day", "set", "duration", "winner", "loser", "downcourt", "url"]
STROKE_CSV = [
    "rally", "ball_round", "time", "frame_num", "roundscore_A", "roundscore_B", "player", "server", "type", "aroundhead", "backhand", "hit_height", "hit_area", "hit_x", "hit_y", "landing_height", "landing_area",
    "landing_x", "landing_y", "lose_reason", "win_reason", "getpoint_player", "flaw", "player_location_area", "player_location_x", "player_location_y", "opponent_location_area", "opponent_location_x", "opponent_location_y", "db",
]
FILE_NAME = r"^(\d{4})-(\d{2})-\d(R32|R16|QF|SF|F)-MS-([^-]+)-([^-]+)-([^-]+)-1080p(-50fps)?\.json$"
POINT = "map<string,struct<PointInfo:map<string,struct<Score:int,Point:int>>>>"
MATCH = ["match_uid", "source", "video", "date", "date_precision", "tournament", "round_name", "winner", "loser", "n_sets", "duration_min"]
c = F.col


def _texts(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _csv(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """A CSV with a header that must be the contract's, all as text."""
    return spark.read.schema(_texts(names)).option("header", True).option("enforceSchema", False).csv(path)


def _resolved(rows: DataFrame, aliases: DataFrame | None, *columns: str) -> DataFrame:
    for col in columns if aliases is not None else ():
        names = F.broadcast(aliases.select(c("alias").alias("__alias"), c("canonical").alias("__canonical")))
        rows = rows.join(names, c(col) == c("__alias"), "left").withColumn(col, F.coalesce("__canonical", col)).drop("__alias", "__canonical")
    return rows


def read_match_table(spark: SparkSession, path: str, source: str, prefix: str, aliases: DataFrame | None = None) -> DataFrame:
    """The match contract from a match CSV."""
    raw = _csv(spark, path, MATCH_CSV)
    y, m, d = (rulebook.coerce_int(c(n)) for n in ("year", "month", "day"))
    rows = raw.select(
        F.concat(F.lit(f"{prefix}:"), "id").alias("match_uid"), F.lit(source).alias("source"), "video", rulebook.safe_date(y, m, d).alias("date"), F.lit("day").alias("date_precision"), "tournament", c("round").alias("round_name"),
        "winner", "loser", rulebook.coerce_int(c("set")).alias("n_sets"), rulebook.coerce_int(c("duration")).alias("duration_min"), c("duration").alias("__duration"),
    )
    rules = [(c("match_uid").isNull(), "no id"), (c("date").isNull(), "bad date"), (c("n_sets").isNull(), "bad set count"), (c("__duration").isNotNull() & c("duration_min").isNull(), "bad duration"), (c("winner").isNull() | c("loser").isNull(), "no player")]
    return _resolved(rows.withColumn("reason", gates.first_reason(rules)).drop("__duration"), aliases, "winner", "loser")


def folder_name(path: Column) -> Column:
    """The decoded name of a file's folder; a literal plus stays one."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B")))


def read_strokes(spark: SparkSession, set_dir: str, matches: DataFrame) -> DataFrame:
    """All strokes below set_dir/<video>/setN.csv in one scan, with the match of their folder."""
    raw = _csv(spark, f"{set_dir}/*/set*.csv", STROKE_CSV).select("*", "_metadata.file_path")
    number = F.regexp_extract("file_path", r"set(\d+)\.csv$", 1)
    rows = raw.withColumn("video", folder_name(c("file_path"))).withColumn("set_no", number.try_cast("int"))
    known = matches.select(c("video").alias("__video"), "match_uid", "source", "n_sets")
    rows = rows.join(known, c("video") == c("__video"), "left")
    rules = [(c("match_uid").isNull(), "no match for folder"), (c("set_no").isNull() | (c("set_no") > c("n_sets")), "unexpected set file"), (c("rally").try_cast("double").isNull() | c("ball_round").try_cast("double").isNull(), "no rally or stroke number")]
    return rows.withColumn("reason", gates.first_reason(rules)).drop("file_path", "__video", "n_sets")


def missing_folders(set_dir: str, matches: DataFrame) -> list[str]:
    """Videos of matches (a match table is small) that have no folder below set_dir."""
    return sorted(r.video for r in matches.select("video").distinct().collect() if not os.path.isdir(os.path.join(set_dir, r.video)))


def set_count_violations(strokes: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches whose set files aren't exactly 1..n_sets."""
    got = strokes.groupBy("match_uid").agg(F.array_sort(F.collect_set("set_no")).alias("sets"))
    return matches.join(got, "match_uid", "left").where(~F.coalesce(c("sets") == F.sequence(F.lit(1), c("n_sets")), F.lit(False))).select("match_uid", "n_sets", "sets")


def read_homography(spark: SparkSession, path: str) -> DataFrame:
    """video and a 3 by 3 matrix from a CSV with JSON in a column."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    rows = raw.select("id", "video", F.from_json("homography_matrix", "array<array<double>>").alias("homography"))
    ok = (F.size("homography") == 3) & F.forall("homography", lambda r: F.size(r) == 3)
    return rows.withColumn("reason", gates.first_reason([(~ok, "matrix is not 3 by 3")]))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias and canonical; repeated, self and chained aliases raise."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path).select("alias", "canonical")
    bad = gates.unique(rows, "alias").select("alias").union(rows.where("alias = canonical").select("alias")).union(rows.select("alias").intersect(rows.select("canonical")))
    gates.require_none(bad, "aliases")
    return rows


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("comment", "#").csv(path).withColumn("date", c("date").try_cast("date")).withColumn("week_mismatch_ok", F.lower("week_mismatch_ok") == "true")
    gates.require_none(rows.where("provenance_url IS NULL").select("match_uid"), "overrides without provenance")
    return rows


def read_label_map(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The label dimension of a YAML or JSON file and its version: classes, each with `group` and its raw tokens in `zh`, and unknown_tokens."""
    with open(path, encoding="utf-8") as f:
        got = config.read_mapping(f.read(), path)
    try:
        classes = [(name, x["group"], list(x["zh"])) for name, x in got["classes"].items()]
        return load_label_map(spark, classes, list(got["unknown_tokens"])), str(got["version"])
    except (KeyError, TypeError, AttributeError) as e:
        raise LabelError(f"{path} isn't a label map: {e}") from None


def load_label_map(spark: SparkSession, classes: list[tuple[str, str, list[str]]], unknown: list[str]) -> DataFrame:
    """The label dimension from (class, group, tokens); a token given twice raises."""
    tokens = [t for _, _, ts in classes for t in ts] + unknown
    if not tokens or len(tokens) != len(set(tokens)):
        raise LabelError("the label map is empty or maps a token twice")
    rows = [(t, k, g, False) for k, g, ts in classes for t in ts] + [(t, None, None, True) for t in unknown]
    return spark.createDataFrame(rows, "token string, shot_class string, shot_group string, is_unknown boolean")


def read_point_files(spark: SparkSession, folder: str, source: str, prefix: str, aliases: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The match contract from one JSON a match, with curated dates and winners merged in."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file"))
    part = lambda i: F.regexp_extract("file", FILE_NAME, i)
    rows = raw.select("file", F.from_json("value", POINT).alias("m"), part(1).alias("y"), part(2).alias("w"), part(3).alias("round_name"), part(4).alias("p1"), part(5).alias("p2"), part(6).alias("tournament"))
    n = F.size("m")
    last = F.try_element_at("m", F.concat(F.lit("Point"), n.cast("string")))["PointInfo"]
    at = lambda side, field: F.try_element_at(last, F.lit(side))[field]
    rows = rows.withColumn("gapless", F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.map_contains_key("m", F.concat(F.lit("Point"), i.cast("string")))))
    rows = rows.withColumn("side", rulebook.extract_winner(at("T1P1", "Score"), at("T1P1", "Point"), at("T2P1", "Score"), at("T2P1", "Point"))).withColumn("n_sets", at("T1P1", "Score") + at("T2P1", "Score") + 1)
    rows = _resolved(rows, aliases, "p1", "p2").withColumn("match_uid", F.concat(F.lit(f"{prefix}:"), "y", F.lit("-"), "w")).withColumn("own", F.when(c("side") == "T1P1", c("p1")).when(c("side") == "T2P1", c("p2")))
    monday = F.when(c("y") != "", rulebook.iso_monday(c("y").try_cast("int"), c("w").try_cast("int")))
    if overrides is None:
        over = rows.select("match_uid").limit(0).selectExpr("match_uid AS __uid", "cast(null AS date) AS o_date", "cast(null AS string) AS o_winner", "false AS o_ok")
    else:
        over = overrides.select(c("match_uid").alias("__uid"), c("date").alias("o_date"), c("winner").alias("o_winner"), c("week_mismatch_ok").alias("o_ok"))
    rows = rows.join(over, c("match_uid") == c("__uid"), "left").withColumn("winner", F.coalesce("own", "o_winner"))
    week = F.weekofyear("o_date") == c("w").try_cast("int")
    rules = [
        (c("y") == "", "file name"), (~c("gapless"), "points have gaps"), (c("own").isNotNull() & c("o_winner").isNotNull() & (c("own") != c("o_winner")), "override disagrees"), (c("winner").isNull(), "no winner"),
        (~c("winner").isin(c("p1"), c("p2")), "winner is no player"), (c("o_date").isNotNull() & ~week & ~F.coalesce("o_ok", F.lit(False)), "week disagrees"),
    ]
    rows = rows.withColumn("reason", gates.first_reason([(F.coalesce(b, F.lit(False)), r) for b, r in rules]))
    return rows.select(
        "match_uid", F.lit(source).alias("source"), c("file").alias("video"), F.coalesce("o_date", monday).alias("date"), F.when(c("o_date").isNull(), "week").otherwise("day").alias("date_precision"), "tournament", "round_name",
        "winner", F.when(c("winner") == c("p1"), c("p2")).otherwise(c("p1")).alias("loser"), "n_sets", F.lit(None).cast("int").alias("duration_min"), "reason",
    )


def audit_tree(root: str, expected: dict[str, int]) -> list[str]:
    """All problems of a raw tree at once: file counts of folders, and paths that can be written."""
    problems = []
    for folder, n in expected.items():
        at = os.path.join(root, folder)
        files = [os.path.join(d, f) for d, _, fs in os.walk(at) for f in fs]
        if len(files) != n:
            problems.append(f"{folder}: {len(files)} files, {n} expected")
        problems += [f"{f} is writable" for f in files if os.stat(f).st_mode & 0o222]
    return problems


def write_run(log: DataFrame, folder: str, manifest: dict, report: dict | None = None) -> None:
    """A run's prediction log as Parquet, and its manifest and report as JSON beside it; a folder that holds a run raises."""
    log.write.mode("errorifexists").parquet(f"{folder}/predictions.parquet")
    for name, content in (("manifest", manifest), ("report", report)):
        if content is not None:
            with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
                json.dump(content, f, indent=2, sort_keys=True, default=str)


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """A stored run's log and manifest."""
    try:
        with open(f"{folder}/manifest.json", encoding="utf-8") as f:
            manifest = json.load(f)
    except (OSError, ValueError) as e:
        raise ContractError(f"no run in {folder}: {e}") from None
    return spark.read.parquet(f"{folder}/predictions.parquet"), manifest


def unpack(archives: dict[str, str], root: str) -> list[str]:
    """Extracts each ZIP file into its folder below root, unless that is there, and takes the right to write from the whole tree.

    A member that would lie outside its folder raises; a folder appears only when its archive is whole.
    """
    os.makedirs(root, exist_ok=True)
    os.chmod(root, os.stat(root).st_mode | 0o200)
    done = []
    for archive, name in archives.items():
        target, part = os.path.join(root, name), os.path.join(root, f".{name}.part")
        if os.path.isdir(target):
            continue
        shutil.rmtree(part, ignore_errors=True)
        try:
            with zipfile.ZipFile(archive) as z:
                for member in z.namelist():
                    if not os.path.realpath(os.path.join(part, member)).startswith(os.path.realpath(part) + os.sep):
                        raise ContractError(f"{archive} holds {member}, which lies outside")
                z.extractall(part)
        except (OSError, zipfile.BadZipFile) as e:
            raise ContractError(f"{archive} can't be unpacked: {e}") from None
        os.rename(part, target)
        done.append(target)
    for d, _, names in os.walk(root, topdown=False):
        for x in [*(os.path.join(d, n) for n in names), d]:
            os.chmod(x, os.stat(x).st_mode & ~0o222)
    return done


def latest_run(root: str) -> str:
    """The run folder whose name sorts last."""
    runs = sorted(x for x in os.listdir(root) if os.path.isdir(os.path.join(root, x))) if os.path.isdir(root) else []
    if not runs:
        raise ContractError(f"no run below {root}")
    return os.path.join(root, runs[-1])
