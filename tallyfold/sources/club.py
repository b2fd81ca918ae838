"""The club's record store: players, matches and games as tables, filled from CSV with a quarantine."""

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.errors import ContractError
from tallyfold.functions import rulebook
from tallyfold.operators import gates
from tallyfold.session import written

COLUMNS = ["match_type", "played_at", "side_a", "side_b", "winner_side", "games"]
TWIN = 0.85
c = F.col


@dataclass
class Import:
    """Accepted matches, quarantined rows with line and reason, and the players the accepted rows name."""

    accepted: DataFrame
    quarantined: DataFrame
    players: DataFrame


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a match CSV with their line numbers; a file is one record, as line numbers need the whole of it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where("i > 0 AND trim(line) <> '' AND NOT startswith(line, '#')")
    row = F.from_csv("line", ", ".join(f"{n} string" for n in COLUMNS)).alias("r")
    return lines.select((c("i") + 1).alias("line_no"), row).select("line_no", "r.*")


def parsed(rows: DataFrame) -> DataFrame:
    """Typed columns; games that aren't two numbers each become null and so break the score rule."""
    side = lambda x: F.transform(F.split(x, r"\|"), lambda n: F.trim(n))
    number = lambda g, k: F.try_element_at(F.split(g, "-"), F.lit(k)).try_cast("int")
    games = F.transform(F.split("games", ","), lambda g: F.struct(number(F.trim(g), 1).alias("a"), number(F.trim(g), 2).alias("b")))
    return rows.select("line_no", "match_type", c("played_at").try_cast("date").alias("played_at"), side("side_a").alias("side_a"), side("side_b").alias("side_b"), F.lower("winner_side").alias("winner_side"), games.alias("games"))


def import_csv(spark: SparkSession, path: str, today: Column) -> Import:
    """No row stops the file; players come from accepted rows alone."""
    rows = parsed(read_csv(spark, path)).withColumn("reason", rulebook.match_reason(today))
    good = rows.where("reason IS NULL").drop("reason")
    names = good.select(F.explode(F.concat("side_a", "side_b")).alias("name")).select("name", rulebook.normalize_name(c("name")).alias("key"))
    return Import(good, rows.where("reason IS NOT NULL").select("line_no", "reason"), names.groupBy("key").agg(F.min("name").alias("name")))


def near_twins(new: DataFrame, roster: DataFrame, most: int = 200_000) -> DataFrame:
    """New players (key, name) that nearly equal one of the roster, with the twin; equal keys are the same player.

    Names are compared only where their lengths allow the ratio, and the roster is broadcast up to `most` names;
    beyond, both sides meet by length.
    """
    known = roster.select(c("key").alias("known"), F.length("key").alias("known_length"))
    # a ratio r of lengths a <= b needs 2a / (a + b) >= r
    lengths = F.sequence(F.ceil(F.length("key") * TWIN / (2 - TWIN)).cast("int"), F.floor(F.length("key") * (2 - TWIN) / TWIN).cast("int"))
    sized = new.withColumn("near_length", F.explode(lengths))
    known = F.broadcast(known) if known.limit(most + 1).count() <= most else known
    both = sized.join(known, (c("near_length") == c("known_length")) & (c("key") != c("known"))).drop("near_length", "known_length")
    return both.withColumn("ratio", rulebook.name_ratio("key", "known")).where(c("ratio") >= TWIN)


def match_table(accepted: DataFrame) -> DataFrame:
    """The match contract of the singles."""
    won = c("winner_side") == "a"
    a, b = c("side_a")[0], c("side_b")[0]
    return accepted.where("match_type = 'singles'").select(
        F.concat(F.lit("club:"), c("line_no").cast("string")).alias("match_uid"), F.lit("club").alias("source"), c("played_at").alias("date"), F.lit("day").alias("date_precision"), F.when(won, a).otherwise(b).alias("winner"), F.when(won, b).otherwise(a).alias("loser"), F.size("games").alias("n_sets"),
    )


class ClubStore:
    """Players, matches and games as Parquet batches of a folder, with the store's constraints checked on every write.

    A write puts its tables into a batch folder of its own and then adds one file that names
    the batch, so all of it is there or nothing; readers only see named batches. One writer
    at a time, as for any such store.
    """

    PLAYERS = "player_id long, name string, key string"
    MATCHES = "match_id long, match_type string, played_at date, side_a array<long>, side_b array<long>, winner_side string, source string"
    GAMES = "match_id long, game_number int, a int, b int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def init(self) -> None:
        os.makedirs(f"{self.folder}/commits", exist_ok=True)

    def _commits(self) -> list[str]:
        if not os.path.isdir(f"{self.folder}/commits"):
            raise ContractError(f"no store in {self.folder}; make it first")
        return sorted(x[:-5] for x in os.listdir(f"{self.folder}/commits") if x.endswith(".json"))

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [p for b in self._commits() if os.path.isdir(p := f"{self.folder}/batches/{b}/{name}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def players(self) -> DataFrame:
        return self._table("players", self.PLAYERS)

    def matches(self) -> DataFrame:
        return self._table("matches", self.MATCHES)

    def games(self) -> DataFrame:
        return self._table("games", self.GAMES)

    def _commit(self, **tables: DataFrame) -> None:
        batch = f"{len(self._commits()):08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/batches/{batch}/{name}")
        part = f"{self.folder}/commits/{batch}.part"
        with open(part, "w") as f:
            f.write("{}")
        os.rename(part, f"{self.folder}/commits/{batch}.json")

    def add_players(self, names: DataFrame, force_new: bool = False) -> DataFrame:
        """Adds the names (column name), all or none: empty, repeated and known names raise, and near twins of known ones unless forced."""
        clean = F.trim(F.regexp_replace("name", r"(?U)[\s\x1c-\x1f]+", " "))
        new = names.select(clean.alias("name")).withColumn("key", rulebook.normalize_name(c("name")))
        roster = self.players().select("key", "name")
        gates.require_none(new.where("coalesce(key, '') = ''").select("name"), "empty player names")
        gates.require_none(gates.unique(new, "key").select("key"), "names given twice")
        gates.require_none(new.join(roster.select("key"), "key", "left_semi").select("name"), "players that exist already")
        if not force_new:
            both = roster.unionByName(new)
            gates.require_none(near_twins(new, both).select("name", "known", "ratio"), "names close to another; force them if they are other people")
        first = (self.players().agg(F.max("player_id")).first()[0] or 0) + 1
        added = new.select((F.row_number().over(Window.orderBy("key")) - 1 + first).cast("long").alias("player_id"), "name", "key")
        self._commit(players=added)
        return added

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """rows with ids for the names of both sides; a name that isn't a player raises."""
        ids = self.players().select("key", "player_id")
        for side in ("side_a", "side_b"):
            each = rows.select("line_no", F.posexplode(side).alias("at", "name")).withColumn("key", rulebook.normalize_name(c("name")))
            found = each.join(ids, "key", "left")
            gates.require_none(found.where("player_id IS NULL").select("name").distinct(), "unknown players; add them first")
            listed = found.groupBy("line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "player_id"))), lambda x: x["player_id"]).alias(f"{side}_ids"))
            rows = rows.join(listed, "line_no").drop(side).withColumnRenamed(f"{side}_ids", side)
        return rows

    def add_matches(self, rows: DataFrame, today: Column, source: str = "manual") -> tuple[DataFrame, DataFrame]:
        """Adds matches (line_no, match_type, played_at, side_a, side_b, winner_side, games), all or none; gives them with
        their ids, and those that repeat a pair and day (which a club may well play twice)."""
        checked = rows.withColumn("reason", rulebook.match_reason(today))
        good = self._with_ids(gates.strict(checked, "matches"))
        first = (self.matches().agg(F.max("match_id")).first()[0] or 0) + 1
        placed = good.withColumn("match_id", (F.row_number().over(Window.orderBy("line_no")) - 1 + first).cast("long"))
        placed = written(self.spark, placed)
        pair = lambda df: df.select("match_id", "played_at", F.least(c("side_a")[0], c("side_b")[0]).alias("lo"), F.greatest(c("side_a")[0], c("side_b")[0]).alias("hi"))
        old = written(self.spark, pair(self.matches()))
        again = pair(placed).join(old.drop("match_id").distinct(), ["played_at", "lo", "hi"], "left_semi").select("match_id")
        games = placed.select("match_id", F.posexplode("games").alias("at", "g")).select("match_id", (c("at") + 1).alias("game_number"), "g.a", "g.b")
        self._commit(matches=placed.select("match_id", "match_type", "played_at", "side_a", "side_b", "winner_side", F.lit(source).alias("source")), games=games)
        return placed, again

    def import_csv(self, path: str, today: Column) -> tuple[int, DataFrame]:
        """Adds the fine rows of a match CSV whose players are known; gives their number and the other rows' line and reason."""
        rows = parsed(read_csv(self.spark, path)).withColumn("reason", rulebook.match_reason(today))
        names = rows.select("line_no", F.explode(F.concat("side_a", "side_b")).alias("name")).withColumn("key", rulebook.normalize_name(c("name")))
        strangers = names.join(self.players().select("key"), "key", "left_anti").groupBy("line_no").agg(F.lit("unknown_player").alias("stranger"))
        rows = written(self.spark, rows.join(strangers, "line_no", "left").withColumn("reason", F.coalesce("reason", "stranger")).drop("stranger"))
        good = rows.where("reason IS NULL").drop("reason")
        n = good.count()
        if n:
            self.add_matches(good, today, "csv")
        return n, rows.where("reason IS NOT NULL").select("line_no", "reason")

    def stored(self) -> DataFrame:
        """Matches with names and games in the form the rules take."""
        ids = self.players().select("player_id", "name")
        out = self.matches().withColumn("line_no", c("match_id"))
        for side in ("side_a", "side_b"):
            each = out.select("match_id", F.posexplode(side).alias("at", "player_id")).join(ids, "player_id", "left")
            named = each.groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
            out = out.join(named, "match_id").drop(side).withColumnRenamed("names", side)
        games = self.games().groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("game_number", "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("games"))
        none = F.array().cast("array<struct<a:int,b:int>>")
        return out.join(games, "match_id", "left").withColumn("games", F.coalesce("games", none))

    def revalidate(self, today: Column) -> DataFrame:
        """Stored matches that break a rule: match_id and reason."""
        return self.stored().withColumn("reason", rulebook.match_reason(today)).where("reason IS NOT NULL").select("match_id", "reason")
