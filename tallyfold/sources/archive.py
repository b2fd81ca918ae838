"""The timeline of the raw archives: match tables and point files, curated names and dates, duplicates, one order."""

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import ConfigError, ContractError
from tallyfold.functions import config, rulebook
from tallyfold.operators import gates, timeline
from tallyfold.session import written
from tallyfold.sources import files

c = F.col


@dataclass(frozen=True)
class Layout:
    """Where the archives lie below one folder; earlier sources win where two hold a match."""

    root: str
    #: (source, prefix of match ids, folder that holds match.csv and one folder of strokes a match)
    tables: tuple[tuple[str, str, str], ...] = (("sets", "ss", "raw/sets"), ("sets22", "ss22", "raw/sets22"))
    #: The same of the folder of point files, or None.
    points: tuple[str, str, str] | None = ("points", "pts", "raw/points")
    aliases: str = "curated/aliases.csv"
    overrides: str = "curated/overrides.csv"
    #: One player of each component of the opponent graph, with the discipline.
    seeds: tuple[tuple[str, str], ...] = ()

    def at(self, path: str) -> str:
        return os.path.join(self.root, path)

    @property
    def priorities(self) -> list[str]:
        return [t[0] for t in self.tables] + ([self.points[0]] if self.points else [])


def read_layout(root: str) -> Layout:
    """The layout that layout.yaml (or JSON in it) in the folder describes; without the file, the usual one."""
    path = os.path.join(root, "layout.yaml")
    if not os.path.exists(path):
        return Layout(root)
    with open(path, encoding="utf-8") as f:
        got = config.read_mapping(f.read(), path)
    try:
        rows = {k: tuple(tuple(map(str, x)) for x in got[k]) for k in ("tables", "seeds") if k in got}
        if "points" in got:
            rows["points"] = tuple(map(str, got["points"])) if got["points"] else None
        return Layout(root, **{k: v for k, v in got.items() if k not in ("tables", "seeds", "points")}, **rows)
    except TypeError as e:
        raise ConfigError(f"{path} isn't a layout: {e}") from None


def matches(spark: SparkSession, layout: Layout) -> DataFrame:
    """The match contract of all sources; a row that breaks it, and a match without its folder, raise."""
    aliases = files.read_aliases(spark, layout.at(layout.aliases)) if os.path.exists(layout.at(layout.aliases)) else None
    overrides = files.read_overrides(spark, layout.at(layout.overrides)) if os.path.exists(layout.at(layout.overrides)) else None
    parts = []
    for source, prefix, folder in layout.tables:
        table = written(spark, gates.strict(files.read_match_table(spark, f"{layout.at(folder)}/match.csv", source, prefix, aliases), source))
        if lacking := files.missing_folders(layout.at(folder), table):
            raise ContractError(f"{source}: no folder for {lacking[:5]}")
        parts.append(table)
    if layout.points:
        source, prefix, folder = layout.points
        parts.append(gates.strict(files.read_point_files(spark, layout.at(folder), source, prefix, aliases, overrides), source))
    out = parts[0].select(*files.MATCH)
    for p in parts[1:]:
        out = out.unionByName(p.select(*files.MATCH))
    return written(spark, out)


def disciplines(rows: DataFrame, seeds: tuple[tuple[str, str], ...]) -> DataFrame:
    """rows with the discipline of the seed in their players' component; a component without exactly one seed raises."""
    spark = rows.sparkSession
    known = spark.createDataFrame(list(seeds), "node string, discipline string")
    labels = timeline.components(rows)
    gates.require_none(gates.component_seeds(labels, known), "components without exactly one seed")
    of = labels.join(F.broadcast(known), "node").select("label", "discipline")
    names = labels.join(of, "label").select(c("node").alias("winner"), "discipline")
    return rows.join(names, "winner")


def global_timeline(spark: SparkSession, layout: Layout) -> DataFrame:
    """One row a match in one order with t_idx: conflicting winners raise, of copies the one of the first source stays."""
    rows, order = matches(spark, layout), {s: i for i, s in enumerate(layout.priorities)}
    gates.require_none(timeline.conflicts(rows, order).select("p_lo", "p_hi", "date"), "sources disagree on the winner")
    unique = timeline.dedup(rows, order).where("match_uid = kept_match_uid").select(*rows.columns)
    ranked = unique.withColumn("round_rank", rulebook.round_rank(c("round_name")))
    gates.require_none(ranked.where("round_rank IS NULL").select("match_uid", "round_name"), "rounds without a rank")
    return timeline.ordered(written(spark, disciplines(ranked, layout.seeds)))


def elite_timeline(spark: SparkSession, layout: Layout) -> DataFrame:
    """The matches that have strokes, ordered anew."""
    point_source = layout.points[0] if layout.points else ""
    return timeline.ordered(global_timeline(spark, layout).where(c("source") != point_source).drop("t_idx"))


def elite_strokes(spark: SparkSession, layout: Layout, rows: DataFrame) -> DataFrame:
    """All strokes of the timeline's matches; a stroke that breaks the contract and a match without its sets raise."""
    out = None
    for source, _, folder in layout.tables:
        own = written(spark, rows.where(c("source") == source))
        read = files.read_strokes(spark, layout.at(folder), own)
        # folders of matches that another source holds are no fault
        read = gates.strict(read.where("match_uid IS NOT NULL"), f"strokes of {source}")
        gates.require_none(files.set_count_violations(read, own).select("match_uid"), f"set files of {source}")
        out = read if out is None else out.unionByName(read)
    return out
