"""Command line: python -m tallyfold.cli COMMAND ...; errors of the library end it with status 1."""

import argparse
import json
import sys
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import ContractError, TallyfoldError


def _pairs(text: str) -> tuple[str, str]:
    name, _, value = text.partition("=")
    if not value:
        raise argparse.ArgumentTypeError(f"{text!r} isn't NAME=VALUE")
    return name, value


def build(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyfold")
    sub = parser.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *, data: bool = False):
        p = sub.add_parser(name, help=about)
        if data:
            p.add_argument("data", help="folder of the raw archives, or of the order tables")
            p.add_argument("--out", help="folder for the result (Parquet)")
            p.add_argument("--tail", type=int, default=20)
        return p

    p = add("unpack", "extract archives below a folder and lock it")
    p.add_argument("root")
    p.add_argument("archives", nargs="+", type=_pairs, metavar="FOLDER=ZIP")
    p = add("extract-check", "count files and look for writable ones")
    p.add_argument("root")
    p.add_argument("--expect", action="append", type=_pairs, default=[], metavar="FOLDER=COUNT")
    add("timeline", "the end of the global timeline", data=True)
    p = add("run", "a walk-forward run, stored with its manifest and report", data=True)
    p.add_argument("--predictors", default="coinflip,elo,log5")
    p.add_argument("--config")
    p.add_argument("--runs", default="runs")
    p = add("report", "summaries and calibration of a stored run")
    p.add_argument("--runs", default="runs")
    p.add_argument("--run", default="latest")
    p.add_argument("--config")
    p = add("experiment", "the experiments' contrasts", data=True)
    p.add_argument("which", choices=("p4a", "p4b"), nargs="?", default="p4a")
    p = add("records", "the club's record store")
    club = p.add_subparsers(dest="what", required=True)
    for name in ("init", "add-player", "add-match", "import-csv", "validate"):
        q = club.add_parser(name)
        q.add_argument("--store", default="club")
        if name == "add-player":
            q.add_argument("name")
            q.add_argument("--force-new", action="store_true")
        if name == "import-csv":
            q.add_argument("path")
        if name == "add-match":
            q.add_argument("--type", choices=("singles", "doubles"), required=True)
            for option in ("--date", "--side-a", "--side-b", "--games"):
                q.add_argument(option, required=True)
            q.add_argument("--winner", choices=("A", "B"), required=True)
    return parser.parse_args(argv)


def timeline_of(spark: SparkSession, data: str) -> DataFrame:
    """The timeline of raw archives, or of the order tables where the folder holds those."""
    from tallyfold.plans import records
    from tallyfold.sources import archive

    if (Path(data) / "orders.parquet").exists():
        return records.tl(spark, data)
    return archive.global_timeline(spark, archive.read_layout(data))


def _show(df: DataFrame, args: argparse.Namespace) -> None:
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(args.tail, truncate=False)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    from tallyfold.functions import config
    from tallyfold.operators import harness
    from tallyfold.session import written
    from tallyfold.sources import files

    names = [n.strip() for n in args.predictors.split(",") if n.strip()]
    predictors = harness.make_predictors(names)
    own = config.load(args.config, config.Harness) if args.config else config.Harness()
    rows = written(spark, timeline_of(spark, args.data))
    log = written(spark, harness.walk_forward(rows, predictors, own))
    folder = f"{args.runs}/{datetime.now():%Y%m%d-%H%M%S-%f}"
    Path(folder).mkdir(parents=True)
    report = harness.report(log, own)
    files.write_run(log, folder, harness.manifest(rows, names, own), report)
    print(f"run: {folder}")
    print(json.dumps(report, indent=1, default=str))
    if args.out:
        log.write.parquet(args.out)


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    from tallyfold.functions import config
    from tallyfold.operators import harness
    from tallyfold.sources import files

    folder = files.latest_run(args.runs) if args.run == "latest" else f"{args.runs}/{args.run}"
    log, manifest = files.read_run(spark, folder)
    own = config.load(args.config, config.Harness) if args.config else config.Harness(calibration_buckets=manifest["config"]["calibration_buckets"])
    print(f"run: {folder} ({manifest['n_matches']} matches, config {manifest['config_version']})")
    print(json.dumps(harness.report(log, own), indent=1, default=str))


def _records(spark: SparkSession, args: argparse.Namespace) -> None:
    from tallyfold.sources import club

    store, today = club.ClubStore(spark, args.store), F.current_date()
    if args.what == "init":
        store.init()
    elif args.what == "add-player":
        store.add_players(spark.createDataFrame([(args.name,)], "name string"), args.force_new)
    elif args.what == "add-match":
        try:
            games = [tuple(int(x) for x in g.split("-", 1)) for g in args.games.split(",")]
            played = date.fromisoformat(args.date)
            rows = [(1, args.type, played, args.side_a.split("|"), args.side_b.split("|"), args.winner.lower(), [(a, b) for a, b in games])]
        except ValueError as e:
            raise ContractError(f"a match that can't be read: {e}") from None
        frame = spark.createDataFrame(rows, "line_no int, match_type string, played_at date, side_a array<string>, side_b array<string>, winner_side string, games array<struct<a:int,b:int>>")
        placed, again = store.add_matches(frame, today)
        print(f"match {placed.first().match_id}" + (" (played before on that day)" if again.count() else ""))
    elif args.what == "import-csv":
        n, rejected = store.import_csv(args.path, today)
        print(f"added {n}")
        rejected.orderBy("line_no").show(1000, truncate=False)
    else:
        bad = store.revalidate(today)
        bad.orderBy("match_id").show(1000, truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = build(sys.argv[1:] if argv is None else argv)
    from tallyfold.plans import registry
    from tallyfold.sources import files

    try:
        if args.command == "unpack":
            print("\n".join(files.unpack({z: f for f, z in args.archives}, args.root)))
            return 0
        if args.command == "extract-check":
            if problems := files.audit_tree(args.root, {f: int(n) for f, n in args.expect}):
                raise ContractError("; ".join(problems[:20]))
            print("counts as expected, nothing writable")
            return 0
        spark = SparkSession.builder.appName("tallyfold").getOrCreate()
        if args.command == "timeline":
            _show(timeline_of(spark, args.data).orderBy(F.desc("t_idx")) if not args.out else timeline_of(spark, args.data), args)
        elif args.command == "experiment":
            _show(registry.QUERIES[f"{args.which}_report"](spark, args.data), args)
        else:
            {"run": _run, "report": _report, "records": _records}[args.command](spark, args)
    except TallyfoldError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
