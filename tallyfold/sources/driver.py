"""Matches and strokes derived from the order tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match: every twentieth order."""
    c = F.col
    o = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").withColumn("mid", (c("o_orderkey") / 20).cast("long"))
    pool, own = c("mid") % 2 * 16, c("o_custkey") % 16
    a, b = pool + own, pool + (own + 1 + c("mid") % 15) % 16
    a_wins = (c("o_orderstatus") == "O") | ((c("o_orderstatus") != "F") & (a < b))
    name = lambda n: F.concat(F.lit("P"), n.cast("string"))
    return o.select(
        "mid", F.concat(F.lit("m:"), c("mid").cast("string")).alias("match_uid"), c("o_orderdate").cast("date").alias("date"), F.substring("o_orderpriority", 1, 1).cast("int").alias("round_rank"),
        F.when(c("mid") % 2 == 0, "MS").otherwise("WS").alias("discipline"), name(F.when(a_wins, a).otherwise(b)).alias("winner"), name(F.when(a_wins, b).otherwise(a)).alias("loser"), (2 + c("mid") % 2).cast("int").alias("n_sets"),
    )


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stroke: order lines in a unique order within their order."""
    c = F.col
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = li.withColumn("ball_round", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    point = F.when(c("ball_round") == c("n"), F.when(c("l_returnflag") == "A", "A").when(c("l_returnflag") == "R", "B"))
    place = lambda x, gap: F.when((c("l_partkey") + c("l_linenumber")) % gap != 0, x.cast("double"))
    return li.select(
        F.concat(F.lit("m:"), ((c("l_orderkey") - c("l_orderkey") % 20) / 20).cast("long").cast("string")).alias("match_uid"), F.when(c("l_orderkey") % 20 < 10, 1).otherwise(2).alias("set_no"), (c("l_orderkey") % 20).alias("rally"), "ball_round",
        F.when((c("ball_round") + c("l_orderkey")) % 2 == 0, "A").otherwise("B").alias("player"), (c("l_partkey") % 19).cast("int").alias("token"),
        F.when(c("l_discount") != 0, (c("l_suppkey") % 2).cast("int")).alias("backhand"), F.when(c("l_tax") != 0, (c("l_linenumber") % 2).cast("int")).alias("aroundhead"), point.alias("getpoint_player"),
        (c("ball_round") * 30 + c("l_partkey") % 7).cast("long").alias("frame_num"), place(c("l_partkey") % 170, 3).alias("player_location_x"), place(c("l_suppkey") % 300, 5).alias("player_location_y"),
        place(c("l_suppkey") % 171, 4).alias("opponent_location_x"), place(c("l_partkey") % 301, 6).alias("opponent_location_y"), place(c("l_partkey") % 172, 7).alias("landing_x"), place(c("l_suppkey") % 302, 9).alias("landing_y"),
    )
