"""The stroke label dimension."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (class, group, raw tokens), in the order of the label contract.
CLASSES = [
    ("short_service", "serve", ["發短球"]),
    ("long_service", "serve", ["發長球"]),
    ("net_shot", "net", ["放小球"]),
    ("return_net", "net", ["擋小球"]),
    ("cross_court_net_shot", "net", ["勾球"]),
    ("smash", "attack", ["殺球"]),
    ("wrist_smash", "attack", ["點扣"]),
    ("rush", "attack", ["撲球"]),
    ("drop", "attack", ["切球"]),
    ("passive_drop", "transition", ["過渡切球", "過度切球"]),
    ("push", "transition", ["推球"]),
    ("clear", "neutral", ["長球"]),
    ("drive", "neutral", ["平球"]),
    ("driven_flight", "neutral", ["小平球"]),
    ("back_court_drive", "neutral", ["後場抽平球"]),
    ("lob", "defense", ["挑球"]),
    ("defensive_return_lob", "defense", ["防守回挑"]),
    ("defensive_return_drive", "defense", ["防守回抽"]),
]
UNKNOWN_TOKENS = ["未知球種"]
SMASHES = ("smash", "wrist_smash")


def dimension(spark: SparkSession) -> DataFrame:
    """token, shot_class, shot_group, is_unknown; 20 rows."""
    rows = [(t, c, g, False) for c, g, tokens in CLASSES for t in tokens] + [(t, None, None, True) for t in UNKNOWN_TOKENS]
    return spark.createDataFrame(rows, "token string, shot_class string, shot_group string, is_unknown boolean")


def apply_labels(strokes: DataFrame, labels: DataFrame, token: str = "type", strict: bool = True) -> DataFrame:
    """strokes with shot_class, shot_group and is_unknown; a token outside the dimension raises, or is null if not strict."""
    out = strokes.join(F.broadcast(labels.withColumnRenamed("token", "__token")), F.col(token) == F.col("__token"), "left")
    if strict:
        known: Column = F.when(F.col("__token").isNull(), F.raise_error(F.concat(F.lit("unmapped token: "), F.coalesce(F.col(token), F.lit("null"))))).otherwise(F.col("is_unknown"))
        out = out.withColumn("is_unknown", known.cast("boolean"))
    return out.drop("__token")
