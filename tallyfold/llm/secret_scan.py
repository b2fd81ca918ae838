"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything runs in DataFrame expressions. A candidate's numbers (length, character
transitions, dictionary coverage, path marks, neighbouring words and others) feed a
forest that MLlib trains on labelled findings; its trees are then written out
as SQL conditions, so scanning is one pass over the texts without a shuffle.

Defined cases: a null or empty text has no candidates; a text without findings is
returned as it is; in a text with candidates a character U+0001 counts as a space, also in
its redacted form; repeated rows are scanned each; rows without doc_id are scanned by
`scan` and left out by the query; texts of any length are scanned whole, each candidate
with at most 40 characters around it; where candidates could overlap the first one from
the left counts; an empty table gives no rows; all columns are kept, whatever their
names, and the result's column takes the name given.
"""

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import common

MARK = "\x01"
REDACTED = "[SECRET]"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<=(?i:password|passwd|pwd|secret|api_key|apikey|token)(?: ?[=:] ?[\"']?))[^\s\"'\x01]{6,}"
    r"|(?<![A-Za-z0-9+/_=.\-])(?=[A-Za-z+/_=.\-]{0,80}[0-9])[A-Za-z0-9_][A-Za-z0-9+/_=.\-]{15,}"
)
#: What a text with a candidate has in any case; scans begin at a digit or a fixed string, so other texts pass quickly.
LONG_NUMBERED = r"[0-9](?:(?=[A-Za-z0-9+/_=.\-]{8})|(?<=[A-Za-z0-9+/_=.\-]{9}))"
ASSIGNED = r"(?i)(?:password|passwd|pwd|secret|api_key|apikey|token) ?[=:]"
DICTIONARY = "about account admin after application back before build cache change check class client code common config content count current data default document error event example field file first format from function group home image index info item last level line link list local login main make message method model module name network node number object option order other output page path process project public query record release remote report request result return root script server service session source start state status string system table target temp test text there this time type update user value version view with word work world write".split()
FEATURES = ("length", "transitions", "digits", "upper", "dictionary", "path", "secret_word", "plain_word", "assigned", "quoted", "hex", "prefix", "placeholder", "distinct")
N_LABELLED = 6000
TREES, DEPTH, SEED = 15, 6, 7
_forests: dict[str, str] = {}


def feature_columns(value, left, right) -> list:
    """Numbers of a candidate, from its characters and what stands around it."""
    length = F.char_length(value).cast("double")
    share = lambda pattern: (length - F.char_length(F.regexp_replace(value, pattern, ""))) / length
    flag = lambda cond: cond.cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    lower = F.lower(value)
    return [
        length,
        F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / length,
        share("[0-9]"),
        share("[A-Z]"),
        (length - F.char_length(F.regexp_replace(lower, "(" + "|".join(DICTIONARY) + ")", ""))) / length,
        share("[/\\\\.]") + flag(left.rlike(r"[/\\]$")),
        flag(left.rlike(r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private)[^\n]{0,14}$")),
        flag(left.rlike(r"(?i)(commit|sha-?\d*|md5|checksum|hash|digest|uuid|guid|revision|etag|build|version|file|path|url|order|invoice|phone|card)[^\n]{0,14}$")),
        flag(left.rlike(r"[=:]\s?[\"']?$")),
        flag(right.rlike("^[\"']")),
        flag(value.rlike("^[0-9a-f]{32,64}$")),
        flag(value.rlike("^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|sk-|eyJ|AIza|-----BEGIN)")),
        flag(lower.rlike(r"example|xxxx|your|change.?me|dummy|sample|placeholder|0{6}|1234567")),
        F.size(F.array_distinct(F.split(value, ""))) / length,
    ]


def labelled_findings(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """Labelled findings made by rule: value, left, right and label, the same every time."""
    hexed, other = "sha2(cast(id AS string), 256)", "sha2(concat('b', id), 256)"
    b64 = f"translate(base64(unhex({hexed})), '=', '')"
    number = "cast(pmod(xxhash64(id), 9000000000000000) + 1000000000000000 AS string)"
    secret_left = "element_at(array('token = \"', 'secret: ', 'api_key=', 'password = \"', 'Authorization: Bearer ', 'access_key: \"', 'client_secret=\\'', 'auth_token = '), cast(pmod(xxhash64(id, 1), 8) AS int) + 1)"
    plain_left = "element_at(array('the ', 'in ', ' and ', '\\n', ' | ', 'see ', 'at ', '. '), cast(pmod(xxhash64(id, 2), 8) AS int) + 1)"
    hash_left = "element_at(array('commit ', 'sha256: ', 'md5=', 'checksum = \"', 'revision ', 'etag: \"', 'digest: ', 'uuid = \"'), cast(pmod(xxhash64(id, 3), 8) AS int) + 1)"
    cut = "cast(pmod(xxhash64(id, 4), 24) AS int)"
    word = f"element_at(array({', '.join(repr(w) for w in DICTIONARY)}), cast(pmod(xxhash64(id, 5), {len(DICTIONARY)}) AS int) + 1)"
    word2 = word.replace("id, 5", "id, 6")
    kinds = [
        (1, secret_left, f"left({hexed}, 40)"), (1, secret_left, f"left({hexed}, 32)"), (1, secret_left, f"left({b64}, 20 + {cut})"),
        (1, secret_left, hexed), (1, plain_left, f"concat('AKIA', upper(left({other}, 16)))"), (1, plain_left, f"concat('ghp_', left({b64}, 36))"),
        (1, plain_left, f"concat('sk_live_', left({b64}, 24))"), (1, plain_left, f"concat('eyJ', {b64}, '.', base64(unhex({other})))"),
        (1, "'password = \"'", f"left({b64}, 8 + {cut})"), (1, plain_left, "'-----BEGIN RSA PRIVATE KEY-----'"),
        (0, hash_left, f"left({hexed}, 40)"), (0, hash_left, f"left({hexed}, 32)"), (0, hash_left, hexed),
        (0, "'build '", f"concat({word}, '-', {word2}, '-', pmod(id, 97), '.', pmod(id, 13))"), (0, plain_left, f"concat({word}, '/', {word2}, '/', {word}, pmod(id, 997), '.txt')"),
        (0, plain_left, number), (0, "'order '", f"concat({number}, '-', pmod(id, 89))"), (0, secret_left, "concat('your-', 'example-token-', pmod(id, 1000))"),
        (0, "'password = \"'", "concat('xxxxxxxx', pmod(id, 10))"), (0, plain_left, f"concat({word}, '_', {word2}, '_', {word}, '_', pmod(id, 100))"),
    ]
    case = lambda k: "CASE pmod(id, 20) " + " ".join(f"WHEN {i} THEN {x[k]}" for i, x in enumerate(kinds)) + " END"
    right = "CASE WHEN pmod(id, 20) IN (0, 3, 8, 18) OR pmod(id, 7) = 0 THEN '\" ' WHEN pmod(id, 3) = 0 THEN '\\n' ELSE ' ' END"
    return spark.range(n).selectExpr(f"{case(2)} AS value", f"{case(1)} AS left", f"{right} AS right", f"{case(0)} AS label")


def forest_sql(text: str, name) -> str:
    """The votes of a forest (its debug string) as one SQL expression; name(i) is feature i."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    trees, at = [], 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return m[1]
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node()
        at += 1  # Else
        return f"CASE WHEN {name(int(m[1]))} <= {float(m[2])!r}D THEN {yes} ELSE {node()} END"

    while at < len(lines):
        if lines[at].startswith("Tree "):
            at += 1
            trees.append(f"({node()})")
        else:
            at += 1
    return f"(({' + '.join(trees)}) / {len(trees)}D)"


def train(spark: SparkSession, labelled: DataFrame | None = None) -> str:
    """The forest as SQL over an array `f` of features; trained once a process for the rule-made findings."""
    if labelled is None and "rule" in _forests:
        return _forests["rule"]
    rows = (labelled_findings(spark) if labelled is None else labelled).select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in zip(FEATURES, feature_columns(F.col("value"), F.col("left"), F.col("right")), strict=True)])
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(table)
    sql = forest_sql(model.toDebugString, lambda i: f"f[{i}]")
    if labelled is None:
        _forests["rule"] = sql
    return sql


def scan(docs: DataFrame, forest: str, text: str = "text", out: str = "scan") -> DataFrame:
    """docs with the struct `out` (a column of this name is replaced): n_candidates, findings (ordinal, sha256, length, score), redacted text."""
    parts, values, votes = common.spare_names(docs, "pieces", "numbers", "scores")
    plain = F.coalesce(F.col(text), F.lit(""))
    clear = F.translate(plain, MARK, " ")
    sign = F.contains(plain, F.lit("=")) | F.contains(plain, F.lit(":"))
    worth = plain.rlike(LONG_NUMBERED) | (sign & plain.rlike(ASSIGNED)) | F.contains(plain, F.lit("PRIVATE KEY-----"))
    marked = F.when(worth, F.regexp_replace(clear, CANDIDATE, f"{MARK}$0{MARK}")).otherwise(clear)
    pieces = docs.withColumn(parts, F.split(marked, MARK, -1))
    numbers = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(*feature_columns(p, F.right(F.get(parts, i - 1), F.lit(40)), F.left(F.get(parts, i + 1), F.lit(4))))))
    scored = pieces.withColumn(values, numbers).withColumn(votes, F.expr(f"transform({values}, f -> CASE WHEN f IS NULL THEN 0D ELSE {forest} END)"))
    found = F.filter(
        F.transform(F.arrays_zip(F.col(parts).alias("p"), F.col(votes).alias("s")), lambda x, i: F.struct(F.floor(i / 2).cast("long").alias("ordinal"), F.sha2(x["p"], 256).alias("sha256"), F.char_length(x["p"]).cast("long").alias("length"), x["s"].alias("score"))),
        lambda x: x["score"] >= 0.5,
    )
    redacted = F.when(F.size(F.filter(votes, lambda s: s >= 0.5)) == 0, F.col(text)).otherwise(F.array_join(F.transform(parts, lambda p, i: F.when(F.get(votes, i) >= 0.5, F.lit(REDACTED)).otherwise(p)), ""))
    result = F.struct(F.floor(F.size(parts) / 2).cast("long").alias("n_candidates"), found.alias("findings"), redacted.alias("redacted"))
    return scored.withColumn(out, result).drop(parts, values, votes)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    out = scan(common.keyed_texts(common.read_table(spark, sf_dir, "documents")), train(spark))
    return out.select(
        "doc_id", "scan.n_candidates", F.size("scan.findings").cast("long").alias("n_secrets"),
        F.col("scan.findings.sha256").alias("secret_sha256"), F.sha2(F.coalesce("scan.redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
