"""Homomorphic multiset fingerprints of documents, by SQL functions alone.

A text is the multiset of its paragraphs: lines, cut further at sentence ends and at
160 characters, trimmed. Each is hashed to a wide vector; a text's fingerprint is the
sum of the vectors modulo powers of two. So the order of paragraphs doesn't matter,
and a fingerprint after adding or taking away a paragraph is a sum or difference.
Eight 32-bit lanes serve equality; 128 lanes count set hash bits, 64 longs of
two 32-bit counters, and serve likeness: the cosine of the lanes' signed sums, which
estimates the cosine of the multisets (standard error about 0.09).

Defined cases: a null text is empty; an empty text, or one of white space, is the empty
multiset (all lanes zero) and is like another such text with 1, like others with 0;
rows without doc_id are left out; rows with the same doc_id are ordered by their text;
a table of one row has itself as next document; an empty table gives no rows; texts of
any length are hashed whole; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm import common

#: A paragraph: up to 160 characters to a line's or sentence's end, or leading stops.
PARAGRAPH = r"[^\n.!?|]{1,160}[.!?|]*|[.!?|]+"
SEEDS = (0, 1, 2, 3)
MOD32 = (1 << 32) - 1
ROWS_PER_BUCKET = 4096
#: Shares of doc_id by quantiles, and of each share by its own: at most COARSE * FINE buckets, and so many numbers broadcast.
COARSE, FINE = 256, 1024
#: Tasks at most that buckets are dealt to.
LANES = 8192


def paragraphs(text: str | Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the struct `out`: n, eq (eight sums mod 2^32), bits (64 longs of two counts)."""
    hashed = df.withColumn(f"{out}__p", paragraphs(text))

    def seeded(s):
        return F.transform(f"{out}__p", lambda p: F.xxhash64(p, F.lit(s)))

    for s in SEEDS:
        hashed = hashed.withColumn(f"{out}__h{s}", seeded(s))

    def low(h):
        return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: (acc + x.bitwiseAND(F.lit(MOD32))).bitwiseAND(F.lit(MOD32)))

    def high(h):
        return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: (acc + F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(MOD32)))

    def counts(h, i):
        return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, i).bitwiseAND(F.lit((1 << 32) + 1)))

    h = [F.col(f"{out}__h{s}") for s in SEEDS]
    vector = F.struct(
        F.size(f"{out}__p").cast("long").alias("n"),
        F.array(*[f(x) for x in h for f in (low, high)]).alias("eq"),
        F.array(*[counts(x, i) for x in h[:2] for i in range(32)]).alias("bits"),
    )
    return hashed.withColumn(out, vector).drop(f"{out}__p", *[f"{out}__h{s}" for s in SEEDS])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets together (sign 1) or of a without b (sign -1)."""
    eq = F.zip_with(a["eq"], b["eq"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(MOD32)))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), eq.alias("eq"), F.zip_with(a["bits"], b["bits"], lambda x, y: x + sign * y).alias("bits"))


def as_text(v: Column) -> Column:
    """Hex of the eight equality lanes, the number of paragraphs, and the counts mod 2^16."""
    hex8 = lambda x: F.lpad(F.hex(x), 8, "0")
    eq = F.array_join(F.transform(v["eq"], hex8), "")
    packed = lambda p: F.shiftleft(F.shiftrightunsigned(p, 32).bitwiseAND(F.lit(65535)), 16).bitwiseOR(p.bitwiseAND(F.lit(65535)))
    bits = F.array_join(F.transform(v["bits"], lambda p: hex8(packed(p))), "")
    return F.lower(F.concat(eq, hex8(v["n"]), bits))


def likeness(a: Column, b: Column) -> Column:
    def dot(x, y):
        def lanes(p, q):
            lo = (2 * p.bitwiseAND(F.lit(MOD32)) - x["n"]).cast("double") * (2 * q.bitwiseAND(F.lit(MOD32)) - y["n"])
            hi = (2 * F.shiftrightunsigned(p, 32) - x["n"]).cast("double") * (2 * F.shiftrightunsigned(q, 32) - y["n"])
            return lo + hi

        return F.aggregate(F.zip_with(x["bits"], y["bits"], lanes), F.lit(0.0), lambda acc, z: acc + z)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a["eq"] == b["eq"], F.lit(1.0)).when(size <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size)))


def _slot(value: Column, edges: Column) -> Column:
    """How many of the sorted edges, but the first, are not above the value."""
    return F.size(F.filter(edges, lambda b: b <= value))


def with_buckets(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts with a bucket number, and how many buckets there are; it never falls as doc_id grows, about ROWS_PER_BUCKET rows a bucket however doc_id is spread.

    Quantiles of doc_id cut the table into shares, and each share's own quantiles cut it
    into buckets; each step is one aggregation of sketches, and only quantiles are broadcast.
    """
    n = texts.count()
    wanted = -(-n // ROWS_PER_BUCKET)
    if wanted < 2:
        return texts.withColumn("bucket", F.lit(0).cast("long")), 1
    shares = min(COARSE, wanted)
    fine = min(FINE, -(-wanted // shares))
    cuts = lambda k: [i / k for i in range(1, k)]
    edges = sorted(set(texts.agg(F.percentile_approx("doc_id", cuts(shares), 20 * shares + 1000)).first()[0]))
    coarse = texts.withColumn("share", _slot(F.col("doc_id"), F.lit(edges)))
    if fine < 2:
        return coarse.withColumn("bucket", F.col("share").cast("long")).drop("share"), shares
    inner = coarse.groupBy(F.col("share").alias("of")).agg(F.percentile_approx("doc_id", cuts(fine), 20 * fine + 1000).alias("edges"))
    held = coarse.join(F.broadcast(inner), F.col("share") == F.col("of"))
    return held.withColumn("bucket", F.col("share").cast("long") * fine + _slot(F.col("doc_id"), F.array_distinct("edges"))).drop("share", "of", "edges"), shares * fine


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, v and next_text, next_v of the next document in descending doc_id order (the first after the last).

    Rows are dealt by ranges of doc_id; the largest row of each bucket is also given,
    as a guest, to the bucket before it in order, so no bucket needs another's rows.
    """
    texts = common.keyed_texts(docs)
    dealt, buckets = with_buckets(texts)
    lanes = min(buckets, LANES)
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    # one row a bucket, at most COARSE * FINE, passes one task
    order = Window.orderBy("bucket")
    heads = heads.select("head", F.lead("bucket").over(order).alias("up"), F.first("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"))
    heads = heads.select("head", F.coalesce("up", "lowest").alias("guest_of"), F.when(F.col("up").isNull(), 2).otherwise(1).alias("guest"))
    own = dealt.withColumn("guest", F.lit(0))
    guests = common.maybe_among(texts.withColumnRenamed("doc_id", "head"), ["head"], heads).where("__maybe").join(heads, "head")
    placed = own.union(guests.select(F.col("head").alias("doc_id"), "text", F.col("guest_of").alias("bucket"), "guest"))
    # a bucket a task, as far as there are so many tasks; the window takes the rows as they are dealt
    dealt = placed.withColumn("lane", F.pmod("bucket", F.lit(lanes)).cast("int")).repartitionById(lanes, "lane")
    vectors = with_vector(dealt, "text", "v")
    w = Window.partitionBy("lane", "bucket").orderBy("guest", F.desc("doc_id"), "text")
    return vectors.select("doc_id", "text", "v", "guest", F.lead("text").over(w).alias("next_text"), F.lead("v").over(w).alias("next_v")).where("guest = 0").drop("guest")


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = with_next(common.read_table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half))).drop("text", "next_text")
    out = with_vector(edited, "edited", "e")
    v, e, x = F.col("v"), F.col("e"), F.col("next_v")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(v).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        likeness(v, e).alias("near_edited"), likeness(v, x).alias("near_next"),
    )
