"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

A fingerprint of 64 bits is cut into blocks; fingerprints at most `distance` bits apart
leave at least blocks - distance blocks untouched, so they share one of the keys made of
so many blocks, rows join on these keys, and the Hamming distance is verified. The
number of blocks follows the number of distinct fingerprints, so that a key holds few
chance neighbours at any size (`blocks_for`); the links found are the same for any number.

Equal fingerprints are one node. Each bucket has a centre, and a node is held against
two of its buckets' centres at most (a star), a few times with other centres; only
buckets that then still hold several components are joined, with the distance in the
join, and only nodes outside the bucket's smallest component are held against the
others. No link between different components is missed, and no group's pairs are all
formed.

`near_duplicates` links by the one fingerprint of 4-word shingles. `near_copies` is made
for copies of five-word similarity 0.8 and more, which differ in too many bits of one
such fingerprint: three fingerprints of a text's distinct words propose pairs, and a
wide one of its distinct five-word shingles (1,024 bits) verifies them by Hamming distance.
With `exact` the wide one only leaves out clear strangers, and the similarity of the two
sets of shingles decides, so that no pair below 0.8 links. But where a large group's
texts are mostly a little less similar than that to each other, its pairs are all held
against each other: their number grows with the square of such a group, so `exact` is for
corpora without one.

Defined cases: a null text is empty and has fingerprint zero, which links like any
other; rows without doc_id are left out; repeated rows give repeated result rows, and a
group's id is its smallest doc_id, so ties can't occur; an empty table gives no rows;
texts of any length are read whole, in slices of bounded memory; other columns are not
read. A text of fewer than five words is one shingle. Texts with equal fingerprints and
equal wide ones (1,216 bits) are one node. Different texts under one doc_id are one node's.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from operator import add, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import common

SHINGLE = 4
DISTANCE = 4
LEAST_BLOCKS = 7
#: Star rounds, each with another centre a bucket (the first: its smallest node), before buckets are joined.
CENTRES = (0, -1, 0x5555555555555555)
#: Fingerprints of distinct words, longs of the wide fingerprint, words of its shingles.
PROPOSING, WIDE, WIDE_SHINGLE = 3, 16, 5
#: Least similarity of the sets of five-word shingles.
LEAST = 0.8


def wide_bits(least: float = LEAST, spare: float = 0.43) -> int:
    """Bits of the wide fingerprint in which texts of this similarity differ on average (by the angle of their sets), and `spare` standard deviations."""
    p = float(np.arccos(2 * least / (1 + least))) / np.pi
    return round(64 * WIDE * p + spare * (64 * WIDE * p * (1 - p)) ** 0.5)


def even_blocks(n: int) -> list[tuple[int, int]]:
    """64 bits cut into n blocks of nearly equal size: (first bit, bits)."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Blocks at which a key of the untouched ones holds a quarter of a chance neighbour at most, of n fingerprints."""
    blocks = max(LEAST_BLOCKS, distance + 3)
    while blocks < 32 and n > 1 << ((blocks - distance) * (64 // blocks) - 2):
        blocks += 1
    return blocks


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks that keep blocks - distance whole blocks, as signed 64-bit numbers."""
    single = [((1 << n) - 1) << at for at, n in even_blocks(blocks)]
    masks = [sum(c) for c in combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _majority(h: np.ndarray, step: int = 255 * 16) -> np.ndarray:
    """Of 64-bit hashes (n, lanes): the bits set in over half the rows, one number a lane."""
    n, lanes = h.shape
    counts = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, n, step):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + step]).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")


def simhash(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    return int(_majority(h[:, None])[0])


_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, PROPOSING + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Independent hashes of each number, one a multiplier."""
    x = (h[:, None] ^ (h[:, None] >> np.uint64(31))) * odd[None, :]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Signatures:
    """PROPOSING fingerprints of a text's distinct words and WIDE longs of its distinct five-word shingles."""

    def __init__(self, most: int = 300_000):
        self.cache: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(PROPOSING + WIDE, dtype=np.int64)
        h = self.hashes(words)
        parts = [self._fold(np.unique(h), _ODD[:PROPOSING]), self._fold(self.shingles(h), _ODD[PROPOSING:])]
        return np.concatenate(parts).view(np.int64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > self.most:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            self.cache[w] = xxhash.xxh64_intdigest(w, 42)
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def shingles(h: np.ndarray) -> np.ndarray:
        """Distinct hashes of the five-word shingles of words with the hashes h; of fewer words, of all of them."""
        if not len(h):
            return h
        k = min(WIDE_SHINGLE, len(h))
        s = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            s = (s ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        return np.unique(s)

    @staticmethod
    def _fold(h: np.ndarray, odd: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        if len(h) <= step:
            return _majority(_mixed(h, odd))
        # long texts: the lanes one after the other
        return np.concatenate([_majority(_mixed(h, odd[i : i + 1])) for i in range(len(odd))])


@dataclass(frozen=True)
class Rule:
    """Nodes link if one of the fingerprints `prints` is at most `distance` bits apart, the `wide` ones together at most `most`, and the check holds.

    The check takes a function that saves a table until the search ends, and pairs (x_node, y_node and more); it gives the pairs that hold.
    """

    prints: tuple[str, ...]
    distance: int = DISTANCE
    wide: tuple[str, ...] = field(default=())
    most: int = 0
    check: Callable[[Callable, DataFrame], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return [*self.prints, *self.wide]

    def near(self, a: str, b: str) -> Column:
        """The condition for columns with the prefixes a and b."""
        apart = lambda c: F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
        found = reduce(or_, [apart(c) <= self.distance for c in self.prints])
        return found & (reduce(add, map(apart, self.wide)) <= self.most) if self.wide else found


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node reachable.

    Labels spread from neighbours and then jump to the label of the label, so long
    chains take few rounds. Each round is written to the checkpoint folder.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    for _ in range(rounds):
        hooked = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        labels = labels.join(hooked, labels.label == hooked.root, "left").select("node", F.coalesce("root_label", "label").alias("label"))
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        # what a node has seen also goes to its own label, so that whole components hook at once
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("seen"))
        roots = step.groupBy("label").agg(F.min("seen").alias("best"))
        labels_next = step.join(roots, "label").select("node", F.least("seen", "best").alias("next"), "label").checkpoint()
        changed = labels_next.where("next <> label").limit(1).count()
        labels = labels_next.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _keys(nodes: DataFrame, rule: Rule, blocks: int) -> DataFrame:
    """node and k, a hash of the mask's number and the blocks it keeps; a chance collision is told by the distance."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, rule.distance)])
    prints = nodes.select("node", F.posexplode(F.array(*rule.prints)).alias("s", "fp"))
    held = prints.select("node", "s", "fp", F.posexplode(masks).alias("t", "mask"))
    return held.select("node", F.xxhash64("s", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{c}" for c in df.columns])


class _Search:
    """The state of one search: nodes with their labels, and the rows (k, node) of buckets still looked at."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, rule: Rule):
        self.spark, self.rule = spark, rule
        self.nodes = nodes.select("node", "label", *rule.columns)
        self.held: DataFrame | None = None
        self.tables: list[str] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        table, path = common.saved(self.spark, df, name)
        self.tables.append(path)
        return table

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Labels (a, b) of the pairs (node, c) of different labels that are near."""
        some = common.maybe_among(self.nodes, ["node"], pairs.select(F.explode(F.array("node", "c")).alias("node"))).where("__maybe").drop("__maybe")
        left, right = _prefixed(some, "x_"), _prefixed(some, "y_")
        both = pairs.join(left, F.col("node") == F.col("x_node")).join(right, F.col("c") == F.col("y_node"))
        return self.linked(both.where((F.col("x_label") != F.col("y_label")) & self.rule.near("x_", "y_")))

    def linked(self, near: DataFrame) -> DataFrame:
        """Labels (a, b) of the near pairs for which the rule's check holds."""
        labels = [F.col("x_label").alias("a"), F.col("y_label").alias("b")]
        if self.rule.check is None:
            return near.select(*labels).distinct()
        pairs = self.saved(near.select("x_node", "y_node", *labels).distinct(), "near")
        return pairs.select("a", "b") if pairs.isEmpty() else self.rule.check(self.saved, pairs).select("a", "b").distinct()

    def relabel(self, edges: DataFrame) -> None:
        merged = connected(edges).select(F.col("node").alias("old"), F.col("label").alias("new"))
        held = self.nodes.join(merged, F.col("label") == F.col("old"), "left")
        self.nodes = self.saved(held.withColumn("label", F.coalesce("new", "label")).drop("old", "new"), "labelled")

    def star(self, mask: int) -> bool:
        """Holds the nodes of each bucket with several labels against one of them; false if there is no such bucket."""
        flip = F.lit(mask).cast("long")
        members = self.held.join(self.nodes.select("node", "label"), "node")
        mixed = members.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.col("node").bitwiseXOR(flip)).bitwiseXOR(flip).alias("c"))
        mixed = self.saved(mixed.where("low < high").select("k", "c"), "mixed")
        if mixed.isEmpty():
            return False
        self.hold(self.saved(self.held.join(mixed, "k"), "open"))
        return True

    def hold(self, open_: DataFrame) -> None:
        """Holds the nodes of buckets (k, node and the bucket's centre c) against their centres."""
        self.held = open_.select("k", "node")
        # a node in many buckets is held against the first and the last of its centres alone; the rest is for the rounds to come
        ends = open_.where("node <> c").groupBy("node").agg(F.min("c").alias("first"), F.max("c").alias("last"))
        self.relabel(self.verified(ends.select("node", F.explode(F.array_distinct(F.array("first", "last"))).alias("c"))))

    def cross(self) -> None:
        """Joins what is left: nodes outside a bucket's smallest label with those of smaller labels."""
        members = self.saved(self.held.join(self.nodes, "node"), "members")
        left, right = _prefixed(above_lowest(members), "x_"), _prefixed(members, "y_")
        pairs = left.join(right, (F.col("x_k") == F.col("y_k")) & (F.col("y_label") < F.col("x_label")) & self.rule.near("x_", "y_"))
        self.relabel(self.linked(pairs))


def above_lowest(members: DataFrame) -> DataFrame:
    """The rows (k, label and more) whose label isn't the smallest of their bucket k; a bucket of one label has none."""
    lows = members.groupBy(F.col("k").alias("bucket")).agg(F.min("label").alias("low"))
    return members.join(lows, (F.col("k") == F.col("bucket")) & (F.col("label") > F.col("low"))).drop("bucket", "low")


def component_table(spark: SparkSession, nodes: DataFrame, rule: Rule, blocks: int | None = None) -> DataFrame:
    """nodes (a written table of node and the rule's columns) with component, the smallest node reachable.

    Only the first look at the buckets shuffles all keys; keys that a bitmap shows to
    stand alone go no further.
    """
    keyed = _keys(nodes, rule, blocks or blocks_for(nodes.count(), rule.distance))
    search = _Search(spark, nodes.withColumn("label", F.col("node")), rule)
    # the first star needs no further look: every label is a node's own, so every shared bucket is mixed, and its smallest node is the centre
    found = keyed.groupBy("k").agg(F.min("node").alias("c"), F.max("node").alias("last")).where("c < last").select("k", "c")
    shared = search.saved(found, "shared")
    search.hold(search.saved(common.maybe_among(keyed, ["k"], shared).where("__maybe").join(shared, "k").select("k", "node", "c"), "buckets"))
    for mask in CENTRES[1:]:
        if not search.star(mask):
            break
    else:
        search.cross()
    out = search.nodes.withColumnRenamed("label", "component").checkpoint()
    common.remove(spark, *search.tables)
    return out


def _grouped(spark: SparkSession, prints: DataFrame, rule: Rule) -> DataFrame:
    """prints (doc_id and the rule's columns) with component_id, the smallest doc_id reachable."""
    nodes, nodes_at = common.saved(spark, prints.groupBy(*rule.columns).agg(F.min("doc_id").alias("node")), "nodes")
    # a checkpoint brings no partitioning along that would keep a large group in one task
    parts = component_table(spark, nodes, rule).select(F.col("component").alias("component_id"), *rule.columns)
    common.remove(spark, nodes_at)
    return prints.join(parts, rule.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable)."""
    common.prepare(spark)

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t, shingle) for t in batch.text], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch.doc_id, "fp": fp.view(np.int64)})

    prints = common.keyed_texts(docs).mapInPandas(run, "doc_id long, fp long").checkpoint()
    return _grouped(spark, prints, Rule(("fp",), distance)).select("doc_id", "fp", "component_id")


def similar(texts: DataFrame, least: float = LEAST) -> Callable[[Callable, DataFrame], DataFrame]:
    """A rule's check: the pairs whose texts have at least this similarity of their sets of five-word shingles.

    Only texts that a bitmap shows to be in a pair are read into sets, and only sets are shuffled. Shingles are compared by 64-bit hashes.
    """

    def run(batches):
        make = Signatures()
        for batch in batches:
            sets = [make.shingles(make.hashes(t.encode("utf-8", "replace").lower().split())).view(np.int64) for t in batch.text]
            yield pd.DataFrame({"node": batch.doc_id, "shingles": sets})

    def check(saved: Callable, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("x_node", "y_node")).alias("doc_id"))
        some = common.maybe_among(texts.select("doc_id", "text"), ["doc_id"], ends).where("__maybe").select("doc_id", "text")
        sets = saved(some.mapInPandas(run, "node long, shingles array<long>"), "shingles")
        held = pairs.join(_prefixed(sets, "x_"), "x_node").join(_prefixed(sets, "y_"), "y_node")
        both, sizes = F.size(F.array_intersect("x_shingles", "y_shingles")), F.size("x_shingles") + F.size("y_shingles")
        return held.withColumn("both", both).where(F.col("both") >= least * (sizes - F.col("both")))

    return check


def near_copies(spark: SparkSession, docs: DataFrame, least: float = LEAST, distance: int = DISTANCE, exact: bool = False) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, to tell rows with one doc_id apart), component_id (smallest doc_id reachable)."""
    common.prepare(spark)
    texts = common.keyed_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    rule = Rule(tuple(f"f{i}" for i in range(PROPOSING)), distance, tuple(f"w{i}" for i in range(WIDE)), wide_bits(least, 2.5) if exact else wide_bits(least), similar(texts, least) if exact else None)
    columns = rule.columns

    def run(batches):
        make = Signatures()
        for batch in batches:
            out = pd.DataFrame(np.array([make(t) for t in batch.text], dtype=np.int64).reshape(-1, PROPOSING + WIDE), columns=columns)
            out.insert(0, "doc_id", batch.doc_id.to_numpy())
            out.insert(1, "text_hash", batch.text_hash.to_numpy())
            yield out

    schema = "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in columns)
    return _grouped(spark, texts.mapInPandas(run, schema).checkpoint(), rule).select("doc_id", "text_hash", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, common.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
