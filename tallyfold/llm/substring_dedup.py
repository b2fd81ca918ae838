"""Long repeated spans across documents by De Bruijn compaction.

The graph's edges are windows of 50 words; two successive windows share a node of 49.
Each document's walk through the graph is cut into nonbranching stretches by
minimizers: successive windows with the same smallest k-mer are one stretch, about a
sixteenth as many rows as windows. Stretches are compacted by grouping equal ones over
the corpus (their first document is kept), and a join brings that back to each
occurrence, so that a stretch first seen in an earlier document is covered whole.
Where a k-mer branches (it stands in different stretches), the stretch's single
windows are expanded, at each place of its first document, and joined window by window.
The spans are cut by source coordinates: document and word offsets.

Repeats are verified at their source coordinates: a stretch's or window's identity is
its k-mer's rolling hash, made of word hashes, and the XXH64 of its very bytes, read
from each document at the words it stands at; only occurrences equal in both are covered.

Defined cases: a null text has no words; texts under 50 words lose nothing; rows
without doc_id are left out; windows repeated inside one document are kept; rows with
the same doc_id each give a row, and none is earlier than the other, so ties of doc_id
remove nothing; an empty table gives no rows; texts are read whole, and one of more than
2^27 words (over what a Spark string of such words can hold) raises ValueError; columns
of any names pass, as own columns take names that are free.
"""

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import common

WINDOW = 50
KMER = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class WordHashes:
    """64-bit hashes of words, in a bounded cache, and rolling sums over them."""

    #: Odd multiplier of the rolling sums.
    BASE = 0xD6E8FEB86659FD93

    def __init__(self, most: int = 300_000):
        self.cache: dict[bytes, int] = {}
        self.most = most
        self.size = 0
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > self.most:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w, 11)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))

    def kmers(self, words: list[bytes], k: int) -> np.ndarray:
        """Hash of the k words from each place, wherever they stand."""
        n = len(words)
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.up, self.down = _powers(self.BASE, self.size), _powers(pow(self.BASE, -1, 1 << 64), self.size)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self(words) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


class Bytes:
    """A document's words, joined by one space, and the XXH64 of any run of them."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        self.starts, self.ends = np.concatenate([[0], ends[:-1]]), ends - 1

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digests of the words start..end."""
        at, to = self.starts[start].tolist(), self.ends[end - 1].tolist()
        joined, digest = self.joined, xxhash.xxh64_intdigest
        return np.fromiter((digest(joined[a:b], 29) for a, b in zip(at, to, strict=True)), dtype=np.uint64, count=len(at))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def stretches(hasher: WordHashes, words: list[bytes], window: int = WINDOW, kmer: int = KMER):
    """Starts, counts of windows, k-mer hashes and stretch hashes of a document's walk."""
    n = len(words)
    at = np.arange(n - kmer + 1)
    key = hasher.kmers(words, kmer)
    # the smallest k-mer of each window; of equal ones the first (low bits hold its place)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = _sliding_min((key & ~low) | at.astype(np.uint64), window - kmer + 1)
    anchor = (best & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([first, [len(anchor)]]))
    place = anchor[first]
    whole = Bytes(words).digests(first, first + count - 1 + window)
    whole = (whole ^ (place - first).astype(np.uint64)) * _MIX
    return first, count, key[place].view(np.int64), whole.view(np.int64)


#: A place in a document as one number: the row's tag (31 bits), first window (27) and windows (5).
TAG_BITS, AT_BITS, COUNT_BITS = 31, 27, 5


def _tag():
    """A number of the text, which tells rows with the same doc_id apart."""
    return F.crc32(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << TAG_BITS) - 1))


def _walks(batches):
    hasher = WordHashes()
    for batch in batches:
        parts = []
        for doc, text, tag in zip(batch.doc_id, batch.text, batch.tag, strict=True):
            words = text.encode("utf-8", "replace").split()
            if len(words) >= 1 << AT_BITS:
                raise ValueError(f"document {doc} has more words than a place can number")
            if len(words) >= WINDOW:
                first, count, kmer, whole = stretches(hasher, words)
                place = ((int(tag) << AT_BITS) + first << COUNT_BITS) + count
                parts.append(pd.DataFrame({"kmer": kmer, "whole": whole, "doc_id": doc, "place": place}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def _windows(batches):
    for batch in batches:
        parts = []
        for doc, tag, text, at, n, kmer in zip(batch.doc_id, batch.tag, batch.text, batch["at"], batch.n, batch.kmer, strict=True):
            starts = np.repeat(at, n) + np.concatenate([np.arange(k) for k in n])
            win = Bytes(text.encode("utf-8", "replace").split()).digests(starts, starts + WINDOW).view(np.int64)
            parts.append(pd.DataFrame({"kmer": np.repeat(kmer, n), "win": win, "doc_id": doc, "tag": tag, "at": starts.astype(np.int32)}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def kept_words(text: str, starts: list[int], counts: list[int]) -> tuple[list[bytes], int]:
    """Words left when the windows are cut, and how many there were."""
    words = text.encode("utf-8", "replace").split()
    if starts is None or not len(starts):
        return words, len(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + np.asarray(counts) - 1 + WINDOW, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)], len(words)


def _placed(column: str) -> list:
    """tag, at and n of a place."""
    at = F.shiftright(column, COUNT_BITS).bitwiseAND(F.lit((1 << AT_BITS) - 1)).cast("int")
    return [F.shiftright(column, AT_BITS + COUNT_BITS).alias("tag"), at.alias("at"), F.col(column).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int").alias("n")]


def covered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, tag, starts, counts: the windows of each document that start in an earlier one.

    Every shuffle but the first carries only rows whose key a bitmap holds. What is
    written on the way is removed; the result is a table of its own.
    """
    texts = common.keyed_texts(docs).withColumn("tag", _tag())
    walk, walk_at = common.saved(spark, texts.mapInPandas(_walks, "kmer long, whole long, doc_id long, place long"), "walk")
    found = walk.groupBy("kmer", "whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("place", "doc_id").alias("place"), F.count("*").alias("times"))
    paths, paths_at = common.saved(spark, found, "paths")
    # stretches that stand in several documents: whole stretches of the later ones are covered
    repeated = paths.where("hi > lo").select("kmer", "whole", "lo")
    whole = common.maybe_among(walk, ["kmer", "whole"], repeated).where("__maybe").join(repeated, ["kmer", "whole"]).where("doc_id > lo").select("doc_id", *_placed("place"))
    # k-mers that branch between documents: single windows of their stretches may be shared, at each place where the first document has the stretch
    edges, edges_at = common.saved(spark, paths.groupBy("kmer").agg(F.count("*").alias("paths"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("paths > 1 and lo < hi").select("kmer"), "edges")
    forks, forks_at = common.saved(spark, common.maybe_among(paths, ["kmer"], edges).where("__maybe").drop("__maybe").join(edges, "kmer"), "forks")
    again = forks.where("times > 1").select("kmer", "whole", F.col("lo").alias("doc_id"))
    again = common.maybe_among(walk, ["kmer", "whole", "doc_id"], again).where("__maybe").join(again, ["kmer", "whole", "doc_id"])
    ends = forks.where("times = 1").select(F.col("lo").alias("doc_id"), "place", "kmer").union(again.select("doc_id", "place", "kmer")).select("doc_id", *_placed("place"), "kmer")
    ends = ends.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n", "kmer")).alias("e")).select("doc_id", "tag", F.col("e.at").alias("at"), F.col("e.n").alias("n"), F.col("e.kmer").alias("kmer"))
    ends, ends_at = common.saved(spark, ends, "ends")
    near = common.maybe_among(texts, ["doc_id"], ends).where("__maybe").drop("__maybe").join(ends, ["doc_id", "tag"])
    singles, singles_at = common.saved(spark, near.mapInPandas(_windows, "kmer long, win long, doc_id long, tag long, at int"), "windows")
    seen = singles.groupBy("kmer", "win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("hi > lo").select("kmer", "win", "lo")
    parts = singles.join(seen, ["kmer", "win"]).where("doc_id > lo").select("doc_id", "tag", "at", F.lit(1).alias("n"))
    spans = whole.union(parts).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("w"))
    out, _ = common.saved(spark, spans.select("doc_id", "tag", F.col("w.at").alias("starts"), F.col("w.n").alias("counts")), "spans")
    common.remove(spark, walk_at, paths_at, edges_at, forks_at, ends_at, singles_at)
    return out


def cut(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the starts and counts of the windows to cut (null: none), and the names of these two columns.

    Only documents that may have such windows are joined with them.
    """
    doc, tag, own, maybe, starts, counts = common.spare_names(docs, "span_doc", "span_tag", "own_tag", "maybe", "starts", "counts")
    spans = covered(spark, docs).toDF(doc, tag, starts, counts)
    held = common.maybe_among(docs.withColumn(own, _tag()), ["doc_id"], spans.select(F.col(doc).alias("doc_id")), maybe)
    some = held.where(F.col(maybe)).join(spans, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(tag)), "left")
    none = held.where(~F.col(maybe)).withColumn(starts, F.lit(None).cast("array<int>")).withColumn(counts, F.lit(None).cast("array<int>"))
    columns = [*docs.columns, starts, counts]
    return some.select(*columns).union(none.select(*columns)), starts, counts


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.keyed_texts(common.read_table(spark, sf_dir, "documents"))
    held, starts, counts = cut(spark, docs)

    def run(batches):
        for batch in batches:
            rows = [kept_words(*x) for x in zip(batch.text, batch[starts], batch[counts], strict=True)]
            yield pd.DataFrame({
                "doc_id": batch.doc_id,
                "n_words": [n for _, n in rows],
                "n_removed": [n - len(k) for k, n in rows],
                "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in rows],
            })

    return held.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS pos FROM words WHERE len(w) >= 50),
wins AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 49], ' ') AS win FROM starts),
hit AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS lo FROM wins) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS i FROM hit),
single AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM single e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
