"""Shared helpers of the corpus operators: reading, shared storage, word-level BPE."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A folder with the tokenizer files; where it is not set, the installed package's own path is taken.
TOKENIZER_DIR = os.environ.get("TALLYFOLD_TOKENIZERS")
#: Whitespace for Python's split() that the tokenizer's pattern doesn't treat as whitespace.
_ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Rows a Python worker holds at once; documents may be long.
ARROW_ROWS = 256


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return os.path.join(TOKENIZER_DIR, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches for the session's Python stages, and a checkpoint folder.

    A local session that names no folder gets a temporary one; on a cluster that would lie on one
    machine's disk, so there the session must name it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyfold-"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    prepare(spark)
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is empty, a row without doc_id is left out."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))


def saved(spark: SparkSession, df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and the table's path."""
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes tables written by saved() once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: 64-bit words of a key bitmap; it is broadcast, and is never larger than this.
BITMAP_WORDS = 1 << 17


def _bit(keys) -> tuple:
    h = F.xxhash64(*keys)
    return h.bitwiseAND(F.lit(BITMAP_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))


def maybe_among(df: DataFrame, keys: list[str], others: DataFrame, flag: str = "__maybe") -> DataFrame:
    """df with a boolean `flag`: false where the keys are surely not in `others`.

    Rows that can't match then need no shuffle; the join that follows is exact. The
    bitmap has BITMAP_WORDS rows at most, whatever the size of `others`.
    """
    word, bit = _bit(keys)
    own, words, bits = spare_names(df, "__own_word", "__word", "__bits")
    bitmap = others.select(word.alias(words), bit.alias("__bit")).groupBy(words).agg(F.bit_or("__bit").alias(bits))
    held = df.withColumn(own, word).join(F.broadcast(bitmap), F.col(own) == F.col(words), "left")
    return held.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).drop(own, words, bits)


#: The word-end vocabulary's pattern between white space, over characters up to U+024F in lower case.
_PIECE = re.compile(
    r"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\s\xa0\x85a-z0-9\xaa\xb2\xb3\xb5\xb9-\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-ɏ]+"
)
_BEYOND = re.compile("[ɐ-\U0010ffff\x1c-\x1f]")


class _Index(dict):
    """Numbers keys as they are first looked up, and keeps the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordBpe:
    """Ids of the word-end BPE, by a bounded cache of the pieces its pattern cuts.

    The pattern never matches white space, so a text's ids are those of its pieces one
    after the other. New pieces are encoded together, joined by spaces; each ends with
    a token that has the word-end mark. Words with characters beyond U+024F, whose case
    or normal form may be less plain, are encoded one by one, and texts with the
    characters that only Python takes for white space as they are.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # plain pieces are lower case and whole already
        plain = json.loads(self.tokenizer.to_str())
        plain["normalizer"] = None
        plain["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int64)

    def _add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        at = np.fromiter(map(self.index.__getitem__, keys), dtype=np.int64, count=len(keys))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at] = lengths
        self.used += len(ids)

    def _learn(self, keys: list[str], step: int = 256) -> None:
        for k in range(0, len(keys), step):
            some = keys[k : k + step]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._add(some, ids, np.diff(ends, prepend=0))
            else:
                self._learn_each(some)

    def _learn_each(self, keys: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([k.removeprefix(" ") for k in keys], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self._add(keys, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum())), lengths)

    @staticmethod
    def _keys(text: str) -> list[str]:
        """The pieces of a text; a word that isn't plain is one key, with a space before it, and so is such a text."""
        if not _BEYOND.search(text):
            return _PIECE.findall(text.lower())
        if any(c in text for c in _ODD_SPACES):
            return [" " + text]
        out: list[str] = []
        for word in text.split():
            out.extend([" " + word] if _BEYOND.search(word) else _PIECE.findall(word.lower()))
        return out

    def encode_many(self, texts) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > self.most:
            self._clear()
        find, places, out = self.index.__getitem__, [], []
        for text in texts:
            keys = self._keys(text)
            places.append(np.fromiter(map(find, keys), dtype=np.int64, count=len(keys)))
        if new := self.index.new:
            self._learn([k for k in new if k[0] != " "])
            if odd := [k for k in new if k[0] == " "]:
                self._learn_each(odd)
            self.index.new.clear()
        for at in places:
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            out.append(self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """The process's own encoder: a worker's tasks share the pieces it has learned, whose number is bounded."""
    return WordBpe(path)
