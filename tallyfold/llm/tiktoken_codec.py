"""Byte-level BPE by the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first: before a single space that stands
between two characters that aren't white space, no match of the pattern crosses.
Pieces that still hold very long runs are matched by the regex library and each match
is encoded by itself. Decoding gives raw bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows
are encoded each, equal texts alike; rows without doc_id are left out; texts of any
length are encoded whole; an empty table gives no rows; other columns are not read.
"""

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import common

#: The pattern that splits text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 20_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s{1000}")


class Codec:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    @staticmethod
    def pieces(text: str, most: int = LONG):
        """The text in pieces of about `most` characters, cut at safe boundaries."""
        at = 0
        while len(text) - at > most:
            m = _SAFE.search(text, at + most)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _encode_piece(self, text: str) -> list[int]:
        if len(text) <= 4 * LONG and not _RUN.search(text):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            ids.extend(self.encoding._encode_single_piece(m.group().encode()))
        return ids

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self._encode_piece(text)
        return [i for piece in self.pieces(text) for i in self._encode_piece(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the bytes they decode to."""

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.text]
            yield pd.DataFrame({
                "doc_id": batch.doc_id,
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            })

    return common.keyed_texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return encode_documents(common.read_table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.tiktoken"))
