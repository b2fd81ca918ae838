"""Very long texts and ties for every query: whole texts are used, equal texts are told apart by doc_id alone."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyfold.llm import common, registry, tiktoken_codec
from tests.llm import helpers
from tests.llm.test_text_operators import brute_components, brute_cut, brute_simhash, n_sequences

LONG = 120_000


@pytest.fixture(scope="module")
def data():
    r = random.Random(17)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ra", "lo", "mi", "tu", "12", "é")]
    text = " ".join(r.choice(words) for _ in range(LONG)) + " the end"
    same = " ".join(r.choice(words) for _ in range(120))
    tail = " ".join(text.split()[-200:])
    return [(5, text, "en", "s", None), (7, text, "en", "s", None), (9, tail, "en", "s", None), (2, same, "en", "s", None), (3, same, "en", "s", None), (11, same, "en", "s", None), (1, "", "en", "s", 0), (4, "", "en", "s", 0)]


@pytest.fixture(scope="module")
def got(spark, data, tmp_path_factory):
    folder = helpers.write(spark, tmp_path_factory.mktemp("long"), data, [(d[0], i % 2, i % 2) for i, d in enumerate(data)])
    return {name.split("_")[0]: query(spark, folder).collect() for name, query in registry.QUERIES.items()}


def test_scores_of_ties_are_equal(got):
    for op in ("op1", "op3"):
        score = {r.doc_id: r.score for r in got[op]}
        assert score[5] == score[7] and score[2] == score[3] == score[11] and score[1] == score[4] and all(0 <= s <= 1 for s in score.values())


def test_spans_of_long_texts(got, data):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got["op2"]} == brute_cut(data)
    assert {r.doc_id: r.n_removed for r in got["op2"]}[9] == 200


def test_tokens_of_long_texts(got, data):
    tok = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    codec = tiktoken_codec.Codec(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    at = 0
    for d, t, *_ in sorted(data):
        ids = tok.encode(t, add_special_tokens=False).ids
        whole, packed = np.array([*ids, 1], dtype="<u4"), np.array([*ids, 0], dtype="<u4")
        assert [(r.start, r.n_tokens, r.ids_crc32) for r in got["op9"] if r.doc_id == d] == [(at, len(whole), zlib.crc32(whole.tobytes()))]
        at += len(whole)
        assert sorted((r.start, r.ids_crc32) for r in got["op4"] if r.doc_id == d) == [(a, zlib.crc32(packed[a : a + 2048].tobytes())) for a in range(0, len(packed), 2048)]
        own = codec.encoding.encode_ordinary(t)
        assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got["op5"] if r.doc_id == d] == [(len(own), hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())]
    assert n_sequences(got["op4"]) == -(-sum(r.length for r in got["op4"]) // 2048)


def test_fingerprints_of_long_texts(got, data):
    prints = {d: brute_simhash(t) for d, t, *_ in data}
    parts = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got["op7"]} == {d: (f"{p:016x}", parts[d]) for d, p in prints.items()}
    by = {r.doc_id: r for r in got["op10"]}
    assert by[5].fingerprint == by[7].fingerprint != by[9].fingerprint and by[2].fingerprint == by[3].fingerprint == by[11].fingerprint
    assert all(by[d].n_chars == len(t) for d, t, *_ in data) and by[3].near_next == 1 and by[4].near_next < 1


def test_media_and_scans_of_long_texts(got, data):
    by = {r.doc_id: r for r in got["op8"]}
    for d, t, *_ in data:
        raw = t.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (by[d].n_bytes, by[d].payload_sha256) == (len(raw), hashlib.sha256(padded).hexdigest())
    assert by[5].feature == by[7].feature and by[1].media_sha256 == by[4].media_sha256
    assert {r.doc_id: r.redacted_sha256 for r in got["op6"]} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t, *_ in data}
