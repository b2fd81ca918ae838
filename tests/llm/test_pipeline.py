import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyfold.llm import common, simhash
from tests.llm import helpers
from tests.llm.test_text_operators import brute_cut

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == columns
    assert sum(labels[d] == 1 for d in kept if d in labels) <= 0.05 * sum(v == 1 for v in labels.values())
    assert sum(labels[d] == 0 for d in kept if d in labels) >= 0.99 * sum(v == 0 for v in labels.values())

    before = docs.collect()
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == columns
    kept = {r.doc_id for r in out.collect()}
    exact, near = brute_near([(r.doc_id, r.text) for r in before])
    assert kept.isdisjoint(d for d in exact if exact[d] != d)
    gone = {d for d in near if near[d] != d}
    assert len(gone & kept) <= 0.1 * len(gone)
    # what goes is a copy of something: it shares half its shingles with a document at least
    assert all(d in kept or best_similarity(d, {r.doc_id: r.text for r in before}) > 0.6 for d in exact if exact[d] == d and near[d] == d)

    out = corpus_pipeline.cut_repeated_spans(spark, docs, SF)
    want = brute_cut([(r.doc_id, r.text) for r in before])
    assert out.columns == columns
    texts = {r.doc_id: r.text for r in before}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        assert (r.text == texts[r.doc_id]) if want[r.doc_id][1] == 0 else (len(r.text.encode().split()) == want[r.doc_id][0] - want[r.doc_id][1])

    out = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert out.columns == columns
    for r in out.collect():
        assert r.text == texts[r.doc_id] or "[SECRET]" in r.text
        assert 'token = "' not in r.text or '[SECRET]"' in r.text


def five(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_near(docs, least=0.8):
    """For each doc_id the smallest of its exact copies, and of its group by five-word similarity."""
    shingles = {d: five(t) for d, t in docs}
    first, exact, holders = {}, {}, {}
    for d, t in sorted(docs):
        exact[d] = first.setdefault(" ".join((t or "").lower().split()), d)
        for x in shingles[d]:
            holders.setdefault(x, []).append(d)
    label = dict(exact)

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for d, _ in docs:
        counts = {}
        for x in shingles[d]:
            for o in holders[x]:
                counts[o] = counts.get(o, 0) + 1
        for o, n in counts.items():
            if o < d and n / (len(shingles[d]) + len(shingles[o]) - n) >= least:
                x, y = sorted((root(d), root(o)))
                label[y] = x
    return exact, {d: root(d) for d, _ in docs}


def best_similarity(d, texts):
    mine = five(texts[d])
    if not mine:
        return 1.0
    return max(len(mine & o) / len(mine | o) for e, t in texts.items() if e != d and (o := five(t)))


def test_near_copies_by_similarity(spark):
    """Of edited copies with similarity 0.8 and more at least nine in ten meet; texts below 0.6 and unrelated ones never do."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs, want = [], {}
    for k in range(120):
        w = [r.choice(words) for _ in range(r.choice([60, 150, 400]))]
        docs.append((1000 * k, " ".join(w)))
        for j, rate in enumerate((0.005, 0.01, 0.015, 0.08, 0.15)):
            c = [r.choice(words) if r.random() < rate else x for x in w]
            docs.append((1000 * k + j + 1, " ".join(c)))
            a, b = five(" ".join(w)), five(" ".join(c))
            want[1000 * k + j + 1] = len(a & b) / len(a | b)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark, frame).collect()}
    close = [d for d, j in want.items() if j >= 0.8]
    assert len(close) > 200
    assert np.mean([got[d] == d // 1000 * 1000 for d in close]) >= 0.9
    assert all(got[d] // 1000 == d // 1000 for d, _ in docs)
    assert all(got[d] == d for d, j in want.items() if j < 0.6)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark, frame, exact=True).collect()}
    _, near = brute_near(docs)
    assert np.mean([got[d] == d // 1000 * 1000 for d in close]) >= 0.95
    assert all(near[got[d]] == near[d] for d, _ in docs)


def test_similarity_decides_at_the_threshold(spark):
    """Of 24 distinct shingles 20 in common with 22 and 22 hold 20 / 24 >= 0.8; one word further in, 15 / 29 don't. Short, empty and null texts too."""
    w = [f"w{i}" for i in range(26)]
    texts = [" ".join(w), " ".join([*w[:24], "x", "y"]), " ".join([*w[:12], "z", *w[13:]]), "one two", "two one", "One  two", "", None]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark, docs, exact=True).collect()}
    _, near = brute_near(list(enumerate(texts, 1)))
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4, 7: 7, 8: 7}
    assert got in (near, near | {2: 2})  # its words may differ in too many bits for the search
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (4, 7)], "x_node long, y_node long")
    saved = lambda df, name: common.saved(spark, df, name)[0]
    held = simhash.similar(common.keyed_texts(docs))(saved, pairs)
    assert [(r.x_node, r.y_node) for r in held.collect()] == [(1, 2)]


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    """run() equals the brute-force chain on a small corpus whose near copies are exact ones."""
    data = [x for x in helpers.rows(40) if x[0] is not None]
    data += [(2000 + i, data[i][1], "en", "s", None) for i in range(0, 20, 4)]
    folder = helpers.write(spark, tmp_path, data, [])  # no labels: the base rate rejects all at 0.5
    assert corpus_pipeline.run(spark, folder).collect() == []
    folder = helpers.write(spark, tmp_path / "labelled", data, [(d[0], 1, 0) for d in data])
    rows = corpus_pipeline.run(spark, folder).collect()
    exact, near = brute_near([(d, t) for d, t, *_ in data])
    kept = [(d, t) for d, t, *_ in data if near[d] == d]
    got = {r.doc_id for r in rows}
    assert got <= {d for d, _ in kept} | {d for d in exact if exact[d] == d} and {d for d, _ in kept} <= got
    left = {r.doc_id: r for r in corpus_pipeline.cut_repeated_spans(spark, helpers.pages(spark, [x for x in data if x[0] in got]), folder).collect()}
    want = brute_cut([(d, t) for d, t, *_ in data if d in got])
    tok = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    for d, (n, gone, _) in want.items():
        text = left[d].text or ""
        assert len(text.encode().split()) == n - gone
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((r.piece, r.ids_crc32) for r in rows if r.doc_id == d)
        assert mine == [(k, zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]


def test_run_on_awkward_rows(spark, tmp_path):
    data = helpers.rows()
    folder = helpers.write(spark, tmp_path, [*data, (None, "no id", None, None, None)], [(d, i % 2, 0) for i, (d, *_) in enumerate(data)])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= {d[0] for d in data} and len(rows) > 30
    empty = helpers.write(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_own_columns_do_not_clash(spark, tmp_path):
    """Every name that a stage uses inside may be a column of the input: it passes with its values."""
    data = helpers.rows(12)
    folder = helpers.write(spark, tmp_path, data, [(d[0], 1, 0) for d in data])
    names = "starts counts score span_doc span_tag own_tag maybe copy_id copy_hash new_text scan pieces numbers scores __maybe __own_word __word __bits tag label node g is_open sequence_id"
    docs = helpers.pages(spark, data)
    for n in names.split():
        docs = docs.withColumn(n, F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) > 5 and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names.split()), name
    assert corpus_pipeline.pack_sequences(spark, docs, folder).count() > 5
