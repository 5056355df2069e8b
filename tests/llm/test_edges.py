"""Null ids, repeated rows, ties, clashing names and texts beyond a block, for every operator that reads documents."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from kinetrace.llm import digest, fertility, neardup, packing, perplexity, planes, secrets, substrings, text
from kinetrace.llm.graph import components
from kinetrace.llm.tokens import encoder, public_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("__id", "__n", "__uid", "__key", "__all", "row", "uid", "size", "removed_spans", "base", "spans", "kept", "ids", "depths", "segments", "content")


def prose(rng, n):
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    same = prose(rng, 80)
    out = [(None, same, "en", "s", 0), (None, same, "en", "s", 0), (None, prose(rng, 70), None, None, 0), (None, None, None, None, None)]
    out += [(7, prose(rng, 60), "en", "s", 0), (7, prose(rng, 60), "en", "s", 0)] * 2 + [(8, same, "en", "s", 0)] * 3
    return out + [(i, prose(rng, rng.randrange(30, 90)), "en", "t", 0) for i in range(20, 60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).cache()


def test_op1_repeated_and_null_ids(spark, docs, rows, tmp_path):
    path, to = public_path("byte_bpe_50k.json"), str(tmp_path / "d")
    planes.write_dataset(docs, to, path, bits=True)
    got = planes.document_index(spark, to).orderBy("start").collect()
    e = encoder(path, "byte")
    want = Counter((i, zlib.crc32(np.append(e.encode(t), np.uint32(0)).astype("<u4").tobytes())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_op2_repeated_and_null_ids(docs, rows):
    got = {r.doc_id: r for r in substrings.repeated_passages(docs).collect()}
    assert None in got and 8 in got and got[8].keep_ids == [substrings.NO_ID] and got[8].removed_words == 80 and got[None].removed_words == 0
    out = substrings.remove_passages(docs)
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == ["doc_id", "text"] and texts[(8, "")] == 3 and sum(texts.values()) == len(rows)


def test_op3_repeated_and_null_ids(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in (7, 8, *range(20, 60))], "doc_id long, quality int, toxic int")
    got = perplexity.scored(docs, labels).collect()
    assert len(got) == len(rows) and not any(r.trusted for r in got if r.doc_id is None)
    assert len({r.perplexity for r in got if r.doc_id == 8}) == 1 and len({r.perplexity for r in got if r.doc_id == 7}) == 2
    kept = perplexity.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r["__uid"] == "own __uid" and r.kept == "own kept" for r in kept.collect())


def test_op5_repeated_and_null_ids(docs, rows):
    got = digest.fingerprints(docs).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(by[8]) == 1 and len(by[7]) == 2 and by[8] <= by[None] and all(0 <= r.near_edited <= 1 for r in got)


def test_op6_repeated_null_and_ties(docs, rows):
    got = fertility.quality_rules(docs, public_path("piece_bpe_32k.model"), least=5).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    assert len({(r.kept, r.chars_per_token) for r in got if r.doc_id == 8}) == 1
    alike = docs.where("doc_id = 8").drop(*CLASH)
    assert all(r.kept for r in fertility.quality_rules(alike, public_path("piece_bpe_32k.model"), least=1).collect())  # values on the bands' edge


def test_op8_repeated_and_null_ids(docs, rows):
    path = public_path("word_bpe_49k.json")
    e = encoder(path, "word")
    got = packing.pack_documents(packing.prompted(docs), path, segments="segments", capacity=128, max_segments=4, max_loss=120).collect()
    total = sum(len(e.encode(t)) + 1 for _, t, *_ in rows)
    assert sum(r.length for r in got) == total and Counter(r.doc_id for r in got if r.start == 0) == Counter(x[0] for x in rows)


def test_op9_repeated_and_null_ids(docs, rows):
    got = neardup.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    eight = [r for r in got if r.doc_id == 8]
    assert {(r.copy_of, r.n_copies, r.class_id) for r in eight} == {(8, 5, 8)}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 8: 1, 7: 2, **{i: 1 for i in range(20, 60)}})
    assert all(r["__uid"] == "own __uid" and r.uid == "own uid" for r in kept.collect())


def test_op7_keeps_clashing_names(docs):
    red = secrets.redact_secrets(docs.withColumn("text", F.concat(F.lit("token: abcdef123 "), F.coalesce("text", F.lit("")))))
    assert red.columns == docs.columns and all(r.text.startswith("[SECRET] ") and r.base == "own base" and r.spans == "own spans" for r in red.collect())


def test_texts_beyond_a_block(spark, monkeypatch):
    """Words, windows and shingles of a text that is read in blocks are those of the whole text."""
    rng = random.Random(3)
    long = "\n".join(prose(rng, 25) for _ in range(200))
    whole = [text.shingles(long), *substrings.anchored_windows(long, 32, 20)]
    monkeypatch.setattr(text, "BLOCK_CHARS", 700)
    parts = [text.shingles(long), *substrings.anchored_windows(long, 32, 20)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert [w for first, block in text.word_blocks(long, 0) for w in block.split()] == long.encode().split()


def test_very_long_documents(spark):
    """Two copies of 2.5 million characters, and one with a word changed, through the joins and the packing."""
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(330_000))
    assert len(long) > text.BLOCK_CHARS
    df = spark.createDataFrame([(1, long, "en", "s", 0), (2, long, "en", "s", 0), (3, long.replace(" ", " x ", 1), "en", "s", 0), (4, "short", "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i].class_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4] and got[3].n_links == 1 and got[1].n_copies == 2
    passages = {r.doc_id: r for r in substrings.repeated_passages(df, report=32).collect()}
    assert passages[1].removed_words == 0 and passages[2].removed_words == 330_000 and passages[3].removed_words > 329_900
    path = public_path("word_bpe_49k.json")
    pieces = packing.pack_documents(df, path).collect()
    n = len(encoder(path, "word").encode(long)) + 1
    assert sum(r.length for r in pieces if r.doc_id == 1) == n == max(r.doc_tokens for r in pieces if r.doc_id == 1)
    prints = {r.doc_id: r for r in digest.fingerprints(df).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint


def test_components_that_do_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, rounds=2)
    assert components(chain).select("component").distinct().count() == 1


def test_no_sample_decides_what_pairs_are_found(spark, monkeypatch):
    """The prefix is the threshold's, whatever likenesses the texts have, and loses next to no pair; planted pairs are found."""
    rng, texts, chosen = np.random.default_rng(8), [], []
    for n, (shared, size) in enumerate([(50, 53)] * 150 + [(40, 45)] * 60):  # indices of 0.89 and of 0.8
        common = [f"c{n}x{x}" for x in rng.integers(0, 1 << 40, shared + 4)]
        texts += [" ".join(common + [f"{side}{n}x{x}" for x in rng.integers(0, 1 << 40, size - shared)]) for side in "ab"]
    whole = neardup.forest_depth

    def depth(threshold, trees, max_depth, recall, measured=None):
        chosen.append((whole(threshold, trees, max_depth, recall, measured), bool(measured)))
        return chosen[-1][0]

    monkeypatch.setattr(neardup, "forest_depth", depth)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(df).collect()}
    assert [i for i in range(len(texts)) if got[i] != (i - i % 2, 1)] == []
    assert neardup.keep_one(df).count() == len(texts) // 2
    assert {(measured, (1 - 0.8**d) ** 16 < 1e-9) for d, measured in chosen} == {(False, True)}


def test_the_pipeline_takes_no_sample(spark, sf, monkeypatch):
    import corpus_pipeline

    stated, whole = [], neardup.forest_depth
    monkeypatch.setattr(neardup, "forest_depth", lambda *a: stated.append(a[4:]) or whole(*a))
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert stated == [()] and "sample" not in neardup.near_duplicates.__code__.co_varnames and kept.columns
