"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

import math

import pytest


import numpy as np

from loomstead.llm import extraction, mixing, packing, quality, simhash, substring, token_files, topk, toxicity, warc


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, n_removed int"
PAGES = "page_id long, url string, html string, text string, key string, payload binary"


def vocabulary(name):
    import public_tokenizers

    return str(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "t", 0), (4, long, "en", "s", 9), (5, long, "en", "s", 9), (None, "x y", "en", "s", 3), (6, "\n \t", "en", None, 3)]
    return spark.createDataFrame([(*r, 0.5, "clash", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty, labels):
    got = quality.rules(docs, quality.fit(docs, labels)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4, 5, 6]
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 6))
    assert quality.rules(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_substring(spark, docs, empty):
    got = substring.dedup(docs, carry=["n_words", "score"]).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4, 5, 6]
    five = next(r for r in got if r.doc_id == 5)
    assert five.n_removed == 20_000 and five.kept == "" and five.carry.n_words == "clash"
    assert next(r for r in got if r.doc_id == 4).n_removed == 0
    assert substring.dedup(empty).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (7, f"x {a}"), (7, f"{b} y"), (9, f"z {b}")]
    got = sorted((r.doc_id, r.n_removed) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (7, 0), (7, 30), (9, 30)]


def test_warc(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, "u", "same"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "é\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame([(*r, "clash", "clash", b"") for r in rows], PAGES)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark, pages).collect())
    assert got == [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 300_000)]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_extraction(spark):
    rows = [(1, "u", "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One &amp; two.</p></article>"), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, "clash", "clash", b"") for r in rows], PAGES)
    trees = extraction.train(60)
    got = {r.page_id: r.text for r in extraction.extract(pages, trees).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == ""
    assert "menu" not in got[1]
    assert extraction.extract(pages.limit(0), trees).count() == 0


def test_toxicity(spark, docs, empty, labels):
    got = toxicity.score(docs, toxicity.fit(docs, labels), carry=["score"]).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4, 5, 6]
    assert all(0 <= r.score <= 1 and r.carry.score == 0.5 for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_token_files(spark, docs, empty):
    got = token_files.digest(token_files.round_trip(spark, docs, tokenizer_path=vocabulary("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4, 5, 6] and [r.n_tokens for r in got][2:4] == [1, 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert token_files.round_trip(spark, empty, tokenizer_path=vocabulary("word_bpe_49k.json")).count() == 0


def test_packing(spark, docs, empty):
    got = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6}
    assert sum(r.length for r in got if r.doc_id == 1) == 2 * next(r.doc_tokens for r in got if r.doc_id == 1)
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == 8 and all(r.taken <= 3 * r.size for r in got)
    assert math.isclose(sum({(r.source, r.target) for r in got} and {r.source: r.target for r in got}.values()), sum(r.size for r in got))
    assert mixing.mix(empty).count() == 0
    nothing = mixing.mix(docs.where("doc_id in (2, 3)")).collect()
    assert [r.taken for r in nothing] == [0, 0]


def test_simhash(spark, docs, empty):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got[2] == got[3] == got[6] == (0, 2) and got[5] == got[4] and got[4][1] == 4
    assert simhash.near_duplicates(empty).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [None, 1.0], 1), (5, [], 1), (None, [1.0, 1.0], 1), (6, [float("inf"), 0.0], 1), (7, [-1.0, 0.5], 1), (8, [1.0, 1.0, 1.0], 1)]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, shard string")
    got = topk.search(v, v.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 5 * 65536), (1, 5 * 65536), (7, 0)]
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_topk_large_components(spark):
    import math

    first = spark.createDataFrame([(0, [2000000.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = topk.search(first, first.where("vec_id = 1")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 256 * 512000256), (2, 4 * 65536)]
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=4) * 10.0 ** r.integers(-2, 38 if i % 3 else 9)]) for i in range(120)] + [(200, []), (201, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for row in topk.search(v, v.where("vec_id % 5 = 0"), shards=3).collect():
        found.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    whole = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    for q in (i for i in whole if i % 5 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], e)), i) for i, e in whole.items() if i != q and len(e) == len(whole[q]))[:5]
        assert sorted(found[q]) == [(k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scores, 1)], q


def test_mixing_in_groups_of_shards(spark):
    """Many shards in many groups: each document near its share, each source near its target, none above 3 times its size."""
    rows = [(i if i % 9 else None, "a" if i % 4 else "b", " ".join(["w"] * (1 + i % 40))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, block=8, shard_words=200, group_shards=4).collect()
    assert len(got) == 2000 and all(0 <= r.taken <= 3 * r.size for r in got)
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target
