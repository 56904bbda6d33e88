"""Hand-made cases of the analytics operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstead.functions.text import clean_choice_text, first_upper, safe_name
from loomstead.operators import blocks, choices, losses, order, pairs, report, rows, runlog, selection, tokenize


def placed(spark, lengths):
    docs = spark.createDataFrame([(i, [50256] + [7] * n) for i, n in enumerate(lengths)], "doc_id long, ids array<int>")
    return tokenize.with_offsets(docs)


def test_sharding(spark):
    tokens = tokenize.sharded(placed(spark, [3, 0, 5]), 4, 1)
    got = {r.shard_idx: (r.split, r.n_tokens) for r in tokenize.shard_counts(tokens, 4).collect()}
    assert got == {0: ("val", 4), 1: ("train", 4), 2: ("train", 3)}
    lengths = {r.shard_idx: r.n_tokens for r in tokenize.shard_lengths(placed(spark, [3, 0, 5]), 4, 1, 4).collect()}
    assert lengths == {0: 4, 1: 4, 2: 3}


def test_offsets_over_many_buckets(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit(1), (F.col("id") % 5).cast("int")).alias("ids"))
    got = {r.doc_id: r.start for r in tokenize.with_offsets(docs).collect()}
    want, at = {}, 0
    for i in range(2000):
        want[i] = at
        at += i % 5
    assert got == want


def test_empty_corpus(spark):
    empty = tokenize.with_offsets(tokenize.document_tokens(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0
    assert tokenize.shard_lengths(empty, 4, 1, 4).count() == 0


def test_range_check(spark):
    bad = spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="out of range"):
        tokenize.checked(bad).collect()


def test_blocks(spark):
    shards = spark.createDataFrame([("train", 0, 11, 2)], "split string, shard_idx long, n_tokens long, n_blocks long")
    assert [(r.start, r.end) for r in blocks.spans(shards, 4).orderBy("start").collect()] == [(0, 5), (4, 9)]
    c = losses.coverage(shards, 4).first()
    assert (c.covered, c.unfilled, c.coverage_fraction) == (8, 3, 8 / 11)
    docs = spark.createDataFrame([(0, [0, 1, 2], 3, 0), (1, [], 0, 3), (2, [3], 1, 3), (3, list(range(4, 11)), 7, 4)], "doc_id long, ids array<int>, n_tokens long, start long")
    places = {r.token_index: (r.block_idx, r.row_idx, r.col_idx, r.x, r.y) for r in blocks.target_pairs(docs, 11, 0, 1, 4).collect()}
    assert places[5] == (1, 0, 0, 4, 5) and set(places) == set(range(1, 9)) and all(p[3:] == (i - 1, i) for i, p in places.items())
    assert blocks.target_pairs(docs.limit(0), 11, 0, 1, 4).count() == 0
    with pytest.raises(Exception, match="no shard holds a block"):
        blocks.require_blocks(shards.withColumn("n_blocks", F.lit(0).cast("long"))).collect()


def test_shape_errors():
    with pytest.raises(ValueError):
        blocks.check_shape(0, 4)


def test_even_split(spark):
    shards = spark.range(10).select(F.lit("t").alias("split"), F.col("id").alias("shard_idx"))
    got = [r["count"] for r in blocks.assignment(shards, 1, 4).groupBy("worker").count().orderBy("worker").collect()]
    assert got == [3, 3, 2, 2]


def test_longest_first(spark):
    shards = spark.createDataFrame([(i, n) for i, n in enumerate([5, 4, 3, 3])], "shard_idx long, n_blocks long")
    got = {r["rank"]: r["n"] for r in blocks.longest_first(shards, 3).groupBy("rank").agg(F.sum("n_blocks").alias("n")).collect()}
    assert [got[i] for i in range(3)] == [5, 4, 6]


def test_batch_math():
    assert blocks.batch_math(491_520, 8, 4, 1024)["grad_accum"] == 15


def test_packing_case():
    got = list(rows.pack_lane(list(enumerate([5, 4, 3, 9, 2])), 8, 1000))
    assert [(r, d, u) for r, _, d, _, u in got] == [(0, 0, 5), (0, 2, 3), (1, 1, 4), (1, 4, 2), (1, 3, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(2, 20), st.integers(1, 12))
def test_packing_invariants(lengths, width, buffer):
    got = list(rows.pack_lane(list(enumerate(lengths)), width, buffer))
    used = {}
    for row, _, doc, n, u in got:
        used.setdefault(row, []).append(u)
        assert u <= n == lengths[doc]
    assert all(sum(u) == width for u in used.values())
    assert len({d for _, _, d, _, _ in got}) == len(got)


def test_crop_stats(spark):
    docs = spark.createDataFrame(list(enumerate([5, 4, 3, 9, 2])), "doc_id long, n_tokens long")
    s = rows.crop_stats(rows.pack(docs, 7)).first()
    assert (s.n_rows, s.written, s.cropped) == (2, 16, 7) and math.isclose(s.crop_fraction, 7 / 23)


def test_percentiles(spark):
    x = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,), (float("nan"),), (float("inf"),)], "ref_loss double")
    got = {r.name: r.value for r in losses.percentiles(x).collect()}
    assert got["p25"] == 1.75
    assert losses.mean_std(x).first().n == 4


def test_selection_ties(spark):
    x = spark.createDataFrame([("t", 0, 0, s, 0.0) for s in (5.0, 4.0, 4.0, 4.0, 3.0)], "split string, shard_idx long, block_idx long, student_loss double, ref_loss double")
    got = selection.select_tokens(x, 0.4)
    assert got.where("kept").count() == 4 and got.first().k == 2
    many = spark.range(100).select(F.lit("t").alias("split"), F.lit(0).alias("shard_idx"), F.lit(0).alias("block_idx"), F.col("id").cast("double").alias("student_loss"), F.lit(0.0).alias("ref_loss"))
    assert selection.select_tokens(many, 0.55).where("kept").count() == 56
    assert selection.select_tokens(many.withColumn("ref_loss", F.lit(9.0)), 0.5, cap=1.0).where("kept").count() == 50
    with pytest.raises(ValueError):
        selection.select_tokens(many, 0)


def test_margins(spark):
    s = spark.createDataFrame([(0, "d", 1.0, 0.0, 0.0, 0.5), (1, "d", 0.0, 1.0, 0.0, 2.0)], "row_index long, domain string, s11 double, s12 double, s21 double, s22 double")
    m = pairs.domain_metrics(pairs.margins(s)).first()
    assert (m.acc1, m.acc2, m.acc_combined, m.mean_signed_m, m.mean_abs_m) == (0.5, 1.0, 1.0, 0.625, 0.625)


def test_reduce(spark):
    x = spark.createDataFrame([([-1.0, -3.0],), ([],)], "a array<double>")
    assert [tuple(r) for r in x.select(pairs.reduce_scores(F.col("a"), "sum"), pairs.reduce_scores(F.col("a"), "mean")).collect()] == [(-4.0, -2.0), (0.0, 0.0)]
    with pytest.raises(ValueError):
        pairs.reduce_scores(F.col("a"), "max")


def test_text_cleaning(spark):
    x = spark.createDataFrame([("  [header] Foo [title] bar  baz\x1c ",)], "t string")
    assert x.select(clean_choice_text(F.col("t"))).first()[0] == "Foo. bar baz"
    assert x.select(first_upper(F.lit("heLLo"))).first()[0] == "HeLLo"
    assert x.select(safe_name(F.lit("__a//b c__")), safe_name(F.lit("//"))).first()[:] == ("a_b_c", "item")


def test_argmax_ties(spark):
    x = spark.createDataFrame([(0, i, 1, s, 1) for i, s in enumerate([-2.0, -1.0, -1.0])], "example_idx long, choice_idx int, label int, score double, length int")
    assert choices.predictions(x).first().pred == 1
    assert choices.accuracy(choices.predictions(x.limit(0))).first().accuracy == 0


def test_log_lines(spark):
    lines = ['{"step":1}', '{"step":"7"}', '{"step":true}', "not json", "", "[1,2]", '{"step":7.9}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    c = runlog.trim_counts(runlog.trimmed_lines(df, 6)).first()
    assert (c.removed, c.kept, c.invalid_lines_kept) == (2, 5, 1)
    assert runlog.trim_counts(runlog.trimmed_lines(df, 7)).first().removed == 0


def test_learning_rate(spark):
    got = [spark.range(1).select(runlog.learning_rate(F.lit(s), 1.0, 4, 12, 0.1)).first()[0] for s in (0, 3, 8, 12, 13)]
    assert np.allclose(got, [0.25, 1, 0.55, 0.1, 0.1])


def test_dedupe(spark):
    x = spark.createDataFrame([(5, True, 3, 0), (5, False, 1, 1), (5, False, 2, 2)], "step long, final boolean, ts long, input_pos long")
    r = runlog.one_per_step(x).first()
    assert (r.ts, r.duplicates) == (2, 3)


def test_skip_count(spark):
    assert spark.range(1).select(runlog.skip_count(F.lit(3), F.lit(None).cast("long"), 5), runlog.skip_count(F.lit(3), F.lit(7), 5)).first()[:] == (15, 7)
    with pytest.raises(ValueError):
        runlog.skip_count(F.lit(1), F.lit(1), 0)


def test_average_fallback(spark):
    x = spark.createDataFrame([(1, {"a": 1.0, "b": 3.0}), (2, {"a": 1.0, "average": 9.0}), (3, {"a": float("nan")})], "step long, m map<string,double>")
    assert {r.step: r.average for r in report.average_with_fallback(x, "m").collect()} == {1: 2.0, 2: 9.0}
    assert report.with_baseline(x.select(F.lit("social-properties").alias("domain"))).first().baseline == 0.73


def test_union_files(spark):
    a, b = spark.createDataFrame([(0, "x")], "line long, p string"), spark.createDataFrame([(0, "y", 1)], "line long, p string, q int")
    assert [(r.row_index, r.p, r.q) for r in pairs.union_files([a, b]).orderBy("row_index").collect()] == [(0, "x", None), (1, "y", 1)]


def test_replayed_shuffle(spark):
    s = spark.range(10).select(F.lit(2).alias("rank"), F.lit(1).alias("worker"), F.lit(0).cast("long").alias("shard_idx"), F.col("id").alias("block_idx"))
    mixed = np.arange(10)
    np.random.default_rng(7 + 2001).shuffle(mixed)
    assert [r.block_idx for r in blocks.numpy_shuffled(s, 7).orderBy("place").collect()] == mixed.tolist()


def test_limits():
    assert choices.longest_input(1024, 10**9) == 1024 and choices.longest_input(None, None) == 2048
    assert losses.sequence_length(None, {"seq_len": 7}) == 7 and losses.sequence_length(None, {}) == 1024


def test_scored_continuations(spark):
    """Masks, sums and lengths of fitted candidates against a plain loop; log probabilities are those of a fixed scorer."""
    r = random.Random(4)
    rows = [([r.randrange(90) for _ in range(p)], [r.randrange(90) for _ in range(c)]) for p in (0, 1, 2, 5, 9) for c in (0, 1, 2, 6, 8, 12)]
    logp = lambda before, token: -float((before * 31 + token * 17) % 13) - 0.5
    head, cont = choices.fitted(F.col("p"), F.col("c"), 8, 99)
    ids, start = choices.padded(head, cont, 98)
    fit = spark.createDataFrame(rows, "p array<int>, c array<int>").select("p", "c", ids.alias("ids"), start.alias("start"))
    steps = F.transform(F.sequence(F.lit(2), F.size("ids")), lambda i: -((F.element_at("ids", i - 1) * 31 + F.element_at("ids", i) * 17) % 13).cast("double") - 0.5)
    total, length = choices.sequence_score(choices.continuation_logps(steps, F.col("start")))
    for row in fit.select("p", "c", "ids", "start", total.alias("total"), length.alias("length")).collect():
        p, c = list(row.p), list(row.c) or [99]
        over = len(p) + len(c) - 8
        if over > 0:
            p, c = (p[over:], c) if over < len(p) else ([], c[:8])
        whole, at = p + c, len(p)
        if len(whole) < 2:
            whole, at = [98, *whole], at + 1
        scored = [logp(whole[i], whole[i + 1]) for i in range(max(at - 1, 0), len(whole) - 1)]
        assert (list(row.ids), row.start, row.total, row.length) == (whole, at, sum(scored), len(scored))


def test_conditional_logps(spark):
    x = spark.createDataFrame([([-1.0, -2.0, -3.0], 2), ([-1.0, -2.0], 0), ([-1.0], 1), ([-1.0], 5)], "logps array<double>, n int")
    got = [r[0] for r in x.select(pairs.conditional_logps(F.col("logps"), F.col("n"))).collect()]
    assert got == [[-3.0], [-1.0, -2.0], [], []]


def test_packed_views():
    assert rows.shard_rows(1024) == 97_560 and rows.shard_rows(7, asked=3) == 3 and rows.check_packed(16, 7, {"seq_len": 7, "row_tokens": 8}) == 2
    for bad in (lambda: rows.check_packed(17, 7, {}), lambda: rows.check_packed(16, 7, {"seq_len": 8}), lambda: rows.check_packed(16, 7, {"row_tokens": 7}), lambda: rows.shard_rows(1024, 1000)):
        with pytest.raises(ValueError):
            bad()


def test_first_batches(spark):
    x = spark.createDataFrame([(i, float(i), 1) for i in range(3)], "k long, loss double, n long")
    assert sorted(r.k for r in choices.first_batches(x, 7, ["k"]).collect()) == [0, 0, 0, 1, 1, 2, 2]
    assert choices.first_batches(x, 2, ["k"]).count() == 2 and choices.first_batches(x.limit(0), 5, ["k"]).count() == 0


def test_numbers_in_order(spark):
    keys = [5, 4095, 4096, 9000, 123_456, -3]
    got = {r.k: r.place for r in order.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    x = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted(r.k for r in order.after_first(x, 2, ["k"]).collect()) == sorted(keys)[2:]
    assert order.after_first(x, 0, ["k"]).count() == 6 and order.after_first(x, 99, ["k"]).count() == 0 and order.after_first(x.limit(0), 2, ["k"]).count() == 0


def test_trimmed_lists(spark):
    texts = spark.createDataFrame([('[{"step": 1}, {"step": 9}, {"x": [1, 2]}]',), ("[]",)], "value string")
    got = [(r.removed, r.n_kept, r.rewrite) for r in runlog.trimmed_list(texts, 5).collect()]
    assert got == [(1, 2, True), (0, 0, False)] and runlog.trimmed_list(texts, 5).first().kept == '[{"step":1},{"x":[1,2]}]'
    for bad in ('{"step": 1}', None):
        with pytest.raises(Exception, match="not a list"):
            runlog.trimmed_list(spark.createDataFrame([(bad,)], "value string"), 5).collect()


def test_flattened(spark):
    x = spark.createDataFrame([('{"a": 1}',), ('[{"a": 2}, [[{"a": 3}], {"a": [4]}], 7, null]',), ("null",), (None,), ("[]",)], "value string")
    assert sorted(r.value.replace(" ", "") for r in runlog.flattened(x).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":[4]}']


def test_payload(spark):
    x = spark.createDataFrame([({"m_sum": 1.0, "m": 2.0},), ({"m": 2.0},), ({"m_sum": None, "m": 2.0},), ({"m_mean": 3.0},)], "r map<string,double>")
    assert [tuple(v) for v in x.select(report.payload(F.col("r"), "m", "sum"), report.payload(F.col("r"), "m", "mean")).collect()] == [(1.0, None), (2.0, None), (None, None), (None, 3.0)]


def test_detokenized(spark):
    import public_tokenizers

    path, texts = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), ["a b  c", "", "é 日本\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = tokenize.detokenized(tokenize.bpe_tokens(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert [r.text for r in back.orderBy("doc_id").collect()] == texts


def test_draws(spark):
    """Draws fall on covered places alone, all over them."""
    docs = spark.createDataFrame([(i, [50256, *range(24)], 25, 25 * i) for i in range(10)], "doc_id long, ids array<int>, n_tokens long, start long")
    scored = blocks.target_pairs(docs, 100, 0, 1, 8).withColumn("ref_loss", (F.col("shard_idx") * 1000 + F.col("token_index")).cast("double"))
    got = [r.ref_loss for r in losses.drawn(docs, scored, 4000, 100, 8).collect()]
    assert len(got) == 4000 and set(got) == {r.ref_loss for r in scored.collect()}


def test_whole_blocks(spark):
    x = spark.createDataFrame([("t", 0, b, i, 1.0 if b else None) for b in (0, 1) for i in range(4)], "split string, shard_idx long, block_idx long, token_index long, ref_loss double")
    assert selection.whole_blocks(x.where("block_idx = 1"), 4).count() == 4
    for bad, n in ((x, 4), (x.where("block_idx = 1"), 5)):
        with pytest.raises(Exception, match="a block has"):
            selection.whole_blocks(bad, n).collect()
    with pytest.raises(ValueError):
        selection.check_arguments(0.5, "delta", warmup=-1)
