"""Every registered analytics query against its oracle SQL, on the smallest tables."""

from collections import Counter

import numpy as np
import pytest

from loomstead.plans import catalog
from tests.harness import compare, oracle

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf).startswith("ok")


def test_all_are_checked():
    """What has no oracle SQL is checked by hand below."""
    assert set(QUERIES) - set(ORACLES) == {"tok_bpe_shard_counts", "replayed_shuffle", "pack_rows", "pack_crop_stats", "packed_row_blocks", "packed_shards"}


def texts(sf):
    return oracle("SELECT doc_id, coalesce(text, '') AS text FROM documents ORDER BY doc_id", sf).to_pylist()


def test_bpe_shards(spark, sf):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    heads, at = Counter(), 0
    for d in texts(sf):
        heads[at // 100_000] += 1
        at += 1 + len(encode(d["text"]))
    want = {}
    for k in range(-(-at // 100_000)):
        n = min(100_000, at - k * 100_000)
        want[k] = ("val" if k < 1 else "train", n, heads[k], 1 + (n - 257) // 256 if n >= 257 else 0)
    assert {r.shard_idx: (r.split, r.n_tokens, r.n_heads, r.n_blocks) for r in QUERIES["tok_bpe_shard_counts"](spark, sf).collect()} == want


def plain_packing(lengths, width, most):
    """The packing rule by scanning lists: (row, doc, length, used)."""
    waiting, buffer, out, row = list(lengths), [], [], 0
    while waiting or buffer:
        pieces, left = [], width
        while left:
            while waiting and len(buffer) < most:
                buffer.append(waiting.pop(0))
            if not buffer:
                break
            fits = [n for _, n in buffer if n <= left]
            wanted = max(fits) if fits else min(n for _, n in buffer)
            k = next(i for i, (_, n) in enumerate(buffer) if n == wanted)
            doc, n = buffer.pop(k)
            pieces.append((row, doc, n, min(n, left)))
            left -= min(n, left)
        if left:
            break
        out += pieces
        row += 1
    return out


def test_packing_queries(spark, sf):
    lanes = {}
    for d in texts(sf):
        lanes.setdefault(d["doc_id"] % 8, []).append((d["doc_id"], 1 + len(d["text"].encode().split())))
    want = [(lane, *piece) for lane, docs in lanes.items() for piece in plain_packing(docs, 1025, 1000)]
    assert sorted((r.lane, r.row_id, r.doc_id, r.doc_len, r.used) for r in QUERIES["pack_rows"](spark, sf).collect()) == sorted(want)
    stats, written, cropped = QUERIES["pack_crop_stats"](spark, sf).first(), sum(p[4] for p in want), sum(p[3] - p[4] for p in want)
    n_rows = Counter(lane for lane, _ in {p[:2] for p in want})
    assert (stats.n_rows, stats.written, stats.cropped) == (sum(n_rows.values()), written, cropped) and abs(stats.crop_fraction - cropped / (cropped + written)) < 1e-12
    blocks = sorted((lane, k, 4 * k, 4 * k + 3) for lane, n in n_rows.items() for k in range(n // 4))
    assert sorted((r.lane, r.block_idx, r.first_row, r.last_row) for r in QUERIES["packed_row_blocks"](spark, sf).collect()) == blocks
    shards = Counter()
    for lane, row, _, _, used in want:
        shards[lane, row // 19] += used
    got = {(r.lane, r.shard_idx): (r.n_tokens, r.n_rows) for r in QUERIES["packed_shards"](spark, sf).collect()}
    assert got == {k: (n, n // 1025) for k, n in shards.items()}


def test_replayed_queries(spark, sf):
    workers = {}
    for r in QUERIES["batch_provenance"](spark, sf).collect():
        workers.setdefault((r["rank"], r.worker), []).append((r.shard_idx, r.block_idx))
    want = set()
    for (rank, worker), blocks in workers.items():
        order = np.arange(len(blocks))
        np.random.default_rng(17 + 1000 * rank + worker).shuffle(order)
        want |= {(rank, worker, *sorted(blocks)[i], place) for place, i in enumerate(order.tolist())}
    assert {(r["rank"], r.worker, r.shard_idx, r.block_idx, r.place) for r in QUERIES["replayed_shuffle"](spark, sf).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tok_shard_counts", "loss_histogram", "rho_block_stats"])
def test_no_nested_loops(spark, sf, name):
    """No join multiplies its sides."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
