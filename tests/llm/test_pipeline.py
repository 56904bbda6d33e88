"""The pipeline: stages, their columns, and what each must do."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = docs.unionByName(copies)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "simhash near-dedup":
            assert out.where("doc_id >= 1000000").count() == 0 and out.count() == out.select("doc_id").distinct().count()
        if name == "substring dedup":
            assert out.count() == docs.count()
        docs = out
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_odd_rows(spark, sf):
    rows = [(None, "x", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf)
        table.collect()


def test_edited_copies(spark, sf):
    """Copies with small edits go where five-word shingles have a similarity of 0.8 or more, by brute force; chains count."""
    r = random.Random(11)
    words = [[f"w{r.randrange(5000)}" for _ in range(n)] for n in (40, 60, 120, 300, 300, 8, 3)]
    texts = []
    for w in words:
        texts.append(w)
        for edits in (0, 1, 2, 4, 8, 12):
            v = list(texts[-1] if edits == 2 else w)
            for _ in range(edits):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            texts.append(v)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert kept == set(group) and any(texts[i] != texts[g] for i, g in enumerate(group))


def test_no_row_is_lost(spark, sf):
    """One doc_id with different texts: a row of each group stays; of equal rows one."""
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (3, texts[2]), (3, None), (4, ""), (0, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert kept == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (3, "")])


def test_chain_by_brute_force(spark, sf):
    """Every stage on what its predecessor kept, against plain computations (the scores of toxicity are held by a test of their own)."""
    import hashlib

    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomstead.llm import mixing, queries
    from tests.llm.test_exact import windows_removed

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def ran(name, frame):
        rows = stages[name](spark, frame, sf).select(*corpus_pipeline.COLUMNS).collect()
        return rows, spark.createDataFrame(rows, frame.schema)

    rows, docs = ran("toxicity", docs)
    toxic = {r.doc_id for r in queries.op5_toxicity(spark, sf).collect() if r.predicted}
    assert sorted(r.doc_id for r in rows) == sorted(set(texts) - toxic) and all((r.text or "") == texts[r.doc_id] for r in rows)

    kept = sorted(r.doc_id for r in rows)
    lowered = {i: "".join(c.lower() if c.isascii() else c for c in texts[i]).encode().split() for i in kept}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in lowered.items()}
    group = {i: i for i in kept}
    for n, a in enumerate(kept):
        for b in kept[:n]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    rows, docs = ran("simhash near-dedup", docs)
    assert sorted(r.doc_id for r in rows) == sorted(set(group.values())) and len(set(group.values())) < len(kept)

    before = {r.doc_id: r.text or "" for r in rows}
    want = windows_removed(before)
    rows, docs = ran("substring dedup", docs)
    assert sorted(r.doc_id for r in rows) == sorted(before)
    for r in rows:
        n, gone, digest = want[r.doc_id]
        text = r.text or ""
        assert hashlib.sha256(b" ".join(text.encode().split())).hexdigest() == digest and (gone or text == before[r.doc_id]) and r.n_chars == len(text)

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    taken = {i: (size, n) for i, _, size, _, _, n in con.execute(mixing.ORACLE.format(documents="documents")).fetchall()}
    rows, docs = ran("mixing", docs)
    copies = {i: sum(r.doc_id == i for r in rows) for i in taken}
    assert all((n // size <= copies[i] <= n // size + (n % size > 0)) if size else copies[i] == 1 for i, (size, n) in taken.items())

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {}
    for r in rows:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in stages["packing"](spark, docs, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_the_driver_gives_back_what_the_fit_took(spark, sf, monkeypatch):
    """What the fit of toxicity has freed is not held through the later stages."""
    import re
    from pathlib import Path

    import numpy as np

    from loomstead.llm import common

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    taken = [np.ones(3000) for _ in range(4000)]  # 96 MB below the size that is mapped by itself
    last, most = [taken[i] for i in range(0, 4000, 200)], held()
    del taken
    common.give_back()
    assert held() < most - 60 and len(last) == 20
    called = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda: called.append(1))
    corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert called == [1]


def test_run_leaves_its_results_alone(spark, sf):
    """Staged tables of a stage go once its result is written; the result is whole."""
    import os

    from loomstead.sources.shared import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(root)) if os.path.exists(root) else set()
    out = corpus_pipeline.run(spark, sf)
    made = set(os.listdir(root)) - there
    assert out.count() > 0 and sum(x.startswith(tuple(n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES)) for x in made) == 1 == len(made)
