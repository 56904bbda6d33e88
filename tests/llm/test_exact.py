"""Operators against brute force on the small tables and on planted cases."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from loomstead.llm import boosting, components, extraction, packing, simhash, substring, token_files, tokens, topk, toxicity, warc
from loomstead.llm.common import Words, fresh_path
from tests.harness import compare

Q, O = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def read(sf, name, columns):
    import pyarrow.parquet as pq

    return list(zip(*(pq.read_table(f"{sf}/{name}.parquet").column(c).to_pylist() for c in columns)))


@pytest.fixture(scope="module")
def texts(sf):
    return dict(read(sf, "documents", ["doc_id", "text"]))


@pytest.mark.parametrize("name", ["op8_mixing", "op10_topk"])
def test_oracle(spark, sf, name):
    assert compare(Q[name](spark, sf), O[name], sf).startswith("ok")


def windows_removed(texts, width=13):
    first, out = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), i)
    for i in texts:
        w = (texts[i] or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring(spark, sf, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q["op2_substring"](spark, sf).collect()}
    assert got == windows_removed(texts)


@pytest.mark.parametrize("hot", [0, 1 << 30])
def test_substring_of_few_words(spark, hot):
    r = random.Random(3)
    texts = {i: " ".join(r.choices("abc", k=r.randint(0, 60))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.dedup(docs, hot=hot).collect()}
    assert got == windows_removed(texts)


def test_subtree_nodes():
    """Sorted suffixes, common prefixes and deep nodes against brute force."""
    r = random.Random(9)
    rows = [" ".join(r.choices("ab", k=r.randint(1, 12))).encode() for _ in range(300)]
    owners = np.array([r.randrange(1000) for _ in rows])
    tree = substring.Subtree(rows, 4)
    suffixes = [(i, tuple(row.split()[at:])) for i, row in enumerate(rows) for at in range(len(row.split()) - 3)]
    least = {}
    for i, suffix in suffixes:
        least[suffix[:4]] = min(int(owners[i]), least.get(suffix[:4], 1000))
    assert tree.least(owners).tolist() == [least[suffix[:4]] for _, suffix in suffixes]
    ordered = [suffixes[i][1] for i in tree.order.tolist()]
    for n, (a, b) in enumerate(zip(ordered, ordered[1:]), 1):
        assert tree.common[n] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for first, end, depth in zip(*(x.tolist() for x in tree.deep_nodes())):
        if end - first > 1:
            group = ordered[first:end]
            assert depth >= 4 and len({g[:depth] for g in group}) == 1 and len({g[: depth + 1] for g in group}) > 1 or len(set(group)) == 1


def test_long_text_with_one_anchor(spark):
    """One text in which a run of words comes back far more often than a group holds, and a part of it in another text."""
    long = " ".join(f"a b c d e {i}" for i in range(30_000))
    part = " ".join(f"a b c d e {i}" for i in range(100, 130))
    docs = spark.createDataFrame([(5, part), (9, long), (2, "x " * 12 + "y")], "doc_id long, text string")
    for hot in (substring.HOT_ANCHOR, 1 << 30):
        got = {r.doc_id: r.n_removed for r in substring.dedup(docs, hot=hot).collect()}
        assert got == {5: 0, 9: 180, 2: 0}


def test_warc(spark, sf):
    pages = dict(read(sf, "pages", ["page_id", "html"]))
    last = {}
    for i, h in pages.items():
        last[h] = max(i, last.get(h, i))
    want = {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), None if last[h] == i else last[h]) for i, h in pages.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in Q["op3_warc"](spark, sf).collect()} == want


def test_warc_random_access(spark, sf):
    pages = dict(read(sf, "pages", ["page_id", "html"]))
    index = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), fresh_path(spark, "warc-test"), frame_bytes=10_000).collect()
    for r in index[::7]:
        fields, payload = warc.Bundle(r.bundle).record(r.frame, r.offset, r.length)
        if fields["WARC-Type"] == "response":
            assert payload == pages[r.page_id].encode()


def test_extraction_of_pages(spark, sf):
    import html
    import re

    for r in Q["op4_extraction"](spark, sf).collect():
        page = dict(read(sf, "pages", ["page_id", "html"]))[r.page_id]
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_of_other_layouts():
    trees, r, good = extraction.train(), random.Random(99), 0
    mark = chr(0xE000)
    for _ in range(60):
        page = extraction.training_page(r)
        want = "\n\n".join(t for _, t in sorted(x for d in extraction.parse(page) for x in d.runs if mark in x[1])).replace(mark, "")
        nodes = extraction.parse(page.replace(mark, ""))
        good += extraction.main_text(nodes, trees.log_odds(extraction.features([nodes]))) == want
    assert good >= 54


def test_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boosting.fit(x[:1500], y[:1500], share=1.0)
    assert ((model.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.9


def encoded(name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark, sf, texts):
    encode, want, at = encoded("word_bpe_49k.json", 2), {}, 0
    for i in sorted(texts):
        ids = encode(texts[i])
        want[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q["op6_token_files"](spark, sf).collect()} == want


def test_addressable_codes(tmp_path):
    ids = np.random.default_rng(1).choice([1, 200, 300, 70_000, 2**31], 5000).astype("<u4")
    token_files.write_file(f"file://{tmp_path}/x.dac", [1, 2], [ids[:10], ids[10:]])
    f = token_files.TokenFile(f"file://{tmp_path}/x.dac")
    assert (f.all() == ids).all() and [f.token(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    assert f.starts.tolist() == [0, 10, 5000]


ODD = [
    "a \xa0b", "a\xa0\n b", "  x  y\n\n z ", "it's  they'LL 's x", "\x1c\x1f a", "ΑΣ ΟΣ'", "é ́b İI", "<|endoftext|> a<|startoftext|>b", " ", "\n\n", "\na\nb", "日本語 123,,,", "a b 　 c", "x\r\ny\tz",
    "₏B", "\U0001f600₏", "ͦ₞", "<|ENDOFTEXT|>", "a×b÷c", "dog'sx !'s", "\ufeffa", "a\u200b b", "ſİıŸŉ",
]


def random_texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    signs = [*"abzAZ019 \t\n\r.,;!'$#<|>-_", "  ", "\n\n", " \n", "'s", "'t", "'re", "<|endoftext|>", "<|startoftext|>", *"éÉßüÜñŉſİıŸÿĀāŽž×÷°«»“”—…€₏₞ͦ́\xa0\u3000\u2009\x85\x1c\x1f\x00\x7f日本語한국абвΣςσ😀²½٣\u200b\ufeff"]
    out = []
    for k in range(n):
        if k % 4:
            out.append("".join(r.choices(signs, k=r.randint(0, 24))))
        else:
            codes = [r.randint(0, r.choice([0x250, 0x2FFF, 0x10FFFF])) for _ in range(r.randint(0, 24))]
            out.append("".join(chr(c) for c in codes if not 0xD800 <= c < 0xE000))
    return out


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoding_as_the_library(name, kind, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(name))
    library, e = Tokenizer.from_file(path), tokens.Encoder(path, kind)
    cases = ODD + random_texts(5, 10_000)
    want = [library.encode(text, add_special_tokens=False).ids for text in cases]
    got = [ids.tolist() for ids in e.encode_all([text.encode() for text in cases])]
    assert [text for text, a, b in zip(cases, got, want) if a != b] == []
    # cut into short parts, and with a table that is always full
    monkeypatch.setattr(tokens, "PASS_BYTES", 40)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    long = [" ".join(cases[i : i + 50]) for i in range(0, 2000, 50)] + [cases[7]]
    assert [x.tolist() for x in tokens.Encoder(path, kind).encode_all([t.encode() for t in long])] == [library.encode(t, add_special_tokens=False).ids for t in long]


def test_added_tokens_keep_their_ids():
    for name, kind, ids in (("byte_bpe_50k.json", "byte", [50256]), ("word_bpe_49k.json", "word", [49407])):
        import public_tokenizers

        assert tokens.Encoder(str(public_tokenizers.path(name)), kind).encode("<|endoftext|>").tolist() == ids


def test_packing(spark, sf, texts):
    encode = encoded("byte_bpe_50k.json", 1)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in Q["op7_packing"](spark, sf).collect():
        ids = encode(texts[r.doc_id])[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for group in (sequences, pieces):
        for parts in group.values():
            assert [s for s, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
    totals = [sum(n for _, n in p) for p in sequences.values()]
    assert max(totals) <= 2048 and all(t & (t - 1) == 0 for t in totals)
    assert all(sum(n for _, n in p) == len(encode(texts[i])) for i, p in pieces.items()) and set(pieces) == set(texts)


def test_first_fit_decreasing():
    r = random.Random(2)
    lengths = [r.randint(1, 50) for _ in range(200)]
    bins, rooms = packing.first_fit_decreasing(lengths, 50), []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(50 - n)
        else:
            rooms[at] -= n
    assert [50 - sum(lengths[i] for i in b) for b in bins] == rooms


def brute_components(prints, distance=3):
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf, texts):
    import xxhash

    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
        prints[i] = sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))
    groups = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op9_simhash"](spark, sf).collect()}
    assert got == {i: (format(prints[i], "016x"), groups[i]) for i in prints}


@pytest.mark.parametrize("hot", [2, 2048])
def test_links_of_close_fingerprints(spark, hot):
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(4)]
    prints = {}
    for i in range(300):
        x = r.choice(seeds)
        for b in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << b
        prints[i] = x
    distinct = sorted(set(prints.values()))
    signed = [x - (1 << 64) if x >> 63 else x for x in distinct]
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)).collect()
    got = {r.node: r.root for r in found}
    want = brute_components(dict(zip(signed, distinct)))
    same = lambda m: sorted(sorted(g) for g in _groups({x: m.get(x, x) for x in signed}))
    assert same(got) == same(want)


def _groups(m):
    out = defaultdict(list)
    for x, root in m.items():
        out[root].append(x)
    return out.values()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    assert {r.root for r in components.components(edges).collect()} == {0, 100}


def test_max_score():
    r = np.random.default_rng(4)
    v = r.integers(-900, 900, (3000, 32)).astype(float)
    v[100:200] = v[0]
    ids = np.arange(3000)
    for q in (0, 5, 150):
        s, found = topk.max_score(ids, np.ascontiguousarray(v.T), q, v[q], 5)
        full = v @ v[q]
        order = [i for i in np.lexsort((ids, -full)) if i != q][:5]
        assert found.tolist() == order and s.tolist() == full[order].tolist()


def toxicity_by_hand(docs, labels, sample):
    """Vectors of TF-IDF times relevance frequency, as dicts, of all documents."""
    import math
    import re

    def terms(text):
        out = Counter()
        for w in re.findall(r"[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\uffff]+", text.lower()):
            out[w] += 1
            if len(w) > 4:
                out[w[:4] + "-"] += 1
        return out

    counts = {i: terms(t or "") for i, t in docs.items()}
    df, have = Counter(), {0: Counter(), 1: Counter()}
    for c in counts.values():
        df.update(c.keys())
    known = Counter(y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2)
    picked = Counter(labels[i] for i in sample)
    for i in sample:
        have[labels[i]].update(dict.fromkeys(counts[i], known[labels[i]] / picked[labels[i]]))
    unit = known[0] / picked[0]
    vectors = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(n)) * math.log((1 + len(docs)) / (1 + df[t])) * math.log2(2 + have[1][t] / max(unit, have[0][t])) for t, n in c.items() if have[0][t] or have[1][t]}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / length for t, x in v.items()} if length else {}
    return vectors


@pytest.mark.parametrize("bounds", [{}, {"most_toxic": 12, "most_others": 30}])
def test_nearest_examples(spark, bounds):
    sf = "/root/testdata/sf0.01"
    docs, labels = dict(read(sf, "documents", ["doc_id", "text"])), dict(read(sf, "labels", ["doc_id", "toxic"]))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = toxicity.fit(table, spark.read.parquet(f"{sf}/labels.parquet"), **bounds)
    sample = fitted.index.ids.tolist()
    learned = {i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs}
    assert set(sample) <= learned and (bounds or set(sample) == learned)
    vectors = toxicity_by_hand(docs, labels, sample)
    for r in toxicity.score(table.where("doc_id % 7 = 0"), fitted).collect():
        cosines = {j: sum(x * vectors[j].get(t, 0.0) for t, x in vectors[r.doc_id].items()) for j in sample}
        want = sorted((c for c in cosines.values() if c > 1e-12), reverse=True)[:15]
        assert np.allclose([e.cosine for e in r.evidence], want, atol=1e-9)
        assert all(abs(e.cosine - cosines[e.doc_id]) < 1e-9 and e.toxic == labels[e.doc_id] for e in r.evidence)
        assert 0 <= r.score <= 1 and len({e.doc_id for e in r.evidence}) == len(r.evidence)


def test_blocks_are_passed_over():
    """Texts like few examples: blocks whose bound is too low are not visited, and the result is the exact one."""
    r = np.random.default_rng(3)
    rows = [(e, t, int(r.integers(1, 4))) for e in range(600) for t in sorted(set(r.integers(0, 30, 6).tolist()) | {30 + e // 20, 60 + e})]
    rows = tuple(np.array(c) for c in zip(*rows))
    index = toxicity.Index(rows, np.linspace(1, 4, 660), np.arange(600), (np.arange(600) % 5 == 0).astype(int), np.ones(600), k=5, block=16)
    places, cosines = index.nearest(*rows, 600)
    full = np.zeros((600, 660))
    full[rows[0], rows[1]] = index._weights(*rows, 600)
    products = full @ full.T
    assert np.allclose(cosines, -np.sort(-products, axis=1)[:, :5]) and np.allclose(products[np.arange(600)[:, None], index.ids[places]], cosines)


def test_toxicity_held_out():
    """Held-out recall, on the largest of the small tables."""
    from loomstead.session import local_session

    sf = "/root/testdata/sf0.1"
    labels = dict(read(sf, "labels", ["doc_id", "toxic"]))
    rows = [r for r in Q["op5_toxicity"](local_session(4, 4, "4g"), sf).collect() if r.held_out and r.doc_id in labels]
    hit = Counter((labels[r.doc_id], r.predicted) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert hit[1, 1] >= 0.9 * (hit[1, 0] + hit[1, 1]) and hit[0, 1] <= 0.015 * (hit[0, 0] + hit[0, 1])


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels, texts = dict(read(sf, "labels", ["doc_id", "quality"])), dict(read(sf, "documents", ["doc_id", "text"]))
    rows = Q["op1_quality"](spark, sf).collect()
    for r in rows[::3]:
        w = texts[r.doc_id].encode().split()
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in texts[r.doc_id].split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(cover))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id]) and r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    wrong = sum(r.kept != (labels[r.doc_id] == 1) for r in rows if r.doc_id in labels and not r.base_failed)
    assert wrong <= 0.03 * len(labels)


def test_run_hashes():
    w = Words(b" a bb\tccc\na bb ccc a")
    h = w.run_hashes(3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3 and w.line == b"a bb ccc a bb ccc a"


def test_large_buckets_of_near_copies(spark):
    """Many edited copies of one text: the same groups whole, in blocks, and by brute force."""
    from loomstead.llm import minhash

    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        v = list(base)
        for _ in range(r.randint(0, 4)):
            v[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(v))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    group = list(range(150))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bounds in ({}, {"members": 8}, {"held": 1000}):
        got = {x.doc_id: x.component_id for x in minhash.near_copies(docs, **bounds).collect()}
        assert [got[i] for i in range(150)] == group, bounds


def test_rounds_of_few_edges_are_few_files(spark):
    """A round of components is not a file for each shuffle partition: the local store forks the JVM for every file."""
    import glob

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        scratch = []
        edges = spark.range(400).selectExpr("id as a", "id + 400 as b")
        got = components.components(edges, scratch=scratch).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(x.node, x.root) for x in got} == {(n, n % 400) for n in range(800)}
    files = [f for path in scratch for f in glob.glob(f"{path.removeprefix('file:')}/part-*")]
    assert 0 < len(files) <= 8


def test_few_edges_are_settled_by_one_task(spark):
    """The same stars as by rounds, in a few jobs, whatever the shape; more edges than ``few`` take rounds."""
    r, names = random.Random(7), list(range(-3000, 3000))
    r.shuffle(names)
    path = list(zip(names[:2000], names[1:2000]))
    star = [(names[2000], x) for x in names[2001:2600]]
    loose = [(r.choice(names[2600:]), r.choice(names[2600:])) for _ in range(1500)]
    edges = spark.createDataFrame(path + star + path[:9] + loose + [(names[0], names[0])], "a long, b long")

    def ran(label, **bounds):
        spark.sparkContext.setJobGroup(label, label)
        try:
            got = {x.node: x.root for x in components.components(edges, **bounds).collect()}
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))

    rounds, many = ran("rounds")
    once, jobs = ran("once", few=1 << 18)
    more, again = ran("more", few=100)
    assert once == rounds == more and set(once) == {x for e in path + star + loose if e[0] != e[1] for x in e}
    assert {once[x] for x in names[:2000]} == {min(names[:2000])}
    assert jobs <= 8 < many / 3 and again > jobs
    assert components.components(edges.limit(0), few=10).collect() == []


def test_near_copies_of_few_links_take_few_jobs(spark):
    """The driver plans and keeps no rounds of star steps for a handful of links; the groups are those of the rounds."""
    from loomstead.llm import similar

    r = random.Random(3)
    texts = []
    for _ in range(12):
        w = [f"w{r.randrange(4000)}" for _ in range(90)]
        texts += [" ".join(w), " ".join(w[:-1] + ["end"]), " ".join([*w[:-2], "an", "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def ran(label, **bounds):
        spark.sparkContext.setJobGroup(label, label)
        try:
            got = sorted((x.doc_id, x.component_id) for x in similar.near_copies(docs, **bounds).collect())
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))

    (rounds, many), (once, jobs) = ran("near by rounds", few=0), ran("near at once")
    assert once == rounds == [(i, i - i % 3) for i in range(36)]
    assert 3 * jobs < 2 * many, (jobs, many)


def test_near_copies_by_simhash(spark):
    """Deletion variants of 16-bit segments: what meets by brute force is connected, however buckets are searched; pairs of similarity 0.8 meet."""
    from loomstead.llm import similar

    r = np.random.default_rng(8)
    sets = []
    for n in (4, 9, 18, 45, 90, 900):
        for _ in range(60):  # n of n + n / 4 hashes
            large = r.integers(0, 1 << 64, n + max(1, n // 4), np.uint64)
            sets += [np.sort(large), np.sort(large[:n])]
    for n in (40, 41, 42):  # chains
        base = r.integers(0, 1 << 64, 200, np.uint64)
        sets += [np.sort(base[i : i + n * 3]) for i in range(0, 60, 4)]
    prints = np.frombuffer(b"".join(map(similar.fingerprint, sets)), np.uint8).reshape(len(sets), -1)
    one = sets[8]
    assert similar.fingerprint(one) == np.packbits([2 * sum((int(h) >> b) & 1 for h in column) > len(one) for column in common_mix(one) for b in range(64)], bitorder="little").tobytes()
    size = np.array([len(x) for x in sets])
    want = []
    for i in range(len(sets)):
        for j in range(i):
            segments = np.bitwise_count((prints[i] ^ prints[j]).view(np.uint16))
            bits = np.bitwise_count(prints[i] ^ prints[j])
            far = similar.FAR_TINY if max(size[i], size[j]) <= similar.TINY else similar.FAR
            if segments.min() <= 1 and bits[:8].sum() <= similar.FIRST and bits[:32].sum() <= far and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]):
                want.append((j, i))
    root = list(range(len(sets)))
    for a, b in want:
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    classes = spark.createDataFrame([(i, int(size[i]), bytearray(prints[i].tobytes())) for i in range(len(sets))], "node long, size long, bits binary")
    for hot in (similar.HOT_BUCKET, 2):
        found = {x.node: x.root for x in components.components(similar.candidates(classes, hot)).collect()}
        got = [found.get(i, i) for i in range(len(sets))]
        if hot > 2:
            assert got == root
        # member by member, the first 64 bits are not looked at by themselves
        assert all(got[a] == got[b] for a, b in want)
    assert sum(root[i] == root[i + 1] for i in range(0, 720, 2)) >= 358


def common_mix(hashes):
    """The eight 64-bit hashes of each hash, column by column."""
    from loomstead.llm import similar

    return [similar.mix(hashes * f) for f in similar._FACTORS]


def test_pipeline_near_dedup_is_simhash(spark, monkeypatch):
    """The stage finds edited copies by SimHash: no MinHash band is made."""
    import corpus_pipeline
    from loomstead.llm import minhash

    def none(*_):
        raise AssertionError("MinHash in the SimHash stage")

    monkeypatch.setattr(minhash, "signatures", none)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:40], "other", *words[41:]]), " ".join(f"v{i}" for i in range(80))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_large_groups_of_near_copies_by_simhash(spark):
    """Many edited copies of one text: the same groups whole, in blocks, and by brute force."""
    from loomstead.llm import similar

    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        v = list(base)
        for _ in range(r.randint(0, 4)):
            v[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(v))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    group = list(range(150))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bounds in ({}, {"members": 8}, {"held": 1000}, {"hot": 4}):
        got = {x.doc_id: x.component_id for x in similar.near_copies(docs, **bounds).collect()}
        assert [got[i] for i in range(150)] == group, bounds
