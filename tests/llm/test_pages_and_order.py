"""URL filters, training order, mixing, and the pipeline as a whole."""

import os
import tempfile
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.data import corpus, documents
from tests.llm.test_pairs import shingles, union_find
from wattledger.llm import bpe, mixing, order, urls
from wattledger.llm.queries import RULES
from wattledger.llm.twins import urls_sql

PAGES = [
    (1, "http://A.example.com/en/x", None), (2, "https://www.example.com/en/y#f", ""), (3, "http://q.net/es/z?p=1", "x"), (4, "http://net/fr/", "x"),
    (5, None, "x"), (6, "no scheme", "x"), (7, "http://alias.org/a", '<LINK rel="canonical" href="http://q.net/es/z?p=1">'),
    (8, "http://alias.org/b", '<link href="/a" rel=canonical>'), (9, "http://both.org/", '<link rel="canonical" href="http://net/fr/">'),
    (10, "https://mid.org/p", '<meta http-equiv="refresh" content="0; url=http://both.org">'),
    (11, "http://mid.org/p#top", '<link rel="canonical" href="//www.example.com/en/y">'), (12, "http://x.net/de/", '<link rel="stylesheet" href="http://net/fr/">'),
    (13, "http://deep.org/d/e?q", "<link rel=canonical href=f>"), (14, "http://deep.org/d/f", '<link rel=canonical href="http://unknown.net/fr/k">'),
    (15, "http://noexample.com/en/", ""), (1, "http://A.example.com/en/x", None), (None, "http://net", None),
]


def test_urls(spark):
    pages = spark.createDataFrame([(*p, "c", "c") for p in PAGES], "page_id long, url string, html string, node string, component string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark, pages, RULES).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/y", "www.example.com/en/", "allow"),
        3: ("q.net", "/es/z", "net/es/", "block"), 4: ("net", "/fr/", "net/fr/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("alias.org", "/a", None, "block"), 8: ("alias.org", "/b", None, "block"),  # a blocked page's aliases
        9: ("both.org", "/", None, "allow"), 10: ("mid.org", "/p", None, "allow"), 11: ("mid.org", "/p", None, "allow"),  # one alias is allowed
        12: ("x.net", "/de/", None, "allow"), 13: ("deep.org", "/d/e", None, "block"), 14: ("deep.org", "/d/f", None, "block"),
        15: ("noexample.com", "/en/", "com/", "allow"), None: ("net", "", None, "allow"),
    }
    assert urls.judge(spark, pages.limit(0), RULES).collect() == []
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert {r[0]: r[1:] for r in db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls_sql(RULES)})").fetchall()} == got


def test_urls_with_references_and_dot_segments(spark):
    rows = [
        (1, "http://q.net/es/p?a=1&b=2", None), (2, "http://one.org/", '<link rel="canonical" href="http://q.net/es/p?a=1&amp;b=2">'),
        (3, "http://two.org/", """<meta http-equiv=refresh content="0; url='http://q.net/es/p?a=1&#38;b=2'">"""),
        (4, "http://q.net/es/r;v=1", ""), (5, "http://three.org/", '<meta content="5;URL=http://q.net/es/r;v=1" http-equiv="Refresh">'),
        (6, "http://deep.org/d/e/f", '<link rel=canonical href="../g">'), (7, "http://deep.org/d/g", '<link rel="canonical" href="./h?x=1&#x26;y">'),
        (8, "http://deep.org/d/h?x=1&y", '<link rel="canonical" href="//q.net/es/./no/../r;v=1">'), (9, "http://deep.org/d/x/../g", None),
        (10, "http://four.org/", '<link rel=canonical href="http://five.org/?a=1&copy=2">'), (11, "http://five.org/?a=1&copy=2", '<link rel=canonical href="../../k/..">'),
        (12, "http://six.org/", "<meta http-equiv=refresh content=9>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.a, r.b) for r in urls.link_edges(pages).collect()}
    assert edges == {
        ("one.org/", "q.net/es/p?a=1&b=2"), ("two.org/", "q.net/es/p?a=1&b=2"), ("three.org/", "q.net/es/r;v=1"), ("deep.org/d/e/f", "deep.org/d/g"),
        ("deep.org/d/g", "deep.org/d/h?x=1&y"), ("deep.org/d/h?x=1&y", "q.net/es/r;v=1"), ("four.org/", "five.org/?a=1&copy=2"), ("five.org/?a=1&copy=2", "five.org/"),
    }
    got = {r.page_id: r.verdict for r in urls.judge(spark, pages, RULES).collect()}
    assert got == {i: "allow" if i >= 10 else "block" for i in range(1, 13)}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    one, two = order.Feistel(n, 1), order.Feistel(n, 2)
    slots = one.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (one.sequence(slots) == np.arange(n)).all()
    assert n < 100 or (slots != two.slot(np.arange(n))).mean() > 0.9


def test_order_round_trip(spark):
    texts = [*corpus(), None, "", "long " * 9000, "<|endoftext|>"]
    folder = tempfile.mkdtemp(prefix="order-")
    documents(spark, texts).repartition(5).write.mode("overwrite").parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    ranks = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = order.materialise(spark, docs, ranks, public_tokenizers.PATTERN, 50256, folder=f"{folder}/shards", length=64, per_shard=16)
    rows = sorted(out.collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in rows] == list(range(len(rows))) and sorted(r.slot for r in rows) == list(range(len(rows)))
    stream = np.concatenate([order.read_record(f"{folder}/shards", r.slot, 16, 64) for r in rows])
    used = sum(r.n_tokens for r in rows)
    assert (stream[used:] == 50256).all() and [r.slot for r in rows] == order.Feistel(len(rows), 20_250_101).slot(np.arange(len(rows))).tolist()
    encoding = order.encoder(ranks, public_tokenizers.PATTERN)
    ends = np.flatnonzero(stream[:used] == 50256)
    found = [encoding.decode(part[:-1].tolist()) for part in np.split(stream[:used].astype(int), ends + 1)[:-1]]
    assert sorted(found) == sorted(t or "" for t in texts)
    assert order.materialise(spark, docs.where("false"), ranks, public_tokenizers.PATTERN, 50256).collect() == []


def test_mixing_meets_targets(spark):
    rows = [(i, "good words here and there " * (1 + i % 5)) if i % 3 else (i, "BAD!! ### " * (1 + i % 7)) for i in range(300)]
    docs = documents(spark, [*rows, (500, None), (501, ""), (None, "good words")])
    labelled = spark.createDataFrame([(i, "bad" if i % 3 == 0 else "good") for i in range(0, 300, 2)] + [(None, "bad"), (4, None)], "doc_id long, domain string")
    for targets, anchor in (({"good": 0.9, "bad": 0.1}, "good"), ({"good": 0.5, "bad": 0.5}, None)):
        got = mixing.mix(spark, docs, labelled, targets, anchor=anchor).collect()
        sums = np.sum([np.array(r.p) * r.tokens * r.rate for r in got], axis=0)
        assert np.allclose(sums / sums.sum(), [targets["bad"], targets["good"]], atol=1e-5)
        assert len(got) == 303 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    one = {r.doc_id: r.copies for r in got}
    taken = mixing.apply_mix(spark, docs, labelled, {"good": 0.5, "bad": 0.5})
    assert taken.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in one.items() if c}
    empty = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(spark, documents(spark, []), empty, {"a": 0.5, "b": 0.5}).collect() == []
    assert all(abs(r.rate - 1) < 1e-6 for r in mixing.mix(spark, docs, empty, {"a": 0.5, "b": 0.5}).collect())


def plain_projected_gradient(p, tokens, bound, wanted, steps=60_000):
    """Rates nearest to one that meet the totals, by small gradient steps on the multipliers; nothing is shared with the library."""
    x = np.zeros(p.shape[1])
    length = 1.0 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p).max()
    for _ in range(steps):
        r = np.maximum(bound, 1 - p @ x)
        x += length * ((tokens * r) @ p - wanted)
    return r


def test_three_domains_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    rows, domain = [], []
    for i in range(360):
        kind = ["clean", "low", "toxic"][[0, 0, 0, 1, 2, 0][i % 6]]
        words = ["word", "other", "third"] if kind != "low" else ["###", "12", "!!"]
        n = int(rng.integers(5, 60))
        text = " ".join(rng.choice(words, n)) + (" idiot" * (kind == "toxic" and i % 12 < 8)) + (" !!" * (i % 5 == 0))
        rows.append((i, text))
        domain.append((i, kind))
    labelled = spark.createDataFrame(domain, "doc_id long, domain string")
    targets = {"clean": 0.86, "low": 0.08, "toxic": 0.06}
    for keep in (None, "clean"):
        got = sorted(mixing.mix(spark, documents(spark, rows), labelled, targets, anchor="clean", keep=keep).collect(), key=lambda r: r.doc_id)
        p, tokens, rate = np.array([r.p for r in got]), np.array([r.tokens for r in got], float), np.array([r.rate for r in got])
        bound = np.where((p[:, 0] >= mixing.KEPT) & (keep is not None), 1.0, 0.0)
        wanted = np.array([targets[d] for d in sorted(targets)]) * (tokens @ p[:, 0]) / targets["clean"]
        assert {r.gap for r in got} == {got[0].gap} and got[0].gap < 1e-6
        assert np.abs((tokens * rate) @ p - wanted).max() < 1e-5 * wanted.sum()
        assert np.abs(plain_projected_gradient(p, tokens, bound, wanted) - rate).max() < 1e-3
        assert (rate >= bound).all() and all(r.copies >= 1 for r, b in zip(got, bound) if b)


def test_targets_out_of_reach_are_told(spark):
    rows = [(i, "same words here") for i in range(40)]
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="out of reach"):
        got = mixing.mix(spark, documents(spark, rows), labelled, {"a": 0.9, "b": 0.1}).collect()
    # every rate gives halves: the nearest totals of the least squares
    assert got[0].gap > 0.1 and len({r.rate for r in got}) == 1 and all(np.isfinite(r.rate) for r in got)


def test_projection_keeps_rates_above_the_least(spark):
    rows = [(i, "good words here and there " * 3) if i % 2 else (i, "BAD!! ### " * 3) for i in range(100)]
    labelled = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(100)], "doc_id long, domain string")
    got = mixing.mix(spark, documents(spark, rows), labelled, {"good": 1.0, "bad": 0.0}, anchor="good").collect()
    assert 0 <= min(r.rate for r in got) < 1e-6 and all(r.rate > 0.5 for r in got if r.doc_id % 2)


def test_minhash_stage_decides_by_row(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, b, 1), (5, a, 1), (5, b + " more", 1), (7, a + " more", 1), (9, "c " + a[::-1], 1), (9, "c " + a[::-1], 2), (None, b, 1), (None, "d " + b[::-1], 1), (None, "d " + b[::-1], 2),
            (11, None, 1), (11, "", 1), (11, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.minhash_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, b), (5, a), (9, "c " + a[::-1]), (None, "d " + b[::-1]), (11, None), (11, "")], key=str)


def test_pipeline_stages(spark):
    from wattledger.llm.common import Scratch, table

    small = "/root/testdata/sf0.01"
    if not os.path.isdir(small):
        pytest.skip("test tables are absent")
    scratch = Scratch(spark, "test-pipeline")
    docs = table(spark, small, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(scratch.keep(stage(spark, frames[-1], small), name))
    assert [f.columns for f in frames[1:-1]] == [docs.columns] * 4
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:-1]]
    toxic = {r.doc_id for r in table(spark, small, "labels").where("toxic = 1").collect()}
    gone = set(texts[0]) - set(texts[1])
    assert len(gone & toxic) >= 0.6 * len(toxic & set(texts[0])) and len(gone - toxic) <= 0.1 * len(texts[0])
    sets = {i: shingles(t, 5) for i, t in texts[1].items()}
    root = union_find([(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], sets)
    assert set(texts[2]) == {i for i in sets if root[i] == i}
    assert set(texts[3]) == set(texts[2]) and not any("AKIA" in (t or "") and "[access]" not in t for t in texts[3].values())
    assert set(texts[4]) <= set(texts[3]) and frames[5].count() == frames[4].count()
    assert frames[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert frames[5].where("size(ids) <> n_tokens").count() == 0


def test_words_apart_give_the_ids_of_whole_texts(monkeypatch):
    """Any white space, scripts and special tokens; a word that comes often is encoded once."""
    ranks = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding, sizes = order.encoder(ranks, public_tokenizers.PATTERN), order.sizes_of(ranks)
    pieces = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "᠎", "a", "b'", "'s", "12", "é", "é", "中文", "😀", "!", "<|endoftext|>", "\r\n"]
    rng = np.random.default_rng(3)
    texts = [None, "", " ", *("".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(5000)), "word " * 40, "long " * 400]
    want = [np.array(encoding.encode_ordinary(t or ""), np.uint16).tobytes() for t in texts]
    for size in (1 << 20, 1000):  # bytes of a slice; the last text is longer
        monkeypatch.setattr(order, "SLICE", size)
        for apart in (False, True):
            arguments = encoding, sizes, pa.array([None, *texts]).slice(1), apart
            assert list(order.token_bytes(np.uint16, *arguments)) == want
            assert (order.count_tokens(*arguments) * 2).tolist() == [len(w) for w in want]
    seen = []
    monkeypatch.setattr(order, "SLICE", 1 << 20)
    counting = SimpleNamespace(encode_ordinary=lambda text: seen.append(len(text)) or encoding.encode_ordinary(text))
    assert order.count_tokens(counting, sizes, pa.array(["some words and " * 1000 + "end"]), True)[0] > 3000
    assert sum(seen) < 40
    with pytest.raises(ValueError, match="crosses"):
        fours = SimpleNamespace(encode_ordinary=lambda text: [0] * (len(text) // 4))
        order.count_tokens(fours, np.array([4]), pa.array(["x bbbb cc"]), True)


def test_order_apart_is_the_same(spark):
    folder = tempfile.mkdtemp(prefix="order-")
    spark.createDataFrame([(i, f"the {i} words  of{i}\n of the text " * i) for i in range(60)], "doc_id long, text string").write.parquet(f"{folder}/docs")
    ranks = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{folder}/docs")
    one, two = (order.materialise(spark, docs, ranks, public_tokenizers.PATTERN, 50256, length=64, per_shard=16, apart=a).collect() for a in (False, True))
    assert sorted(one) == sorted(two) and len(one) > 100
