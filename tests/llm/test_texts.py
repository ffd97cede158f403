"""Per-text operators: encoding, secrets, toxicity, quality."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tests.llm.data import documents, words
from wattledger.llm import bpe, quality, secrets, toxicity
from wattledger.llm.common import remainder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


ODD = ["<|endoftext|>a<|startoftext|>", "a<|endoftext|> b", "", " \t\n", "ΑΣ ΣΑΣ", "é ́x", "it's WE'LL 's't", "日本語 ½² ⅷ", "a\x1cb\x85c d",
       "x" * 3000, "ab " * 20_000, "İstanbul ÅK", "!?!? ... 12345"]


def test_bpe_equals_library(vocabulary):
    library, own = tokenizers.Tokenizer.from_file(PATH), bpe.WordBpe(vocabulary, limit=500)
    rng = random.Random(1)
    letters = "abcdeABC  \n\t'.,!?#0123日éÉñßΣσİ́ \x1c\x85​😀½'s't<|endoftext|>"
    for text in ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]:
        e = library.encode(text, add_special_tokens=False)
        decoded = library.decode(e.ids, skip_special_tokens=False)
        assert own.encode(text) == e.ids and own.decode(e.ids) == decoded
        assert own.digest(text) == (len(e.ids), " ".join(map(str, e.ids)), decoded)


def test_every_code_point_is_split_as_by_the_library(vocabulary):
    library, own = tokenizers.Tokenizer.from_file(PATH), bpe.WordBpe(vocabulary)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for begin in range(0, len(points), 512):
        text = "".join(f"x{c}y{c}{c}!{c} {c}1\n" for c in points[begin : begin + 512])
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_a_million_special_tokens_and_one_long_word(vocabulary):
    own = bpe.WordBpe(vocabulary)
    begun = time.process_time()
    assert own.digest("<|endoftext|>" * 1_000_000)[0] == 1_000_000
    assert own.digest("ab" * 100_000)[0] > 0 and time.process_time() - begun < 30


def test_bpe_operator(spark, vocabulary):
    library = tokenizers.Tokenizer.from_file(PATH)
    texts = [*ODD, None, ODD[0]]
    got = {r.doc_id: r for r in bpe.encode_digest(documents(spark, texts), vocabulary).collect()}
    full = {r.doc_id: r for r in bpe.encode(documents(spark, texts), vocabulary).collect()}
    both = {r.doc_id: r for r in bpe.encode_digest(documents(spark, texts), vocabulary, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert (full[i].ids, full[i].decoded, both[i].ids) == (ids, decoded, ids)
    assert bpe.encode_digest(documents(spark, []), vocabulary).collect() == []


SECRETS = ['password="hunter2xyz" and Token: abc', "api_key = a.b-c_d/e+f API-KEY=123456", "AKIA" + "Z" * 16 + " AKIA" + "Q" * 15,
           "x" + "0123456789abcdef" * 2 + "g", "passwordpassword=short", "secret:secret=abcdef", "pwd: aaaaaaaaaaaa db_pass=x8Kd92mQzL0pRt", None, "",
           "é😀 password=abcdefgh", "PASSWD:'deadbeefdeadbeefdeadbeef'", "ſecret=abcdefgh toKen=abcdefgh"]


def secrets_brute(text):
    key = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(found)]


def test_secrets(spark, vocabulary):
    got = {r.doc_id: r for r in secrets.find_secrets(documents(spark, SECRETS), vocabulary).collect()}
    for i, text in enumerate(SECRETS):
        base = secrets_brute(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(got[i].spans.split(",")) | {""}
    spans = got[6].spans
    assert spans == f"guess:{SECRETS[6].index('x8Kd')}:{len(SECRETS[6])}"  # a run of one letter is cheap to guess
    assert secrets.find_secrets(documents(spark, []), vocabulary).collect() == []


def test_short_values_long_names_and_tabs(vocabulary):
    scanner = secrets.Scanner(vocabulary, 10.0)
    name = "token_" + "x_" * 30
    for text, value in [("db_pwd: Xk9#mQ2", "Xk9#mQ2"), ("pin is q7x2vz", "q7x2vz"), (f"{name}=x8Kd92mQzL0pRt", "x8Kd92mQzL0pRt"), ("a" * 90 + "_pwd: x8Kd92mQzL0pRt", "x8Kd92mQzL0pRt"),
                        ("pwd\tis\tx8Kd92mQzL0pRt", "x8Kd92mQzL0pRt"), ("url=http://h/?auth=x8Kd92mQzL0pRt", "x8Kd92mQzL0pRt")]:
        assert [text[a:b] for a, b, *_ in scanner.added(text)] == [value], text
    assert not scanner.added("pwd: monkey") and not scanner.added("key: aaaaaaa") and not scanner.added("login: password")
    assert scanner.added("key" * 100_000) == []  # in proportion to the length


ORDINARY = [
    "author: Kowalczyk", "Authors: Szymborska", "opinion: Zwölferrat", "monkey = Makak-Affe", "passage: Überfahrt", "The spinach is Blattspinat", "keyboard: qwertyuiop1234",
    "tokenizer: BertWordPiece", "secretary: Wiśniewska", "compass = Nordnordost", "The key is Verständnis,", "bypass: Umgehungsstraße", "pin: Wimmelbild", "hockey is Eishockey",
    "see http://example.com/a:b@c", "a bearer certificate", "basic understanding", "--keyword searching",
]
CREDENTIALS = [
    ("userPwd=x8Kd92mQzL", "x8Kd92mQzL"), ("X-Auth-Key: q7x2vzk9", "q7x2vzk9"), ("mysql --password x8Kd92mQzL -u me", "x8Kd92mQzL"), ("<db.pass>x8Kd92mQzL</db.pass>", "x8Kd92mQzL"),
    ("postgres://me:x8Kd92mQzL@host/db", "x8Kd92mQzL"), ("Authorization: Bearer q7x2vzk9Pm", "q7x2vzk9Pm"), ("accessKey => q7x2vzk9Pm", "q7x2vzk9Pm"), ("pin is xkqvbzwj", "xkqvbzwj"),
    ("DB_PASS='x8Kd92mQzL'", "x8Kd92mQzL"), ("login: zqxjkvbp", "zqxjkvbp"), ("ssh-key = q7x2vzk9Pm", "q7x2vzk9Pm"), ("secret is correcthorsebatterystaple", "correcthorsebatterystaple"),
]


def test_names_and_words_that_are_no_secrets(vocabulary):
    scanner = secrets.Scanner(vocabulary, 10.0)
    assert [t for t in ORDINARY if scanner.scan(t)[1]] == []
    for text, value in CREDENTIALS:
        base, spans = scanner.scan(text)
        assert base == [] and [text[a:b] for a, b, *_ in spans] == [value], text
    # the base has these already
    base, spans = scanner.scan("password = x8Kd92mQzL and token: q7x2vzk9Pm")
    assert spans == base and len(base) == 2
    assert scanner.scan("password = x8Kd92mQzL#Qq9")[1][1][2] == "guess"  # goes on after the base span


def test_guess_cost_is_least(vocabulary):
    guess = secrets.GuessCost(secrets.word_ranks(vocabulary))

    def least(value):  # all segmentations, with the costs of single segments
        n = len(value)
        if not n:
            return 0.0
        best = float("inf")
        for k in range(1, n + 1):
            cost, parts = guess.segments(value[:k])
            if len(parts) == 1:
                best = min(best, cost + least(value[k:]))
        return best

    for value in ["passw0rd", "qwer1999", "aaaaab", "zx9!kq", "Love2021", "dragonqq"]:
        cost, parts = guess.segments(value)
        assert abs(cost - least(value)) < 1e-9 and [parts[0][0], parts[-1][1]] == [0, len(value)]
    assert guess.cost("password") < guess.cost("Password1") < guess.cost("x8Kd92mQzL0pRt")
    assert guess.cost("ab" * 5000) > 0


def test_redact(spark, vocabulary):
    rows = {r.doc_id: r.text for r in secrets.redact(documents(spark, SECRETS), vocabulary).collect()}
    assert rows[7] is None and rows[8] == "" and "hunter2" not in rows[0] and rows[9] == "é😀 [assign]"


INSULTS = ["moron", "scumbag", "worthless", "idiot"]


def toxic_corpus(n=260, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, y = words(rng, rng.randint(5, 60)), i % 4 == 0
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((i, " ".join(w), int(y)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus()
    extra = [(1000, "you 1d10t babu", 1), (1001, "you m o r o n dado", 1), (1002, "s.c.u.m.b.a.g like", 1), (1003, "wooorthlesss", 1), (1004, "babu dado like", 0),
             (1005, None, 0), (1006, "", 0), (1007, "kala " * 30_000, 0)]
    docs = documents(spark, [(i, t) for i, t, _ in rows + extra] + [(None, "moron idiot")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(rows[0][0], 1, 1), (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(spark, docs, labels).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held and all(got[i].predicted == y for i, _, y in rows)
    assert {i: got[i].predicted for i, _, _ in extra} == {i: y for i, _, y in extra}
    assert got[None].predicted == 1 and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_of_words_set_apart(spark):
    rows = toxic_corpus()
    phrase = " ".join("babudadokalababumorondadokalababu")
    assert len(phrase) > 60
    extra = [(1000, "what a m o r o n", 1), (1001, f"dado {phrase} kala", 1), (1002, "babu mo-ron", 1), (1003, "babu id.iot dado", 1), (1004, "you-mo-ron babu", 1),
             (1005, "babu" + "-" * 60 + "m-o-r-o-n", 1), (1006, "b a b u k a l a d a d o", 0), (1007, "babu-dado ka.la", 0), (1008, "a b " * 40_000, 0)]
    docs = documents(spark, [(i, t) for i, t, _ in rows + extra])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(spark, docs, labels).collect()}
    assert {i: got[i].predicted for i, _, _ in extra} == {i: y for i, _, y in extra}


PLAIN_DISGUISES = [
    "you m0r0n!", "m0r0n!!!", "mmoorroonn", "m\to\tr\to\tn", "m\no\nr\no\nn", "m    o    r    o    n", "m\u200bo\u200br\u200bo\u200bn", "mo ron", "sc um ba g",
    "m/o/r/o/n", "m,o,r,o,n", "s=c=u=m=b=a=g", "a s s", "a  s\ts", "1d!0t", "sc|_|mbag scvm m.0.r.0.n", "dado m o r o n s", "wor\xadth\xadless", "m\x00o\x00r\x00o\x00n",
]
HARMLESS = ["babu da do ka la", "no rom mo la", "b/a/b/u", "as la so", "12,500 3/4 da=do", "mama papa dada", "bb aa bb uu", "l i o n", "an us er"]


def test_plain_disguises(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        w, y = words(rng, rng.randint(5, 60)), i % 4 == 0
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice([*INSULTS, "ass"]))
        rows.append((i, " ".join(w), int(y)))
    extra = [(1000 + k, f"babu dado {t} kala", 1) for k, t in enumerate(PLAIN_DISGUISES)] + [(2000 + k, f"babu {t} kala", 0) for k, t in enumerate(HARMLESS)]
    docs = documents(spark, [(i, t) for i, t, _ in rows + extra])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(spark, docs, labels).collect()}
    assert [t for i, t, y in extra if got[i] != y] == []


def test_decoding_is_the_best_of_all_readings():
    rng = np.random.default_rng(3)
    restorer = toxicity.Restorer(toxicity.language_model(rng.integers(0, 50, toxicity.A**3)))

    def every(token, at=0, state=(0, 0), before=""):  # price and letters of every reading
        if at == len(token):
            yield restorer.model[state[0]][state[1]][0], ""
            return
        c = token[at]
        code = int(toxicity.CODES[ord(c)]) if ord(c) < toxicity.CODES.size else 0
        options = ([(code, 0.0)] if code else []) + [(toxicity.LETTERS.index(x) + 1, toxicity.SUBSTITUTION) for x in toxicity.READINGS.get(c, "")]
        if not c.isalnum() or c == before or not options:
            for score, text in every(token, at + 1, state, c):
                yield score - toxicity.DROP, ("" if c.isalnum() else ".") + text
        for code, price in options:
            for score, text in every(token, at + 1, (state[1], code), c):
                yield score - price + restorer.model[state[0]][state[1]][code], toxicity.LETTERS[code - 1] + text

    for token in ["m0r0n!", "m.0r-0n", "1d!0t", "mmoorroonn", "b6!!1+x", "b-a-s-e", "(|asses", "h4ll0o0"]:
        best = max(every(token))
        assert best[1] == restorer._readings(token)[0]


def test_hints_miss_no_disguise():
    hints = toxicity.Hints(["=moron", "scum", "=ass"])
    assert all(hints.any(t.replace("\n", " "), whole=True) for t in PLAIN_DISGUISES if "m" in t and "d!" not in t and "th" not in t)
    assert not toxicity.Hints(["=moron"]).any("babu dado kala") and not toxicity.Hints([]).any("moron")
    assert toxicity.Hints(["=worthless"]).any("w0rthle55", whole=True)


def test_the_lexicon_does_not_depend_on_the_size_of_the_sample(spark):
    """A word in seven toxic texts and no clean one is learned whatever the number of others."""
    for n in (100, 2000):
        rng = random.Random(n)
        rows = [(" ".join(words(rng, 12)) + (" zorbling" if i < 7 else ""), int(i % 2 == 0 or i < 7), 1.0) for i in range(n)]
        sample = spark.createDataFrame(rows, "text string, y int, w double")
        found = toxicity.lexicon(sample, toxicity.language_model(np.ones(toxicity.A**3)))
        assert "=zorbling" in found


def test_windows_of_long_tokens():
    token = ".".join("abcdefghijklmnopqrstuvwxyz" * 20)
    windows = toxicity.Restorer.windows(token)
    assert all(len(w) <= toxicity.WINDOW for w in windows) and "".join(windows).count("a") >= 20
    assert all(any(token[k : k + 47] in w for w in windows) for k in range(0, len(token) - 46, 2))
    assert not toxicity.Restorer.disguised("he'll") and toxicity.Restorer.disguised("mor'on")


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["babu dado", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.01 for r in toxicity.score_documents(spark, docs, labels).collect())
    assert toxicity.score_documents(spark, documents(spark, []), labels).collect() == []


def test_trigram_counts_cover_all_texts(spark):
    counts = toxicity.trigram_counts(documents(spark, ["ab", "Ab, äb", None]))
    assert counts.sum() == 3 * 3 and counts[(0 * 27 + 1) * 27 + 2] == 3


def test_quality(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        w = words(rng, rng.randint(5, 80))
        y = i % 3 != 0
        texts.append(". ".join(w) if y else rng.choice([" | ".join(w), " ".join(w[:1] * len(w)), " ".join(x + "###" for x in w)]))
        labels.append((i, int(y), 0))
    docs = documents(spark, [*texts, None, "", "z " * 50_000])
    table = spark.createDataFrame([*labels, (None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(spark, docs, table).collect()}
    held = [(got[i].predicted, y) for i, y, _ in labels if got[i].held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    assert got[300].score == got[301].score and len(got) == 303
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(spark, docs, none).collect()} == {0.5}
    assert quality.score_documents(spark, documents(spark, []), table).collect() == []


def test_additive_model_equals_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    gam = quality.fit(x, y, np.ones(400))
    b = gam.bins(x[:5])
    by_hand = [gam.intercept + sum(t[b[r, k]] for k, t in enumerate(gam.tables)) + sum(t[gam.coarse[i][b[r, i]], gam.coarse[j][b[r, j]]] for i, j, t in gam.pairs) for r in range(5)]
    assert np.allclose(gam.margin(b), by_hand)
    assert ((gam.score(x) >= 0.5) == y).mean() > 0.9  # only the pair of the first two features tells the classes apart
    assert {0, 1} == set(gam.pairs[0][:2])


def test_remainder(spark):
    import zlib

    row = spark.createDataFrame([(17,)], "doc_id long").select(remainder("doc_id", 5)).first()
    assert row[0] == zlib.crc32(b"17") % 5


def test_cuts_are_the_best_of_all():
    """The searches of the shallow trees against every cut and every pair of cuts."""
    rng = np.random.default_rng(5)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(40):
        g, h = rng.normal(size=9), rng.random(9) * 5
        best = max((gain(g[:k], h[:k]) + gain(g[k:], h[k:]) - gain(g, h), -k) for k in range(1, 9))
        found = quality._best_cut(g, h)
        assert abs(found[0] - best[0]) < 1e-9 and found[1] == -best[1]
        g2, h2 = rng.normal(size=(5, 6)), rng.random((5, 6)) * 3
        quadrants = lambda i, j: [(rows, cols) for rows in (slice(0, i), slice(i, None)) for cols in (slice(0, j), slice(j, None))]
        every = {(i, j): sum(gain(g2[q], h2[q]) for q in quadrants(i, j)) - gain(g2, h2) for i in range(1, 5) for j in range(1, 6)}
        value, table = quality._pair_tree(g2, h2)
        i, j = max(every, key=every.get)
        assert abs(value - every[i, j]) < 1e-9
        for q in quadrants(i, j):
            assert np.allclose(table[q], g2[q].sum() / (h2[q].sum() + 1))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.random((300, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair of features tells
    gam = quality.fit(x, y, np.ones(300), rounds=5, pair_rounds=20)
    scores = gam.score(x)
    for row, score in zip(x[:40], scores):
        bins = [int((row[k] >= np.asarray(e)).sum()) for k, e in enumerate(gam.edges)]
        margin = gam.intercept + sum(t[b] for t, b in zip(gam.tables, bins))
        margin += sum(t[gam.coarse[i][bins[i]], gam.coarse[j][bins[j]]] for i, j, t in gam.pairs)
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-9
    assert ((scores > 0.5) == (y > 0.5)).mean() > 0.9 and {0, 1} in [{i, j} for i, j, _ in gam.pairs]
