"""Operators 11 to 13 and the edges of earlier ones, against brute force, finite differences and held-out accuracy."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from graphloom.llm import op1_jaccard, op3_audio, op6_pieces, op9_leaks, op10_secrets, op11_quality, op12_turns, op13_spelling
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def numpy_texts(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data) or b"\0", np.uint8), np.cumsum([0, *map(len, data)])


# Operator 11


def plain_words(text):
    """Runs of letters, digits and other signs of the bytes of a text."""
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\s]+", text.encode().replace(b"\x0b", b" ").replace(b"\x0c", b" "))


@pytest.mark.parametrize("span", [4 << 20, 7, 64])
def test_words_of_texts(monkeypatch, span):
    monkeypatch.setattr(op11_quality, "SPAN", span)
    texts = ["The cat, the hat!! 12", "", "é" * 40 + " x", "   ", "the", "end!the 1the", "a" * 100 + "b"]
    ids, bounds = op11_quality.words(*numpy_texts(texts))
    assert list(np.diff(bounds)) == [len(plain_words(t)) for t in texts]
    told = dict(zip([w for t in texts for w in plain_words(t)], ids.tolist(), strict=True))
    assert [told[w] for t in texts for w in plain_words(t)] == ids.tolist()
    assert len(set(told.values())) == len(told)


@pytest.mark.parametrize("step", [1 << 18, 3])
def test_context_sums(monkeypatch, step):
    monkeypatch.setattr(op11_quality, "STEP", step)
    rng, index = np.random.default_rng(2), op11_quality.index_vectors()
    assert set(np.abs(index).sum(axis=1)) == {op11_quality.NONZERO}
    lists = [rng.integers(0, 9, n) for n in (0, 1, 2, 7, 30)]
    ids, bounds = np.concatenate(lists).astype(np.int32), np.cumsum([0, *map(len, lists)])
    got = np.zeros((op11_quality.BUCKETS, op11_quality.DIMS + 1), np.int64)
    op11_quality.context_sums(ids, bounds, index, got)
    want = np.zeros_like(got)
    for some in lists:
        for i, w in enumerate(some):
            want[w, -1] += 1
            for j in range(max(0, i - 2), min(len(some), i + 3)):
                if i != j:
                    want[w, :-1] += index[some[j]]
    assert (got == want).all()


def test_network_gradients_and_temperature():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((40, 6)), rng.integers(0, 2, 40).astype(float)
    net = op11_quality.Network(5).fit(x, y, steps=3)
    z, weight = (x - net.centre) / net.scale, np.full(40, 1 / 40)
    _, g = net.gradients(z, y, weight, 0.01)
    for name in "wbvc":
        for at in list(np.ndindex(net.p[name].shape))[:6]:
            held = net.p[name][at]
            loss = []
            for step in (1e-5, -1e-5):
                net.p[name][at] = held + step
                loss.append(net.gradients(z, y, weight, 0.01)[0])
            net.p[name][at] = held
            assert abs((loss[0] - loss[1]) / 2e-5 - g[name][at]) < 1e-6
    net.calibrate(x, y)
    told = lambda t: np.mean(np.logaddexp(0, net.logit(x) / t) - y * net.logit(x) / t)
    assert told(net.temperature) <= min(told(t) for t in np.exp(np.linspace(-1.9, 2.9, 50))) + 1e-9


def test_quality_of_odd_rows(spark):
    rows = [(1, "good plain words here " * 9), (2, "BAD!!! $$$ ### " * 9), (2, "BAD!!! $$$ ### " * 9), (3, None), (4, ""), (None, "good plain words"), (5, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "quality": F.lit(7), "hash": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("false")):
        got = op11_quality.score_quality(docs, *op11_quality.learned(docs, some)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id == 2}) == 1 and len({r.score for r in got if r.doc_id in (3, 4)}) == 1
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    assert op11_quality.score_quality(docs.where("false"), *op11_quality.learned(docs.where("false"), labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_quality_is_learned(spark):
    got = op11_quality.query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(got) > 80 and sum(right) / len(right) > 0.97


# Operator 12


def repaired(rows):
    """cost, audit and lines by trying every edit, with a rest that is solved once for each place and state."""
    best, n = {}, len(rows)
    roles = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def rest(i, state, inserted):
        key = i, state, inserted
        if key not in best:
            ways = [(0, "", ())] if i == n and state in ("", "a") else []
            if inserted < 2:
                c, e, out = rest(i, roles[state][0], inserted + 1)
                ways.append((c + 5, "I" + e, (f"{roles[state]}:", *out)))
            if i < n:
                role, text, must, cut = rows[i]
                c, e, out = rest(i + 1, state, 0)
                ways.append((c + 2, "D" + e, out))
                if not must:
                    if role[:1] == "s" and state == "" or role[:1] and role[:1] == roles[state][0]:
                        c, e, out = rest(i + 1, role[:1], 0)
                        ways.append((c + 5 * cut, "K" + e, (f"{role}:{text}", *out)))
                    c, e, out = rest(i + 1, roles[state][0], 0)
                    ways.append((c + 1 + 5 * cut, "R" + e, (f"{roles[state]}:{text}", *out)))
            best[key] = min(ways, default=(10**9, "", ()), key=lambda w: w[:2])
        return best[key]

    return rest(0, "", 0)


def brute_repair(rows):
    """conv_id -> what repair_conversations() returns of it."""
    out = {}
    told = lambda x: " " if x is None else str(x)
    for conv, some in itertools.groupby(sorted(rows, key=lambda r: told(r[0])), key=lambda r: r[0]):
        kept = []
        for _, turn, role, text in some:
            h = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
            text, role = told(text), told(role)
            if h:
                text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
                kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, turns = set(), [], []
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
            turns.append((role, text, faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = repaired(turns)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng, n):
    texts = ["Yes.", "No?", "Well", "", " \n", "Ok! ", "é", None, "Same.", "a.\n b"]
    rows = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 6, 12, 30])):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows + [(1000 + i, 1, "user", "Hello.") for i in range(60)]


@pytest.mark.parametrize("chunk", [512, 3])
def test_conversations_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(op12_turns, "CHUNK", chunk)
    rows = conversations(random.Random(chunk), 120)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "pos": F.lit(2), "copy": F.lit("c")})
    got = {r.conv_id: tuple(r)[1:] for r in op12_turns.repair_conversations(df).collect()}
    want = brute_repair(rows)
    assert got == want
    assert {len(w[6]) > 0 for w in want.values()} == {True, False}
    assert op12_turns.repair_conversations(df.where("false")).count() == 0


def test_chunks_of_a_long_conversation(spark, monkeypatch):
    df = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, IF(id % 7 = 0, '', '.')) AS text")
    got = []
    for chunk in (64, 512, 100_000):
        monkeypatch.setattr(op12_turns, "CHUNK", chunk)
        got.append(op12_turns.repair_conversations(df).first())
    assert got[0] == got[1] == got[2] and got[0].audit.count("K") > 1500 and got[0].truncated > 300


# Operator 13


def test_subtries_by_brute_force():
    rng = random.Random(1)

    def near(s, t):
        return sum(x != y for x, y in zip(s, t, strict=True)) == 1 if len(s) == len(t) else len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    for _ in range(500):
        n = rng.randint(0, 5)
        words = list({"".join(rng.choice("abc") for _ in range(n + rng.randint(0, 1))) for _ in range(12)})
        for open_end in (True, False):
            got = sorted(tuple(sorted(p)) for p in op13_spelling.near_in_subtrie(words, n, open_end))
            pairs = [(i, j, *sorted((words[i], words[j]), key=len)) for i, j in itertools.combinations(range(len(words)), 2)]
            assert got == sorted((i, j) for i, j, s, t in pairs if len(s) == n and near(s, t) and (open_end or len(s) == len(t) or t[:n] != s))


@pytest.mark.parametrize("most", [4096, 2])
def test_spelling_variants_by_brute_force(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdéÿ") for _ in range(rng.choice([7, 8, 12]))) for _ in range(12)]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w.upper()])

    texts = [(i, " ".join(w if rng.random() < 0.6 else changed(w) for w in rng.choices(base, range(12, 0, -1), k=60))) for i in range(40)]
    texts += [(None, " ".join(base)), (7, None), (8, ""), (9, "12 !"), (10, "ab" * 4000 + " " + "ab" * 4000 + "c"), (10, "ab" * 4000 + " " + "ab" * 4000 + "c"), (11, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa ×÷aaaaaaa×÷ " * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "id__": F.lit(0)})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op13_spelling.spelling_variants(df, most=most).collect()}
    assert got == op13_spelling.brute_force(texts) and any(v[0] for v in got.values())
    assert op13_spelling.spelling_variants(df.where("false")).count() == 0


# Edges of earlier operators


@pytest.mark.parametrize("num", [30, 50, 80, 95])
def test_jaccard_at_low_and_high_thresholds(spark, num):
    rng = random.Random(num)
    texts = {i: " ".join(f"w{rng.randrange(8)}" for _ in range(rng.choice([1, 2, 3, 5, 9]))) for i in range(80)}
    for i in range(20):
        words = [f"v{rng.randrange(300)}" for _ in range(30)]
        for j in range(4):
            texts[1000 + 4 * i + j] = " ".join(w if rng.random() > 0.1 else f"z{rng.randrange(999)}" for w in words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_jaccard.jaccard_classes(df, 3, num, 100).collect()}
    assert got == op1_jaccard.brute_force(texts, 3, num, 100)
    if num == 50:
        named = {r.doc_id for r in op1_jaccard.jaccard_classes(df.withColumn("doc_id", F.concat(F.lit("s"), "doc_id")), 3, num, 100).collect()}
        assert named == {f"s{i}" for i in texts}


def test_stages_keep_columns_of_any_name(spark):
    clash = {c: F.lit("own") for c in ("hash__", "of__", "leak_key__", "blob__", "found__", "row__", "judged_id", "key", "set_id", "text_key", "item")}
    body = "a plain text of several words"
    rows = [(1, body, 1), (1, body, 1), (2, body, 2), (3, "password = hunter22x", 3), (4, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumns(clash)
    bench = spark.createDataFrame([(1, "nothing of this is in there")], "item_id long, text string")
    every = {"keep_one": op1_jaccard.keep_one(docs), "drop_leaking": op9_leaks.drop_leaking(docs, bench), "redact": op10_secrets.redact(docs)}
    assert {k: v.count() for k, v in every.items()} == {"keep_one": 3, "drop_leaking": 5, "redact": 5}
    for out in every.values():
        assert out.columns == docs.columns
        assert all(r[c] == "own" for r in out.collect() for c in clash) and {r["a.b"] for r in out.collect()} <= {1, 2, 3, 4}


def test_many_secrets_in_one_text(spark):
    body = "x é " + " ".join(f"password = hunter2x{i} and token:abcdefgh{i}" for i in range(3000))
    df = spark.createDataFrame([(1, body), (2, "clean"), (3, None), (4, "secret=abcdefg"), (5, "password = short and AKIA")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in op10_secrets.redact(df).collect()}
    assert got == {1: "x é " + " ".join(["[assign] and [assign]"] * 3000), 2: "clean", 3: None, 4: "[assign]", 5: "password = short and AKIA"}
    spans = {r.doc_id: (r.n_assign, r.spans) for r in op10_secrets.scan_documents(df).collect()}
    at = [m.span() for m in re.finditer(r"(?:password = |token:)[a-z0-9]+", body)]
    assert spans[1] == (6000, ",".join(f"assign:{a}:{b}" for a, b in at)) and spans[3] == (0, "")


def test_rates_and_channels(spark):
    t = np.arange(800)
    left, right = (8000 * np.sin(t / 9)).astype("<i2"), (8000 * np.cos(t / 7)).astype("<i2")
    stereo = bytearray(op3_audio.wave(op3_audio.PCM, np.stack([left, right], axis=1).tobytes(), 16000))
    stereo[22:24] = (2).to_bytes(2, "little")
    rows = {"16k": op3_audio.wave(op3_audio.PCM, left.tobytes(), 16000), "8k": op3_audio.wave(op3_audio.PCM, left.tobytes(), 8000), "stereo": bytes(stereo), "44k": op3_audio.wave(op3_audio.PCM, left.tobytes(), 44100)}
    got = {r.id: r for r in op3_audio.decode_media(spark.createDataFrame(list(rows.items()), "id string, media binary")).collect()}
    pcm = {k: None if r.pcm is None else np.frombuffer(op3_audio.chunks_of(bytes(r.pcm))[2], "<i2") for k, r in got.items()}
    assert (pcm["16k"] == left).all() and (pcm["8k"][::2] == left).all() and len(pcm["8k"]) == 1600
    assert (pcm["stereo"] == np.rint((left.astype(float) + right) / 2)).all()
    assert pcm["44k"] is None and got["44k"].error == "unknown sampling rate 44100"


def test_ids_that_are_none(spark):
    rows = [(1, [5, 6]), (2, [5, None]), (3, [10**6]), (4, [-1]), (5, None), (6, [])]
    got = {r.doc_id: r.text for r in op6_pieces.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got[1] is not None and got[6] == "" and [got[i] for i in (2, 3, 4, 5)] == [None] * 4
