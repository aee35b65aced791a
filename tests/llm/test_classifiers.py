import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panweave.llm import _text, langid, quality
from tests.llm.conftest import edge_rows, make

SYLLABLES = {"aa": ["the", "and", "ing", "er", "on"], "bb": ["der", "ung", "sch", "ein", "ich"], "cc": ["que", "ción", "los", "ar", "es"]}


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, lang), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 80)]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_language_id(spark):
    rows = corpus()
    docs = make(spark, rows + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in edge_rows()])
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(got[i]["held_out"] == held(i) for i in got)
    own = [r for r in rows if held(r[0])]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in own) / len(own) >= 0.95
    assert [got[1000 + i]["lang_pred"] for i in (4, 5, 6, 12)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"]


def test_language_id_learns_nothing_from_nothing(spark, empty):
    net = langid.train(empty)
    assert langid.identify(empty, net).collect() == []
    assert {r["lang_pred"] for r in langid.identify(make(spark, edge_rows()), net).collect()} == {"und"}


def test_kept_columns(spark, edge):
    docs = make(spark, corpus()[:60])
    got = langid.identify(edge, langid.train(docs), keep=("lang", "text", "doc_id")).collect()
    assert sorted(((r["keep_2"], r["keep_1"], r["keep_0"]) for r in got), key=str) == sorted(((d, t, g) for d, t, g, _ in edge_rows()), key=str)


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "aa") if i % 3 else " | ".join(prose(rng, "aa", 60).split()), "aa", "s") for i in range(240)]
    docs = make(spark, rows + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in edge_rows()])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, *_ in rows] + [(None, 1), (5, None)], "doc_id long, label int")
    got = {r["doc_id"]: r for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    own = [i for i, *_ in rows if held(i)]
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in own) / len(own) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in got.values())


def test_quality_without_labels(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, label int")
    net = quality.train(edge, labels)
    assert len(quality.classify(edge, net).collect()) == len(edge_rows())
    assert quality.classify(empty, net).collect() == []


def test_scores_do_not_depend_on_the_batch():
    """A document scores alike alone, among others, and in pieces."""
    texts = [t or "" for _, t, *_ in edge_rows()]
    for net, score in ((quality.Net(), lambda n, c: n.score(c)), (langid.Net(["a", "b"]), lambda n, c: n.score(c))):
        together = np.concatenate([score(net, c) for c in _text.chunks(pa.array(texts, pa.large_string()), 1 << 30)])
        alone = np.concatenate([score(net, c) for t in texts for c in _text.chunks(pa.array([t], pa.large_string()))])
        assert np.allclose(together, alone, atol=1e-5)


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    from panweave.llm import _conv

    assert all(r["h"] == held(r["doc_id"]) for r in df.withColumn("h", _conv.held_out(F.col("doc_id"))).collect())


def chunk(texts):
    return next(_text.chunks(pa.array(texts, pa.large_string()), 1 << 30))


SMALL = ["", "a", "the cat — sat é on the mat " * 9, "x" * 64, "y z" * 50, "stutter stutter stutter stutter " * 12]


def plain_quality(net, text):
    """The network as its docstring tells it, a byte at a time."""
    p, data = net.p, text.encode()
    z = np.zeros((len(data), quality.FILTERS))
    for i in range(len(data)):
        for j in range(quality.WIDTH):
            z[i] += p["emb"][data[i + j] if i + j < len(data) else 0] @ p["filters"][j]
    z = np.maximum(z + p["bias"], 0)
    same = np.array([[float(i >= lag and data[i] == data[i - lag]) for lag in quality.LAGS] for i in range(len(data))]).reshape(len(data), len(quality.LAGS))
    blocks, size = max(1, -(-len(data) // quality.BLOCK)), quality.BLOCK
    units = []
    for b in range(max(1, blocks - 1)):
        own = slice(b * size, (b + 2) * size)
        n = max(1, len(z[own]))
        lag = same[own].sum(axis=0) / n
        x = np.concatenate((z[own].sum(axis=0) / n, [2 * lag.max(initial=0), 4 * lag.mean()]))
        units.append(np.tanh(x @ p["mixer"] + p["mixer_bias"]))
    return 1 / (1 + np.exp(-(np.max(units, axis=0) @ p["out"] + p["prior"][0])))


def plain_language(net, text):
    data, total, out = text.encode(), 0, 0
    for a in range(0, max(1, len(data)), langid.WINDOW):
        part = data[a : a + langid.WINDOW]
        pooled = []
        for w in langid.WIDTHS:
            best = np.zeros(langid.FILTERS)
            for i in range(len(part)):
                z = net.p[f"b{w}"].copy()
                for j in range(w):
                    at = a + i + j  # a filter looks on into the next window
                    z += net.p["emb"][data[at] if at < len(data) else 0] @ net.p[f"f{w}"][j]
                best = np.maximum(best, z)
            pooled.append(best)
        logit = np.concatenate(pooled) @ net.p["out"] + net.p["out_bias"]
        e = np.exp(logit - logit.max())
        out, total = out + e / e.sum() * max(1, len(part)), total + max(1, len(part))
    return out / total


def test_forward_passes_match_a_plain_version():
    net = quality.Net()
    net.p["bias"] += 0.1
    assert np.allclose(net.score(chunk(SMALL)), [plain_quality(net, t) for t in SMALL], atol=1e-5)
    net = langid.Net(["a", "b", "c"])
    assert np.allclose(net.score(chunk(SMALL)), [plain_language(net, t) for t in SMALL], atol=1e-5)


def numeric(loss, array, places, step=1e-3):
    out = []
    for at in places:
        kept = array[at]
        array[at] = kept + step
        high = loss()
        array[at] = kept - step
        low = loss()
        array[at] = kept
        out.append((high - low) / (2 * step))
    return np.array(out)


def test_quality_gradients_are_those_of_the_loss():
    from panweave.llm import _conv

    net, y = quality.Net(), np.array([1.0, 0.0, 1.0, 0.0, 1.0, 0.0])
    lay = _conv.Layout(chunk(SMALL), quality.BLOCK)
    lags = net.lags(lay)
    grads = net._grads(lay, lags, y)

    def loss():
        prob = net.score(chunk(SMALL))
        decay = 0.5e-4 * ((net.p["out"] ** 2).sum() + (net.p["mixer"] ** 2).sum())
        return -np.mean(y * np.log(prob) + (1 - y) * np.log(1 - prob)) + decay

    r = np.random.default_rng(1)
    for name, array in net.p.items():
        places = [tuple(r.integers(0, n) for n in array.shape) for _ in range(12)]
        if name == "emb":
            places = [(ord(c), k) for c in "xtsy" for k in range(3)]
        want = numeric(loss, array, places)
        assert np.allclose([grads[name][p] for p in places], want, atol=2e-4, rtol=0.03), name


def test_language_gradients_are_those_of_the_loss():
    from panweave.llm import _conv

    net, texts = langid.Net(["a", "b", "c"]), [t for t in SMALL if t]
    data, valid = np.zeros(len(texts) * langid.WINDOW + _conv.HALO, np.uint8), np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        part = t.encode()[: langid.WINDOW - _conv.HALO]
        data[k * langid.WINDOW : k * langid.WINDOW + len(part)] = np.frombuffer(part, np.uint8)
        valid[k] = len(part)
    y = np.array([0, 1, 2, 0, 1])
    grads = net._grads(data, valid, y)

    def loss():
        prob = net._soft(net._pool(data, valid, net._looked())[0])
        return -np.mean(np.log(prob[np.arange(len(y)), y])) + 0.5e-4 * (net.p["out"] ** 2).sum()

    r = np.random.default_rng(2)
    for name, array in net.p.items():
        places = [(ord(c), k) for c in "xtsy" for k in range(3)] if name == "emb" else [tuple(r.integers(0, n) for n in array.shape) for _ in range(12)]
        assert np.allclose([grads[name][p] for p in places], numeric(loss, array, places), atol=5e-4, rtol=0.05), name


def test_an_id_with_two_labels_or_texts_gives_each_pair(spark):
    from panweave.llm import _conv

    docs = spark.createDataFrame([(1, "one"), (1, "two"), (2, "three"), (3, "x" * 50), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (9, 1), (2, None)], "doc_id long, label int")
    want = {(d, t, v) for d, t, v in [(1, "one", 0), (1, "one", 1), (1, "two", 0), (1, "two", 1), (2, "three", 1)] if not held(d)}
    got = _conv.training_rows(docs, labels, 100, 20)
    assert set(got) == want and len(got) == len(want)
    assert len(_conv.training_rows(docs, labels, 1, 20)) <= 1
