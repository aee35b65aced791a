"""The pipeline against a plain version of its stages, and each stage on odd and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import edge_rows, make
from tests.llm.test_classifiers import prose
from tests.llm.test_minhash import brute as components
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secrets_rules_chat import base
from tests.llm.test_sharding_mixing import targets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], COLUMNS)


def corpus():
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, rng.randrange(5, 90)), lang, f"s{i % 4}") for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(10)]
    rows += [(300 + i, rows[i][1] + f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}"', rows[i][2], "s2") for i in range(20, 26)]
    return rows + [(400, None, "aa", "s1"), (401, "123 456", "aa", "s1"), (402, "", None, "s0")]


def plain_language(rows):
    return [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]


def plain_dedup(rows):
    kept = {d for d, _, _, k in components(rows) if k}
    return list({r[0]: r for r in rows if r[0] in kept}.values())


def plain_redact(rows, example_owners=5, least=5):
    owners = {}
    for _, t, _, s in rows:
        for b in base(t or ""):
            owners.setdefault(b[4], set()).add(s)
    out = []
    for d, t, lang, s in rows:
        at, text = 0, ""
        for _, a, b, _, v in base(t or ""):
            if len(owners[v]) < example_owners and len(set(v)) >= least:
                if a >= at:
                    text += t[at:a] + "[secret]"
                at = max(at, b)
        out.append((d, text + (t or "")[at:] if at else t, lang, s))
    return out


def plain_mix(rows, seed="mix-1"):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, *_) in enumerate(rows)}
    sizes = Counter()
    for i, r in enumerate(rows):
        sizes[r[3]] += size[i]
    goal, out = targets(dict(sizes)), []
    for s in sizes:
        def order(i):
            mark = hashlib.md5(str(rows[i][0]).encode()).hexdigest()
            return len(str(size[i])), str(size[i])[:2], mark[:2], size[i], mark

        u = int(hashlib.md5((seed + ("" if s is None else "=" + s)).encode()).hexdigest()[:8], 16) / 2**32
        rate = goal[s] / sizes[s] if sizes[s] else 0
        for k, i in enumerate(sorted((i for i, r in enumerate(rows) if r[3] == s), key=order)):
            out += [rows[i]] * ((math.floor(rate * (k + 1) + u) - math.floor(rate * k + u)) if size[i] else 0)
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


def test_stages_match_a_plain_version(spark, tmp_path):
    rows = corpus()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = [plain_language, plain_dedup, plain_redact, plain_mix]
    for (name, stage), same in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = same(rows)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows_of(docs) == sorted(rows, key=str), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
    check_packing(rows, corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_stages_on_odd_tables(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name
        out = stage(spark, edge, "")
        if name != "best_fit_packing":
            assert out.columns == edge.columns, name
        assert out.count() >= 0
    once = corpus_pipeline.near_dedup(spark, make(spark, edge_rows() + edge_rows()), "")
    ids = Counter(r["doc_id"] for r in once.collect())
    assert all(n == 1 for d, n in ids.items() if d is not None) and {1, 4, 5, 6, 7, 8, 10} <= set(ids)
