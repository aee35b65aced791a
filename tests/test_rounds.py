"""Orders that were folds, as rounds over tables, against the folds; clustering at any size; block trimming by its rules."""

import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from panweave.functions import models
from panweave.operators import graph, growth, msa
from panweave.operators import sequences as Q
from panweave.plans import pipelines
from panweave.tables import Tables


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def folded_pairs(pairs):
    home = {}
    for _, a, b in sorted(pairs):
        if a not in home and b in home:
            home[a] = home[b]
        else:
            home.setdefault(a, a)
            home.setdefault(b, home[a])
    return sorted((c, m) for m, c in home.items())


@pytest.mark.parametrize("genes", [30, 400])
def test_clusters_of_pairs_are_the_fold(spark, genes):
    """Random pairs, a hub that a third of all pairs name, a long chain, pairs of a gene with itself."""
    rng = random.Random(genes)
    pairs = [(f"g{rng.randrange(genes)}", f"g{rng.randrange(genes)}") for _ in range(300)] + [("hub", f"h{k}") for k in range(150)] + [(f"c{k}", f"c{k + 1}") for k in range(100)]
    rng.shuffle(pairs)
    pairs = [(k, *p) for k, p in enumerate(pairs)] + [(1000 + k, f"d{k + 1}", f"d{k}") for k in range(120)]
    df = spark.createDataFrame(pairs, "ord long, a string, b string")
    assert values(pipelines.pairs_to_clusters(Tables(spark, "p"), df)) == folded_pairs(pairs)
    assert pipelines.pairs_to_clusters(Tables(spark, "p"), df.limit(0)).count() == 0


def folded_absorption(pairs):
    out = {}
    for g in {g for g, *_ in pairs}:
        rep = {}
        for q, s in sorted((q, s) for h, q, s in pairs if h == g and q != s):
            if q not in rep and s not in rep:
                rep[s] = q
        out |= rep
    return sorted(out.items())


def test_absorption_is_the_fold(spark):
    """Pairs in both directions, one taxon with all rows, chains that decide one after the other, repeated pairs."""
    rng = random.Random(3)
    pairs = [("t", rng.randrange(150), rng.randrange(150)) for _ in range(500)] + [("u", 1000 + k, 1001 + k) for k in range(9)] + [("v", 2000, 2001 + k) for k in range(50)] + [("t", 5, 5)]
    df = spark.createDataFrame(pairs + pairs[:40], "taxon string, q long, s long")
    assert values(graph.greedy_absorb(df, "taxon")) == sorted(folded_absorption(pairs), key=str)
    assert graph.greedy_absorb(df.limit(0), "taxon").count() == 0


def blobs(rng, n, size):
    links = []
    for k in range(n):
        own = [100 * k + i for i in range(size)]
        links += [(a, b, 5.0 + rng.random()) for a, b in itertools.combinations(own, 2) if rng.random() < 0.7]
        links.append((100 * k, 100 * ((k + 1) % n) + 1, 0.4 + rng.random() / 10))
    return sorted({(min(a, b), max(a, b)): w for a, b, w in links}.items())


def test_markov_clusters_are_the_same_at_any_size(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in blobs(rng, 5, 9)] + [(9000, 9001, 1.0), (9001, 9001, 3.0)], "a long, b long, w double")
    dense, sparse = values(graph.mcl(Tables(spark, "m"), df)), values(graph.mcl(Tables(spark, "m"), df, dense=0))
    assert dense == sparse and len({c for _, c in dense}) == 6
    assert graph.mcl(Tables(spark, "m"), df.limit(0), dense=0).count() == 0


def test_columns_wider_than_any_cap(spark):
    """A hub of 300 leaves: its column has more cells than the 64 that were kept once."""
    df = spark.createDataFrame([(0, k, 1.0 + k / 1000) for k in range(1, 301)], "a long, b long, w double")
    assert values(graph.mcl(Tables(spark, "m"), df, dense=0)) == values(graph.mcl(Tables(spark, "m"), df)) == [(k, 0) for k in sorted(range(301), key=lambda k: str((k, 0)))]


def test_rounds_that_run_out_are_an_error(spark):
    links = pd.DataFrame(blobs(random.Random(1), 4, 9), columns=["ab", "w"])
    links = pd.DataFrame({"a": [x[0] for x in links["ab"]], "b": [x[1] for x in links["ab"]], "w": links["w"]})
    with pytest.raises(RuntimeError):
        graph.markov_clusters(links, 1.5, rounds=1)
    with pytest.raises(RuntimeError):
        graph.sparse_mcl(Tables(spark, "m"), spark.createDataFrame(links), rounds=1)


@pytest.mark.parametrize(("n", "samples"), [(0, 3), (1, 4), (3, 10), (4, 24), (9, 30), (25, 12)])
def test_orders_are_distinct(spark, n, samples):
    taxa = [f"t{i:02}" for i in range(n)]
    orders = {}
    for r in sorted(growth.permutations(spark, taxa, samples, 5).collect()):
        assert r["g"] == len(orders.setdefault(r["sample"], []))
        orders[r["sample"]].append(r["taxon"])
    assert len(orders) == (min(samples, math.factorial(n)) if n else 0) and all(sorted(o) == taxa for o in orders.values())
    assert len({tuple(o) for o in orders.values()}) == len(orders) and orders.get(0, taxa) == taxa
    if n > 3:
        other = {r["sample"]: r["taxon"] for r in growth.permutations(spark, taxa, samples, 6).filter("g = 0").collect()}
        assert other != {s: o[0] for s, o in orders.items()}


def test_twins(spark):
    """Rows of two files: equal, held, with N, turned round, empty, missing on either side."""
    nt = [("a", 1, "ATGAAATAA"), ("b", 1, "ATGAAATAA"), ("c", 1, "ATGNAATAA"), ("d", 1, "ATGAAATAA"), ("e", 1, "ATGAAATAA"), ("f", 1, "ATGAAATAA"), ("f", 2, "ATGTAA"), ("h", 1, "TAA"), ("i", 1, "ATGAAATAA")]
    aa = [("a", 1, "MK*"), ("b", 1, "XMKX"), ("c", 1, "W"), ("d", 1, "KM"), ("e", 1, ""), ("f", 1, "MK"), ("g", 1, "MK"), ("h", 1, ""), ("i", 1, "mk")]
    make = lambda rows: spark.createDataFrame(rows, "file string, place long, seq string")
    got = dict(values(Q.twins_agree(make(nt), make(aa), "file")))
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": False, "g": False, "h": True, "i": False}


ROLES = [("d0", "diploid", 1.0, 0), ("d1", "diploid", 1.0, 1), ("d2", "diploid", 1.0, 2), ("d3", "diploid", 0.2, 3), ("d4", "diploid", 0.2, 4), ("o", "outgroup", 0.0, 5), ("p", "polyploid", 0.0, 6), ("q", "polyploid", 0.0, 7)]


def plain_block(rows, min_weight, min_length, max_gaps, min_cover, isoform):
    """One alignment, {(taxon, name): seq}, step by step."""
    bases = lambda s: len(re.sub("[^ACGTN]", "", s))
    of = lambda t: sorted((-bases(s), n, s) for (x, n), s in rows.items() if x == t)

    def reach(s, low, high):
        while low < len(s) and s[low] == "-":
            low += 1
        while high >= 0 and s[high] == "-":
            high -= 1
        return low, high

    low, high, weight, out = 0, len(next(iter(rows.values()))) - 1, 0.0, []
    for t, role, w, _ in ROLES:
        if role == "diploid" and of(t):
            weight += w
            low, high = reach(of(t)[0][2], low, high)
            out.append((t, of(t)[0][1], of(t)[0][2]))
    n = high - low + 1
    if weight <= min_weight or n < min_length or any(s[low : high + 1].count("-") > max_gaps for *_, s in out):
        return []
    for t, role, *_ in ROLES:
        if role == "outgroup" and of(t):
            a, b = reach(of(t)[0][2], low, high)
            if (b - a + 1) / n < min_cover:
                return []
            out.append((t, of(t)[0][1], of(t)[0][2]))
        if role == "polyploid":
            kept, seen = [], set()
            for _, name, s in of(t):
                m = isoform and re.search(isoform, name)
                if m and m[0] in seen:
                    continue
                seen.add(m and m[0])
                a, b = reach(s, low, high)
                if (b - a + 1) / n >= min_cover and not any(k[a : b + 1] == s[a : b + 1] for k in kept):
                    kept.append(s)
                    out.append((t, name, s))
    return [(t, name, s[low : high + 1]) for t, name, s in out]


@pytest.mark.parametrize("isoform", [None, r"c\d+_g\d+_i"])
def test_blocks_follow_the_rules(spark, isoform):
    rng = random.Random(7)
    rows, want = [], []
    for aln in range(40):
        base = "".join(rng.choice("ACGT") for _ in range(60))
        own = {}
        for t, *_ in ROLES:
            if rng.random() < 0.06:
                continue
            for k in range(rng.choice([1, 1, 2]) if t < "p" else rng.choice([1, 3, 4])):
                s = [c if rng.random() > (0.01 if t > "n" else 0.05) else rng.choice("ACGT-N") for c in base]
                a, b = rng.choice([0, 0, 2, 5, 9, 30]) if t > "n" else rng.randrange(8), rng.randrange(8)
                own[t, f"c{aln}_g{k % 2}_i{k}" if t == "p" else f"{t}{k}"] = "-" * a + "".join(s[a : len(s) - b]) + "-" * b
        rows += [(aln, t, n, s, "x") for (t, n), s in own.items()]
        want += [(aln, *r) for r in plain_block(own, 3, 45, 4, 0.6, isoform)]
    df = spark.createDataFrame(rows, "aln long, taxon string, name string, seq string, low string").drop("low")
    got = msa.diploid_block(df, spark.createDataFrame(ROLES, "taxon string, role string, weight double, ord int"), 3, 45, 4, 0.6, isoform)
    assert values(got.select("aln", "taxon", "name", "seq")) == sorted(want, key=str)
    assert 5 < len({w[0] for w in want}) < 40


def test_three_diploids_are_too_few_and_gappy_blocks_go(spark):
    roles = spark.createDataFrame(ROLES, "taxon string, role string, weight double, ord int")
    full = [(1, t, t, "ACGT" * 30) for t in ("d0", "d1", "d2", "d3")]
    make = lambda rows: spark.createDataFrame(rows, "aln long, taxon string, name string, seq string")
    assert msa.diploid_block(make(full), roles).count() == 4
    assert msa.diploid_block(make(full[:3]), roles).count() == 0
    gappy = [(1, "d0", "d0", "A" + "-" * 110 + "ACGTACGTA"), *full[1:]]
    assert msa.diploid_block(make(gappy), roles).count() == 0 and msa.diploid_block(make(gappy), roles, max_gaps=110).count() == 4
    assert msa.diploid_block(make([*full, (1, "o", "o", "-" * 80 + "ACGT" * 10)]), roles).count() == 0


def test_the_mixture_of_least_bic_is_chosen():
    p = np.array([0.2 * math.comb(6, k) * 0.15**k * 0.85 ** (6 - k) for k in range(1, 7)])
    p[-1] += 0.5
    fits = models.binomial_mixtures([round(1000 * x) for x in p])
    assert [f["components"] for f in fits] == [2, 3, 4, 5, 6] and sum(f["chosen"] for f in fits) == 1
    assert min(fits, key=lambda f: f["bic"])["chosen"] == 1 and fits[0]["bic"] < fits[-1]["bic"]
