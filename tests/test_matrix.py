"""Matrix algebra on golden values and hand-made rows."""

import pytest

from panweave.functions import models
from panweave.operators import growth, matrix

#: Clusters by occupancy of the sample matrix of 12 plasmids, and what follows from them.
HISTOGRAM = [106, 18, 5, 2, 2, 1, 6, 1, 2, 4, 9, 24]
COMPARTMENTS = {"cloud": 124, "shell": 23, "softcore": 33}
MIXTURE = {2: (24, 193, 1056.08217644576, -520.251652946544), 3: (23, 370, 583.140322949438, -278.587769347493), 4: (14, 417, 570.835786136617, -267.242544090193), 5: (13, 703, 579.364023427564, -266.313705884776)}


@pytest.fixture(scope="module")
def pan(spark):
    rows, c = [], 0
    for occ, n in enumerate(HISTOGRAM, 1):
        for _ in range(n):
            rows += [(f"t{(c + k) % 12:02d}", f"c{c}", 1) for k in range(occ)]
            c += 1
    return spark.createDataFrame(rows, "taxon string, cluster string, n long").cache()


def test_histogram(pan):
    assert [r["n"] for r in sorted(matrix.occupancy_histogram(pan).collect())] == HISTOGRAM


def test_compartments(pan):
    rows = matrix.compartments(pan).collect()
    assert {k: sum(r["compartment"] == k for r in rows) for k in COMPARTMENTS} == COMPARTMENTS
    assert sum(r["core"] for r in rows) == 24
    cut = matrix.cut_positions(pan).first()
    assert (cut["softcorepos"], cut["cloudpos"]) == (11, 2)
    assert matrix.cut_positions(pan, no_cloud=True).first()["cloudpos"] == 0


def test_too_few_taxa(spark):
    with pytest.raises(ValueError):
        matrix.require_taxa(spark.createDataFrame([("a", "c", 1)], "taxon string, cluster string, n long"))


def test_mixture():
    for k, (core, pan_size, bic, ll) in MIXTURE.items():
        got = models.binomial_mixture(HISTOGRAM, k)
        assert abs(got["log_likelihood"] - ll) < 0.3 and abs(got["bic"] - bic) < 0.6, (k, got)
        assert abs(got["core"] - core) <= 2, (k, got)
        if k <= 4:  # beyond the best model the likelihood is flat in the pan size
            assert abs(got["pan"] - pan_size) <= 0.05 * pan_size, (k, got)
    assert min(MIXTURE, key=lambda k: models.binomial_mixture(HISTOGRAM, k)["bic"]) == 4


def small(spark):
    rows = [("a", "x", 3), ("b", "x", 1), ("a", "y", 1), ("c", "y", 2), ("b", "z", 1)]
    return spark.createDataFrame(rows, "taxon string, cluster string, n long")


def values(df):
    return sorted(map(tuple, df.collect()))


def test_contrasts(spark):
    p = small(spark)
    assert values(matrix.absent_in_b(p, ["b"])) == [("y",)]
    assert values(matrix.present_a_absent_b(p, ["a"], ["b"])) == [("y",)]
    assert values(matrix.expansions(p, ["a"], ["b"])) == [("x", 3, 1)]


def test_pocp(spark):
    p = spark.createDataFrame([("a", "x", 2), ("b", "x", 1)], "taxon string, cluster string, n long")
    t = spark.createDataFrame([("a", 10), ("b", 20)], "taxon string, total long")
    assert values(matrix.pocp(p, t)) == [("a", "b", 10.0), ("b", "a", 10.0)]


def test_distance_and_square(spark):
    p = small(spark)
    assert values(matrix.distances(p).drop("gower")) == [("a", "b", 4, 6), ("a", "c", 4, 10), ("b", "c", 4, 6)]
    cells = spark.createDataFrame([("a", "b", 50.0)], "t1 string, t2 string, v double")
    full = {(r["t1"], r["t2"]): r["v"] for r in matrix.square(cells, p, "v").collect()}
    assert len(full) == 9 and full["a", "a"] == 100 and full["a", "b"] == 50 and full["b", "a"] is None
    assert values(matrix.drop_redundant(cells, p.select("taxon").distinct(), "v", 40)) == [("b",), ("c",)]


def test_median_and_variable(spark):
    m = spark.createDataFrame([("x", 1, 10), ("x", 2, 30), ("x", 3, 20), ("x", 4, 20)], "cluster string, seq_id long, length long")
    assert values(matrix.median_length(m)) == [("x", 20, 3)]
    assert {r["cluster"] for r in matrix.variable_clusters(small(spark)).collect()} == {"x", "y", "z"}


def test_growth(spark):
    p = small(spark)
    orders = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")], "sample int, g int, taxon string")
    assert values(growth.growth(p, orders, 0.5)) == [(0, 0, 2, 2, 2), (0, 1, 1, 3, 3), (0, 2, 0, 3, 3)]
    perms = growth.permutations(spark, ["a", "b", "c"], 10, 1).collect()
    assert len({r["sample"] for r in perms}) == 6 and [r["taxon"] for r in sorted(perms)[:3]] == ["a", "b", "c"]


def test_pan_increments(spark):
    genes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "seq_id long, taxon string")
    hom = spark.createDataFrame([(2, "a"), (4, "b")], "q long, ts string")
    extras = spark.createDataFrame([], "seq_id long")
    orders = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")], "sample int, g int, taxon string")
    assert values(growth.pan_increments(genes, hom, extras, orders)) == [(0, 0, 1), (0, 1, 1)]


def test_fits():
    import numpy as np

    g = np.arange(1, 13)
    got = models.fit_core(g, 24 + 60 * np.exp(-g / 2.1))
    assert abs(got["omega"] - 24) < 1e-3 and abs(got["tau"] - 2.1) < 1e-3
    got = models.fit_pan(g, models.pan_tettelin(g, np.array([40, 5, 80, 3.0])))
    assert got["residual"] < 0.5
    assert models.fisher(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert models.benjamini_hochberg([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    d = np.array([[0, 1, 4], [1, 0, 4], [4, 4, 0.0]])
    assert models.linkage(["a", "b", "c"], d) == "((a:0.5,b:0.5):1.5,c:2);"
    assert models.silhouette(d, np.array([0, 0, 1])) == pytest.approx(0.5)
