"""Statistics: enrichment, score normalisation, rate summaries. Counting is relational; only tests and fits are numpy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.functions.models import fisher
from panweave.operators.ranks import ranked
from panweave.tables import Tables


def enrichment_counts(experiment: DataFrame, control: DataFrame, per: str = "cluster") -> DataFrame:
    """(domain, exp, ctrl): in how many clusters (or sequences) of each set a domain occurs; missing is 0.

    Inputs (cluster, seq_id, domains array): a domain counts once per sequence, and once per cluster by default.
    """
    key = "cluster" if per == "cluster" else "seq_id"

    def count(rows: DataFrame, name: str) -> DataFrame:
        one = rows.select(key, F.explode(F.array_distinct("domains")).alias("domain")).distinct()
        return one.groupBy("domain").agg(F.count(F.lit(1)).alias(name))

    both = count(experiment, "exp").join(count(control, "ctrl"), "domain", "full")
    return both.select("domain", F.coalesce("exp", F.lit(0)).cast("long").alias("exp"), F.coalesce("ctrl", F.lit(0)).cast("long").alias("ctrl"))


def enrichment(counts: DataFrame, alternative: str = "greater", cutoff: float = 0.05) -> DataFrame:
    """counts(domain, exp, ctrl) -> with totals, p and adjusted p, those at or below the cutoff, best first.

    The tested table is [[exp, ctrl], [all exp, all ctrl]]: totals, not complements. The adjustment is the step-up rule
    over the ranks, as a window over one row per domain.
    """
    totals = counts.agg(F.sum("exp").alias("exp_total"), F.sum("ctrl").alias("ctrl_total"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["p"] = [fisher(int(a), int(b), int(c), int(d), alternative) for a, b, c, d in zip(p.exp, p.ctrl, p.exp_total, p.ctrl_total, strict=True)]
            yield p

    tested = counts.crossJoin(F.broadcast(totals)).mapInPandas(run, "domain string, exp long, ctrl long, exp_total long, ctrl_total long, p double")
    ranked = tested.withColumns({"m": F.count(F.lit(1)).over(W.partitionBy())})
    down = W.orderBy(F.desc("p"), "domain").rowsBetween(W.unboundedPreceding, 0)
    last = F.col("m") - F.row_number().over(W.orderBy(F.desc("p"), "domain")) + 1
    out = ranked.withColumn("k", last).withColumn("q", F.least(F.min(F.col("p") * F.col("m") / F.col("k")).over(down), F.lit(1.0)))
    out = out.withColumn("q", F.min("q").over(W.partitionBy("p")))
    return out.filter(F.col("q") <= cutoff).select("domain", "exp", "ctrl", "exp_total", "ctrl_total", "p", "q").orderBy("q", "p", "domain")


def score_bins(first: DataFrame, bin_size: int, top_percent: float) -> DataFrame:
    """Per bin of `bin_size` hits in order of length product, the best top_percent by bits; however many products are equal,
    no task holds more than a range of hits."""
    placed = ranked(Tables(first.sparkSession, "bins"), first, [], ["lp", "q", "s"], "_place")
    binned = placed.withColumn("bin", F.floor((F.col("_place") - 1) / bin_size)).drop("_place")
    # no bin keeps more than a full one: a limit that each task can set before rows move
    most = max(int(bin_size * top_percent // 100), 1)
    top = binned.withColumn("r", F.row_number().over(W.partitionBy("bin").orderBy(F.desc("bits"), "q", "s"))).filter(F.col("r") <= most)
    held = F.least(F.lit(bin_size), F.col("_all") - F.col("bin") * bin_size)
    total = first.agg(F.count(F.lit(1)).alias("_all"))
    return top.crossJoin(F.broadcast(total)).filter(F.col("r") <= F.greatest(F.floor(held * top_percent / 100), F.lit(1))).drop("r", "_all")


def bin_size(hits: int) -> int:
    """Hits per bin by the number of hits."""
    return hits if hits < 100 else 1000 if hits > 5000 else 200 if hits > 1000 else 20


def normalise_scores(hits: DataFrame, min_bits: float = 100, keep_percent: float = 5, scale: float = 100.0, database: float = 1e8) -> DataFrame:
    """hits(q, s, bits, qlen, slen) -> with norm and norm_evalue: bits over the fitted power of the length product.

    The line log10(bits) ~ log10(length product) is fitted on the best hits of each bin by regr_slope and regr_intercept.
    """
    lp = (F.col("qlen") * F.col("slen")).cast("double")
    strong = hits.filter(F.col("bits") >= min_bits).select("q", "s", "bits", lp.alias("lp"))
    top = score_bins(strong, bin_size(strong.count()), keep_percent)
    line = top.agg(F.regr_slope(F.log10("bits"), F.log10("lp")).alias("m"), F.regr_intercept(F.log10("bits"), F.log10("lp")).alias("b"))
    norm = F.lit(scale) * F.col("bits") / (F.pow(F.lit(10.0), F.col("b")) * F.pow(lp, F.col("m")))
    return hits.crossJoin(F.broadcast(line)).select(*hits.columns, norm.alias("norm"), (F.col("qlen") * F.lit(database) / F.pow(F.lit(2.0), norm)).alias("norm_evalue"))


def rate_summary(rates: DataFrame) -> DataFrame:
    """rates(file, omega, n_of_seqs) -> per file mean omega: 99 counts as 0, NaN goes, at least 4 sequences."""
    ok = rates.filter((F.col("n_of_seqs") >= 4) & ~F.isnan("omega") & F.col("omega").isNotNull())
    return ok.groupBy("file").agg(F.avg(F.when(F.col("omega") == 99, 0.0).otherwise(F.col("omega"))).alias("omega"), F.count(F.lit(1)).alias("pairs"))


def by_occupancy(rates: DataFrame) -> DataFrame:
    """rates(occ, omega): mean, extremes, median and standard deviation (of a sample and of a population) per occupancy."""
    return rates.groupBy("occ").agg(F.count(F.lit(1)).alias("n"), F.avg("omega").alias("mean"), F.min("omega").alias("least"), F.max("omega").alias("most"), F.median("omega").alias("median"), F.stddev_samp("omega").alias("sd"), F.stddev_pop("omega").alias("population_sd"))


def trend(rates: DataFrame) -> DataFrame:
    """One row: correlation, slope, intercept and the F statistic of a one-way analysis of variance over occupancies."""
    g = rates.groupBy("occ").agg(F.count(F.lit(1)).alias("n"), F.avg("omega").alias("m"), F.var_pop("omega").alias("v"))
    tot = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    anova = tot.select((((F.col("sq") - F.col("N") * F.col("gm") * F.col("gm")) / (F.col("k") - 1)) / (F.col("within") / (F.col("N") - F.col("k")))).alias("f"))
    return rates.agg(F.corr("occ", "omega").alias("r"), F.regr_slope("omega", "occ").alias("slope"), F.regr_intercept("omega", "occ").alias("intercept")).crossJoin(anova)


def merge_tools(stats: DataFrame, tools: list[str]) -> DataFrame:
    """stats(domain, tool, n) of several tools side by side, 0 where a tool has none."""
    return stats.groupBy("domain").pivot("tool", tools).agg(F.sum("n")).na.fill(0)
