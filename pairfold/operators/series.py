"""Statistics of long series as aggregates, windows by group and equi-joins.

Functions take a table with a group column, so that many series are worked on at once; a series'
order is a column that tells its rows apart.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairfold.operators.collection import ordered_by_group
from pairfold.work import stored


def _placed(table: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, at, v): 0-based places inside each series, by two phases: no series is in one task."""
    rows = table.where(F.col(value).isNotNull()).select(group, *order, F.col(value).cast("double").alias("v"))
    return ordered_by_group(rows, group, order, "at").select(group, "at", "v")


def block_mean(table: DataFrame, group: str, order: list[str], value: str, blocks: int = 10, rest_in_mean: bool = True) -> DataFrame:
    """(group, mean, error, n): the error from the means of equal blocks.

    There are min(blocks, n) blocks; the rows behind the last one count in the mean only (or not at
    all). The error is 0 with fewer than two blocks.
    """
    rows = _placed(table, group, order, value)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("k", F.least(F.col("n"), F.lit(blocks))).withColumn("size", F.floor(F.col("n") / F.col("k")))
    rows = rows.join(sizes, group).withColumn("block", F.floor(F.col("at") / F.col("size")))
    by_block = rows.groupBy(group, "n", "k", F.least("block", "k").alias("block")).agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    inside = F.when(F.col("block") < F.col("k"), F.col("s") / F.col("c"))
    mean = F.sum("s") / F.sum("c") if rest_in_mean else F.avg(inside)
    out = by_block.groupBy(group, "n", "k").agg(mean.alias("mean"), F.when(F.count(inside) > 1, F.sqrt(F.var_samp(inside) / F.count(inside))).otherwise(0.0).alias("error"))
    return out.select(group, "mean", "error", "n")


#: Rows of a series that are worked on as one array.
BLOCK = 8192


#: The group's column inside of the statistics of lags, whatever its name.
OF = "__of"


def _lagged(dev: DataFrame, first: int, last: int) -> DataFrame:
    """(__of, t, s): the sums of d[at] * d[at + t] for t from ``first`` to ``last``.

    Series are cut into blocks; a row goes to its own block and, if lags reach it from there, to those before. Lags are
    added up inside the blocks, so that a block's sums and not its rows times the lags are shuffled.
    """
    reach = math.ceil(last / BLOCK)
    block = F.floor(F.col("at") / BLOCK).cast("long")
    near = F.floor((F.col("at") - last) / BLOCK).cast("long")
    spread = dev.select(OF, "at", "d", F.explode(F.sequence(F.greatest(near, block - reach, F.lit(0)), block)).alias("block"))
    kind = dev.schema[OF].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        x, own = rows.d.to_numpy(), int((rows["at"] < (rows.block.iloc[0] + 1) * BLOCK).sum())
        lags = np.arange(first, min(last, len(x) - 1) + 1)
        sums = [float(x[: min(own, len(x) - t)] @ x[t : t + min(own, len(x) - t)]) for t in lags]
        return pd.DataFrame({OF: [rows[OF].iloc[0]] * len(lags), "t": lags, "s": sums})

    return spread.groupBy(OF, "block").applyInPandas(run, f"{OF} {kind}, t long, s double").groupBy(OF, "t").agg(F.sum("s").alias("s"))


def inefficiency(table: DataFrame, group: str, order: list[str], value: str, most_lags: int | None = None, half: bool = False) -> DataFrame:
    """(group, g, n): the statistical inefficiency 1 + 2 sum (1 - t/N) C(t), up to the first C(t) that is not positive.

    Lags are worked off in doubling blocks; a series leaves when its sum has ended, so that the work
    is that of its correlation time and not of its square length. ``half`` ends the sum at n // 2.
    """
    rows = stored(_placed(table, group, order, value).withColumnRenamed(group, OF), "series")
    means = rows.groupBy(OF).agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    dev = stored(rows.join(means, OF).select(OF, "at", (F.col("v") - F.col("m")).alias("d")), "deviations")
    end = F.floor(F.col("n") / 2) - 1 if half else F.col("n") - 2
    state = stored(means.select(OF, "n", "var", end.cast("long").alias("end"), F.lit(1.0).alias("g"), ((F.col("n") < 3) | (F.col("var") == 0)).alias("done")), "inefficiency")
    first, width = 1, 64
    while True:
        top = first + width - 1 if most_lags is None else min(first + width - 1, most_lags)
        open_ = state.where(~F.col("done") & (F.col("end") >= first))
        if top < first or not open_.limit(1).count():
            break
        mine = dev.join(open_.select(F.col(OF).alias("__g")), F.col(OF) == F.col("__g"), "left_semi")
        c = _lagged(mine, first, top).join(open_, OF).where(F.col("t") <= F.col("end")).withColumn("c", F.col("s") / ((F.col("n") - F.col("t")) * F.col("var")))
        cut = c.groupBy(OF).agg(F.min(F.when(F.col("c") <= 0, F.col("t"))).alias("cut"))
        added = c.join(cut, OF).where(F.col("cut").isNull() | (F.col("t") < F.col("cut"))).groupBy(OF).agg(F.sum(2 * (1 - F.col("t") / F.col("n")) * F.col("c")).alias("add"))
        state = stored(state.join(cut, OF, "left").join(added, OF, "left").select(OF, "n", "var", "end", (F.col("g") + F.coalesce("add", F.lit(0.0))).alias("g"), (F.col("done") | F.col("cut").isNotNull()).alias("done")), "inefficiency")
        first, width = top + 1, width * 2
    return state.select(F.col(OF).alias(group), F.greatest("g", F.lit(1.0)).alias("g"), "n")


def correlation_time(table: DataFrame, group: str, order: list[str], value: str, window: float = 5.0) -> DataFrame:
    """(group, mean, error, tau, n): the integrated correlation time 1/2 + sum rho(t), to the first t of ``window`` times itself.

    rho is the sum of products at a lag over that at lag 0. The error of the mean is sqrt(2 tau var / n); it is NaN
    with fewer than four rows, and 0 if all rows are equal.
    """
    rows = stored(_placed(table, group, order, value).withColumnRenamed(group, OF), "series")
    means = rows.groupBy(OF).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    dev = stored(rows.join(means, OF).select(OF, "at", (F.col("v") - F.col("mean")).alias("d")), "deviations")
    state = stored(means.select(OF, "n", "mean", "var", F.lit(0.5).alias("tau"), ((F.col("n") < 4) | (F.col("var") == 0)).alias("done")), "correlation")
    first, width = 1, 64
    while True:
        open_ = state.where(~F.col("done") & (F.col("n") > first))
        if not open_.limit(1).count():
            break
        top = first + width - 1
        mine = dev.join(open_.select(F.col(OF).alias("__g")), F.col(OF) == F.col("__g"), "left_semi")
        rho = _lagged(mine, first, top).join(open_, OF).where(F.col("t") < F.col("n")).withColumn("rho", F.col("s") / (F.col("n") * F.col("var")))
        # A few lags per series and round: their running sum is an array of bounded size.
        listed = rho.groupBy(OF, "tau").agg(F.array_sort(F.collect_list(F.struct("t", "rho"))).alias("l"))
        start = F.struct(F.col("tau").alias("tau"), F.lit(False).alias("done"))
        step = lambda s, x: F.when(s["done"], s).otherwise(F.struct((s["tau"] + x["rho"]).alias("tau"), (x["t"] >= window * (s["tau"] + x["rho"])).alias("done")))
        after = listed.select(OF, F.aggregate("l", start, step).alias("s")).select(OF, F.col("s.tau").alias("__tau"), F.col("s.done").alias("__done"))
        state = stored(state.join(after, OF, "left").select(OF, "n", "mean", "var", F.coalesce("__tau", "tau").alias("tau"), (F.col("done") | F.coalesce("__done", F.lit(False))).alias("done")), "correlation")
        first, width = top + 1, width * 2
    error = F.when(F.col("n") < 4, F.lit(float("nan"))).otherwise(F.sqrt(2 * F.col("tau") * F.col("var") / F.col("n")))
    return state.select(F.col(OF).alias(group), "mean", error.alias("error"), "tau", "n")


def blocking_inefficiency(table: DataFrame, group: str, replica: str, order: list[str], value: str, least: int = 8) -> DataFrame:
    """(group, g, block): b times the variance of means of blocks of b rows over that of the rows, averaged over replicas.

    b is the greatest power of 2 that leaves every replica ``least`` whole blocks; null if none does. All block sizes come
    from one pass: rows are added up in the smallest blocks once and those are paired level by level.
    """
    pair = table.where(F.col(value).isNotNull()).withColumn("__r", F.struct(F.col(group), F.col(replica)))
    rows = stored(ordered_by_group(pair.select("__r", *order, F.col(value).cast("double").alias("v")), "__r", order, "at").select("__r", "at", "v"), "replicas")
    whole = stored(rows.groupBy("__r").agg(F.count("*").alias("n"), F.var_samp("v").alias("var")), "replica-sizes")
    shortest = whole.groupBy(F.col("__r")[group].alias("g_")).agg(F.floor(F.log2((F.min("n") / least).cast("double")) + 1e-9).cast("int").alias("level")).withColumn("b", F.when(F.col("level") >= 0, F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    met = rows.join(whole, "__r").join(F.broadcast(shortest), F.col("__r")[group] == F.col("g_"))
    blocks = met.where("at < floor(n / b) * b").groupBy("__r", "b", "var", F.floor(F.col("at") / F.col("b")).alias("k")).agg(F.avg("v").alias("m"))
    ratios = blocks.groupBy("__r", "b", "var").agg((F.first("b") * F.var_samp("m") / F.first("var")).alias("ratio"))
    return shortest.join(ratios.groupBy(F.col("__r")[group].alias("__g")).agg(F.avg("ratio").alias("g")), F.col("g_") == F.col("__g"), "left").select(F.col("g_").alias(group), "g", F.col("b").alias("block"))


def mean_error(variance: Column, g: Column, n: Column) -> Column:
    return F.sqrt(variance * g / n)


def subsample(table: DataFrame, group: str, order: list[str], every: dict | Column) -> DataFrame:
    """Every k-th row of each series, from the first one on; ``every`` is a column of the table."""
    return ordered_by_group(table, group, order, "__at").where(F.pmod(F.col("__at"), every) == 0).drop("__at")


def reweighted(table: DataFrame, group: str, delta: Column, value: Column, kt: float) -> DataFrame:
    """(group, mean, ess_entropy, ess_kish, n): averages with weights exp(-delta / kT), shifted by the largest."""
    top = table.groupBy(group).agg(F.max(-delta / kt).alias("__top")).withColumnRenamed(group, "__g")
    w = table.join(top, F.col(group) == F.col("__g")).withColumn("__x", -delta / kt - F.col("__top")).withColumn("__w", F.exp("__x"))
    sums = w.groupBy(group).agg(F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__w")).alias("w2"), F.sum(F.col("__w") * F.col("__x")).alias("wx"), F.sum(F.col("__w") * value).alias("wv"), F.count("*").alias("n"))
    return sums.select(group, (F.col("wv") / F.col("w")).alias("mean"), F.exp(F.log("w") - F.col("wx") / F.col("w")).alias("ess_entropy"), (F.col("w") * F.col("w") / F.col("w2") / F.col("n")).alias("ess_kish"), "n")


def mean_derivative(table: DataFrame, group: str, observable: Column, slope: Column, kt: float, weight: Column | None = None) -> DataFrame:
    """(group, derivative) of a mean: minus the weighted covariance of observable and slope over kT."""
    w = F.lit(1.0) if weight is None else weight
    s = table.groupBy(group).agg(F.sum(w).alias("w"), F.sum(w * observable).alias("o"), F.sum(w * slope).alias("g"), F.sum(w * observable * slope).alias("og"))
    return s.select(group, (-(F.col("og") / F.col("w") - F.col("o") / F.col("w") * F.col("g") / F.col("w")) / kt).alias("derivative"))


def thermodynamic_integration(table: DataFrame, state: str, lambdas: dict[str, str], slopes: dict[str, str]) -> DataFrame:
    """(component, dg): trapezoids over the states of the mean slopes; steps without a change of lambda count nothing.

    ``lambdas`` and ``slopes`` name the columns of each component. There are few states; they are
    ordered by one small window.
    """
    means = table.groupBy(state).agg(*(F.avg(c).alias(f"s_{k}") for k, c in slopes.items()), *(F.first(c).alias(f"l_{k}") for k, c in lambdas.items()))
    flat = means.select(state, F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"l_{k}").alias("l"), F.col(f"s_{k}").alias("s")) for k in slopes])).alias("x")).select(state, "x.*")
    w = Window.partitionBy("component").orderBy(state)
    step = F.col("l") - F.lag("l").over(w)
    area = F.when(step == 0, 0.0).otherwise((F.col("s") + F.lag("s").over(w)) / 2 * step)
    return flat.withColumn("a", area).groupBy("component").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("dg"))


class Mbar(NamedTuple):
    """Free energies of K states (the first is 0), their covariance, and the overlap of the states' samples."""

    free_energies: list[float]
    covariance: list[list[float]]
    overlap: list[list[float]]


def mbar(samples: DataFrame, energies: list[str], state: str = "state", tolerance: float = 1e-10, most: int = 200) -> Mbar:
    """Free energies of K states by the self-consistent equations for the weights of all samples in all states.

    ``samples`` has a row per sample: the number of the state it was drawn from, and its reduced energy
    in every state. They are written once; each round is one aggregate of K sums and K^2 products over them, from which the
    driver takes a Newton step (a plain step where that leads away). An error if ``most`` rounds do not end.
    """
    k = len(energies)
    base = stored(samples.select(F.col(state).cast("int").alias("state"), *(F.col(e).cast("double").alias(f"u{i}") for i, e in enumerate(energies))), "mbar")
    counts = {int(r[0]): int(r[1]) for r in base.groupBy("state").count().collect()}
    n = np.array([counts.get(i, 0) for i in range(k)], dtype=float)
    # One constant per state keeps the exponentials in range.
    low = np.array([float(x) for x in base.agg(*(F.min(f"u{i}") for i in range(k))).first()])

    def products(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each state's weights and of the products of two, the weights being exp(f - u) over the mixture's density."""
        parts = [F.lit(math.log(n[i]) + f[i]) - F.col(f"u{i}") for i in range(k) if n[i]]
        top = F.greatest(*parts) if len(parts) > 1 else parts[0]
        d = base.withColumn("d", top + F.log(functools.reduce(Column.__add__, [F.exp(p - top) for p in parts])))
        w = d.select(*(F.exp(F.lit(float(f[i])) - F.col(f"u{i}") - F.col("d")).alias(f"w{i}") for i in range(k)))
        row = w.agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in range(k)), *(F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"o{i}_{j}") for i in range(k) for j in range(i, k))).first()
        both = np.array([[row[f"o{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return np.array([row[f"s{i}"] for i in range(k)]), both

    f, last = low - low[0], math.inf
    sums, both = products(f)
    for _ in range(most):
        plain = f - np.log(sums)
        plain -= plain[0]
        off = float(np.abs(plain - f).max())
        if off < tolerance:
            break
        new = plain
        if off < last and off < 1 and n.all() and k > 1:
            # The equations are n_i (1 - sums_i) = 0; the derivative of n_i sums_i by f_j is n_i (delta sums_i - both_ij n_j).
            slope = n[:, None] * (np.diag(sums) - both * n[None, :])
            step = np.linalg.lstsq(slope[1:, 1:], (n * (1 - sums))[1:], rcond=None)[0]
            if np.isfinite(step).all() and np.abs(step).max() < 10:
                new = f + np.r_[0.0, step]
        last, f = off, new
        sums, both = products(f)
    else:
        raise RuntimeError(f"the free energies have not settled after {most} rounds")
    # The covariance from the singular values of the weights, whose squares are the eigenvalues of the products.
    values, v = np.linalg.eigh(both)
    s = np.diag(np.sqrt(np.maximum(values, 0.0)))
    inner = np.eye(k) - s @ v.T @ np.diag(n) @ v @ s
    theta = v @ s @ np.linalg.pinv(inner, rcond=1e-10) @ s @ v.T
    return Mbar(f.tolist(), theta.tolist(), (both * n[None, :]).tolist())


def legs(samples: DataFrame, state: str, lambdas: dict[str, list[float]], slopes: dict[str, str], energies: list[str], g: dict[int, float], legs_: list[tuple[int, int]], kt: float, order: list[str]) -> list[tuple[float, float, float, float]]:
    """(ti, error, mbar, error) of each leg (a, b) of states.

    ``lambdas``: each component's value at every state; ``slopes`` and ``energies``: columns of the components' slopes and of the
    energies at every state; ``g``: each state's inefficiency, by whose whole number samples are thinned for the second estimate.
    """
    k = len(energies)
    n = {r[state]: r for r in samples.groupBy(state).agg(*(F.avg(c).alias(f"m_{x}") for x, c in slopes.items()), *(F.stddev_samp(c).alias(f"e_{x}") for x, c in slopes.items()), F.count("*").alias("n")).collect()}
    every = functools.reduce(lambda out, i: F.when(F.col(state) == i, max(1, math.ceil(g[i]))).otherwise(out), range(k), F.lit(1))
    kept = subsample(samples, state, order, every)
    solved = mbar(kept.select(F.col(state).alias("state"), *((F.col(e) / kt).alias(e) for e in energies)), energies)
    out = []
    for a, b in legs_:
        total = error = 0.0
        for x, values in lambdas.items():
            weight = [0.0] * k
            for i in range(a + 1, b + 1):
                weight[i - 1] += (values[i] - values[i - 1]) / 2
                weight[i] += (values[i] - values[i - 1]) / 2
            for i, w in enumerate(weight):
                if w:
                    total += w * n[i][f"m_{x}"]
                    error += (w * n[i][f"e_{x}"]) ** 2 * g[i] / n[i].n
        t = solved.covariance
        out.append((total, math.sqrt(error), (solved.free_energies[b] - solved.free_energies[a]) * kt, math.sqrt(max(t[a][a] + t[b][b] - 2 * t[a][b], 0.0)) * kt))
    return out


def two_state_slope(x1: DataFrame, x2: DataFrame, value: str, most: int = 100, tolerance: float = 1e-10) -> tuple[float, float]:
    """(slope, error) of the log ratio of two sampled densities, by Newton steps of a logistic fit; one aggregate a step.

    The values are written once, and taken from their mean in units of their spread; an error if ``most`` steps do not end.
    """
    both = stored(x1.select(F.col(value).cast("double").alias("x"), F.lit(0.0).alias("y")).unionByName(x2.select(F.col(value).cast("double").alias("x"), F.lit(1.0).alias("y"))), "two-states")
    mean, spread = both.agg(F.avg("x"), F.stddev_pop("x")).first()
    if not spread:
        raise ValueError("the values do not differ")
    a = b = 0.0
    x = (F.col("x") - mean) / spread
    for _ in range(most):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * x)))
        q = p * (1 - p)
        r = both.agg(F.sum(F.col("y") - p).alias("g0"), F.sum((F.col("y") - p) * x).alias("g1"), F.sum(q).alias("h0"), F.sum(q * x).alias("h1"), F.sum(q * x * x).alias("h2")).first()
        det = r.h0 * r.h2 - r.h1 * r.h1
        da, db = (r.h2 * r.g0 - r.h1 * r.g1) / det, (r.h0 * r.g1 - r.h1 * r.g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tolerance:
            return b / spread, math.sqrt(r.h0 / det) / spread
    raise RuntimeError(f"the fit has not settled after {most} steps")


def kolmogorov_smirnov(table: DataFrame, group: str, value: str, cdf: Column) -> DataFrame:
    """(group, d, p, n) of each series against a distribution function, which sees the row's columns.

    p is the sum of 100 terms of the limiting distribution with the small-sample argument.
    """
    seen = table.where(F.col(value).isNotNull()).select(F.col(group), F.col(value).alias("__v"), cdf.alias("f"))
    sizes = seen.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n"))
    ranked = ordered_by_group(seen, group, ["__v"], "k").withColumn("k", F.col("k") + 1).join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    d = ranked.groupBy(group, "n").agg(F.max(F.greatest(F.col("k") / F.col("n") - F.col("f"), F.col("f") - (F.col("k") - 1) / F.col("n"))).alias("d"))
    root = F.sqrt(F.col("n").cast("double"))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return d.select(group, "d", F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0)).alias("p"), "n")


def jackknife(replicas: DataFrame, group: str, replica: str, total: str, count: str) -> DataFrame:
    """(group, mean, error, replicas) of a pooled mean, leaving one replica out at a time.

    ``replicas`` has a row of sums per replica; what is left without one is the whole minus its row.
    """
    whole = replicas.groupBy(F.col(group).alias("__g")).agg(F.sum(total).alias("__t"), F.sum(count).alias("__c"))
    left = replicas.join(whole, F.col(group) == F.col("__g")).where(F.col("__c") > F.col(count)).withColumn("theta", (F.col("__t") - F.col(total)) / (F.col("__c") - F.col(count)))
    out = left.groupBy(group).agg((F.first("__t") / F.first("__c")).alias("mean"), F.sqrt((F.count("*") - 1) * F.var_pop("theta")).alias("error"), F.count("*").alias("replicas"))
    return out


def first_crossing(table: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, root): where y first changes its sign along x, by linear interpolation."""
    rows = stored(ordered_by_group(table.select(group, F.col(x).alias("__a"), F.col(y).alias("__f")), group, ["__a"], "__k"), "crossing")
    after = rows.select(F.col(group).alias("__of"), (F.col("__k") - 1).alias("__at"), F.col("__a").alias("__b"), F.col("__f").alias("__g"))
    near = rows.join(after, F.col(group).eqNullSafe(F.col("__of")) & (F.col("__k") == F.col("__at")), "left")
    hit = near.where((F.col("__f") == 0) | (F.col("__f") * F.col("__g") < 0))
    inside = F.col("__a") - F.col("__f") * (F.col("__b") - F.col("__a")) / (F.col("__g") - F.col("__f"))
    return hit.groupBy(group).agg(F.min_by(F.when(F.col("__f") == 0, F.col("__a")).otherwise(inside), "__a").alias("root"))


def pchip(knots: DataFrame, x: str, y: str) -> DataFrame:
    """(x0, x1, y0, y1, m0, m1): the intervals of the monotone cubic interpolant of a small table of knots."""
    k = knots.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    w = Window.orderBy("x")
    k = k.withColumn("h", F.lead("x").over(w) - F.col("x")).withColumn("s", (F.lead("y").over(w) - F.col("y")) / F.col("h"))
    hp, sp = F.lag("h").over(w), F.lag("s").over(w)
    w1, w2 = 2 * F.col("h") + hp, F.col("h") + 2 * hp
    inner = F.when(F.col("s") * sp <= 0, 0.0).otherwise((w1 + w2) / (w1 / sp + w2 / F.col("s")))
    # At the ends the slopes are those of the first and the last secant.
    k = k.withColumn("m", F.when(hp.isNull(), F.col("s")).when(F.col("h").isNull(), sp).otherwise(inner))
    out = k.select(F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.col("y").alias("y0"), F.lead("y").over(w).alias("y1"), F.col("m").alias("m0"), F.lead("m").over(w).alias("m1"))
    return out.where("x1 IS NOT NULL")


def pchip_at(intervals: DataFrame, table: DataFrame, at: str, name: str = "value", most_intervals: int = 10_000) -> DataFrame:
    """The interpolant at each row; null outside of the knots.

    The intervals are literals of the plan, so that their number is bounded: more raise an error.
    """
    rows = intervals.orderBy("x0").limit(most_intervals + 1).collect()
    if len(rows) > most_intervals:
        raise ValueError(f"more than {most_intervals} intervals")
    knots = F.array(*[F.struct(*(F.lit(float(r[c])).alias(c) for c in ("x0", "x1", "y0", "y1", "m0", "m1"))) for r in rows])
    x = F.col(at).cast("double")
    hit = F.element_at(F.filter(knots, lambda r: (x >= r["x0"]) & (x <= r["x1"])), 1) if len(rows) else F.lit(None)
    h = hit["x1"] - hit["x0"]
    t = (x - hit["x0"]) / h
    value = (1 + 2 * t) * (1 - t) * (1 - t) * hit["y0"] + t * (1 - t) * (1 - t) * h * hit["m0"] + t * t * (3 - 2 * t) * hit["y1"] + t * t * (t - 1) * h * hit["m1"]
    inside = (x >= float(rows[0].x0)) & (x <= float(rows[-1].x1)) if rows else F.lit(False)
    return table.withColumn(name, F.when(inside, value))


def running_maximum(table: DataFrame, group: str, order: list[str], value: Column, name: str = "most") -> DataFrame:
    """The largest value so far of each series; long ones are worked off in parts that take over the maximum before them."""
    rows = stored(ordered_by_group(table.withColumn("__v", value), group, order, "__k").withColumn("__b", F.floor(F.col("__k") / F.lit(1 << 20))), "running")
    parts = rows.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__p")).agg(F.max("__v").alias("__top"))
    ahead = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("__g", "__p", F.max("__top").over(ahead).alias("__before"))
    w = Window.partitionBy(group, "__b").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("__in", F.max("__v").over(w))
    met = inside.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__p")))
    return met.select(*table.columns, F.greatest("__in", "__before").alias(name))


def divergence(a: DataFrame, b: DataFrame, step: str, value: str) -> DataFrame:
    """(step, far, most): how far two runs are apart at each step that both have, and the most so far."""
    met = a.select(F.col(step), F.col(value).alias("__a")).join(b.select(F.col(step).alias("__s"), F.col(value).alias("__b")), F.col(step) == F.col("__s"))
    far = met.select(step, F.abs(F.col("__a") - F.col("__b")).alias("far"), F.lit(0).alias("__one"))
    return running_maximum(far, "__one", [step], F.col("far")).drop("__one")


def fluctuation(table: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, ratio): the variance of a series over its mean, as for a compressibility."""
    return table.groupBy(group).agg(F.avg(value).alias("mean"), (F.var_samp(value) / F.avg(value)).alias("ratio"))


def move_weights(deltas: dict[str, float], kt: float) -> Column:
    """The log weight, up to a constant, of a row when the factors of its amplitudes (columns) change by ``deltas``."""
    return functools.reduce(Column.__add__, [F.col(c) * F.lit(float(x)) for c, x in deltas.items()]) * F.lit(-1.0 / kt)


def replica_gradient(table: DataFrame, replica: str, observable: Column, slope: Column, kt: float) -> DataFrame:
    """(replica, derivative) of each replica's mean observable: minus its covariance with the energy's slope over kT."""
    return mean_derivative(table, replica, observable, slope, kt)


def gyration(frames: DataFrame, frame: str, axes: list[str], mass: str | None = None) -> DataFrame:
    """(frame, rg): the root mean square distance of a frame's rows from their center."""
    w = F.lit(1.0) if mass is None else F.col(mass)
    sums = frames.groupBy(frame).agg(F.sum(w).alias("__w"), *(F.sum(w * F.col(a)).alias(f"__s{a}") for a in axes), F.sum(w * functools.reduce(Column.__add__, [F.col(a) * F.col(a) for a in axes])).alias("__q"))
    center = functools.reduce(Column.__add__, [F.col(f"__s{a}") * F.col(f"__s{a}") for a in axes])
    return sums.select(frame, F.sqrt(F.greatest(F.col("__q") / F.col("__w") - center / (F.col("__w") * F.col("__w")), F.lit(0.0))).alias("rg"))


def fluctuations(frames: DataFrame, row: str, axes: list[str]) -> DataFrame:
    """(row, rmsf): the root mean square distance of a row from its mean place over the frames."""
    return frames.groupBy(row).agg(F.sqrt(functools.reduce(Column.__add__, [F.var_pop(a) for a in axes])).alias("rmsf"))


def fitted_distance(frames: DataFrame, frame: str, row: str, reference: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(frame, rmsd): the least root mean square distance from a reference over all turns and shifts of a frame.

    Frames meet the reference by row; each is summed to nine products and a few means, however many rows it has, and the best
    turn comes from the singular values of these.
    """
    met = frames.select(frame, row, *axes).join(reference.select(F.col(row).alias("__r"), *(F.col(a).alias(f"r_{a}") for a in axes)), F.col(row) == F.col("__r"))
    names = [f"c_{a}_{b}" for a in axes for b in axes]
    sums = met.groupBy(frame).agg(
        F.count("*").alias("n"), *(F.covar_pop(a, f"r_{b}").alias(f"c_{a}_{b}") for a in axes for b in axes),
        functools.reduce(Column.__add__, [F.var_pop(a) + F.var_pop(f"r_{a}") for a in axes]).alias("both"),
    )

    def best(n: pd.Series, both: pd.Series, *products: pd.Series) -> pd.Series:
        c = np.stack([p.to_numpy(dtype=float) for p in products], axis=1).reshape(-1, 3, 3)
        u, s, vt = np.linalg.svd(c)
        s[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))  # no mirror images
        return pd.Series(np.sqrt(np.maximum(both.to_numpy() - 2 * s.sum(axis=1), 0.0)))

    turn = F.pandas_udf(best, "double")
    return sums.select(frame, turn("n", "both", *names).alias("rmsd"))


def area_modulus(cells: DataFrame, group: str, length: str, width: str, height: str, kt: float, per: float = 1.0) -> DataFrame:
    """(group, area, spread, modulus, height, volume, n): the area (over ``per``) of a cell's face, and kT <A> / var(A)."""
    a = F.col(length) * F.col(width)
    s = cells.groupBy(group).agg(F.avg(a).alias("__m"), F.var_samp(a).alias("__v"), F.avg(height).alias("height"), F.avg(a * F.col(height)).alias("volume"), F.count("*").alias("n"))
    return s.select(group, (F.col("__m") / per).alias("area"), (F.sqrt("__v") / per).alias("spread"), (F.lit(float(kt)) * F.col("__m") / F.when(F.col("__v") != 0, F.col("__v"))).alias("modulus"), "height", "volume", "n")
