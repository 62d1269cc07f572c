"""Queries of scalar functions and of statistics of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairfold.functions import geometry, scalars
from pairfold.operators import series
from pairfold.plans.registry import fx, query, table
from pairfold.streaming import windows

# Functions.


@query("""SELECT p_partkey, round(CASE WHEN x < 3 THEN 2 / sqrt(pi()) * list_sum([(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(x, 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1)) FOR n IN range(0, 60)]) ELSE 1 END, 6) AS a,
round(CASE WHEN x < 3 THEN 1 - 2 / sqrt(pi()) * list_sum([(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(x, 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1)) FOR n IN range(0, 60)]) ELSE 0 END, 6) AS b FROM (SELECT p_partkey, CASE WHEN p_size > 44 THEN p_size * 1.0::DOUBLE ELSE p_size / 15.0::DOUBLE END AS x FROM part)""")
def error_functions(spark, d):
    x = F.when(F.col("p_size") > 44, F.col("p_size").cast("double")).otherwise(F.col("p_size") / F.lit(15.0))
    return table(spark, d, "part").select("p_partkey", F.round(scalars.erf(x), 6).alias("a"), F.round(scalars.erfc(x), 6).alias("b"))


def _curvatures(values: list[float], periodic: bool = False) -> list[float]:
    """Second derivatives, in units of the squared step, of the spline through values: by elimination, row by row."""
    n = len(values) - 1
    rows = [[0.0] * (n + 2) for _ in range(n + 1)]
    for k in range(1, n):
        rows[k][k - 1 : k + 2] = [1.0, 4.0, 1.0]
        rows[k][-1] = 6 * (values[k - 1] - 2 * values[k] + values[k + 1])
    if periodic:
        rows[0][0], rows[0][1], rows[0][n - 1] = 4.0, 1.0, 1.0
        rows[0][-1] = 6 * (values[n - 1] - 2 * values[0] + values[1])
        rows[n][0], rows[n][n] = 1.0, -1.0
    else:
        rows[0][0] = rows[n][n] = 1.0
    for k in range(n + 1):
        top = max(range(k, n + 1), key=lambda r: abs(rows[r][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                f = rows[r][k] / rows[k][k]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[k])]
    return [rows[k][-1] / rows[k][k] for k in range(n + 1)]


def _listed(values: list[float]) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _spline_sql(u: str, values: str, curvatures: str, n: int) -> str:
    k = f"least(greatest(floor({u}), 0), {n - 1})::INTEGER"
    t = f"({u} - {k})"
    return f"((1 - {t}) * {values}[{k} + 1] + {t} * {values}[{k} + 2] + ((pow(1 - {t}, 3) - (1 - {t})) * {curvatures}[{k} + 1] + (pow({t}, 3) - {t}) * {curvatures}[{k} + 2]) / 6)"


KNOTS, TURN = [1.0, 3.0, 2.0, 2.5, -1.0, 0.0], [0.5, 2.0, -1.0, 1.0, 0.0, 0.5]


@query(f"""WITH e AS (SELECT event_id, value / 60 AS u, value / 7 - 5 * floor(value / 35) AS w FROM events)
SELECT event_id, round(CASE WHEN u > 5 THEN 0 ELSE {_spline_sql('u', _listed(KNOTS), _listed(_curvatures(KNOTS)), 5)} END, 7) + 0.0 AS natural, round({_spline_sql('w', _listed(TURN), _listed(_curvatures(TURN, True)), 5)}, 7) + 0.0 AS turned FROM e""")
def splines(spark, d):
    x = F.col("value")
    natural, turned = scalars.spline(x, 0.0, 300.0, KNOTS), scalars.spline(x, 0.0, 35.0, TURN, periodic=True)
    return table(spark, d, "events").select("event_id", (F.round(natural, 7) + 0.0).alias("natural"), (F.round(turned, 7) + 0.0).alias("turned"))


SURFACE = [[((3 * i * i + 5 * j + i * j) % 7) * 0.5 for j in range(5)] for i in range(4)]
_rows = [_spline_sql("v", _listed(row), _listed(_curvatures(row)), 4) for row in SURFACE]
#: Curvatures of a natural spline of four values: a whole matrix over the values.
_matrix = [_curvatures([float(k == j) for k in range(4)]) for j in range(4)]
_of_rows = "[" + ", ".join(" + ".join(f"{_matrix[j][k]!r} * g[{j + 1}]" for j in range(4)) for k in range(4)) + "]"


@query(f"""WITH e AS (SELECT event_id, (event_id * 7 % 1000) / 1000.0::DOUBLE * 3 AS u, value / 100 AS v FROM events), r AS (SELECT event_id, u, v, [{', '.join(_rows)}] AS g FROM e), c AS (SELECT *, {_of_rows} AS m FROM r)
SELECT event_id, round(CASE WHEN v > 4 THEN 0 ELSE {_spline_sql('u', 'g', 'm', 3)} END, 6) + 0.0 AS smooth, {_listed([x for row in SURFACE for x in row])}[(least(greatest(round_even(u, 0), 0), 3) * 5 + least(greatest(round_even(v, 0), 0), 4))::INTEGER + 1] AS nearest FROM c""")
def surfaces(spark, d):
    x, y = (F.col("event_id") * 7 % 1000) / F.lit(1000.0) * 3, F.col("value") / 100
    spans = [(0.0, 3.0), (0.0, 4.0)]
    return table(spark, d, "events").select("event_id", (F.round(scalars.spline_grid([x, y], spans, SURFACE), 6) + 0.0).alias("smooth"), scalars.tabulated_grid([x, y], spans, SURFACE).alias("nearest"))


@query("SELECT event_id, round(1 - exp(-value / 20) * (1 + value / 20 + pow(value / 20, 2) / 2), 7) AS f FROM events")
def gamma_distribution(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.gamma_cdf(F.col("value"), 3.0, 20.0), 7).alias("f"))


@query("SELECT p_partkey, round(CASE WHEN u < 0 OR u >= 4 THEN 0 WHEN u < 1 THEN u * u * u / 6 WHEN u < 2 THEN (-3 * u * u * u + 12 * u * u - 12 * u + 4) / 6 WHEN u < 3 THEN (3 * u * u * u - 24 * u * u + 60 * u - 44) / 6 ELSE pow(4 - u, 3) / 6 END, 9) + 0.0 AS w FROM (SELECT p_partkey, p_size / 10.0::DOUBLE - 0.5 AS u FROM part)")
def bspline_of_order_four(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.round(scalars.bspline(4, F.col("p_size") / F.lit(10.0) - 0.5), 9) + 0.0).alias("w"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_tax / l_discount + 1 / l_discount END AS ratio, CASE WHEN l_tax = 0 THEN '-inf'::DOUBLE ELSE round(ln(l_tax), 9) END AS logarithm, CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE least(l_tax, l_discount) END AS low FROM lineitem WHERE l_tax <> 0 OR l_discount <> 0")
def guarded_arithmetic(spark, d):
    t = table(spark, d, "lineitem").where("l_tax <> 0 OR l_discount <> 0")
    tax, discount = F.col("l_tax"), F.col("l_discount")
    ratio = scalars.divide(tax, discount) + scalars.recip(discount)
    ratio = F.when((discount == 0) & (tax == 0), F.lit(float("inf"))).otherwise(F.when(discount == 0, F.lit(float("inf"))).otherwise(ratio))
    low = F.when(discount == 0, F.lit(float("nan"))).otherwise(F.least(tax, discount))  # least() of SQL: NaN is the greatest, null is passed over
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ratio.alias("ratio"), F.when(tax == 0, scalars.log(tax)).otherwise(F.round(scalars.log(tax), 9)).alias("logarithm"), low.alias("low"))


@query("SELECT s_suppkey, round(sqrt(pow(s_suppkey % 5 - 2, 2) + pow(s_nationkey % 7 - 3, 2) + 1), 9) AS length, round(s_suppkey * 0.7 - 2 * pi() * floor((s_suppkey * 0.7 + pi()) / (2 * pi())), 7) + 0.0 AS angle FROM supplier")
def lengths_and_angles(spark, d):
    v = ((F.col("s_suppkey") % 5 - 2).cast("double"), (F.col("s_nationkey") % 7 - 3).cast("double"), F.lit(1.0))
    return table(spark, d, "supplier").select("s_suppkey", F.round(geometry.norm(v), 9).alias("length"), (F.round(geometry.wrapped_angle(F.col("s_suppkey") * F.lit(0.7)), 7) + 0.0).alias("angle"))


# Series.

_ranked = "WITH r AS (SELECT event_type, event_id, ts, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"{_ranked}, b AS (SELECT event_type, pos // (n // 10) AS block, v FROM r WHERE pos < n // 10 * 10), m AS (SELECT event_type, block, avg(v) AS m FROM b GROUP BY ALL) SELECT event_type, round(avg(m), 9) AS mean, round(sqrt(var_samp(m) / count(*)), 6) AS error FROM m GROUP BY 1")
def block_mean_of_whole_blocks(spark, d):
    got = series.block_mean(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value", rest_in_mean=False)
    return got.select("event_type", F.round("mean", 9).alias("mean"), F.round("error", 6).alias("error"))


def _correlations(last: int) -> str:
    return f"""{_ranked}, s AS (SELECT event_type, avg(v) AS m, var_pop(v) AS var, var_samp(v) AS var1, count(*) AS n FROM r GROUP BY 1), e AS (SELECT r.event_type, pos, v - m AS d FROM r JOIN s USING (event_type)),
c AS (SELECT a.event_type, t, sum(a.d * b.d) AS c FROM e a JOIN range(1, {last}) q(t) ON true JOIN e b ON a.event_type = b.event_type AND b.pos = a.pos + t GROUP BY ALL)"""


@query(f"{_correlations(65)}, k AS (SELECT event_type, min(t) AS cut FROM c JOIN s USING (event_type) WHERE c <= 0 AND t < n // 2 GROUP BY 1) SELECT s.event_type, round(greatest(1 + coalesce(sum(2 * (1 - t / s.n::DOUBLE) * c / ((s.n - t) * var)) FILTER (t < cut AND t < s.n // 2), 0), 1), 6) AS g, round(any_value(sqrt(var1 / s.n)), 6) AS plain, s.n FROM s LEFT JOIN c USING (event_type) LEFT JOIN k USING (event_type) GROUP BY s.event_type, s.n")
def inefficiency_half(spark, d):
    events = table(spark, d, "events")
    got = series.inefficiency(events, "event_type", ["ts", "event_id"], "value", half=True)
    spread = events.groupBy(F.col("event_type").alias("__e")).agg(F.var_samp("value").alias("var"))
    return got.join(spread, F.col("event_type") == F.col("__e")).select("event_type", F.round("g", 6).alias("g"), F.round(series.mean_error(F.col("var"), F.lit(1.0), F.col("n")), 6).alias("plain"), "n")


@query(f"{_correlations(65)}, q AS (SELECT event_type, t, 0.5 + sum(c / (n * var)) OVER (PARTITION BY event_type ORDER BY t) AS tau FROM c JOIN s USING (event_type)), f AS (SELECT event_type, min(t) AS t FROM q WHERE t >= 5 * tau GROUP BY 1) SELECT event_type, round(m, 6) AS mean, round(sqrt(2 * tau * var / n), 6) AS error, round(tau, 6) AS tau FROM q JOIN f USING (event_type, t) JOIN s USING (event_type)")
def correlation_times(spark, d):
    got = series.correlation_time(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")
    return got.select("event_type", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"), F.round("tau", 6).alias("tau"))


@query("""WITH r AS (SELECT event_type, user_id % 4 AS k, value AS v, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS pos FROM events), s AS (SELECT event_type, k, count(*) AS n, var_samp(v) AS var FROM r GROUP BY ALL),
l AS (SELECT event_type, max(b) AS b FROM (SELECT event_type, min(n) AS n FROM s GROUP BY 1) JOIN (SELECT 1 << i AS b FROM range(30) t(i)) ON n // b >= 8 GROUP BY 1),
m AS (SELECT r.event_type, r.k, b, var, pos // b AS block, avg(v) AS m FROM r JOIN s ON r.event_type = s.event_type AND r.k = s.k JOIN l ON l.event_type = r.event_type WHERE pos < n // b * b GROUP BY ALL), q AS (SELECT event_type, k, b, b * var_samp(m) / var AS q FROM m GROUP BY event_type, k, b, var)
SELECT event_type, round(avg(q), 6) AS g, b::BIGINT AS block FROM q GROUP BY event_type, b""")
def blocking_inefficiency(spark, d):
    t = table(spark, d, "events").withColumn("k", F.col("user_id") % 4)
    return series.blocking_inefficiency(t, "event_type", "k", ["ts", "event_id"], "value").select("event_type", F.round("g", 6).alias("g"), "block")


@query(f"{_ranked} SELECT event_type, event_id FROM r WHERE pos % length(event_type) = 0")
def subsampled(spark, d):
    return series.subsample(table(spark, d, "events"), "event_type", ["ts", "event_id"], F.length("event_type")).select("event_type", "event_id")


@query("""WITH RECURSIVE x AS (SELECT CASE WHEN event_type = 'click' THEN 0.0 ELSE 1.0 END AS y, value / 50 AS x FROM events WHERE event_type IN ('click', 'view')),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT k + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM
(SELECT k, a, b, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2 FROM (SELECT k, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM it, x WHERE k < 12) GROUP BY k, a, b)),
e AS (SELECT b, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2 FROM (SELECT a, b, x, 1 / (1 + exp(-(a + b * x))) AS p FROM it, x WHERE k = 12) GROUP BY b)
SELECT round(b / 50, 7) + 0.0 AS slope, round(sqrt(h0 / (h0 * h2 - h1 * h1)) / 50, 7) AS error FROM e""")
def two_state_slope(spark, d):
    events = table(spark, d, "events")
    slope, error = series.two_state_slope(events.where("event_type = 'click'"), events.where("event_type = 'view'"), "value")
    return spark.createDataFrame([(round(slope, 7) + 0.0, round(error, 7))], "slope double, error double")


_knots = [(0.0, 1.0), (50.0, 3.0), (120.0, 2.0), (200.0, 2.5), (260.0, 6.0), (300.0, 6.5)]


def _pchip_sql() -> str:
    """Each interval's cubic, with its slopes worked out here."""
    x, y = [k for k, _ in _knots], [v for _, v in _knots]
    h = [b - a for a, b in zip(x, x[1:])]
    s = [(b - a) / w for a, b, w in zip(y, y[1:], h)]
    m = [s[0], *(0.0 if s[k - 1] * s[k] <= 0 else 3 * (h[k - 1] + h[k]) / ((2 * h[k] + h[k - 1]) / s[k - 1] + (h[k] + 2 * h[k - 1]) / s[k]) for k in range(1, len(s))), s[-1]]
    parts = []
    for k, w in enumerate(h):
        t = f"((value - {x[k]}) / {w})"
        parts.append(f"WHEN value <= {x[k + 1]} THEN {y[k]} + {t} * ({m[k] * w!r} + {t} * ({3 * (y[k + 1] - y[k]) - (2 * m[k] + m[k + 1]) * w!r} + {t} * ({(m[k] + m[k + 1]) * w - 2 * (y[k + 1] - y[k])!r})))")
    return f"SELECT event_id, round(CASE {' '.join(parts)} END, 6) AS y FROM events"


@query(_pchip_sql())
def monotone_interpolation(spark, d):
    knots = spark.createDataFrame(_knots, "x double, y double")
    return series.pchip_at(series.pchip(knots, "x", "y"), table(spark, d, "events"), "value", "y").select("event_id", F.round("y", 6).alias("y"))


@query("SELECT event_type, round(sqrt(avg(x * x + y * y) - pow(avg(x), 2) - pow(avg(y), 2)), 6) AS rg FROM (SELECT event_type, value / 10 AS x, event_id % 17 AS y FROM events) GROUP BY 1")
def gyration_of_types(spark, d):
    t = table(spark, d, "events").select("event_type", (F.col("value") / 10).alias("x"), (F.col("event_id") % 17).cast("double").alias("y"))
    return series.gyration(t, "event_type", ["x", "y"]).select("event_type", F.round("rg", 6).alias("rg"))


@query("SELECT user_id, round(sqrt(var_pop(value) + var_pop((event_id % 17)::DOUBLE)), 6) AS rmsf FROM events GROUP BY 1")
def fluctuations_of_users(spark, d):
    t = table(spark, d, "events").withColumn("y", (F.col("event_id") % 17).cast("double"))
    return series.fluctuations(t, "user_id", ["value", "y"]).select("user_id", F.round("rmsf", 6).alias("rmsf"))


@query("SELECT frame::BIGINT AS frame, round(CASE WHEN frame % 2 = 0 THEN 0 ELSE 0.5 * sqrt(avg(s) - avg(px) * avg(px) - avg(py) * avg(py) - avg(pz) * avg(pz)) END, 5) + 0.0 AS rmsd FROM (SELECT px, py, pz, px * px + py * py + pz * pz AS s FROM (SELECT s_suppkey % 5 AS px, s_nationkey % 7 AS py, s_suppkey % 11 AS pz FROM supplier)), range(4) t(frame) GROUP BY frame")
def fitted_distances(spark, d):
    """Frames that are turned (even ones), or turned and stretched by a half (odd ones), and moved."""
    t = table(spark, d, "supplier").select("s_suppkey", *((F.col(c) % n).cast("double").alias(a) for a, c, n in (("x", "s_suppkey", 5), ("y", "s_nationkey", 7), ("z", "s_suppkey", 11))))
    each = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("frame"))
    s, a = F.when(F.col("frame") % 2 == 0, 1.0).otherwise(1.5), F.col("frame") * 0.7 + 0.3
    moved = each.select("frame", "s_suppkey", (s * (F.cos(a) * F.col("x") - F.sin(a) * F.col("z")) + F.col("frame")).alias("x"), (s * F.col("y") - 2).alias("y"), (s * (F.sin(a) * F.col("x") + F.cos(a) * F.col("z"))).alias("z"))
    return series.fitted_distance(moved, "frame", "s_suppkey", t).select("frame", (F.round("rmsd", 5) + 0.0).alias("rmsd"))


@query("SELECT l_returnflag, round(avg(l_quantity * l_linenumber) / 4, 6) AS area, round(stddev_samp(l_quantity * l_linenumber) / 4, 6) AS spread, round(2.5 * avg(l_quantity * l_linenumber) / var_samp(l_quantity * l_linenumber), 8) AS modulus, round(avg(l_quantity * l_linenumber * l_tax), 6) AS volume FROM lineitem GROUP BY 1")
def area_moduli(spark, d):
    got = series.area_modulus(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linenumber", "l_tax", 2.5, 4.0)
    return got.select("l_returnflag", F.round("area", 6).alias("area"), F.round("spread", 6).alias("spread"), F.round("modulus", 8).alias("modulus"), F.round("volume", 6).alias("volume"))


@query("WITH x AS (SELECT event_type, value, -(0.3 * value - 0.1 * (event_id % 7)) / 25 AS lw FROM events), w AS (SELECT event_type, value, exp(lw - max(lw) OVER (PARTITION BY event_type)) AS w FROM x) SELECT event_type, round(sum(w * value) / sum(w), 5) AS mean, round(pow(sum(w), 2) / sum(w * w) / count(*), 5) AS kish FROM w GROUP BY 1")
def moved_weights(spark, d):
    t = table(spark, d, "events").withColumn("a6", (F.col("event_id") % 7).cast("double"))
    got = series.reweighted(t, "event_type", -series.move_weights({"value": 0.3, "a6": -0.1}, 25.0), F.col("value"), 1.0)
    return got.select("event_type", F.round("mean", 5).alias("mean"), F.round("ess_kish", 5).alias("kish"))


@query("SELECT user_id, round(-covar_pop(value, (event_id % 7)::DOUBLE) / 2.5, 5) + 0.0 AS derivative FROM events GROUP BY 1")
def replica_gradients(spark, d):
    got = series.replica_gradient(table(spark, d, "events"), "user_id", F.col("value"), (F.col("event_id") % 7).cast("double"), 2.5)
    return got.select("user_id", (F.round("derivative", 5) + 0.0).alias("derivative"))


@query("SELECT l_returnflag, round(-(sum(l_tax * l_quantity * l_discount) / sum(l_tax) - sum(l_tax * l_quantity) / sum(l_tax) * sum(l_tax * l_discount) / sum(l_tax)) / 2.5, 6) AS derivative FROM lineitem GROUP BY 1")
def weighted_derivative(spark, d):
    got = series.mean_derivative(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity"), F.col("l_discount"), 2.5, F.col("l_tax"))
    return got.select("l_returnflag", F.round("derivative", 6).alias("derivative"))


@query("WITH d AS (SELECT o_orderkey, abs(o_totalprice - c_acctbal) AS far FROM orders JOIN customer ON c_custkey = o_orderkey) SELECT o_orderkey, round(far, 4) AS far, round(max(far) OVER (ORDER BY o_orderkey), 4) AS most FROM d")
def run_divergence(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("v"))
    return series.divergence(a, b, "o_orderkey", "v").select("o_orderkey", F.round("far", 4).alias("far"), F.round("most", 4).alias("most"))


_legs = [(0, 2), (1, 2)]


@query("""WITH RECURSIVE s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS pos, event_id % 3 AS state FROM events), m AS (SELECT state, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT * FROM s WHERE pos % 2 = 0 OR state <> 1), c AS (SELECT count(*) FILTER (state = 0) AS n0, count(*) FILTER (state = 1) AS n1, count(*) FILTER (state = 2) AS n2 FROM k),
it AS (SELECT 0 AS r, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS f2 UNION ALL SELECT r + 1, -ln(sum(exp(-v / 45) / z)) + ln(sum(exp(-v / 40) / z)), -ln(sum(exp(-v / 50) / z)) + ln(sum(exp(-v / 40) / z)) FROM (SELECT r, v, n0 * exp(-v / 40) + n1 * exp(f1 - v / 45) + n2 * exp(f2 - v / 50) AS z FROM it, k, c WHERE r < 80) GROUP BY r),
f AS (SELECT 0.0 AS f0, f1, f2 FROM it WHERE r = 80), t AS (SELECT max(m) FILTER (state = 0) AS m0, max(m) FILTER (state = 1) AS m1, max(m) FILTER (state = 2) AS m2, max(s / n) FILTER (state = 0) AS e0, max(s / n) FILTER (state = 1) AS e1, max(s / n) FILTER (state = 2) AS e2 FROM m)
SELECT leg::INTEGER AS leg, round(CASE leg WHEN 0 THEN 0.25 * m0 + 0.5 * m1 + 0.25 * m2 ELSE 0.25 * m1 + 0.25 * m2 END, 5) AS ti, round(sqrt(CASE leg WHEN 0 THEN 0.0625 * e0 + 0.25 * e1 * 1.5 + 0.0625 * e2 ELSE 0.0625 * e1 * 1.5 + 0.0625 * e2 END), 5) AS ti_error, round(CASE leg WHEN 0 THEN f2 - f0 ELSE f2 - f1 END * 2.0, 5) AS mbar FROM t, f, range(2) q(leg)""")
def free_energy_legs(spark, d):
    t = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("state"), "value", *((F.col("value") * 2.0 / F.lit(x)).alias(f"u{k}") for k, x in enumerate((40.0, 45.0, 50.0))))
    got = series.legs(t, "state", {"all": [0.0, 0.5, 1.0]}, {"all": "value"}, ["u0", "u1", "u2"], {0: 1.0, 1: 1.5, 2: 1.0}, _legs, 2.0, ["event_id"])
    return spark.createDataFrame([(k, round(x[0], 5), round(x[1], 5), round(x[2], 5)) for k, x in enumerate(got)], "leg int, ti double, ti_error double, mbar double")


# Windows.


@query(f"SELECT event_id // 500 AS period, event_type, count(*) AS n, {fx('value')} AS total FROM events GROUP BY ALL")
def nested_periods(spark, d):
    windows.nested(100, 500, 1000)
    return windows.by_step(table(spark, d, "events"), "event_id", 500, "event_type").agg(F.count("*").alias("n"), scalars.exact_sum("value").alias("total"))


