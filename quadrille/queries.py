"""Queries over the test tables, one or more for each operator, with their SQL.

Panels are built from the star tables; `x` below is a field with nulls put in, so that every null rule is
met. Floats are rounded alike on both sides and periods are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .functions.aggregates import REDUCERS
from .operators.align import Loaded, align
from .operators.asof import asof_join
from .operators.periods import period_end
from .plans import lower
from .plans.check import validate
from .plans.macros import prepare
from .errors import PanelError
from .sources.kinds import register_fields
from .sources.names import date_column

KINDS = {
    "m.revenue": "flow", "m.x": "flow", "m.qty": "flow", "m.price": "price", "m.disc": "ratio", "m.ret": "return", "m.stock": "stock", "m.busy": "meta",
    "u.value": "flow", "u.n": "flow", "g.rate": "rate", "n.total": "level",
}
register_fields(KINDS)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supplier_months(spark: SparkSession, sf: str) -> DataFrame:
    """(supplier x month): revenue, quantity, price, discount, a return, a running stock, a flag, and a group."""
    # whole numbers, so that sums are exact in any order
    net = F.expr("CAST(ROUND(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT) DIV 10000")
    discount = F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / (F.count("*") * 100)
    by = (
        _table(spark, sf, "lineitem").groupBy("l_suppkey", period_end(F.col("l_shipdate"), "monthly").alias("time"))
        .agg(F.sum(net).cast("double").alias("m.revenue"), F.sum("l_quantity").alias("m.qty"), F.max("l_extendedprice").alias("m.price"), discount.alias("m.disc"))
    )
    sup = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("N"), (F.col("s_nationkey") % 5).cast("string")).alias("meta.sector"))
    gap = (F.month("time") + F.col("l_suppkey")) % 7 == 0
    return by.join(sup, "l_suppkey").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity"), "time",
        "`m.revenue`", F.when(~gap, F.col("`m.revenue`")).alias("m.x"), "`m.qty`", "`m.price`", "`m.disc`",
        (F.col("`m.disc`") - 0.05).alias("m.ret"), (F.col("`m.qty`") * 2).alias("m.stock"),
        F.when(~gap, F.col("`m.qty`") > 150).alias("m.busy"), "`meta.sector`",
    )


SUPPLIERS = """
p AS (
  SELECT 'S' || l_suppkey AS entity, time, revenue, CASE WHEN NOT gap THEN revenue END AS x, qty, price, disc, disc - 0.05 AS ret,
    qty * 2 AS stock, CASE WHEN NOT gap THEN qty > 150 END AS busy, sector
  FROM (
    SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS TIMESTAMP) AS time,
      CAST(SUM(CAST(ROUND(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT) // 10000) AS DOUBLE) AS revenue, SUM(l_quantity) AS qty, MAX(l_extendedprice) AS price,
      CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100) AS disc, (month(time) + l_suppkey) % 7 = 0 AS gap, 'N' || (any_value(s_nationkey) % 5) AS sector
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2))"""


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """(user x day): summed value and count; sparse."""
    day = period_end(F.col("ts").cast("timestamp_ntz"), "daily")
    return _table(spark, sf, "events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"), day.alias("time")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100).alias("u.value"), F.count("*").cast("double").alias("u.n")
    )


USERS = """
p AS (SELECT 'U' || user_id AS entity, CAST(date_trunc('day', CAST(ts AS TIMESTAMP)) AS TIMESTAMP) AS time, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value, CAST(COUNT(*) AS DOUBLE) AS n
  FROM events GROUP BY 1, 2)"""

E = "PARTITION BY entity ORDER BY time"
X = "PARTITION BY time"
XG = "PARTITION BY time, sector"


def _rows(n: int) -> str:
    return f"({E} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_rows(n)} = {n} THEN {value} END"


def _span(text: str) -> str:
    return f"({E} RANGE BETWEEN INTERVAL {text} - INTERVAL '1' MICROSECOND PRECEDING AND CURRENT ROW)"


def _past(f: str) -> str:
    return f"CASE WHEN x IS NOT NULL THEN {f} OVER ({E} ROWS UNBOUNDED PRECEDING) END"


def _nearest(x: str, q: float, over: str) -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL) OVER ({over}))[CAST(ROUND({q} * (count({x}) OVER ({over}) - 1)) AS BIGINT) + 1]"


def _corr(a: str, b: str, over: str) -> str:
    m = lambda e: f"avg({e}) OVER ({over})"
    cov = lambda s, t: f"({m(f'{s} * {t}')} - {m(s)} * {m(t)})"
    return f"{cov(a, b)} / NULLIF(sqrt({cov(a, a)} * {cov(b, b)}), 0)"


_ERF_SQL = "(1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z)))"
_BUCKET = "PARTITION BY entity, date_trunc('year', time)"
_AGG_SQL = {
    "sum": "coalesce(sum(x) OVER (B), 0)", "mean": "avg(x) OVER (B)", "last": "last(x) OVER (B ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "first": "first(x) OVER (B ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "min": "min(x) OVER (B)", "max": "max(x) OVER (B)",
    "count": "count(x) OVER (B)", "median": "median(x) OVER (B)", "std": "stddev_samp(x) OVER (B)", "var": "var_samp(x) OVER (B)",
    "range": "max(x) OVER (B) - min(x) OVER (B)", "geomean": "exp(avg(ln(x)) OVER (B))",
    "change": "last(x) OVER (B ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first(x) OVER (B ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "prod": "coalesce(product(x) OVER (B), 1)", "compound": "coalesce(product(x + 1) OVER (B), 1) - 1",
    "skew": "(avg(x * x * x) OVER (B) - 3 * avg(x) OVER (B) * avg(x * x) OVER (B) + 2 * (avg(x) OVER (B)) ^ 3) / (var_pop(x) OVER (B)) ^ 1.5",
    "kurtosis": "kurtosis_pop(x) OVER (B)",
}


def _agg_sql(name: str) -> str:
    body = _AGG_SQL[name].replace("(B", f"({_BUCKET}")
    small = body.replace("(x", "(y").replace("x *", "y *").replace("* x", "* y") if name in ("prod", "compound", "skew", "kurtosis", "std", "var", "geomean") else body
    return small if name not in ("skew", "kurtosis") else f"CASE WHEN count(y) OVER ({_BUCKET}) > 1 AND var_pop(y) OVER ({_BUCKET}) > 1e-9 THEN {small} END"


def _horner_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _ppf_sql(p: str) -> str:
    """The same rational function in SQL."""
    tail = lambda r: f"{_horner_sql(scalar._PPF_C, r)} / {_horner_sql((*scalar._PPF_D, 1.0), r)}"
    low, q = scalar._PPF_LOW, f"({p} - 0.5)"
    centre = f"{q} * {_horner_sql(scalar._PPF_A, f'({q} * {q})')} / {_horner_sql((*scalar._PPF_B, 1.0), f'({q} * {q})')}"
    left, right = (f"sqrt(-2 * ln(least(greatest({v}, 1e-300), 1)))" for v in (p, f"1 - {p}"))
    return f"CASE WHEN {p} <= 0 THEN '-inf'::DOUBLE WHEN {p} >= 1 THEN 'inf'::DOUBLE WHEN {p} < {low} THEN {tail(left)} WHEN {p} > {1 - low} THEN -({tail(right)}) ELSE {centre} END"


_W = f"{E} ROWS UNBOUNDED PRECEDING"
_WEALTH = [f"product(1 + ret) OVER ({_W}) AS wealth", f"wealth / greatest(1, max(wealth) OVER ({_W})) - 1 AS fall"]
_PCTILE = f"(rank() OVER ({X} ORDER BY x NULLS LAST) + (count(x) OVER ({X}, x) - 1) / 2.0 - 1) / NULLIF(count(x) OVER ({X}) - 1, 0)"


def _cov(a: str, b: str, over: str) -> str:
    return f"(avg(({a}) * ({b})) OVER ({over}) - avg({a}) OVER ({over}) * avg({b}) OVER ({over}))"


#: name: (expression, SQL over p, decimals). In the SQL `x` is m.x, `y` is m.x / 1e5. Of a list of SQL, all but the last are
#: columns that come before it.
CASES: dict[str, tuple[str, str | list[str], int]] = {
    "lag": ("lag(m.x, 2)", f"lag(x, 2) OVER ({E})", 6),
    **{f"roll_{k}": (f"roll_{k}(m.x / 100000, 3)", _full("y", 3, f"{f}(y) OVER {_rows(3)}"), 9) for k, f in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp"), ("var", "var_samp"), ("max", "max"), ("min", "min"))},
    "roll_mean_year": ('roll_mean(m.x, "1y")', f"avg(x) OVER {_span('1 YEAR')}", 6),
    "roll_sum_quarter": ('roll_sum(m.x, "3mo")', f"sum(x) OVER {_span('3 MONTH')}", 6),
    "roll_max_days": ('roll_max(m.x, "90d")', f"max(x) OVER {_span('90 DAY')}", 6),
    "roll_quantile": ("roll_quantile(m.x, 4, 0.25)", _full("x", 4, f"list_sort(list(x) OVER {_rows(4)})[2]"), 6),
    "roll_median": ("roll_median(m.x, 4)", _full("x", 4, f"median(x) OVER {_rows(4)}"), 6),
    "roll_skew": ("roll_skew(m.x / 100000, 5)", _full("y", 5, f"(avg(y * y * y) OVER {_rows(5)} - 3 * avg(y) OVER {_rows(5)} * avg(y * y) OVER {_rows(5)} + 2 * (avg(y) OVER {_rows(5)}) ^ 3) / (var_pop(y) OVER {_rows(5)}) ^ 1.5"), 4),
    "ewm_mean": ("ewm_mean(m.x, 3)", "EWM_MEAN", 4),
    "ewm_std": ("ewm_std(m.revenue / 100000, 3)", "EWM_STD", 5),
    "decay_linear": ("decay_linear(m.x, 3)", f"(x * 3 + lag(x, 1) OVER ({E}) * 2 + lag(x, 2) OVER ({E})) / 6", 6),
    **{f"resample_{k}": (f'resample({"m.x / 100000" if k in ("prod", "compound", "skew", "kurtosis", "std", "var", "geomean") else "m.x"}, "annual", "{k}")', _agg_sql(k), 5) for k in REDUCERS},
    "asof": ("asof(m.x)", f"last_value(x IGNORE NULLS) OVER ({E} ROWS UNBOUNDED PRECEDING)", 6),
    "ttm_flow": ("ttm(m.x)", f"sum(x) OVER {_span('1 YEAR')}", 6),
    "ttm_ratio": ("ttm(m.disc)", f"avg(disc) OVER {_span('1 YEAR')}", 10),
    "ttm_return": ("ttm(m.ret)", f"exp(sum(ln(1 + ret)) OVER {_span('1 YEAR')}) - 1", 6),
    "ttm_stock": ("ttm(m.stock)", "stock", 6),
    "trailing": ("trailing(m.x, 3)", _full("x", 3, f"sum(x) OVER {_rows(3)}"), 6),
    "to_annual": ("to_annual(m.x)", f"coalesce(sum(x) OVER ({_BUCKET}), 0)", 6),
    "to_quarterly": ("to_quarterly(m.disc)", "avg(disc) OVER (PARTITION BY entity, date_trunc('quarter', time))", 10),
    "to_monthly": ('to_monthly(m.x, "max")', "max(x) OVER (PARTITION BY entity, date_trunc('month', time))", 6),
    "to_daily": ("to_daily(m.price)", "price", 6),
    "cummax": ("cummax(m.x)", _past("max(x)"), 6),
    "cummin": ("cummin(m.x)", _past("min(x)"), 6),
    "cumsum": ("cumsum(m.x)", _past("sum(x)"), 6),
    "cumprod": ("cumprod(1 + m.ret)", f"product(1 + ret) OVER ({E} ROWS UNBOUNDED PRECEDING)", 10),
    "ts_mean": ("ts_mean(m.x)", "avg(x) OVER (PARTITION BY entity)", 6),
    "ts_std": ("ts_std(m.x / 100000)", "stddev_samp(y) OVER (PARTITION BY entity)", 6),
    "ts_min": ("ts_min(m.x)", "min(x) OVER (PARTITION BY entity)", 6),
    "zscore": ("zscore(m.x)", f"(x - avg(x) OVER ({X})) / NULLIF(stddev_samp(x) OVER ({X}), 0)", 6),
    "zscore_by": ("zscore(m.x) by meta.sector", f"(x - avg(x) OVER ({XG})) / NULLIF(stddev_samp(x) OVER ({XG}), 0)", 6),
    "rank": ("rank(m.stock)", f"rank() OVER ({X} ORDER BY stock) + (count(*) OVER ({X}, stock) - 1) / 2.0", 6),
    "rank_by": ("rank(m.x) by meta.sector", f"CASE WHEN x IS NOT NULL THEN rank() OVER ({XG} ORDER BY x NULLS LAST) + (count(x) OVER ({XG}, x) - 1) / 2.0 END", 6),
    "winsorize": ("winsorize(m.x, 0.1)", f"CASE WHEN x IS NOT NULL THEN least(greatest(x, {_nearest('x', 0.1, X)}), {_nearest('x', 0.9, X)}) END", 6),
    **{f"xs_{k}": (f"xs_{k}(m.x / 100000) by meta.sector", f"{f}(y) OVER ({XG})", 9) for k, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("var", "var_samp"), ("min", "min"), ("max", "max"), ("count", "count"))},
    "xs_sum": ("xs_sum(m.x)", f"coalesce(sum(x) OVER ({X}), 0)", 6),
    "xs_frac": ("xs_frac(m.busy)", f"avg(CAST(busy AS INTEGER)) OVER ({X})", 6),
    "xs_quantile": ("xs_quantile(m.x, 0.75)", _nearest("x", 0.75, X), 6),
    "count": ("count(m.busy, m.qty > 100)", "CAST(busy AS INTEGER) + CAST(qty > 100 AS INTEGER)", 0),
    "count_true": ("count_true(m.busy, m.qty > 100)", "CAST(coalesce(busy, false) AS INTEGER) + CAST(qty > 100 AS INTEGER)", 0),
    "erf": ("erf(m.ret * 20)", f"sign(ret) * (SELECT {_ERF_SQL} FROM (SELECT abs(ret * 20) AS z, 1 / (1 + 0.3275911 * abs(ret * 20)) AS t))", 6),
    "sqrt": ("sqrt(m.ret)", "CASE WHEN ret >= 0 THEN sqrt(abs(ret)) END", 6),
    "abs": ("abs(m.ret)", "abs(ret)", 6),
    "log": ("log(m.ret)", "CASE WHEN ret > 0 THEN ln(nullif(abs(ret), 0)) END", 6),
    "exp": ("exp(m.ret)", "exp(ret)", 6),
    **{k: (f"{k}(m.ret)", f"{k}(ret)", 6) for k in ("sin", "cos", "tan", "asin", "acos", "atan")},
    "floor": ("floor(m.x / 7)", "floor(x / 7)", 6),
    "ceil": ("ceil(m.x / 7)", "ceil(x / 7)", 6),
    "round": ("round(m.x / 7.3)", "round(x / 7.3)", 6),
    "clamp": ("clamp(m.x, 50000, 200000)", "CASE WHEN x IS NOT NULL THEN least(greatest(x, 50000), 200000) END", 6),
    "min": ("min(m.x, m.price)", "least(x, price)", 6),
    "max": ("max(m.x, m.price)", "greatest(x, price)", 6),
    **{k: (f"{k}(time)", f"{k}(time)", 0) for k in ("year", "month", "quarter", "day")},
    "truncate": ('datediff(time, truncate(time, "3mo"))', "date_diff('day', date_trunc('quarter', time), time)", 0),
    "truncate_multiple": ('datediff(time, truncate(time, "5mo"))', "date_diff('day', make_timestamp(CAST((year(time) * 12 + month(time) - 1) // 5 * 5 // 12 AS BIGINT), CAST(1 + (year(time) * 12 + month(time) - 1) // 5 * 5 % 12 AS BIGINT), 1, 0, 0, 0), time)", 0),
    "datediff": ('datediff(time, truncate(time, "1y"), "hours")', "date_diff('hour', date_trunc('year', time), time)", 0),
    "divide": ("m.revenue / (m.qty - m.qty)", "CAST(NULL AS DOUBLE)", 6),
    "modulo": ("m.qty % 7", "qty % 7", 6),
    "power": ("m.ret ^ 0.5", "CASE WHEN ret >= 0 THEN abs(ret) ^ 0.5 END", 6),
    "negate_power": ("-m.ret ^ 2", "ret * ret", 6),
    "coalesce": ("m.x ?? m.price", "coalesce(x, price)", 6),
    "ternary": ("1 if m.busy else 2", "CASE WHEN busy THEN 1 ELSE 2 END", 0),
    "logic": ("1 if (m.busy and m.qty > 160) or not m.busy else 0", "CASE WHEN (busy AND qty > 160) OR NOT busy THEN 1 ELSE 0 END", 0),
    "membership": ('1 if meta.sector in ("N1", "N3") else 0', "CASE WHEN sector IN ('N1', 'N3') THEN 1 ELSE 0 END", 0),
    "comparison": ("1 if m.x >= m.revenue and m.x != 0 else 0", "CASE WHEN x >= revenue AND x <> 0 THEN 1 ELSE 0 END", 0),
    # derived functions
    "yoy": ("yoy(m.x)", f"x / lag(x) OVER ({E}) - 1", 6),
    "avg2": ("avg2(m.x)", f"(x + lag(x) OVER ({E})) / 2", 6),
    "drawdown": ("drawdown(m.x)", f"x / max(x) OVER ({E} ROWS UNBOUNDED PRECEDING) - 1", 6),
    "pctile": ("pctile(m.x)", f"CASE WHEN x IS NOT NULL THEN (rank() OVER ({X} ORDER BY x NULLS LAST) + (count(x) OVER ({X}, x) - 1) / 2.0 - 1) / NULLIF(count(x) OVER ({X}) - 1, 0) END", 6),
    "roll_cov": ("roll_cov(m.disc, m.ret, 6)", _full("disc", 6, f"avg(disc * ret) OVER {_rows(6)} - avg(disc) OVER {_rows(6)} * avg(ret) OVER {_rows(6)}"), 8),
    "roll_zscore": ("roll_zscore(m.x, 4)", _full("x", 4, f"(x - avg(x) OVER {_rows(4)}) / NULLIF(stddev_samp(x) OVER {_rows(4)}, 0)"), 6),
    "roll_geomean": ("roll_geomean(m.x, 3)", _full("x", 3, f"exp(avg(ln(x)) OVER {_rows(3)})"), 6),
    "beta": ("beta(m.revenue / 100000, m.price / 10000, 6)", _full("revenue", 6, f"(avg(revenue / 100000 * price / 10000) OVER {_rows(6)} - avg(revenue / 100000) OVER {_rows(6)} * avg(price / 10000) OVER {_rows(6)}) / NULLIF(var_samp(price / 10000) OVER {_rows(6)}, 0)"), 5),
    "cagr": ("cagr(m.revenue, 3)", f"(revenue / lag(revenue, 3) OVER ({E})) ^ (1 / 3.0) - 1", 6),
    "increase": ("increase(m.revenue, 2)", f"(revenue - lag(revenue, 2) OVER ({E})) / lag(revenue, 2) OVER ({E})", 6),
    "demean": ("demean(m.x)", f"x - avg(x) OVER ({X})", 6),
    "xs_range": ("xs_range(m.x)", f"max(x) OVER ({X}) - min(x) OVER ({X})", 6),
    "minmax": ("minmax(m.x)", f"(x - min(x) OVER ({X})) / NULLIF(max(x) OVER ({X}) - min(x) OVER ({X}), 0)", 6),
    "xs_cv": ("xs_cv(m.x) by meta.sector", f"stddev_samp(x) OVER ({XG}) / avg(x) OVER ({XG})", 6),
    "xs_corr": ("xs_corr(m.revenue / 100000, m.qty / 100)", _corr("(revenue / 100000)", "(qty / 100)", X), 5),
    "ntile": ("ntile(m.x, 5)", f"CASE WHEN x IS NOT NULL THEN least(floor((rank() OVER ({X} ORDER BY x NULLS LAST) + (count(x) OVER ({X}, x) - 1) / 2.0 - 1) * 5 / count(x) OVER ({X})) + 1, 5) ELSE 5 END", 0),
    "scale": ("scale(m.ret)", f"ret / NULLIF(sum(abs(ret)) OVER ({X}), 0)", 6),
    "log_return": ("log_return(m.x)", f"ln(x) - ln(lag(x) OVER ({E}))", 6),
    "momentum": ("momentum(m.x, 2)", f"x - lag(x, 2) OVER ({E})", 6),
    "diff2": ("diff2(m.x)", f"x - 2 * lag(x, 1) OVER ({E}) + lag(x, 2) OVER ({E})", 6),
    "cum_return": ("cum_return(m.ret)", f"product(1 + ret) OVER ({E} ROWS UNBOUNDED PRECEDING) - 1", 10),
    "signed_log": ("signed_log(m.ret)", "sign(ret) * ln(1 + abs(ret))", 6),
    "sigmoid": ("sigmoid(m.ret)", "1 / (1 + exp(-ret))", 6),
    "hypot": ("hypot(m.ret, m.disc)", "sqrt(ret * ret + disc * disc)", 6),
    "ann_sharpe": ("ann_sharpe(m.ret, 12)", "avg(ret) OVER (PARTITION BY entity) / NULLIF(stddev_samp(ret) OVER (PARTITION BY entity), 0) * sqrt(12)", 5),
    "to_bps": ("to_bps(m.ret)", "ret * 10000", 6),
    "gross_margin": ("gross_margin(m.x, m.revenue - m.price)", "x / NULLIF(revenue - price, 0)", 6),
    "net_margin": ("net_margin(m.price, m.x)", "price / NULLIF(x, 0)", 6),
    "operating_margin": ("operating_margin(m.price, m.revenue)", "price / NULLIF(revenue, 0)", 6),
    "current_ratio": ("current_ratio(m.stock, m.qty - 30)", "stock / NULLIF(qty - 30, 0)", 6),
    "excess_return": ("excess_return(m.ret, m.disc / 2)", "ret - disc / 2", 8),
    "sharpe": ("sharpe(m.ret, 5)", _full("ret", 5, f"avg(ret) OVER {_rows(5)} / NULLIF(stddev_samp(ret) OVER {_rows(5)}, 0)"), 5),
    "roll_corr": ("roll_corr(m.revenue / 100000, m.price / 10000, 6)", _full("revenue", 6, f"{_cov('revenue / 100000', 'price / 10000', _rows(6)[1:-1])} / NULLIF(stddev_samp(revenue / 100000) OVER {_rows(6)} * stddev_samp(price / 10000) OVER {_rows(6)}, 0)"), 5),
    "xs_mad": ("xs_mad(m.x)", [f"median(x) OVER ({X}) AS mid", f"median(abs(x - mid)) OVER ({X})"], 6),
    "robust_zscore": ("robust_zscore(m.x)", [f"median(x) OVER ({X}) AS mid", f"median(abs(x - mid)) OVER ({X}) AS mad", "(x - mid) / NULLIF(1.4826 * mad, 0)"], 6),
    "roll_range": ("roll_range(m.x, 4)", _full("x", 4, f"max(x) OVER {_rows(4)} - min(x) OVER {_rows(4)}"), 6),
    "roll_cv": ("roll_cv(m.x / 100000, 4)", _full("y", 4, f"stddev_samp(y) OVER {_rows(4)} / NULLIF(avg(y) OVER {_rows(4)}, 0)"), 6),
    "autocorr": ("autocorr(m.revenue / 100000, 1, 5)", ["revenue / 100000 AS a", f"lag(a, 1) OVER ({E}) AS b", _full("b", 5, f"{_cov('a', 'b', _rows(5)[1:-1])} / NULLIF(stddev_samp(a) OVER {_rows(5)} * stddev_samp(b) OVER {_rows(5)}, 0)")], 5),
    "xs_cov": ("xs_cov(m.revenue / 100000, m.qty / 100)", _cov("revenue / 100000", "qty / 100", X), 6),
    "xs_pvar": ("xs_pvar(m.x / 100000)", _cov("y", "y", X), 6),
    "neutralize": ("neutralize(m.revenue / 100000, m.qty / 100)", f"revenue / 100000 - avg(revenue / 100000) OVER ({X}) - {_cov('revenue / 100000', 'qty / 100', X)} / NULLIF({_cov('qty / 100', 'qty / 100', X)}, 0) * (qty / 100 - avg(qty / 100) OVER ({X}))", 5),
    "ic": ("ic(m.ret * 10, m.revenue / 100000)", _corr("(ret * 10)", "(revenue / 100000)", X), 5),
    "diff": ("diff(m.x)", f"x - lag(x) OVER ({E})", 6),
    "deriv": ("deriv(m.x, 3)", f"(x - lag(x, 3) OVER ({E})) / 3", 6),
    "pct_change": ("pct_change(m.x, 2)", f"x / NULLIF(lag(x, 2) OVER ({E}), 0) - 1", 6),
    "integral": ("integral(m.x)", _past("sum(x)"), 4),
    "trapz": ("trapz(m.x)", [f"(x + lag(x) OVER ({E})) / 2 AS mid", f"CASE WHEN mid IS NOT NULL THEN sum(mid) OVER ({_W}) END"], 4),
    "pi": ("m.ret * pi()", "ret * pi()", 9),
    "tau": ("m.ret * tau()", "ret * 2 * pi()", 9),
    "euler": ("m.ret * euler()", "ret * exp(1)", 9),
    "square": ("square(m.ret)", "ret * ret", 10),
    "cube": ("cube(m.ret * 10)", "power(ret * 10, 3)", 6),
    "reciprocal": ("reciprocal(m.qty - 30)", "1 / NULLIF(qty - 30, 0)", 8),
    "sign": ("sign(m.ret)", "sign(ret)", 0),
    "cbrt": ("cbrt(m.ret)", "sign(ret) * abs(ret) ^ (1 / 3.0)", 8),
    "logb": ("logb(m.qty, 3)", "ln(qty) / ln(3)", 8),
    "log10": ("log10(m.qty)", "log10(qty)", 8),
    "log2": ("log2(m.qty)", "log2(qty)", 8),
    "log1p": ("log1p(m.disc)", "ln(1 + disc)", 8),
    "expm1": ("expm1(m.ret)", "exp(ret) - 1", 8),
    "pow10": ("pow10(m.ret)", "power(10, ret)", 8),
    "pow": ("pow(m.qty, m.disc)", "power(qty, disc)", 8),
    "normal_cdf": ("normal_cdf(m.ret * 20)", f"0.5 * (1 + sign(ret) * (SELECT {_ERF_SQL} FROM (SELECT abs(ret * 20) / sqrt(2) AS z, 1 / (1 + 0.3275911 * abs(ret * 20) / sqrt(2)) AS t)))", 6),
    "sinh": ("sinh(m.ret)", "(exp(ret) - exp(-ret)) / 2", 8),
    "cosh": ("cosh(m.ret)", "(exp(ret) + exp(-ret)) / 2", 8),
    "tanh": ("tanh(m.ret)", "(exp(ret) - exp(-ret)) / (exp(ret) + exp(-ret))", 8),
    "asinh": ("asinh(m.ret)", "ln(ret + sqrt(ret * ret + 1))", 8),
    "acosh": ("acosh(m.qty)", "ln(qty + sqrt(qty * qty - 1))", 8),
    "atanh": ("atanh(m.ret)", "0.5 * ln((1 + ret) / (1 - ret))", 8),
    "logit": ("logit(m.disc)", "CASE WHEN disc > 0 AND disc < 1 THEN ln(greatest(disc, 1e-9) / (1 - disc)) END", 6),
    "softplus": ("softplus(m.ret)", "ln(1 + exp(ret))", 8),
    "deg2rad": ("deg2rad(m.qty)", "radians(qty)", 8),
    "rad2deg": ("rad2deg(m.ret)", "degrees(ret)", 8),
    "signed_power": ("signed_power(m.ret, 0.5)", "sign(ret) * sqrt(abs(ret))", 8),
    "clip_lower": ("clip_lower(m.ret, 0)", "greatest(ret, 0)", 8),
    "clip_upper": ("clip_upper(m.ret, 0)", "least(ret, 0)", 8),
    "to_pct": ("to_pct(m.ret)", "ret * 100", 8),
    "indicator": ("indicator(m.qty > 100)", "CASE WHEN qty > 100 THEN 1 ELSE 0 END", 0),
    "dist2": ("dist2(m.ret, m.disc, 0.01, 0.05)", "sqrt((ret - 0.01) ^ 2 + (disc - 0.05) ^ 2)", 8),
    "manhattan": ("manhattan(m.ret, m.disc, 0.01, 0.05)", "abs(ret - 0.01) + abs(disc - 0.05)", 8),
    "max_drawdown": ("max_drawdown(m.ret)", [*_WEALTH, "min(fall) OVER (PARTITION BY entity)"], 8),
    "sortino": ("sortino(m.ret, 12)", "avg(ret) OVER (PARTITION BY entity) / NULLIF(sqrt(avg(least(ret, 0) * least(ret, 0)) OVER (PARTITION BY entity)), 0) * sqrt(12)", 5),
    "calmar": ("calmar(m.ret, 12)", [*_WEALTH, "avg(ret) OVER (PARTITION BY entity) * 12 / NULLIF(-min(fall) OVER (PARTITION BY entity), 0)"], 5),
    "norm_ppf": ("norm_ppf(pctile(m.x))", [f"CASE WHEN x IS NOT NULL THEN {_PCTILE} END AS share", f"CASE WHEN share IS NOT NULL THEN {_ppf_sql('share')} END"], 6),
    "divide_values": ("m.x / (m.qty - 100)", "x / NULLIF(qty - 100, 0)", 8),
    "modulo_negative": ("(m.qty - 150) % -7", "(((qty - 150) % -7) - 7) % -7", 6),
    "cagr_across_zero": ("cagr(m.ret, 3)", [f"lag(ret, 3) OVER ({E}) AS b", "CASE WHEN ret * b < 0 THEN -2 * least(ret, b) ELSE 0 END AS up", "CASE WHEN (ret + up) / NULLIF(b + up, 0) >= 0 THEN abs((ret + up) / NULLIF(b + up, 0)) ^ (1 / 3.0) - 1 END"], 5),
    "increase_across_zero": ("increase(m.ret, 2)", [f"lag(ret, 2) OVER ({E}) AS b", "(ret - b) / NULLIF(b + CASE WHEN ret * b < 0 THEN -2 * least(ret, b) ELSE 0 END, 0)"], 5),
    "between": ("1 if between(m.ret, -0.01, 0.01) else 0", "CASE WHEN ret >= -0.01 AND ret <= 0.01 THEN 1 ELSE 0 END", 0),
}


def program(text: str):
    """A checked program."""
    found = prepare(text)
    for i in validate(found):
        if i.severity == "error":
            raise PanelError(i.code, i.message)
    return found


def shown(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("entity", F.date_format("time", "yyyy-MM-dd").alias("period"), *[c.alias(n) for n, c in columns.items()])


def _number(c: Column, digits: int) -> Column:
    # as SQL rounds: the scaled double, not its decimal digits; + 0.0 turns -0.0 into 0.0
    c = c.cast("double")
    scaled = F.round(c * 10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), scaled / 10.0**digits).otherwise(c) + F.lit(0.0)


def _case(expression: str, digits: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = program(f"signal value = {expression}")
        return shown(lower.run(p.named("value"), p, supplier_months(spark, sf)), value=_number(F.col("value"), digits))

    return run


_EWM = """
s AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY time) AS i FROM p),
w AS (
  SELECT a.entity, a.time, a.{x} AS now, power(0.5, a.i - b.i) AS w, b.{x} AS v
  FROM s a JOIN s b ON a.entity = b.entity AND b.i <= a.i AND b.i >= a.i - 60 AND b.{x} IS NOT NULL),
m AS (SELECT entity, time, any_value(now) AS now, sum(w) AS w, sum(w * w) AS w2, sum(w * v) / sum(w) AS mean, sum(w * v * v) / sum(w) AS square FROM w GROUP BY 1, 2)"""


def _case_sql(sql: str | list[str], digits: int) -> str:
    time = "strftime(time, '%Y-%m-%d') AS period"
    if sql == "EWM_MEAN":
        body = f"SELECT s.entity, strftime(s.time, '%Y-%m-%d') AS period, ROUND(CASE WHEN s.x IS NOT NULL THEN m.mean END, {digits}) + 0.0 AS value FROM s LEFT JOIN m USING (entity, time)"
        return f"WITH {SUPPLIERS},{_EWM.format(x='x')} {body}"
    if sql == "EWM_STD":
        body = f"SELECT entity, {time}, ROUND(CASE WHEN w * w - w2 <= 1e-12 THEN 0 ELSE sqrt(greatest(square - mean * mean, 0) * w * w / (w * w - w2)) END, {digits}) + 0.0 AS value FROM m"
        return f"WITH {SUPPLIERS},{_EWM.format(x='revenue / 100000')} {body}"
    *before, sql = [sql] if isinstance(sql, str) else sql
    steps, last = "", "q"
    for i, column in enumerate(before):
        steps, last = f"{steps}, q{i} AS (SELECT *, {column} FROM {last})", f"q{i}"
    return f"WITH {SUPPLIERS}, q AS (SELECT *, x / 100000 AS y FROM p){steps} SELECT entity, {time}, ROUND(CAST({sql} AS DOUBLE), {digits}) + 0.0 AS value FROM {last}"


# models, alignment and loading

FLAGSHIP = """
universe busy = stocks where m.qty > 20
model growth on busy {
  desc "growth, standing in the group, and a composite"
  growth = m.revenue / lag(m.revenue, 1) - 1
  standing = zscore(m.revenue) by meta.sector
  score s_growth weight 3 { 2 if growth > 0.2 1 if growth > 0 else 0 }
  score s_standing weight 2 { 2 if standing > 1 1 if standing > 0 else 0 }
  export growth
  export standing
  export composite = weighted_score()
}
"""
_FLAGSHIP_SQL = f"""
WITH {SUPPLIERS}, u AS (SELECT * FROM p WHERE qty > 20),
g AS (SELECT *, revenue / lag(revenue) OVER ({E}) - 1 AS growth, (revenue - avg(revenue) OVER ({XG})) / NULLIF(stddev_samp(revenue) OVER ({XG}), 0) AS standing FROM u),
s AS (SELECT *, CASE WHEN growth IS NULL THEN NULL WHEN growth > 0.2 THEN 2 WHEN growth > 0 THEN 1 ELSE 0 END AS a,
  CASE WHEN standing IS NULL THEN NULL WHEN standing > 1 THEN 2 WHEN standing > 0 THEN 1 ELSE 0 END AS b FROM g)
SELECT entity, strftime(time, '%Y-%m-%d') AS period, ROUND(growth, 6) + 0.0 AS growth, ROUND(standing, 6) + 0.0 AS standing,
  ROUND((coalesce(a * 3, 0) + coalesce(b * 2, 0)) / NULLIF(CASE WHEN a IS NULL THEN 0 ELSE 6.0 END + CASE WHEN b IS NULL THEN 0 ELSE 4.0 END, 0), 6) + 0.0 AS composite
FROM s
"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    p = program(FLAGSHIP)
    out = lower.run(p.named("growth"), p, supplier_months(spark, sf))
    return shown(out, **{c: _number(F.col(c), 6) for c in ("growth", "standing", "composite")})


def score_zero(spark: SparkSession, sf: str) -> DataFrame:
    p = program("model z { on_missing zero g = yoy(m.x) score s weight 2 { 3 if g > 0.1 1 if g > 0 else 0 } export s export total = weighted_score() }")
    out = lower.run(p.named("z"), p, supplier_months(spark, sf))
    return shown(out, s=_number(F.col("s"), 1), total=_number(F.col("total"), 6))


_SCORE_ZERO_SQL = f"""
WITH {SUPPLIERS}, g AS (SELECT *, x / lag(x) OVER ({E}) - 1 AS g FROM p),
s AS (SELECT *, CASE WHEN g IS NULL THEN NULL WHEN g > 0.1 THEN 3.0 WHEN g > 0 THEN 1.0 ELSE 0.0 END AS s FROM g)
SELECT entity, strftime(time, '%Y-%m-%d') AS period, ROUND(s, 1) + 0.0 AS s, ROUND(coalesce(s * 2, 0) / 6.0, 6) + 0.0 AS total FROM s
"""


def universe_window(spark: SparkSession, sf: str) -> DataFrame:
    """A universe below another, one with a window, before a lag over the rows that are left."""
    p = program("universe a = stocks where m.qty > 20 universe b = a where rank(m.revenue) > 5 model k on b { export back = lag(m.revenue, 1) }")
    return shown(lower.run(p.named("k"), p, supplier_months(spark, sf)), back=_number(F.col("back"), 2))


_UNIVERSE_SQL = f"""
WITH {SUPPLIERS}, r AS (SELECT *, rank() OVER ({X} ORDER BY revenue) AS r FROM p), u AS (SELECT * FROM r WHERE r > 5 AND qty > 20)
SELECT entity, strftime(time, '%Y-%m-%d') AS period, ROUND(lag(revenue) OVER ({E}), 2) + 0.0 AS back FROM u
"""


def user_spans(spark: SparkSession, sf: str) -> DataFrame:
    p = program('model k { export week = roll_sum(u.value, "1w") export known = asof(u.value) export days = datediff(time, lag(time, 1)) }')
    out = lower.run(p.named("k"), p, user_days(spark, sf))
    return shown(out, week=_number(F.col("week"), 2), known=_number(F.col("known"), 2), days=_number(F.col("days"), 0))


_USER_SQL = f"""
WITH {USERS}
SELECT entity, strftime(time, '%Y-%m-%d') AS period, ROUND(sum(value) OVER {_span("7 DAY")}, 2) + 0.0 AS week, ROUND(value, 2) + 0.0 AS known,
  CAST(date_diff('day', lag(time) OVER ({E}), time) AS DOUBLE) + 0.0 AS days FROM p
"""


def nation_years(spark: SparkSession, sf: str) -> DataFrame:
    """(nation x year): order totals, keyed by a foreign dimension."""
    o, c = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    at = period_end(F.col("o_orderdate"), "annual")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.concat(F.lit("N"), (F.col("c_nationkey") % 5).cast("string")).alias("entity"), at.alias("time")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("n.total"))


def world_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """One global quarterly series."""
    at = period_end(F.col("l_shipdate"), "quarterly")
    return _table(spark, sf, "lineitem").groupBy(at.alias("time")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / (F.count("*") * 100)).alias("g.rate")).select(F.lit("*").alias("entity"), "time", "`g.rate`")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly suppliers, a coarser global series and a coarser foreign dimension, on the monthly grid."""
    base = supplier_months(spark, sf).select("entity", "time", "`m.revenue`", "`meta.sector`")
    out = align(
        [
            Loaded(base, "monthly", is_global=False), Loaded(world_quarters(spark, sf), "quarterly", is_global=True),
            Loaded(nation_years(spark, sf), "annual", "nation", bridge="meta.sector"),
        ],
        "monthly",
    )
    return shown(out, revenue=_number(F.col("`m.revenue`"), 2), rate=_number(F.col("`g.rate`"), 6), total=_number(F.col("`n.total`"), 2))


_ALIGNED_SQL = f"""
WITH {SUPPLIERS},
g AS (SELECT CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS TIMESTAMP) AS time, CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100) AS rate FROM lineitem GROUP BY 1),
n AS (SELECT 'N' || (c_nationkey % 5) AS sector, CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS TIMESTAMP) AS time, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT p.entity, strftime(p.time, '%Y-%m-%d') AS period, ROUND(p.revenue, 2) + 0.0 AS revenue, ROUND(g.rate, 6) + 0.0 AS rate, ROUND(n.total, 2) + 0.0 AS total
FROM p ASOF LEFT JOIN g ON p.time >= g.time ASOF LEFT JOIN n ON p.sector = n.sector AND p.time >= n.time
"""


def downsampled(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind's own reduction to years."""
    out = align([Loaded(supplier_months(spark, sf).drop("m.busy"), "monthly", is_global=False)], "annual")
    digits = {"m.revenue": 2, "m.x": 2, "m.price": 2, "m.disc": 10, "m.ret": 10, "m.stock": 2}
    return shown(out, **{c.split(".")[1]: _number(F.col(f"`{c}`"), d) for c, d in digits.items()})


_DOWN_SQL = f"""
WITH {SUPPLIERS}
SELECT entity, strftime(date_trunc('year', time) + INTERVAL 1 YEAR - INTERVAL 1 DAY, '%Y-%m-%d') AS period, ROUND(SUM(revenue), 2) + 0.0 AS revenue,
  ROUND(coalesce(SUM(x), 0), 2) + 0.0 AS x, ROUND(arg_max(price, time), 2) + 0.0 AS price, ROUND(AVG(disc), 10) + 0.0 AS disc, ROUND(product(1 + ret) - 1, 10) + 0.0 AS ret,
  ROUND(arg_max(stock, time), 2) + 0.0 AS stock
FROM p GROUP BY 1, 2
"""


def point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by customer and quarter, placed where their last line was shipped."""
    ship = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("known"))
    rows = _table(spark, sf, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey"), period_end(F.col("o_orderdate"), "quarterly").alias("time")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("m.revenue"), F.max("known").cast("timestamp_ntz").alias(date_column("shipped")))
    panel = rows.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity"), "time", "`m.revenue`", f"`{date_column('shipped')}`")
    out = align([Loaded(panel, "quarterly", coordinates={"m.revenue": date_column("shipped")}, is_global=False)], "quarterly")
    return shown(out, revenue=_number(F.col("`m.revenue`"), 2))


_PIT_SQL = """
WITH k AS (SELECT l_orderkey, max(l_shipdate) AS known FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS q, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue, max(known) AS known FROM orders JOIN k ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT 'C' || o_custkey AS entity, strftime(date_trunc('quarter', known) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS period, ROUND(SUM(revenue), 2) + 0.0 AS revenue
FROM r GROUP BY 1, 2
"""


def asof_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with its customer's latest order total of an earlier or equal month that has one."""
    o = _table(spark, sf, "orders").groupBy("o_custkey", period_end(F.col("o_orderdate"), "monthly").alias("month")).agg(F.round(F.max("o_totalprice"), 2).alias("top"))
    e = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("time"))
    found = asof_join(e, o, "month", ["o_custkey"], ["top"])
    return found.select("o_orderkey", "top")


_ASOF_SQL = """
WITH o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS TIMESTAMP) AS month, ROUND(MAX(o_totalprice), 2) AS top FROM orders GROUP BY 1, 2)
SELECT e.o_orderkey, o.top FROM orders e ASOF LEFT JOIN o ON e.o_custkey = o.o_custkey AND CAST(e.o_orderdate AS TIMESTAMP) >= o.month
"""


def config_loading(spark: SparkSession, sf: str) -> DataFrame:
    """Through a configuration: two sources coalesced cell by cell, a pinned entity, and a universe."""
    from .plans.needs import scoped_needs
    from .sources.config import config_of
    from .sources.loader import load_panel

    base = supplier_months(spark, sf)
    first = base.select("entity", "time", F.when(F.col("`m.x`").isNotNull(), F.col("`m.price`")).alias("m.price"), "`m.qty`")
    second = base.select("entity", "time", F.col("`m.revenue`").alias("m.price"))
    rows = lambda f: {"driver": "rows", "options": {"frame": f, "frequency": "monthly", "global": False}}
    config = config_of({"sources": {"a": rows(first), "b": rows(second)}, "precedence": {"default": ["a", "b"]}})
    p = program('model k at monthly { export cell = m.price export other = m.price @ b export pin = m.qty @ entity("S1") }')
    n = scoped_needs(p.named("k"), p)
    out = lower.run(p.named("k"), p, load_panel(spark, config, n.fields, "monthly", None, n.aligns))
    return shown(out, **{c: _number(F.col(c), 2) for c in ("cell", "other", "pin")})


_CONFIG_SQL = f"""
WITH {SUPPLIERS}, one AS (SELECT time, qty FROM p WHERE entity = 'S1')
SELECT entity, strftime(p.time, '%Y-%m-%d') AS period, ROUND(CASE WHEN x IS NOT NULL THEN price ELSE revenue END, 2) + 0.0 AS cell, ROUND(revenue, 2) + 0.0 AS other, ROUND(coalesce(one.qty, NULL), 2) + 0.0 AS pin
FROM p LEFT JOIN one ON one.time = p.time
"""

MODELS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship": (flagship, _FLAGSHIP_SQL), "score_zero": (score_zero, _SCORE_ZERO_SQL), "universe_window": (universe_window, _UNIVERSE_SQL),
    "user_spans": (user_spans, _USER_SQL), "aligned": (aligned, _ALIGNED_SQL), "downsampled": (downsampled, _DOWN_SQL), "point_in_time": (point_in_time, _PIT_SQL),
    "asof_by_key": (asof_by_key, _ASOF_SQL), "config_loading": (config_loading, _CONFIG_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in MODELS.items()} | {f"fn_{n}": _case(e, d) for n, (e, _, d) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in MODELS.items()} | {f"fn_{n}": _case_sql(s, d) for n, (_, s, d) in CASES.items()}
