"""Return panels, features and backtests."""

from __future__ import annotations

from .text import rnd, with_tables

EVENTS = {
    "p": """SELECT date_trunc('hour', ts) AS date, event_type AS symbol, SUM(value) AS price
            FROM events GROUP BY ALL""",
    "days": """SELECT unnest(generate_series((SELECT MIN(date) FROM p), (SELECT MAX(date) FROM p),
               INTERVAL 1 HOUR)) AS date""",
}
ORDERS = {
    "p": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
                   'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS symbol,
                   SUM(o_totalprice) AS price
            FROM orders INNER JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
    "days": """SELECT CAST(unnest(generate_series((SELECT MIN(date) FROM p),
               (SELECT MAX(date) FROM p), INTERVAL 7 DAY)) AS DATE) AS date""",
}
RETURNS = {
    "grid": "SELECT symbol, date FROM (SELECT DISTINCT symbol FROM p) CROSS JOIN days",
    "filled": "SELECT symbol, date, price FROM grid LEFT JOIN p USING (symbol, date)",
    "prior": """SELECT *, LAG(price) OVER (PARTITION BY symbol ORDER BY date) AS previous
                FROM filled""",
    "x": """SELECT symbol, date, CASE WHEN price > 0 AND previous > 0
                                 THEN ln(price / previous) ELSE 0 END AS ret FROM prior""",
}


def series(agg: str, rows: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS {rows - 1} PRECEDING)"
    return f"CASE WHEN COUNT(ret) {frame} = {rows} THEN {agg}(ret) {frame} END"


def step(expr: str) -> str:
    return f"{expr} OVER (PARTITION BY symbol ORDER BY date)"


OWN = {
    "own": f"""SELECT symbol, date, {series('AVG', 4)} AS ma4, {series('AVG', 13)} AS ma13,
               {series('STDDEV_SAMP', 4)} AS vol4, {series('SUM', 12)} AS momentum_12,
               {step('LEAD(ret)')} AS label FROM x""",
}
DAY = "strftime(date, '%Y-%m-%d') AS date"
HOUR = "strftime(date, '%Y-%m-%d %H:%M:%S') AS date"
OWN_NAMES = ["ma4", "ma13", "vol4", "momentum_12"]
CROSS_NAMES = ["cross_mean", "cross_dispersion"]


def rounded(names: list[str], digits: int = 8) -> str:
    return ", ".join(f"{rnd(n, digits)} AS {n}" for n in names)


def wide(symbols: list[str], lags: list[int]) -> tuple[list[str], dict[str, str]]:
    """Supplier columns by date: names and the two tables that make them."""
    past = ", ".join("ret AS lag_0" if k == 0 else f"{step(f'LAG(ret, {k})')} AS lag_{k}" for k in lags)
    names, columns = [], []
    for s in symbols:
        for k in lags:
            name = f"{s}_ret" if k == 0 else f"{s}_ret_lag{k}"
            names.append(name)
            columns.append(f"ANY_VALUE(lag_{k}) FILTER (symbol = '{s}') AS {name}")
    listed = ", ".join(f"'{s}'" for s in symbols)
    return names, {
        "past": f"SELECT symbol, date, ret, {past} FROM x WHERE symbol IN ({listed})",
        "w": f"""SELECT date, {', '.join(columns)}, AVG(ret) AS cross_mean,
                 STDDEV_SAMP(ret) AS cross_dispersion FROM past GROUP BY date""",
    }


def features(base: dict[str, str], targets: str, symbols: list[str], lags: list[int]):
    names, tables = wide(symbols, lags)
    names = [*names, *OWN_NAMES, *CROSS_NAMES]
    complete = " AND ".join(f"{n} IS NOT NULL" for n in ["label", *names])
    return names, {
        **base,
        **RETURNS,
        **OWN,
        **tables,
        "f": f"""SELECT symbol AS target, date, label, {', '.join(names)}
                 FROM own INNER JOIN w USING (date) WHERE {targets} AND {complete}""",
    }


NATIONS = [f"N{i:02d}" for i in range(25)]
EVENT_NAMES, EVENT_F = features(
    EVENTS, "symbol = 'purchase'", ["click", "error", "signup", "view"], [0, 1, 2, 3]
)
ORDER_NAMES, ORDER_F = features(ORDERS, "TRUE", NATIONS, [0])
SPLIT = {
    "split": """SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY date)
                <= floor(75e-2 * COUNT(*) OVER (PARTITION BY target)) AS is_train FROM f""",
}


def standardised(names: list[str]) -> str:
    def one(n: str) -> str:
        mean = f"AVG({n}) FILTER (is_train) OVER (PARTITION BY target)"
        dev = f"STDDEV_POP({n}) FILTER (is_train) OVER (PARTITION BY target)"
        return f"{rnd(f'({n} - {mean}) / (CASE WHEN {dev} > 0 THEN {dev} ELSE 1 END)', 6)} AS {n}"

    return ", ".join(one(n) for n in names)


PANELS = {
    "calendar_densify": with_tables(
        {**ORDERS, **RETURNS}, f"SELECT symbol, {DAY}, {rnd('price', 2)} AS price FROM filled"
    ),
    "calendar_last_price": f"""
        WITH o AS (
          SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price,
                 CAST(o_orderdate AS DATE) - CAST(dayofweek(CAST(o_orderdate AS DATE)) AS INT) AS date
          FROM orders
        ), placed AS (
          SELECT symbol, date, price, ROW_NUMBER() OVER (
            PARTITION BY symbol, date ORDER BY day DESC, price DESC) AS nth
          FROM o WHERE price IS NOT NULL
        ), weeks AS (
          SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date
          FROM (SELECT MIN(date) AS lo, MAX(day) AS hi FROM o)
        ), grid AS (
          SELECT symbol, date FROM (SELECT DISTINCT symbol FROM o), weeks
        )
        SELECT grid.symbol, strftime(grid.date, '%Y-%m-%d') AS date, {rnd('price', 2)} AS price
        FROM grid LEFT JOIN placed
          ON placed.symbol = grid.symbol AND placed.date = grid.date AND placed.nth = 1""",
    "log_returns_events": with_tables(
        {**EVENTS, **RETURNS}, f"SELECT symbol, {HOUR}, {rnd('ret', 8)} AS ret FROM x"
    ),
    "log_returns_orders": with_tables(
        {**ORDERS, **RETURNS}, f"SELECT symbol, {DAY}, {rnd('ret', 8)} AS ret FROM x"
    ),
    "lag_features": with_tables(
        {**ORDERS, **RETURNS},
        f"SELECT symbol, {DAY}, {rnd('ret', 8)} AS ret, "
        + ", ".join(f"{rnd(step(f'LAG(ret, {k})'), 8)} AS lag_{k}" for k in [1, 2, 3, 4])
        + " FROM x",
    ),
    "cross_section_stats": with_tables(
        {**ORDERS, **RETURNS},
        f"""SELECT {DAY}, {rnd('AVG(ret)', 8)} AS cross_mean,
            {rnd('STDDEV_SAMP(ret)', 8)} AS cross_dispersion FROM x GROUP BY x.date""",
    ),
    "own_features": with_tables(
        {**ORDERS, **RETURNS, **OWN},
        f"SELECT symbol, {DAY}, {rounded([*OWN_NAMES, 'label'])} FROM own",
    ),
    "features_events": with_tables(
        EVENT_F, f"SELECT target, {HOUR}, {rounded(['label', *EVENT_NAMES])} FROM f"
    ),
    "features_orders": with_tables(
        ORDER_F, f"SELECT target, {DAY}, {rounded(['label', *ORDER_NAMES])} FROM f"
    ),
    "chrono_split": with_tables(
        {**ORDER_F, **SPLIT},
        f"SELECT target, {DAY}, {rnd('label', 8)} AS label, CAST(is_train AS BIGINT) AS is_train FROM split",
    ),
    "standardise": with_tables(
        {**EVENT_F, **SPLIT},
        f"""SELECT target, {HOUR}, {rnd('label', 6)} AS label, CAST(is_train AS BIGINT) AS is_train,
            {standardised(EVENT_NAMES)} FROM split""",
    ),
}

# -- backtests -------------------------------------------------------------------------------

SERIES = "PARTITION BY model, target"
BY_DATE = f"{SERIES} ORDER BY date"
FORECASTS = {
    **ORDERS,
    **RETURNS,
    **OWN,
    "f": f"""SELECT symbol AS target, * EXCLUDE (symbol) FROM own
             WHERE {' AND '.join(f'{n} IS NOT NULL' for n in ['label', *OWN_NAMES])}""",
    **SPLIT,
    "y": """SELECT 'short trend' AS model, target, date, ma4 * 1e-2 AS pred, label * 1e-2 AS actual
            FROM split WHERE NOT is_train
            UNION ALL
            SELECT 'long trend', target, date, ma13 * 1e-2, label * 1e-2
            FROM split WHERE NOT is_train""",
}


def sized(largest: str) -> dict[str, str]:
    return {
        "s0": f"SELECT *, pred / ({largest} + 1e-9) AS pos FROM y",
        "s1": f"""SELECT *, ABS(pos - LAG(pos, 1, pos) OVER ({BY_DATE})) AS turnover FROM s0""",
        "s": "SELECT *, turnover * 5e-4 AS cost, pos * actual - turnover * 5e-4 AS strat FROM s1",
    }


FULL = sized(f"MAX(ABS(pred)) OVER ({SERIES})")
EXPANDING = sized(f"MAX(ABS(pred)) OVER ({BY_DATE} ROWS UNBOUNDED PRECEDING)")


def growth(source: str) -> dict[str, str]:
    running = f"OVER ({BY_DATE} ROWS UNBOUNDED PRECEDING)"
    year = f"OVER ({BY_DATE} ROWS 51 PRECEDING)"
    return {
        "g": f"""SELECT *, PRODUCT(1 + strat) {running} AS wealth,
                 PRODUCT(1 + actual) {running} AS bnh_wealth FROM {source}""",
        "c": f"""SELECT *, wealth - 1 AS cum, bnh_wealth - 1 AS bnh,
                 wealth / MAX(wealth) {running} - 1 AS drawdown,
                 CASE WHEN COUNT(*) {year} = 52 THEN AVG(strat) {year}
                   / (STDDEV_SAMP(strat) {year} + 1e-9) * sqrt(52e0) END AS rolling_sharpe FROM g""",
    }


CURVES = {**FORECASTS, **FULL, **growth("s")}
RESCALED = {
    **FORECASTS,
    **FULL,
    "z": f"""SELECT * EXCLUDE (strat), CASE WHEN model = 'short trend' THEN
             strat * COALESCE(5e-2 / NULLIF(PRODUCT(1 + strat) OVER ({SERIES}) - 1, 0), 1)
             ELSE strat END AS strat
             FROM s""",
    **growth("z"),
}
KEYS = f"model, target, {DAY}"
SUMMARY = """SELECT model, target, arg_max(cum, date) AS CumReturn, arg_max(bnh, date) AS BnH,
             AVG(strat) / (STDDEV_POP(strat) + 1e-9) * sqrt(52e0) AS Sharpe,
             MIN(drawdown) AS MaxDrawdown FROM c GROUP BY model, target"""
METRICS = """SELECT model, target, sqrt(AVG((actual - pred) ** 2)) AS RMSE,
             AVG(ABS(actual - pred)) AS MAE,
             CASE WHEN VAR_POP(actual) > 0
                  THEN 1 - SUM((actual - pred) ** 2) / (COUNT(*) * VAR_POP(actual))
                  WHEN MAX(ABS(actual - pred)) > 0 THEN 0 ELSE 1 END AS R2,
             AVG(CASE WHEN SIGN(actual) = SIGN(pred) THEN 1e0 ELSE 0e0 END) AS DirAcc
             FROM y GROUP BY model, target"""
BACK_NAMES = ["CumReturn", "BnH", "Sharpe", "MaxDrawdown"]
QUALITY_NAMES = ["RMSE", "MAE", "R2", "DirAcc"]
BOTH = {
    **CURVES,
    "both_": f"""SELECT m.model AS Model, m.target, {', '.join(QUALITY_NAMES + BACK_NAMES)}
                 FROM ({METRICS}) m INNER JOIN ({SUMMARY}) b USING (model, target)""",
}

BACKTESTS = {
    "bt_positions": with_tables(
        {**FORECASTS, **FULL},
        f"""SELECT {KEYS}, {rounded(['pos', 'turnover', 'cost', 'strat'])},
            CAST(SIGN(pred) AS INTEGER) AS side FROM s""",
    ),
    "bt_positions_expanding": with_tables(
        {**FORECASTS, **EXPANDING},
        f"""SELECT {KEYS}, {rounded(['pos', 'turnover', 'cost', 'strat'])},
            CAST(SIGN(pred) AS INTEGER) AS side FROM s""",
    ),
    "bt_curves": with_tables(
        CURVES,
        f"SELECT {KEYS}, {rounded(['strat', 'wealth', 'bnh_wealth', 'cum', 'bnh'])} FROM c",
    ),
    "bt_rescaled": with_tables(RESCALED, f"SELECT {KEYS}, {rounded(['strat', 'cum'])} FROM c"),
    "bt_summary": with_tables(
        CURVES, f"SELECT model, target, {rounded(BACK_NAMES)} FROM ({SUMMARY})"
    ),
    "bt_curve_table": with_tables(
        CURVES,
        f"""SELECT {KEYS}, {rnd('100 * cum', 6)} AS cum_pct, {rnd('100 * bnh', 6)} AS bnh_pct,
            CAST(cum > bnh AS BIGINT) AS above FROM c""",
    ),
    "forecast_metrics": with_tables(
        FORECASTS, f"SELECT model, target, {rounded(QUALITY_NAMES)} FROM ({METRICS})"
    ),
    "scatter_table": with_tables(
        FORECASTS, f"SELECT {KEYS}, {rnd('actual', 8)} AS y, {rnd('pred', 8)} AS pred FROM y"
    ),
    "axis_limits": with_tables(
        FORECASTS,
        f"""SELECT model, target,
            {rnd('11e-1 * MAX(GREATEST(ABS(actual), ABS(pred)))', 8)} AS lim
            FROM y GROUP BY model, target""",
    ),
    "rolling_sharpe": with_tables(
        CURVES,
        f"""SELECT {KEYS}, {rnd('rolling_sharpe', 6)} AS rolling_sharpe,
            CAST(SIGN(rolling_sharpe) AS INTEGER) AS sign,
            CAST(rolling_sharpe > 1 AS BIGINT) AS above_one
            FROM c WHERE rolling_sharpe IS NOT NULL""",
    ),
    "drawdown": with_tables(
        CURVES, f"SELECT {KEYS}, {rnd('100 * drawdown', 6)} AS drawdown_pct FROM c"
    ),
    "model_summary": with_tables(
        BOTH, f"SELECT Model, target, {rounded(QUALITY_NAMES + BACK_NAMES)} FROM both_"
    ),
    "metric_comparison": with_tables(
        {
            **BOTH,
            "long_": """SELECT target, Model, unnest([
                          {'metric': 'DirAcc', 'value': DirAcc, 'sign': 1},
                          {'metric': 'R2', 'value': R2, 'sign': 1},
                          {'metric': 'MAE x 1000', 'value': 1000 * MAE, 'sign': -1},
                          {'metric': 'Sharpe', 'value': Sharpe, 'sign': 1}]) AS m FROM both_""",
        },
        f"""
SELECT target, m.metric AS metric, Model, {rnd('m.value', 8)} AS value,
       CAST(ROW_NUMBER() OVER (PARTITION BY target, m.metric ORDER BY m.value * m.sign DESC,
            CASE Model WHEN 'short trend' THEN 0 ELSE 1 END) = 1 AS BIGINT) AS is_best
FROM long_""",
    ),
}
