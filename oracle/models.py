"""Elastic nets in SQL: moments of the training rows, then coordinate descent as a recursion."""

from __future__ import annotations

from .returns import DAY, EVENT_F, EVENT_NAMES, HOUR, ORDER_F, ORDER_NAMES, SPLIT
from .text import rnd, with_tables

L1 = L2 = "25e-5"  # alpha 0.0005, half of it for each penalty


def net(base: dict[str, str], names: list[str], sweeps: int) -> dict[str, str]:
    """Tables up to ``cd``: a row per target with the list ``b`` of its coefficients.

    A recursion step moves one coefficient of every target; ``sweeps`` times all of them.
    """
    k = len(names)

    def scaled(n: str) -> str:
        mean = f"AVG({n}) FILTER (is_train) OVER (PARTITION BY target)"
        dev = f"STDDEV_POP({n}) FILTER (is_train) OVER (PARTITION BY target)"
        return f"({n} - {mean}) / (CASE WHEN {dev} > 0 THEN {dev} ELSE 1 END)"

    line = ", ".join(f"AVG(x[i] * x[{j}]) - AVG(x[i]) * AVG(x[{j}])" for j in range(1, k + 1))
    slope = "c[j] - list_dot_product(g[j], b) + g[j][j] * b[j]"
    return {
        **base,
        **SPLIT,
        "z": f"SELECT target, date, is_train, label AS y, [{', '.join(map(scaled, names))}] AS x FROM split",
        "lines": f"""SELECT target, i, [{line}] AS line, AVG(x[i] * y) - AVG(x[i]) * AVG(y) AS pull,
                     AVG(x[i]) AS mean, AVG(y) AS level
                     FROM z CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS i) WHERE is_train GROUP BY target, i""",
        "gram": """SELECT target, list(line ORDER BY i) AS g, list(pull ORDER BY i) AS c,
                   list(mean ORDER BY i) AS means, MAX(level) AS level FROM lines GROUP BY target""",
        "cd(target, step, b) USING KEY (target)": f"""
            SELECT target, 0, list_transform(range({k}), lambda i: 0e0) FROM gram
            UNION ALL
            SELECT target, step + 1, list_concat(list_concat(b[:j - 1],
                   [SIGN(s) * GREATEST(ABS(s) - {L1}, 0) / (g[j][j] + {L2})]), b[j + 1:])
            FROM (SELECT *, {slope} AS s
                  FROM (SELECT cd.*, gram.g, gram.c, cd.step % {k} + 1 AS j FROM cd INNER JOIN gram USING (target))
                  WHERE step < {sweeps * k})""",
        "fit": """SELECT target, b, level - list_dot_product(means, b) AS intercept
                  FROM cd INNER JOIN gram USING (target)""",
        "forecast": """SELECT target, date, intercept + list_dot_product(x, b) AS pred, y AS actual
                       FROM z INNER JOIN fit USING (target) WHERE NOT is_train""",
    }


def recursive(tables: dict[str, str], body: str) -> str:
    return with_tables(tables, body).replace("WITH", "WITH RECURSIVE", 1)


EVENTS = net(EVENT_F, EVENT_NAMES, 150)
NATIONS = net(ORDER_F, ORDER_NAMES, 2000)


def named(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"SELECT target, unnest([{listed}]) AS feature, unnest(b) AS coef FROM fit"


MODELS = {
    "fitted_model_facts": with_tables(
        {**EVENT_F, **SPLIT},
        f"""SELECT unnest(['Elastic Net', 'Decision Tree', 'Gradient Boosting', 'Random Forest']) AS model,
            target, n, actual_sum, date AS first_day, n AS n_inside
            FROM (SELECT target, COUNT(*) AS n, {rnd('SUM(label)', 6)} AS actual_sum,
                  strftime(MIN(date), '%Y-%m-%d %H:%M:%S') AS date FROM split WHERE NOT is_train GROUP BY target)""",
    ),
    "fit_elastic_net": recursive(
        EVENTS,
        f"""SELECT 'Elastic Net' AS model, target, {HOUR}, {rnd('pred', 6)} AS pred,
            {rnd('actual', 6)} AS actual FROM forecast""",
    ),
    "coef_top": recursive(
        {
            **EVENTS,
            "named": named(EVENT_NAMES),
            "placed": """SELECT *, ROW_NUMBER() OVER (ORDER BY coef DESC, feature) AS high,
                         ROW_NUMBER() OVER (ORDER BY coef, feature) AS low FROM named""",
        },
        f"""SELECT feature, replace(replace(feature, '_ret', ''), '_', ' ') AS label, {rnd('coef', 6)} AS coef,
            CASE WHEN coef > 0 THEN 'positive' ELSE 'not positive' END AS sign_class
            FROM placed WHERE high <= 12
            UNION ALL
            SELECT feature, replace(replace(feature, '_ret', ''), '_', ' '), {rnd('coef', 6)},
            CASE WHEN coef > 0 THEN 'positive' ELSE 'not positive' END
            FROM placed WHERE low <= 8""",
    ),
    "fit_many_targets": recursive(
        {**NATIONS, "named": named(ORDER_NAMES)},
        f"SELECT target, feature, {rnd('coef', 6)} AS coef FROM named",
    ),
    "predict_many_targets": recursive(
        NATIONS,
        f"SELECT target, {DAY}, {rnd('pred', 6)} AS pred, {rnd('actual', 6)} AS actual FROM forecast",
    ),
}
