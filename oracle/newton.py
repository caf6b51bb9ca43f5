"""The fitted regression in SQL: Newton steps from zero, each a pass over the training rows and an elimination."""

from __future__ import annotations

from oracle.sql import COEFFICIENTS, STEPS, step

STEPS_TAKEN = 14
NAMES = list(COEFFICIENTS)
N = len(NAMES) + 1  # with the intercept


def register() -> str:
    """Adds the steps and gives the name of the last: one row with moments mu, sd and weights beta, the intercept last."""
    for name, source, old in (("spc", "ct", "sp"), ("tec", "spc", "te")):
        needs, text = STEPS[old]
        step(name, [source], text.replace("FROM rk", "FROM ct").replace("FROM sp ", "FROM spc "))
    step(
        "mom",
        ["spc"],
        f"""SELECT [{", ".join(f"avg({c})" for c in NAMES)}] AS mu,
                   [{", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1)" for c in NAMES)}] AS sd
            FROM spc WHERE NOT is_test""",
    )
    scaled = ", ".join(f"({c} - mu[{i}]) / sd[{i}] AS z{i}" for i, c in enumerate(NAMES, 1))
    step(
        "trn",
        ["spc", "mom"],
        f"""SELECT {scaled}, 1.0::DOUBLE AS z{N}, CAST(Churn_90D AS DOUBLE) AS y,
                   count(*) OVER ()::DOUBLE / (2 * count(*) OVER (PARTITION BY Churn_90D)) AS w
            FROM spc, mom WHERE NOT is_test""",
    )
    step("b0", [], f"SELECT [{', '.join(['0.0::DOUBLE'] * N)}] AS beta")
    eta = " + ".join(f"beta[{i}] * z{i}" for i in range(1, N + 1))
    for k in range(STEPS_TAKEN):
        rows = []
        for i in range(1, N + 1):
            one = " + 1" if i < N else ""
            second = [f"sum(w * p * (1 - p) * z{min(i, j)} * z{max(i, j)}){one if i == j else ''}" for j in range(1, N + 1)]
            first = f"-(sum(w * (p - y) * z{i})" + (f" + any_value(beta[{i}])" if i < N else "") + ")"
            rows.append(f"[{', '.join([*second, first])}]")
        step(
            f"e{k}_0",
            ["trn", f"b{k}"],
            f"SELECT [{', '.join(rows)}] AS a FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM trn, b{k}) AS t",
        )
        for c in range(1, N + 1):
            step(
                f"e{k}_{c}",
                [f"e{k}_{c - 1}"],
                f"""SELECT list_transform(range(1, {N + 1}), lambda i: list_transform(range(1, {N + 2}), lambda j:
                        CASE WHEN i = {c} THEN a[i][j] / a[i][{c}] ELSE a[i][j] - a[i][{c}] / a[{c}][{c}] * a[{c}][j] END)) AS a
                    FROM e{k}_{c - 1}""",
            )
        step(
            f"b{k + 1}",
            [f"b{k}", f"e{k}_{N}"],
            f"SELECT list_transform(range(1, {N + 1}), lambda i: beta[i] + a[i][{N + 1}]) AS beta FROM b{k}, e{k}_{N}",
        )
    step("fit", ["mom", f"b{STEPS_TAKEN}"], f"SELECT mu, sd, beta FROM mom, b{STEPS_TAKEN}")
    linear = " + ".join(f"beta[{i}] * (({c} - mu[{i}]) / sd[{i}])" for i, c in enumerate(NAMES, 1)) + f" + beta[{N}]"
    step("pbf", ["ct", "fit"], f"SELECT ct.*, round(1.0::DOUBLE / (1 + exp(-({linear}))), 9) AS Churn_Probability_Raw FROM ct, fit")
    for name, old, source, was in (("rkf", "rk", "pbf", "pb"), ("spf", "sp", "rkf", "rk"), ("tef", "te", "spf", "sp"), ("cumf", "cum", "tef", "te")):
        text = STEPS[old][1]
        for before, after in ((f"FROM {was}", f"FROM {source}"), (f"SELECT {was}.*", f"SELECT {source}.*")):
            text = text.replace(before, after)
        step(name, [source], text)
    step(
        "coef",
        ["fit"],
        f"""SELECT feature, coefficient, abs(coefficient) AS abs_coefficient,
                   CASE WHEN coefficient > 0 THEN 'Higher Inactivity Risk (+)' ELSE 'Lower Inactivity Risk (-)' END AS direction
            FROM (SELECT unnest([{", ".join(f"'{c}'" for c in NAMES)}]) AS feature,
                         unnest(list_transform(beta[1:{N - 1}], lambda x: round(x, 6))) AS coefficient FROM fit) AS c""",
    )
    return "fit"
