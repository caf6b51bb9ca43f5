"""The registered queries as DuckDB SQL over the plain tables, written independently of the Spark code."""

from __future__ import annotations

# The columns of the customer table.
PREDICTORS = [
    "Recency",
    "Frequency",
    "Monetary",
    "AvgOrderValue",
    "UniqueProducts",
    "TotalItems",
    "ActiveMonths",
    "TenureDays",
    "PurchaseSpanDays",
]
TABLE_COLUMNS = ", ".join(["CustomerID", *PREDICTORS, "Country", "R", "F", "M", "RFM_Score", "RFM_Segment", "Churn_90D"])

# ---------------------------------------------------------------- shared steps

STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name, needs, text):
    STEPS[name] = (tuple(needs), text)


step(
    "tx",
    [],
    """
    SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
           CAST(l_partkey AS VARCHAR) AS StockCode,
           CASE WHEN l_partkey % 50 <> 0 THEN p_name END AS Description,
           CAST(CASE WHEN l_orderkey % 101 = 0 THEN 0 WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END
                AS INTEGER) AS Quantity,
           o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS InvoiceDate,
           CASE WHEN l_partkey % 199 = 0 THEN 0.0::DOUBLE
                ELSE CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                          // (2 * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE END AS UnitPrice,
           CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS CustomerID,
           n_name AS Country
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR l_orderkey % 97 = 0
    """,
)
step("filled", ["tx"], "SELECT * REPLACE (coalesce(Description, 'Unknown') AS Description) FROM tx")
step("dd", ["filled"], "SELECT DISTINCT * FROM filled")
step(
    "ql",
    ["dd"],
    """
    SELECT *, CAST(Quantity AS DOUBLE) * UnitPrice AS Revenue, false AS IsCancellation FROM dd
    WHERE CustomerID IS NOT NULL AND NOT coalesce(InvoiceNo LIKE 'C%', false) AND Quantity > 0 AND UnitPrice > 0
    """,
)
step(
    "ev",
    [],
    """
    SELECT CAST(event_id AS VARCHAR) AS InvoiceNo, 'event' AS StockCode, 'Unknown' AS Description, 1 AS Quantity,
           ts AS InvoiceDate, value AS UnitPrice, user_id AS CustomerID, 'unknown' AS Country, value AS Revenue,
           false AS IsCancellation
    FROM events WHERE event_type = 'purchase'
    """,
)
for lines in ("ql", "ev"):
    s = "" if lines == "ql" else "_ev"
    step(f"obs{s}", [lines], f"SELECT * FROM {lines} WHERE CAST(InvoiceDate AS DATE) <= DATE '{{snapshot}}'")
    step(
        f"fut{s}",
        [lines],
        f"SELECT * FROM {lines} WHERE CAST(InvoiceDate AS DATE) BETWEEN DATE '{{start}}' AND DATE '{{end}}'",
    )
    step(
        f"elig{s}",
        [f"obs{s}"],
        f"""
        SELECT CustomerID FROM obs{s} GROUP BY CustomerID
        HAVING count(DISTINCT InvoiceNo) >= 2
           AND floor((epoch_us(max(InvoiceDate)) - epoch_us(min(InvoiceDate))) / 86400000000) >= {{span}}
        """,
    )
    step(
        f"beh{s}",
        [f"obs{s}"],
        f"""
        SELECT CustomerID,
               CAST(date_diff('day', CAST(max(InvoiceDate) AS DATE), DATE '{{snapshot}}') AS INTEGER) AS Recency,
               count(DISTINCT InvoiceNo) AS Frequency,
               CAST(sum(CAST(Revenue AS DECIMAL(18, 4))) AS DOUBLE) AS Monetary,
               CAST(sum(CAST(Revenue AS DECIMAL(18, 4))) AS DOUBLE) / count(DISTINCT InvoiceNo) AS AvgOrderValue,
               count(DISTINCT StockCode) AS UniqueProducts,
               CAST(sum(Quantity) AS BIGINT) AS TotalItems,
               count(DISTINCT date_trunc('month', InvoiceDate)) AS ActiveMonths,
               CAST(date_diff('day', CAST(min(InvoiceDate) AS DATE), DATE '{{snapshot}}') AS INTEGER) AS TenureDays,
               CAST(date_diff('day', CAST(min(InvoiceDate) AS DATE), CAST(max(InvoiceDate) AS DATE)) AS INTEGER)
                   AS PurchaseSpanDays
        FROM obs{s} GROUP BY CustomerID
        """,
    )
    step(
        f"ctry{s}",
        [f"obs{s}"],
        f"""
        SELECT CustomerID, Country FROM (
            SELECT CustomerID, Country, row_number() OVER (
                       PARTITION BY CustomerID ORDER BY count(InvoiceNo) DESC, max(InvoiceDate) DESC, Country) AS place
            FROM obs{s} WHERE Country IS NOT NULL GROUP BY CustomerID, Country) AS t
        WHERE place = 1
        """,
    )
    step(
        f"lab{s}",
        [f"elig{s}", f"fut{s}"],
        f"""
        SELECT CustomerID, CASE WHEN CustomerID IN (SELECT CustomerID FROM fut{s}) THEN 0 ELSE 1 END AS Churn_90D
        FROM elig{s}
        """,
    )
    step(
        f"lf{s}",
        [f"beh{s}", f"elig{s}", f"ctry{s}", f"lab{s}"],
        f"""
        SELECT b.*, c.Country, l.Churn_90D FROM beh{s} b JOIN lab{s} l USING (CustomerID)
        LEFT JOIN ctry{s} c USING (CustomerID)
        """,
    )
    step(
        f"edge{s}",
        [f"lf{s}"],
        f"""
        SELECT count(*) AS n,
               quantile_cont(CAST(Recency AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS er,
               quantile_cont(CAST(Frequency AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS ef,
               quantile_cont(Monetary, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS em
        FROM lf{s}
        """,
    )
    step(
        f"scored{s}",
        [f"lf{s}", f"edge{s}"],
        f"""
        SELECT t.* EXCLUDE (n, er, ef, em, pr, pf, pm),
               CASE WHEN len(list_distinct(er)) = 6
                    THEN 5 - (Recency > er[2])::INT - (Recency > er[3])::INT - (Recency > er[4])::INT - (Recency > er[5])::INT
                    ELSE CAST((5 * pr + n) // (n + 1) AS INTEGER) END AS R,
               CASE WHEN len(list_distinct(ef)) = 6
                    THEN 1 + (Frequency > ef[2])::INT + (Frequency > ef[3])::INT + (Frequency > ef[4])::INT + (Frequency > ef[5])::INT
                    ELSE CAST((5 * pf + n) // (n + 1) AS INTEGER) END AS F,
               CASE WHEN len(list_distinct(em)) = 6
                    THEN 1 + (Monetary > em[2])::INT + (Monetary > em[3])::INT + (Monetary > em[4])::INT + (Monetary > em[5])::INT
                    ELSE CAST((5 * pm + n) // (n + 1) AS INTEGER) END AS M
        FROM (SELECT lf{s}.*, edge{s}.*,
                     row_number() OVER (ORDER BY Recency DESC, CustomerID) AS pr,
                     row_number() OVER (ORDER BY Frequency, CustomerID) AS pf,
                     row_number() OVER (ORDER BY Monetary, CustomerID) AS pm
              FROM lf{s}, edge{s}) AS t
        """,
    )
    step(
        f"ct{s}",
        [f"scored{s}"],
        f"""
        SELECT * EXCLUDE (R, F, M, Country, Churn_90D), Country, R, F, M, R + F + M AS RFM_Score,
               CASE WHEN R + F + M >= 13 THEN 'Very High Value' WHEN R + F + M >= 10 THEN 'High Value'
                    WHEN R + F + M >= 7 THEN 'Medium Value' ELSE 'Lower Value' END AS RFM_Segment,
               Churn_90D
        FROM scored{s}
        """,
    )

# Published standardised coefficients.
COEFFICIENTS = {
    "Recency": 0.13199,
    "Frequency": -0.774142,
    "Monetary": 0.374441,
    "AvgOrderValue": -0.002792,
    "UniqueProducts": -0.41015,
    "TotalItems": -0.768869,
    "ActiveMonths": -0.789998,
    "TenureDays": 0.122682,
    "PurchaseSpanDays": 0.006174,
}
LINEAR = " + ".join(
    f"({k}::DOUBLE) * (({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())" for c, k in COEFFICIENTS.items()
)
step("pb", ["ct"], f"SELECT *, round(1.0::DOUBLE / (1 + exp(-({LINEAR}))), 9) AS Churn_Probability_Raw FROM ct")
step(
    "rk",
    ["pb"],
    """
    SELECT *, CASE
        WHEN Risk_Tier = 'High Risk' AND RFM_Segment IN ('Very High Value', 'High Value') THEN 'Priority retention attention'
        WHEN Risk_Tier = 'High Risk' AND RFM_Segment = 'Medium Value' THEN 'Targeted attention'
        WHEN Risk_Tier = 'High Risk' AND RFM_Segment = 'Lower Value' THEN 'Lower-cost intervention'
        WHEN Risk_Tier = 'Medium Risk' AND RFM_Segment IN ('Very High Value', 'High Value') THEN 'Monitor / targeted engagement'
        WHEN Risk_Tier = 'Low Risk' AND RFM_Segment IN ('Very High Value', 'High Value') THEN 'Relationship / loyalty attention'
        ELSE 'Standard engagement' END AS Retention_Priority
    FROM (SELECT pb.*, CAST(round_even(Churn_Probability_Raw * 100, 2) AS DOUBLE) AS Churn_Probability,
                 CASE WHEN Churn_Probability_Raw >= e[2] THEN 'High Risk'
                      WHEN Churn_Probability_Raw >= e[1] THEN 'Medium Risk' ELSE 'Low Risk' END AS Risk_Tier
          FROM pb, (SELECT quantile_cont(Churn_Probability_Raw, [0.4, 0.8]) AS e FROM pb) AS q) AS t
    """,
)
step(
    "sp",
    ["rk"],
    """
    SELECT k.* EXCLUDE (key, place), place <= CASE WHEN Churn_90D = 0 THEN t0 ELSE t1 END AS is_test
    FROM (SELECT *, row_number() OVER (PARTITION BY Churn_90D ORDER BY key) AS place
          FROM (SELECT *, ('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '-42'), 1, 15))::BIGINT AS key FROM rk) AS a) AS k,
         (SELECT f0 + CASE WHEN (t * n0) % n >= (t * n1) % n THEN t - f0 - f1 ELSE 0 END AS t0,
                 f1 + CASE WHEN (t * n0) % n >= (t * n1) % n THEN 0 ELSE t - f0 - f1 END AS t1
          FROM (SELECT *, (t * n0) // n AS f0, (t * n1) // n AS f1
                FROM (SELECT count(*) AS n, count(*) FILTER (Churn_90D = 0) AS n0, count(*) FILTER (Churn_90D = 1) AS n1,
                             CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM rk) AS b) AS c) AS d
    """,
)
step("te", ["sp"], "SELECT * FROM sp WHERE is_test")
step(
    "cum",
    ["te"],
    """
    SELECT p, pos, neg, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg, sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg
    FROM (SELECT Churn_Probability_Raw AS p, count(*) FILTER (Churn_90D = 1) AS pos, count(*) FILTER (Churn_90D = 0) AS neg
          FROM te GROUP BY 1) AS t
    WINDOW w AS (ORDER BY p DESC)
    """,
)

LATE = {"snapshot": "2000-12-31", "start": "2001-01-01", "end": "2001-03-31", "span": 30}
EARLY = {"snapshot": "1996-12-31", "start": "1997-01-01", "end": "1997-03-31", "span": 30}
EVENTS = {"snapshot": "2024-01-20", "start": "2024-01-21", "end": "2024-01-30", "span": 7}


def with_steps(names, body, windows=LATE) -> str:
    ordered: list[str] = []

    def add(name):
        for need in STEPS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    once = lambda n: "MATERIALIZED " if n in ("spc", "trn") or n[0] in "be" and n[1].isdigit() else ""
    text = ",\n".join(f"{n} AS {once(n)}({STEPS[n][1].strip()})" for n in ordered)
    for key, value in windows.items():
        text = text.replace("{" + key + "}", str(value))
        body = body.replace("{" + key + "}", str(value))
    return f"WITH {text}\n{body.strip()}"


# ---------------------------------------------------------------- pieces of bodies


def even(expression: str, digits: int) -> str:
    return f"CAST(round_even({expression}, {digits}) AS DOUBLE)"


def share(part: str, whole: str, digits: int) -> str:
    return even(f"CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100", digits)


def values(pairs) -> str:
    return "(VALUES " + ", ".join(str(p) for p in pairs) + ")"


SEGMENTS = "(VALUES (1, 'Very High Value'), (2, 'High Value'), (3, 'Medium Value'), (4, 'Lower Value')) AS o(position, name)"
TIERS = "(VALUES (1, 'High Risk'), (2, 'Medium Risk'), (3, 'Low Risk')) AS o(position, name)"
QUALIFIES = "CustomerID IS NOT NULL AND NOT coalesce(InvoiceNo LIKE 'C%', false) AND Quantity > 0 AND UnitPrice > 0"

AUDIT = """
    SELECT count(*) AS raw_rows, 8::INTEGER AS raw_columns,
           count(*) FILTER (CustomerID IS NULL) AS missing_customer_id,
           count(*) FILTER (Description IS NULL) AS missing_description,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx) AS t) AS exact_duplicates,
           count(*) FILTER (InvoiceNo LIKE 'C%') AS cancellation_rows,
           count(*) FILTER (Quantity < 0) AS negative_quantity_rows,
           count(*) FILTER (Quantity = 0) AS zero_quantity_rows,
           count(*) FILTER (Quantity <= 0) AS non_positive_quantity_rows,
           count(*) FILTER (UnitPrice < 0) AS negative_unit_price_rows,
           count(*) FILTER (UnitPrice = 0) AS zero_unit_price_rows,
           count(*) FILTER (UnitPrice <= 0) AS non_positive_unit_price_rows,
           count(*) FILTER (InvoiceDate IS NULL) AS date_parse_failures,
           CAST(CAST(min(InvoiceDate) AS DATE) AS VARCHAR) AS date_min,
           CAST(CAST(max(InvoiceDate) AS DATE) AS VARCHAR) AS date_max,
           count(DISTINCT InvoiceNo) AS unique_invoices, count(DISTINCT StockCode) AS unique_products,
           count(DISTINCT CustomerID) AS unique_customers, count(DISTINCT Country) AS country_count
    FROM tx
"""


def describe(columns, source) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75,
        round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {source}"""
        for c in columns
    )


def group_rates(group: str, source: str, order: list[str]) -> str:
    places = values([(i + 1, n) for i, n in enumerate(order)])
    return f"""
    SELECT "{group}", n, churned, CAST(churned AS DOUBLE) / n AS churn_rate, position
    FROM (SELECT grp AS "{group}", count(Churn_90D) AS n, CAST(sum(Churn_90D) AS BIGINT) AS churned
          FROM ({source}) AS s WHERE grp IS NOT NULL GROUP BY grp) AS t
    JOIN {places} AS o(position, name) ON "{group}" = name
    """


def band_rates(name: str, source: str, bands: str) -> str:
    """`bands` gives (position, label, above, up to), the first band closed below."""
    return f"""
    SELECT CAST(position AS INTEGER) AS position, label AS "{name}", CAST(sum(Churn_90D) AS BIGINT) AS churned,
           count(*) AS total, {share("sum(Churn_90D)", "count(*)", 1)} AS inactive_rate_pct
    FROM {bands} JOIN {source} ON v > above AND v <= upto GROUP BY 1, 2
    """


RECENCY_BANDS = """
    (SELECT row_number() OVER (ORDER BY b) AS position, CASE WHEN a = 0 THEN -1 ELSE a END AS above, b AS upto,
            CASE WHEN a = 0 AND b = 30 THEN '0–30' WHEN a = 30 AND b = 90 THEN '31–90' WHEN a = 90 AND b = 180 THEN '91–180'
                 WHEN a = 180 AND b = 270 THEN '181–270' WHEN a = 270 AND b = 365 THEN '271–365'
                 WHEN a = 365 AND b = top THEN '>365' ELSE CAST(a + 1 AS VARCHAR) || '–' || CAST(b AS VARCHAR) END AS label
     FROM (SELECT e AS b, lag(e) OVER (ORDER BY e) AS a, top
           FROM (SELECT DISTINCT unnest(list_concat([0, 30, 90, 180, top], list_filter([270, 365], lambda x: top > x))) AS e, top
                 FROM (SELECT max(Recency) + 1 AS top FROM ct) AS m) AS d) AS f
     WHERE a IS NOT NULL) AS bands
"""
FREQUENCY_BANDS = """
    (VALUES (1, '2–3', 0, 3), (2, '4–6', 3, 6), (3, '7–10', 6, 10), (4, '11–20', 10, 20), (5, '>20', 20, 9999999999))
    AS bands(position, label, above, upto)
"""
RECENCY_RATES = band_rates("RecencyBand", "(SELECT *, Recency AS v FROM ct) AS x", RECENCY_BANDS)
FREQUENCY_RATES = band_rates("FreqGroup", "(SELECT *, Frequency AS v FROM ct) AS x", FREQUENCY_BANDS)
DASHBOARD_RECENCY = """
    SELECT *, CASE WHEN Recency <= 0 OR Recency > 9999 THEN NULL WHEN Recency <= 30 THEN '≤30d' WHEN Recency <= 60 THEN '31–60d'
                   WHEN Recency <= 90 THEN '61–90d' WHEN Recency <= 120 THEN '91–120d' WHEN Recency <= 180 THEN '121–180d'
                   ELSE '>180d' END AS grp FROM ct
"""
FREQUENCY_GROUP = """
    SELECT * EXCLUDE (place, n), CASE greatest(1, CAST(ceil(4.0 * (place - 1) / nullif(n - 1, 0)) AS INTEGER))
        WHEN 1 THEN 'Q1 (Lowest)' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' ELSE 'Q4 (Highest)' END AS grp
    FROM (SELECT *, row_number() OVER (ORDER BY Frequency, CustomerID) AS place, count(*) OVER () AS n FROM ct) AS t
"""
VALUE_GROUP = """
    SELECT ct.*, CASE WHEN Monetary <= e[1] THEN 'Bottom 25%' WHEN Monetary <= e[2] THEN '25–50%'
                      WHEN Monetary <= e[3] THEN '50–75%' ELSE 'Top 25%' END AS grp
    FROM ct, (SELECT quantile_cont(Monetary, [0.25, 0.5, 0.75]) AS e FROM ct) AS q
"""
SEGMENT_REVENUE = f"""
    SELECT position, name AS RFM_Segment, customers, round(total, 4) AS total_revenue,
           round(total / nullif(customers, 0), 4) AS avg_revenue,
           {share("total", "sum(total) OVER ()", 1)} AS revenue_share_pct
    FROM (SELECT position, name, count(CustomerID) AS customers,
                 CAST(sum(CAST(Monetary AS DECIMAL(20, 4))) AS DOUBLE) AS total
          FROM {SEGMENTS} LEFT JOIN ct ON RFM_Segment = name GROUP BY 1, 2) AS t
"""


def counts(source: str, column: str, order: str, keep_empty: bool) -> str:
    tail = "" if keep_empty else "WHERE customers > 0"
    return f"""
    SELECT position, name AS "{column}", customers, {share("customers", "sum(customers) OVER ()", 1)} AS share_pct
    FROM (SELECT position, name, count(CustomerID) AS customers FROM {order} LEFT JOIN {source} ON "{column}" = name
          GROUP BY 1, 2) AS t {tail}
    """


def histogram(source: str, column: str, bins: int, cap=None, group: str | None = None) -> str:
    value = f"CAST({column} AS DOUBLE)" if cap is None else f"least(CAST({column} AS DOUBLE), {cap}.0::DOUBLE)"
    inner = f"""(SELECT *, least(CAST(floor((v - lo) * {bins} / (hi - lo)) AS INTEGER), {bins - 1}) AS bin
                 FROM (SELECT *, {value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi FROM {source}) AS a)"""
    bounds = f"""round(lo + bin * ((hi - lo) / {bins}), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS upper"""
    if group:
        return f"SELECT {group}, bin, count(*) AS customers, {bounds} FROM {inner} AS b GROUP BY {group}, bin, lo, hi"
    return f"""
    SELECT CAST(bin AS INTEGER) AS bin, count(v) AS customers, {bounds}
    FROM (SELECT g.bin, s.lo, s.hi, b.v
          FROM (SELECT unnest(range({bins})) AS bin) AS g
          JOIN (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) AS s ON true
          LEFT JOIN {inner} AS b ON b.bin = g.bin) AS t
    GROUP BY bin, lo, hi
    """


def box() -> str:
    parts = []
    for column, cap in (("Recency", 400), ("Frequency", 60), ("Monetary", 10000)):
        parts.append(
            f"""SELECT '{column}' AS "column", Churn_90D, count(*) AS customers,
            round(min(v) FILTER (v >= q[1] - 1.5 * (q[3] - q[1])), 4) AS whisker_low,
            round(q[1], 4) AS q1, round(q[2], 4) AS median, round(q[3], 4) AS q3,
            round(max(v) FILTER (v <= q[3] + 1.5 * (q[3] - q[1])), 4) AS whisker_high
            FROM (SELECT a.*, b.q FROM (SELECT Churn_90D, least(CAST({column} AS DOUBLE), {cap}) AS v FROM ct) AS a
                  JOIN (SELECT Churn_90D, quantile_cont(least(CAST({column} AS DOUBLE), {cap}), [0.25, 0.5, 0.75]) AS q
                        FROM ct GROUP BY 1) AS b USING (Churn_90D)) AS t
            GROUP BY Churn_90D, q"""
        )
    return " UNION ALL ".join(parts)


SUMMARY_COLUMNS = [
    "Recency",
    "Frequency",
    "Monetary",
    "AvgOrderValue",
    "TenureDays",
    "PurchaseSpanDays",
    "ActiveMonths",
    "UniqueProducts",
    "TotalItems",
    "RFM_Score",
]


def summary() -> str:
    parts = [
        "SELECT 'observation_transaction_rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM obs",
        "SELECT 'future_transaction_rows', CAST(count(*) AS DOUBLE) FROM fut",
        "SELECT 'eligible_customers', CAST(count(*) AS DOUBLE) FROM ct",
        "SELECT 'class_0_count', CAST(count(*) FILTER (Churn_90D = 0) AS DOUBLE) FROM ct",
        "SELECT 'class_1_count', CAST(count(*) FILTER (Churn_90D = 1) AS DOUBLE) FROM ct",
        f"SELECT 'class_0_pct', {share('count(*) FILTER (Churn_90D = 0)', 'count(*)', 4)} FROM ct",
        f"SELECT 'class_1_pct', {share('count(*) FILTER (Churn_90D = 1)', 'count(*)', 4)} FROM ct",
        "SELECT 'score ' || CAST(RFM_Score AS VARCHAR), CAST(count(*) AS DOUBLE) FROM ct GROUP BY RFM_Score",
        "SELECT 'segment ' || RFM_Segment, CAST(count(*) AS DOUBLE) FROM ct GROUP BY RFM_Segment",
    ]
    for c in SUMMARY_COLUMNS:
        for name, f in (("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg({c})"), ("median", f"median({c})")):
            parts.append(f"SELECT '{c}_{name}', {even(f'CAST({f} AS DOUBLE)', 4)} FROM ct")
    return " UNION ALL ".join(parts)


def text_percent(expression: str) -> str:
    return f"printf('%.1f%%', {expression})"


def text_pounds(expression: str, digits: int = 0) -> str:
    return f"'£' || format('{{:,.{digits}f}}', {expression})"


DIRECTORY = f"""
    CustomerID, Country, Recency, Frequency, {text_pounds("Monetary")} AS Monetary,
    {text_pounds("AvgOrderValue", 2)} AS AvgOrderValue, UniqueProducts, TotalItems, ActiveMonths, TenureDays,
    PurchaseSpanDays, RFM_Score, RFM_Segment, {text_percent("Churn_Probability")} AS Churn_Probability, Risk_Tier,
    Retention_Priority
"""
THRESHOLDS = "(SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]::DOUBLE[]) AS threshold) AS th"


def zero(expression: str) -> str:
    return f"coalesce({expression}, 0.0::DOUBLE)"


METRICS = f"""
    SELECT round(CAST(tp + tneg - fp AS DOUBLE) / (tpos + tneg), 6) AS accuracy,
           round({zero("CAST(tp AS DOUBLE) / nullif(tp + fp, 0)")}, 6) AS "precision",
           round({zero("CAST(tp AS DOUBLE) / nullif(tpos, 0)")}, 6) AS recall,
           round({zero("2.0::DOUBLE * tp / nullif(tp + fp + tpos, 0)")}, 6) AS f1,
           round(won / (CAST(tpos AS DOUBLE) * tneg), 6) AS roc_auc, round(ap / tpos, 6) AS pr_auc
    FROM (SELECT max(tpos) AS tpos, max(tneg) AS tneg, coalesce(sum(pos) FILTER (p > 0.5), 0) AS tp,
                 coalesce(sum(neg) FILTER (p > 0.5), 0) AS fp, sum(neg * (cpos - pos / 2.0::DOUBLE)) AS won,
                 sum(pos * (CAST(cpos AS DOUBLE) / (cpos + cneg))) AS ap FROM cum) AS t
"""
