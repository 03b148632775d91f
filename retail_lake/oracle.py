"""DuckDB SQL giving the expected result of each registered query."""

from retail_lake.schema import ANOMALY_FEATURES, CATEGORIES, NUMERIC_COLUMNS, RAW_COLUMNS

Z_LIMIT = "2.0"


def rx(expr: str, name: str, digits: int | None = None) -> str:
    """A double to six decimals; ``digits`` first rounds as the operator itself does."""
    value = f"CAST({expr} AS DOUBLE)"
    if digits is not None:
        value = f"round({value}, {digits})"
    return f"floor({value} * 1e6 + 0.5) / 1e6 AS {name}"


def r(*names: str) -> str:
    return ", ".join(rx(n, n) for n in names)


def whole(column: str) -> str:
    exact = f'TRY_CAST("{column}" AS DECIMAL(38, 6))'
    return f"CASE WHEN {exact} % 1 = 0 THEN CAST({exact} AS INTEGER) END"


def no_number(column: str) -> str:
    return f"({whole(column)}) IS NULL" if column in ("Age", "Quantity") else f'TRY_CAST("{column}" AS DOUBLE) IS NULL'


def day(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr}"


CATEGORY = """CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Beauty'
             WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'Clothing' ELSE 'Electronics' END"""

SALES = """sales AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

TX = f"""{SALES}, tx AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id,
         CAST(o_orderdate AS DATE) AS date,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE WHEN o_custkey % 20 = 0 THEN 'Unknown' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CAST(18 + o_custkey % 47 AS INTEGER) AS age,
         {CATEGORY} AS product_category,
         CAST(l_quantity AS INTEGER) AS quantity,
         floor(l_extendedprice * 100 / l_quantity) / 100 AS price_per_unit,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS total_amount
  FROM sales)"""

RAW = f"""{SALES}, raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS "Transaction ID",
         CASE WHEN l_orderkey % 97 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
              WHEN l_orderkey % 89 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "Date",
         CAST(o_custkey AS VARCHAR) AS "Customer ID",
         CASE WHEN o_custkey % 20 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Female'
              WHEN o_custkey % 3 = 0 THEN 'n/a' ELSE 'Male' END AS "Gender",
         CASE WHEN l_orderkey % 83 = 1 THEN 'abc' WHEN l_orderkey % 79 = 1 THEN '0'
              WHEN l_orderkey % 71 = 1 THEN '30.0'
              WHEN l_orderkey % 73 <> 1 THEN CAST(18 + o_custkey % 47 AS VARCHAR) END AS "Age",
         CASE WHEN l_partkey % 71 = 1 THEN 'Furniture' WHEN l_partkey % 67 <> 1 THEN {CATEGORY} END AS "Product Category",
         CASE WHEN l_orderkey % 61 = 1 THEN '0' WHEN l_orderkey % 59 = 1 THEN '-2'
              WHEN l_orderkey % 43 = 1 THEN '2.5'
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS "Quantity",
         floor(l_extendedprice * 100 / l_quantity) / 100 AS "Price per Unit",
         CASE WHEN l_orderkey % 53 = 1 THEN '-5'
              WHEN l_orderkey % 47 <> 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) END AS "Total Amount"
  FROM sales)"""

TYPED = f"""{RAW}, typed AS (
  SELECT "Transaction ID" AS transaction_id,
         CAST(try_strptime("Date", '%Y-%m-%d') AS DATE) AS date,
         "Customer ID" AS customer_id, "Gender" AS gender,
         {whole('Age')} AS age, "Product Category" AS product_category,
         {whole('Quantity')} AS quantity, "Price per Unit" AS price_per_unit,
         TRY_CAST("Total Amount" AS DECIMAL(18, 2)) AS total_amount
  FROM raw)"""


def calendar(source: str) -> str:
    return f"""SELECT *, year(date) AS year, month(date) AS month, day(date) AS day,
         dayofweek(date) + 1 AS day_of_week, weekofyear(date) AS week_of_year, quarter(date) AS quarter,
         CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) >= 25 AS INTEGER) AS is_month_end,
         quantity * price_per_unit AS total_amount_calc
  FROM {source}"""


SILVER = f"""{TYPED}, clean AS (
  SELECT transaction_id, date, customer_id,
         CASE gender WHEN 'Female' THEN 'F' WHEN 'Male' THEN 'M' ELSE 'Unknown' END AS gender,
         age, product_category, quantity, price_per_unit, total_amount,
         CASE product_category WHEN 'Beauty' THEN 0 WHEN 'Clothing' THEN 1 WHEN 'Electronics' THEN 2 ELSE -1 END AS category_code
  FROM typed
  WHERE date IS NOT NULL AND product_category IS NOT NULL AND total_amount > 0 AND quantity > 0 AND age > 0),
silver AS ({calendar('clean')})"""

CLEAN_SILVER = f"""{TX}, silver AS ({calendar('tx')})"""

GOLD_DAILY = """gold_daily AS (
  SELECT date, product_category, year, month, day_of_week, quarter, is_weekend,
         CAST(sum(total_amount) AS DOUBLE) AS daily_revenue,
         CAST(sum(quantity) AS BIGINT) AS daily_quantity, count(transaction_id) AS transaction_count,
         avg(price_per_unit) AS avg_price, avg(age) AS avg_customer_age,
         avg(CASE WHEN gender = 'F' THEN 1.0 ELSE 0.0 END) AS female_ratio
  FROM silver GROUP BY ALL)"""

GOLD_MONTHLY = """monthly AS (
  SELECT year, month, product_category,
         CAST(sum(total_amount) AS DOUBLE) AS monthly_revenue, CAST(sum(quantity) AS BIGINT) AS monthly_quantity,
         count(transaction_id) AS monthly_transactions,
         CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_transaction_value,
         count(DISTINCT customer_id) AS unique_customers,
         year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month
  FROM silver GROUP BY year, month, product_category)"""

AGE_GROUP = """CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
            WHEN age < 55 THEN '45-54' ELSE '55+' END"""

GOLD_SEGMENTS = f"""segments AS (
  SELECT product_category, gender, {AGE_GROUP} AS age_group, count(transaction_id) AS transaction_count,
         CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
         CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_spend, avg(quantity) AS avg_quantity
  FROM silver GROUP BY ALL)"""

DAILY = f"""{TX}, daily AS (
  SELECT date, product_category, CAST(sum(total_amount) AS DOUBLE) AS daily_revenue,
         CAST(sum(quantity) AS BIGINT) AS daily_quantity, count(transaction_id) AS transaction_count,
         avg(price_per_unit) AS avg_price, avg(age) AS avg_age,
         avg(CASE WHEN gender = 'F' THEN 1.0 ELSE 0.0 END) AS female_ratio
  FROM tx GROUP BY date, product_category)"""

MEASURES = ["daily_revenue", "daily_quantity", "transaction_count", "avg_price", "avg_age", "female_ratio"]

GRID = f"""{DAILY}, days AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT min(date) AS lo, max(date) AS hi FROM daily)),
cells AS (SELECT date, product_category FROM days, (SELECT unnest({CATEGORIES!r}) AS product_category)),
grid AS (
  SELECT c.date, c.product_category,
         {', '.join(f'CASE WHEN d.date IS NULL THEN 0 ELSE d.{m} END AS {m}' for m in MEASURES)}
  FROM cells c LEFT JOIN daily d ON c.date = d.date AND c.product_category = d.product_category)"""


def frame(n: int) -> str:
    return f"(PARTITION BY product_category ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


ROLLING = ["rolling_mean_7", "rolling_mean_14", "rolling_std_7", "rolling_std_14", "rolling_max_7", "rolling_min_7"]
LAGS = ["lag_1", "lag_7", "lag_14"]

ROLLED = f"""{GRID}, rolled AS (
  SELECT *,
         {', '.join(f'lag(daily_revenue, {n}) OVER (PARTITION BY product_category ORDER BY date) AS lag_{n}' for n in (1, 7, 14))},
         {', '.join(f'avg(daily_revenue) OVER {frame(n)} AS rolling_mean_{n}' for n in (7, 14))},
         {', '.join(f'coalesce(stddev_samp(daily_revenue) OVER {frame(n)}, 0) AS rolling_std_{n}' for n in (7, 14))},
         max(daily_revenue) OVER {frame(7)} AS rolling_max_7, min(daily_revenue) OVER {frame(7)} AS rolling_min_7
  FROM grid)"""

CALENDAR = ["Year", "Month", "Day", "DayOfWeek", "WeekOfYear", "DayOfYear", "Quarter", "IsWeekend", "IsMonthStart", "IsMonthEnd"]


def feature_calendar(d: str = "date") -> str:
    return f"""year({d}) AS "Year", month({d}) AS "Month", day({d}) AS "Day", isodow({d}) - 1 AS "DayOfWeek",
         weekofyear({d}) AS "WeekOfYear", dayofyear({d}) AS "DayOfYear", quarter({d}) AS "Quarter",
         CAST(isodow({d}) >= 6 AS INTEGER) AS "IsWeekend", CAST(day({d}) <= 5 AS INTEGER) AS "IsMonthStart",
         CAST(day({d}) >= 25 AS INTEGER) AS "IsMonthEnd\""""


ENCODED = """CASE product_category WHEN 'Clothing' THEN 1 WHEN 'Electronics' THEN 2 ELSE 0 END AS category_encoded,
         CAST(product_category = 'Beauty' AS INTEGER) AS is_beauty,
         CAST(product_category = 'Clothing' AS INTEGER) AS is_clothing,
         CAST(product_category = 'Electronics' AS INTEGER) AS is_electronics"""

SERIES = f"""{ROLLED}, stats AS (
  SELECT product_category AS cat, avg(daily_revenue) AS m, stddev_samp(daily_revenue) AS s FROM grid GROUP BY 1),
series AS (
  SELECT rolled.*, {feature_calendar()}, {ENCODED},
         (daily_revenue - m) / coalesce(nullif(s, 0), 1) AS revenue_z_score,
         (daily_revenue - rolling_mean_7) / coalesce(nullif(rolling_mean_7, 0), 1) AS pct_from_rolling_mean
  FROM rolled JOIN stats ON product_category = cat)"""

FEAT = f"""{SERIES}, feat AS (SELECT * FROM series WHERE lag_14 IS NOT NULL)"""


def flagged(limit: str = Z_LIMIT) -> str:
    return f"""{FEAT}, scored AS (
  SELECT *, CAST(revenue_z_score > {limit} AS INTEGER) AS anomaly_flag,
         least(abs(revenue_z_score) / 4, 1.0) AS anomaly_score FROM feat)"""


RISK = "CASE WHEN anomaly_score >= 0.65 THEN 'HIGH' WHEN anomaly_score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END"

WEEK = f"""{flagged()}, week AS (
  SELECT date + 7 AS date, product_category, daily_revenue AS predicted_revenue, anomaly_flag
  FROM scored WHERE date > (SELECT max(date) FROM scored) - 7)"""

SUM_RAW = """SELECT "Product Category" AS product_category, count(*) AS rows, count("Transaction ID") AS ids,
       count(try_strptime("Date", '%Y-%m-%d')) AS dates,
       CAST(sum(TRY_CAST("Total Amount" AS DECIMAL(18, 2))) AS DOUBLE) AS amount
FROM raw GROUP BY 1"""

LIBRARY = """library AS (
  SELECT d.doc_id, source AS title, text AS content, CASE WHEN source = 'src0' THEN 'All' ELSE lang END AS category,
         coalesce(quality, 0) * 0.5 AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

MESSAGE_TERMS = """SELECT conv_id || ':' || turn AS query_id, CAST(NULL AS VARCHAR) AS wanted,
  unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM conversations"""

CHUNKS = """chunks AS (
  SELECT doc_id, source, lang, CAST(n AS INTEGER) AS chunk_id, substring(text, CAST(n * 450 + 1 AS INTEGER), 500) AS chunk_text
  FROM (SELECT doc_id, source, lang, text, unnest(generate_series(0, (length(text) - 1) // 450)) AS n
        FROM documents WHERE length(text) > 0))"""


def _searches() -> str:
    # Imported here: the SQL side needs the request texts only.
    from retail_lake.catalog import SEARCHES

    rows = [f"('{q.query_id}', '{q.text}', {'NULL' if q.category is None else repr(q.category)})" for q in SEARCHES]
    return f"searches(query_id, words, wanted) AS (VALUES {', '.join(rows)})"


def _keyword(source: str, ids: str, title: str, content: str, category: str, prior: str, k: int) -> str:
    hits = f"""list_sum(list_transform(string_split(words, ' '),
              lambda w: CAST(contains(lower({content}), w) OR contains(lower({title}), w) AS INTEGER)))"""
    return f"""{_searches()}, matched AS (
  SELECT query_id, {ids}, {hits} + {prior} AS relevance_score
  FROM {source}, searches WHERE wanted IS NULL OR {category} IN (wanted, 'All')),
found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, {ids}) AS rank FROM matched)
  WHERE rank <= {k})"""


def _bm25(k: int, terms: str = "SELECT query_id, wanted, unnest(string_split(words, ' ')) AS term FROM searches") -> str:
    return f"""{LIBRARY}, {_searches()}, parsed AS (
  SELECT doc_id, category, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM library),
sized AS (SELECT *, len(ws) AS n FROM parsed),
corpus AS (SELECT count(*) AS docs, avg(n) AS mean_n FROM sized),
terms AS ({terms}),
tf AS (SELECT doc_id, category, n, term, count(*) AS tf
       FROM (SELECT doc_id, category, n, unnest(ws) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
  SELECT query_id, doc_id, round(sum(
           ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_n))), 6) AS relevance_score
  FROM terms JOIN tf USING (term) JOIN df USING (term), corpus
  WHERE wanted IS NULL OR category = wanted GROUP BY query_id, doc_id),
found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, doc_id) AS rank FROM scores)
  WHERE rank <= {k})"""


def _votes(phrases: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{p}') AS INTEGER)" for p in phrases)


def _routes(routes: dict[str, list[str]], default: str) -> tuple[str, str]:
    scores = ", ".join(f"{_votes(phrases)} AS {name}_score" for name, phrases in routes.items())
    best = f"greatest({', '.join(f'{name}_score' for name in routes)})"
    cases = " ".join(f"WHEN {name}_score = {best} THEN '{name}'" for name in routes)
    return scores, f"CASE WHEN {best} = 0 THEN '{default}' {cases} END AS agent"


def _null_rows(counts: dict[str, str], value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) FILTER ({test}) AS {value} FROM raw" for name, test in counts.items()
    )


def _upload_findings() -> str:
    tests = {"unparsable date": '"Date" IS NOT NULL AND try_strptime("Date", \'%Y-%m-%d\') IS NULL'}
    tests |= {f"non-numeric in {c}": f'"{c}" IS NOT NULL AND {no_number(c)}' for c in NUMERIC_COLUMNS}
    known = ", ".join(f"'{c}'" for c in CATEGORIES)
    tests["unknown category"] = f'"Product Category" NOT IN ({known})'
    tests |= {f"null in {c}": f'"{c}" IS NULL' for c in RAW_COLUMNS}
    parts = [f"SELECT '{name}' AS finding, count(*) AS rows FROM raw WHERE {test} HAVING count(*) > 0" for name, test in tests.items()]
    return f"WITH {RAW} " + " UNION ALL ".join(parts)


def _report() -> str:
    checks = [("error", "unparsable date", "Date", """"Date" IS NOT NULL AND try_strptime("Date", '%Y-%m-%d') IS NULL""")]
    checks += [("warning", "non-numeric", c, no_number(c)) for c in NUMERIC_COLUMNS]
    known = ", ".join(f"'{c}'" for c in CATEGORIES)
    checks += [("warning", "unknown category", "Product Category", f'coalesce("Product Category" NOT IN ({known}), true)')]
    checks += [("warning", "null", c, f'"{c}" IS NULL') for c in RAW_COLUMNS]
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS severity, '{k}' AS check_name, '{c}' AS column_name, count(*) FILTER ({t}) AS n FROM raw"
        for s, k, c, t in checks
    )
    return f"WITH {RAW} SELECT * FROM ({rows}) WHERE n > 0"


def _metrics(source: str) -> str:
    return f"""SELECT split, CASE WHEN grouping(product_category) = 1 THEN '(all)' ELSE product_category END AS product_category,
       count(*) AS rows, {rx('avg(abs(daily_revenue - p))', 'mae')}, {rx('sqrt(avg((daily_revenue - p) * (daily_revenue - p)))', 'rmse')},
       {rx('avg(CASE WHEN daily_revenue > 0 THEN abs((daily_revenue - p) / daily_revenue) END) * 100', 'mape')}
FROM {source} GROUP BY GROUPING SETS ((split), (split, product_category))"""


SPLIT = f"""{FEAT}, split AS (
  SELECT *, CASE WHEN date > (SELECT max(date) FROM feat) - 28 THEN 'validation' ELSE 'train' END AS split FROM feat)"""

LATEST = f"""{FEAT}, tail AS (
  SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY date DESC) AS rn FROM feat),
latest AS (
  SELECT product_category, max(date) AS last_date,
         max(daily_revenue) FILTER (rn = 1) AS lag_1,
         coalesce(max(daily_revenue) FILTER (rn = 7), max(daily_revenue) FILTER (rn = 1)) AS lag_7,
         coalesce(max(daily_revenue) FILTER (rn = 14), max(daily_revenue) FILTER (rn = 1)) AS lag_14,
         {', '.join(f'max({c}) FILTER (rn = 1) AS {c}' for c in [*ROLLING, 'avg_age', 'female_ratio', 'transaction_count', 'avg_price', 'daily_quantity'])}
  FROM tail GROUP BY product_category)"""


def _describe() -> str:
    stats = {
        "count": "count(daily_revenue)", "mean": "avg(daily_revenue)", "std": "stddev_samp(daily_revenue)",
        "min": "min(daily_revenue)", "25%": "quantile_cont(daily_revenue, 0.25)", "50%": "quantile_cont(daily_revenue, 0.5)",
        "75%": "quantile_cont(daily_revenue, 0.75)", "max": "max(daily_revenue)",
    }
    return f"WITH {FEAT} " + " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, {rx(expr, 'value')} FROM feat" for name, expr in stats.items()
    )


def _percentiles(source: str, column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {p} AS percentile, {rx(f'quantile_cont({column}, {p / 100})', 'value')} FROM {source}"
        for p in (50, 75, 90, 95, 99)
    )


def _expectations() -> str:
    checks = [
        ("rows", "count(*) >= 300", "count(*)"),
        ("categories", "count(DISTINCT product_category) = 3", "count(DISTINCT product_category)"),
        ("null revenue", "count(*) FILTER (daily_revenue IS NULL) = 0", "count(*) FILTER (daily_revenue IS NULL)"),
        ("negative revenue", "count(*) FILTER (daily_revenue < 0) = 0", "count(*) FILTER (daily_revenue < 0)"),
        *[(f"null {c}", f"count(*) FILTER ({c} IS NULL) = 0", f"count(*) FILTER ({c} IS NULL)") for c in LAGS],
        ("flagged percent", "100.0 * sum(anomaly_flag) / count(*) BETWEEN 1 AND 15", "100.0 * sum(anomaly_flag) / count(*)"),
        ("missing model inputs", "count(*) >= 0", "count(*) * 0"),
    ]
    return f"WITH {flagged()} " + " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST({test} AS INTEGER) AS passed, {rx(value, 'observed')} FROM scored"
        for name, test, value in checks
    )


def _context() -> str:
    score = "CAST(CAST(anomaly_score AS DECIMAL(18, 4)) AS VARCHAR)"
    money = lambda c: f"CAST(CAST({c} AS DECIMAL(18, 2)) AS VARCHAR)"
    year = "date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
    sums = " || ' ' || ".join(money(f"round({f}(daily_revenue), 2)") for f in ("sum", "avg", "max", "min"))
    months = " || ' ' || ".join(money(f"round(coalesce(sum(daily_revenue) FILTER (product_category = '{c}'), 0), 2)") for c in CATEGORIES)
    return f"""WITH {flagged()}, top AS (
  SELECT *, row_number() OVER (ORDER BY revenue_z_score DESC, date, product_category) AS place
  FROM scored WHERE anomaly_flag = 1 ORDER BY revenue_z_score DESC, date, product_category LIMIT 10)
SELECT 1 AS section_no, 'SALES SUMMARY (1997)' AS section, product_category AS line_key, product_category || ' ' || {sums} AS line
FROM scored WHERE {year} GROUP BY product_category
UNION ALL SELECT 2, 'MONTHLY REVENUE BY CATEGORY', lpad(CAST(month(date) AS VARCHAR), 2, '0'), monthname(date) || ' ' || {months}
FROM scored WHERE {year} GROUP BY month(date), monthname(date)
UNION ALL SELECT 3, 'TOP 10 ANOMALOUS DAYS', lpad(CAST(place AS VARCHAR), 2, '0'),
       strftime(date, '%Y-%m-%d') || ' ' || product_category || ' ' || {money('daily_revenue')} || ' ' || {money('revenue_z_score')} || ' ' || {score} FROM top
UNION ALL SELECT 4, 'ANOMALY COUNT BY CATEGORY', product_category, product_category || ' ' || CAST(count(*) AS VARCHAR)
FROM scored WHERE anomaly_flag = 1 GROUP BY product_category"""


def _standardised() -> str:
    columns = ", ".join(
        rx(f'(f."{c}" - (SELECT avg("{c}") FROM feat)) / (SELECT coalesce(nullif(stddev_pop("{c}"), 0), 1) FROM feat)', f'"{c}"')
        for c in ANOMALY_FEATURES
    )
    return f"WITH {FEAT} SELECT {day('date')}, product_category, {columns} FROM feat f"


def _feature_columns() -> str:
    return f"""{r('daily_revenue')}, daily_quantity, transaction_count, {r('avg_price', 'avg_age', 'female_ratio')},
       {', '.join(f'"{c}"' for c in CALENDAR)}, {r(*LAGS, *ROLLING)},
       category_encoded, is_beauty, is_clothing, is_electronics, {r('revenue_z_score', 'pct_from_rolling_mean')}"""


def statements() -> dict[str, str]:
    from retail_lake.catalog import SAMPLE_ROUTES
    from retail_lake.operators.routing import DEFAULT_ROUTE, ROUTES

    sample_scores, sample_agent = _routes(SAMPLE_ROUTES, DEFAULT_ROUTE)
    scores, agent = _routes(ROUTES, DEFAULT_ROUTE)
    growth = f"""WITH {SILVER}, {GOLD_MONTHLY}, m AS (
  SELECT year_month, CASE WHEN grouping(product_category) = 1 THEN '(all)' ELSE product_category END AS product_category,
         sum(monthly_revenue) AS monthly_revenue
  FROM monthly GROUP BY GROUPING SETS ((year_month), (year_month, product_category))),
p AS (SELECT m.*, e.monthly_revenue AS previous_revenue FROM m LEFT JOIN m e ON e.product_category = m.product_category
  AND strptime(e.year_month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH = strptime(m.year_month || '-01', '%Y-%m-%d'))
SELECT year_month, product_category, {rx('monthly_revenue', 'monthly_revenue', 2)}, {rx('previous_revenue', 'previous_revenue', 2)},
       {rx('coalesce((monthly_revenue - previous_revenue) / nullif(previous_revenue, 0), 0) * 100', 'growth_percent')} FROM p"""
    totals = """SELECT CASE WHEN grouping(product_category) = 1 THEN '(all)' ELSE product_category END AS product_category,
       {sums}, count(*) AS days FROM gold_daily {where} GROUP BY GROUPING SETS ((), (product_category))"""
    total_columns = f"{rx('sum(daily_revenue)', 'total_revenue', 2)}, {rx('avg(daily_revenue)', 'avg_daily_revenue')}"
    breakdown = """SELECT 'category' AS dimension, product_category AS member, count(*) AS anomalies FROM scored WHERE anomaly_flag = 1 GROUP BY 2
UNION ALL SELECT 'month', CAST("Month" AS VARCHAR), count(*) FROM scored WHERE anomaly_flag = 1 GROUP BY 2
UNION ALL SELECT 'weekend', CASE WHEN "IsWeekend" = 1 THEN 'Weekend' ELSE 'Weekday' END, count(*) FROM scored WHERE anomaly_flag = 1 GROUP BY 2"""
    pivot = ", ".join(rx(f"coalesce(sum(daily_revenue) FILTER (product_category = '{c}'), 0)", c, 2) for c in CATEGORIES)
    year = "WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
    known = ", ".join(f"'{c}'" for c in CATEGORIES)
    hot = [f"coalesce(CAST(product_category = '{c}' AS INTEGER), 0) AS is_{c.lower()}" for c in CATEGORIES]
    sets = "GROUPING SETS ((age_group), (product_category, age_group), (product_category, gender))"
    cut_keys = ", ".join(f"CASE WHEN grouping({k}) = 1 THEN '(all)' ELSE {k} END AS {k}" for k in ("product_category", "gender", "age_group"))
    return {
        # Sources and sinks
        "scan_csv_schema": f"WITH {RAW} {SUM_RAW}",
        "header_normalise": f"WITH {RAW} {SUM_RAW}",
        "ingest_files": f"WITH {RAW} {SUM_RAW}",
        "bronze_copy": f"WITH {RAW} {SUM_RAW}",
        "scan_csv_infer": f"""WITH {CLEAN_SILVER}, {GOLD_DAILY}
SELECT product_category, year, count(date) AS days, CAST(sum(daily_quantity) AS BIGINT) AS quantity,
       {rx('sum(daily_revenue)', 'revenue', 2)} FROM gold_daily GROUP BY ALL""",
        "scan_table": f"""WITH {TX} SELECT gender, age, count(*) AS rows, CAST(sum(total_amount) AS DOUBLE) AS amount
FROM tx GROUP BY gender, age""",
        "sink_table": f"""WITH {SILVER} SELECT product_category, year, 'run-1' AS pipeline_run_id, '2024-01-31' AS run_date,
       count(*) AS rows, CAST(sum(total_amount) AS DOUBLE) AS amount FROM silver GROUP BY product_category, year""",
        "sink_csv": f"""WITH {FEAT} SELECT product_category, count(*) AS rows, {rx('sum(daily_revenue)', 'revenue', 2)},
       {rx('sum(lag_14)', 'lag_14', 2)}, CAST(sum("IsWeekend") AS BIGINT) AS weekend_days FROM feat GROUP BY product_category""",
        "sink_append_tx": f"""WITH {TYPED} SELECT coalesce(product_category, '') AS product_category, coalesce(gender, '') AS gender,
       count(*) AS rows, count(*) AS stamped, count(date) AS dates, CAST(sum(coalesce(age, 0)) AS BIGINT) AS ages,
       CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS quantity, {rx('sum(coalesce(total_amount, 0))', 'amount', 2)}
FROM typed GROUP BY 1, 2""",
        "sink_append_forecast": f"""WITH {WEEK} SELECT {day('date', 'forecast_date')}, product_category, 'naive_week' AS model_version,
       1 AS rows, 1 AS stamped, {r('predicted_revenue')} FROM week""",
        "sink_forecast_csv": f"WITH {WEEK} SELECT {day('date')}, product_category, {r('predicted_revenue')}, anomaly_flag FROM week",
        "sink_append_anomaly": f"""WITH {flagged()} SELECT product_category, anomaly_flag, count(*) AS rows, count(*) AS stamped,
       {rx('sum(daily_revenue)', 'revenue', 2)}, {rx('max(anomaly_score)', 'max_score')} FROM scored GROUP BY 1, 2""",
        "scan_documents": """SELECT source AS source_name, CAST(sum(length(text) + 1) AS BIGINT) AS characters
FROM documents GROUP BY source""",
        # Projections, filters and quality
        "silver_clean": f"""WITH {SILVER} SELECT transaction_id, {day('date')}, customer_id, gender, age, product_category, quantity,
       {r('price_per_unit')}, CAST(total_amount AS DOUBLE) AS total_amount, category_code, year, month, day, day_of_week,
       week_of_year, quarter, is_weekend, is_month_end, {r('total_amount_calc')} FROM silver""",
        "drop_counts": f"""WITH {TYPED}, judged AS (
  SELECT date IS NULL OR total_amount IS NULL OR product_category IS NULL OR quantity IS NULL AS lacking,
         coalesce(total_amount > 0 AND quantity > 0 AND age > 0, false) AS above FROM typed)
SELECT count(*) AS rows_read, count(*) FILTER (NOT lacking AND above) AS rows_kept,
       count(*) FILTER (lacking) AS dropped_missing, count(*) FILTER (NOT lacking AND NOT above) AS dropped_not_positive FROM judged""",
        "encode_ordinal": f"""WITH {TYPED}
SELECT product_category, CASE product_category WHEN 'Beauty' THEN 0 WHEN 'Clothing' THEN 1 WHEN 'Electronics' THEN 2 ELSE -1 END AS silver_code,
       CASE product_category WHEN 'Clothing' THEN 1 WHEN 'Electronics' THEN 2 ELSE 0 END AS feature_code, count(*) AS rows
FROM typed GROUP BY 1""",
        "encode_onehot": f"WITH {TYPED} SELECT product_category, {', '.join(hot)}, count(*) AS rows FROM typed GROUP BY ALL",
        "amount_recalc": f"""WITH {SILVER} SELECT product_category, count(*) AS rows,
       count(*) FILTER (abs(CAST(total_amount AS DOUBLE) - total_amount_calc) > 0.005) AS mismatches,
       {rx('sum(total_amount)', 'stated_total')}, {rx('sum(total_amount_calc)', 'computed_total', 2)} FROM silver GROUP BY 1""",
        "age_band": f"WITH {SILVER} SELECT age, {AGE_GROUP} AS age_group, count(*) AS rows FROM silver GROUP BY age",
        "risk_band": f"""WITH {flagged()} SELECT {RISK} AS risk_level, count(*) AS rows,
       {rx('min(anomaly_score)', 'low')}, {rx('max(anomaly_score)', 'high')} FROM scored GROUP BY 1""",
        "alert_tiers": f"""WITH {flagged()} SELECT CASE WHEN anomaly_score > 0.65 THEN 'stock audit' WHEN anomaly_score > 0.55 THEN 'alert manager'
       ELSE 'none' END AS alert_action, CAST(revenue_z_score > 3 AS INTEGER) AS pricing_review, count(*) AS rows FROM scored GROUP BY 1, 2""",
        "anomaly_gold": f"""WITH {flagged()} SELECT {day('date')}, product_category, {r('daily_revenue')}, daily_quantity, transaction_count,
       {r('revenue_z_score', 'pct_from_rolling_mean', 'rolling_mean_7')}, anomaly_flag, {r('anomaly_score')}, {RISK} AS risk_level FROM scored""",
        "unknown_categories": f"""WITH {RAW} SELECT "Product Category" AS product_category, count(*) AS rows FROM raw
WHERE coalesce("Product Category" NOT IN ({known}), true) GROUP BY 1""",
        "distinct_categories": f"WITH {TX} SELECT DISTINCT product_category FROM tx",
        "null_counts": f"WITH {RAW} " + _null_rows({c: f'"{c}" IS NULL' for c in RAW_COLUMNS}, "nulls"),
        "non_numeric_counts": f"WITH {RAW} " + _null_rows({c: no_number(c) for c in NUMERIC_COLUMNS}, "non_numeric"),
        "validation_report": _report(),
        "upload_reports": _upload_findings(),
        "ingest_summary": f"""WITH {TYPED} SELECT CASE WHEN grouping(product_category) = 1 THEN '(all)' ELSE product_category END AS product_category,
       count(*) AS rows, {day('min(date)', 'first_date')}, {day('max(date)', 'last_date')}
FROM typed GROUP BY GROUPING SETS ((), (product_category))""",
        "silver_quality": f"""WITH {SILVER} SELECT count(*) AS total_records, {day('min(date)', 'first_date')}, {day('max(date)', 'last_date')},
       count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_category) AS categories,
       count(*) FILTER (date IS NULL) AS null_dates, count(*) FILTER (total_amount IS NULL) AS null_amounts FROM silver""",
        "revenue_by_category": f"""WITH {SILVER} SELECT product_category, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
       {rx('CAST(sum(total_amount) AS DOUBLE) / count(*)', 'avg_per_tx')}, count(transaction_id) AS transactions FROM silver GROUP BY 1""",
        "expectations": _expectations(),
        # Gold tables and dashboard
        "gold_daily_revenue": f"""WITH {SILVER}, {GOLD_DAILY} SELECT {day('date')}, product_category, year, month, day_of_week, quarter, is_weekend,
       {r('daily_revenue')}, daily_quantity, transaction_count, {r('avg_price', 'avg_customer_age', 'female_ratio')} FROM gold_daily""",
        "gold_monthly_summary": f"""WITH {SILVER}, {GOLD_MONTHLY} SELECT year, month, product_category, {r('monthly_revenue')}, monthly_quantity,
       monthly_transactions, {r('avg_transaction_value')}, unique_customers, year_month FROM monthly""",
        "customer_sketches": f"""WITH {SILVER} SELECT year, quarter, product_category, count(DISTINCT customer_id) AS customers, true AS close
FROM silver GROUP BY ALL""",
        "scan_quoted_breaks": """SELECT doc_id, source, length(t) AS characters, md5(t) AS digest, 2 AS rows, 0 AS corrupt
FROM (SELECT doc_id, source, nullif(replace(text, 'e ', 'e", "'), '') AS t FROM documents)""",
        "gold_customer_segments": f"""WITH {SILVER}, {GOLD_SEGMENTS} SELECT product_category, gender, age_group, transaction_count,
       {r('total_revenue', 'avg_spend', 'avg_quantity')} FROM segments""",
        "gold_enriched": f"""WITH {flagged()} SELECT {day('date')}, product_category, {r('daily_revenue')}, daily_quantity,
       anomaly_flag,
       {rx('CASE WHEN anomaly_flag = 1 THEN revenue_z_score END', 'revenue_z_score')}, {rx('lag_7', 'predicted_revenue')} FROM scored""",
        "gold_row_counts": f"""WITH {SILVER}, {GOLD_DAILY}, {GOLD_MONTHLY}, {GOLD_SEGMENTS}
SELECT 'daily_revenue' AS table_name, count(*) AS rows FROM gold_daily
UNION ALL SELECT 'monthly_summary', count(*) FROM monthly UNION ALL SELECT 'customer_segments', count(*) FROM segments
UNION ALL SELECT 'anomaly_records', n FROM (WITH {FEAT} SELECT count(*) AS n FROM feat)""",
        "dash_totals": f"WITH {SILVER}, {GOLD_DAILY} " + totals.format(sums=total_columns, where=""),
        "dash_totals_month": f"WITH {SILVER}, {GOLD_DAILY} " + totals.format(sums=total_columns, where="WHERE month = 6"),
        "mom_growth": growth,
        "revenue_share": f"""WITH {SILVER}, a AS (
  SELECT 'revenue by category' AS measure, '(all)' AS within, product_category AS member, CAST(sum(total_amount) AS DOUBLE) AS amount
  FROM silver GROUP BY product_category
  UNION ALL SELECT 'transactions by gender', product_category, gender, CAST(count(transaction_id) AS DOUBLE)
  FROM silver GROUP BY product_category, gender)
SELECT measure, within, member, {rx('amount', 'amount', 2)},
       {rx('amount / sum(amount) OVER (PARTITION BY measure, within) * 100', 'share_percent')} FROM a""",
        "dash_segments": f"""WITH {SILVER}, {GOLD_SEGMENTS} SELECT {cut_keys}, {rx('sum(total_revenue)', 'total_revenue', 2)},
       CAST(sum(transaction_count) AS BIGINT) AS transaction_count, {rx('avg(avg_spend)', 'avg_spend')},
       {rx('sum(total_revenue) / sum(transaction_count)', 'avg_spend_weighted')} FROM segments GROUP BY {sets}""",
        "dash_cards": f"""WITH {SILVER}, {GOLD_MONTHLY} SELECT product_category, {rx('sum(monthly_revenue)', 'total_revenue', 2)},
       {rx('avg(avg_transaction_value)', 'avg_transaction_unweighted')},
       {rx('sum(monthly_revenue) / sum(monthly_transactions)', 'avg_transaction')} FROM monthly GROUP BY 1""",
        # Daily series
        "daily_features": f"""WITH {DAILY} SELECT {day('date')}, product_category, {r('daily_revenue')}, daily_quantity, transaction_count,
       {r('avg_price', 'avg_age', 'female_ratio')} FROM daily""",
        "dense_grid": f"""WITH {GRID} SELECT {day('date')}, product_category, {r('daily_revenue')}, daily_quantity, transaction_count,
       {r('avg_price', 'avg_age', 'female_ratio')} FROM grid""",
        "date_features": f"WITH {GRID} SELECT {day('date')}, product_category, {feature_calendar()} FROM grid",
        "date_names": f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT {day('date')}, monthname(date) AS month_name, dayname(date) AS weekday_name, strftime(date, '%Y-%m-%d') AS date_text FROM d""",
        "lag_features": f"WITH {ROLLED} SELECT {day('date')}, product_category, {r('daily_revenue', *LAGS)} FROM rolled",
        "rolling_features": f"WITH {ROLLED} SELECT {day('date')}, product_category, {r(*ROLLING)} FROM rolled",
        "zscore": f"WITH {SERIES} SELECT {day('date')}, product_category, {r('revenue_z_score', 'pct_from_rolling_mean')} FROM series",
        "feature_table": f"""WITH {FEAT} SELECT {day('date', '"Date"')}, product_category AS "Product Category", {_feature_columns()} FROM feat""",
        "time_split": f"""WITH {SPLIT} SELECT split, product_category, count(*) AS rows, {day('min(date)', 'first_date')}, {day('max(date)', 'last_date')},
       {rx('avg(daily_revenue)', 'revenue_mean')}, {rx('max(daily_revenue)', 'revenue_max')}, {rx('min(daily_revenue)', 'revenue_min')}
FROM split GROUP BY split, product_category""",
        "latest_actuals": f"""WITH {LATEST} SELECT product_category, {day('last_date')}, {r(*LAGS, *ROLLING)},
       {r('avg_age', 'female_ratio', 'avg_price')}, transaction_count, daily_quantity FROM latest""",
        "future_features": f"""WITH {LATEST}, ahead AS (
  SELECT *, last_date + CAST(step AS INTEGER) AS date FROM (SELECT *, unnest(generate_series(1, 14)) AS step FROM latest))
SELECT product_category, {day('last_date')}, CAST(step AS INTEGER) AS step, {day('date')}, {r(*LAGS, *ROLLING)},
       {r('avg_age', 'female_ratio', 'avg_price')}, transaction_count, {feature_calendar()}, {ENCODED},
       0.0::DOUBLE AS revenue_z_score, 0.0::DOUBLE AS pct_from_rolling_mean FROM ahead""",
        "anomaly_runs": f"""WITH {FEAT}, f AS (
  SELECT *, date - CAST(row_number() OVER (PARTITION BY product_category ORDER BY date) AS INTEGER) AS run FROM feat
  WHERE revenue_z_score > CASE WHEN product_category = 'Electronics' THEN 2.0 ELSE 1.5 END)
SELECT product_category, {day('min(date)', 'first_day')}, {day('max(date)', 'last_day')}, count(*) AS days,
       {rx('max(revenue_z_score)', 'max_z')}, CAST(count(*) >= 2 AS INTEGER) AS escalate FROM f GROUP BY product_category, run""",
        "reorder_signal": f"""WITH {FEAT}, m AS (
  SELECT *, avg(daily_revenue) OVER (PARTITION BY product_category, date_trunc('month', date)) AS monthly_mean FROM feat)
SELECT {day('date')}, product_category, {r('rolling_mean_7', 'monthly_mean')},
       CAST(rolling_mean_7 < 0.6 * monthly_mean AS INTEGER) AS reorder FROM m""",
        # Summaries and reports
        "sales_summary": f"""WITH {GRID} SELECT product_category, {rx('sum(daily_revenue)', 'revenue_sum', 2)}, {rx('avg(daily_revenue)', 'revenue_mean', 2)},
       {rx('max(daily_revenue)', 'revenue_max', 2)}, {rx('min(daily_revenue)', 'revenue_min', 2)} FROM grid {year} GROUP BY 1""",
        "monthly_pivot": f"""WITH {GRID} SELECT month(date) AS month_no, monthname(date) AS month_name, {pivot} FROM grid {year}
GROUP BY month(date), monthname(date)""",
        "describe_revenue": _describe(),
        "score_percentiles": f"WITH {FEAT} " + _percentiles("feat", "revenue_z_score"),
        "order_percentiles": f"WITH {TX} " + _percentiles("tx", "price_per_unit"),
        "quantile_sketches": f"""WITH {TX} SELECT CAST(year(date) AS INTEGER) AS year, count(price_per_unit) AS n,
       true AS within_0, true AS within_1, true AS within_2, true AS within_3, true AS within_4 FROM tx GROUP BY 1""",
        "anomaly_rate": f"""WITH {flagged()}, c AS (SELECT count(*) AS total_records, CAST(sum(anomaly_flag) AS BIGINT) AS anomalies FROM scored)
SELECT total_records, anomalies, total_records - anomalies AS normal, {rx('anomalies / total_records * 100', 'anomaly_percent')},
       {rx('(total_records - anomalies) / total_records * 100', 'normal_percent')} FROM c""",
        "anomaly_breakdown": f"WITH {flagged()} {breakdown}",
        "top_anomalies": f"""WITH {flagged()}, z AS (SELECT *, round(abs(revenue_z_score), 6) AS abs_z FROM scored),
top AS (SELECT * FROM z ORDER BY abs_z DESC, date, product_category LIMIT 10)
SELECT {day('date')}, product_category, {r('daily_revenue', 'abs_z')} FROM top""",
        "forecast_metrics": f"WITH {SPLIT}, s AS (SELECT *, lag_7 AS p FROM split) {_metrics('s')}",
        "forecast_summary": f"""WITH {WEEK} SELECT product_category, count(*) AS days_ahead, {rx('sum(predicted_revenue)', 'total_predicted_revenue', 2)},
       {rx('avg(predicted_revenue)', 'avg_daily_revenue', 2)},
       strftime(first(date ORDER BY predicted_revenue DESC, date), '%Y-%m-%d') AS max_day, {rx('max(predicted_revenue)', 'max_revenue')},
       strftime(first(date ORDER BY predicted_revenue, date), '%Y-%m-%d') AS min_day, {rx('min(predicted_revenue)', 'min_revenue')},
       count(*) FILTER (anomaly_flag = 1) AS anomaly_days_count,
       coalesce(string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) FILTER (anomaly_flag = 1), '') AS anomaly_days
FROM week GROUP BY product_category""",
        "sales_context": _context(),
        "sales_context_text": f"""WITH lines AS ({_context()}), blocks AS (
  SELECT section_no, '=== ' || section || ' ===' || chr(10) || string_agg(line, chr(10) ORDER BY line_key) AS block
  FROM lines GROUP BY section_no, section)
SELECT string_agg(block, chr(10) || chr(10) ORDER BY section_no) AS context FROM blocks""",
        "forecast_context": f"""WITH {WEEK}, l AS (
  SELECT *, '  ' || strftime(date, '%Y-%m-%d') || ' (' || rpad(dayname(date), 9, ' ') || '): Rs ' || format('{{:,.0f}}', predicted_revenue) AS line FROM week)
SELECT product_category, '--- ' || product_category || ' (next ' || count(*) || ' days) ---' || chr(10) || string_agg(line, chr(10) ORDER BY date)
       || chr(10) || '  Total: Rs ' || format('{{:,.0f}}', sum(predicted_revenue)) || '  |  Avg/day: Rs ' || format('{{:,.0f}}', avg(predicted_revenue)) AS context
FROM l GROUP BY product_category""",
        "standardise": _standardised(),
        # Text
        "chunk_documents": f"WITH {CHUNKS} SELECT doc_id, source, chunk_id, chunk_text FROM chunks",
        "keyword_search": f"WITH {LIBRARY}, {_keyword('library', 'doc_id', 'title', 'content', 'category', 'score', 10)} "
        f"SELECT query_id, doc_id, {r('relevance_score')}, rank FROM found",
        "bm25_search": f"WITH {_bm25(10)} SELECT query_id, doc_id, {r('relevance_score')}, rank FROM found",
        "bm25_messages": f"WITH {_bm25(3, MESSAGE_TERMS)} SELECT query_id, doc_id, {r('relevance_score')}, rank FROM found",
        "knn_block_join": f"""WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM pairs)
SELECT query_id, vec_id, {r('similarity')}, rank FROM ranked WHERE rank <= 10""",
        "knn_index_recall": """SELECT count(*) AS queries, CAST(10 * count(*) AS BIGINT) AS neighbours, true AS enough
FROM embeddings WHERE vec_id % 100 = 0""",
        "vector_report": """SELECT count(*) AS rows, count(*) FILTER (coalesce(len(embedding), 0) = 0) AS without_vector,
       count(*) FILTER (len(embedding) > 0 AND list_min(embedding) = 0 AND list_max(embedding) = 0) AS zero_vectors,
       CAST(min(len(embedding)) AS INTEGER) AS least_dimensions, CAST(max(len(embedding)) AS INTEGER) AS most_dimensions FROM embeddings""",
        "knn_topk": f"""WITH cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM cells GROUP BY label, pos),
centroids AS (SELECT label, list(x ORDER BY pos) AS c FROM means GROUP BY label),
pairs AS (SELECT e.vec_id, q.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.c) AS similarity FROM embeddings e, centroids q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM pairs)
SELECT label, vec_id, {r('similarity')}, rank FROM ranked WHERE rank <= 4""",
        "context_assembly": f"""WITH {CHUNKS}, {_keyword('chunks', 'doc_id, chunk_id, source, chunk_text', "''", 'chunk_text', 'lang', '0.0', 4)}
SELECT query_id, string_agg('[Source: ' || source || ']' || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
       array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS chunks FROM found GROUP BY query_id""",
        "intent_route": f"SELECT conv_id, turn, * EXCLUDE (conv_id, turn), {sample_agent} FROM (SELECT conv_id, turn, {sample_scores} FROM conversations)",
        "intent_route_default": f"""SELECT agent, count(*) AS messages FROM (SELECT {agent} FROM (SELECT {scores} FROM (
  SELECT text FROM conversations UNION ALL SELECT text FROM documents))) GROUP BY agent""",
        "forecast_params": """SELECT conv_id, turn, unnest(CASE WHEN contains(lower(text), 'tion') THEN ['Beauty'] WHEN contains(lower(text), 'der') THEN ['Clothing']
       WHEN contains(lower(text), 'las') THEN ['Electronics'] ELSE ['Beauty', 'Clothing', 'Electronics'] END) AS product_category,
       CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'the') THEN 14 ELSE 7 END AS days FROM conversations""",
        "session_history": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
SELECT conv_id, turn, role, text, CAST(count(*) OVER (PARTITION BY conv_id) // 2 AS INTEGER) AS conversation_turns FROM a WHERE age <= 6""",
        "session_clear": """SELECT conv_id, count(*) AS messages FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id""",
        # Streaming
        "ingest_stream": f"""WITH {TYPED} SELECT CASE WHEN date IS NULL OR total_amount IS NULL OR product_category IS NULL OR quantity IS NULL THEN 'missing value'
       WHEN coalesce(total_amount > 0 AND quantity > 0 AND age > 0, false) THEN 'ok' ELSE 'not positive' END AS status, count(*) AS rows
FROM typed GROUP BY 1""",
    }
