"""One SQL text per registered query."""

from __future__ import annotations

from oracles.base import months, tenure, with_facts, with_roles, years

SUM = "CAST(COALESCE(SUM(price), 0) AS DOUBLE)"
TENURES = """(VALUES ('no account'), ('1 month'), ('2- 6 months'), ('6 months - 1 year'),
  ('1- 3 years'), ('3 - 5 years'), ('5 years+')) b(tenure_band)"""
PRICES = """(VALUES ('free'), ('below $ 5'), ('$ 5-10'), ('$ 10-20'), ('$20+')) p(price_band)"""
CATEGORY_NAMES = {
    "Entertainment": "entertainment",
    "Games": "games",
    "Photos & Videos": "photos_videos",
    "Social Networking": "social_networking",
    "Utilities": "utilities",
}
MONTHS = ["2016-06", "2016-07", "2016-08", "2016-09"]


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def prev(column: str, keys: str, order: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"LAG({column}) OVER ({part}ORDER BY {order})"


def value_counts(column: str) -> str:
    return f"""SELECT {column}, COUNT(*) AS transaction_ct FROM final
      WHERE {column} IS NOT NULL GROUP BY {column}"""


def share(table: str, column: str, count: str, name: str, share_name: str) -> str:
    return f"""SELECT {column}, {name}, {div(name, f'SUM({name}) OVER ()')} AS {share_name}
      FROM (SELECT {column}, {count} AS {name} FROM {table}
        WHERE {column} IS NOT NULL GROUP BY {column})"""


def histogram(measure: str, bins: int, where: str = "TRUE", limits: tuple | None = None) -> str:
    low, high = limits or ("MIN(v)", "MAX(v)")
    source = "" if limits else " FROM kept"
    return f"""SELECT * FROM (WITH kept AS (
      SELECT CAST({measure} AS DOUBLE) AS v FROM account_summary
      WHERE {where} AND {measure} IS NOT NULL
    ), ends AS (
      SELECT CAST({low} AS DOUBLE) AS l, CAST({high} AS DOUBLE) AS h{source}
    ), placed AS (
      SELECT v, CASE WHEN v < l THEN 0 WHEN v > h THEN {bins + 1} WHEN l = h THEN 1
        ELSE LEAST(FLOOR({bins} * (v - l) / (h - l)) + 1, {bins}) END AS place
      FROM kept, ends
    )
    SELECT CAST(b AS INTEGER) AS bin,
      CASE WHEN b BETWEEN 1 AND {bins} THEN l + (b - 1) * ((h - l) / {bins}) WHEN b > {bins} THEN h END
        AS bin_start,
      CASE WHEN b BETWEEN 1 AND {bins} THEN l + b * ((h - l) / {bins}) WHEN b < 1 THEN l END AS bin_end,
      COUNT(v) AS row_ct
    FROM (SELECT b, l, h FROM range(0, {bins + 2}) r(b), ends) LEFT JOIN placed ON place = b
    GROUP BY b, l, h)"""


def describe(table: str, columns: list[str], where: str = "TRUE") -> str:
    def one(c: str) -> str:
        v = f"CAST({c} AS DOUBLE)"
        return f"""SELECT '{c}' AS column_name, COUNT({c}) AS value_ct, ROUND(AVG({v}), 6) AS mean,
          ROUND(STDDEV_SAMP({v}), 6) AS std, MIN({v}) AS min,
          ROUND(QUANTILE_CONT({v}, 0.25), 6) AS q25, ROUND(QUANTILE_CONT({v}, 0.5), 6) AS q50,
          ROUND(QUANTILE_CONT({v}, 0.75), 6) AS q75, MAX({v}) AS max
        FROM {table} WHERE {where}"""

    return " UNION ALL ".join(one(c) for c in columns)


SUMMARY_MEASURES = [
    *[f"{column}_revenue" for column in CATEGORY_NAMES.values()],
    "total_revenue", "total_txn", "avg_spend_amount",
    "acct_tenure_days", "acct_tenure_months", "acct_tenure_years",
]
WITHIN = "total_txn <= 120 AND total_revenue <= 900"


def filled_tenure(measures: str, zeros: list[str], where: str = "TRUE", tail: str = "*") -> str:
    columns = ", ".join(f"COALESCE({z}, 0) AS {z}" for z in zeros)
    return f"""SELECT {tail} FROM (SELECT tenure_band, {columns} FROM {TENURES} LEFT JOIN (
      SELECT tenure_band, {measures} FROM final WHERE {where} GROUP BY tenure_band)
      USING (tenure_band))"""


def account_bands(key: str) -> str:
    return f"""SELECT tenure_band, {key}, COALESCE(acct_ct, 0) AS acct_ct
    FROM (SELECT * FROM (SELECT DISTINCT {key} FROM account_summary WHERE {key} IS NOT NULL)
      CROSS JOIN {TENURES})
    LEFT JOIN (SELECT tenure_band, {key}, COUNT(*) AS acct_ct FROM account_summary
      GROUP BY tenure_band, {key}) USING (tenure_band, {key})"""


def account_counts(*keys: str) -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""SELECT {', '.join(keys)}, COUNT(*) AS acct_ct FROM account_summary WHERE {present}
      GROUP BY ALL"""


def daily(keys: str, where: str, extra: str = "") -> str:
    return f"""SELECT *, transaction_ct - free_transaction_ct AS paid_transaction_ct,
      {div('free_transaction_ct', 'active_acct_ct')} AS avg_free_transaction_ct_per_acct,
      {div('transaction_ct - free_transaction_ct', 'active_acct_ct')}
        AS avg_paid_transaction_ct_per_acct,
      {div('transaction_ct', 'active_acct_ct')} AS avg_transaction_ct_per_acct,
      {div('daily_sales', 'active_acct_ct')} AS avg_sales_per_acct
    FROM (SELECT {keys}, COUNT(DISTINCT acct_id) AS active_acct_ct, {extra}
        {SUM} AS daily_sales, CAST(SUM(free_transaction_flag) AS BIGINT) AS free_transaction_ct,
        COUNT(*) AS transaction_ct FROM final WHERE {where} GROUP BY ALL)"""


DAY_APPS = f"""SELECT parent_app_content_id, app_name, COUNT(DISTINCT acct_id) AS active_acct,
  {SUM} AS revenue_by_app, COUNT(*) AS txn_by_app FROM final
  WHERE transaction_dt = DATE '2016-07-04' AND parent_app_content_id IS NOT NULL
    AND app_name IS NOT NULL GROUP BY ALL"""

DAILY_APP = f"""SELECT *, {div('txn_by_app', 'yesterday_txn_by_app')} - 1 AS app_txn_change_rate,
    txn_by_app - yesterday_txn_by_app AS app_txn_change,
    {div('revenue_by_app', 'yesterday_revenue_by_app')} - 1 AS app_revenue_change_rate,
    revenue_by_app - yesterday_revenue_by_app AS app_revenue_change
  FROM (SELECT *,
      {prev('txn_by_app', 'parent_app_content_id, app_name', 'transaction_dt')}
        AS yesterday_txn_by_app,
      {prev('revenue_by_app', 'parent_app_content_id, app_name', 'transaction_dt')}
        AS yesterday_revenue_by_app
    FROM (SELECT parent_app_content_id, app_name, transaction_dt,
        COUNT(DISTINCT acct_id) AS active_acct, {SUM} AS revenue_by_app, COUNT(*) AS txn_by_app
      FROM final WHERE parent_app_content_id IS NOT NULL AND app_name IS NOT NULL GROUP BY ALL))"""


def movers(by: str) -> str:
    return f"""SELECT * FROM ({DAILY_APP}) WHERE transaction_dt = DATE '2016-07-04'
      ORDER BY app_{by}_change DESC NULLS LAST, app_{by}_change_rate DESC NULLS LAST,
        parent_app_content_id, app_name LIMIT 10"""


def weekly(key: str = "") -> str:
    keys = "first_day_of_the_week" + (f", {key}" if key else "")
    present = f"{key} IS NOT NULL" if key else "TRUE"
    order = "first_day_of_the_week"
    return f"""SELECT *,
      {div('weekly_sales', 'previous_week_sales')} - 1 AS weekly_sales_increase_rate,
      {div('weekly_transaction_ct', 'previous_week_transaction_ct')} - 1
        AS weekly_transaction_ct_increase_rate
    FROM (SELECT *, {div('weekly_transaction_ct', 'active_days')} AS avg_daily_transaction_ct,
        {div('weekly_sales', 'active_days')} AS avg_daily_sales,
        {prev('weekly_sales', key, order)} AS previous_week_sales,
        {prev('weekly_transaction_ct', key, order)} AS previous_week_transaction_ct
      FROM (SELECT {keys}, {SUM} AS weekly_sales, COUNT(DISTINCT acct_id) AS active_acct_ct,
          COUNT(DISTINCT transaction_dt) AS active_days, COUNT(*) AS weekly_transaction_ct
        FROM final WHERE {present} GROUP BY ALL))"""


WEEKDAY = f"""SELECT *,
    {div('active_acct_ct', 'previous_weekday_active_acct_ct')} - 1 AS wow_active_acct_ct,
    {div('daily_sales', 'previous_weekday_sales')} - 1 AS wow_sales_increase_rate,
    {div('daily_transaction_ct', 'previous_weekday_transaction_ct')} - 1
      AS wow_transaction_ct_increase_rate
  FROM (SELECT *,
      {prev('active_acct_ct', 'transaction_weekday_nm', 'first_day_of_the_week')}
        AS previous_weekday_active_acct_ct,
      {prev('daily_sales', 'transaction_weekday_nm', 'first_day_of_the_week')}
        AS previous_weekday_sales,
      {prev('daily_transaction_ct', 'transaction_weekday_nm', 'first_day_of_the_week')}
        AS previous_weekday_transaction_ct
    FROM (SELECT first_day_of_the_week, transaction_weekday_nm, {SUM} AS daily_sales,
        COUNT(DISTINCT acct_id) AS active_acct_ct, COUNT(*) AS daily_transaction_ct
      FROM final GROUP BY ALL))"""


def ranked(column: str, keys: str) -> str:
    return f"CAST(RANK() OVER (PARTITION BY {keys} ORDER BY {column} DESC) AS INTEGER)"


APP_WEEK = f"""SELECT *,
    {ranked('category_weekly_sales', 'first_day_of_the_week')} AS category_weekly_sales_rank,
    CAST(DENSE_RANK() OVER (PARTITION BY first_day_of_the_week ORDER BY category_weekly_sales DESC)
      AS INTEGER) AS category_weekly_sales_dense_rank
  FROM (SELECT * EXCLUDE (sales),
      {ranked('sales', 'first_day_of_the_week')} AS app_weekly_sales_rank,
      {ranked('app_weekly_transaction_ct', 'first_day_of_the_week')}
        AS app_weekly_transaction_ct_rank,
      {ranked('sales', 'first_day_of_the_week, category_name')} AS app_weekly_sales_rank_category,
      {ranked('app_weekly_transaction_ct', 'first_day_of_the_week, category_name')}
        AS app_weekly_transaction_ct_rank_category,
      CAST(SUM(sales) OVER (PARTITION BY first_day_of_the_week, category_name) AS DOUBLE)
        AS category_weekly_sales
    FROM (SELECT first_day_of_the_week, app_name, category_name, SUM(price) AS sales,
        {SUM} AS app_weekly_sales, COUNT(DISTINCT acct_id) AS app_active_acct_ct,
        COUNT(*) AS app_weekly_transaction_ct
      FROM final WHERE app_name IS NOT NULL AND category_name IS NOT NULL GROUP BY ALL))"""


def leaders(first: str, second: str, more: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT *, MAX(first_day_of_the_week) OVER () AS latest
        FROM ({APP_WEEK})) t
      WHERE ({first} <= 5 OR {second} <= 5) AND first_day_of_the_week = latest AND {more}"""


def without_latest(text: str) -> str:
    return text.replace("SELECT * FROM (SELECT *,", "SELECT * EXCLUDE (latest) FROM (SELECT *,", 1)


def monthly(where: str) -> str:
    return f"""SELECT *, {div('transaction_ct', 'active_days')} AS avg_daily_transaction_ct,
      {div('monthly_sales', 'active_days')} AS avg_daily_sales
    FROM (SELECT transaction_year_month, {SUM} AS monthly_sales,
        COUNT(DISTINCT acct_id) AS active_acct_ct,
        COUNT(DISTINCT parent_app_content_id) AS purchased_unique_app,
        COUNT(DISTINCT transaction_dt) AS active_days, COUNT(*) AS transaction_ct
      FROM final WHERE {where} GROUP BY ALL)"""


def amounts(key: str) -> str:
    return f"""SELECT {key}, total_revenue, CAST(n AS DOUBLE) AS total_transaction_ct,
      avg_transaction_amt, {div('n', 'SUM(n) OVER ()')} AS transaction_share,
      {div('total_revenue', 'CAST(SUM(exact) OVER () AS DOUBLE)')} AS revenue_share,
      {div('avg_transaction_amt', 'MIN(avg_transaction_amt) OVER ()')} AS avg_transaction_amt_index
    FROM (SELECT {key}, SUM(price) AS exact, {SUM} AS total_revenue, COUNT(*) AS n,
        {div('SUM(price)', 'COUNT(*)')} AS avg_transaction_amt
      FROM final WHERE {key} IS NOT NULL GROUP BY {key})"""


def by_type(*keys: str) -> str:
    names = ", ".join(keys)
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    scaled = [
        "sales_amount", "transaction_ct", "avg_revenue_per_app", "avg_txn_per_app",
        "avg_revenue_per_content", "avg_txn_per_content",
    ]
    estimate = ", ".join(
        f"""CASE WHEN inapp_content_type = 'subscription'
          THEN {c} * (CAST(1 AS DOUBLE) / ratio) * CAST(0.6 AS DOUBLE)
          ELSE {c} END AS estimated_annual_{c.replace('avg_', '')}"""
        for c in scaled
    )
    return f"""SELECT * EXCLUDE (ratio), {estimate} FROM (SELECT *,
        {div('content_ct', 'parent_app_content_ct')} AS avg_paid_content_ct_per_app,
        {div('sales_amount', 'parent_app_content_ct')} AS avg_revenue_per_app,
        {div('sales_amount', 'transaction_ct')} AS avg_price_per_txn,
        {div('transaction_ct', 'parent_app_content_ct')} AS avg_txn_per_app,
        {div('sales_amount', 'content_ct')} AS avg_revenue_per_content,
        {div('transaction_ct', 'content_ct')} AS avg_txn_per_content
      FROM (SELECT {names}, COUNT(DISTINCT app_name) AS app_name_ct,
          COUNT(DISTINCT parent_app_content_id) AS parent_app_content_ct,
          COUNT(DISTINCT content_id) AS content_ct, {SUM} AS sales_amount,
          COUNT(*) AS transaction_ct
        FROM subscription WHERE {present} GROUP BY ALL),
      (SELECT date_diff('day', MIN(transaction_dt), MAX(transaction_dt)) / CAST(365 AS DOUBLE)
        AS ratio FROM dedup))"""


CONTENT = f"""SELECT content_id, inapp_content_type, {SUM} AS total_revenue,
  COUNT(*) AS transaction_ct FROM subscription
  WHERE content_id IS NOT NULL AND inapp_content_type IS NOT NULL GROUP BY ALL"""


def month_columns() -> str:
    return ", ".join(
        f"CAST(COALESCE(SUM(price) FILTER (transaction_year_month = '{m}'), 0) AS DOUBLE) "
        f"AS revenue_{m.replace('-', '_')}"
        for m in MONTHS
    )


def purchase_flags() -> str:
    flag = "CASE WHEN revenue_{0} > 0 THEN 1 ELSE 0 END"
    names = [m.replace("-", "_") for m in MONTHS]
    flags = ", ".join(f"{flag.format(n)} AS purchase_{n}" for n in names)
    total = " + ".join(flag.format(n) for n in names)
    return (
        f"{flags}, CAST({total} AS INTEGER) AS purchase_month_ct, "
        f"CASE WHEN {total} > 1 THEN 1 ELSE 0 END AS repeat_purchase"
    )


ANY_MONTH = " OR ".join(f"revenue_{m.replace('-', '_')} <> 0" for m in MONTHS)

MATRIX = f"""SELECT acct_id, content_id, {', '.join('revenue_' + m.replace('-', '_') for m in MONTHS)},
    {purchase_flags()}, first_txn_dt, parent_app_content_id, app_name, category_id, category_name,
    app_device_id, app_device_name, inapp_content_type
  FROM (SELECT acct_id, content_id, {month_columns()} FROM subscription
    WHERE acct_id IS NOT NULL AND content_id IS NOT NULL AND transaction_year_month IS NOT NULL
    GROUP BY ALL)
  LEFT JOIN (SELECT acct_id, content_id, MIN(transaction_dt) AS first_txn_dt FROM final
    GROUP BY ALL) USING (acct_id, content_id)
  LEFT JOIN app_df USING (content_id) WHERE {ANY_MONTH}"""


def two_sample(source: str, group: str, control: str, test: str, value: str) -> str:
    def side(label: str, suffix: str) -> str:
        mine = f"FILTER ({group} = '{label}')"
        return f"""COUNT({value}) {mine} AS n_{suffix}, AVG(CAST({value} AS DOUBLE)) {mine} AS m_{suffix},
          VAR_POP(CAST({value} AS DOUBLE)) {mine} AS v_{suffix}"""

    return f"""SELECT n_control, n_test, ROUND(m_control, 6) AS mean_control,
      ROUND(m_test, 6) AS mean_test, ROUND(SQRT(v_control), 6) AS sd_control,
      ROUND(SQRT(v_test), 6) AS sd_test, ROUND(d, 6) AS d_hat, ROUND(vp, 6) AS variance_pool,
      ROUND(se, 6) AS se, ROUND(1.96::DOUBLE * se, 6) AS margin,
      ROUND(d - 1.96::DOUBLE * se, 6) AS lower_bound, ROUND(d + 1.96::DOUBLE * se, 6) AS upper_bound,
      ABS(d) > 1.96::DOUBLE * se AS significant
    FROM (SELECT *, SQRT(vp) * SQRT(1.0::DOUBLE / n_control + 1.0::DOUBLE / n_test) AS se
      FROM (SELECT *, m_test - m_control AS d,
          ((n_control - 1) * v_control + (n_test - 1) * v_test)
            / NULLIF(CAST(n_control - 1 + n_test - 1 AS DOUBLE), 0) AS vp
        FROM (SELECT {side(control, 'control')}, {side(test, 'test')} FROM ({source}))))"""


def repeat_content(category: str) -> str:
    return f"""SELECT content_id, inapp_content_type,
      CAST(SUM(repeat_purchase) AS BIGINT) AS repeat_purchase_acct_ct FROM ({MATRIX})
      WHERE category_name = '{category}' AND inapp_content_type IS NOT NULL GROUP BY ALL"""


PRICE_DAYS = """SELECT content_id, price, COUNT(DISTINCT transaction_dt) AS price_occur_days,
  COUNT(*) AS transaction_ct FROM final WHERE content_id IS NOT NULL AND price IS NOT NULL
  GROUP BY ALL"""

REGULAR = f"""SELECT content_id,
    MAX(price) FILTER (by_count = 1) AS modal_price, MAX(price) FILTER (by_days = 1) AS regular_price
  FROM (SELECT *,
      ROW_NUMBER() OVER (PARTITION BY content_id ORDER BY transaction_ct DESC, price) AS by_count,
      ROW_NUMBER() OVER (PARTITION BY content_id ORDER BY price_occur_days DESC, price) AS by_days
    FROM ({PRICE_DAYS})) GROUP BY content_id"""

PRICED = f"""SELECT f.*, regular_price,
    CASE WHEN price < regular_price THEN 1 ELSE 0 END AS promotion_flag,
    1 - {div('price', 'regular_price')} AS promotion_rate
  FROM final f LEFT JOIN (SELECT content_id, regular_price FROM ({REGULAR})) USING (content_id)"""

ROLE_COLUMNS = {
    "transaction": ["create_dt", "content_id", "acct_id", "price", "device_id"],
    "account": ["acct_id", "create_dt", "payment_type"],
    "app": ["content_id", "app_name", "category_id", "device_id"],
    "inapp": ["parent_app_content_id", "content_id", "type"],
    "category": ["category_id", "category_name"],
    "device": ["device_id", "device_name"],
}


def duplicates(table: str, columns: list[str]) -> str:
    inner = f"SELECT COUNT(*) AS copies FROM {table} GROUP BY {', '.join(columns)}"
    return f"""SELECT CAST(SUM(copies) AS BIGINT) AS total_rows, COUNT(*) AS distinct_rows,
      CAST(SUM(copies) AS BIGINT) - COUNT(*) AS duplicate_ct,
      ROUND((SUM(copies) - COUNT(*)) / CAST(SUM(copies) AS DOUBLE) * 100, 2) AS duplicate_rate,
      SUM(copies) = COUNT(*) AS is_unique FROM ({inner})"""


def nulls(label: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_ct "
        f"FROM {table}"
        for c in columns
    )


APP_DF_COLUMNS = [
    "parent_app_content_id", "app_name", "category_id", "category_name", "app_device_id",
    "app_device_name", "content_id", "inapp_content_type", "content_id_modified",
]
FACT_COLUMNS = [
    "transaction_dt", "transaction_content_id", "acct_id", "price", "transaction_device_id",
    "app_name", "parent_app_content_id", "category_id", "category_name", "app_device_id",
    "app_device_name", "content_id", "inapp_content_type", "transaction_device_name",
    "account_create_dt", "payment_type",
]
KINDS = {
    "create_dt": "date", "price": "decimal(12,2)", "category_id": "int", "device_id": "int",
    "app_device_id": "int", "transaction_device_id": "int", "transaction_dt": "date",
    "account_create_dt": "date", "first_day_of_the_week": "date", "total_txn": "bigint",
    "entertainment_revenue": "double", "games_revenue": "double", "photos_videos_revenue": "double",
    "social_networking_revenue": "double", "utilities_revenue": "double", "total_revenue": "double",
    "avg_spend_amount": "double", "acct_tenure_days": "int", "acct_tenure_months": "double",
    "acct_tenure_years": "double", "transaction_year": "int", "transaction_month": "int",
    "transaction_weekday": "int", "transaction_week": "int", "transaction_without_acct": "int",
    "free_transaction_flag": "int", ("final", "paid_acct_flag"): "int",
}


def column_kinds(label: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, '{c}' AS column_name, "
        f"'{KINDS.get((label, c), KINDS.get(c, 'string'))}' AS data_type, COUNT({c}) AS value_ct FROM {table}"
        for c in columns
    )


def roles_of(part) -> str:
    return " UNION ALL ".join(part(n, f"{n}_role", c) for n, c in ROLE_COLUMNS.items())


SUMMARY_COLUMNS = [
    "acct_id", "account_create_dt", "payment_type", "entertainment_revenue", "games_revenue",
    "photos_videos_revenue", "social_networking_revenue", "utilities_revenue", "total_revenue", "total_txn",
    "paid_acct_flag", "no_txn_flag", "avg_spend_amount", "acct_tenure_days", "acct_tenure_months",
    "acct_tenure_years", "tenure_band", "acct_txn_group",
]
FINAL_COLUMNS = [
    *FACT_COLUMNS, "acct_txn_group", "paid_acct_flag", "transaction_year_month", "transaction_year",
    "transaction_month", "transaction_weekday", "transaction_weekday_nm", "transaction_week",
    "first_day_of_the_week", "acct_tenure_days", "acct_tenure_months", "acct_tenure_years", "tenure_band",
    "transaction_without_acct", "free_transaction_flag", "price_band",
]
WEEK_COLUMNS = [
    "acct_id", "account_create_dt", "payment_type", "first_day_of_the_week", "total_revenue", "total_txn",
    "paid_acct_flag", "no_txn_flag",
]


def derived_too(part) -> str:
    return " UNION ALL ".join([
        roles_of(part), part("app_dimension", "app_df", APP_DF_COLUMNS),
        part("transaction_fact", "txn_fact", FACT_COLUMNS), part("account_summary", "account_summary", SUMMARY_COLUMNS),
        part("final", "final", FINAL_COLUMNS), part("week_activity", f"({WEEK_ACCOUNTS})", WEEK_COLUMNS),
    ])


def counts(step: str, before: str, after: str) -> str:
    return f"""SELECT '{step}' AS step, b AS rows_before, a AS rows_after, a = b AS same_count
      FROM (SELECT COUNT(*) AS b FROM {before}), (SELECT COUNT(*) AS a FROM {after})"""


def cardinality(table: str, column: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
      COUNT(DISTINCT {column}) AS distinct_ct FROM {table}_role"""


RECUT = f"""SELECT s.* EXCLUDE (acct_tenure_days, acct_tenure_months, acct_tenure_years, tenure_band),
    days AS acct_tenure_days, {months('days')} AS acct_tenure_months,
    {years('days')} AS acct_tenure_years,
    {tenure('days', 'low', 'high', 'transactions without account')} AS tenure_band
  FROM (SELECT a.*, low, high, CAST(date_diff('day', account_create_dt, until) AS INTEGER) AS days
    FROM account_summary a, (SELECT MAX(transaction_dt) AS until, MIN(acct_tenure_days) AS low,
      MAX(acct_tenure_days) AS high FROM final)) s"""
RECUT = RECUT.replace("s.* EXCLUDE (", "s.* EXCLUDE (low, high, days, ")

PAYMENT_MEASURES = f"""CAST(SUM(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
  CAST(SUM(total_txn) AS BIGINT) AS total_txn, COUNT(acct_id) AS total_acct_ct,
  {div('SUM(total_txn)', 'COUNT(acct_id)')} AS avg_txn"""

CONTENT_SHARE = f"""SELECT *, CAST(SUM(app_ct) OVER (PARTITION BY category_name) AS BIGINT)
    AS category_app_ct, CAST(SUM(app_ct) OVER () AS BIGINT) AS total_app_ct,
    {div('app_ct', 'SUM(app_ct) OVER (PARTITION BY category_name)')}
    AS category_app_share, {div('app_ct', 'SUM(app_ct) OVER ()')} AS total_app_share
  FROM (SELECT category_name, inapp_content_type,
      COUNT(DISTINCT parent_app_content_id) AS app_ct, COUNT(DISTINCT content_id) AS content_ct
    FROM app_df WHERE category_name IS NOT NULL AND inapp_content_type IS NOT NULL GROUP BY ALL)"""

DAILY_APPS = "COUNT(DISTINCT parent_app_content_id) AS active_unique_app,"

BOTH = f"""SELECT transaction_device_name, total_revenue, CAST(n AS DOUBLE) AS total_transaction_ct,
    both_transaction_ct, {div('total_revenue', 'n')} AS avg_transaction_amt,
    {div('total_revenue', 'both_transaction_ct')} AS both_avg_transaction_amt,
    {div('n', 'SUM(n) OVER ()')} AS transaction_share,
    {div('total_revenue', 'CAST(SUM(exact) OVER () AS DOUBLE)')} AS revenue_share,
    {div(div('total_revenue', 'n'), f"MIN({div('total_revenue', 'n')}) OVER ()")}
      AS avg_transaction_amt_index
  FROM (SELECT transaction_device_name, SUM(price) FILTER (app_device_name = 'Both') AS exact,
      CAST(COALESCE(SUM(price) FILTER (app_device_name = 'Both'), 0) AS DOUBLE) AS total_revenue,
      COUNT(*) AS n, COUNT(*) FILTER (app_device_name = 'Both') AS both_transaction_ct
    FROM final WHERE transaction_device_name IS NOT NULL GROUP BY ALL)
  WHERE both_transaction_ct > 0"""

TENURE_PERFORMANCE = filled_tenure(
    f"""COUNT(DISTINCT acct_id) AS acct_ct, {SUM} AS revenue, SUM(price) AS exact,
      CAST(SUM(free_transaction_flag) AS BIGINT) AS free_transaction_ct,
      COUNT(*) AS transaction_ct""",
    ["acct_ct", "revenue", "exact", "free_transaction_ct", "transaction_ct"],
    tail=f"""tenure_band, acct_ct, revenue, free_transaction_ct, transaction_ct,
      {div('free_transaction_ct', 'acct_ct')} AS avg_free_transaction_ct,
      {div('transaction_ct', 'acct_ct')} AS avg_transaction_ct,
      {div('revenue', 'acct_ct')} AS avg_revenue_amount,
      {div(div('revenue', 'acct_ct'), div('transaction_ct', 'acct_ct'))} AS avg_transaction_amount,
      1 - {div(div('free_transaction_ct', 'acct_ct'), div('transaction_ct', 'acct_ct'))}
        AS paid_transaction_rate,
      {div('transaction_ct', 'SUM(transaction_ct) OVER ()')} AS transaction_share,
      {div('free_transaction_ct', 'SUM(free_transaction_ct) OVER ()')} AS free_transaction_share,
      {div('revenue', 'CAST(SUM(exact) OVER () AS DOUBLE)')} AS revenue_share""",
)

WEEK_ACCOUNTS = f"""SELECT acct_id, account_create_dt, payment_type,
    CASE WHEN total_txn IS NOT NULL THEN DATE '2016-09-12' END AS first_day_of_the_week,
    COALESCE(total_revenue, 0) AS total_revenue, COALESCE(total_txn, 0) AS total_txn,
    CASE WHEN total_revenue > 0 THEN 'Purchased Paid App' WHEN total_txn IS NULL THEN 'Dormant'
      ELSE 'Free Only' END AS paid_acct_flag,
    CASE WHEN COALESCE(total_txn, 0) = 0 THEN 'Dormant' ELSE 'Active' END AS no_txn_flag
  FROM account_dim LEFT JOIN (SELECT acct_id, {SUM} AS total_revenue, COUNT(*) AS total_txn
    FROM final WHERE first_day_of_the_week = DATE '2016-09-12' GROUP BY acct_id) USING (acct_id)"""

PIVOT = "SELECT first_day_of_the_week, " + ", ".join(
    f"CAST(SUM(1) FILTER (category_name = '{name}') AS BIGINT) AS {column}"
    for name, column in CATEGORY_NAMES.items()
) + """ FROM final WHERE first_day_of_the_week <> DATE '2016-08-22' AND category_name IS NOT NULL
  GROUP BY ALL"""

LAST_WEEK = "first_day_of_the_week = DATE '2016-09-12'"

FACT_QUERIES = {
    "app_dimension": "SELECT * FROM app_df",
    "transaction_fact": "SELECT * FROM txn_fact",
    "final_fact": "SELECT * FROM final",
    "distinct_by_day": "SELECT * FROM dedup",
    "week_top_sales": f"""SELECT *, CAST(rank() OVER (PARTITION BY first_day_of_the_week, category_name
        ORDER BY app_weekly_sales DESC) AS INTEGER) AS sales_rank
      FROM (SELECT first_day_of_the_week, app_name, category_name, {SUM} AS app_weekly_sales,
        COUNT(DISTINCT acct_id) AS app_active_acct_ct, COUNT(*) AS app_weekly_transaction_ct
        FROM final WHERE app_name IS NOT NULL AND category_name IS NOT NULL
          AND first_day_of_the_week IS NOT NULL GROUP BY ALL) QUALIFY sales_rank <= 5""",
    "day_top_apps": f"""SELECT *, CAST(rank() OVER (PARTITION BY transaction_dt
        ORDER BY revenue_by_app DESC) AS INTEGER) AS revenue_rank
      FROM (SELECT transaction_dt, parent_app_content_id, app_name, {SUM} AS revenue_by_app,
        COUNT(*) AS txn_by_app FROM final WHERE transaction_dt IS NOT NULL
          AND parent_app_content_id IS NOT NULL AND app_name IS NOT NULL GROUP BY ALL)
      QUALIFY revenue_rank <= 3""",
    "final_by_account": "SELECT * FROM final",
    "revenue_by_account_category": "SELECT * FROM per_category",
    "account_summary": "SELECT * FROM account_summary",
    "account_summary_recut": RECUT,
    "outlier_accounts": """SELECT acct_id, total_revenue > 900 AS above_revenue,
      total_txn > 120 AS above_transactions FROM account_summary
      WHERE total_revenue > 900 OR total_txn > 120""",
    "extreme_accounts": """SELECT * FROM account_summary
      WHERE total_revenue = (SELECT MAX(total_revenue) FROM account_summary)
        OR total_txn = (SELECT MAX(total_txn) FROM account_summary)""",
    "active_share": share(
        "account_summary", "no_txn_flag", "COUNT(DISTINCT acct_id)", "no_txn_acct_ct", "acct_share"
    ),
    "paid_share": share(
        "account_summary", "paid_acct_flag", "COUNT(DISTINCT acct_id)", "paid_acct_ct", "acct_share"
    ),
    "spend_histogram": histogram("total_revenue", 40),
    "spend_histogram_buyers": histogram("total_revenue", 40, "total_revenue <> 0"),
    "spend_histogram_low": histogram("total_revenue", 40, "total_revenue <> 0", (0, 2000)),
    "spend_histogram_within": histogram("total_revenue", 30, "total_revenue <> 0", (0, 900)),
    "txn_histogram": histogram("total_txn", 40),
    "txn_histogram_active": histogram("total_txn", 40, "total_txn <> 0"),
    "txn_histogram_low": histogram("total_txn", 40, "total_txn <> 0", (0, 400)),
    "txn_histogram_within": histogram("total_txn", 30, "total_txn <> 0", (0, 120)),
    "transaction_statistics": describe("txn_fact", ["price", "category_id"]),
    "account_statistics": describe("account_summary", SUMMARY_MEASURES),
    "final_statistics": describe(
        "final", ["price", "transaction_device_id", "category_id", "app_device_id",
                  "paid_acct_flag", "transaction_year", "transaction_month",
                  "transaction_weekday", "transaction_week", "acct_tenure_days",
                  "acct_tenure_months", "acct_tenure_years", "transaction_without_acct",
                  "free_transaction_flag"]
    ),
    "trimmed_summary": describe("account_summary", SUMMARY_MEASURES, WITHIN),
    "trimmed_summary_active": describe(
        "account_summary", SUMMARY_MEASURES, WITHIN + " AND total_txn <> 0"
    ),
    "tenure_by_payment": account_bands("payment_type"),
    "tenure_by_group": account_bands("acct_txn_group"),
    "activity_by_payment": account_counts("payment_type", "no_txn_flag"),
    "payment_by_group": account_counts("acct_txn_group", "payment_type"),
    "mean_tenure_by_group": f"""SELECT acct_txn_group,
      {years(div('SUM(acct_tenure_days)', 'COUNT(acct_tenure_days)'))} AS mean_tenure_years
      FROM account_summary WHERE acct_txn_group IS NOT NULL GROUP BY acct_txn_group""",
    "txn_by_month": value_counts("transaction_year_month"),
    "txn_by_price_band": value_counts("price_band"),
    "txn_by_tenure": filled_tenure("COUNT(*) AS transaction_ct", ["transaction_ct"]),
    "paid_txn_by_tenure": filled_tenure(
        "COUNT(*) AS transaction_ct", ["transaction_ct"], "free_transaction_flag <> 1"
    ),
    "tenure_activity": filled_tenure(
        "COUNT(DISTINCT acct_id) AS acct_ct, COUNT(*) AS txn", ["acct_ct", "txn"],
        tail=f"*, {div('txn', 'acct_ct')} AS avg_txn",
    ),
    "txn_group_summary": f"""SELECT *, {div('total_revenue', 'acct_ct')} AS avg_revenue,
        {div('total_txn', 'acct_ct')} AS avg_txn
      FROM (SELECT acct_txn_group, COUNT(DISTINCT acct_id) AS acct_ct, {SUM} AS total_revenue,
        COUNT(*) AS total_txn FROM final WHERE acct_txn_group IS NOT NULL GROUP BY ALL)""",
    "performance_daily": daily("transaction_dt", "TRUE", DAILY_APPS),
    "performance_daily_category": daily(
        "transaction_dt, category_name", "category_name IS NOT NULL"
    ),
    "day_app_leaders": f"""SELECT * FROM ({DAY_APPS}) ORDER BY revenue_by_app DESC, txn_by_app DESC,
      parent_app_content_id, app_name LIMIT 5""",
    "daily_app_performance": DAILY_APP,
    "day_movers_txn": movers("txn"),
    "day_movers_revenue": movers("revenue"),
    "performance_weekday_overall": f"""SELECT *,
        {div('total_transaction_ct', 'active_days')} AS avg_daily_transaction_ct,
        {div('total_sales', 'active_days')} AS avg_daily_sales
      FROM (SELECT transaction_weekday, transaction_weekday_nm, {SUM} AS total_sales,
        COUNT(DISTINCT acct_id) AS purchased_acct_ct,
        COUNT(DISTINCT parent_app_content_id) AS purchased_unique_app,
        COUNT(DISTINCT transaction_dt) AS active_days, COUNT(*) AS total_transaction_ct
        FROM final GROUP BY ALL)""",
    "week_account_activity": WEEK_ACCOUNTS,
    "week_paid_share": share(
        f"({WEEK_ACCOUNTS})", "paid_acct_flag", "COUNT(DISTINCT acct_id)", "paid_acct_ct",
        "acct_share",
    ),
    "performance_week": weekly(),
    "performance_week_category": weekly("category_name"),
    "week_category_pivot": PIVOT,
    "performance_weekday": WEEKDAY,
    "week_snapshot_category": f"""SELECT category_name, weekly_sales_increase_rate,
      weekly_transaction_ct_increase_rate FROM ({weekly('category_name')}) WHERE {LAST_WEEK}""",
    "week_snapshot_weekday": f"""SELECT transaction_weekday_nm, wow_sales_increase_rate,
      wow_transaction_ct_increase_rate, wow_active_acct_ct FROM ({WEEKDAY}) WHERE {LAST_WEEK}""",
    "latest_category_weeks": f"""SELECT * FROM ({weekly('category_name')})
      ORDER BY first_day_of_the_week DESC, category_name DESC LIMIT 15""",
    "app_week": APP_WEEK,
    "week_leaders": without_latest(
        leaders("app_weekly_sales_rank", "app_weekly_transaction_ct_rank")
    ),
    "category_leaders": without_latest(
        leaders("app_weekly_sales_rank_category", "app_weekly_transaction_ct_rank_category")
    ),
    "category_leaders_games": without_latest(
        leaders("app_weekly_sales_rank_category", "app_weekly_transaction_ct_rank_category",
                "category_name = 'Games'")
    ),
    "performance_month": monthly("TRUE"),
    "performance_month_without_spike": monthly("transaction_dt <> DATE '2016-07-04'"),
    "category_summary": amounts("category_name"),
    "txn_by_category": share(
        "final", "category_name", "COUNT(*)", "transaction_ct", "transaction_share"
    ),
    "device_summary": amounts("transaction_device_name"),
    "apps_by_device": """SELECT app_device_name, COUNT(DISTINCT parent_app_content_id) AS app_ct,
      COUNT(*) AS row_ct, CAST(COUNT(DISTINCT parent_app_content_id) AS DOUBLE)
        / SUM(COUNT(DISTINCT parent_app_content_id)) OVER () AS app_share
      FROM app_df WHERE app_device_name IS NOT NULL GROUP BY ALL""",
    "device_summary_both": BOTH,
    "accounts_by_payment_and_paid": """SELECT *, CAST(no_txn_acct_ct AS DOUBLE)
        / SUM(no_txn_acct_ct) OVER (PARTITION BY payment_type) AS acct_share
      FROM (SELECT payment_type, paid_acct_flag, COUNT(DISTINCT acct_id) AS no_txn_acct_ct
      FROM account_summary WHERE acct_id NOT IN (SELECT acct_id FROM outliers) AND payment_type IS NOT NULL
      GROUP BY ALL)""",
    "txn_by_payment": value_counts("payment_type"),
    "payment_summary": f"""SELECT payment_type, {PAYMENT_MEASURES} FROM account_summary
      WHERE payment_type IS NOT NULL GROUP BY ALL""",
    "payment_paid_summary": f"""SELECT payment_type, paid_acct_flag, {PAYMENT_MEASURES}
      FROM account_summary WHERE payment_type IS NOT NULL GROUP BY ALL""",
    "app_content_summary": CONTENT_SHARE,
    "subscription_transactions": """SELECT app_name, content_id, category_name,
      parent_app_content_id, inapp_content_type, acct_id, price, transaction_year_month,
      transaction_dt FROM subscription""",
    "subscription_summary": by_type("inapp_content_type"),
    "subscription_content": CONTENT,
    "least_bought_contents": f"""SELECT * FROM ({CONTENT})
      ORDER BY transaction_ct, content_id, inapp_content_type LIMIT 5""",
    "txn_by_content_type": value_counts("inapp_content_type"),
    "subscription_category": by_type("category_name", "inapp_content_type"),
    "monthly_purchase_matrix": MATRIX,
    "repeat_purchase_by_type": f"""SELECT *,
        {div('acct_content_ct', 'content_ct')} AS avg_purchase_acct_per_content,
        {div('repeat_purchase_acct_ct', 'content_ct')} AS avg_repeat_purchase_acct_per_content
      FROM (SELECT category_name, inapp_content_type, COUNT(acct_id) AS acct_content_ct,
        COUNT(DISTINCT content_id) AS content_ct,
        CAST(SUM(repeat_purchase) AS BIGINT) AS repeat_purchase_acct_ct FROM ({MATRIX})
        WHERE category_name IS NOT NULL AND inapp_content_type IS NOT NULL GROUP BY ALL)""",
    "repeat_by_content_utilities": repeat_content("Utilities"),
    "repeat_purchase_summary": f"""SELECT *,
        {div('repeat_purchase_ct', 'content_ct')} AS avg_repeat_purchase_ct
      FROM (SELECT category_name, COUNT(repeat_purchase) AS repeat_purchase_ct,
        CAST(SUM(repeat_purchase) AS BIGINT) AS repeat_purchase_sum,
        COUNT(DISTINCT content_id) AS content_ct
        FROM (SELECT *, {purchase_flags()} FROM (SELECT acct_id, content_id, category_name,
          {month_columns()} FROM final WHERE acct_id IS NOT NULL AND content_id IS NOT NULL
          AND category_name IS NOT NULL GROUP BY ALL) WHERE {ANY_MONTH}) GROUP BY ALL)""",
    "payment_test": two_sample(
        "SELECT * FROM account_summary", "payment_type", "Free only", "PMOF", "total_txn"
    ),
    "content_test_txn": two_sample(
        CONTENT, "inapp_content_type", "consumable", "subscription", "transaction_ct"
    ),
    "content_test_revenue": two_sample(
        CONTENT, "inapp_content_type", "consumable", "subscription", "total_revenue"
    ),
    **{
        f"repeat_test_{column}": two_sample(
            repeat_content(name), "inapp_content_type", "consumable", "subscription",
            "repeat_purchase_acct_ct",
        )
        for name, column in CATEGORY_NAMES.items()
        if column in ("entertainment", "utilities", "photos_videos")
    },
    "price_days": PRICE_DAYS,
    "regular_price": REGULAR,
    "priced_transactions": PRICED,
    "priced_by_content": PRICED,
    "promotions": f"SELECT * FROM ({PRICED}) WHERE promotion_flag = 1",
    "tenure_performance": TENURE_PERFORMANCE,
    "tenure_price_performance": f"""SELECT tenure_band, price_band, COALESCE(acct_ct, 0) AS acct_ct,
        COALESCE(revenue, 0) AS revenue, COALESCE(transaction_ct, 0) AS transaction_ct,
        {div('revenue', 'transaction_ct')} AS avg_transaction_amount
      FROM {TENURES} CROSS JOIN {PRICES} LEFT JOIN (SELECT tenure_band, price_band,
        COUNT(DISTINCT acct_id) AS acct_ct, {SUM} AS revenue, COUNT(*) AS transaction_ct
        FROM final GROUP BY ALL) USING (tenure_band, price_band)""",
    "devices_per_account": """SELECT acct_id, COUNT(DISTINCT transaction_device_id) AS device_ct
      FROM final WHERE acct_id IS NOT NULL GROUP BY ALL""",
    "device_count_values": """SELECT DISTINCT device_ct FROM (
      SELECT acct_id, COUNT(DISTINCT transaction_device_id) AS device_ct
      FROM final WHERE acct_id IS NOT NULL GROUP BY ALL)""",
    "content_first_seen": """SELECT parent_app_content_id, app_name, content_id,
      MIN(transaction_dt) AS first_txn_dt FROM final WHERE parent_app_content_id IS NOT NULL
      AND app_name IS NOT NULL AND content_id IS NOT NULL GROUP BY ALL""",
    "content_first_days": """SELECT DISTINCT first_txn_dt FROM (
      SELECT MIN(transaction_dt) AS first_txn_dt FROM final WHERE parent_app_content_id IS NOT NULL
      AND app_name IS NOT NULL AND content_id IS NOT NULL
      GROUP BY parent_app_content_id, app_name, content_id)""",
    "null_report": derived_too(nulls),
    "column_report": derived_too(column_kinds),
    "approximate_distinct": " UNION ALL ".join(
        f"""SELECT '{kind}' AS period_kind, {period} AS period, COUNT(DISTINCT acct_id) AS acct_ct,
          COUNT(DISTINCT parent_app_content_id) AS app_ct, TRUE AS acct_within, TRUE AS app_within
        FROM final WHERE transaction_dt IS NOT NULL GROUP BY ALL"""
        for kind, period in {
            "day": "CAST(transaction_dt AS VARCHAR)", "week": "CAST(first_day_of_the_week AS VARCHAR)",
            "weekday": "transaction_weekday_nm", "month": "transaction_year_month",
        }.items()
    ),
    "price_quantiles": " UNION ALL ".join(
        f"""SELECT transaction_year_month AS period, CAST({share} AS DOUBLE) AS share,
          CAST(quantile_disc(price, {share}) AS DOUBLE) AS exact, TRUE AS within
        FROM final WHERE price IS NOT NULL GROUP BY ALL"""
        for share in (0.25, 0.5, 0.75)
    ),
    "orphan_accounts": """SELECT acct_id, COUNT(*) AS row_ct FROM resolved r
      WHERE NOT EXISTS (SELECT 1 FROM account_role a WHERE a.acct_id = r.acct_id) GROUP BY ALL""",
    "resolution_report": """SELECT CASE WHEN content_id IS NOT NULL THEN 'content'
      WHEN parent_app_content_id IS NOT NULL THEN 'app' ELSE 'unresolved' END AS resolution,
      COUNT(*) AS transaction_ct FROM resolved GROUP BY ALL""",
    "row_count_report": " UNION ALL ".join([
        counts("resolve", "dedup", "resolved"), counts("enrich", "resolved", "txn_fact"),
        counts("account", "account_role", "account_summary"),
    ]),
    "apps_without_content": """SELECT COUNT(DISTINCT parent_app_content_id) AS app_ct FROM app_df
      WHERE content_id IS NULL""",
    "csv_round_trip": daily("transaction_dt", "TRUE", DAILY_APPS),
    "parquet_round_trip": f"SELECT * FROM ({weekly('category_name')})",
}

ROLE_QUERIES = {
    "duplicate_report": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, * FROM ({duplicates(n + '_role', c)})"
        for n, c in ROLE_COLUMNS.items()
    ),
    "ambiguous_app_names": """SELECT app_name, COUNT(DISTINCT content_id) AS app_ct FROM app_role
      GROUP BY app_name HAVING COUNT(DISTINCT content_id) > 1""",
    "transaction_period": """SELECT MIN(create_dt) AS period_start, MAX(create_dt) AS period_end,
      COUNT(DISTINCT create_dt) AS days_seen,
      CAST(date_diff('day', MIN(create_dt), MAX(create_dt)) AS INTEGER) AS period_days,
      date_diff('day', MIN(create_dt), MAX(create_dt)) + 1 - COUNT(DISTINCT create_dt)
        AS missing_days,
      date_diff('day', MIN(create_dt), MAX(create_dt)) / CAST(365 AS DOUBLE) AS period_ratio
      FROM transaction_role""",
    "input_cardinalities": " UNION ALL ".join([
        cardinality("app", "content_id"), cardinality("app", "app_name"),
        cardinality("inapp", "parent_app_content_id"), cardinality("inapp", "content_id"),
        cardinality("inapp", "type"), cardinality("category", "category_name"),
        cardinality("device", "device_name"),
    ]),
    "device_names": "SELECT DISTINCT device_name FROM device_role",
    "category_names": "SELECT DISTINCT category_name FROM category_role",
    "content_types": "SELECT DISTINCT type FROM inapp_role",
    "csv_input_round_trip": "SELECT * FROM transaction_role",
}


def all_sql() -> dict[str, str]:
    return {
        **{name: with_facts(text) for name, text in FACT_QUERIES.items()},
        **{name: with_roles(text) for name, text in ROLE_QUERIES.items()},
    }
