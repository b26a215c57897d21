"""Common table expressions: the six roles, the facts and the account tables."""

from __future__ import annotations

TENURE = """CASE WHEN {m} <= 0 THEN '{first}' WHEN {m} <= 1 THEN '1 month'
  WHEN {m} <= 6 THEN '2- 6 months' WHEN {m} <= 12 THEN '6 months - 1 year'
  WHEN {m} <= 36 THEN '1- 3 years' WHEN {m} <= 60 THEN '3 - 5 years' ELSE '5 years+' END"""


def months(days: str) -> str:
    return f"(CAST({days} AS DOUBLE) / CAST(30.436875 AS DOUBLE))"


def years(days: str) -> str:
    return f"(CAST({days} AS DOUBLE) / CAST(365.2425 AS DOUBLE))"


def tenure(days: str, low: str, high: str, first: str = "no account") -> str:
    """Band of ``days``; outside (low, high] there is none."""
    label = TENURE.format(m=months(days), first=first)
    return f"CASE WHEN {days} > {low} AND {days} <= {high} THEN {label} END"


ROLES = """
sold AS (
  SELECT *, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS buyer,
    l_returnflag = 'R' AND l_tax <= 0.02 AS is_app,
    l_returnflag = 'N' AND l_tax >= 0.07 AS is_withdrawn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
stepped AS (
  SELECT *, ((CASE WHEN is_app THEN l_suppkey ELSE l_partkey END) * 13) % 24 AS step FROM sold),
purchase AS (
  SELECT DATE '2016-06-01' + CAST(FLOOR(
      date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 22) AS INTEGER) AS create_dt,
    CASE WHEN is_app THEN 'app-' || l_suppkey WHEN is_withdrawn THEN 'gone-' || l_partkey
      ELSE 'item-' || l_partkey END AS content_id,
    (CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'guest-' ELSE 'acct-' END)
      || buyer AS acct_id,
    CAST((CASE WHEN (buyer * 31) % 10 < 3 THEN 0
      WHEN step < 8 OR l_discount = 0 THEN 0
      WHEN l_discount >= 0.09 THEN FLOOR((step * 100 + 99) * 4 / 5)
      ELSE step * 100 + 99 END) / 100.0 AS DECIMAL(12,2)) AS price,
    CAST(l_linenumber % 2 + 1 AS INTEGER) AS device_id,
    l_tax = 0.05 AND l_discount = 0.05 AS twice
  FROM stepped),
transaction_role AS (
  SELECT * EXCLUDE (twice) FROM purchase
  UNION ALL SELECT * EXCLUDE (twice) FROM purchase WHERE twice),
account_role AS (
  SELECT 'acct-' || c_custkey AS acct_id,
    DATE '2016-10-15' - CAST((c_custkey * 37) % 2500 AS INTEGER) AS create_dt,
    CASE WHEN c_acctbal < -900 THEN NULL
      WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Free only' ELSE 'PMOF' END
      AS payment_type
  FROM customer),
app_role AS (
  SELECT 'app-' || s_suppkey AS content_id,
    '  studio ' || s_nationkey || 'b: pro-kit ' || (s_suppkey % 7) || 'x (hd) ' AS app_name,
    n_regionkey AS category_id, CAST(s_suppkey % 3 + 1 AS INTEGER) AS device_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
inapp_role AS (
  SELECT CASE WHEN p_brand = 'Brand#13' AND p_size > 40 THEN 'pulled-' || p_size
      ELSE 'app-' || (p_partkey // 25) END AS parent_app_content_id,
    'item-' || p_partkey AS content_id,
    CASE WHEN p_size % 2 = 0 THEN 'subscription' ELSE 'consumable' END AS type
  FROM part),
category_role AS (
  SELECT r_regionkey AS category_id,
    CASE r_regionkey WHEN 0 THEN 'Entertainment' WHEN 1 THEN 'Games' WHEN 2 THEN 'Photos & Videos'
      WHEN 3 THEN 'Social Networking' WHEN 4 THEN 'Utilities' END AS category_name
  FROM region),
device_role(device_id, device_name) AS (VALUES (1, 'Phone'), (2, 'Tablet'), (3, 'Both'))
"""

# The names hold ASCII letters, digits and spaces once cleaned; words start after any non-letter.
FACTS = f"""
app_df AS (
  SELECT parent_app_content_id,
    list_aggregate(list_transform(
      regexp_extract_all(trim(regexp_replace(app_name, '^\\s+|;|-|,|:|\\)|\\(', '', 'g')),
        '[A-Za-z]+|[^A-Za-z]+'),
      lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS app_name,
    category_id, category_name, device_id AS app_device_id, device_name AS app_device_name,
    content_id, inapp_content_type, COALESCE(content_id, parent_app_content_id)
      AS content_id_modified
  FROM (
    SELECT COALESCE(a.content_id, i.parent_app_content_id) AS parent_app_content_id, a.app_name,
      a.category_id, a.device_id, i.content_id, i.type AS inapp_content_type
    FROM app_role a FULL OUTER JOIN inapp_role i ON a.content_id = i.parent_app_content_id)
  LEFT JOIN category_role USING (category_id) LEFT JOIN device_role USING (device_id)),
dedup AS (
  SELECT DISTINCT create_dt AS transaction_dt, content_id AS transaction_content_id, acct_id, price,
    device_id AS transaction_device_id FROM transaction_role),
app_rows AS (
  SELECT DISTINCT parent_app_content_id, app_name, category_id, category_name, app_device_id,
    app_device_name FROM app_df),
first_try AS (
  SELECT d.*, m.parent_app_content_id AS direct_parent, m.app_name AS direct_name,
    m.category_id AS direct_category, m.category_name AS direct_category_name,
    m.app_device_id AS direct_device, m.app_device_name AS direct_device_name
  FROM dedup d LEFT JOIN app_df m ON d.transaction_content_id = m.content_id_modified),
resolved AS (
  SELECT t.transaction_dt, t.transaction_content_id, t.acct_id, t.price, t.transaction_device_id,
    COALESCE(direct_name, r.app_name) AS app_name,
    COALESCE(direct_parent, r.parent_app_content_id) AS parent_app_content_id,
    COALESCE(direct_category, r.category_id) AS category_id,
    COALESCE(direct_category_name, r.category_name) AS category_name,
    COALESCE(direct_device, r.app_device_id) AS app_device_id,
    COALESCE(direct_device_name, r.app_device_name) AS app_device_name,
    c.content_id, c.inapp_content_type, device_name AS transaction_device_name
  FROM first_try t
  LEFT JOIN app_rows r ON direct_parent IS NULL AND t.transaction_content_id = r.parent_app_content_id
  LEFT JOIN app_df c ON t.transaction_content_id = c.content_id
  LEFT JOIN device_role ON t.transaction_device_id = device_role.device_id),
account_dim AS (SELECT acct_id, create_dt AS account_create_dt, payment_type FROM account_role),
txn_fact AS (
  SELECT r.*, account_create_dt, payment_type FROM resolved r LEFT JOIN account_dim USING (acct_id)),
per_account AS (
  SELECT acct_id,
    CAST(SUM(price) AS DOUBLE) AS total_revenue, COUNT(*) AS total_txn FROM txn_fact
  WHERE acct_id IS NOT NULL GROUP BY acct_id),
per_category AS (
  SELECT acct_id,
    CAST(COALESCE(SUM(price) FILTER (category_name = 'Entertainment'), 0) AS DOUBLE)
      AS entertainment_revenue,
    CAST(COALESCE(SUM(price) FILTER (category_name = 'Games'), 0) AS DOUBLE) AS games_revenue,
    CAST(COALESCE(SUM(price) FILTER (category_name = 'Photos & Videos'), 0) AS DOUBLE)
      AS photos_videos_revenue,
    CAST(COALESCE(SUM(price) FILTER (category_name = 'Social Networking'), 0) AS DOUBLE)
      AS social_networking_revenue,
    CAST(COALESCE(SUM(price) FILTER (category_name = 'Utilities'), 0) AS DOUBLE)
      AS utilities_revenue
  FROM txn_fact WHERE acct_id IS NOT NULL AND category_name IS NOT NULL GROUP BY acct_id),
raw_summary AS (
  SELECT a.acct_id, account_create_dt, payment_type,
    COALESCE(entertainment_revenue, 0) AS entertainment_revenue,
    COALESCE(games_revenue, 0) AS games_revenue,
    COALESCE(photos_videos_revenue, 0) AS photos_videos_revenue,
    COALESCE(social_networking_revenue, 0) AS social_networking_revenue,
    COALESCE(utilities_revenue, 0) AS utilities_revenue,
    COALESCE(total_revenue, 0) AS total_revenue, COALESCE(total_txn, 0) AS total_txn,
    CASE WHEN total_txn IS NULL THEN 'Dormant' WHEN total_revenue > 0 THEN 'Purchased Paid App'
      ELSE 'Free Only' END AS paid_acct_flag,
    CASE WHEN COALESCE(total_txn, 0) = 0 THEN 'Dormant' ELSE 'Active' END AS no_txn_flag,
    total_revenue / NULLIF(total_txn, 0) AS avg_spend_amount,
    CAST(date_diff('day', account_create_dt, (SELECT MAX(transaction_dt) FROM dedup)) AS INTEGER)
      AS acct_tenure_days
  FROM account_dim a LEFT JOIN per_category USING (acct_id) LEFT JOIN per_account USING (acct_id)),
account_summary AS (
  SELECT *, {months('acct_tenure_days')} AS acct_tenure_months,
    {years('acct_tenure_days')} AS acct_tenure_years,
    {tenure('acct_tenure_days', 'MIN(acct_tenure_days) OVER ()', 'MAX(acct_tenure_days) OVER ()')}
      AS tenure_band,
    CASE WHEN paid_acct_flag = 'Dormant' THEN 'Dormant' WHEN total_txn <= 40 THEN 'Low'
      ELSE 'High' END AS acct_txn_group
  FROM raw_summary),
outliers AS (
  SELECT acct_id FROM account_summary WHERE total_revenue > 900 OR total_txn > 120),
kept_fact AS (
  SELECT f.*, s.acct_txn_group,
    CAST(date_diff('day', f.account_create_dt, f.transaction_dt) AS INTEGER) AS acct_tenure_days,
    SUM(price) OVER (PARTITION BY f.acct_id) AS acct_price
  FROM txn_fact f LEFT JOIN account_summary s USING (acct_id)
  WHERE NOT EXISTS (SELECT 1 FROM outliers o WHERE o.acct_id = f.acct_id)),
final AS (
  SELECT * EXCLUDE (acct_price),
    CASE WHEN acct_id IS NOT NULL AND acct_price > 0 THEN 1 ELSE 0 END AS paid_acct_flag,
    strftime(transaction_dt, '%Y-%m') AS transaction_year_month,
    CAST(year(transaction_dt) AS INTEGER) AS transaction_year,
    CAST(month(transaction_dt) AS INTEGER) AS transaction_month,
    CAST(isodow(transaction_dt) - 1 AS INTEGER) AS transaction_weekday,
    dayname(transaction_dt) AS transaction_weekday_nm,
    CAST(weekofyear(transaction_dt) AS INTEGER) AS transaction_week,
    CAST(date_trunc('week', transaction_dt) AS DATE) AS first_day_of_the_week,
    {months('acct_tenure_days')} AS acct_tenure_months,
    {years('acct_tenure_days')} AS acct_tenure_years,
    {tenure('acct_tenure_days', 'MIN(acct_tenure_days) OVER ()', 'MAX(acct_tenure_days) OVER ()')}
      AS tenure_band,
    CASE WHEN transaction_dt < account_create_dt THEN 1 ELSE 0 END AS transaction_without_acct,
    CASE WHEN price = 0 THEN 1 ELSE 0 END AS free_transaction_flag,
    CASE WHEN price IS NULL OR price <= 0.0001 THEN 'free' WHEN price <= 5 THEN 'below $ 5'
      WHEN price <= 10 THEN '$ 5-10' WHEN price <= 20 THEN '$ 10-20' ELSE '$20+' END AS price_band
  FROM kept_fact),
subscription AS (
  SELECT * FROM final WHERE category_name IS DISTINCT FROM 'Games'
    AND category_name IS DISTINCT FROM 'Social Networking')
"""


def with_facts(select: str) -> str:
    return f"WITH {ROLES.strip()},{FACTS.strip()}\n{select.strip()}"


def with_roles(select: str) -> str:
    return f"WITH {ROLES.strip()}\n{select.strip()}"
