"""The registered queries as SQL on the star-schema tables, for an independent engine.

Written from the rules, without order documents: lines come straight from `lineitem`, so a match
also shows that documents are written and read back whole.
"""

from __future__ import annotations

from cohortry.operators.personas import ACTION_COLUMNS, ACTIONS, PERSONA_COLUMNS, PERSONAS

MONEY = "CAST(FLOOR(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)"


def _values(rows) -> str:
    def cell(x):
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def _avg(column: str, digits: int = 0) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"FLOOR(AVG({column}) * {scale} + 0.5) / {scale}"


def _pct(part: str, whole: str) -> str:
    return f"CAST({part} * 100 AS DOUBLE) / CAST({whole} AS DOUBLE)"


SOURCES = f"""
t_users AS (
  SELECT c_custkey AS id, lower(c_name) || '@example.test' AS email,
         c_mktsegment AS created_from, s.created_at, s.last_login,
         c_acctbal > 0 AS is_certified, c_custkey % 50 = 0 AS is_withdrawn,
         c_custkey % 50 <> 0 AS is_active
  FROM customer LEFT JOIN (
    SELECT o_custkey, min(o_orderdate) AS created_at,
           max(o_orderdate + CAST(o_orderkey % 24 AS INTEGER) * INTERVAL 1 HOUR) AS last_login
    FROM orders GROUP BY o_custkey) s ON o_custkey = c_custkey
),
t_info AS (
  SELECT c_custkey AS user_id, n_name AS country_code, c_custkey % 2 AS gender_type,
         DATE '1980-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS birth
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  WHERE c_custkey % 10 <> 0
),
t_mart AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderkey AS order_no,
         {MONEY} AS total_revenue, 'E' || l_suppkey AS event_id,
         CAST(l_partkey AS VARCHAR) AS option_code, CAST(l_quantity AS BIGINT) AS order_qty,
         p_brand AS ip_name,
         CASE o_orderstatus WHEN 'F' THEN 'B2C' WHEN 'O' THEN 'B2B' ELSE 'ETC' END AS market_type,
         CASE WHEN o_orderpriority < '4' THEN 'new' ELSE 'old' END AS data_source,
         CAST(o_orderdate AS DATE) AS pay_date
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
),
t_events AS (
  SELECT 'E' || s_suppkey AS event_id,
         CASE WHEN s_suppkey % 20 <> 0 THEN s_suppkey % 25 END AS artist_id,
         'A' || (s_suppkey % 7) AS album_name
  FROM supplier
),
t_orders AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'B' ELSE 'C' END || o_orderkey AS order_number,
         o_orderkey % 12 AS order_status,
         CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PARTIAL_CANCELED' END
           AS payment_status,
         CASE WHEN o_orderkey % 2 = 0 THEN 'CONFIRMED' ELSE 'CANCELED' END AS document_status,
         o_orderpriority || '|' || o_orderstatus AS address, 'K' || (o_orderkey % 5) AS code
  FROM orders
),
t_wins AS (
  SELECT CASE WHEN event_id % 10 = 0 THEN '-1' ELSE CAST(o_custkey AS VARCHAR) END AS winner,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'B' ELSE 'C' END || o_orderkey AS order_number
  FROM events JOIN orders ON o_orderkey = event_id
  WHERE event_type = 'purchase' AND value > 150
),
t_items AS (
  SELECT DISTINCT 'E' || l_suppkey AS event_id, CAST(l_partkey AS VARCHAR) AS option_code,
         l_partkey, 'S' || l_partkey || suffix AS sku_code
  FROM lineitem, (VALUES (''), ('x')) AS s(suffix)
  WHERE l_partkey % 13 <> 0 AND (suffix = '' OR l_partkey % 5 = 0)
),
t_skus AS (
  SELECT 'S' || p_partkey AS sku_code,
         CASE p_type WHEN 'PROMO' THEN 'C' WHEN 'SMALL' THEN NULL ELSE 'P' END AS sku_type,
         CAST(CASE WHEN p_type = 'STANDARD' THEN 0 ELSE p_size END AS BIGINT) AS vc
  FROM part
  UNION ALL
  SELECT 'S' || p_partkey || 'x', 'P', CAST(p_size + 1 AS BIGINT) FROM part WHERE p_partkey % 5 = 0
)"""

RELATIONS = """
shared_address AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM (
    SELECT user_id, address FROM t_orders
    WHERE payment_status IN ('CONFIRMED', 'PARTIAL_CANCELED')
    GROUP BY user_id, address HAVING count(DISTINCT code) >= 3)
),
multi_artist AS (
  SELECT user_id FROM t_mart JOIN t_events USING (event_id)
  WHERE market_type = 'B2C' AND pay_date >= DATE '2001-01-01'
  GROUP BY user_id HAVING count(DISTINCT artist_id) >= 2
),
agents AS (SELECT user_id FROM shared_address INTERSECT SELECT user_id FROM multi_artist),
excluded AS (
  SELECT user_id FROM agents
  UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 97 = 0
),
recent AS (
  SELECT CAST(id AS VARCHAR) AS user_id,
         CAST(DATE '2001-09-01' - CAST(last_login + INTERVAL 9 HOUR AS DATE) AS BIGINT) AS r_raw
  FROM t_users WHERE last_login IS NOT NULL AND is_certified AND NOT is_withdrawn
),
eligible AS (
  SELECT user_id, order_no, total_revenue, event_id, artist_id, album_name
  FROM t_mart LEFT JOIN t_events USING (event_id)
  WHERE market_type IN ('B2C', 'B2B') AND data_source = 'new'
    AND user_id NOT IN (SELECT user_id FROM excluded)
),
freq AS (
  SELECT user_id, count(DISTINCT artist_id || '||' || album_name) AS total_rounds,
         count(DISTINCT artist_id) AS total_artists,
         CAST(count(DISTINCT artist_id || '||' || album_name) AS DOUBLE)
           / count(DISTINCT artist_id) AS f_raw
  FROM eligible WHERE artist_id IS NOT NULL AND album_name IS NOT NULL GROUP BY user_id
),
money AS (
  SELECT user_id, CAST(sum(total_revenue) AS BIGINT) AS m_raw FROM eligible GROUP BY user_id
),
base AS (
  SELECT user_id, r_raw, coalesce(f_raw, 0) AS f_raw, coalesce(m_raw, 0) AS m_raw,
         coalesce(total_rounds, 0) AS total_rounds, coalesce(total_artists, 0) AS total_artists
  FROM recent LEFT JOIN freq USING (user_id) LEFT JOIN money USING (user_id)
),
score AS (
  SELECT *, r_score + f_score + m_score AS rfm_total_raw FROM (
    SELECT *, 6 - ntile(5) OVER (ORDER BY r_raw, user_id) AS r_score,
           ntile(5) OVER (ORDER BY f_raw, user_id) AS f_score,
           ntile(5) OVER (ORDER BY m_raw, user_id) AS m_score
    FROM base WHERE m_raw > 0)
),
won AS (
  SELECT DISTINCT CAST(o.user_id AS VARCHAR) AS user_id
  FROM t_wins w JOIN t_orders o USING (order_number) WHERE winner <> '-1'
),
lines AS (
  SELECT id AS order_id, user_id, order_status,
         coalesce(payment_status, document_status) AS payment_status,
         left(order_number, 1) AS order_no_prefix, l_suppkey AS offer_id,
         'E' || l_suppkey AS offer_code, l_partkey AS option_id,
         CAST(l_quantity AS BIGINT) AS order_qty, """ + MONEY + """ AS total_revenue
  FROM lineitem JOIN t_orders ON id = l_orderkey WHERE l_returnflag = 'R'
),
offers AS (
  SELECT s_suppkey AS offer_id,
         CASE WHEN s_suppkey % 20 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'F_FUNDING'
              WHEN s_suppkey % 3 = 1 THEN 'P_POB' ELSE 'S_SHOPPING' END AS offer_type,
         CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 25 END AS artist_id,
         CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % 25 <> 24
              THEN 'Artist ' || (s_suppkey % 25) END AS artist_name
  FROM supplier
),
paid AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, offer_code AS event_id,
         CAST(option_id AS VARCHAR) AS option_code, order_qty, total_revenue,
         offer_type, artist_id, artist_name
  FROM lines LEFT JOIN offers USING (offer_id)
  WHERE (payment_status IN ('CONFIRMED', 'PARTIAL_CANCELED') OR order_status IN (1, 10, 11))
    AND order_status IN (1, 2, 4, 5, 6, 10, 11)
    AND NOT (offer_type = 'S_SHOPPING' AND order_no_prefix = 'B')
),
kept AS (SELECT * FROM paid WHERE user_id NOT IN (SELECT user_id FROM excluded)),
matches AS (SELECT event_id, option_code, sku_type, vc FROM t_items JOIN t_skus USING (sku_code)),
variety AS (
  SELECT event_id, option_code, max(vc) AS vc FROM matches
  WHERE sku_type = 'P' AND vc > 1 GROUP BY ALL
),
tickets AS (
  SELECT DISTINCT event_id, option_code FROM matches
  WHERE sku_type IS NULL OR sku_type = 'C' OR (sku_type = 'P' AND coalesce(vc, 0) = 0)
),
stats AS (
  SELECT user_id, artist_id, event_id, option_code, CAST(sum(order_qty) AS BIGINT) AS total_qty,
         CAST(sum(total_revenue) AS DOUBLE) / nullif(sum(order_qty), 0) AS unit_price, vc,
         CAST(sum(order_qty) AS DOUBLE) / vc AS qty_ratio
  FROM kept JOIN variety USING (event_id, option_code)
  GROUP BY user_id, artist_id, event_id, option_code, vc
),
bulk AS (
  SELECT DISTINCT user_id FROM (
    SELECT user_id FROM kept JOIN tickets USING (event_id, option_code)
    GROUP BY user_id, event_id, option_code HAVING sum(order_qty) >= 45)
),
bought AS (
  SELECT user_id, count(DISTINCT artist_id) AS distinct_artists, max(order_qty) AS max_qty,
         count(*) FILTER (offer_type IN ('P_POB', 'F_FUNDING')) AS event_lines
  FROM kept GROUP BY user_id
),
tiers AS (
  SELECT *, CASE WHEN unit_price >= 600000 THEN CAST(0.2 AS DOUBLE)
                 WHEN unit_price >= 300000 THEN CAST(0.3 AS DOUBLE)
                 ELSE CAST(0.5 AS DOUBLE) END AS threshold
  FROM stats
),
labelled AS (
  SELECT * EXCLUDE (threshold), CASE
      WHEN user_id IN (SELECT user_id FROM won) THEN 'Challenger'
      WHEN user_id IN (SELECT user_id FROM bulk) THEN 'Challenger'
      WHEN qty_ratio > 5.0 THEN 'Challenger'
      WHEN qty_ratio >= threshold THEN 'Poca Collector'
      ELSE 'Beginner' END AS option_label
  FROM tiers
),
by_artist AS (
  SELECT user_id, artist_id, option_label AS artist_label FROM (
    SELECT user_id, artist_id, option_label, count(*) AS n FROM labelled
    WHERE artist_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id, artist_id ORDER BY n DESC,
    list_position(['Challenger', 'Poca Collector', 'Beginner'], option_label)) = 1
),
by_user AS (
  SELECT user_id, artist_label AS user_label FROM (
    SELECT user_id, artist_label, count(*) AS n FROM by_artist GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC,
    list_position(['Challenger', 'Poca Collector', 'Beginner'], artist_label)) = 1
),
final_label AS (
  SELECT b.user_id, CASE
      WHEN user_label = 'Challenger' THEN 'Challenger'
      WHEN b.user_id IN (SELECT user_id FROM won) THEN 'Challenger'
      WHEN b.user_id IN (SELECT user_id FROM bulk) THEN 'Challenger'
      WHEN distinct_artists >= 3 AND max_qty <= 25 THEN 'Album Collector'
      WHEN user_label = 'Poca Collector' THEN 'Poca Collector'
      WHEN event_lines = 0 THEN 'Shopper'
      ELSE 'Beginner' END AS dimension_label
  FROM bought b LEFT JOIN by_user u ON u.user_id = b.user_id
),
main AS (
  SELECT user_id, artist_id AS main_artist_id, artist_name AS main_artist_name,
         CAST(gmv AS BIGINT) AS main_artist_gmv
  FROM (SELECT user_id, artist_id, max(artist_name) AS artist_name, sum(total_revenue) AS gmv
        FROM kept WHERE artist_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gmv DESC, artist_id) = 1
),
dimension AS (SELECT * FROM final_label LEFT JOIN main USING (user_id)),
mart2 AS (
  SELECT t_mart.*, artist_id FROM t_mart LEFT JOIN t_events USING (event_id)
  WHERE market_type = 'B2C' AND data_source = 'new'
    AND user_id NOT IN (SELECT user_id FROM excluded)
),
sku_left AS (
  SELECT event_id, option_code, sku_type, vc FROM t_items LEFT JOIN t_skus USING (sku_code)
),
stats2 AS (
  SELECT user_id, artist_id, event_id, option_code, CAST(sum(order_qty) AS BIGINT) AS total_qty,
         CAST(sum(total_revenue) AS DOUBLE) / nullif(sum(order_qty), 0) AS unit_price,
         max(vc) AS vc, CAST(sum(order_qty) AS DOUBLE) / nullif(max(vc), 0) AS qty_ratio
  FROM mart2 LEFT JOIN sku_left USING (event_id, option_code)
  WHERE sku_type = 'P' AND vc > 1 GROUP BY user_id, artist_id, event_id, option_code
),
bulk2 AS (
  SELECT DISTINCT user_id FROM (
    SELECT user_id FROM mart2 LEFT JOIN sku_left USING (event_id, option_code)
    WHERE sku_type IS NULL OR sku_type = 'C' OR (sku_type = 'P' AND coalesce(vc, 0) = 0)
    GROUP BY user_id, event_id, option_code HAVING sum(order_qty) >= 45)
),
labelled2 AS (
  SELECT user_id, artist_id, CASE
      WHEN user_id IN (SELECT user_id FROM won) THEN 'Challenger'
      WHEN user_id IN (SELECT user_id FROM bulk2) THEN 'Challenger'
      WHEN qty_ratio > 5.0 THEN 'Challenger'
      WHEN qty_ratio >= CASE WHEN unit_price >= 600000 THEN 0.2
                             WHEN unit_price >= 300000 THEN 0.3 ELSE 0.5 END THEN 'Poca Collector'
      ELSE 'Beginner' END AS option_label
  FROM stats2
),
by_artist2 AS (
  SELECT user_id, artist_id, option_label AS artist_label FROM (
    SELECT user_id, artist_id, option_label, count(*) AS n FROM labelled2
    WHERE artist_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id, artist_id ORDER BY n DESC,
    list_position(['Challenger', 'Poca Collector', 'Beginner'], option_label)) = 1
),
by_user2 AS (
  SELECT user_id, artist_label AS user_label FROM (
    SELECT user_id, artist_label, count(*) AS n FROM by_artist2 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC,
    list_position(['Challenger', 'Poca Collector', 'Beginner'], artist_label)) = 1
),
bought2 AS (
  SELECT user_id, count(DISTINCT ip_name) AS distinct_artists, max(order_qty) AS max_qty,
         count(*) FILTER (event_id IS NOT NULL AND event_id <> '') AS event_lines
  FROM mart2 GROUP BY user_id
),
final_label2 AS (
  SELECT b.user_id, CASE
      WHEN user_label = 'Challenger' THEN 'Challenger'
      WHEN b.user_id IN (SELECT user_id FROM won) THEN 'Challenger'
      WHEN b.user_id IN (SELECT user_id FROM bulk2) THEN 'Challenger'
      WHEN distinct_artists >= 3 AND max_qty < 25 THEN 'Album Collector'
      WHEN user_label = 'Poca Collector' THEN 'Poca Collector'
      WHEN event_lines = 0 THEN 'Shopper'
      WHEN user_label IS NULL AND event_lines > 0 THEN 'N/A'
      ELSE 'Beginner' END AS dimension_label
  FROM bought2 b LEFT JOIN by_user2 u ON u.user_id = b.user_id
),
main2 AS (
  SELECT user_id, artist_id AS main_artist_id, artist_name AS main_artist_name,
         CAST(gmv AS BIGINT) AS main_artist_gmv
  FROM (SELECT user_id, artist_id, max(ip_name) AS artist_name, sum(total_revenue) AS gmv
        FROM mart2 WHERE artist_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gmv DESC, artist_id) = 1
),
stats1 AS (
  SELECT user_id, artist_id, event_id, option_code, CAST(sum(order_qty) AS BIGINT) AS total_qty,
         CAST(sum(total_revenue) AS DOUBLE) / nullif(sum(order_qty), 0) AS unit_price,
         coalesce(max(vc), 1) AS vc,
         CAST(sum(order_qty) AS DOUBLE) / nullif(coalesce(max(vc), 1), 0) AS qty_ratio
  FROM t_mart LEFT JOIN t_events USING (event_id)
       LEFT JOIN sku_left USING (event_id, option_code)
  WHERE market_type IN ('B2C', 'B2B') AND data_source = 'new'
    AND (sku_type IS NULL OR sku_type = 'P')
  GROUP BY user_id, artist_id, event_id, option_code
),
labelled1 AS (
  SELECT user_id, artist_id, CASE
      WHEN user_id IN (SELECT user_id FROM won) THEN 'Challenger'
      WHEN qty_ratio > 1.0 THEN 'Challenger'
      WHEN qty_ratio >= CASE WHEN unit_price >= 600000 THEN 0.2
                             WHEN unit_price >= 300000 THEN 0.3 ELSE 0.5 END THEN 'Collector'
      ELSE 'Beginner' END AS option_label
  FROM stats1
),
by_artist1 AS (
  SELECT user_id, artist_id, option_label AS artist_label FROM (
    SELECT user_id, artist_id, option_label, count(*) AS n FROM labelled1
    WHERE artist_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id, artist_id ORDER BY n DESC,
    list_position(['Challenger', 'Collector', 'Beginner'], option_label)) = 1
),
final_label1 AS (
  SELECT user_id, artist_label AS dimension_label FROM (
    SELECT user_id, artist_label, count(*) AS n FROM by_artist1 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC,
    list_position(['Challenger', 'Collector', 'Beginner'], artist_label)) = 1
),
segment AS (
  SELECT user_id, r_raw, f_raw, m_raw, r_score, f_score, m_score, rfm_total_raw AS rfm_total,
         coalesce(dimension_label, 'Beginner') AS dimension_label, main_artist_id,
         main_artist_name, main_artist_gmv, TIMESTAMP '2001-09-01 00:00:00' AS updated_at
  FROM score LEFT JOIN dimension USING (user_id)
),
profile AS (
  SELECT CAST(u.id AS VARCHAR) AS user_id, email, created_from,
         CAST(created_at + INTERVAL 9 HOUR AS DATE) AS signup_date,
         CAST(u.last_login + INTERVAL 9 HOUR AS DATE) AS last_login, birth AS birth_date,
         country_code, gender_type, is_withdrawn, is_active
  FROM t_users u LEFT JOIN t_info i ON i.user_id = u.id WHERE is_certified
),
retail AS (
  SELECT user_id, min(pay_date) AS first_purchase_date, max(pay_date) AS last_purchase_date,
         count(DISTINCT order_no) AS total_orders, CAST(sum(total_revenue) AS DOUBLE) AS total_gmv,
         FLOOR(CAST(sum(total_revenue) AS DOUBLE) / count(DISTINCT order_no) + 0.5)
           AS avg_order_value,
         count(DISTINCT date_trunc('month', pay_date)) AS active_months
  FROM t_mart WHERE market_type = 'B2C' AND data_source = 'new' GROUP BY user_id
),
customers AS (
  SELECT p.*, first_purchase_date, last_purchase_date, coalesce(total_orders, 0) AS total_orders,
         coalesce(total_gmv, 0) AS total_gmv, coalesce(avg_order_value, 0) AS avg_order_value,
         coalesce(active_months, 0) AS active_months, r_raw, f_raw, m_raw, r_score, f_score,
         m_score, rfm_total_raw AS rfm_total,
         coalesce(dimension_label, 'Beginner') AS dimension_label, main_artist_id,
         main_artist_name, main_artist_gmv, TIMESTAMP '2001-09-01 00:00:00' AS updated_at
  FROM profile p LEFT JOIN score s ON s.user_id = p.user_id
       LEFT JOIN dimension d ON d.user_id = p.user_id
       LEFT JOIN (SELECT * FROM retail WHERE user_id NOT IN (SELECT user_id FROM excluded)) r
         ON r.user_id = p.user_id
),
scored AS (SELECT * FROM customers WHERE r_score IS NOT NULL)"""

# Totals keep every user: the same relations with nobody excluded.
NOBODY = RELATIONS.replace(
    "  UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 97 = 0\n",
    "  WHERE false\n",
)

ENTROPY = "\nUNION ALL\n".join(
    f"""SELECT '{x}' AS part, CASE WHEN max(high) > min(low) THEN
      1 - (ln(sum(v)) - sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END) / sum(v)) / ln(count(*))
    ELSE 0 END AS d  -- a column that is the same for all weighs nothing
  FROM (SELECT low, high, CASE WHEN high > low THEN {v} ELSE 0 END AS v FROM score,
        (SELECT min({x}) AS low, max({x}) AS high FROM score))"""
    for x, v in (
        ("r_raw", "CAST(high - r_raw AS DOUBLE) / CAST(high - low AS DOUBLE)"),
        ("f_raw", "CAST(f_raw - low AS DOUBLE) / CAST(high - low AS DOUBLE)"),
        ("m_raw", "CAST(m_raw - low AS DOUBLE) / CAST(high - low AS DOUBLE)"),
    )
)

TOP_ARTISTS = (
    "SELECT main_artist_name, dimension_label, count(*) AS user_cnt, {avg} AS avg_gmv FROM {table} "
    "WHERE main_artist_name IS NOT NULL GROUP BY ALL "
    "ORDER BY user_cnt DESC, main_artist_name, dimension_label LIMIT 20"
)


def _by(key: str) -> str:
    return (
        f"SELECT {key}, count(*) AS user_cnt, {_avg('m_raw')} AS avg_gmv, "
        f"{_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM scored GROUP BY {key}"
    )


SUMMARY = (
    f"SELECT dimension_label, count(*) AS user_cnt, {_avg('rfm_total', 1)} AS avg_rfm, "
    f"{_avg('m_raw')} AS avg_gmv, {_avg('r_raw')} AS avg_days_since_login, "
    f"{_avg('f_raw', 1)} AS avg_rounds_per_artist, "
    f"{_pct('count(*) FILTER (r_score = 5)', 'count(*)')} AS pct_active "
    "FROM segment GROUP BY dimension_label"
)

FINAL = {
    "recency": "SELECT * FROM recent",
    "eligible_orders": "SELECT * FROM eligible",
    "frequency": "SELECT * FROM freq",
    "monetary": "SELECT * FROM money",
    "rfm_base": "SELECT * FROM base",
    "ntile_score": "SELECT user_id, m_raw, ntile(5) OVER (ORDER BY m_raw, user_id) AS m_raw_tile FROM base",
    "rfm_score": "SELECT * FROM score",
    "weighted_rfm": "SELECT user_id, r_score, f_score, m_score, "
    "r_score * CAST(0.2 AS DOUBLE) + f_score * CAST(0.3 AS DOUBLE) + m_score * CAST(0.5 AS DOUBLE) "
    "AS rfm_weighted FROM score",
    "entropy_weights": f"""SELECT
        round(max(d) FILTER (part = 'r_raw') / sum(d), 6) AS w_r,
        round(max(d) FILTER (part = 'f_raw') / sum(d), 6) AS w_f,
        round(max(d) FILTER (part = 'm_raw') / sum(d), 6) AS w_m FROM ({ENTROPY})""",
    "shared_address_buyers": "SELECT * FROM shared_address",
    "multi_artist_buyers": "SELECT * FROM multi_artist",
    "purchasing_agents": "SELECT * FROM agents",
    "excluded_users": "SELECT * FROM excluded",
    "winners": "SELECT * FROM won",
    "order_lines": "SELECT * FROM lines",
    "offer_lookup": "SELECT * FROM offers",
    "paid_b2c_lines": "SELECT * FROM paid",
    "option_sku_matches": "SELECT * FROM matches",
    "option_variety": "SELECT * FROM variety",
    "option_is_ticket": "SELECT * FROM tickets",
    "option_stats_v3": "SELECT * FROM stats",
    "option_stats_v2": "SELECT * FROM stats2",
    "option_stats_v1": "SELECT * FROM stats1",
    "bulk_ticket_buyers": "SELECT * FROM bulk",
    "bulk_ticket_buyers_v2": "SELECT * FROM bulk2",
    "user_purchases": "SELECT * FROM bought",
    "user_purchases_v2": "SELECT * FROM bought2",
    "price_tier_threshold": "SELECT user_id, artist_id, event_id, option_code, unit_price, threshold FROM tiers",
    "option_labels": "SELECT * FROM labelled",
    "artist_labels": "SELECT * FROM by_artist",
    "user_labels": "SELECT * FROM by_user",
    "final_dimension_v3": "SELECT * FROM final_label",
    "final_dimension_v2": "SELECT * FROM final_label2",
    "final_dimension_v1": "SELECT * FROM final_label1",
    "main_artist": "SELECT * FROM main",
    "main_artist_v2": "SELECT * FROM main2",
    "user_dimension": "SELECT * FROM dimension",
    "user_dimension_v2": "SELECT * FROM final_label2 LEFT JOIN main2 USING (user_id)",
    "user_segment": "SELECT * FROM segment",
    "user_profile": "SELECT * FROM profile",
    "purchase_stats": "SELECT * FROM retail WHERE user_id NOT IN (SELECT user_id FROM excluded)",
    "crm_users": "SELECT * FROM customers",
    "segment_check": f"SELECT dimension_label, count(*) AS user_cnt, {_avg('rfm_total', 1)} AS avg_rfm, "
    f"{_avg('total_gmv')} AS avg_gmv FROM scored GROUP BY dimension_label",
    "segment_detail": "SELECT dimension_label, r_score, f_score, m_score, rfm_total, main_artist_name, "
    f"count(*) AS user_cnt, {_avg('r_raw')} AS avg_days_since_login, "
    f"{_avg('f_raw', 1)} AS avg_rounds_per_artist, {_avg('m_raw')} AS avg_gmv, "
    f"{_avg('rfm_total', 1)} AS avg_rfm_total FROM segment GROUP BY ALL",
    "segment_summary": SUMMARY,
    "score_distribution": "SELECT r_score, f_score, m_score, count(*) AS user_cnt FROM segment GROUP BY ALL",
    "top_main_artists": TOP_ARTISTS.format(avg=_avg("m_raw"), table="segment"),
    "total_users": "SELECT count(*) AS total_users FROM segment",
    "persona_scorecard": "SELECT p.*, "
    "coalesce(user_cnt, 0) AS user_cnt, "
    f"coalesce({_pct('user_cnt', '(SELECT count(*) FROM segment)')}, 0) AS pct, "
    "avg_rfm, avg_gmv, avg_days_since_login "
    f"FROM (VALUES {_values(PERSONAS)}) AS p({', '.join(PERSONA_COLUMNS)}) "
    f"LEFT JOIN ({SUMMARY}) s ON s.dimension_label = p.dimension_label",
    "persona_actions": "SELECT a.* REPLACE (CAST(action_no AS BIGINT) AS action_no), "
    "coalesce(user_cnt, 0) AS user_cnt "
    f"FROM (VALUES {_values(ACTIONS)}) AS a({', '.join(ACTION_COLUMNS)}) "
    "LEFT JOIN (SELECT dimension_label, count(*) AS user_cnt FROM segment GROUP BY ALL) s "
    "ON s.dimension_label = a.dimension_label",
    "dimension_share": f"SELECT dimension_label, count(*) AS user_cnt, {_avg('rfm_total', 1)} AS avg_rfm, "
    f"{_avg('m_raw')} AS avg_gmv, {_avg('r_raw')} AS avg_days_since_login, "
    f"{_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM scored GROUP BY dimension_label",
    "winner_rate": "SELECT count(*) AS user_cnt, "
    "count(*) FILTER (user_id IN (SELECT user_id FROM won)) AS winner_cnt, "
    f"{_pct('count(*) FILTER (user_id IN (SELECT user_id FROM won))', 'count(*)')} AS pct "
    "FROM dimension WHERE dimension_label = 'Challenger'",
    "rfm_bands": "SELECT CASE WHEN rfm_total <= 3 THEN 'Hibernating' WHEN rfm_total <= 6 THEN 'At Risk' "
    "WHEN rfm_total <= 9 THEN 'Potential' WHEN rfm_total <= 12 THEN 'Loyal' ELSE 'Champions' END AS band, "
    f"count(*) AS user_cnt, {_avg('m_raw')} AS avg_gmv FROM segment GROUP BY ALL",
    "recency_bands": "SELECT CASE WHEN r_raw <= 30 THEN '0-30' WHEN r_raw <= 90 THEN '31-90' "
    "WHEN r_raw <= 180 THEN '91-180' WHEN r_raw <= 365 THEN '181-365' ELSE '366+' END AS band, "
    f"count(*) AS user_cnt, {_avg('m_raw')} AS avg_gmv, "
    f"{_pct('count(*)', '(SELECT count(*) FROM segment)')} AS pct FROM segment GROUP BY band",
    "by_signup_service": _by("created_from"),
    "by_country": _by("country_code"),
    "main_artist_top": TOP_ARTISTS.format(avg=_avg("m_raw"), table="scored"),
    "fanout_check": """SELECT event_id, option_code, sku_rows, option_qty,
        option_qty * sku_rows AS sku_qty, sku_rows > 1 AS fans_out,
        option_qty AS counted_qty, true AS agrees
      FROM (SELECT event_id, option_code, CAST(sum(order_qty) AS BIGINT) AS option_qty
            FROM kept GROUP BY ALL)
      JOIN (SELECT event_id, option_code, count(*) AS sku_rows FROM matches
            WHERE sku_type = 'P' AND vc > 1 GROUP BY ALL) USING (event_id, option_code)""",
    "variety_coverage": f"""SELECT count(*) AS options, count(candidate_vc) AS covered,
        count(*) FILTER (vc = candidate_vc) AS agreeing,
        CAST(count(candidate_vc) AS DOUBLE) / count(*) AS coverage,
        CAST(count(*) FILTER (vc = candidate_vc) AS DOUBLE) / count(candidate_vc) AS agreement
      FROM variety LEFT JOIN (SELECT event_id, option_code, max(order_qty) AS candidate_vc
        FROM t_mart WHERE market_type = 'B2C' GROUP BY ALL) USING (event_id, option_code)""",
    "partition_check": """SELECT count(*) AS users, count(*) FILTER (n = 1 AND labels = 1) AS one_label,
        count(*) FILTER (n > 1) AS repeated, count(*) FILTER (labels = 0) AS unlabelled
      FROM (SELECT user_id, count(*) AS n, count(dimension_label) AS labels
            FROM dimension GROUP BY user_id)""",
}

KPI_TOTALS = f"""SELECT count(*) AS users, count(r_score) AS buyers,
    count(*) - count(r_score) AS non_buyers, count(*) FILTER (is_withdrawn) AS withdrawn,
    sum(total_gmv) AS total_gmv, {_avg('total_gmv').replace('AVG(total_gmv)', 'AVG(total_gmv) FILTER (r_score IS NOT NULL)')} AS avg_buyer_gmv,
    {_pct('count(r_score)', 'count(*)')} AS pct_buyers FROM customers"""


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    sql = {name: f"WITH {SOURCES},{RELATIONS}\n{final}" for name, final in FINAL.items()}
    sql["kpi_totals"] = f"WITH {SOURCES},{NOBODY}\n{KPI_TOTALS}"
    return sql
