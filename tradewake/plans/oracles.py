"""The same queries as DuckDB SQL over the benchmark tables."""

from __future__ import annotations

from tradewake import config
from tradewake.operators import relevance
from tradewake.plans import queries as q

_LAUNCH = """launch AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS mid, regexp_extract(props, '"k": ([0-9]+)', 1) AS uid,
           epoch_us(ts) // 1000 AS ts, strftime(ts, '%Y-%m-%d') AS log_date, strftime(ts, '%H') AS log_hour,
           CASE WHEN event_type = 'signup' THEN 'startup' ELSE 'event' END AS type
    FROM events)"""
_FIRST = _LAUNCH + """, first_launch AS (
    SELECT * FROM launch
    QUALIFY row_number() OVER (PARTITION BY mid, log_date ORDER BY ts, event_id) = 1)"""
_PURCHASE = """purchase AS (
    SELECT value AS total_amount, strftime(ts, '%Y-%m-%d') AS create_date, strftime(ts, '%H') AS create_hour
    FROM events WHERE event_type = 'purchase')"""
_ORDER = """order_info AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS province_id,
           '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS consignee_tel, o_orderstatus AS order_status,
           CAST(o_custkey AS VARCHAR) AS user_id, o_totalprice AS total_amount, o_orderdate AS order_at,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS create_time,
           strftime(o_orderdate, '%Y-%m-%d') AS create_date, strftime(o_orderdate, '%H') AS create_hour
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
_LINE = """order_detail AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
           CAST(l_orderkey AS VARCHAR) AS order_id, p_name AS sku_name, CAST(l_partkey AS VARCHAR) AS sku_id,
           l_extendedprice AS sku_price, CAST(l_quantity AS VARCHAR) AS sku_num, l_shipdate AS line_at
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""
_USER = """user_info AS (
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS login_name, c_mktsegment AS user_level,
           DATE '1960-01-01' + CAST((c_custkey * 37) % 15000 AS INTEGER) AS born,
           CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender
    FROM customer)"""
_AGE = f"CAST(date_diff('day', born, DATE '{q.AGE_DAY}') // 365 AS INTEGER)"
_SALE = f"""{_ORDER}, {_LINE}, {_USER}, sale AS (
    SELECT d.id AS order_detail_id, o.id AS order_id, o.order_status, o.create_time, o.user_id, d.sku_id,
           u.gender AS user_gender, coalesce({_AGE}, 0) AS user_age, u.user_level, d.sku_price, d.sku_name,
           o.create_date AS dt
    FROM order_detail d JOIN order_info o ON d.order_id = o.id LEFT JOIN user_info u ON o.user_id = u.id)"""
_WORDS = r"regexp_extract_all(lower(sku_name), '[\p{L}\p{N}]+')"


def _hits(source: str) -> str:
    return f"""hits AS (
    SELECT *, CAST(1 AS DOUBLE) / len(list_distinct({_WORDS})) AS closeness FROM {source}
    WHERE dt = '{q.SEARCH_DAY}' AND list_contains({_WORDS}, '{q.KEYWORD.lower()}'))"""


_HITS = f"{_SALE}, {_hits('sale')}"
_HIT_ORDER = """closeness DESC, order_id, order_detail_id, order_status, create_time, user_id, sku_id, user_gender,
    user_age, user_level, sku_price, sku_name"""
_DAY_HITS = f"{_SALE}, hits AS (SELECT * FROM sale WHERE dt = '{q.ORDER_DAY}')"
_SALE_COLUMNS = """order_detail_id, order_id, order_status, create_time, user_id, sku_id, user_gender, user_age,
    user_level, sku_price, sku_name, dt"""

_EVENT = """event AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS mid, regexp_extract(props, '"k": ([0-9]+)', 1) AS uid, ts,
           CASE event_type WHEN 'purchase' THEN 'coupon' WHEN 'click' THEN 'clickItem' WHEN 'view' THEN 'addCart'
                WHEN 'error' THEN 'addComment' WHEN 'signup' THEN 'addFavor' END AS evid,
           CAST(event_id % 50 AS VARCHAR) AS itemid
    FROM events)"""


def _windows(window: int, slide: int) -> str:
    return f"""{_EVENT}, slot AS (
    SELECT e.*, (epoch_us(ts) // {slide * 1_000_000} - k.i) * {slide} AS start_s
    FROM event e, range({window // slide}) AS k(i)), state AS (
    SELECT mid, start_s, count(DISTINCT uid) FILTER (evid = 'coupon') AS accounts,
           coalesce(array_to_string(list_sort(list(DISTINCT uid) FILTER (evid = 'coupon')), ','), '') AS uids,
           coalesce(array_to_string(list_sort(list(DISTINCT itemid) FILTER (evid = 'coupon')), ','), '') AS items,
           array_to_string(list_sort(list_transform(map_entries(histogram(evid)), lambda e: e.key || ':' || e.value)),
               ',') AS event_list,
           count(*) AS events, CAST(max(CASE WHEN evid = 'clickItem' THEN 1 ELSE 0 END) AS INTEGER) AS views
    FROM slot GROUP BY mid, start_s)"""


def _alerts(window: int, slide: int, threshold: int) -> str:
    return f"""WITH {_windows(window, slide)}, alert AS (
    SELECT *, (start_s + {window}) * 1000 AS end_ms, make_timestamp((start_s + {window}) * 1000000) AS end_at
    FROM state WHERE accounts >= {threshold} AND views = 0)
    SELECT strftime(end_at, '%Y-%m-%d') AS day, mid || '-' || strftime(end_at, '%H:%M') AS doc_id, mid, uids,
           items AS item_ids, event_list AS events, CAST(end_ms AS BIGINT) AS ts
    FROM alert
    QUALIFY row_number() OVER (PARTITION BY mid, date_trunc('minute', end_at) ORDER BY end_at DESC) = 1"""


def _money(amount: str) -> str:
    return f"CAST(sum(CAST({amount} AS DECIMAL(18,2))) AS DOUBLE)"


def _compare(rows: str, date: str, hour: str, value: str) -> str:
    def of(day: str) -> str:
        return f"(SELECT {value} FROM {rows} r WHERE r.{date} = {day} AND r.{hour} = h.hour)"

    yesterday = f"strftime(DATE '{q.DAY}' - 1, '%Y-%m-%d')"
    return f"""SELECT h.hour, {of(yesterday)} AS yesterday, {of(f"'{q.DAY}'")} AS today
    FROM (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS hour FROM range(24) AS g(i)) h"""


def _share(part: str) -> str:
    return f"coalesce(floor({part} * CAST(1000 AS DOUBLE) / nullif(count(*), 0) + 0.5) / 10, 0)"


def _rest(*shares: str) -> str:
    return f"floor((100 - {' - '.join(shares)}) * 10 + 0.5) / 10"


_SHARES = f"""shares AS (
    SELECT *, {_rest("under_20", "from_30")} AS between_bands, {_rest("male")} AS female FROM (
        SELECT CAST({_share("count(*) FILTER (user_age < 20)")} AS DOUBLE) AS under_20,
               CAST({_share("count(*) FILTER (user_age >= 30)")} AS DOUBLE) AS from_30,
               CAST({_share("count(*) FILTER (user_gender = 'M')")} AS DOUBLE) AS male, count(*) AS total
        FROM hits))"""

_TOPIC = f"""CASE WHEN tbl = 'order_info' AND op = 'INSERT' THEN '{config.TOPIC_ORDER}'
    WHEN tbl = 'user_info' AND op IN ('INSERT', 'UPDATE') THEN '{config.TOPIC_USER}'
    WHEN tbl = 'order_detail' AND op = 'INSERT' THEN '{config.TOPIC_ORDER_LINE}' END"""


def _change(name: str, source: str, key: str, value: str) -> str:
    return f"""SELECT '{name}' AS tbl, {key} % 11 = 0 AS marker,
        CASE {key} % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS op, {value} AS value
        FROM {source}"""


def _json(**columns: str) -> str:
    parts = [f"""'"{name}":"' || {column} || '"'""" for name, column in columns.items()]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_CHANGE = "changes AS (" + " UNION ALL ".join(
    [
        _change("order_info", "orders", "o_orderkey",
                _json(id="o_orderkey", user_id="o_custkey", order_status="o_orderstatus")),
        _change("user_info", "customer", "c_custkey",
                _json(id="c_custkey", login_name="c_name", user_level="c_mktsegment")),
        _change("order_detail", "lineitem", "l_orderkey",
                _json(order_id="l_orderkey", line="l_linenumber", sku_id="l_partkey")),
    ]
) + f"), routed AS (SELECT *, {_TOPIC} AS topic FROM changes WHERE NOT marker AND {_TOPIC} IS NOT NULL)"


def _masked(tail_from: int) -> str:
    return f"""WITH {_ORDER} SELECT id, user_id, province_id,
    substr(consignee_tel, 1, 4) || '****' || substr(consignee_tel, {tail_from + 1}) AS consignee_tel,
    order_status, total_amount, create_date, create_hour FROM order_info"""


_ACTIVE_TOTAL = f"WITH {_FIRST} SELECT count(*) AS ct FROM first_launch WHERE log_date = '{q.DAY}'"
_ACTIVE_BY_HOUR = f"""WITH {_FIRST} SELECT log_hour AS lh, count(*) AS ct FROM first_launch
    WHERE log_date = '{q.DAY}' GROUP BY log_hour"""
_AMOUNT_TOTAL = f"WITH {_ORDER} SELECT {_money('total_amount')} AS amount FROM order_info WHERE create_date = '{q.ORDER_DAY}'"
_AMOUNT_BY_HOUR = f"""WITH {_PURCHASE} SELECT create_hour, {_money('total_amount')} AS sum_amount
    FROM purchase WHERE create_date = '{q.DAY}' GROUP BY create_hour"""
_CARDS = f"""{_LAUNCH}, {_PURCHASE}, cards AS (
    SELECT 1 AS place, 'dau' AS id, '{config.CARD_NAMES["dau"]}' AS name,
           CAST(count(DISTINCT mid) AS DOUBLE) AS value FROM launch WHERE log_date = '{q.DAY}'
    UNION ALL SELECT 2, 'new_mid', '{config.CARD_NAMES["new_mid"]}', CAST(count(*) AS DOUBLE)
    FROM (SELECT mid FROM launch GROUP BY mid HAVING min(log_date) = '{q.DAY}')
    UNION ALL SELECT 3, 'order_amount', '{config.CARD_NAMES["order_amount"]}', {_money('total_amount')}
    FROM purchase WHERE create_date = '{q.DAY}')"""


def _hours(rows: str, date: str, hour: str, value: str) -> str:
    def of(day: str) -> str:
        return f"""coalesce((SELECT string_agg('"' || h || '":' || v, ',' ORDER BY h) FROM (
            SELECT {hour} AS h, CAST({value} AS VARCHAR) AS v FROM {rows} WHERE {date} = {day} GROUP BY 1)), '')"""

    yesterday = f"strftime(DATE '{q.DAY}' - 1, '%Y-%m-%d')"
    return f"""SELECT '{{"yesterday":{{' || {of(yesterday)} || '}},"today":{{' || {of(f"'{q.DAY}'")} || '}}}}' AS json"""


def _option(name: str, value: str) -> str:
    return f"""'{{"name":"{name}","value":' || {value} || '}}'"""


def _quoted(column: str) -> str:
    return f"""coalesce('"{column}":"' || {column} || '",', '')"""


_DOCUMENT = " || ".join(
    [
        "'{'",
        *[_quoted(c) for c in ("order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id", "user_gender")],
        "'\"user_age\":' || user_age || ','",
        _quoted("user_level"),
        "'\"sku_price\":' || sku_price || ','",
        _quoted("sku_name"),
        "'\"dt\":\"' || dt || '\"}'",
    ]
)
_PAGE = f"SELECT * FROM hits ORDER BY {_HIT_ORDER} LIMIT {q.PAGE_SIZE} OFFSET {(q.PAGE - 1) * q.PAGE_SIZE}"
_LATEST_SALE = f"""SELECT order_id || ':' || order_detail_id AS doc_id, {_SALE_COLUMNS} FROM sale
    QUALIFY row_number() OVER (PARTITION BY dt, order_id, order_detail_id
        ORDER BY sku_id DESC, sku_price DESC, sku_name DESC) = 1"""
_LANDED = """'{"type":"' || type || '","mid":"' || mid || '","uid":"' || uid || '","ts":%d}'""" % q.STAMP_MILLIS

_USERS = f"""WITH {_USER} SELECT id, login_name, user_level, strftime(born, '%Y-%m-%d') AS birthday, gender
    FROM user_info"""

def _report(hits: str) -> str:
    return f"""WITH {hits}, {_SHARES}, page AS ({_PAGE}) SELECT '{{"total":' || total ||
        ',"stat":[{{"options":[' || {_option(config.AGE_UNDER_20, "under_20")} || ',' ||
        {_option(config.AGE_FROM_30, "from_30")} || ',' || {_option(config.AGE_20_TO_30, "between_bands")} ||
        '],"title":"{config.AGE_TITLE}"}},{{"options":[' || {_option(config.GENDER_MALE, "male")} || ',' ||
        {_option(config.GENDER_FEMALE, "female")} || '],"title":"{config.GENDER_TITLE}"}}],"detail":[' ||
        (SELECT coalesce(string_agg({_DOCUMENT}, ',' ORDER BY {_HIT_ORDER}), '') FROM page) || ']}}' AS json FROM shares"""


_BM25 = f"""latest AS ({_LATEST_SALE}), doc AS (
    SELECT dt, doc_id, {_WORDS} AS words FROM latest WHERE dt IN ('{q.SEARCH_DAY}', '{q.ORDER_DAY}')), size AS (
    SELECT dt, count(*) AS docs, sum(len(words)) AS words FROM doc GROUP BY dt), posting AS (
    SELECT dt, word, doc_id, count(*) AS n, any_value(length) AS length
    FROM (SELECT dt, doc_id, len(words) AS length, unnest(words) AS word FROM doc) GROUP BY ALL), df AS (
    SELECT dt, word, count(*) AS df FROM posting GROUP BY ALL), scored AS (
    SELECT dt, word, doc_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * n
           / (n + {relevance.K1} * (1 - {relevance.B} + {relevance.B} * length * docs / size.words)) AS score
    FROM posting JOIN df USING (dt, word) JOIN size USING (dt))"""
_RANKED = tuple(q.RANKED_KEYWORD.lower().split())

ORACLES: dict[str, str] = {
    "launch_derived": f"WITH {_LAUNCH} SELECT mid, uid, type, ts, log_date, log_hour FROM launch",
    "ingest_stamped": f"WITH {_LAUNCH} SELECT type, mid, uid, CAST({q.STAMP_MILLIS} AS BIGINT) AS ts FROM launch",
    "route_logs": f"""WITH {_LAUNCH} SELECT CASE WHEN type = 'startup' THEN '{config.TOPIC_LAUNCH}'
        ELSE '{config.TOPIC_EVENT}' END AS topic, count(*) AS lines FROM launch GROUP BY 1""",
    "raw_landing": f"""WITH {_LAUNCH} SELECT {_LANDED} AS value,
        strftime(make_timestamp({q.STAMP_MILLIS} * 1000), '%Y-%m-%d') AS log_date FROM launch""",
    "cdc_route": f"""WITH {_CHANGE} SELECT tbl AS "table", op, topic, count(*) AS records FROM routed GROUP BY 1, 2, 3""",
    "cdc_after_image": f"WITH {_CHANGE} SELECT topic, value FROM routed",
    "order_enriched": _masked(7),
    "order_masked_sale": _masked(8),
    "first_launch_rows": f"WITH {_FIRST} SELECT mid, uid, ts, log_date, log_hour FROM first_launch",
    "seen_anti_join": f"""WITH {_FIRST} SELECT mid, uid, ts, log_date FROM first_launch f WHERE NOT EXISTS (
        SELECT 1 FROM launch s WHERE s.log_hour < '12' AND s.mid = f.mid AND s.log_date = f.log_date)""",
    "latest_user": f"""WITH {_LAUNCH} SELECT mid AS id, uid, event_id AS "offset" FROM launch
        QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ts DESC, event_id DESC) = 1""",
    "doc_upsert": f"""WITH {_LINE} SELECT order_id || ':' || id AS doc_id, sku_id, sku_price, sku_name, sku_num
        FROM order_detail QUALIFY row_number() OVER (PARTITION BY order_id, id
        ORDER BY sku_id DESC, sku_price DESC, sku_name DESC, sku_num DESC) = 1""",
    "order_detail_outer": f"""WITH {_ORDER}, {_LINE} SELECT coalesce(d.order_id, o.id) AS order_id, d.id AS line_id,
        d.sku_id, d.sku_price, o.user_id, o.order_status
        FROM order_detail d FULL OUTER JOIN order_info o ON d.order_id = o.id""",
    "late_join": f"""WITH {_ORDER}, {_LINE} SELECT d.id AS order_detail_id, o.id AS order_id, o.order_status,
        o.create_time, o.user_id, d.sku_id, d.sku_price, d.sku_name, o.create_date AS dt
        FROM order_detail d JOIN order_info o ON d.order_id = o.id
        AND o.order_at BETWEEN d.line_at - INTERVAL {q.AFTER // 86400} DAY AND d.line_at + INTERVAL {q.BEFORE // 86400} DAY""",
    "user_lookup": f"""WITH {_ORDER}, {_USER} SELECT o.id AS order_id, o.user_id, u.gender AS user_gender,
        coalesce({_AGE}, 0) AS user_age, u.user_level FROM order_info o LEFT JOIN user_info u ON o.user_id = u.id""",
    "sale_detail": f"WITH {_SALE} SELECT {_SALE_COLUMNS} FROM sale",
    "coupon_window_state": f"""WITH {_windows(q.WINDOW, q.SLIDE)} SELECT mid,
        strftime(make_timestamp(start_s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, accounts, uids, items,
        events, views FROM state""",
    "coupon_alerts": _alerts(q.WINDOW, q.SLIDE, config.ALERT_ACCOUNTS),
    "coupon_alerts_five_minutes": _alerts(config.ALERT_WINDOW_SECONDS, config.ALERT_SLIDE_SECONDS, 1),
    "daily_active": f"WITH {_LAUNCH} SELECT log_date, count(DISTINCT mid) AS dau FROM launch GROUP BY log_date",
    "active_of_day": _ACTIVE_TOTAL,
    "hourly_active": _ACTIVE_BY_HOUR,
    "hourly_active_compare": f"WITH {_FIRST} " + _compare("first_launch", "log_date", "log_hour", "count(*)"),
    "order_amount_day": f"WITH {_ORDER} SELECT create_date, {_money('total_amount')} AS amount FROM order_info GROUP BY 1",
    "order_amount_total": _AMOUNT_TOTAL,
    "order_amount_hour": _AMOUNT_BY_HOUR,
    "hourly_amount_compare": f"WITH {_PURCHASE} "
    + _compare("purchase", "create_date", "create_hour", f"coalesce({_money('total_amount')}, 0)"),
    "kpi_cards": f"WITH {_CARDS} SELECT id, name, value FROM cards",
    "new_devices": f"""WITH {_LAUNCH} SELECT log_date, count(*) AS new_mid FROM (
        SELECT mid, min(log_date) AS log_date FROM launch GROUP BY mid) GROUP BY log_date""",
    "province_sales": f"""WITH {_ORDER} SELECT province_id, {_money('total_amount')} AS amount, count(*) AS orders
        FROM order_info GROUP BY province_id""",
    "observed_counts": f"""WITH {_FIRST} SELECT 'launches' AS stage, count(*) AS rows FROM launch
        UNION ALL SELECT 'first_launches', count(*) FROM first_launch""",
    "sql_active_total": _ACTIVE_TOTAL,
    "sql_active_by_hour": _ACTIVE_BY_HOUR,
    "sql_amount_total": _AMOUNT_TOTAL,
    "sql_amount_by_hour": _AMOUNT_BY_HOUR,
    "realtime_total": f"""WITH {_CARDS} SELECT '[' || string_agg('{{"id":"' || id || '","name":"' || name ||
        '","value":' || value || '}}', ',' ORDER BY place) || ']' AS json FROM cards""",
    "realtime_hours_dau": f"WITH {_FIRST} " + _hours("first_launch", "log_date", "log_hour", "count(*)"),
    "realtime_hours_amount": f"WITH {_PURCHASE} "
    + _hours("purchase", "create_date", "create_hour", _money("total_amount")),
    "sale_search_page": f"WITH {_HITS} SELECT {_SALE_COLUMNS} FROM ({_PAGE})",
    "sale_search_total": f"WITH {_HITS} SELECT count(*) AS total FROM hits",
    "age_terms": f"""WITH {_DAY_HITS} SELECT user_age, count(*) AS hits FROM hits GROUP BY user_age
        ORDER BY hits DESC, user_age LIMIT {config.AGE_BUCKETS}""",
    "gender_terms": f"""WITH {_DAY_HITS} SELECT user_gender, count(*) AS hits FROM hits WHERE user_gender IS NOT NULL
        GROUP BY user_gender ORDER BY hits DESC, user_gender LIMIT {config.GENDER_BUCKETS}""",
    "age_share": f"""WITH {_DAY_HITS}, {_SHARES} SELECT '{config.AGE_UNDER_20}' AS name, under_20 AS value FROM shares
        UNION ALL SELECT '{config.AGE_FROM_30}', from_30 FROM shares
        UNION ALL SELECT '{config.AGE_20_TO_30}', between_bands FROM shares""",
    "gender_share": f"""WITH {_DAY_HITS}, {_SHARES} SELECT '{config.GENDER_MALE}' AS name, male AS value FROM shares
        UNION ALL SELECT '{config.GENDER_FEMALE}', female FROM shares""",
    "sale_search_report": _report(_HITS),
    "sale_table_report": _report(f"{_SALE}, latest AS ({_LATEST_SALE}), {_hits('latest')}"),
    "sale_search_ranked": f"""WITH {_SALE}, {_BM25}, best AS (
        SELECT dt, doc_id, round(sum(score), {relevance.DIGITS}) AS score FROM scored
        WHERE dt = '{q.SEARCH_DAY}' AND word IN {_RANKED} GROUP BY ALL HAVING count(*) = {len(_RANKED)}
        ORDER BY score DESC, doc_id LIMIT {2 * q.PAGE_SIZE})
        SELECT doc_id, score, {_SALE_COLUMNS} FROM best JOIN latest USING (dt, doc_id)""",
    "sale_word_scores": f"""WITH {_SALE}, {_BM25}
        SELECT dt, word, doc_id, round(score, {relevance.DIGITS}) AS score FROM scored""",
    "sale_breakdowns": f"""WITH {_DAY_HITS}, {_SHARES}, ages AS (
        SELECT user_age, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, user_age LIMIT {config.AGE_BUCKETS})
        SELECT 'age' AS part, CAST(user_age AS VARCHAR) AS name, CAST(n AS DOUBLE) AS value FROM ages
        UNION ALL SELECT 'gender', user_gender, CAST(count(*) AS DOUBLE) FROM hits WHERE user_gender IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'total', NULL, CAST(total AS DOUBLE) FROM shares WHERE total > 0
        UNION ALL SELECT 'age share', '{config.AGE_UNDER_20}', under_20 FROM shares
        UNION ALL SELECT 'age share', '{config.AGE_FROM_30}', from_30 FROM shares
        UNION ALL SELECT 'age share', '{config.AGE_20_TO_30}', between_bands FROM shares
        UNION ALL SELECT 'gender share', '{config.GENDER_MALE}', male FROM shares
        UNION ALL SELECT 'gender share', '{config.GENDER_FEMALE}', female FROM shares""",
    "sale_page_deep": f"""WITH {_SALE} SELECT {_SALE_COLUMNS} FROM sale ORDER BY order_id, order_detail_id, create_time,
        user_id, sku_id, user_gender NULLS FIRST, user_age, user_level, sku_price, sku_name, dt
        LIMIT {q.PAGE_SIZE} OFFSET {(q.DEEP_PAGE - 1) * q.PAGE_SIZE}""",
    "order_upsert_out_of_order": f"""WITH {_ORDER} SELECT id AS "ID", user_id AS "USER_ID",
        CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'later' ELSE order_status END AS "ORDER_STATUS",
        create_date AS "CREATE_DATE" FROM order_info""",
    "dated_targets": f"""WITH {_SALE}, latest AS ({_LATEST_SALE.replace("FROM sale", f"FROM sale WHERE dt = '{q.ORDER_DAY}'")})
        SELECT doc_id, CASE WHEN user_gender = 'M' THEN 'again' ELSE order_status END AS order_status,
        'sale_detail-' || CASE WHEN user_gender = 'M' THEN '{q.RUN_DAYS[1]}' ELSE '{q.RUN_DAYS[0]}' END AS target FROM latest""",
    "user_lookup_buckets": f"""WITH {_ORDER}, {_USER} SELECT o.id AS order_id, o.user_id, u.gender AS user_gender,
        coalesce({_AGE}, 0) AS user_age, u.user_level FROM order_info o LEFT JOIN user_info u ON o.user_id = u.id
        WHERE create_date = '{q.ORDER_DAY}'""",
    "new_devices_incremental": f"""WITH {_LAUNCH} SELECT log_date, count(*) AS new_mid FROM (
        SELECT mid, min(log_date) AS log_date FROM launch GROUP BY mid) GROUP BY log_date""",
    "kpi_cards_stored": f"WITH {_CARDS} SELECT id, name, value FROM cards",
    "stream_late_launches": f"""WITH {_LAUNCH} SELECT DISTINCT mid AS "MID", log_date AS "LOGDATE" FROM launch""",
    "stream_launch_figures": f"""WITH {_LAUNCH}, first AS (SELECT mid, min(log_date) AS day FROM launch GROUP BY mid)
        SELECT log_date AS day, count(DISTINCT launch.mid) AS active, (SELECT count(*) FROM first WHERE day = log_date) AS "new"
        FROM launch GROUP BY log_date""",
    "late_rows_counted": f"""WITH {_LAUNCH} SELECT 'dedupeWithinWatermark' AS operator, count(*) AS rows FROM launch
        WHERE event_id % 5 = 0 AND ts <= (SELECT max(ts) FROM launch WHERE event_id % 5 <> 0) - 86400000""",
    "sale_expiry_audit": f"""WITH {_ORDER}, {_LINE}, mark AS (
        SELECT least((SELECT max(order_at) FROM order_info), (SELECT max(line_at) FROM order_detail))
               - INTERVAL {q.AUDIT_DAYS} DAY - INTERVAL 12 HOUR AS at), line AS (
        SELECT d.order_id, d.id, bool_or(o.id IS NOT NULL) AS matched,
               bool_or(d.line_at + INTERVAL {q.AUDIT_DAYS} DAY < mark.at) AS over
        FROM order_detail d CROSS JOIN mark LEFT JOIN order_info o ON d.order_id = o.id AND o.order_at BETWEEN
             d.line_at - INTERVAL {q.AUDIT_DAYS} DAY AND d.line_at + INTERVAL {q.AUDIT_DAYS} DAY
        GROUP BY 1, 2)
        SELECT CASE WHEN matched THEN 'matched' WHEN over THEN 'expired' ELSE 'waiting' END AS place, count(*) AS lines
        FROM line GROUP BY 1""",
    "wide_upsert": f"""WITH {_FIRST} SELECT mid AS "MID", uid AS "UID", log_date AS "LOGDATE", log_hour AS "LOGHOUR",
        ts AS "TS" FROM first_launch""",
    "order_upsert": f"""WITH {_ORDER} SELECT id AS "ID", user_id AS "USER_ID", order_status AS "ORDER_STATUS",
        CASE WHEN order_status = 'F' THEN total_amount + 1 ELSE total_amount END AS "TOTAL_AMOUNT",
        create_date AS "CREATE_DATE" FROM order_info""",
    "sale_upsert": f"WITH {_SALE} {_LATEST_SALE}",
    "sale_table_search": f"""WITH {_SALE}, latest AS ({_LATEST_SALE}), {_hits("latest")}
        SELECT {_SALE_COLUMNS} FROM hits ORDER BY {_HIT_ORDER} LIMIT {q.PAGE_SIZE}""",
    "alert_upsert": _alerts(q.WINDOW, q.SLIDE, config.ALERT_ACCOUNTS),
    "user_snapshot": f"""WITH {_USER} SELECT id, login_name,
        CASE WHEN user_level = 'BUILDING' THEN 'VIP' ELSE user_level END AS user_level,
        strftime(born, '%Y-%m-%d') AS birthday, gender FROM user_info""",
    "stream_first_launches": f"""WITH {_LAUNCH} SELECT DISTINCT mid AS "MID", log_date AS "LOGDATE" FROM launch""",
    "stream_alerts": _alerts(q.WINDOW, q.SLIDE, config.ALERT_ACCOUNTS),
    "stream_sales": f"""WITH {_SALE}, times AS (
        SELECT d.id, d.order_id, d.sku_id, d.sku_price FROM order_detail d JOIN order_info o ON d.order_id = o.id
        AND o.order_at BETWEEN d.line_at - INTERVAL {q.AFTER // 86400} DAY AND d.line_at + INTERVAL {q.BEFORE // 86400} DAY),
        near AS (SELECT DISTINCT sale.* FROM sale JOIN times t ON t.id = sale.order_detail_id
        AND t.order_id = sale.order_id AND t.sku_id = sale.sku_id AND t.sku_price = sale.sku_price)
        {_LATEST_SALE.replace("FROM sale", "FROM near")}""",
    "stream_log_routes": f"""WITH {_LAUNCH} SELECT {_LANDED} AS value, CASE WHEN type = 'startup'
        THEN '{config.TOPIC_LAUNCH}' ELSE '{config.TOPIC_EVENT}' END AS topic FROM launch""",
    "stream_change_routes": f"WITH {_CHANGE} SELECT topic, value FROM routed",
    "late_join_repeats": f"""WITH {_ORDER}, {_LINE}, repeats AS (
        SELECT * FROM order_info UNION ALL
        SELECT * EXCLUDE (k) REPLACE (order_at - to_days(k) AS order_at, order_status || '-' || k AS order_status)
        FROM order_info, (VALUES {", ".join(f"({k})" for k in q.REPEAT_DAYS)}) AS t(k))
        SELECT d.id AS order_detail_id, o.id AS order_id, o.order_status,
        o.create_time, o.user_id, d.sku_id, d.sku_price, d.sku_name, o.create_date AS dt
        FROM order_detail d JOIN repeats o ON d.order_id = o.id
        AND o.order_at BETWEEN d.line_at - INTERVAL {q.AFTER // 86400} DAY AND d.line_at + INTERVAL {q.BEFORE // 86400} DAY
        QUALIFY row_number() OVER (PARTITION BY d.id, o.id ORDER BY o.order_at DESC) = 1""",
    "stream_orders": f"""WITH {_ORDER} SELECT id AS "ID", user_id AS "USER_ID",
        substr(consignee_tel, 1, 4) || '****' || substr(consignee_tel, 8) AS "CONSIGNEE_TEL",
        order_status AS "ORDER_STATUS", total_amount AS "TOTAL_AMOUNT", create_date AS "CREATE_DATE",
        create_hour AS "CREATE_HOUR" FROM order_info""",
    "stream_users": _USERS,
    "stream_raw_logs": f"""WITH {_LAUNCH} SELECT {_LANDED} AS value,
        strftime(make_timestamp({q.STAMP_MILLIS} * 1000), '%Y-%m-%d') AS log_date FROM launch""",
    "quarantine_counts": """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'bad create_time'
        WHEN o_orderkey % 11 = 0 THEN 'malformed' ELSE 'stored' END AS place, count(*) AS records
        FROM orders GROUP BY 1""",
    "two_checkpoints": _USERS,
}
