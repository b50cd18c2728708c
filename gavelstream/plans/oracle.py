"""DuckDB SQL for the catalogue, written independently of the DataFrame plans."""

from __future__ import annotations

_MARKET = """
WITH person AS (
    SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) || '@example.com' AS emailAddress,
           lpad(c_custkey::VARCHAR, 16, '0') AS creditCard, 'city_' || c_nationkey AS city,
           ['or', 'wy', 'ca', 'id', 'az'][(c_nationkey % 5) + 1] AS state,
           make_timestamp((1704067200000 + c_custkey * 1000 + (c_custkey - c_custkey % 50) * 504000)::BIGINT * 1000) AS date_time,
           c_mktsegment AS extra
    FROM customer
), auction AS (
    SELECT *, make_timestamp((ms + 2000 + (seller % 7) * 1000)::BIGINT * 1000) AS expires, make_timestamp(ms::BIGINT * 1000) AS date_time
    FROM (SELECT o_orderkey AS id, 'item_' || (o_orderkey % 997) AS itemName, o_orderpriority AS description, 1::BIGINT AS initialBid,
                 (o_orderkey % 1000)::BIGINT AS reserve, o_custkey AS seller, (10 + o_orderkey % 5)::BIGINT AS category, o_orderstatus AS extra,
                 1704067200000 + o_orderkey * 100 + (o_orderkey - o_orderkey % 500) * 50400 AS ms
          FROM orders)
), bid AS (
    SELECT l_orderkey AS auction, l_suppkey AS bidder, round(l_extendedprice * [1, 10, 100][(l_partkey % 3) + 1])::BIGINT AS price,
           CASE WHEN l_partkey % 6 < 4 THEN ['Apple', 'Google', 'Facebook', 'Baidu'][(l_partkey % 6) + 1] ELSE 'channel-' || (l_partkey % 100) END AS channel,
           'https://www.example.com/d' || (l_partkey % 7) || '/e' || (l_suppkey % 5) || '/f/item.htm?query=1'
               || CASE WHEN l_partkey % 2 = 0 THEN '&channel_id=' || l_partkey ELSE '' END AS url,
           make_timestamp((1704067200000 + l_orderkey * 100 + (l_orderkey - l_orderkey % 500) * 50400 + (l_linenumber - 1) * 900
               + (l_partkey::BIGINT * 31 + l_suppkey) % 900)::BIGINT * 1000) AS date_time,
           l_returnflag || l_linestatus || 'ccc' AS extra
    FROM lineitem
), valid AS (
    SELECT a.*, b.auction, b.bidder, b.price, b.date_time AS bid_dateTime, b.extra AS bid_extra
    FROM auction a JOIN bid b ON b.auction = a.id AND b.date_time >= a.date_time AND b.date_time <= a.expires
), final AS (SELECT id, category, max(price) AS final FROM valid GROUP BY ALL),
counts AS (SELECT auction, count(*) AS bid_count FROM bid GROUP BY auction)
"""

_HOP = """, hops AS (
    SELECT auction, count(*) AS num, time_bucket(INTERVAL '{slide} seconds', date_time) - to_seconds(k * {slide}) AS starttime
    FROM bid, range(0, {n}) r(k) GROUP BY ALL
), peaks AS (SELECT *, starttime + INTERVAL '{size} seconds' AS endtime, max(num) OVER (PARTITION BY starttime) AS maxn,
                    row_number() OVER (PARTITION BY starttime ORDER BY num DESC, auction) AS place FROM hops)
"""
_HOP10 = _HOP.format(slide=2, n=5, size=10)
_EURO = "(0.908 * price)::DECIMAL(23, 3)"
_DAY = "strftime(date_time, '%Y-%m-%d')"
_R1, _R2, _R3 = "price < 10000", "price >= 10000 AND price < 1000000", "price >= 1000000"
_RANKED = ", ".join(
    f"count({'DISTINCT ' + c if c else '*'}) {f'FILTER ({w})' if w else ''} AS {n}_{what}"
    for c, what in (("", "bids"), ("bidder", "bidders"), ("auction", "auctions"))
    for n, w in (("total", ""), ("rank1", _R1), ("rank2", _R2), ("rank3", _R3))
)
_CHANNEL = "regexp_extract(url, '(&|^)channel_id=([^&]*)', 2)"
_TUMBLE = "time_bucket(INTERVAL '{} seconds', {})"


def _q7(seconds: int) -> str:
    bucket = _TUMBLE.format(seconds, "date_time")
    return f"""{_MARKET}, tops AS (SELECT {bucket} AS s, max(price) AS p FROM bid GROUP BY 1)
        SELECT auction, price, bidder, date_time, extra FROM bid JOIN tops ON price = p AND date_time BETWEEN s AND s + INTERVAL '{seconds} seconds'"""


def _session(keys: str, time: str, gap: str, table: str, name: str) -> str:
    return f"""
        SELECT {keys}, count(*) AS {name}, min({time}) AS starttime, max({time}) + INTERVAL '{gap}' AS endtime FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {time} ROWS UNBOUNDED PRECEDING) AS part FROM (
                SELECT *, CASE WHEN {time} <= lag({time}) OVER (PARTITION BY {keys} ORDER BY {time}) + INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM {table}))
        GROUP BY {keys}, part"""


_ARRIVALS = f"""{_MARKET}, p AS (SELECT DISTINCT id, name, {_TUMBLE.format(10, 'date_time')} AS w FROM person),
    s AS (SELECT DISTINCT seller, {_TUMBLE.format(10, 'date_time')} AS w FROM auction)"""

_REPORT = """
WITH e AS (
    SELECT '2024010' || (event_id % 3 + 1) || '000000' AS report_time, 'q' || (event_id % 23) AS kase, 'platform-' || (user_id % 3) AS platform, event_id, user_id FROM events
), results AS (SELECT report_time, kase, platform, event_id / 4 AS execution_time FROM e WHERE event_id % 10 = 0),
chosen AS (
    SELECT TIMESTAMPTZ '2024-01-01 00:00:00+00' + to_seconds(event_id % 60) AS "time", platform AS container, event_id, user_id
    FROM e WHERE report_time = '20240102000000' AND kase LIKE '%q1%'
)
"""

ORACLE_SQL: dict[str, str] = {
    "base": "SELECT 1::INTEGER AS id, 'Hello streaming!' AS message",
    "q0": f"{_MARKET} SELECT auction, bidder, price, date_time, extra FROM bid",
    "q1": f"{_MARKET} SELECT auction, bidder, {_EURO} AS price, date_time, extra FROM bid",
    "q2": f"{_MARKET} SELECT auction, price FROM bid WHERE mod(auction, 123) = 0",
    "q3": f"{_MARKET} SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 14 AND p.state IN ('or', 'wy', 'ca')",
    "q3_no_condition": f"{_MARKET} SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id",
    "q4": f"{_MARKET} SELECT category, avg(final) AS avg_price FROM final GROUP BY category",
    "q5": f"{_MARKET}{_HOP10} SELECT auction, num, starttime, endtime FROM peaks WHERE num >= maxn",
    "q5_asof": f"{_MARKET}{_HOP10} SELECT auction, num, starttime, endtime FROM peaks WHERE num >= maxn",
    "q5_rewrite": f"{_MARKET}{_HOP10} SELECT auction, num, starttime, endtime FROM peaks WHERE place = 1",
    "q5_many_windows": f"{_MARKET}{_HOP.format(slide=5, n=60, size=300)} SELECT auction, num, starttime, endtime FROM peaks WHERE num >= maxn",
    "q6": f"""{_MARKET}, f AS (SELECT id, seller, bid_dateTime, max(price) AS final FROM valid GROUP BY ALL)
        SELECT seller, (sum(final) OVER (PARTITION BY seller ORDER BY bid_dateTime, id ROWS 9 PRECEDING))::DOUBLE / 10 AS avg_sell_price FROM f""",
    "q6_winning": f"""{_MARKET}, f AS (SELECT id, seller, expires, max(price) AS final FROM valid GROUP BY ALL)
        SELECT id, seller, avg(final) OVER (PARTITION BY seller ORDER BY expires, id ROWS 9 PRECEDING) AS avg_sell_price FROM f""",
    "q7": _q7(10),
    "q7_two_seconds": _q7(2),
    "q7_rewrite": f"""{_MARKET} SELECT auction, price, bidder, date_time, extra FROM bid
        QUALIFY row_number() OVER (PARTITION BY {_TUMBLE.format(600, 'date_time')} ORDER BY price DESC, date_time, auction, bidder) = 1""",
    "q8": f"{_ARRIVALS} SELECT id, name, p.w AS starttime FROM p JOIN s ON id = seller AND p.w = s.w",
    "q8_any_window": f"{_ARRIVALS} SELECT id, name, p.w AS starttime, s.w AS auction_starttime FROM p JOIN s ON id = seller",
    "q9": f"""{_MARKET} SELECT id, itemName, description, initialBid, reserve, date_time, expires, seller, category, extra, auction, bidder, price, bid_dateTime, bid_extra
        FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY price DESC, bid_dateTime, bidder) = 1""",
    "q9_session": f"""{_MARKET}, marked AS (
            SELECT *, bid_dateTime < expires AS running,
                   CASE WHEN bid_dateTime > lag(bid_dateTime) OVER w + INTERVAL '2 hours' THEN 1 ELSE 0 END AS late,
                   coalesce(sum((bid_dateTime >= expires)::INTEGER) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
            FROM valid WINDOW w AS (PARTITION BY id ORDER BY bid_dateTime, price, bidder)
        ), parts AS (
            SELECT *, ended + sum(late) OVER (PARTITION BY id ORDER BY bid_dateTime, price, bidder ROWS UNBOUNDED PRECEDING) AS part FROM marked
        ), kept AS (
            SELECT *, bool_or(running) OVER (PARTITION BY id, part ORDER BY bid_dateTime, price, bidder ROWS UNBOUNDED PRECEDING) AS opened FROM parts
        )
        SELECT min(bid_dateTime) AS ws, max(bid_dateTime) AS we, max(price) AS price, id, any_value(itemName) AS itemName, any_value(seller) AS seller
        FROM kept WHERE opened GROUP BY id, part""",
    "q10": f"{_MARKET} SELECT auction, bidder, price, date_time, extra, {_DAY} AS dt, strftime(date_time, '%H:%M') AS hm FROM bid",
    "q11": f"{_MARKET} {_session('bidder', 'date_time', '10 seconds', 'bid', 'bid_count')}",
    "q13": f"{_MARKET} SELECT auction, bidder, price, date_time, 'v' || (auction % 10000) AS \"value\" FROM bid",
    "q14": f"""{_MARKET} SELECT auction, bidder, {_EURO} AS price,
            CASE WHEN hour(date_time) BETWEEN 8 AND 18 THEN 'dayTime' WHEN hour(date_time) <= 6 OR hour(date_time) >= 20 THEN 'nightTime' ELSE 'otherTime' END AS bidTimeType,
            date_time, extra, (length(extra) - length(replace(extra, 'c', '')))::BIGINT AS c_counts
        FROM bid WHERE 0.908 * price > 1000000 AND 0.908 * price < 50000000""",
    "q15": f"{_MARKET} SELECT {_DAY} AS \"day\", {_RANKED} FROM bid GROUP BY 1",
    "q16": f"{_MARKET} SELECT channel, {_DAY} AS \"day\", max(strftime(date_time, '%H:%M')) AS \"minute\", {_RANKED} FROM bid GROUP BY 1, 2",
    "q17": f"""{_MARKET} SELECT auction, {_DAY} AS "day", count(*) AS total_bids, count(*) FILTER ({_R1}) AS rank1_bids, count(*) FILTER ({_R2}) AS rank2_bids,
            count(*) FILTER ({_R3}) AS rank3_bids, min(price) AS min_price, max(price) AS max_price, (sum(price) // count(*))::BIGINT AS avg_price, sum(price)::BIGINT AS sum_price
        FROM bid GROUP BY 1, 2""",
    "q18": f"{_MARKET} SELECT * FROM bid QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY date_time DESC, price DESC) = 1",
    "q18_latest": f"{_MARKET} SELECT bidder, auction FROM bid QUALIFY row_number() OVER (PARTITION BY bidder ORDER BY date_time DESC, price DESC, auction DESC) = 1",
    "q19": f"{_MARKET} SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, bidder) AS rank_number FROM bid QUALIFY rank_number <= 10",
    "q19_topk": f"{_MARKET} SELECT auction, list_slice(list(price ORDER BY price DESC), 1, 10) AS prices FROM bid GROUP BY auction",
    "q20": f"""{_MARKET} SELECT b.auction, b.bidder, b.price, b.channel, b.url, b.date_time AS bid_dateTime, b.extra AS bid_extra, a.itemName, a.description, a.initialBid,
            a.reserve, a.date_time AS auction_dateTime, a.expires, a.seller, a.category, a.extra AS auction_extra
        FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10""",
    "q21": f"""{_MARKET} SELECT auction, bidder, price, channel,
            CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2' WHEN 'baidu' THEN '3' ELSE {_CHANNEL} END AS channel_id
        FROM bid WHERE {_CHANNEL} <> '' OR lower(channel) IN ('apple', 'google', 'facebook', 'baidu')""",
    "q22": f"{_MARKET} SELECT auction, bidder, price, channel, string_split(url, '/')[4] AS dir1, string_split(url, '/')[5] AS dir2, string_split(url, '/')[6] AS dir3 FROM bid",
    "q101": f"{_MARKET} SELECT id, itemName, max_price FROM auction LEFT JOIN (SELECT auction, max(price) AS max_price FROM bid GROUP BY 1) ON id = auction",
    "q102": f"{_MARKET} SELECT id, itemName, bid_count FROM auction JOIN counts ON id = auction WHERE bid_count >= (SELECT count(*) / count(DISTINCT auction) FROM bid)",
    "q103": f"{_MARKET} SELECT id, itemName FROM auction WHERE id IN (SELECT auction FROM counts WHERE bid_count >= 8)",
    "q104": f"{_MARKET} SELECT id, itemName FROM auction WHERE id NOT IN (SELECT auction FROM counts WHERE bid_count < 8)",
    "q103_20": f"{_MARKET} SELECT id, itemName FROM auction WHERE id IN (SELECT auction FROM counts WHERE bid_count >= 20)",
    "q104_20": f"{_MARKET} SELECT id, itemName FROM auction WHERE id NOT IN (SELECT auction FROM counts WHERE bid_count < 20)",
    "q105": f"{_MARKET} SELECT id, itemName, bid_count FROM auction JOIN counts ON id = auction ORDER BY bid_count DESC, id LIMIT 1000",
    "q106": f"{_MARKET} SELECT min(final) AS min_final FROM final",
    "union_stream_split": f"{_MARKET} SELECT category, avg(final) AS avg_price FROM final GROUP BY category",
    "union_event_time": f"""{_MARKET}, t AS (SELECT 0 AS event_type, date_time FROM person UNION ALL SELECT 1, date_time FROM auction UNION ALL SELECT 2, date_time FROM bid)
        SELECT event_type::INTEGER AS event_type, count(*) AS n, min(date_time) AS first_time, max(date_time) AS last_time FROM t GROUP BY 1""",
    "interval_join": f"""{_MARKET} SELECT category, count(*) AS n, sum(price)::BIGINT AS total FROM auction a JOIN bid b ON a.id = b.auction
        AND b.date_time BETWEEN a.date_time - INTERVAL '2 hours' AND a.date_time + INTERVAL '2 hours' GROUP BY category""",
    "asof_join": f"""{_MARKET} SELECT l.seller, l.id, l.expires, r.opened FROM auction l ASOF JOIN (SELECT seller, date_time AS opened FROM auction) r
        ON l.seller = r.seller AND l.expires >= r.opened""",
    "null_aware_anti_join": f"{_MARKET} SELECT id FROM auction WHERE id NOT IN (SELECT CASE WHEN auction % 2 = 0 THEN auction END FROM bid)",
    "filtered_distinct": f"{_MARKET} SELECT channel, count(DISTINCT bidder) FILTER ({_R1}) AS cheap_bidders, count(*) FILTER ({_R1}) AS cheap_bids FROM bid GROUP BY 1",
    "latest_by_key": f"""{_MARKET} SELECT auction, bidder, price, date_time FROM bid
        QUALIFY row_number() OVER (PARTITION BY auction ORDER BY date_time DESC, price DESC, bidder DESC) = 1""",
    "array_average": f"{_MARKET} SELECT auction, (min(price)::DOUBLE + max(price)::DOUBLE) / 2 AS middle FROM bid GROUP BY auction",
    "array_concat": f"""{_MARKET} SELECT auction, len(joined)::INTEGER AS n, joined[2] AS second, joined[-1] AS last
        FROM (SELECT auction, list_concat([min(price)], [max(price), 0]) AS joined FROM bid GROUP BY auction)""",
    "max_k_bids": f"""{_MARKET} SELECT auction, (k - 1)::INTEGER AS place, price, date_time, bidder
        FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, bidder) AS k FROM bid) WHERE k <= 3""",
    "bids_by_minute": f"""{_MARKET} SELECT date_time::DATE::VARCHAR AS day, strftime(date_trunc('minute', date_time), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM bid GROUP BY ALL""",
    "url_segments": "SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[4] AS dir1 FROM pages",
    "tumble_events": "SELECT time_bucket(INTERVAL '1 hour', ts) AS starttime, event_type, count(*) AS n FROM events GROUP BY ALL",
    "hop_events": """SELECT time_bucket(INTERVAL '30 minutes', ts) - to_minutes(k * 30) AS starttime, time_bucket(INTERVAL '30 minutes', ts) - to_minutes(k * 30 - 60) AS endtime,
        count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL""",
    "session_events": _session("user_id", "ts", "30 minutes", "events", "n"),
    "json_path_events": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, (props ->> '$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "last_event": "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "distinct_events": "SELECT DISTINCT event_type FROM events",
    "top_events": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100",
    "dashboard_response_time": f"{_REPORT} SELECT platform, execution_time FROM results WHERE report_time = '20240102000000' AND kase = 'q1'",
    "dashboard_report_times": f"{_REPORT} SELECT DISTINCT report_time FROM results",
    "dashboard_cases": f'{_REPORT} SELECT DISTINCT kase AS "case" FROM results',
    "dashboard_memory": f'{_REPORT} SELECT "time", container, event_id * 1048576 / 1024 ^ 3 AS memory_gb FROM chosen',
    "dashboard_cpu": f"""{_REPORT} SELECT "time", container, CASE WHEN event_id * 1000 + 7 <> 0 THEN (event_id * 100 + user_id)::DOUBLE / (event_id * 1000 + 7)::DOUBLE * 8 END AS cpu FROM chosen""",
    "dashboard_network_write": f'{_REPORT} SELECT "time", container, (event_id * 1000 + user_id) / 1024 ^ 2 AS network_mb FROM chosen',
    "dashboard_network_read": f'{_REPORT} SELECT "time", container, event_id * 1048576 / 1024 ^ 2 AS network_mb FROM chosen',
}

#: Streams end at their batch form's result.
ORACLE_SQL |= {f"stream_{n}": ORACLE_SQL[n] for n in ("q4", "q5_many_windows", "q9", "q9_session", "q15", "q16", "q101", "q105", "asof_join")}
