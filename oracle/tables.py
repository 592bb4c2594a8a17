"""SQL of the bar adapters."""

_LINE = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity}"


def _bars(symbol, bucket, price, volume, key, table):
    return (
        f"SELECT {symbol} AS symbol, {bucket} AS ts, arg_min({price}, {key}) AS open, max({price}) AS high, "
        f"min({price}) AS low, arg_max({price}, {key}) AS close, CAST({volume} AS DOUBLE) AS volume "
        f"FROM {table} GROUP BY 1, 2"
    )


def _line(symbol):
    return _bars(symbol, "date_trunc('day', l_shipdate)::TIMESTAMP", "l_extendedprice / l_quantity", "sum(l_quantity)", _LINE, "lineitem")


def _event(symbol, unit):
    return _bars(symbol, f"date_trunc('{unit}', ts)::TIMESTAMP", "value", "count(*)", "{'a': events.ts, 'b': event_id}", "events")


BARS = {
    "events_hourly": _event("event_type", "hour"),
    "events_user_daily": _event("user_id::VARCHAR", "day"),
    "part_daily": _line("l_suppkey::VARCHAR"),
    "flag_daily": _line("l_returnflag"),
    "market_daily": _line("'ALL'"),
    "orders_daily": _bars("o_orderpriority", "date_trunc('day', o_orderdate)::TIMESTAMP", "o_totalprice", "count(*)", "o_orderkey", "orders"),
}
BARS["combo_daily"] = _line("l_returnflag || l_linestatus")
_SIX = ["AF", "AO", "NF", "NO", "RF", "RO"]
_first = ", ".join(f"max(CASE WHEN symbol = 'AF' THEN {c} END) AS {c}" for c in ("open", "high", "low", "close", "volume"))
_rest = ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS close_{i}" for i, s in enumerate(_SIX[1:], 2))
_all = " AND ".join(["close IS NOT NULL"] + [f"close_{i} IS NOT NULL" for i in range(2, 7)])
BARS["panel_daily"] = (
    f"SELECT '{'/'.join(_SIX)}' AS symbol, * FROM (SELECT ts, {_first}, {_rest} FROM ({BARS['combo_daily']}) GROUP BY ts) WHERE {_all}"
)
MACRO = (
    "SELECT (m + INTERVAL 1 MONTH)::TIMESTAMP AS ts, bullish, bearish, p / 5000.0::DOUBLE AS pmi, n AS confidence, "
    "avg(n) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS confidence_mean3, n / 4.0::DOUBLE AS exposure, "
    "p / 150000.0::DOUBLE AS rate, coalesce(lag(p) OVER (ORDER BY m), p) / 150000.0::DOUBLE AS rate_prev, "
    "p / 50000.0::DOUBLE AS risk, p / 80000.0::DOUBLE AS inflation, (bullish - bearish) / 10.0::DOUBLE AS sentiment "
    "FROM (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS p, count(*)::DOUBLE AS n, "
    "avg(CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 100.0::DOUBLE ELSE 0 END) AS bullish, "
    "avg(CASE WHEN o_orderpriority[1] IN ('4', '5') THEN 100.0::DOUBLE ELSE 0 END) AS bearish FROM orders GROUP BY 1)"
)
BARS["macro_daily"] = (
    f"SELECT b.*, r.* EXCLUDE (ts) FROM ({BARS['flag_daily']}) b ASOF LEFT JOIN ({MACRO}) r ON b.ts >= r.ts"
)
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
