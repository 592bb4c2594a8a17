"""Plain SQL written by hand for the queries of tidebars.workloads."""

from __future__ import annotations

from oracle.build import cut_sql
from oracle.tables import BARS, MACRO, TS


def q(text, digits=4, name=None):
    return f"{cut_sql(text, digits)} AS {name or text.split('.')[-1]}"


def cols(names, digits=4, prefix=""):
    return ", ".join(q(prefix + n, digits, n) for n in names)


OHLCV = ["open", "high", "low", "close", "volume"]


def numbered(table):
    return f"b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS seq FROM ({BARS[table]}))"


def stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


SQL: dict[str, str] = {}
for _n in ("events_hourly", "events_user_daily", "part_daily", "flag_daily", "market_daily", "orders_daily", "panel_daily"):
    SQL[f"bars_{_n}"] = f"SELECT symbol, {TS} AS ts, {cols(OHLCV)} FROM ({BARS[_n]})"

SQL["resample_weekly"] = (
    f"SELECT symbol, {stamp('p')} AS ts, {cols(OHLCV)} FROM (SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS p, arg_min(open, ts) AS open, "
    f"max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({BARS['flag_daily']}) GROUP BY 1, 2)")
SQL["resample_monthly_last"] = (
    f"SELECT symbol, {stamp('date_trunc(' + chr(39) + 'month' + chr(39) + ', ts)::TIMESTAMP')} AS period, {TS} AS ts, {cols(OHLCV)} FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts DESC) AS r FROM ({BARS['flag_daily']})) WHERE r = 1")
SQL["tail_bars"] = (
    f"SELECT symbol, {TS} AS ts, {cols(OHLCV)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r "
    f"FROM ({BARS['flag_daily']})) WHERE r <= 500")
SQL["gap_report"] = (
    f"SELECT symbol, bars, span, span - bars AS missing FROM (SELECT symbol, count(*) AS bars, "
    f"date_diff('day', min(ts), max(ts)) + 1 AS span FROM ({BARS['flag_daily']}) GROUP BY 1)")

SQL["pair_ratio"] = (
    f"WITH b AS ({BARS['flag_daily']}) SELECT {stamp('x.ts')} AS ts, {cut_sql('x.close / y.close')} AS ratio, {cut_sql('x.close - y.close')} AS spread "
    f"FROM b x JOIN b y ON x.ts = y.ts WHERE x.symbol = 'A' AND y.symbol = 'N'")
SQL["unmatched_times"] = (
    f"WITH b AS ({BARS['combo_daily']}), x AS (SELECT ts FROM b WHERE symbol = 'AF'), y AS (SELECT ts FROM b WHERE symbol = 'RF') "
    f"SELECT (SELECT count(*) FROM x WHERE ts NOT IN (SELECT ts FROM y)) AS only_first, "
    f"(SELECT count(*) FROM y WHERE ts NOT IN (SELECT ts FROM x)) AS only_second, (SELECT count(*) FROM x JOIN y USING (ts)) AS matched")
_MAC = ["bullish", "bearish", "pmi", "confidence", "confidence_mean3", "exposure", "rate", "rate_prev", "risk", "inflation", "sentiment"]
SQL["macro_asof"] = f"SELECT symbol, {TS} AS ts, {cols(['close'] + _MAC)} FROM ({BARS['macro_daily']})"
SQL["favourites_short"] = (
    f"SELECT symbol, {TS} AS ts, CASE WHEN close < open THEN -1 ELSE 0 END AS signal FROM ({BARS['part_daily']}) "
    f"WHERE symbol IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 0)")
_SMA = lambda x, n, w="PARTITION BY symbol ORDER BY ts": (
    f"CASE WHEN count({x}) OVER ({w} ROWS {n - 1} PRECEDING) = {n} THEN avg({x}) OVER ({w} ROWS {n - 1} PRECEDING) END")
SQL["breadth_count"] = (
    f"SELECT {TS} AS ts, sum(a)::BIGINT AS holding, count(*) AS symbols FROM (SELECT ts, CASE WHEN close > m THEN 1 ELSE 0 END AS a FROM "
    f"(SELECT *, {_SMA('close', 20)} AS m FROM ({BARS['combo_daily']}))) GROUP BY 1")
SQL["rotation_argmax"] = (
    f"SELECT {TS} AS ts, symbol, {q('ret')} FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol DESC) AS r FROM "
    f"(SELECT *, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM ({BARS['combo_daily']})) WHERE ret IS NOT NULL) WHERE r = 1")
SQL["top_n_momentum"] = (
    f"SELECT symbol, {TS} AS ts, place::INTEGER AS place, {q('ret')} FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', ts) "
    f"ORDER BY ret DESC, symbol, ts) AS place FROM (SELECT *, close / lag(close, 6) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret "
    f"FROM ({BARS['flag_daily']})) WHERE ret IS NOT NULL) WHERE place <= 10")
SQL["signal_merge"] = (
    f"SELECT symbol, {TS} AS ts, 'ma' AS strategy, coalesce(CASE WHEN close > m20 THEN 1 END, CASE WHEN close > m5 THEN 1 WHEN close < m5 THEN -1 END)::DOUBLE AS signal "
    f"FROM (SELECT *, {_SMA('close', 5)} AS m5, {_SMA('close', 20)} AS m20 FROM ({BARS['flag_daily']}))")
SQL["portfolio_weighted"] = (
    f"WITH p AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS a, close_2 / lag(close_2) OVER (ORDER BY ts) - 1 AS b, "
    f"close_3 / lag(close_3) OVER (ORDER BY ts) - 1 AS c FROM ({BARS['panel_daily']})) SELECT {TS} AS ts, {cut_sql('a * 0.4::DOUBLE + b * 0.4::DOUBLE + c * 0.2::DOUBLE')} AS ret, "
    f"{cut_sql('CASE WHEN count(a) OVER w >= 60 THEN covar_samp(a, b) OVER w / var_samp(b) OVER w END')} AS beta FROM p WINDOW w AS (ORDER BY ts ROWS 59 PRECEDING)")

SQL["growth_screen"] = (
    "SELECT p_brand AS symbol, p_partkey AS period, CASE WHEN n = 4 AND m > 25 AND p_size >= 25 AND p_retailprice / 600 >= 1.5 AND p_retailprice / 10 >= 70 "
    "AND p_size / 50.0 > 0.5 AND p_type = 'ECONOMY' THEN 1 ELSE 0 END AS signal FROM (SELECT *, count(*) OVER w AS n, avg(p_size) OVER w AS m FROM part "
    "WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS 3 PRECEDING))")
SQL["market_screen"] = (
    "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CASE WHEN c_acctbal / 500 > 6.5 THEN 1 ELSE -1 END ELSE 0 END AS signal FROM customer")
SQL["value_growth_screen"] = (
    "SELECT p_partkey, CASE WHEN p_size / 50.0::DOUBLE < 0.2::DOUBLE OR p_retailprice / 20000 - 0.05::DOUBLE > 0.15::DOUBLE THEN 1 ELSE -1 END AS signal FROM part")
SQL["ten_bagger_screen"] = (
    "SELECT p_partkey, CASE WHEN (p_retailprice / nullif(p_size * 4.0::DOUBLE - 8, 0) < 15 AND p_size - 25 > 0) OR p_retailprice >= 10 * p_size * 5.0::DOUBLE "
    "THEN 1 ELSE 0 END AS signal FROM part")
SQL["top_yield"] = (
    "SELECT p_partkey::VARCHAR AS symbol, 1 AS signal FROM part ORDER BY p_size / p_retailprice DESC, p_partkey::VARCHAR LIMIT 10")
SQL["implied_over_realised"] = "SELECT p_partkey FROM part WHERE p_size / 50.0::DOUBLE > p_retailprice / 3000 AND p_size / 50.0::DOUBLE > 0.4::DOUBLE"
SQL["custom_predicates"] = (
    f"SELECT symbol, {TS} AS ts, CASE WHEN close > open * 1.5::DOUBLE THEN 1 WHEN close < open * 0.5::DOUBLE THEN -1 ELSE 0 END AS signal FROM ({BARS['flag_daily']})")

SQL["session_breakout"] = (
    f"WITH b AS (SELECT *, ts - INTERVAL 5 HOUR AS loc FROM ({BARS['events_hourly']})), c AS (SELECT *, hour(loc) * 60 + minute(loc) AS m, loc::DATE AS d FROM b), "
    f"r AS (SELECT symbol, d, max(CASE WHEN m >= 570 AND m < 691 THEN high END) AS hi, min(CASE WHEN m >= 570 AND m < 691 THEN low END) AS lo FROM c GROUP BY 1, 2) "
    f"SELECT c.symbol, {stamp('c.ts')} AS ts, CASE WHEN m >= 691 AND high > hi THEN 1 WHEN m >= 691 AND low < lo THEN -1 ELSE 0 END AS signal FROM c JOIN r ON c.symbol = r.symbol AND c.d = r.d")
_FREQ = (
    f"SELECT symbol, month, avg(share) AS frequency FROM (SELECT symbol, year(ts) AS y, month(ts) AS month, avg(CASE WHEN close > p THEN 1.0::DOUBLE ELSE 0 END) AS share "
    f"FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM ({BARS['flag_daily']})) WHERE p IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2")
SQL["seasonality_frequency"] = f"SELECT symbol, month, {q('frequency')} FROM ({_FREQ})"
SQL["seasonal_signal"] = (
    f"SELECT b.symbol, {stamp('b.ts')} AS ts, CASE WHEN frequency >= 0.51 THEN -1 WHEN frequency <= 0.49 THEN 1 ELSE 0 END AS signal "
    f"FROM ({BARS['flag_daily']}) b LEFT JOIN ({_FREQ}) f ON b.symbol = f.symbol AND month(b.ts) = f.month")

SQL["adaptive_cyber_cycle"] = (
    f"WITH {numbered('flag_daily')}, x AS (SELECT *, close - avg(close) OVER (PARTITION BY symbol) AS x, count(*) OVER (PARTITION BY symbol) AS n FROM b), "
    f"pw AS (SELECT symbol, n, k, pow(sum(x * cos(2 * pi() * ((seq * k) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((seq * k) % n) / n)), 2) AS w "
    f"FROM x, (SELECT unnest(range(1, (SELECT max(n) // 2 + 1 FROM x))) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3), "
    f"d AS (SELECT symbol, round_even(any_value(n) / arg_max(k, w), 0) AS p FROM pw GROUP BY 1), "
    f"v AS (SELECT x.symbol, ts, seq, p, sin(2 * pi() * seq / (n - 1) * (2 * pi() / p)) AS a FROM x JOIN d USING (symbol)), "
    f"s AS (SELECT *, a - avg(a) OVER (PARTITION BY symbol) AS c FROM v), t AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY seq) AS z FROM s) "
    f"SELECT symbol, {TS} AS ts, p::INTEGER AS period, CASE WHEN c > 0.5 AND z <= 0.5 THEN 1 WHEN c < -0.5 AND z >= -0.5 THEN -1 ELSE 0 END AS signal FROM t")

# --- state rules as recursive queries: one bar per step -----------------------------------
_PSAR = f"""{numbered('flag_daily')},
r(symbol, seq, side, sar, ep, af, ph, pl, outv, outs) AS (
 SELECT symbol, seq, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, high, low, NULL::DOUBLE, NULL::DOUBLE FROM b WHERE seq = 0
 UNION ALL
 SELECT symbol, seq, nside, nside * least(s2 + af2 * (e2 - s2), nlo1, nlo2), nside * e2, af2, h, l, outv, nside FROM (
  SELECT *, CASE WHEN flip THEN -side0 ELSE side0 END AS nside, CASE WHEN flip THEN -side0 * -greatest(e1, phi, hi) ELSE side0 * s1 END AS outv,
   CASE WHEN flip THEN -greatest(e1, phi, hi) ELSE s1 END AS s2, CASE WHEN flip THEN -lo WHEN hi > e1 THEN hi ELSE e1 END AS e2,
   CASE WHEN flip THEN 0.02::DOUBLE WHEN hi > e1 THEN least(af0 + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af0 END AS af2,
   CASE WHEN flip THEN -phi ELSE plo END AS nlo1, CASE WHEN flip THEN -hi ELSE lo END AS nlo2
  FROM (SELECT *, lo <= s1 AS flip FROM (
   SELECT *, side0 * sar0 AS s1, side0 * ep0 AS e1, CASE WHEN side0 > 0 THEN l ELSE -h END AS lo, CASE WHEN side0 > 0 THEN h ELSE -l END AS hi,
    CASE WHEN side0 > 0 THEN pl0 ELSE -ph0 END AS plo, CASE WHEN side0 > 0 THEN ph0 ELSE -pl0 END AS phi FROM (
    SELECT symbol, seq, h, l, CASE WHEN seq = 1 THEN st ELSE side END AS side0, CASE WHEN seq = 1 THEN CASE WHEN st > 0 THEN pl ELSE ph END ELSE sar END AS sar0,
     CASE WHEN seq = 1 THEN CASE WHEN st > 0 THEN h ELSE l END ELSE ep END AS ep0, CASE WHEN seq = 1 THEN 0.02::DOUBLE ELSE af END AS af0,
     CASE WHEN seq = 1 THEN h ELSE ph END AS ph0, CASE WHEN seq = 1 THEN l ELSE pl END AS pl0 FROM (
     SELECT b.symbol, b.seq, b.high AS h, b.low AS l, r.side, r.sar, r.ep, r.af, r.ph, r.pl,
      CASE WHEN r.pl - b.low > b.high - r.ph AND r.pl - b.low > 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS st
     FROM r JOIN b ON b.symbol = r.symbol AND b.seq = r.seq + 1))))))"""
SQL["psar"] = (
    f"WITH RECURSIVE {_PSAR} SELECT r.symbol, {stamp('b.ts')} AS ts, {cut_sql('outv')} AS sar, outs AS side, {cut_sql('outv * outs')} AS sarext "
    f"FROM r JOIN b USING (symbol, seq)")
SQL["psar_cross"] = (
    f"WITH RECURSIVE {_PSAR}, j AS (SELECT symbol, b.ts, close, outv AS s, lag(close) OVER w AS pc, lag(outv) OVER w AS ps FROM r JOIN b USING (symbol, seq) "
    f"WINDOW w AS (PARTITION BY symbol ORDER BY seq)) SELECT symbol, {TS} AS ts, CASE WHEN close > s AND pc <= ps THEN 1 WHEN close < s AND pc >= ps THEN -1 ELSE 0 END AS signal FROM j")

_HIT = f"{numbered('flag_daily')}, h AS MATERIALIZED (SELECT symbol, ts, seq, close, coalesce(close > {_SMA('close', 20)}, FALSE) AS hit FROM b)"
SQL["cooldown_signals"] = (
    f"WITH RECURSIVE {_HIT}, r(symbol, seq, last, sig) AS (SELECT symbol, seq, CASE WHEN hit THEN seq ELSE -1 END, hit FROM h WHERE seq = 0 UNION ALL "
    f"SELECT h.symbol, h.seq, CASE WHEN h.hit AND (r.last < 0 OR h.seq - r.last >= 10) THEN h.seq ELSE r.last END, h.hit AND (r.last < 0 OR h.seq - r.last >= 10) "
    f"FROM r JOIN h ON h.symbol = r.symbol AND h.seq = r.seq + 1) SELECT symbol, {stamp('h.ts')} AS ts, seq FROM r JOIN h USING (symbol, seq) WHERE sig")
SQL["average_cost_ledger"] = (
    f"WITH RECURSIVE {numbered('flag_daily')}, r(symbol, seq, n, cost, p, sig) AS (SELECT symbol, seq, 0.0::DOUBLE, 0.0::DOUBLE, close, 0 FROM b WHERE seq = 0 UNION ALL "
    f"SELECT symbol, seq, CASE WHEN buy THEN n + 1 WHEN sell THEN 0 ELSE n END, CASE WHEN buy THEN cost + c WHEN sell THEN 0 ELSE cost END, c, "
    f"CASE WHEN buy THEN 1 WHEN sell THEN -1 ELSE 0 END FROM (SELECT b.symbol, b.seq, r.n, r.cost, b.close AS c, b.close < r.p AS buy, "
    f"r.n > 0 AND b.close > r.cost / nullif(r.n, 0) AS sell FROM r JOIN b ON b.symbol = r.symbol AND b.seq = r.seq + 1)) "
    f"SELECT symbol, {stamp('b.ts')} AS ts, sig AS signal, {cut_sql('cost / nullif(n, 0)')} AS average_cost FROM r JOIN b USING (symbol, seq)")
SQL["scale_in_ledger"] = (
    f"WITH RECURSIVE {numbered('flag_daily')}, r(symbol, seq, n, cost, sig) AS (SELECT symbol, seq, 0.1::DOUBLE, 0.1::DOUBLE * close, 1 FROM b WHERE seq = 0 UNION ALL "
    f"SELECT symbol, seq, CASE WHEN buy THEN n + 0.1::DOUBLE ELSE n END, CASE WHEN buy THEN cost + 0.1::DOUBLE * c ELSE cost END, buy::INTEGER "
    f"FROM (SELECT b.symbol, b.seq, r.n, r.cost, b.close AS c, (r.cost / r.n - b.close) / (r.cost / r.n) >= 0.02::DOUBLE AS buy "
    f"FROM r JOIN b ON b.symbol = r.symbol AND b.seq = r.seq + 1)) "
    f"SELECT symbol, {stamp('b.ts')} AS ts, sig AS signal, {cut_sql('cost / nullif(n, 0)')} AS average_cost FROM r JOIN b USING (symbol, seq)")
SQL["martingale_ledger"] = (
    f"WITH RECURSIVE {numbered('flag_daily')}, r(symbol, seq, size, run, p, pnl) AS (SELECT symbol, seq, 1.0::DOUBLE, 0.0::DOUBLE, close, 0.0::DOUBLE FROM b WHERE seq = 0 UNION ALL "
    f"SELECT symbol, seq, CASE WHEN g < 0 AND run < 10 THEN size * 2 ELSE 1 END, CASE WHEN g < 0 AND run < 10 THEN run + 1 ELSE 0 END, c, g FROM "
    f"(SELECT b.symbol, b.seq, r.size, r.run, b.close AS c, (b.close - r.p) * r.size AS g FROM r JOIN b ON b.symbol = r.symbol AND b.seq = r.seq + 1)) "
    f"SELECT symbol, {stamp('b.ts')} AS ts, {q('size')}, {q('pnl', 2)} FROM r JOIN b USING (symbol, seq)")

# --- labels ------------------------------------------------------------------------------------
_TR = ("CASE WHEN seq = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY seq)), "
       "abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY seq))) END")
_GATES = (
    f"{numbered('flag_daily')}, t AS MATERIALIZED (SELECT *, {_TR} AS tr FROM b), g AS MATERIALIZED (SELECT *, "
    f"volume >= avg(volume) OVER (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING) AS ok, "
    f"greatest(avg(tr) OVER (PARTITION BY symbol ORDER BY seq ROWS 13 PRECEDING), 0.0015::DOUBLE) AS need FROM t)")


def _candidates(name, sign):
    later = "OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return (
        f"{name} AS MATERIALIZED (SELECT symbol, seq, ts, CASE WHEN pays THEN x END AS x, CASE WHEN pays THEN best - p END AS profit FROM "
        f"(SELECT *, ok AND best - p >= need AND best - p > 0 AS pays FROM (SELECT *, (m).v AS best, -(m).s AS x FROM "
        f"(SELECT *, {sign} * close AS p, max({{'v': {sign} * close, 's': -seq}}) {later} AS m FROM g))))")


def _greedy(name, cand):
    return (
        f"{name}(symbol, seq, last, keep) AS (SELECT symbol, seq, coalesce(x, -1), x IS NOT NULL FROM {cand} WHERE seq = 0 UNION ALL "
        f"SELECT c.symbol, c.seq, CASE WHEN c.x IS NOT NULL AND c.seq > r.last THEN c.x ELSE r.last END, c.x IS NOT NULL AND c.seq > r.last "
        f"FROM {name} r JOIN {cand} c ON c.symbol = r.symbol AND c.seq = r.seq + 1)")


SQL["best_later_exit"] = f"WITH {_GATES}, {_candidates('cl', '1')} SELECT symbol, seq, x::DOUBLE AS exit_seq, {q('profit')} FROM cl"
_TRUTH = (
    f"{_GATES}, {_candidates('cl', '1')}, {_candidates('cs', '-1')}, {_greedy('rl', 'cl')}, {_greedy('rs', 'cs')}, "
    f"trades AS MATERIALIZED (SELECT symbol, 'long' AS side, seq AS entry_seq, x AS exit_seq, profit FROM rl JOIN cl USING (symbol, seq) WHERE keep UNION ALL "
    f"SELECT symbol, 'short', seq, x, profit FROM rs JOIN cs USING (symbol, seq) WHERE keep)")
SQL["truth_trades_suffix"] = f"WITH RECURSIVE {_TRUTH} SELECT symbol, side, entry_seq, exit_seq, {q('profit')} FROM trades"


def _optimal(name, sign):
    """Backwards, bar by bar, with lists of all later prices and of what each is worth as an exit; then forwards."""
    return (
        f"{name}(symbol, seq, dp, ps, ws, x) AS (SELECT symbol, seq, 0.0::DOUBLE, [close * {sign}]::DOUBLE[], [close * {sign}]::DOUBLE[], NULL::BIGINT FROM g WHERE seq = (SELECT max(seq) FROM g o WHERE o.symbol = g.symbol) UNION ALL "
        f"SELECT symbol, seq, greatest(dp, coalesce(best, dp)), list_append(ps, p), list_append(ws, p + dp), CASE WHEN best > dp THEN seq + 1 + len(ws) - list_position(open, list_max(open)) END FROM ("
        f"SELECT g.symbol, g.seq, r.dp, r.ps, r.ws, g.close * {sign} AS p, list_transform(r.ws, lambda w, i: CASE WHEN g.ok AND r.ps[i] - g.close * {sign} >= g.need THEN w END) AS open, list_max(list_transform(r.ws, lambda w, i: CASE WHEN g.ok AND r.ps[i] - g.close * {sign} >= g.need THEN w END)) - g.close * {sign} AS best "
        f"FROM {name} r JOIN g ON g.symbol = r.symbol AND g.seq = r.seq - 1))"
    )


def _taken(name, of):
    return (
        f"{name}(symbol, seq, last, keep) AS (SELECT symbol, seq, coalesce(x, -1), x IS NOT NULL FROM {of} WHERE seq = 0 UNION ALL SELECT c.symbol, c.seq, CASE WHEN c.x IS NOT NULL AND c.seq > r.last THEN c.x ELSE r.last END, "
        f"c.x IS NOT NULL AND c.seq > r.last FROM {name} r JOIN {of} c ON c.symbol = r.symbol AND c.seq = r.seq + 1)"
    )


SQL["truth_trades_optimal"] = (
    f"WITH RECURSIVE {_GATES}, {_optimal('ol', '1')}, {_optimal('os', '-1')}, xl AS MATERIALIZED (SELECT symbol, seq, x FROM ol), xs AS MATERIALIZED (SELECT symbol, seq, x FROM os), {_taken('kl', 'xl')}, {_taken('ks', 'xs')}, "
    f"o AS (SELECT symbol, 'long' AS side, 1 AS s, seq, x FROM kl JOIN xl USING (symbol, seq) WHERE keep UNION ALL SELECT symbol, 'short', -1, seq, x FROM ks JOIN xs USING (symbol, seq) WHERE keep) "
    f"SELECT t.symbol, side, t.seq AS entry_seq, x AS exit_seq, {cut_sql('(b.close - a.close) * s')} AS profit FROM o t JOIN g a ON a.symbol = t.symbol AND a.seq = t.seq JOIN g b ON b.symbol = t.symbol AND b.seq = t.x")
SQL["close_marks"] = (
    f"WITH RECURSIVE {_TRUTH}, n AS (SELECT *, lead(entry_seq) OVER (PARTITION BY symbol ORDER BY entry_seq, side) - 1 AS bn FROM trades), "
    f"k AS (SELECT symbol, CASE WHEN bn > entry_seq THEN bn ELSE exit_seq END AS seq FROM n) "
    f"SELECT b.symbol, b.seq, CASE WHEN EXISTS (SELECT 1 FROM trades t WHERE t.symbol = b.symbol AND t.entry_seq = b.seq AND side = 'long') THEN 1 ELSE 0 END AS long_signal, "
    f"CASE WHEN EXISTS (SELECT 1 FROM trades t WHERE t.symbol = b.symbol AND t.entry_seq = b.seq AND side = 'short') THEN 1 ELSE 0 END AS short_signal, "
    f"CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.symbol = b.symbol AND k.seq = b.seq) THEN 1 ELSE 0 END AS close_position FROM b")

# --- ledgers: position carried bar by bar ----------------------------------------------------------
_SIG = (
    f"{numbered('flag_daily')}, m AS MATERIALIZED (SELECT *, {_SMA('close', 5)} AS f, {_SMA('close', 20)} AS s, "
    f"coalesce(greatest(close - lag(close) OVER (PARTITION BY symbol ORDER BY seq), 0), 0) AS u, "
    f"coalesce(greatest(lag(close) OVER (PARTITION BY symbol ORDER BY seq) - close, 0), 0) AS d FROM b), "
    f"m2 AS MATERIALIZED (SELECT *, lag(f) OVER (PARTITION BY symbol ORDER BY seq) AS pf, lag(s) OVER (PARTITION BY symbol ORDER BY seq) AS ps, "
    f"CASE WHEN seq >= 13 THEN avg(u) OVER (PARTITION BY symbol ORDER BY seq ROWS 13 PRECEDING) END AS au, "
    f"CASE WHEN seq >= 13 THEN avg(d) OVER (PARTITION BY symbol ORDER BY seq ROWS 13 PRECEDING) END AS ad FROM m), "
    f"k AS MATERIALIZED (SELECT symbol, seq, ts, close, coalesce(f > s AND pf <= ps, FALSE) AS lo, coalesce(f < s AND pf >= ps, FALSE) AS sh, "
    f"coalesce(CASE WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / nullif(ad, 0)) END NOT BETWEEN 40 AND 60, FALSE) AS cl FROM m2)")
_LEDGER = (
    f"{_SIG}, r(symbol, seq, pos, es, opened, closed, cpos, ces) AS (SELECT symbol, seq, CASE WHEN lo THEN 1 WHEN sh THEN -1 ELSE 0 END, seq, lo OR sh, FALSE, 0, 0::BIGINT FROM k WHERE seq = 0 "
    f"UNION ALL SELECT symbol, seq, CASE WHEN base = 0 THEN CASE WHEN lo THEN 1 WHEN sh THEN -1 ELSE 0 END ELSE base END, CASE WHEN base = 0 AND (lo OR sh) THEN seq ELSE es END, "
    f"base = 0 AND (lo OR sh), cl AND pos <> 0, pos, es FROM (SELECT k.*, r.pos, r.es, CASE WHEN k.cl THEN 0 ELSE r.pos END AS base FROM r JOIN k ON k.symbol = r.symbol AND k.seq = r.seq + 1)), "
    f"opens AS (SELECT r.symbol, r.seq AS entry_seq, r.pos, k.ts AS entry_ts, k.close AS entry_px FROM r JOIN k USING (symbol, seq) WHERE opened), "
    f"closes AS (SELECT r.symbol, r.ces AS entry_seq, r.seq AS exit_seq, k.ts AS exit_ts, k.close AS exit_px FROM r JOIN k USING (symbol, seq) WHERE closed), "
    f"trades AS MATERIALIZED (SELECT o.symbol, CASE WHEN pos > 0 THEN 'long' ELSE 'short' END AS side, entry_seq, entry_ts, entry_px, exit_seq, exit_ts, exit_px, "
    f"(exit_px - entry_px) * pos * 1000.0::DOUBLE AS pnl FROM opens o LEFT JOIN closes USING (symbol, entry_seq))")
SQL["trade_ledger"] = (
    f"WITH RECURSIVE {_LEDGER} SELECT symbol, side, entry_seq, exit_seq::DOUBLE AS exit_seq, {q('entry_px')}, {q('exit_px')}, {q('pnl', 1)} FROM trades")
SQL["trade_summary"] = (
    f"WITH RECURSIVE {_LEDGER} SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, {cut_sql('sum(pnl)', 1)} AS pnl, "
    f"{cut_sql('max(pnl)', 1)} AS best, {cut_sql('min(pnl)', 1)} AS worst FROM trades WHERE exit_ts IS NOT NULL GROUP BY 1")
SQL["trade_balance"] = (
    f"WITH RECURSIVE {_LEDGER} SELECT symbol, side, {stamp('exit_ts')} AS exit_ts, "
    f"{cut_sql('sum(pnl) OVER (PARTITION BY symbol ORDER BY exit_ts) + 10000.0::DOUBLE', 1)} AS balance FROM trades WHERE exit_ts IS NOT NULL")
SQL["trade_log"] = (
    f"WITH RECURSIVE {_LEDGER} SELECT symbol, {stamp('entry_ts')} AS ts, CASE WHEN side = 'long' THEN 'Buy' ELSE 'Sell' END AS action, {cut_sql('entry_px')} AS price FROM trades "
    f"UNION ALL SELECT symbol, {stamp('exit_ts')}, 'Close', {cut_sql('exit_px')} FROM trades WHERE exit_ts IS NOT NULL")


def _reversal(table):
    return (
        f"{numbered(table)}, m AS (SELECT *, {_SMA('close', 5)} AS f, {_SMA('close', 20)} AS s FROM b), "
        f"m2 AS (SELECT *, lag(f) OVER (PARTITION BY symbol ORDER BY seq) AS pf, lag(s) OVER (PARTITION BY symbol ORDER BY seq) AS ps FROM m), "
        f"e AS (SELECT symbol, seq, ts, close, CASE WHEN f > s AND pf <= ps THEN 1 WHEN f < s AND pf >= ps THEN -1 END AS sig FROM m2), "
        f"e2 AS (SELECT *, lag(sig) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM e WHERE sig IS NOT NULL), "
        f"t AS (SELECT * FROM e2 WHERE before IS NULL OR before <> sig), "
        f"trades AS (SELECT symbol, CASE WHEN sig > 0 THEN 'long' ELSE 'short' END AS side, seq AS entry_seq, ts AS entry_ts, lead(seq) OVER w AS exit_seq, lead(ts) OVER w AS exit_ts, "
        f"(lead(close) OVER w - close) * sig AS pnl FROM t WINDOW w AS (PARTITION BY symbol ORDER BY seq))")


SQL["reversal_ledger"] = f"WITH {_reversal('flag_daily')} SELECT symbol, side, entry_seq, exit_seq::DOUBLE AS exit_seq, {q('pnl')} FROM trades"
SQL["market_cross_trades"] = (
    f"WITH {_reversal('events_hourly')} SELECT symbol, side, {stamp('entry_ts')} AS entry_ts, {stamp('exit_ts')} AS exit_ts, {q('pnl')} FROM trades")

# --- preparation -------------------------------------------------------------------------------
_P = "(VALUES (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.99::DOUBLE)) t(p)"
_QS = [("l_quantity", p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)]
SQL["exact_quantiles"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS p, {cut_sql(f'quantile_cont({c}, {p})')} AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount") for p in (0.01, 0.25, 0.5, 0.75, 0.99))
SQL["winsor_rank_log"] = (
    f"WITH b AS MATERIALIZED ({BARS['part_daily']}), q AS (SELECT quantile_cont(volume, 0.01) AS lo, quantile_cont(volume, 0.99) AS hi, count(*) AS n FROM b) "
    f"SELECT symbol, {TS} AS ts, {cut_sql('ln(1 + volume)', 5)} AS volume_log, {cut_sql('greatest(least(volume, hi), lo)', 5)} AS volume_winsor, "
    f"{cut_sql('(rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0::DOUBLE) / n', 5)} AS volume_rank FROM b, q")
SQL["robust_scale"] = (
    f"WITH {numbered('flag_daily')}, c AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars FROM b), "
    f"q AS (SELECT quantile_cont(close, 0.5) AS cm, quantile_cont(close, 0.9) - quantile_cont(close, 0.1) AS cw, quantile_cont(volume, 0.5) AS vm, "
    f"quantile_cont(volume, 0.9) - quantile_cont(volume, 0.1) AS vw FROM c WHERE seq < floor(bars * 0.8::DOUBLE)) "
    f"SELECT symbol, {TS} AS ts, {cut_sql('greatest(least((close - cm) / cw, 10), -10)')} AS close, {cut_sql('greatest(least((volume - vm) / vw, 10), -10)')} AS volume FROM c, q")
SQL["sliding_windows"] = (
    f"WITH {numbered('flag_daily')}, c AS (SELECT symbol, seq, count(*) OVER (PARTITION BY symbol) AS bars, sum(close::FLOAT::DOUBLE + volume::FLOAT::DOUBLE) OVER w AS total, "
    f"lag(close::FLOAT::DOUBLE, 29) OVER v AS first, lead(close::FLOAT::DOUBLE, 5) OVER v AS last_ahead FROM b "
    f"WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 29 PRECEDING), v AS (PARTITION BY symbol ORDER BY seq)) "
    f"SELECT symbol, seq, 60 AS len, {q('total', 1)}, {q('first', 1)}, {q('last_ahead', 1)} FROM c WHERE seq >= 29 AND seq < bars - 5")
SQL["label_encode"] = (
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY coalesce(lower(trim(o_orderpriority)), '0')) - 1)::INTEGER AS priority, "
    "(dense_rank() OVER (ORDER BY coalesce(lower(trim(o_orderstatus)), '0')) - 1)::INTEGER AS status FROM orders")
SQL["skew_fill"] = (
    f"WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN user_id::DOUBLE END AS u FROM events), "
    f"s AS (SELECT CASE WHEN abs(skewness(value)) > 1 THEN median(value) ELSE avg(value) END AS fv, CASE WHEN abs(skewness(u)) > 1 THEN median(u) ELSE avg(u) END AS fu FROM e) "
    f"SELECT event_id, {cut_sql('coalesce(value, fv)')} AS value, {cut_sql('coalesce(u, fu)')} AS user FROM e, s")
SQL["duplicate_columns"] = (
    "SELECT * FROM (SELECT 'copy_a' AS duplicate UNION ALL SELECT 'copy_b' UNION ALL SELECT 'almost' FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey = 0) WHERE n = 0)")
SQL["head_rows"] = (
    f"WITH {numbered('flag_daily')} SELECT symbol, count(*) AS rows, min(seq) AS first, {cut_sql('sum(close)', 2)} AS total FROM b WHERE seq >= 200 AND seq < 1000 GROUP BY 1")
SQL["time_folds"] = (
    f"WITH {numbered('flag_daily')}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars FROM b), d AS (SELECT *, bars // 6 AS size FROM c), "
    f"f AS (SELECT symbol, seq, CASE WHEN seq < bars - 5 * size THEN -1 ELSE ((seq - (bars - 5 * size)) // size) END::INTEGER AS fold, seq < floor(bars * 0.8::DOUBLE) AS train FROM d) "
    f"SELECT symbol, fold, train, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM f GROUP BY 1, 2, 3")
SQL["class_weights"] = (
    f"SELECT doc_id, {cut_sql('(count(*) OVER ())::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality))', 6)} AS weight FROM labels")

# --- selection ----------------------------------------------------------------------------------
_FT = (
    f"{numbered('flag_daily')}, ft AS MATERIALIZED (SELECT symbol, seq, open, high, low, close, volume, {_SMA('close', 5)} AS mean5, {_SMA('close', 20)} AS mean20, "
    f"CASE WHEN seq >= 19 THEN stddev_samp(close) OVER (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING) END AS std20, "
    f"close / lag(close) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS ret, CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY seq) > close THEN 1 ELSE 0 END AS label FROM b), "
    "u AS MATERIALIZED (SELECT symbol, seq, label, x.f AS feature, x.v AS value FROM ft, unnest(["
    + ", ".join(f"{{'f': '{c}', 'v': {c}}}" for c in ("open", "high", "low", "close", "volume", "mean5", "mean20", "std20", "ret"))
    + "]) t(x))")
SQL["feature_profile"] = (
    f"WITH {_FT}, s AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM u GROUP BY 1), "
    f"n AS (SELECT feature, count(value) AS n, count(*) - count(value) AS nulls, avg(value) AS m, stddev_samp(value) AS sd, corr(value, label) AS tc FROM u GROUP BY 1), "
    f"k AS (SELECT u.feature, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4, "
    f"avg(CASE WHEN value IS NULL THEN NULL WHEN value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS os FROM u JOIN n USING (feature) JOIN s USING (feature) GROUP BY 1) "
    f"SELECT feature, nulls, {cut_sql('m', 2)} AS mean, {cut_sql('sd', 2)} AS std, {cut_sql('m3 / pow(m2, 1.5)', 2)} AS skew, {cut_sql('m4 / (m2 * m2) - 3', 2)} AS kurtosis, "
    f"{cut_sql('tc', 2)} AS target_corr, {cut_sql('med', 2)} AS median, {cut_sql('q3 - q1', 2)} AS iqr, {cut_sql('os', 2)} AS outlier_share FROM n JOIN s USING (feature) JOIN k USING (feature)")
SQL["constant_filter"] = (
    f"WITH {_FT} SELECT feature FROM (SELECT feature, stddev_samp(value) AS sd FROM u GROUP BY 1 UNION ALL SELECT 'flat', 0) WHERE sd <= 1e-10")
SQL["corr_filter"] = (
    f"WITH {_FT}, w AS (SELECT *, count(value) OVER (PARTITION BY symbol, seq) AS full_row FROM (SELECT symbol, seq, feature, value FROM u UNION ALL "
    f"SELECT symbol, seq, 'twin', close * 2.0::DOUBLE + volume * 1e-9::DOUBLE FROM ft)), v AS (SELECT feature, var_samp(value) AS v FROM w GROUP BY 1), "
    f"c AS (SELECT a.feature AS x, b.feature AS y, corr(a.value, b.value) AS c FROM w a JOIN w b ON a.symbol = b.symbol AND a.seq = b.seq AND a.feature < b.feature "
    f"WHERE a.full_row = 10 GROUP BY 1, 2) SELECT DISTINCT CASE WHEN p.v < q.v THEN x ELSE y END AS feature FROM c JOIN v p ON p.feature = x JOIN v q ON q.feature = y WHERE abs(c) > 0.95")
_MI = (
    "lim AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM u WHERE value IS NOT NULL GROUP BY 1), "
    "j AS (SELECT u.feature, coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * 10), 9), 0) AS bin, label, count(*)::DOUBLE AS n FROM u JOIN lim USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2, 3), "
    "mi AS (SELECT feature, sum(n / t * ln(n * t / (nb * nl))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, "
    "sum(n) OVER (PARTITION BY feature, label) AS nl FROM j) GROUP BY 1)")
SQL["mutual_information"] = f"WITH {_FT}, {_MI} SELECT feature, {cut_sql('mi', 6)} AS mi FROM mi"
SQL["autocorr_top"] = (
    f"WITH {numbered('flag_daily')}, r AS MATERIALIZED (SELECT symbol, seq, close / lag(close) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS x FROM b), "
    f"c AS (SELECT a.symbol, k.lag, corr(a.x, z.x) AS c FROM range(1, 100) k(lag) JOIN r a ON TRUE JOIN r z ON z.symbol = a.symbol AND z.seq = a.seq - k.lag "
    f"WHERE a.x IS NOT NULL AND z.x IS NOT NULL GROUP BY 1, 2) SELECT symbol, lag::INTEGER AS lag, place::INTEGER AS place, {cut_sql('c', 6)} AS corr FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(c) DESC, lag) AS place FROM c) WHERE place <= 5")
SQL["ensemble_rank"] = (
    f"WITH {_FT}, {_MI}, s AS (SELECT 'mi' AS method, feature, mi AS score, mi > 0.001 AS chosen FROM mi UNION ALL SELECT 'corr', feature, abs(corr(value, label)), abs(corr(value, label)) > 0.01 FROM u GROUP BY feature) "
    f"SELECT feature, {cut_sql('0.6::DOUBLE * sum(chosen::INTEGER) / 2 + 0.4::DOUBLE * sum(score / top) / 2', 5)} AS rank_score FROM (SELECT *, max(score) OVER (PARTITION BY method) AS top FROM s) GROUP BY feature")

# --- evaluation ----------------------------------------------------------------------------------
_PRED = (
    "p AS (SELECT vec_id AS ts, CASE WHEN label % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, m.model, m.i::DOUBLE AS weight, "
    "1 / (1 + exp(-(embedding[m.i]::DOUBLE))) AS probability FROM embeddings, (VALUES ('LSTM', 1), ('GRU', 2), ('Conv1D', 3), ('Conv1D_LSTM', 4)) m(model, i))")
SQL["calibrate"] = f"WITH {_PRED} SELECT ts, model, side, {cut_sql('1 / (1 + exp(-(2 * probability - 1)))', 6)} AS calibrated FROM p"
SQL["vote_ensemble"] = (
    f"WITH {_PRED}, v AS (SELECT ts, side, count(*) AS models, sum(probability * weight) / sum(weight) AS vote FROM p GROUP BY 1, 2) "
    f"SELECT ts, side, models, CASE WHEN vote > 0.4 THEN 1 ELSE 0 END AS signal, {cut_sql('vote', 6)} AS vote FROM v")
_LIMITS = (
    "(VALUES ('LSTM', 'buy', 0.6::DOUBLE), ('GRU', 'buy', 0.433::DOUBLE), ('Conv1D', 'buy', 0.5::DOUBLE), ('Conv1D_LSTM', 'buy', 0.5::DOUBLE), "
    "('LSTM', 'sell', 0.4::DOUBLE), ('GRU', 'sell', 0.4::DOUBLE), ('Conv1D', 'sell', 0.6::DOUBLE), ('Conv1D_LSTM', 'sell', 0.4::DOUBLE)) l(model, side, t)")
SQL["threshold_signals"] = (
    f"WITH {_PRED} SELECT model, side, count(*) AS n, count(*) FILTER (probability > t) AS signals, {cut_sql('avg(CASE WHEN probability > t THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS rate, "
    f"{cut_sql('avg(probability)', 6)} AS avg_probability, {cut_sql('min(probability)', 6)} AS min_probability, {cut_sql('max(probability)', 6)} AS max_probability FROM p JOIN {_LIMITS} USING (model, side) GROUP BY 1, 2")
SQL["tiered_rule"] = (
    "WITH e AS (SELECT vec_id, 1 / (1 + exp(-4 * embedding[1]::DOUBLE)) AS b, 1 / (1 + exp(-4 * embedding[2]::DOUBLE)) AS s, 1 / (1 + exp(-4 * embedding[3]::DOUBLE)) AS d, "
    "embedding[4] AS r1, embedding[5] AS r5, embedding[6] AS r14 FROM embeddings) SELECT vec_id, "
    "CASE WHEN b > 0.6 AND s < 0.4 AND d > 0.55 AND r1 > 0 AND r5 > 0 AND r14::DOUBLE > 0.0005 THEN 1 ELSE 0 END AS signal, "
    + cut_sql("0.4::DOUBLE * b + 0.3::DOUBLE * (1 - s) + 0.3::DOUBLE * d", 6) + " AS confidence FROM e")
SQL["forecast_metrics"] = (
    f"WITH {numbered('flag_daily')}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars, close::FLOAT::DOUBLE AS x FROM b), "
    f"s AS (SELECT k.k - 1 AS step, z.x AS a, c.x AS p FROM c JOIN range(1, 6) k(k) ON TRUE JOIN c z ON z.symbol = c.symbol AND z.seq = c.seq + k.k WHERE c.seq >= 4 AND c.seq < c.bars - 5), "
    f"t AS (SELECT * FROM s UNION ALL SELECT -1, a, p FROM s) SELECT step::INTEGER AS step, count(*) AS n, {cut_sql('sqrt(avg(pow(a - p, 2)))', 2)} AS rmse, {cut_sql('avg(abs(a - p))', 2)} AS mae, "
    f"{cut_sql('1 - avg(pow(a - p, 2)) / var_pop(a)', 2)} AS r2 FROM t GROUP BY 1")
SQL["interval_forecast"] = (
    f"WITH {numbered('flag_daily')}, g AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS g FROM b), e AS (SELECT sqrt(avg(pow(g - close, 2))) AS r FROM g WHERE g IS NOT NULL) "
    f"SELECT symbol, {TS} AS ts, {cut_sql('g - 1.96::DOUBLE * r', 2)} AS lower, {cut_sql('g + 1.96::DOUBLE * r', 2)} AS upper FROM g, e WHERE g IS NOT NULL")
SQL["direction_scores"] = (
    f"WITH {numbered('flag_daily')}, g AS (SELECT *, (open + close) / 2 AS g FROM b), d AS (SELECT *, close - lag(close) OVER w AS da, g - lag(g) OVER w AS dg FROM g WINDOW w AS (PARTITION BY symbol ORDER BY seq)), "
    f"s AS (SELECT symbol, avg(CASE WHEN da IS NULL THEN NULL WHEN sign(da) = sign(dg) THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(abs(close - g)) AS mae, stddev_pop(close) AS sd FROM d GROUP BY 1) "
    f"SELECT symbol, {cut_sql('acc', 6)} AS direction_accuracy, {cut_sql('0.3::DOUBLE * (1 - acc) + 0.7::DOUBLE * tanh(mae / sd)', 6)} AS loss FROM s")
SQL["asymmetric_loss"] = (
    f"SELECT {cut_sql('avg(CASE WHEN close - open > 0 THEN 2.0::DOUBLE * pow(close - open, 2) ELSE pow(close - open, 2) END)', 0)} AS loss FROM ({BARS['flag_daily']})")
SQL["class_balance"] = f"SELECT quality AS label, count(*) AS n, {cut_sql('count(*)::DOUBLE / (SELECT count(*) FROM labels)', 6)} AS share FROM labels GROUP BY 1"
SQL["structure_report"] = (
    f"WITH {_FT} SELECT (SELECT count(*) FROM ft) AS rows, 9 AS features, (SELECT count(*) FROM u WHERE value IS NULL) AS nulls, "
    f"(SELECT count(*) FROM ft WHERE label = 1) AS positives, {cut_sql('(SELECT avg(label::DOUBLE) FROM ft)', 6)} AS rate")

# --- streaming: what the closed windows must hold -----------------------------------------------------
SQL["stream_bars"] = f"SELECT symbol, {TS} AS ts, {cols(OHLCV)} FROM ({BARS['events_hourly']})"
_Q12, _Q26, _Q14 = 2 / 13, 2 / 27, 1 / 14
SQL["stream_signals"] = (
    f"WITH RECURSIVE {numbered('events_hourly')}, m AS MATERIALIZED (SELECT *, {_SMA('close', 20)} AS sma, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY seq), 0) AS d FROM b), "
    f"r(symbol, seq, ef, es, g, l, last, sig) AS (SELECT symbol, seq, close, close, 0.0::DOUBLE, 0.0::DOUBLE, -1::BIGINT, 0 FROM m WHERE seq = 0 UNION ALL "
    f"SELECT symbol, seq, ef, es, g, l, CASE WHEN hit THEN seq ELSE last END, hit::INTEGER FROM (SELECT m.symbol, m.seq, r.ef + (m.close - r.ef) * {_Q12!r}::DOUBLE AS ef, r.es + (m.close - r.es) * {_Q26!r}::DOUBLE AS es, "
    f"r.g + (greatest(m.d, 0) - r.g) / 14 AS g, r.l + (greatest(-m.d, 0) - r.l) / 14 AS l, r.last, coalesce(m.close > m.sma, FALSE) AND (r.last < 0 OR m.seq - r.last >= 10) AS hit "
    f"FROM r JOIN m ON m.symbol = r.symbol AND m.seq = r.seq + 1)) SELECT symbol, {stamp('m.ts')} AS ts, sig AS signal, {q('close')}, {q('sma')}, {cut_sql('ef')} AS ema_fast, {cut_sql('es')} AS ema_slow, "
    f"{cut_sql('CASE WHEN seq >= 13 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END END')} AS rsi FROM r JOIN m USING (symbol, seq)")

# --- walk forward: every fold fitted by a join to all rows whose label bar lies before it -----------------------
_QUARTER = "(year({0}) * 4 + quarter({0}) - 1)"
_WALK = f"""{numbered('flag_daily')},
e AS (SELECT *, avg(close) OVER w AS a, min(close) OVER w AS lo, max(close) OVER w AS hi, lag(close) OVER o AS c1, lag(close, 5) OVER o AS c5,
 lead(close, 5) OVER o / close - 1 AS ahead, lead(ts, 5) OVER o AS seen, {_QUARTER.format('ts')} AS fold
 FROM b WINDOW o AS (PARTITION BY symbol ORDER BY seq), w AS (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING)),
x AS MATERIALIZED (SELECT * FROM (SELECT symbol, seq, ts, fold, {_QUARTER.format('seen')} AS known, ahead, model, feature, v, count(v) OVER (PARTITION BY symbol, seq, model) = count(*) OVER (PARTITION BY symbol, seq, model) AS whole
 FROM e, LATERAL (VALUES ('trend', 1, CASE WHEN seq >= 19 THEN close / a - 1 END), ('trend', 2, close / c5 - 1), ('trend', 3, CASE WHEN seq >= 19 AND hi > lo THEN (close - lo) / (hi - lo) END),
  ('swing', 1, close / c1 - 1), ('swing', 2, (high - low) / close)) t(model, feature, v)) WHERE whole),
y AS MATERIALIZED (SELECT *, CASE WHEN side = 'buy' THEN ahead > 0.002 ELSE ahead < -0.002 END AS hit FROM x, (VALUES ('buy'), ('sell')) t(side) WHERE ahead IS NOT NULL),
fit AS (SELECT g.symbol, g.fold, side, model, feature, count(*) FILTER (hit) AS n1, count(*) FILTER (NOT hit) AS n0, avg(v) AS m, sqrt(var_pop(v)) AS d,
 avg(v) FILTER (hit) AS m1, avg(v) FILTER (NOT hit) AS m0, greatest(var_pop(v) FILTER (hit), var_pop(v) * 1e-6) AS v1, greatest(var_pop(v) FILTER (NOT hit), var_pop(v) * 1e-6) AS v0
 FROM (SELECT DISTINCT symbol, fold FROM e) g JOIN y ON y.symbol = g.symbol AND y.known < g.fold GROUP BY ALL HAVING n1 >= 50 AND n0 >= 50),
z AS (SELECT x.symbol, seq, side, model, ln(any_value(n1) / any_value(n0)) + sum(power(h - m0, 2) / (2 * v0) + ln(v0) / 2 - power(h - m1, 2) / (2 * v1) - ln(v1) / 2) AS z
 FROM (SELECT x.*, f.* EXCLUDE (symbol, fold, model, feature), greatest(least(v, m + 5 * d), m - 5 * d) AS h FROM x JOIN fit f USING (symbol, fold, model, feature)) x GROUP BY ALL),
p AS MATERIALIZED (SELECT symbol, seq, side, model, 1 / (1 + exp(-(2 / (1 + exp(-z)) - 1))) AS p FROM z),
k AS MATERIALIZED (SELECT b.symbol, b.seq, m.side, m.model, coalesce(p.p > 0.5, false) AS hit FROM b CROSS JOIN (SELECT DISTINCT side, model FROM p) m LEFT JOIN p ON p.symbol = b.symbol AND p.seq = b.seq AND p.side = m.side AND p.model = m.model),
r(symbol, side, model, seq, last, sig) AS (SELECT symbol, side, model, seq, CASE WHEN hit THEN seq ELSE -1 END, hit FROM k WHERE seq = 0 UNION ALL
 SELECT k.symbol, k.side, k.model, k.seq, CASE WHEN k.hit AND (last < 0 OR k.seq - last >= 10) THEN k.seq ELSE last END, k.hit AND (last < 0 OR k.seq - last >= 10)
 FROM r JOIN k ON k.symbol = r.symbol AND k.side = r.side AND k.model = r.model AND k.seq = r.seq + 1),
w AS (SELECT p.symbol, p.seq, p.side, p.model, p.p, r.sig::INTEGER AS signal FROM p JOIN r USING (symbol, seq, side, model)
 UNION ALL SELECT symbol, seq, side, 'ensemble', avg(p), (avg(p) > 0.4)::INTEGER FROM p GROUP BY ALL)"""
SQL["walk_forward"] = (
    f"WITH RECURSIVE {_WALK} SELECT w.symbol, {stamp('e.ts')} AS ts, e.fold::INTEGER AS fold, side, model, signal, {q('p', 4, 'probability')} FROM w JOIN e USING (symbol, seq)")
SQL["walk_forward_trades"] = (
    f"""WITH RECURSIVE {_WALK},
g AS (SELECT b.symbol, b.seq, b.close, coalesce(s, 0) AS s FROM b LEFT JOIN (SELECT symbol, seq, sum(CASE WHEN side = 'buy' THEN signal ELSE -signal END) AS s FROM w WHERE model = 'trend' GROUP BY ALL) USING (symbol, seq)),
h AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS held FROM g),
t AS (SELECT *, lag(held) OVER (PARTITION BY symbol ORDER BY seq) AS old FROM h),
u AS (SELECT *, lead(seq) OVER o AS exit_seq, lead(close) OVER o AS exit_px FROM t WHERE old IS NULL OR held <> old WINDOW o AS (PARTITION BY symbol ORDER BY seq)),
v AS (SELECT *, (exit_px - close) * held AS pnl FROM u WHERE held <> 0)
SELECT symbol, CASE WHEN held > 0 THEN 'long' ELSE 'short' END AS side, seq AS entry_seq, exit_seq::DOUBLE AS exit_seq, {q('pnl', 2)},
 CASE WHEN exit_seq IS NOT NULL THEN {cut_sql('sum(pnl) OVER (PARTITION BY symbol ORDER BY seq) + 10000.0::DOUBLE', 2)} END AS balance FROM v""")
_W20 = "OVER (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING)"
SQL["stream_context"] = (
    f"WITH RECURSIVE {numbered('events_hourly')}, m AS MATERIALIZED (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS c, "
    f"CASE WHEN seq >= 19 THEN sum((high + low + close) / 3 * volume) {_W20} / nullif(sum(volume) {_W20}, 0) END AS vwap, CASE WHEN seq >= 19 THEN max(high) {_W20} END AS top, CASE WHEN seq >= 19 THEN min(low) {_W20} END AS bottom FROM b), "
    f"r(symbol, seq, atr) AS (SELECT symbol, seq, (high - low)::DOUBLE FROM m WHERE seq = 0 UNION ALL SELECT m.symbol, m.seq, r.atr + (greatest(m.high, m.c) - least(m.low, m.c) - r.atr) / 14 FROM r JOIN m ON m.symbol = r.symbol AND m.seq = r.seq + 1) "
    f"SELECT symbol, {stamp('m.ts')} AS ts, 0::BIGINT AS repeats, {cut_sql('atr')} AS atr, {cut_sql('sum(coalesce(sign(close - c), 0) * volume) OVER (PARTITION BY symbol ORDER BY seq)')} AS obv, {q('vwap')}, {q('top')}, {q('bottom')} FROM r JOIN m USING (symbol, seq)")

SQL["statements_asof"] = (
    f"WITH b AS ({BARS['flag_daily']}), m AS (SELECT l_returnflag AS symbol, date_trunc('month', l_shipdate) AS m, sum(l_extendedprice * (1 - l_discount)) AS turnover, sum(l_extendedprice * l_tax) AS tax FROM lineitem GROUP BY 1, 2), "
    f"r AS (SELECT symbol, (m + INTERVAL 1 MONTH + INTERVAL 10 DAY)::TIMESTAMP AS ts, CASE WHEN symbol = 'R' THEN 1 ELSE 2 END AS version, CASE WHEN symbol = 'R' THEN turnover ELSE turnover - tax END AS value FROM m) "
    f"SELECT b.symbol, {stamp('b.ts')} AS ts, {stamp('r.ts')} AS known, version::INTEGER AS version, {q('value', 1)} FROM b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.ts")
_LAST = lambda n: f"OVER (PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)"
_QUANTILE = lambda n, s, name: f"CASE WHEN seq >= {n - 1} THEN {cut_sql(f'quantile_cont(close, {s}) ' + _LAST(n))} END AS {name}"
SQL["rolling_order_statistics"] = (
    f"WITH {numbered('flag_daily')} SELECT symbol, {TS} AS ts, {_QUANTILE(10, 0.5, 'median_10')}, {_QUANTILE(300, 0.5, 'median_300')}, {_QUANTILE(300, 0.05, 'low_300')}, {_QUANTILE(300, 0.9, 'high_300')} FROM b")
SQL["rolling_callables"] = (
    f"WITH {numbered('flag_daily')}, w AS (SELECT *, list(close) {_LAST(30)} AS l FROM b) SELECT symbol, {TS} AS ts, "
    f"CASE WHEN seq >= 29 THEN {cut_sql('len(list_filter(l, lambda v: v <= close)) / 30.0::DOUBLE')} END AS rank, CASE WHEN seq >= 249 THEN {cut_sql('stddev_samp(close) ' + _LAST(250))} END AS spread, "
    f"CASE WHEN seq >= 14 THEN {cut_sql('sum(close * volume) ' + _LAST(15) + ' / sum(volume) ' + _LAST(15))} END AS paid FROM w")
SQL["running_growth"] = (
    f"WITH {numbered('flag_daily')}, g AS (SELECT symbol, ts, seq, close / lag(close) OVER (PARTITION BY symbol ORDER BY seq) * CASE WHEN dayofweek(ts) = 1 THEN -1 ELSE 1 END AS g FROM b) "
    f"SELECT symbol, {TS} AS ts, {cut_sql('coalesce(product(g) OVER (PARTITION BY symbol ORDER BY seq), 1.0)')} AS growth FROM g")
SQL["back_filled"] = (
    f"WITH {numbered('flag_daily')}, h AS (SELECT symbol, ts, seq, CASE WHEN volume % 3 = 0 THEN close END AS c, CASE WHEN volume % 3 = 0 THEN volume END AS v FROM b) "
    f"SELECT symbol, {TS} AS ts, {cut_sql('first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS close, "
    f"{cut_sql('first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)')} AS volume FROM h")
