"""Plain SQL for the same feature definitions, used only for checking.

Nothing here knows about chunks, halos or Arrow: every window runs over the
whole symbol and every recurrence is a recursive CTE, one bar per step.
"""

from __future__ import annotations

from tidebars.functions.expr import Expr, ex
from tidebars.plans.features import WINDOW_OPS, _kids, _name, _walk

W = "PARTITION BY symbol ORDER BY seq"
_BIN = {"add": "+", "sub": "-", "mul": "*", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>",
        "and": "AND", "or": "OR"}
_FN = {"abs": "abs", "exp": "exp", "sign": "sign", "sin": "sin", "cos": "cos", "tanh": "tanh", "atan": "atan",
       "floor": "floor", "greatest": "greatest", "least": "least", "coalesce": "coalesce",
       "month": "month", "day": "day", "isodow": "isodow", "year": "year", "hour": "hour"}
_AGG = {"max": "max", "min": "min", "avg": "avg", "sum": "sum", "stddev_samp": "stddev_samp",
        "stddev_pop": "stddev_pop", "var_samp": "var_samp", "count": "count"}


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _frame(lo, hi):
    def end(k):
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({W} ROWS BETWEEN {end(lo)} AND {end(hi)})"


def _text(e: Expr, have: set[int]) -> str:
    if e.num in have or e.op == "col":
        return _name(e)
    op, a = e.op, e.args
    t = lambda x: _text(x, have)
    if op == "lit":
        return _lit(a[0])
    if op == "pos":
        return "seq::DOUBLE"
    if op == "known":
        return t(a[0])
    if op in _BIN:
        return f"({t(a[0])} {_BIN[op]} {t(a[1])})"
    if op == "not":
        return f"(NOT {t(a[0])})"
    if op == "neg":
        return f"(-{t(a[0])})"
    if op == "div":
        return f"({t(a[0])} / nullif({t(a[1])}::DOUBLE, 0))"
    if op == "isnull":
        return f"({t(a[0])} IS NULL)"
    if op == "true":
        return f"coalesce({t(a[0])}, FALSE)"
    if op in ("log", "log10"):
        return f"(CASE WHEN {t(a[0])} > 0 THEN {'ln' if op == 'log' else 'log10'}({t(a[0])}) END)"
    if op == "sqrt":
        return f"(CASE WHEN {t(a[0])} >= 0 THEN sqrt({t(a[0])}) END)"
    if op == "pow":
        return f"pow({t(a[0])}, {a[1]})"
    if op == "case":
        arms = " ".join(f"WHEN {t(c)} THEN {t(v)}" for c, v in zip(a[0:-1:2], a[1:-1:2]))
        return f"(CASE {arms} ELSE {t(a[-1])} END)"
    if op == "dim":
        return f"day(last_day({t(a[0])}))"
    if op == "epochday":
        return f"date_diff('day', DATE '1970-01-01', {t(a[0])}::DATE)"
    if op == "minuteofday":
        return f"(hour({t(a[0])}) * 60 + minute({t(a[0])}))"
    if op in _FN:
        return f"{_FN[op]}({', '.join(map(t, a))})"
    raise KeyError(op)


def _window(e: Expr, have) -> str:
    op, a = e.op, e.args
    t = lambda x: _text(x, have)
    if op in ("lag", "lead"):
        return f"{op}({t(a[0])}, {a[1]}) OVER ({W})"
    if op == "startval":
        return f"CASE WHEN seq = {a[3]} THEN {a[0]}({t(a[1])}) OVER {_frame(1 - a[2], 0)} END"
    if op == "run":
        f = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        fn = {"last": "last_value({} IGNORE NULLS)", "first": "first_value({} IGNORE NULLS)"}.get(a[0], a[0] + "({})")
        return f"{fn.format(t(a[1]))} OVER {f}"
    if op == "glob":
        if a[0] == "last_value":
            return f"last_value({t(a[1])}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        if a[0] == "first_value":
            return f"first_value({t(a[1])}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"{a[0]}({t(a[1])}) OVER (PARTITION BY symbol)"
    fn, lo, hi, need, x = a[:5]
    f, n = _frame(lo, hi), hi - lo + 1
    extra = a[5] if len(a) > 5 else None
    gate = f"count({t(x)}) OVER {f} >= {need}"
    if fn == "count":
        return f"(count({t(x)}) OVER {f})::DOUBLE"
    if fn == "percentile":
        v = f"quantile_cont({t(x)}, {extra}) OVER {f}"
    elif fn == "mad":
        v = f"list_sum(list_transform(list({t(x)}) OVER {f}, lambda v: abs(v - {t(extra)}))) / {n}.0::DOUBLE"
    elif fn in ("age_max", "age_min"):
        v = f"(seq - (max({{'v': {'' if fn == 'age_max' else '-'}{t(x)}, 's': seq}}) OVER {f}).s)::DOUBLE"
    elif fn in ("corr", "covar_samp", "regr_slope", "regr_intercept", "regr_r2"):
        v = f"{fn}({t(x)}, {t(extra)}) OVER {f}"
        gate += f" AND count({t(extra)}) OVER {f} >= {need}"
    else:
        v = f"{_AGG[fn]}({t(x)}) OVER {f}"
    return f"CASE WHEN {gate} THEN {v} END"


def feature_ctes(wanted: dict[str, Expr], base: str = "bars") -> tuple[list[str], str, set[int]]:
    """CTEs that extend ``base`` (symbol, seq, ...) with every needed value."""
    nodes = _walk([ex(v) for v in wanted.values()])
    level: dict[int, int] = {}
    kind: dict[int, str] = {}
    for e in nodes:
        kids = _kids(e)
        m = max((level[k.num] for k in kids), default=0)
        if e.op in WINDOW_OPS or e.op in ("run", "glob", "recur", "startval"):
            m += 1
        level[e.num] = m
    ctes, have, cur = [], set(), base
    step = 0
    for lv in range(1, max(level.values(), default=0) + 1):
        group = [e for e in nodes if level[e.num] == lv]
        wins = [e for e in group if e.op in WINDOW_OPS or e.op in ("run", "glob", "startval")]
        recs = [e for e in group if e.op == "recur"]
        if wins:
            step += 1
            cols = ", ".join(f"{_window(e, have)} AS {_name(e)}" for e in wins)
            ctes.append(f"s{step} AS MATERIALIZED (SELECT *, {cols} FROM {cur})")
            cur = f"s{step}"
        if recs:
            step += 1
            ins = []
            for e in recs:
                ins.append(f"{_text(e.args[0], have)} AS a{e.num}, {_text(e.args[1], have)} AS b{e.num}")
            ctes.append(f"i{step} AS MATERIALIZED (SELECT symbol, seq, {', '.join(ins)} FROM {cur})")
            first, nxt, cols = [], [], ["symbol", "seq"]
            for e in recs:
                a2, start = e.args[2], e.args[4]
                n = e.num
                cols += [f"y{n}", f"z{n}"]
                first += [f"CASE WHEN seq >= {start} THEN b{n} END", "NULL::DOUBLE"]
                second = f" + {a2!r}::DOUBLE * coalesce(r.z{n}, 0)" if a2 else ""
                nxt += [f"CASE WHEN i.seq >= {start} THEN i.a{n} * coalesce(r.y{n}, 0){second} + i.b{n} END", f"r.y{n}"]
            ctes.append(
                f"r{step}({', '.join(cols)}) AS (SELECT symbol, seq, {', '.join(first)} FROM i{step} WHERE seq = 0 "
                f"UNION ALL SELECT i.symbol, i.seq, {', '.join(nxt)} FROM r{step} r JOIN i{step} i "
                f"ON i.symbol = r.symbol AND i.seq = r.seq + 1)"
            )
            got = ", ".join(f"r.y{e.num} AS {_name(e)}" for e in recs)
            ctes.append(f"s{step} AS MATERIALIZED (SELECT c.*, {got} FROM {cur} c JOIN r{step} r USING (symbol, seq))")
            cur = f"s{step}"
        have.update(e.num for e in wins + recs)
    return ctes, cur, have


def feature_sql(bars_sql: str, wanted: dict[str, Expr], select: dict[str, str]) -> str:
    """Full query: ``bars_sql`` gives symbol, ts, OHLCV; ``select`` maps output
    names to a template with ``{x}`` for the feature's text (or plain SQL)."""
    ctes, cur, have = feature_ctes(wanted)
    cols = []
    for name, template in select.items():
        value = template.format(x=_text(ex(wanted[name]), have)) if name in wanted else template
        cols.append(f'{value} AS "{name}"')
    head = (
        f"raw AS MATERIALIZED ({bars_sql}), bars AS MATERIALIZED "
        f"(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS seq FROM raw)"
    )
    return f"WITH RECURSIVE {', '.join([head] + ctes)} SELECT {', '.join(cols)} FROM {cur}"
