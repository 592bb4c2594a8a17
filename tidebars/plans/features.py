"""Turn feature expressions into a DataFrame plan.

The features of one call share one chunk shuffle.  Window values are added
level by level, each level in one ``select`` over the same (symbol, chunk)
window; recurrences of one level run together in one Arrow pass; running
totals and whole-symbol statistics are two-step aggregates whose second step
works on one row per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.expr import Expr, ex
from tidebars.plans import kernels
from tidebars.plans.layout import Laid, own_rows, settle, with_halo

WINDOW_OPS = {"lag", "lead", "roll"}
WHOLE_OPS = {"run", "glob"}
KERNEL_OPS = {"recur", "startval"}
KEYS = ["symbol", "chunk", "seq", "bars"]
_INT_OPS = {"month", "day", "isodow", "year", "hour", "dim", "epochday", "minuteofday"}
_BOOL_OPS = {"gt", "ge", "lt", "le", "eq", "ne", "and", "or", "not", "isnull", "true"}


def _kids(e: Expr) -> list[Expr]:
    return [a for a in e.args if isinstance(a, Expr)]


def _name(e: Expr) -> str:
    return e.args[0].rstrip("?") if e.op == "col" else f"_f{e.num}"


def _walk(roots) -> list[Expr]:
    seen, order = set(), []
    stack = [(r, False) for r in reversed(list(roots))]
    while stack:
        e, done = stack.pop()
        if done:
            order.append(e)
        elif e.num not in seen:
            seen.add(e.num)
            stack.append((e, True))
            stack.extend((k, False) for k in _kids(e))
    return order


# --- scalar and window rendering ---------------------------------------------
_INFIX = {
    "add": "+", "sub": "-", "mul": "*", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>", "and": "AND", "or": "OR",
}
_SCALAR = {
    "neg": "(-{0})", "abs": "abs({0})", "exp": "exp({0})", "sign": "signum({0})", "floor": "CAST(floor({0}) AS DOUBLE)",
    "sin": "sin({0})", "cos": "cos({0})", "tanh": "tanh({0})", "atan": "atan({0})", "not": "(NOT {0})",
    "isnull": "({0} IS NULL)", "true": "coalesce({0}, FALSE)", "log": "(CASE WHEN {0} > 0D THEN ln({0}) END)",
    "log10": "(CASE WHEN {0} > 0D THEN log10({0}) END)", "sqrt": "(CASE WHEN {0} >= 0D THEN sqrt({0}) END)",
    "div": "({0} / nullif({1}, 0D))", "month": "month({0})", "day": "dayofmonth({0})", "isodow": "(weekday({0}) + 1)",
    "year": "year({0})", "hour": "hour({0})", "dim": "dayofmonth(last_day({0}))", "epochday": "datediff({0}, DATE'1970-01-01')",
    "minuteofday": "(hour({0}) * 60 + minute({0}))",
}
_CHEAP = {"col", "lit", "pos", "neg", "not", "true", "known", "isnull"}
_OVER = "PARTITION BY symbol, chunk ORDER BY seq"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, str):
        return "'" + v.replace("'", "\\'") + "'"
    return str(v)


def _edge(k: int) -> str:
    return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"


class _Stage:
    """Renders expressions as SQL text against the columns that exist so far."""

    def __init__(self, rows: int, gaps: bool = True):
        self.rows = rows
        self.gaps = gaps
        self.have: set[int] = set()

    def text(self, e: Expr) -> str:
        if e.num in self.have or e.op == "col":
            return _name(e)
        op, a = e.op, e.args
        if op == "lit":
            return _literal(a[0])
        if op == "pos":
            return f"CAST(seq - chunk * {self.rows} AS DOUBLE)"
        if op == "known":
            return self.text(a[0])
        if op in _INFIX:
            return f"({self.text(a[0])} {_INFIX[op]} {self.text(a[1])})"
        if op == "pow":
            return f"pow({self.text(a[0])}, {a[1]}D)"
        if op == "case":
            arms = " ".join(f"WHEN {self.text(c)} THEN {self.text(v)}" for c, v in zip(a[0:-1:2], a[1:-1:2]))
            return f"CASE {arms} ELSE {self.text(a[-1])} END"
        if op in ("greatest", "least", "coalesce"):
            return f"{op}({', '.join(map(self.text, a))})"
        return _SCALAR[op].format(*map(self.text, a))

    def col(self, e: Expr) -> Column:
        return F.expr(self.text(e))

    def named(self, e: Expr) -> str:
        return f"{self.window(e) if e.op in WINDOW_OPS else self.text(e)} AS {_name(e)}"

    def window(self, e: Expr) -> str:
        op, a = e.op, e.args
        if op in ("lag", "lead"):
            return f"{op}({self.text(a[0])}, {a[1]}) OVER ({_OVER})"
        fn, lo, hi, need, x = a[:5]
        f = f"({_OVER} ROWS BETWEEN {_edge(lo)} AND {_edge(hi)})"
        extra = a[5] if len(a) > 5 else None
        cx = self.text(x)
        if fn == "count":
            return f"CAST(count({cx}) OVER {f} AS DOUBLE)"
        if fn == "percentile":
            value = f"percentile({cx}, {extra}D) OVER {f}"
        elif fn == "mad":
            value = f"aggregate(collect_list({cx}) OVER {f}, 0D, (s, v) -> s + abs(v - {self.text(extra)})) / {hi - lo + 1}D"
        elif fn in ("age_max", "age_min"):
            sign = "" if fn == "age_max" else "-"
            value = f"CAST(seq - (max(named_struct('v', {sign}{cx}, 's', seq)) OVER {f}).s AS DOUBLE)"
        elif isinstance(extra, Expr):
            value = f"{fn}({cx}, {self.text(extra)}) OVER {f}"
        else:
            value = f"{fn}({cx}) OVER {f}"
        return f"CASE WHEN {self.gate(e, f)} THEN {value} END"

    def gate(self, e: Expr, f: str) -> str:
        """Enough non-null values in the frame (a position test when that suffices)."""
        fn, lo, hi, need, x = e.args[:5]
        if e.lead is not None and not self.gaps:
            return f"seq >= {e.lead}"
        enough = f"count({self.text(x)}) OVER {f} >= {need}"
        if len(e.args) > 5 and isinstance(e.args[5], Expr) and fn != "mad":
            enough += f" AND count({self.text(e.args[5])}) OVER {f} >= {need}"
        return enough


def _stages(nodes: list[Expr], phase: int, have: set[int]) -> dict[int, int]:
    st: dict[int, int] = {}
    for e in nodes:
        if e.num in have or e.op in ("col", "lit", "pos") or e.phase < phase:
            st[e.num] = 0
            continue
        m = max((st[k.num] for k in _kids(e)), default=0)
        if e.op in WINDOW_OPS:
            m = m + 2 if m % 2 == 0 else m + 1
        elif e.op in KERNEL_OPS:
            m = m + 1 if m % 2 == 0 else m
        st[e.num] = m
    return st


def _kernel(nodes, ins, carry, outs, rows):
    """Grouped-map function: evaluates the recurrences of one level on one chunk."""

    spec = []
    for e in nodes:
        spec.append((e.num, e.op, tuple(("n", a.num) if isinstance(a, Expr) else ("v", a) for a in e.args)))
    in_cols = [(e.num, _name(e)) for e in ins]
    out_cols = [(e.num, _name(e)) for e in outs]

    def run(table: pa.Table) -> pa.Table:
        seq = table.column("seq").to_numpy()
        if len(seq) > 1 and (np.diff(seq) < 0).any():
            order = np.argsort(seq, kind="stable")
            table, seq = table.take(pa.array(order)), seq[order]
        n = len(seq)
        vals = {num: table.column(name).to_numpy().astype(float, copy=False) for num, name in in_cols}
        for num, op, args in spec:
            if num in vals:
                continue
            kids = [vals[v] for kind, v in args if kind == "n"]
            raw = [None if kind == "n" else v for kind, v in args]
            if op == "lit":
                v = raw[0]
                vals[num] = np.full(n, np.nan if v is None else float(v))
            elif op == "pos":
                vals[num] = (seq - table.column("chunk")[0].as_py() * rows).astype(float)
            elif op == "startval":
                vals[num] = kernels.start_value(raw[0], kids[0], seq, raw[2], raw[3])
            elif op == "recur":
                a, b = kids
                a2, start = raw[2], raw[4]
                b = np.where(seq < start, np.nan, b)
                same = n > 0 and a2 == 0.0 and (a == a[0]).all()
                vals[num] = kernels.decay_scan(float(a[0]), b) if same and a[0] < 1.0 else kernels.general_scan(a, a2, b)
            else:
                with np.errstate(all="ignore"):
                    vals[num] = kernels.scalar(op, raw, kids)
        cols = [table.column(c) for c in carry] + [pa.array(vals[num], pa.float64(), from_pandas=True) for num, _ in out_cols]
        return pa.table(cols, names=[*carry, *[name for _, name in out_cols]])

    return run


def add_features(laid: Laid, wanted: dict[str, Expr], keep: list[str] | None = None) -> DataFrame:
    """Compute ``wanted`` for every bar; ``keep`` lists stored columns to return."""
    keep = list(keep if keep is not None else ["symbol", "ts", "seq"])
    wanted = {k: ex(v) for k, v in wanted.items()}
    nodes = _walk(wanted.values())
    users: dict[int, list[Expr]] = {}
    for e in nodes:
        for k in _kids(e):
            users.setdefault(k.num, []).append(e)
    out_nums = {e.num for e in wanted.values()}
    last_phase = max((e.phase for e in nodes), default=0)
    stored = {_name(e) for e in nodes if e.op == "col"} - {"seq"}
    base = list(dict.fromkeys(KEYS + [c for c in keep if c not in KEYS] + sorted(stored - set(keep))))
    df = laid.df.select(*base)
    render = _Stage(laid.rows, laid.gaps)
    named: set[int] = set()
    sliding = False

    for phase in range(last_phase + 1):
        here = [e for e in nodes if e.phase <= phase]
        if phase:
            pending = [e for e in nodes if e.num not in render.have and e.phase >= phase]
            alive = _live(pending, render.have, wanted, keep)
            df = df.select(*[c for c in df.columns if c in alive])
            if sliding:
                # read three times below: store it once instead of computing it three times
                df = settle(df, "phase")
            df = _whole(df, [e for e in nodes if e.op in WHOLE_OPS and e.phase == phase], render)
        st = _stages(here, phase, render.have)
        now = [e for e in here if e.phase == phase and e.num not in render.have and e.op not in ("col", "lit", "pos")]
        back, fwd = _reach(now, render.have)
        top = max((st[e.num] for e in now), default=0)
        sliding = any(st[e.num] > 0 for e in now)
        if sliding:
            df = with_halo(Laid(df, laid.rows, laid.gaps), back, fwd)

        def leaves(e):
            """Is the value read outside the level it is computed on?"""
            if e.num in out_nums:
                return True
            for u in users.get(e.num, []):
                if u.phase > phase or st.get(u.num, 10**9) != st[e.num]:
                    return True
            return False

        for level in range(top + 1):
            group = [e for e in now if st[e.num] == level]
            if not group:
                continue
            if level % 2:
                pending = [e for e in nodes if e.num not in render.have and (e.phase > phase or st.get(e.num, 0) > level)]
                df = _kernel_pass(df, group, here, leaves, keep, pending, render, wanted)
                continue
            wins = [e for e in group if e.op in WINDOW_OPS]
            if wins:
                df = df.selectExpr("*", *[render.named(e) for e in wins])
                render.have.update(e.num for e in wins)
            # a value another level reads, or several values share, becomes a column
            flat = [e for e in group if e.op not in WINDOW_OPS]
            wave: dict[int, int] = {}
            for e in flat:
                below = max((wave.get(k.num, 0) for k in _kids(e)), default=0)
                shared = e.op not in _CHEAP and len(users.get(e.num, ())) > 1
                wave[e.num] = below + 1 if shared or leaves(e) else below
                if shared or leaves(e):
                    named.add(e.num)
            for depth in range(1, max(wave.values(), default=0) + 1):
                cols = [e for e in flat if e.num in named and wave[e.num] == depth]
                df = df.selectExpr("*", *[render.named(e) for e in cols])
                render.have.update(e.num for e in cols)
        if sliding:
            df = own_rows(df, laid.rows)

    return df.selectExpr(*keep, *[f"{render.text(e)} AS `{n}`" for n, e in wanted.items()])


def _reach(now, have):
    """Halo of one phase: frames below the phase boundary are already columns."""
    memo: dict[int, tuple[int, int]] = {}
    back = fwd = 0
    for e in now:
        kids = [memo.get(k.num, (0, 0)) for k in _kids(e)]
        b, f = max((k[0] for k in kids), default=0), max((k[1] for k in kids), default=0)
        if e.op == "lag":
            b += e.args[1]
        elif e.op == "lead":
            f += e.args[1]
        elif e.op == "roll":
            b += max(0, -e.args[1])
            f += max(0, e.args[2])
        elif e.op == "recur":
            b += e.args[3]
        elif e.op == "startval":
            b += e.args[2] - 1
        memo[e.num] = (b, f)
        back, fwd = max(back, b), max(fwd, f)
    return back, fwd


def _live(pending, have, wanted, keep) -> set[str]:
    """Names of the columns that the values still to be computed, or the caller, will read."""
    names = set(KEYS) | set(keep)
    seen: set[int] = set()
    stack = [k for e in pending for k in _kids(e)]
    stack += list(wanted.values())
    while stack:
        e = stack.pop()
        if e.num in seen:
            continue
        seen.add(e.num)
        if e.num in have or e.op == "col":
            names.add(_name(e))
        else:
            stack.extend(_kids(e))
    return names


def _kernel_pass(df, group, here, leaves, keep, pending, render, wanted):
    inside = {e.num for e in group}
    need: dict[int, Expr] = {}

    def pull(e):
        for k in _kids(e):
            if k.num in inside or k.num in need or k.op in ("lit", "pos"):
                continue
            if k.num in render.have or k.op == "col":
                need[k.num] = k
            else:
                need[k.num] = k  # a cheap scalar of an earlier level: computed before the pass

    for e in group:
        pull(e)
    missing = [e for e in need.values() if e.num not in render.have and e.op != "col"]
    if missing:
        df = df.selectExpr("*", *[render.named(e) for e in missing])
        render.have.update(e.num for e in missing)
    outs = [e for e in group if leaves(e)]
    ins = list(need.values())
    order = [e for e in here if e.num in inside or e.op in ("lit", "pos")]
    later = _live(pending, render.have | {e.num for e in outs}, wanted, keep)
    feed = later | {_name(e) for e in ins}
    schema = [f for f in df.schema.fields if f.name in feed]
    bools = {f.name for f in schema if isinstance(f.dataType, T.BooleanType)}
    df = df.selectExpr(*[f"CAST({f.name} AS DOUBLE) AS {f.name}" if f.name in bools else f.name for f in schema])
    carry = [f.name for f in schema if f.name in later]
    fields = [T.StructField(f.name, T.DoubleType() if f.name in bools else f.dataType, True) for f in schema if f.name in later]
    fields += [T.StructField(_name(e), T.DoubleType(), True) for e in outs]
    fn = _kernel(order, ins, carry, outs, render.rows)
    df = df.groupBy("symbol", "chunk").applyInArrow(fn, T.StructType(fields))
    flags = [c for c in carry if c in bools] + [_name(e) for e in outs if e.op in _BOOL_OPS]
    if flags:
        df = df.selectExpr(*[f"{f.name} = 1D AS {f.name}" if f.name in flags else f.name for f in fields])
    render.have.update(e.num for e in outs)
    return df


_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def _whole(df, nodes, render):
    """Running totals and whole-symbol statistics, joined back per chunk."""
    runs = [e for e in nodes if e.op == "run"]
    globs = [e for e in nodes if e.op == "glob"]
    chunk_aggs = [F.count(F.lit(1)).alias("_rows")]
    for e in runs:
        fn, x = e.args[0], render.col(e.args[1])
        if fn == "last":
            chunk_aggs.append(F.max_by(x, F.when(x.isNotNull(), F.col("seq"))).alias(f"{_name(e)}_t"))
        elif fn == "first":
            chunk_aggs.append(F.min_by(x, F.when(x.isNotNull(), F.col("seq"))).alias(f"{_name(e)}_t"))
        else:
            chunk_aggs.append(getattr(F, fn)(x).alias(f"{_name(e)}_t"))
    per_chunk = df.groupBy("symbol", "chunk").agg(*chunk_aggs)
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for e in runs:
        t = F.col(f"{_name(e)}_t")
        if e.args[0] in ("last", "first"):
            v = getattr(F, e.args[0])(t, ignorenulls=True).over(before)
        else:
            v = _MERGE[e.args[0]](t).over(before)
        carried.append(v.alias(f"{_name(e)}_p"))
    per_chunk = per_chunk.select("symbol", "chunk", *carried)
    if globs:
        aggs = []
        for e in globs:
            fn, x = e.args[0], render.col(e.args[1])
            if fn == "last_value":
                v = F.max_by(x, F.col("seq"))
            elif fn == "first_value":
                v = F.min_by(x, F.col("seq"))
            else:
                v = getattr(F, fn)(x)
            aggs.append(v.alias(_name(e)))
        per_chunk = per_chunk.join(df.groupBy("symbol").agg(*aggs), "symbol")
    df = df.join(per_chunk, ["symbol", "chunk"])
    w = Window.partitionBy("symbol", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cols = []
    for e in runs:
        fn, x, p = e.args[0], render.col(e.args[1]), F.col(f"{_name(e)}_p")
        if fn == "last":
            v = F.coalesce(F.last(x, ignorenulls=True).over(w), p)
        elif fn == "first":
            v = F.coalesce(p, F.first(x, ignorenulls=True).over(w))
        elif fn in ("sum", "count"):
            here = getattr(F, fn)(x).over(w)
            v = F.when(here.isNotNull() | p.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(p, F.lit(0)))
        else:
            v = (F.greatest if fn == "max" else F.least)(getattr(F, fn)(x).over(w), p)
        cols.append(v.alias(_name(e)))
    df = df.select("*", *cols).drop(*[f"{_name(e)}_p" for e in runs])
    render.have.update(e.num for e in nodes)
    return df
