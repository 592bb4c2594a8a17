"""Feature expressions: the vocabulary rules and indicators are written in.

An :class:`Expr` is a small immutable tree over the columns of a bar table.
It carries four facts that the plan needs and that can be derived from the
tree alone:

``back`` / ``fwd``
    how many earlier / later bars of the same symbol the value may touch; the
    halo of a chunk is the maximum over all requested features.
``lead``
    number of leading bars of a symbol on which the value is null, when that
    is known from the tree (``None`` when it depends on the data).
``phase``
    0 for values that a chunk with its halo can compute alone, +1 for every
    running total or whole-symbol statistic below.

Equal trees are the same object, so a feature used by many rules is computed
once per plan.
"""

from __future__ import annotations

import math

_INTERNED: dict = {}


class Expr:
    __slots__ = ("op", "args", "key", "back", "fwd", "lead", "phase", "num")

    def __new__(cls, op, *args):
        key = (op,) + tuple(a.num if isinstance(a, Expr) else ("k", repr(a)) for a in args)
        found = _INTERNED.get(key)
        if found is not None:
            return found
        self = super().__new__(cls)
        self.op, self.args, self.key = op, args, key
        self.num = len(_INTERNED)
        kids = [a for a in args if isinstance(a, Expr)]
        self.back = max((k.back for k in kids), default=0)
        self.fwd = max((k.fwd for k in kids), default=0)
        self.phase = max((k.phase for k in kids), default=0)
        leads = [k.lead for k in kids]
        self.lead = None if any(v is None for v in leads) else max(leads, default=0)
        _describe(self)
        _INTERNED[key] = self
        return self

    # arithmetic -----------------------------------------------------------
    def __add__(self, o):
        return Expr("add", self, ex(o))

    def __radd__(self, o):
        return Expr("add", ex(o), self)

    def __sub__(self, o):
        return Expr("sub", self, ex(o))

    def __rsub__(self, o):
        return Expr("sub", ex(o), self)

    def __mul__(self, o):
        return Expr("mul", self, ex(o))

    def __rmul__(self, o):
        return Expr("mul", ex(o), self)

    def __truediv__(self, o):
        return Expr("div", self, ex(o))

    def __rtruediv__(self, o):
        return Expr("div", ex(o), self)

    def __neg__(self):
        return Expr("neg", self)

    # comparisons and logic ------------------------------------------------
    def __gt__(self, o):
        return Expr("gt", self, ex(o))

    def __ge__(self, o):
        return Expr("ge", self, ex(o))

    def __lt__(self, o):
        return Expr("lt", self, ex(o))

    def __le__(self, o):
        return Expr("le", self, ex(o))

    def eq(self, o):
        return Expr("eq", self, ex(o))

    def ne(self, o):
        return Expr("ne", self, ex(o))

    def __and__(self, o):
        return Expr("and", self, ex(o))

    def __or__(self, o):
        return Expr("or", self, ex(o))

    def __invert__(self):
        return Expr("not", self)

    def isin(self, values):
        out = self.eq(values[0])
        for v in values[1:]:
            out = out | self.eq(v)
        return out

    def __bool__(self):
        raise TypeError("an Expr has no truth value; use &, |, ~")

    def __repr__(self):
        return f"{self.op}({', '.join(map(repr, self.args))})"


def ex(v):
    return v if isinstance(v, Expr) else Expr("lit", v)


def is_lit(e):
    return e.op == "lit"


NULL_PRONE = {"div", "log", "log10", "sqrt", "coalesce", "case", "isnull", "true", "pow"}


def leads_of(e):
    return [k.lead for k in e.args if isinstance(k, Expr)]


def _describe(e):
    """Derive back / fwd / lead / phase for the operators that change them."""
    op, a = e.op, e.args
    if op in ("col", "lit"):
        e.lead = 0
        if op == "col" and a[0].endswith("?"):
            e.lead = None
    elif op in ("isnull", "true"):
        e.lead = 0
    elif op == "div":
        e.lead = a[0].lead if is_lit(a[1]) and a[1].args[0] else None
    elif op in ("case", "log", "log10", "sqrt", "pow"):
        e.lead = None
    elif op in ("greatest", "least"):
        e.lead = None if any(v is None for v in leads_of(e)) and 0 not in leads_of(e) else min(v for v in leads_of(e) if v is not None)
    elif op == "coalesce":
        e.lead = 0 if is_lit(a[-1]) and a[-1].args[0] is not None else None
    elif op == "known":
        e.lead = a[1]
    elif op == "lag":
        e.back += a[1]
        e.lead = None if a[0].lead is None else a[0].lead + a[1]
    elif op == "lead":
        e.fwd += a[1]
        e.lead = None
    elif op == "roll":
        fn, lo, hi, need = a[0], a[1], a[2], a[3]
        e.back += max(0, -lo)
        e.fwd += max(0, hi)
        over = [a[4]] if fn == "mad" else [k for k in a if isinstance(k, Expr)]
        unknown = any(k.lead is None for k in over)
        e.lead = None if unknown or hi > 0 else max(k.lead for k in over) + need - 1 - hi
        if fn in ("corr", "regr_r2", "kurt"):
            e.lead = None
    elif op == "recur":
        e.back += a[3]
        e.lead = a[4]
    elif op == "startval":
        e.back += a[2] - 1
        e.lead = None
    elif op in ("run", "glob", "folded"):
        e.back = e.fwd = 0
        e.phase += 1
        if op == "run" and a[0] == "last":
            e.lead = None
        if op == "glob":
            e.lead = None


# --- leaves ---------------------------------------------------------------
def col(name):
    """A stored column that is never null (prices, volume)."""
    return Expr("col", name)


def ncol(name):
    """A stored column that may be null."""
    return Expr("col", name + "?")


O, H, L, C, V = col("open"), col("high"), col("low"), col("close"), col("volume")
SEQ = col("seq")
POS = Expr("pos")


# --- scalars --------------------------------------------------------------
def _un(op):
    return lambda x: Expr(op, ex(x))


absx, logx, log10x, expx, sqrtx, signx = map(_un, ("abs", "log", "log10", "exp", "sqrt", "sign"))
floorx, sinx, cosx, tanhx, isnull = map(_un, ("floor", "sin", "cos", "tanh", "isnull"))
atanx = _un("atan")
month, dayom, isodow, year_, hour_ = map(_un, ("month", "day", "isodow", "year", "hour"))
days_in_month, epoch_day, minute_of_day = map(_un, ("dim", "epochday", "minuteofday"))


def powx(x, p):
    return Expr("pow", ex(x), float(p))


def greatest(*xs):
    return Expr("greatest", *map(ex, xs))


def least(*xs):
    return Expr("least", *map(ex, xs))


def coalesce(*xs):
    return Expr("coalesce", *map(ex, xs))


def fill0(x):
    return coalesce(x, 0.0)


def when(*pairs, otherwise=None):
    """``when(cond1, value1, cond2, value2, ..., otherwise=v)``; first hit wins."""
    return Expr("case", *map(ex, pairs), ex(otherwise))


def true(cond):
    """Null counts as false."""
    return Expr("true", cond)


def known(x, lead):
    """State that ``x`` is null exactly on the first ``lead`` bars of a symbol."""
    return Expr("known", x, int(lead))


# --- windows --------------------------------------------------------------
def lag(x, k=1):
    x = ex(x)
    return x if k == 0 else Expr("lag", x, int(k)) if k > 0 else Expr("lead", x, -int(k))


def lead(x, k=1):
    return Expr("lead", ex(x), int(k))


def roll(fn, x, n, need=None, hi=0, y=None, p=None):
    """Aggregate of ``n`` rows ending ``hi`` rows after the current one.

    Null until ``need`` (default ``n``) non-null values are in the frame.
    """
    if fn in BLOCKWISE and n >= LONG_FRAME and hi == 0 and need in (None, n):
        return _from_blocks(fn, ex(x), n)
    args = [fn, hi - n + 1, hi, n if need is None else need, ex(x)]
    if y is not None:
        args.append(ex(y))
    if p is not None:
        args.append(float(p))
    return Expr("roll", *args)


LONG_FRAME = 40
BLOCKWISE = {"max", "min", "sum", "avg"}


def _from_blocks(fn, x, n):
    """A long frame as a few lagged short ones: work per bar grows with the root of n, not with n."""
    b = max(2, math.isqrt(n))
    if fn in ("max", "min"):
        part = roll(fn, x, b)
        parts = [lag(part, min(k, n - b)) for k in range(0, n, b)]
        whole = (greatest if fn == "max" else least)(*parts)
        missing = isnull(parts[0])
        for p in parts[1:]:
            missing = missing | isnull(p)
        out = when(missing, None, otherwise=whole)
    else:
        part = roll("sum", x, b)
        out = part
        for k in range(b, n - b + 1, b):
            out = out + lag(part, k)
        rest = n % b
        if rest:
            out = out + lag(roll("sum", x, rest), n - rest)
        out = out / float(n) if fn == "avg" else out
    return out if x.lead is None else known(out, x.lead + n - 1)


def sma(x, n, need=None):
    return roll("avg", x, n, need)


def rsum(x, n, need=None):
    return roll("sum", x, n, need)


def rmax(x, n, need=None):
    return roll("max", x, n, need)


def rmin(x, n, need=None):
    return roll("min", x, n, need)


def rstd(x, n, need=None):
    return roll("stddev_samp", x, n, need)


def rstdp(x, n, need=None):
    return roll("stddev_pop", x, n, need)


def diff(x, k=1):
    return ex(x) - lag(x, k)


def pct(x, k=1):
    return ex(x) / lag(x, k) - 1.0


def wma(x, n):
    """Linear weights 1..n; the sums are taken on chunk-relative positions."""
    x = ex(x)
    t = POS
    return (rsum(x * t, n) - (t - float(n)) * rsum(x, n)) / (n * (n + 1) / 2.0)


def mad(x, n):
    """Mean absolute deviation of the last n values around their own mean."""
    return roll("mad", x, n, None, 0, sma(x, n))


def run(fn, x):
    """Running aggregate from the first bar of the symbol."""
    return Expr("run", fn, ex(x))


def glob(fn, x, p=None):
    """Statistic of the whole symbol, repeated on each of its bars."""
    return Expr("glob", fn, ex(x)) if p is None else Expr("glob", fn, ex(x), float(p))


def cross_up(a, b):
    a, b = ex(a), ex(b)
    return (a > b) & (lag(a) <= lag(b))


def cross_dn(a, b):
    a, b = ex(a), ex(b)
    return (a < b) & (lag(a) >= lag(b))


# --- recurrences ------------------------------------------------------------
def memory(q):
    """Bars after which the weight q**k drops below double precision."""
    return 1 if q <= 0 else int(math.ceil(41.5 / -math.log(q)))


def recur(a, b, halo, start, a2=0.0):
    """y[t] = a[t]*y[t-1] + a2*y[t-2] + b[t] from bar ``start`` on, null before.

    ``halo`` is the number of bars after which the influence of an unknown
    start falls below double precision.
    """
    return Expr("recur", ex(a), ex(b), float(a2), int(halo), int(start))


def start_value(fn, x, n, start):
    """``avg`` or ``sum`` of the n values ending at bar ``start``; null on other bars."""
    return Expr("startval", fn, ex(x), int(n), int(start))


def ema_alpha(x, alpha, seed="first", n=1):
    """Exponential mean with smoothing ``alpha``.

    seed ``first`` starts from the first value, ``sma`` from the mean of the
    first ``n`` values, ``adjusted`` gives the bias-corrected mean.
    """
    x = ex(x)
    if x.lead is None:
        x = known(fill0(x), 0)
    q = 1.0 - alpha
    if seed == "first":
        s = x.lead
        b = when(SEQ.eq(s), x, SEQ > s, x * alpha)
        return recur(q, b, memory(q), s)
    if seed == "sma":
        s = x.lead + n - 1
        b = when(SEQ.eq(s), start_value("avg", x, n, s), SEQ > s, x * alpha)
        return recur(q, b, memory(q), s)
    s = x.lead
    num = recur(q, when(SEQ >= s, x), memory(q), s)
    den = recur(q, when(SEQ >= s, 1.0), memory(q), s)
    return known(num / den, s)


def ema(x, n, seed="first"):
    return ema_alpha(x, 2.0 / (n + 1), seed, n)


def wilder(x, n, seed="sma"):
    return ema_alpha(x, 1.0 / n, seed, n)


def wilder_sum(x, n):
    """Running directional sum: s = s - s/n + x, seeded with the first n-1 values."""
    x = ex(x)
    s = x.lead + n - 2
    q = 1.0 - 1.0 / n
    b = when(SEQ.eq(s), start_value("sum", x, n - 1, s), SEQ > s, x)
    return recur(q, b, memory(q), s)


def signal(long_, short=None):
    """+1 / -1 / 0; nulls are false and the long side wins when both hold."""
    pairs = [true(long_), 1]
    if short is not None:
        pairs += [true(short), -1]
    return Expr("case", *map(ex, pairs), ex(0))
