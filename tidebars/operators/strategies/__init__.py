"""Rule registry: every rule is a name and a signal expression (+1, 0, -1)."""

from __future__ import annotations

from tidebars.functions.expr import Expr


def uses_future(e: Expr) -> bool:
    """Does the rule look at later bars or at whole-symbol statistics?"""
    if e.op in ("lead", "glob") or (e.op == "roll" and e.args[2] > 0):
        return True
    return any(uses_future(a) for a in e.args if isinstance(a, Expr))


def registry() -> dict[str, dict[str, Expr]]:
    """Rules by family; single-symbol families need only the bar table."""
    from tidebars.operators.strategies import bands, calendar, ideas, means, momentum, shapes

    out: dict[str, dict[str, Expr]] = {}
    for mod in (means, momentum, bands, shapes, calendar, ideas):
        out.update(mod.families())
    return out
