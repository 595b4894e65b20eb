"""Arithmetic equations in X: parsed to postfix form, which becomes a Spark column or runs over numpy arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_]\w*|[-+*/^()])")


@lru_cache(maxsize=10_000)
def postfix(text: str | None) -> tuple[str | float, ...]:
    """The equation in postfix form: numbers, X, + - * / ^ and ``neg``; empty for X as it is.

    ``X*0.1``, ``(X-128)*0.5``, ``X^2``, unary signs; every name means X. ``^`` binds tightest and to the right;
    a sign binds weaker than ``^`` and stronger than ``*``. Anything else is an error.
    """
    tokens, at = [], 0
    text = (text or "").strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"equation {text!r}: not understood at {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    if not tokens:
        return ()
    tokens.append("")
    place = 0
    out: list[str | float] = []

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def chain(part, signs: tuple[str, str]) -> None:
        part()
        while tokens[place] in signs:
            sign = take()
            part()
            out.append(sign)

    def sums() -> None:
        chain(products, ("+", "-"))

    def products() -> None:
        chain(signed, ("*", "/"))

    def signed() -> None:
        if tokens[place] in ("+", "-"):
            minus = take() == "-"
            signed()
            if minus:
                out.append("neg")
            return
        atom()
        if tokens[place] == "^":
            take()
            signed()
            out.append("^")

    def atom() -> None:
        t = take()
        if t == "(":
            sums()
            if take() != ")":
                raise ValueError(f"equation {text!r}: bracket not closed")
        elif t and (t[0].isdigit() or t[0] == "."):
            out.append(float(t))
        elif t and (t[0].isalpha() or t[0] == "_"):
            out.append("X")
        else:
            raise ValueError(f"equation {text!r}: {t or 'end'} not expected")

    sums()
    if tokens[place]:
        raise ValueError(f"equation {text!r}: {tokens[place]} not expected")
    return tuple(out)


def _run(program: tuple, x, number, divide, power):
    stack = []
    for step in program:
        if step == "neg":
            stack.append(-stack.pop())
        elif step == "X":
            stack.append(x)
        elif isinstance(step, float):
            stack.append(number(step))
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left + right if step == "+" else left - right if step == "-" else left * right if step == "*" else divide(left, right) if step == "/" else power(left, right))
    return stack[0]


def compile_equation(text: str | None, x: Column) -> Column:
    """The equation as a column. Division by zero and results that are not finite give 0; null stays null."""
    program = postfix(text)
    if not program:
        return x
    out = _run(program, x, F.lit, lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b)), F.pow)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(out) | (F.abs(out) == float("inf")), 0.0).otherwise(out)


def evaluate(text: str | None, x: np.ndarray) -> np.ndarray:
    """The equation over an array of doubles, by the same rules."""
    program = postfix(text)
    if not program:
        return x

    def divide(a, b):
        a, b = np.broadcast_arrays(a, b)
        return np.divide(a, b, out=np.zeros(a.shape), where=b != 0)

    with np.errstate(all="ignore"):
        out = np.broadcast_to(_run(program, x, np.float64, divide, np.power), x.shape)
    return np.where(np.isfinite(out), out, 0.0)
