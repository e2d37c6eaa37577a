"""The expression language: parse, canonical key, validation against limits. Driver side, no Spark."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from loomfactor.operators.registry import COMMUTE, OPS


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Const:
    value: float


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple["Expr", ...]


Expr = Field | Const | Call


def _split(text: str) -> list[str]:
    """Arguments at the commas outside any bracket."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    if depth:
        raise ValueError("PARSE_ERROR:brackets")
    return [p.strip() for p in parts]


def parse(text: str) -> Expr:
    text = text.strip()
    if text.startswith("$") and text[1:].isidentifier():
        return Field(text[1:])
    head, bracket, tail = text.partition("(")
    if bracket and head.strip().isidentifier() and tail.endswith(")"):
        return Call(head.strip(), tuple(parse(a) for a in _split(tail[:-1])))
    try:
        return Const(float(text))
    except ValueError:
        raise ValueError(f"PARSE_ERROR:{text}") from None


def canonical(expr: Expr) -> str:
    """The key of an expression. Constants are written in full: 10, 0.5, 1234567."""
    match expr:
        case Field(name):
            return f"${name}"
        case Const(value):
            return str(int(value)) if value.is_integer() and abs(value) < 2**53 else repr(value)
        case Call(op, args):
            keys = [canonical(a) for a in args]
            return f"{op}({','.join(sorted(keys) if op in COMMUTE and len(keys) == 2 else keys)})"


@dataclass(frozen=True)
class Limits:
    depth: int = 4
    nodes: int = 10
    ts_ops: int = 2
    pair_ops: int = 1
    binary_ops: int = 1


@dataclass(frozen=True)
class Size:
    """What the limits count."""

    depth: int = 0
    nodes: int = 0
    ts_ops: int = 0
    pair_ops: int = 0
    binary_ops: int = 0

    def __add__(self, other: "Size") -> "Size":
        return Size(max(self.depth, other.depth), *(getattr(self, k) + getattr(other, k) for k in ("nodes", "ts_ops", "pair_ops", "binary_ops")))


@dataclass
class Validator:
    fields: Iterable[str]
    windows: Iterable[int] = (10, 20, 30, 40, 50)
    limits: Limits = field(default_factory=Limits)

    def check(self, expr: Expr) -> str:
        """'OK', or the reason why an expression is refused. Reasons are fixed values."""
        try:
            size = self._size(expr)
        except ValueError as e:
            return str(e)
        for name in ("depth", "nodes", "ts_ops", "pair_ops", "binary_ops"):
            if getattr(size, name) > getattr(self.limits, name):
                return f"{name.upper()}_EXCEEDED:{getattr(size, name)}"
        return "OK"

    def _size(self, expr: Expr) -> Size:
        match expr:
            case Const():
                return Size(1, 1)
            case Field(name):
                if name not in set(self.fields):
                    raise ValueError(f"UNKNOWN_FIELD:{name}")
                return Size(1, 1)
            case Call():
                return self._call(expr)
        raise ValueError(f"UNKNOWN_NODE:{type(expr).__name__}")

    def _call(self, call: Call) -> Size:
        op = OPS.get(call.op)
        if op is None:
            raise ValueError(f"UNKNOWN_OPERATOR:{call.op}")
        timed = op.kind in ("rolling", "pair")
        self._form(call, timed, op.kind, op.arity)
        # No constant of a rolling operator counts, be it the window or not.
        below = [self._size(a) for a in call.args if not (timed and isinstance(a, Const))]
        inner = reduce(Size.__add__, below, Size())
        self._inputs(call)
        own = Size(0, 1, op.kind == "rolling", op.kind == "pair", op.kind == "binary")
        return Size(inner.depth + 1) + Size(0, *(getattr(inner + own, k) for k in ("nodes", "ts_ops", "pair_ops", "binary_ops")))

    def _form(self, call: Call, timed: bool, kind: str, arity: int) -> None:
        right = len(call.args) == arity
        if timed:
            if not right or not isinstance(call.args[-1], Const):
                raise ValueError(f"{'PAIR_' * (kind == 'pair')}ROLLING_NEEDS_WINDOW:{call.op}")
            w = call.args[-1].value
            if w not in set(self.windows):
                raise ValueError(f"BAD_WINDOW:{call.op}:{int(w) if math.isfinite(w) else w}")
        elif not right:
            raise ValueError(f"ARITY:{call.op}")

    def _inputs(self, call: Call) -> None:
        """Rules on what an operator may be applied to."""
        if call.op == "Log":
            match call.args[0]:
                case Call("Abs" | "SLog1p" | "Greater"):
                    pass
                case _:
                    raise ValueError("LOG_INPUT_UNSAFE")
        if call.op == "Pow":
            match call.args[1]:
                case Const(0.5 | 2.0 | 3.0):
                    pass
                case _:
                    raise ValueError("POW_ONLY_CONSTANT_0.5_2_3")
