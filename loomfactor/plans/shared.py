"""Sub-expressions that several batches of a run need: which are worth keeping, and the store that keeps them.

A batch compiles its own sub-expressions once; across batches nothing is shared unless it is written. ``choose`` looks at all
batches and keeps the windowed sub-expressions that more than one of them reads, the largest first: what stands only inside a
kept one is not kept by itself. ``Store`` computes them in blocks, each written as a panel bucketed by code, and gives a batch
the panel with the columns it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from loomfactor.operators.registry import OPS
from loomfactor.plans.compile import evaluate
from loomfactor.plans.expressions import Call, Expr, canonical
from loomfactor.sources import panels

#: The store as a reader of sub-expressions, before all batches.
STORE = -1
#: Columns of one table of the store: they are computed together.
BLOCK = 64
#: Columns that are kept at most; what is beyond is computed by each batch that needs it.
MOST = 1024


def parts(expr: Expr) -> Iterator[Call]:
    """The calls in an expression, outermost first."""
    if isinstance(expr, Call):
        yield expr
        for a in expr.args:
            yield from parts(a)


def windowed(expr: Expr) -> bool:
    return isinstance(expr, Call) and OPS[expr.op].windowed


def cost(expr: Expr) -> int:
    """Windows that it takes to compute an expression."""
    return sum(windowed(x) for x in parts(expr))


def _read(expr: Expr, kept: set[str]) -> Iterator[str]:
    """Keys of the kept sub-expressions that an evaluation reads: it looks no further inside one."""
    if isinstance(expr, Call):
        key = canonical(expr)
        if key in kept:
            yield key
        else:
            for a in expr.args:
                yield from _read(a, kept)


def choose(batches: list[list[Expr]], most: int = MOST) -> list[Expr]:
    """The sub-expressions to keep, those first that others need, then those that the earliest batches read."""
    known: dict[str, Expr] = {}
    seen: dict[str, set[int]] = {}
    for i, batch in enumerate(batches):
        for expr in batch:
            for x in filter(windowed, parts(expr)):
                known.setdefault(canonical(x), x)
                seen.setdefault(canonical(x), set()).add(i)
    candidates = {k for k, at in seen.items() if len(at) > 1}
    kept = candidates
    while True:
        reads: dict[str, set[int]] = {}
        for i, batch in enumerate(batches):
            for expr in batch:
                for key in _read(expr, kept):
                    reads.setdefault(key, set()).add(i)
        for k in kept:  # a column that the store needs for others is read by it
            for a in known[k].args:
                for key in _read(a, kept):
                    reads.setdefault(key, set()).add(STORE)
        # What larger kept expressions hide goes; it is not taken back if they go in turn.
        still = {k for k in kept if len(reads.get(k, ())) > 1}
        if still == kept:
            break
        kept = still
    saved = lambda k: (len(reads[k]) - 1) * cost(known[k])
    best = sorted(kept, key=lambda k: (-saved(k), k))[:most]
    return [known[k] for k in sorted(best, key=lambda k: (min(reads[k]), k))]


@dataclass
class Store:
    """Kept columns of a base panel that is itself kept, under a folder. key -> (table, column)."""

    base: DataFrame
    folder: str
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)

    def build(self, chosen: list[Expr], block: int = BLOCK) -> "Store":
        """Compute and write what was chosen; later blocks read what earlier ones hold."""
        for i in range(0, len(chosen), block):
            some = {f"k{len(self.columns) + j}": x for j, x in enumerate(chosen[i : i + block])}
            panel, given = self.panel(list(some.values()))
            name = f"kept_{uuid.uuid4().hex}"
            panels.save(evaluate(panel, some, given=given), name, f"{self.folder}/{name}")
            self.tables.append(name)
            self.columns |= {canonical(x): (name, c) for c, x in some.items()}
        return self

    def panel(self, exprs: list[Expr]) -> tuple[DataFrame, dict[str, str]]:
        """The base panel with the kept columns that these expressions read, and their names by key."""
        wanted = dict.fromkeys(k for e in exprs for k in _read(e, set(self.columns)))
        out = self.base
        for name in dict.fromkeys(self.columns[k][0] for k in wanted):
            out = panels.attach(out, out.sparkSession.table(name), [self.columns[k][1] for k in wanted if self.columns[k][0] == name])
        return out, {k: self.columns[k][1] for k in wanted}

    def windows(self, exprs: list[Expr]) -> set[str]:
        """Keys of the windows that a batch still computes by itself."""

        def inside(e: Expr) -> Iterator[str]:
            if isinstance(e, Call) and canonical(e) not in self.columns:
                if windowed(e):
                    yield canonical(e)
                for a in e.args:
                    yield from inside(a)

        return {k for e in exprs for k in inside(e)}

    def release(self) -> None:
        for name in self.tables:
            panels.drop(self.base.sparkSession, name, f"{self.folder}/{name}")
        self.tables.clear()
        self.columns.clear()
