"""From expressions to one DataFrame: unique sub-expressions once, one select for each depth of windows.

Row operators are inlined in the expressions that use them. Windowed operators become columns; all that stand at
the same depth are built in the same select, so passes over the same partitioning share one exchange and sort.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfactor.functions.missing import clean
from loomfactor.operators import frames, sliding, stretches
from loomfactor.operators.metrics import cells, percentiles
from loomfactor.operators.ranks import rank_apart
from loomfactor.operators.registry import OPS, Pass, rank_of
from loomfactor.plans.expressions import Call, Const, Expr, Field, canonical


#: Windows over codes stand at depths up to this one, ranks over dates at its multiples: all windows that need no rank come
#: before the first ranks, so the panel changes its partitioning once a phase and not once a depth.
PHASE = 100


#: Steps of t a task holds of a code whose wide windows slide: a group is one Arrow table there.
SLIDING_STRETCH = 50_000


class Compiler:
    """``given`` names the columns of the panel that hold sub-expressions already. ``stretch`` cuts histories into that many
    steps of t, where no operator needs all of them. ``apart`` names a folder for ranks of dates too wide for a task."""

    def __init__(self, given: dict[str, str] | None = None, stretch: int | None = None, apart: str | None = None):
        self.given, self.stretch, self.apart = given or {}, stretch, apart
        #: Depth -> rows that windows there reach back.
        self.back: dict[int, int] = {}
        #: Depth -> statistics of ordered values that slide there: column -> (statistic, input, width).
        self.slides: dict[int, dict[str, tuple[str, str, int]]] = {}
        #: Depth -> statistics of frames among the windows there: column -> (statistic, inputs, rows); those that a value needs
        #: beside other windows stay windows.
        self.frames: dict[int, dict[str, tuple[str, tuple[str, ...], int]]] = {}
        self.plain: set[str] = set()
        #: Values that are made of statistics of frames and inputs -> the columns they read.
        self.of_frames: dict[str, set[str]] = {}
        #: Those among them that operators/frames.py tells as one column -> (its statistic, inputs, rows).
        self.told: dict[str, tuple[str, tuple[str, ...], int]] = {}
        self.endless = False
        self.columns: dict[str, Column] = {}
        self.levels: dict[str, int] = {}
        #: Key -> columns of the panel that its column reads.
        self.reads: dict[str, set[str]] = {}
        #: Depth -> columns that are added there, in this order: inputs of windows, windows, values of operators.
        self.inputs: dict[int, dict[str, Column]] = {}
        self.windows: dict[int, dict[str, Column]] = {}
        self.values: dict[int, dict[str, Column]] = {}
        #: Depth -> inputs of ranks at that depth, by the column that holds the rank.
        self.ranks: dict[int, dict[str, Column]] = {}
        self.names: dict[tuple, str] = {}
        #: Depth -> columns that inputs added there read.
        self.wanted: dict[int, set[str]] = {}

    def add(self, expr: Expr) -> str:
        """Plan an expression and what it needs; returns its key."""
        key = canonical(expr)
        if key in self.given:
            self._put(key, F.col(self.given[key]), 0, {self.given[key]})
        if key not in self.columns:
            match expr:
                case Field(name):
                    self._put(key, clean(F.col(name).cast("double")), 0, {name})
                case Const(value):
                    self._put(key, F.lit(float(value)), 0, set())
                case Call():
                    self._operator(key, expr)
        return key

    @property
    def by(self) -> tuple[str, ...]:
        return ("code", stretches.STRETCH) if self.stretch else ("code",)

    def _operator(self, key: str, call: Call) -> None:
        op = OPS[call.op]
        timed = op.kind in ("rolling", "pair")
        inputs = call.args[:-1] if timed else call.args
        window = int(call.args[-1].value) if timed else 0
        keys = [self.add(a) for a in inputs]
        level = max(self.levels[k] for k in keys)
        if not op.windowed:
            value = op.passes[0]([self.columns[k] for k in keys], window, Pass(lambda n, c: c, []))
            self._put(key, clean(value), level, set().union(*(self.reads[k] for k in keys)))
            return
        first = (level // PHASE + 1) * PHASE if call.op == "Rank" else level + 1
        self.wanted.setdefault(first, set()).update(*(self.reads[k] for k in keys))
        args = [self._named(self.inputs, first, ("input", k), self.columns[k]) for k in keys]
        if call.op == "Rank":
            column, level = self._named(self.ranks, first, ("value", key), args[0]), first
        elif op.ordered and window > sliding.WIDE:
            level += 1
            self.back[level] = max(self.back.get(level, 0), window)
            where, slid = {}, self.slides.setdefault(level, {})
            column = clean(self._named(where, level, ("value", key, 0), args[0]))
            # The values slide by the name of their input, which the panel has at this depth.
            slid |= {name: (op.ordered, self.names["input", keys[0], first], window) for name in where.get(level, {})}
        else:
            self.endless |= op.endless
            earlier: list[Column] = []
            for step, build in enumerate(op.passes):
                level += 1
                self.back[level] = max(self.back.get(level, 0), window)
                held, framed, told, read = set(), set(), [], tuple(self.names["input", k, first] for k in keys)

                def hold(stat: str, c: Column, used=held, at=level) -> Column:
                    column = self._named(self.windows, at, (stat, window, tuple(keys), at), c)
                    used.add(self.names[stat, window, tuple(keys), at])
                    return column

                def frame(stat: str, c: Column, used=framed, at=level, read=read) -> Column:
                    column = hold(stat, c, used, at)
                    self.frames.setdefault(at, {})[self.names[stat, window, tuple(keys), at]] = (stat, read, window)
                    return column

                value = self._named(self.values, level, ("value", key, step), clean(build(args, window, Pass(hold, list(earlier), self.by, frame, told.append))))
                if framed and not held and not earlier:
                    self.of_frames[self.names["value", key, step]] = {*framed, *read}
                    self.told |= {self.names["value", key, step]: (stat, read, window) for stat in told if stat in frames.TOLD}
                else:
                    self.plain |= framed
                earlier.append(value)
            column = earlier[-1]
        self._put(key, column, level, {self.names[("value", key) if call.op == "Rank" else ("value", key, len(op.passes) - 1)]})

    def _named(self, where: dict[int, dict[str, Column]], level: int, key: tuple, column: Column) -> Column:
        """A column that is added once at a depth, under a name of its own."""
        key = (*key, level) if key[0] == "input" else key
        if key not in self.names:
            self.names[key] = f"_e{len(self.names)}"
            where.setdefault(level, {})[self.names[key]] = column
        return F.col(self.names[key])

    def _put(self, key: str, column: Column, level: int, reads: set[str]) -> None:
        self.columns[key], self.levels[key], self.reads[key] = column, level, reads

    def run(self, panel: DataFrame, outputs: list[str], keep: list[str]) -> DataFrame:
        """panel with the columns that the outputs read; what later depths do not need is dropped before each exchange."""
        if self.stretch and self.endless:
            raise ValueError("averages without end cannot be cut into stretches")
        always = {"t", "trade_date", "code", *keep}.union(*(self.reads[k] for k in outputs))
        levels = sorted({*self.inputs, *self.windows, *self.values, *self.ranks, *self.slides})
        is_cut = False
        #: Statistics of frames, and values made of them, that no window of this phase has asked for yet: the rows of a code lie in
        #: order until they are computed.
        frame, value = {}, {}
        for level in levels:
            ranks = self.ranks.get(level, {})
            if frame and (ranks or self.wanted.get(level, set()) & value.keys()):
                needed = always.union(*(names for at, names in self.wanted.items() if at >= level), *(self.of_frames[n] for n in value))
                panel = frames.with_frames(panel.select(*[c for c in panel.columns if c in needed]) if ranks else panel, frame).withColumns(value)
                frame, value = {}, {}
            if self.stretch and not ranks and not is_cut and level in self.back:
                # Windows between two depths of ranks look back through one another.
                phase = [at for at in levels if at // PHASE == level // PHASE]
                panel, is_cut = stretches.cut(panel, self.stretch, sum(self.back.get(at, 0) for at in phase)), True
            if ranks and is_cut:
                panel, is_cut = stretches.join_up(panel), False
            if ranks:
                later = always.union(*(names for at, names in self.wanted.items() if at >= level))
                panel = panel.select(*[c for c in panel.columns if c in later])
            few = {n: rank_of(x) for n, x in ranks.items()} if len(ranks) <= FEW_RANKS and not self.apart else {}
            here = {n: x for n, x in self.frames.get(level, {}).items() if n not in self.plain}
            here = here if len(here) > frames.FEW and not self.stretch else {}
            later_values = {n: x for n, x in self.values.get(level, {}).items() if n in self.of_frames and self.of_frames[n] & here.keys()}
            windows = {n: x for n, x in self.windows.get(level, {}).items() if n not in here}
            # One column for a value where there is one, and what the other values are made of.
            told = {n: self.told[n] for n in later_values if n in self.told}
            still = set().union(*(self.of_frames[n] for n in later_values if n not in told))
            frame |= {n: x for n, x in here.items() if n in still} | {f"{n}_told": x for n, x in told.items()}
            value |= {n: F.col(f"{n}_told") if n in told else x for n, x in later_values.items()}
            values = {n: x for n, x in self.values.get(level, {}).items() if n not in later_values}
            for added in (self.inputs.get(level, {}), windows, values, few):
                panel = panel.withColumns(added) if added else panel
            if level in self.slides:
                if self.stretch:
                    panel = sliding.with_slides(panel, list(self.by), self.slides[level])
                else:
                    held = stretches.cut(panel, SLIDING_STRETCH, self.back[level])
                    panel = stretches.join_up(sliding.with_slides(held, ["code", stretches.STRETCH], self.slides[level]))
            if ranks and not few:
                later = always.union(*(names for at, names in self.wanted.items() if at > level))
                kept = [c for c in panel.columns if c in later]
                panel = rank_apart(panel, ranks, kept, self.apart) if self.apart else _rank_together(panel, ranks, kept)
        if frame:
            needed = always.union(*(self.of_frames[n] for n in value))
            panel = frames.with_frames(panel.select(*[c for c in panel.columns if c in needed]), frame).withColumns(value)
        return stretches.join_up(panel) if is_cut else panel


#: So many ranks at one depth have a window each; more are ranked date by date.
FEW_RANKS = 2


def _rank_together(panel: DataFrame, ranks: dict[str, Column], keep: list[str]) -> DataFrame:
    """The columns to keep with an ordinal percentile for each input. Each would sort every date by itself; here a date's
    cross-section is one Arrow table whose columns are ranked in turn: one exchange for any number. A cross-section is
    the codes listed on a date."""
    inputs, names = panel.select(*keep, *[x.alias(n) for n, x in ranks.items()]), list(ranks)

    def rank(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["code"]))
        for name in names:
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, pa.array(percentiles(cells(table[name])), from_pandas=True))
        return table

    return inputs.groupBy("trade_date").applyInArrow(rank, inputs.schema)


def evaluate(
    panel: DataFrame,
    nodes: dict[str, Expr],
    keep: list[str] = (),
    given: dict[str, str] | None = None,
    stretch: int | None = None,
    apart: str | None = None,
) -> DataFrame:
    """(t, trade_date, code, keep..., one column for each named expression) of a dense panel. given: keys of sub-expressions
    that the panel holds already -> their columns. stretch: steps of t of one code that a task takes at a time. apart: a
    folder where ranks are sorted over many tasks, for dates of more codes than a task should hold."""
    compiler = Compiler(given, stretch, apart)
    keys = {name: compiler.add(node) for name, node in nodes.items()}
    out = compiler.run(panel, list(keys.values()), list(keep))
    return out.select("t", "trade_date", "code", *keep, *[compiler.columns[k].alias(n) for n, k in keys.items()])


def long_form(wide: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """(expr_id, t, trade_date, code, keep..., f): a row for each cell of each expression."""
    ids = ["t", "trade_date", "code", *keep]
    return wide.unpivot(ids, names, "expr_id", "f")
