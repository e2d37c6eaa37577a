"""Template enumeration: groups of templates over fields, field pairs and windows, deduplicated and interleaved."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations, zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfactor.plans.expressions import Validator, canonical, parse
from loomfactor.sources import files

#: Operators and field pairs that templates are made of.
SINGLE = "TsMean TsStd TsIr TsMinMaxDiff TsRank TsDelta TsDiv TsPctChange TsWMA TsEMA".split()
LOGGED = {"TsDelta", "TsPctChange", "TsIr", "TsRank"}
DIRECTED = [
    ("big_vs_small_flow", "ret_1d"),
    ("main_net_ratio", "turnover_log"),
    ("flow_imbalance", "ret_1d"),
    ("lg_net_ratio", "sm_net_ratio"),
    ("chip_cost_bias", "winner_rate_norm"),
    ("chip_width_90", "turnover_log"),
    ("hist_price_position", "ret_1d"),
    ("active_big_buy_pressure", "ret_1d"),
]
SPREADS = [("Sub", "TsMean"), ("Sub", "TsDelta"), ("Div", "TsMean")]
#: Fixed value: fields that take part in correlations of all pairs.
CORRELATED = 18


def _spread(op: str, ts: str, a: str, b: str, w: int) -> str:
    return f"{op}(Rank({ts}(${a},{w})),Rank({ts}(${b},{w})))"


def groups(fields: list[str], windows: tuple[int, ...], heavy: bool) -> dict[str, Iterator[str]]:
    single = (
        f"{outer}({ts}(${f},{w}))"
        for f in fields
        for w in windows
        for ts in SINGLE
        for outer in (("Rank", "SLog1p") if ts in LOGGED else ("Rank",))
    )
    binary = (_spread(op, ts, a, b, w) for a, b in combinations(fields, 2) for w in windows for op, ts in SPREADS)
    pair_ops = ("TsCorr", "TsCov") if heavy else ("TsCorr",)
    pairs = (f"Rank({op}(${a},${b},{w}))" for a, b in combinations(fields[:CORRELATED], 2) for w in windows for op in pair_ops)
    known = [p for p in DIRECTED if set(p) <= set(fields)]
    directed = (
        e
        for a, b in known
        for w in windows
        for e in (f"Rank(TsCorr(${a},${b},{w}))", _spread("Sub", "TsMean", a, b, w), f"Rank(TsDelta(${a},{w}))")
    )
    return {"single_field": single, "binary": binary, "pair_corr": pairs, "directional": directed}


def enumerate_templates(
    fields: list[str], windows: tuple[int, ...] = (10, 20, 30, 40, 50), limit: int | None = None, heavy: bool = False
) -> tuple[list[str], dict[str, int]]:
    """Valid templates, each canonical key once, dealt in turn from the groups; and the size of each group."""
    validator, seen, kept = Validator(fields, windows), set(), {}
    for name, group in groups(list(fields), windows, heavy).items():
        kept[name] = []
        for e in group:
            node = parse(e)
            if (key := canonical(node)) not in seen and validator.check(node) == "OK":
                seen.add(key)
                kept[name].append(e)
    stats = {k: len(v) for k, v in kept.items()}
    dealt = [e for row in zip_longest(*kept.values()) for e in row if e is not None]
    return dealt[:limit], stats | {"total": sum(stats.values())}


def save_templates(spark: SparkSession, path: str, fields: list[str], **options) -> dict[str, int]:
    """Write numbered templates, one 'index<TAB>expression' a line, and beside them the sizes of their groups as
    ``expression_stats.json``."""
    found, stats = enumerate_templates(fields, **options)
    lines = spark.createDataFrame([(i, f"{i}\t{e}") for i, e in enumerate(found, 1)], "i int, value string")
    lines.orderBy("i").select("value").coalesce(1).write.mode("overwrite").text(path)
    beside = f"{path.rsplit('/', 1)[0]}/expression_stats.json"
    files.delete(spark, beside)
    files.write_text(spark, beside, json.dumps(stats, indent=2))
    return stats


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(idx, expr) of the lines numbered start..end; lines without a tab are skipped."""
    cells = F.split("value", "\t", 2)
    rows = spark.read.text(path).filter(F.contains("value", F.lit("\t")))
    return rows.select(F.try_to_number(cells[0], F.lit("999999999")).cast("long").alias("idx"), F.trim(cells[1]).alias("expr")).filter(
        F.col("idx").between(start, end)
    )
