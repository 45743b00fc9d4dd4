"""Features as specifications, and the plan that computes a set of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from qpanel.functions.kernels import with_kernels


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: its expression over bars and the features it needs; kernel features have no expression."""

    name: str
    category: str
    lookback: int
    column: Column | None = None
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ("close",)


def in_order(specs: Iterable[FeatureSpec], names: Iterable[str]) -> list[list[FeatureSpec]]:
    """The named features and all they need, in layers: each needs only earlier ones."""
    known = {s.name: s for s in specs}
    depth: dict[str, int] = {}

    def place(n: str) -> int:
        if n not in depth:
            depth[n] = 1 + max((place(x) for x in known[n].needs), default=-1)
        return depth[n]

    for n in names:
        place(n)
    layers: list[list[FeatureSpec]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for n, d in depth.items():
        layers[d].append(known[n])
    return layers


def compute(bars: DataFrame, specs: Iterable[FeatureSpec], names: Iterable[str] | None = None, width: int = 40) -> DataFrame:
    """bars with the named features.

    Recursions run first, in one grouped map; all windows then share one exchange and
    one sort by (symbol, date). Wide layers are cut so that generated code stays small.
    """
    specs = list(specs)
    names = list(names) if names is not None else [s.name for s in specs if not s.name.startswith("_")]
    layers = in_order(specs, names)
    df = with_kernels(bars, [s.name for layer in layers for s in layer if s.column is None])
    for layer in layers:
        found = [s for s in layer if s.column is not None]
        for at in range(0, len(found), width):
            df = df.withColumns({s.name: s.column for s in found[at : at + width]})
    return df
