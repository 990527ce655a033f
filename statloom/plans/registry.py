"""The operators by category, for search and help."""

from __future__ import annotations

import importlib
import inspect

#: Modules with public operators.
CATEGORIES = {
    "rows and columns": "transform", "cleaning": "clean", "joins": "join", "aggregates": "aggregate", "reshaping": "reshape", "features": "features",
    "quality": "quality", "statistics": "stats", "regression": "moments", "models": "models", "causal": "causal", "series": "series", "survival": "survival", "learning": "learn",
    "inference": "inference", "likelihood": "likelihood", "regression models": "regress", "effects": "effects", "forecasting": "forecast", "spatial": "spatial", "trees": "trees", "clustering": "cluster", "graphs": "graph", "dynamic panels": "panel", "neighbours and maps": "neighbours",
}


def operators() -> dict[str, dict[str, str]]:
    """category -> operator -> signature and first line of its help."""
    out: dict[str, dict[str, str]] = {}
    for category, module in CATEGORIES.items():
        m = importlib.import_module(f"statloom.operators.{module}")
        found = {n: f for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and n[0] != "_"}
        out[category] = {n: f"{n}{inspect.signature(f)}: {(inspect.getdoc(f) or '').splitlines()[0] if f.__doc__ else ''}" for n, f in found.items()}
    return out


def search(words: str) -> list[tuple[str, str]]:
    """(category, operator) whose name or help holds every word."""
    wanted = words.lower().split()
    return [(c, n) for c, ops in operators().items() for n, said in ops.items() if all(w in f"{c} {said}".lower() for w in wanted)]


def info(name: str) -> str:
    """Signature and help of an operator."""
    for ops in operators().values():
        if name in ops:
            return ops[name]
    raise KeyError(name)
