"""Registry of scorers: functions of texts that queries may use by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SCORERS: dict[str, Callable[[str], float]] = {}


def register(name: str, scorer: Callable[[str], float]) -> None:
    """Names are unique; a scorer takes a text and returns a number."""
    if name in _SCORERS:
        raise ValueError(f"{name} is registered already")
    _SCORERS[name] = scorer


def names() -> list[str]:
    return sorted(_SCORERS)


def score(name: str, text: Column) -> Column:
    """Scores by Arrow batches; a text on which the scorer fails, or a null one, scores null."""
    scorer = _SCORERS[name]

    def safe(t):
        try:
            return None if t is None else float(scorer(t))
        except Exception:
            return None

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(safe).astype("float64")

    return run(text)


def attempt(name: str, text: Column) -> Column:
    """Struct of ``raw_score`` and ``abstain_reason``: where the scorer fails the score is 0.5 and the reason its error,
    so that one plugin's fault abstains instead of failing the query; null texts abstain, too."""
    scorer = _SCORERS[name]

    @F.pandas_udf("raw_score double, abstain_reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((0.5, "no text") if t is None else (float(scorer(t)), None))
            except Exception as e:  # whatever a plugin raises is its abstention
                rows.append((0.5, f"{name}: {e}"))
        return pd.DataFrame(rows, columns=["raw_score", "abstain_reason"])

    return run(text)


def discover(group: str = "textloom.scorers") -> list[str]:
    """Registers the scorers that installed packages offer as entry points of a group; a scorer that fails to load or whose
    name is taken is left out. Returns the names that were added."""
    from importlib.metadata import entry_points

    added = []
    for e in entry_points(group=group):
        try:
            register(e.name, e.load())
            added.append(e.name)
        except Exception:  # a broken plugin must not keep the others out
            continue
    return added
