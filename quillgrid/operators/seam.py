"""Seam for decoders, rasterisers and models: named functions on batches of rows.

A stage is registered as a function or as a factory, which loads what the stage needs and returns it.  A worker
process calls the factory once and keeps the function for all its tasks.  The function gets a list of
tuples and returns a list of as many entries: a tuple, or a list of tuples for a stage that makes several
rows of one.  If it fails on a batch, the rows are tried one by one, and those that fail come back with
their keys, nulls and the error; no row is lost and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Stage = Callable[[list[tuple]], list]
STAGES: dict[str, Callable[[], Stage]] = {}
_OPEN: dict[tuple[str, str], Stage] = {}


def register(name: str, stage: Stage) -> None:
    """A stage that needs nothing loaded."""
    register_factory(name, lambda: stage)


def register_factory(name: str, factory: Callable[[], Stage]) -> None:
    STAGES[name] = factory


def opened(name: str, version: str, factory: Callable[[], Stage]) -> Stage:
    """The stage's function, loaded once in this process for each registration."""
    key = (name, version)
    if key not in _OPEN:
        _OPEN[key] = factory()
    return _OPEN[key]


def run_stage(df: DataFrame, name: str, schema: str) -> DataFrame:
    """Rows of the stage ``name`` over ``df`` with a last column ``error`` (null if all went well).

    Columns of ``schema`` that ``df`` has too are the keys of a row that failed.
    """
    factory = STAGES[name]
    version = f"{id(factory):x}"
    names = [x.split()[0] for x in schema.split(",")]
    at = {n: i for i, n in enumerate(df.columns)}

    def several(entry) -> list[tuple]:
        return [(*r, None) for r in (entry if isinstance(entry, list) else [entry])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(rows: list[tuple]) -> list:
            out = opened(name, version, factory)(rows)
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} entries for {len(rows)} rows")
            return [r for entry in out for r in several(entry)]

        def alone(row: tuple) -> list[tuple]:
            try:
                return call([row])
            except Exception as e:  # noqa: BLE001  the contract of the seam
                return [(*(row[at[n]] if n in at else None for n in names), str(e) or type(e).__name__)]

        for pdf in batches:
            rows = list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None))
            try:
                done = call(rows)
            except Exception:  # noqa: BLE001
                done = [r for row in rows for r in alone(row)]
            yield pd.DataFrame(done, columns=[*names, "error"])

    return df.mapInPandas(run, schema + ", error string")
