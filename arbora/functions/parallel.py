"""User functions over rows, with errors as values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def mapped(rows: DataFrame, key: str, column: str, f: Callable) -> DataFrame:
    """key, value, error of f over a column; the order is the key's."""

    def run(frames):
        for frame in frames:
            values, errors = [], []
            for x in frame[column]:
                try:
                    values.append(str(f(x)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  errors of the caller's function are data
                    values.append(None)
                    errors.append(str(e))
            out = frame[[key]].copy()
            out["value"], out["error"] = values, errors
            yield out

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, value string, error string")


def register(spark, name: str, f: Callable, returns: str = "string"):
    """A tool as an SQL function."""
    return spark.udf.register(name, f, returns)
