"""Pluggable functions by role: registered by name, called over batches, with one shape of result.

A function gets the columns it names as lists and gives one value, or (value, confidence), for each
row. Whatever it raises becomes a failed row and never ends the job; a deadline counts per batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame

ROLES = ("vision", "ocr", "translation", "image_edit", "visual_qa")
#: Problems whose text may be shown; of any other only the type is.
SHOWN = (ValueError, LookupError)
RESULT = "ok boolean, status string, value string, confidence double, detail string, elapsed double"
TYPES = pa.schema([("ok", pa.bool_()), ("status", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("detail", pa.string()), ("elapsed", pa.float64())])


class Providers:
    def __init__(self):
        self._made: dict[tuple[str, str], Callable] = {}

    def register(self, role: str, name: str, function: Callable) -> None:
        if role not in ROLES:
            raise ValueError(f"no such role: {role}")
        self._made[role, name] = function

    def get(self, role: str, name: str) -> Callable:
        if (role, name) not in self._made:
            raise LookupError(f"no {role} named {name}; there are {sorted(n for r, n in self._made if r == role)}")
        return self._made[role, name]

    def names(self, role: str) -> list[str]:
        return sorted(n for r, n in self._made if r == role)


def detail(error: BaseException) -> str:
    return str(error) if isinstance(error, SHOWN) else type(error).__name__


def outcome(value) -> dict:
    """One shape for a value, a (value, confidence) or a mistake."""
    text, sure = value if isinstance(value, tuple) else (value, None)
    if sure is not None and not (isinstance(sure, (int, float)) and 0 <= sure <= 1):
        return {"ok": False, "status": "failed", "detail": "confidence out of range"}
    return {"ok": text is not None, "status": "ok" if text is not None else "empty", "value": None if text is None else str(text), "confidence": sure}


def call(df: DataFrame, key: str, columns: list[str], function: Callable, timeout: float = 120.0) -> DataFrame:
    """``key`` and the result of the function for each row; rows of a batch share its time."""
    if not 0 < timeout < float("inf"):
        raise ValueError("a timeout is a positive number of seconds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(1)
        for batch in batches:
            began, given = time.monotonic(), [c.to_pylist() for c in batch.columns[1:]]
            try:
                values = list(pool.submit(function, *given).result(timeout))
                if len(values) != batch.num_rows:
                    raise ValueError(f"{len(values)} results for {batch.num_rows} rows")
                rows = [outcome(v) for v in values]
            except Late:
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(1)
                rows = [{"ok": False, "status": "timeout", "detail": f"no result in {timeout} s"}] * batch.num_rows
            except Exception as error:
                rows = [{"ok": False, "status": "failed", "detail": detail(error)}] * batch.num_rows
            spent = time.monotonic() - began
            made = pa.RecordBatch.from_pylist([{**r, "elapsed": spent} for r in rows], schema=TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[key, *TYPES.names])

    return df.select(key, *columns).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {RESULT}")


def echo(prefix: str = "") -> Callable:
    """A deterministic stand-in: gives the first column back."""
    return lambda texts, *rest: [None if t is None else (prefix + t, 1.0) for t in texts]
