"""Object stores by their own protocol: pages of keys that follow one another, and puts that may fail.

A store is any object that pickles and has ``page(low, high, token, limit)``, which gives up to ``limit`` (key, size)
of the keys from low (included) to high (not) in order, after the token, and the next token or None; and
``put(key, body)``, which puts an object whole or raises.
"""

from __future__ import annotations

import os
import time
from bisect import bisect_right
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.runtime import dealt, ship, stage_table


class Store(Protocol):
    def page(self, low: str, high: str | None, token: str | None, limit: int) -> tuple[list[tuple[str, int]], str | None]: ...

    def put(self, key: str, body: bytes) -> None: ...


class FolderStore:
    """A folder that all machines share, as a store; keys are names in it.

    A folder can't be read from a key on: a range's names are read with its first page and kept until its last.
    """

    def __init__(self, root: str):
        self.root = root.removeprefix("file://").removeprefix("file:")
        if "://" in self.root:
            raise ValueError("the folder must be mounted")
        self._range: tuple[str, str | None] | None = None
        self._names: list[str] = []

    def page(self, low: str, high: str | None, token: str | None, limit: int) -> tuple[list[tuple[str, int]], str | None]:
        if token is None or self._range != (low, high):
            self._range, self._names = (low, high), self._between(low, high)
        begin = 0 if token is None else bisect_right(self._names, token)
        some, more = self._names[begin : begin + limit], begin + limit < len(self._names)
        if not more:
            self._range, self._names = None, []
        return [(n, os.path.getsize(f"{self.root}/{n}")) for n in some], some[-1] if some and more else None

    def _between(self, low: str, high: str | None) -> list[str]:
        if not os.path.isdir(self.root):
            return []
        with os.scandir(self.root) as found:
            return sorted(e.name for e in found if low <= e.name and (high is None or e.name < high) and not e.name.startswith(".") and e.is_file())

    def put(self, key: str, body: bytes) -> None:
        os.makedirs(self.root, exist_ok=True)
        part = f"{self.root}/.{key}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(body)
        os.replace(part, f"{self.root}/{key}")


def paged_listing(spark: SparkSession, store: Store, cuts: list[str], name: str = "store", limit: int = 1000) -> DataFrame:
    """(store, key, size): the whole store. Each range between two cuts is a task that follows its pages to the end.

    Cuts are keys, which needn't be there; more cuts make more tasks. A page leaves a task before the next is
    asked for, so neither a task nor the driver ever holds all keys.
    """
    ship(spark)
    ends = sorted(set(cuts))
    ranges = [(low, high) for low, high in zip(["", *ends], [*ends, None], strict=True)]
    schema = pa.schema([("store", pa.string()), ("key", pa.string()), ("size", pa.int64())])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True):
                token, more = None, True
                while more:
                    found, token = store.page(low, high, token, limit)
                    more = token is not None
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())], schema=schema)

    rows = spark.createDataFrame(ranges, "low string, high string")
    return rows.repartitionByRange(len(ranges), "low").mapInArrow(pages, "store string, key string, size long")


def put_objects(rows: DataFrame, store: Store, key: str = "key", body: str = "body", retries: int = 3, pause: float = 0.2) -> DataFrame:
    """(name, error) of each row's put, for ``sinks.write_rejected``; a null error is a success.

    Rows are dealt by key, so that puts go over all tasks. A put that fails is tried again up to ``retries`` times, after pauses that double. A task that runs twice puts
    the same objects under the same keys. Null keys and bodies aren't put. The outcomes are written once, so
    that reading them puts nothing.
    """
    ship(rows.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for k, v in zip(b.column("name").to_pylist(), b.column("body").to_pylist(), strict=True):
                error = "no key" if k is None else "no body" if v is None else ""
                for attempt in range(0 if error else retries + 1):
                    if attempt:
                        time.sleep(pause * 2 ** (attempt - 1))
                    try:
                        store.put(k, v)
                        error = None
                        break
                    except Exception as e:  # whatever a store raises is the row's outcome
                        error = f"{type(e).__name__}: {e}"
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(errors, pa.string())], ["name", "error"])

    narrow = rows.select(F.col(key).cast("string").alias("name"), F.col(body).cast("binary").alias("body"))
    return stage_table(dealt(narrow, "name").mapInArrow(put, "name string, error string"), "outcomes")
