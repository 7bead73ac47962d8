"""Boundaries to the world outside Spark: downloads, media tools and models.

A provider gets admitted rows only (gates come before it in the plan: Catalyst
can't push a filter through Python), a bounded number of partitions bounds the
concurrent calls, and a failed row comes back with an error in place of a result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.plans.ladder import BACKOFF_SECONDS, STYLE_RETRIES


@dataclass(frozen=True)
class Provider:
    """``call(row) -> dict`` of the fields of ``schema``; raising fails the row, a ``retry`` error is tried again."""

    call: Callable[[dict], dict]
    schema: str
    concurrency: int = 8
    retries: int = 0
    backoff: float = BACKOFF_SECONDS
    retry: Callable[[str], bool] = lambda message: False

    def apply(self, rows: DataFrame, key: str) -> DataFrame:
        """key, the schema's fields, error and attempts of each row."""
        kind = rows.schema[key].dataType.simpleString()
        names = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        call, retries, backoff, retry = self.call, self.retries, self.backoff, self.retry

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    for attempt in range(1, retries + 2):
                        try:
                            found, error = call(row), None
                            break
                        except Exception as failure:  # noqa: BLE001 - the row's error is its result
                            found, error = {}, str(failure)[:240] or type(failure).__name__
                            if attempt > retries or not retry(error):
                                break
                            time.sleep(backoff * attempt)
                    out.append([row[key], *[found.get(n) for n in names], error, attempt])
                yield pd.DataFrame(out, columns=[key, *names, "error", "attempts"])

        return rows.repartition(self.concurrency).mapInPandas(run, f"{key} {kind}, {self.schema}, error string, attempts int")


def style_provider(call: Callable[[dict], dict]) -> Provider:
    """A caption provider: transient failures are tried once more."""
    from spoolglass.functions.text import TRANSIENT

    return Provider(call, "caption string", retries=STYLE_RETRIES, retry=lambda m: any(x in m.lower() for x in TRANSIENT))


def local_clips(spark, path: str, limit: int) -> DataFrame:
    """Clips of a folder, those over the limit left out before their bytes are read."""
    return spark.read.format("binaryFile").load(path).filter((F.col("length") > 0) & (F.col("length") <= limit))
