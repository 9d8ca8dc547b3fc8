"""CSV sinks whose rows are checked while they are written.

The checks are observed metrics of the writing job itself, so the rows are neither read nor computed a second time. A load lies in a folder of its own; when its
metrics meet the expectations, a small manifest with these metrics is added, and readers take the newest manifest. A load that fails a check, or whose job
fails, is never named by a manifest: readers keep the load before. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.staging import remove

MANIFEST = "version long, folder string, columns string, n_rows long, first_day date, last_day date"


class CheckFailed(ValueError):
    """A load that was not published; the text names every check that failed."""


@dataclass(frozen=True)
class Expect:
    """What a load must meet: a number of rows, columns without NULL, a day column inside a span, columns inside a closed range (NULLs and NaN are not
    compared; name the column in ``required`` to forbid NULLs)."""

    min_rows: int = 1
    max_rows: int | None = None
    required: Sequence[str] = ()
    day: str | None = None
    first_day: dt.date | None = None
    last_day: dt.date | None = None
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def metrics(self) -> dict[str, Column]:
        day = F.col(self.day) if self.day else F.lit(None).cast("date")
        found = {"n_rows": F.count(F.lit(1)), "first_day": F.min(day), "last_day": F.max(day)}
        found |= {f"nulls {c}": F.count_if(F.col(c).isNull()) for c in self.required}
        return found | {f"outside {c}": F.count_if((F.col(c) < lo) | (F.col(c) > hi) & ~F.isnan(F.col(c).cast("double"))) for c, (lo, hi) in self.ranges.items()}

    def failures(self, seen: Mapping) -> list[str]:
        out = [f"{seen['n_rows']} rows, fewer than {self.min_rows}"] if seen["n_rows"] < self.min_rows else []
        if self.max_rows is not None and seen["n_rows"] > self.max_rows:
            out.append(f"{seen['n_rows']} rows, more than {self.max_rows}")
        out += [f"{n} rows: {name}" for name, n in seen.items() if name.startswith(("nulls ", "outside ")) and n]
        if self.first_day and seen["first_day"] and seen["first_day"] < self.first_day:
            out.append(f"first day {seen['first_day']} before {self.first_day}")
        if self.last_day and seen["last_day"] and seen["last_day"] > self.last_day:
            out.append(f"last day {seen['last_day']} after {self.last_day}")
        return out


class CheckedCsv:
    """Loads under ``path``: ``data/<load>`` holds CSV files with a header, ``published/<version>`` one manifest row."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def newest(self):
        """Manifest row of the load that readers see, or None before the first."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/published/*")
        except Exception as missing:  # the folder appears with the first load
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise
        return rows.orderBy(F.desc("version")).first()

    def write(self, df: DataFrame, expect: Expect) -> dict:
        """Publish ``df`` if it meets ``expect``; returns the metrics. Otherwise its files go and ``CheckFailed`` is raised."""
        before, seen = self.newest(), Observation()
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        metrics = expect.metrics()
        df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.csv(folder, header=True)
        found = seen.get
        if failed := expect.failures(found):
            remove(self.spark, folder)
            raise CheckFailed("; ".join(failed))
        version = before.version + 1 if before else 0
        row = (version, folder, df.schema.json(), found["n_rows"], found["first_day"], found["last_day"])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.path}/published/{version:012d}")
        return found

    def read(self) -> DataFrame:
        from pyspark.sql.types import _parse_datatype_json_string

        last = self.newest()
        return self.spark.read.schema(_parse_datatype_json_string(last.columns)).csv(last.folder, header=True)
