"""Values of formulas kept by their canonical text and extended by new dates only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grammar
from .compiler import with_formula


class FactorStore:
    """Formulas' values (date, symbol, f) as Parquet under a shared folder, a subfolder per formula and extension.

    An extension computes the dates after the last kept one; the look-back of the formula says from which row of
    the panel on, so the filter on dates reaches below its windows. An extension is named by its first date and
    overwrites what a failed attempt left. The panel's past must not change: another panel needs another folder.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, formula: str) -> str:
        return f"{self.folder}/{hashlib.sha256(str(grammar.parse(formula)).encode()).hexdigest()[:32]}"

    def kept(self, formula: str) -> DataFrame | None:
        """What is kept of a formula, or None."""
        path = self._path(formula)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        done = [f for f in place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place) if self._whole(f.getPath())]
        if not done:
            return None
        return self.spark.read.schema("date date, symbol string, f double").parquet(*[f.getPath().toString() for f in done])

    def _whole(self, place) -> bool:
        """Whether a write has ended: Spark's committer leaves a mark."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def values(self, panel: DataFrame, formula: str) -> DataFrame:
        """(date, symbol, f) for all dates of ``panel``, of which only those after the kept ones are computed."""
        kept = self.kept(formula)
        last = kept.agg(F.max("date")).first()[0] if kept is not None else None
        first = panel.filter(F.col("date") > F.lit(last)).agg(F.min("date")).first()[0] if last is not None else panel.agg(F.min("date")).first()[0]
        if first is not None:
            new = with_formula(panel, formula, start=str(first) if last is not None else None)
            new.select("date", "symbol", "f").write.mode("overwrite").parquet(f"{self._path(formula)}/from={first}")
            kept = self.kept(formula)
        return kept if kept is not None else with_formula(panel, formula).select("date", "symbol", "f")
