"""Keyed rows on disk that grow: immutable parts, tombstones, merges.

    commits/seq=n   kind, base       (one row per change, written last)
    rows/seq=n      the rows that came in
    gone/seq=n      key              (whose earlier rows are dead)

A change that breaks off is not seen, and the next one writes over it.  Readers take
the parts that count and leave out rows whose key came in again or went.  Null keys
are refused; of rows that repeat a key within one change the one of least hash counts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.session import exists


@dataclass
class Collection:
    spark: SparkSession
    root: str
    key: str

    def _commits(self) -> list:
        path = f"{self.root}/commits"
        if not exists(self.spark, path):
            return []
        rows = self.spark.read.schema("kind string, base long, shape string, seq long").parquet(path).collect()  # one row per change
        return sorted(rows, key=lambda r: r.seq)

    def _state(self) -> tuple[list[int], object]:
        commits = self._commits()
        return ([c.seq for c in commits if c.seq >= commits[-1].base], commits[-1]) if commits else ([], None)

    def _read(self, name: str, seqs: list[int], shape: StructType) -> DataFrame:
        shape = StructType(shape.fields).add("seq", "long")
        paths = [p for p in (f"{self.root}/{name}/seq={n}" for n in seqs) if exists(self.spark, f"{p}/_SUCCESS")]
        return self.spark.read.schema(shape).option("basePath", f"{self.root}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def read(self) -> DataFrame:
        """What is in now."""
        seqs, last = self._state()
        if not last:
            raise FileNotFoundError(f"nothing was ever put into {self.root}")
        shape = StructType.fromJson(json.loads(last.shape))
        rows = self._read("rows", seqs, shape)
        if len(seqs) > 1:
            gone = self._read("gone", seqs, StructType([shape[self.key]])).groupBy(F.col(self.key).alias("_gone")).agg(F.max("seq").alias("_until"))
            rows = rows.join(gone, (F.col(self.key) == F.col("_gone")) & (F.col("_until") > F.col("seq")), "left_anti")
        return rows.select(*shape.names)

    def _commit(self, seq: int, kind: str, base: int, shape: StructType) -> int:
        row = self.spark.createDataFrame([(kind, base, shape.json())], "kind string, base long, shape string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/seq={seq}")
        return seq

    def replace(self, rows: DataFrame) -> int:
        """These rows and no others."""
        _, last = self._state()
        seq = last.seq + 1 if last else 0
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/seq={seq}")
        return self._commit(seq, "merge", seq, rows.schema)

    def upsert(self, rows: DataFrame) -> int:
        """Rows come in; those of a known key take its place."""
        seqs, last = self._state()
        refused = F.raise_error(F.lit("a row without its key")).cast(rows.schema[self.key].dataType)
        rows = rows.withColumn(self.key, F.coalesce(self.key, refused))
        one = rows.groupBy(self.key).agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_r")).select("_r.*")
        if not last:
            return self.replace(one)
        seq = last.seq + 1
        one.write.mode("overwrite").parquet(f"{self.root}/rows/seq={seq}")
        self.spark.read.schema(one.schema).parquet(f"{self.root}/rows/seq={seq}").select(self.key).write.mode("overwrite").parquet(f"{self.root}/gone/seq={seq}")
        return self._commit(seq, "upsert", last.base, rows.schema)

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys go; unknown ones are no error."""
        _, last = self._state()
        if not last:
            return -1
        seq = last.seq + 1
        keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{self.root}/gone/seq={seq}")
        return self._commit(seq, "delete", last.base, StructType.fromJson(json.loads(last.shape)))

    def merge(self) -> int:
        """What is in becomes one part."""
        return self.replace(self.read()) if self._commits() else -1
