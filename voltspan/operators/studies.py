"""Studies in stages: a durable ledger to resume from, a queue with a budget, and families that stay from an earlier run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltspan.operators.tours import numbered
from voltspan.sinks.keyed import Keyed

Stage = tuple[str, Callable[[DataFrame | None], DataFrame]]


class StaleStudy(ValueError):
    """The ledger holds the study for other inputs or options."""


class Ledger:
    """Stages of studies on a shared folder. A stage is done once its record is committed; its table is written before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Keyed(spark, f"{self.path}/ledger")

    def records(self, study: str) -> dict[str, dict]:
        found = self.store.read().where(F.col("scope") == study).select("key", "value").collect()
        return {r.key.removeprefix(f"{study}/"): json.loads(r.value) for r in found}

    def _record(self, study: str, stage: str, value: dict) -> None:
        self.store.put(self.spark.createDataFrame([(f"{study}/{stage}", study, json.dumps(value))], "key string, scope string, value string"))

    def run(self, study: str, identity: str, stages: list[Stage]) -> DataFrame:
        """The last stage's table. Each stage gets the one before; those that the ledger has are read, the first that it lacks and
        all behind it run. A study that is there for another identity is refused until it is reset."""
        held, df, going = self.records(study), None, True
        if any(r["identity"] != identity for r in held.values()):
            raise StaleStudy(study)
        for name, stage in stages:
            going = going and name in held
            if not going:
                out = stage(df)
                path = f"{self.path}/{study}-{name}-{uuid.uuid4().hex}"
                out.write.parquet(path)
                held[name] = {"identity": identity, "path": path, "schema": out.schema.json()}
                self._record(study, name, held[name])
            df = self._table(held[name])
        return df

    def _table(self, record: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(record["schema"]))).parquet(record["path"])

    def reset(self, study: str) -> None:
        self.store.reset([study])

    def families(self, study: str, identity: str, runs: dict[str, list[Stage]]) -> dict[str, DataFrame]:
        """The last table of each family of a study: of those in runs, and of those that an earlier run of equal identity has left.
        Families of another identity are dropped."""
        kept = {f"{study}:{f}": f for f in runs}
        names = self.store.read().where(F.col("scope").startswith(f"{study}:")).select("scope").distinct().collect()
        out = {}
        for name in sorted({r.scope for r in names} | set(kept)):
            held = self.records(name)
            if any(r["identity"] != identity for r in held.values()):
                self.reset(name)
                held = {}
            if name in kept:
                out[kept[name]] = self.run(name, identity, runs[kept[name]])
            elif last := held.get("RESULT"):
                out[name.partition(":")[2]] = self._table(last)
        return out


def queued(cases: DataFrame, budget: int) -> DataFrame:
    """id, slot, status of promoted cases: RUN for the first so many slots, else NOT_RUN_BUDGET.

    cases (id, explicit, violation, loading, direct, islanding, promoted). Explicit ones come first; then those that only a full
    run can judge (direct) and those at risk take turns, risk first, while both last; then the rest at risk, and islanding ones
    at the end. Within a kind: violations, then the greater loading (missing last), then the lesser id."""
    kind = F.when(F.col("explicit"), 0).when(F.col("islanding"), 3).when(F.col("direct"), 1).otherwise(2)
    order = ["kind", F.col("violation").desc(), F.col("loading").desc_nulls_last(), F.col("id")]
    placed = numbered(cases.where("promoted").withColumn("kind", kind).select("id", "kind", "violation", "loading"), *order)
    n = {r.kind: r["count"] for r in placed.groupBy("kind").count().collect()}
    first, direct, risk = (n.get(k, 0) for k in range(3))
    turns = min(direct, risk)
    i = F.col("pos") - F.when(F.col("kind") == 1, first).when(F.col("kind") == 2, first + direct).otherwise(0)
    # Of two kinds that take turns, what is left over follows without gaps.
    slot = F.when(F.col("kind").isin(0, 3), F.col("pos")).when(i >= turns, first + turns + i).otherwise(first + 2 * i + F.when(F.col("kind") == 1, 1).otherwise(0))
    return placed.select("id", slot.cast("long").alias("slot")).withColumn("status", F.when(F.col("slot") < budget, "RUN").otherwise("NOT_RUN_BUDGET"))
