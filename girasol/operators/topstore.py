"""A store of the top rows of each feature that grows part by part.

A part is what one rank has at one step: its own top rows, its counts and the scalars that all parts have to
share. Parts come in any order and again after a failure; the store is read up to the last step that
every rank has.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.operators import select

_LOG = "rank int, step long, scalars string"


class TopStore:
    """``order`` ranks the rows of a feature and has to be total for the result to be one."""

    def __init__(self, spark: SparkSession, path: str, feature: str, order: list[Column], n: int, world: int) -> None:
        self.spark, self.path, self.feature, self.order, self.n, self.world = spark, path, feature, order, n, world

    def arrive(self, rows: DataFrame, rank: int, step: int, scalars: dict[str, float] | None = None) -> None:
        """Keep what a rank has at a step. The same part again replaces itself; it counts once its line is in
        the log, which is written last."""
        at = f"rank={int(rank)}/step={int(step)}"
        select.first_n(rows, [self.feature], self.order, self.n).write.mode("overwrite").parquet(f"{self.path}/top/{at}")
        rows.groupBy(self.feature).agg(F.count(F.lit(1)).alias("fires")).write.mode("overwrite").parquet(f"{self.path}/fires/{at}")
        line = [(int(rank), int(step), json.dumps(scalars or {}, sort_keys=True))]
        self.spark.createDataFrame(line, _LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def parts(self) -> DataFrame:
        """(rank, step, scalars) of the parts that are whole."""
        try:
            return self.spark.read.schema(_LOG).json(f"{self.path}/log").distinct()
        except AnalysisException:
            return self.spark.createDataFrame([], _LOG)

    def common_step(self) -> int | None:
        """The last step that all ranks have."""
        whole = self.parts().groupBy("step").agg(F.count_distinct("rank").alias("ranks")).where(F.col("ranks") == self.world)
        return whole.agg(F.max("step")).first()[0]

    def checked(self, step: int) -> DataFrame:
        """The parts up to a step; an error if their scalars differ or a rank has none."""
        own = self.parts().where(F.col("step") <= step)
        facts = own.agg(F.count_distinct("scalars").alias("kinds"), F.count_distinct("rank").alias("ranks"), F.min("scalars").alias("one"), F.max("scalars").alias("other")).first()
        if facts.kinds > 1:
            raise ValueError(f"parts differ in their scalars: {facts.one} and {facts.other}")
        if facts.ranks != self.world:
            raise ValueError(f"{facts.ranks} of {self.world} ranks have parts up to step {step}")
        return own.select("rank", "step")

    def _read(self, kind: str, step: int) -> DataFrame:
        own = self.checked(step)
        return self.spark.read.parquet(f"{self.path}/{kind}").join(F.broadcast(own), ["rank", "step"], "left_semi").drop("rank", "step")

    def _upto(self, step: int | None) -> int:
        at = self.common_step() if step is None else step
        if at is None:
            raise ValueError("no step is there from all ranks")
        return at

    def merged(self, step: int | None = None) -> DataFrame:
        """The top rows of each feature with rank_in_feature, over the parts up to a step (the last common one)."""
        return select.first_n(self._read("top", self._upto(step)), [self.feature], self.order, self.n, "rank_in_feature")

    def fires(self, step: int | None = None) -> DataFrame:
        """(feature, fires): rows of each feature, those that are in no top list included."""
        return self._read("fires", self._upto(step)).groupBy(self.feature).agg(F.sum("fires").alias("fires"))
