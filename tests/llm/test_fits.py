"""Models fitted in one task on rows that all tasks read."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from gridsift.llm import labelled


def test_all_tasks_read_for_a_fit(spark):
    def who(batches):
        for batch in batches:
            yield pa.record_batch([pc.add(pc.multiply(batch.column(0), 0), TaskContext.get().taskAttemptId())], ["task"])

    rows = spark.range(0, 400, 1, 4).mapInArrow(who, "task long")
    assert labelled.fitted(rows, lambda df: (len(df), df["task"].nunique())) == (400, 4)
