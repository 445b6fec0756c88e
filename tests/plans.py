"""What a run of a plan really did."""

from pyspark.sql import DataFrame


def most_rows(df: DataFrame) -> int:
    """The most rows that a join of the plan gave out, by its metrics after a run."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution()
        plan.executedPlan().execute().count()
        most, todo = 0, [plan.executedPlan()]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return most
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
