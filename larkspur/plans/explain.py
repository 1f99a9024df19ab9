"""Plans as text, with run-time figures, and as a Graphviz graph; timing with and without the optimizer's rules."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

RULES = ("PushDownPredicates", "ColumnPruning", "ConstantFolding", "PushPredicateThroughJoin", "InferFiltersFromConstraints", "CollapseProject", "EliminateOuterJoin")


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _nodes(plan, depth: int = 0):
    """The final physical plan, stages opened."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan(), depth)
        return
    if kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan(), depth)
        return
    yield depth, plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i), depth + 1)


def analyze(df: DataFrame) -> str:
    """Runs the query; each node with its rows and times. The rows are counted where they are made."""
    began = time.perf_counter()
    rows = df._jdf.queryExecution().toRdd().count()
    took = (time.perf_counter() - began) * 1000
    out = [f"{rows} rows in {took:.1f} ms"]
    for depth, node in _nodes(df._jdf.queryExecution().executedPlan()):
        metrics, found = node.metrics(), []
        it = metrics.keysIterator()
        while it.hasNext():
            m = metrics.apply(it.next())
            if m.value() > 0 and m.name().isDefined():
                found.append(f"{m.name().get()}: {m.value()}")
        out.append("  " * depth + node.nodeName() + (f" ({', '.join(found)})" if found else ""))
    return "\n".join(out)


def dot(df: DataFrame) -> str:
    """The optimized logical plan."""
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip()]
    out, stack = ["digraph plan {", "  node [shape=box];"], []
    for n, line in enumerate(lines):
        m = re.match(r"^([\s:|+\-]*)(.*)$", line)
        depth, label = len(m[1]), m[2].replace("\\", "\\\\").replace('"', '\\"')
        out.append(f'  n{n} [label="{label}"];')
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            out.append(f"  n{stack[-1][1]} -> n{n};")
        stack.append((depth, n))
    return "\n".join([*out, "}"])


def benchmark(spark: SparkSession, sql: str) -> str:
    """Both runs after a warm-up, into a sink that drops the rows."""

    def timed(excluded: str) -> float:
        spark.conf.set("spark.sql.optimizer.excludedRules", excluded)
        try:
            spark.sql(sql).write.format("noop").mode("overwrite").save()
            began = time.perf_counter()
            spark.sql(sql).write.format("noop").mode("overwrite").save()
            return (time.perf_counter() - began) * 1000
        finally:
            spark.conf.unset("spark.sql.optimizer.excludedRules")

    plain = timed(",".join(f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in RULES))
    best = timed("")
    return f"without rules: {plain:.1f} ms, optimized: {best:.1f} ms, ratio {plain / max(best, 0.001):.2f}"
