"""Plans as node and edge tables: order, readiness and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, node, level) of many plans at once: level 1 depends on nothing, others on the level before; members of cycles get null.

    One round peels one level of every plan.
    """
    left = materialize(nodes.select("plan_id", "node").distinct(), "nodes")
    e = materialize(edges.select("plan_id", "src", "dst").distinct(), "edges")
    done, level = None, 0
    while True:
        level += 1
        waits = e.select("plan_id", F.col("dst").alias("node")).distinct()
        ready = materialize(left.join(waits, ["plan_id", "node"], "left_anti"), "ready")
        if ready.isEmpty():
            break
        named = ready.withColumn("level", F.lit(level))
        done = named if done is None else done.unionByName(named)
        left = materialize(left.join(ready, ["plan_id", "node"], "left_anti"), "nodes")
        e = materialize(e.join(ready.withColumnRenamed("node", "src"), ["plan_id", "src"], "left_anti"), "edges")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def ready_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes all of whose dependencies are solved; nodes have a boolean ``solved``."""
    open_ = nodes.where(~F.col("solved")).select("plan_id", F.col("node").alias("src"))
    blocked = edges.join(open_, ["plan_id", "src"]).select("plan_id", F.col("dst").alias("node")).distinct()
    return nodes.where(~F.col("solved")).join(blocked, ["plan_id", "node"], "left_anti").select("plan_id", "node")


def attach_prompts(nodes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Nodes with their prompts; what is missing is a status, not a lost row."""
    joined = nodes.join(prompts, "prompt_id", "left")
    status = F.when(F.col("prompt_id").isNull(), "no prompt id").when(F.col("template").isNull(), "unknown prompt").otherwise("ok")
    return joined.withColumn("status", status)


def cyclic_plans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Plans that have no topological order, with the number of nodes on or behind a cycle."""
    stuck = topological_levels(nodes, edges).where("level IS NULL")
    return stuck.groupBy("plan_id").agg(F.count("*").alias("n_stuck"))


def run_levels(levels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(plan_id, node, level, status) of executed plans: a level runs only if all nodes of the levels before it went well.

    Outcomes are (plan_id, node, ok). The first failing level of a plan is one aggregate, so a plan of any length takes one pass.
    """
    joined = levels.join(outcomes, ["plan_id", "node"], "left")
    stop = joined.where(~F.coalesce("ok", F.lit(False))).groupBy("plan_id").agg(F.min("level").alias("stop"))
    status = F.when(F.col("level").isNull() | (F.col("level") > F.col("stop")), "skipped").when(F.coalesce("ok", F.lit(False)), "done").otherwise("failed")
    return joined.join(stop, "plan_id", "left").select("plan_id", "node", "level", status.alias("status"))


def expand_iterations(tasks: DataFrame, values: str = "iterations") -> DataFrame:
    """One row for each iteration value of a task; a task without any runs once with a null value."""
    return tasks.withColumn("iteration_value", F.explode_outer(F.when(F.size(values) > 0, F.col(values)))).drop(values)


def ensemble_weights(rows: DataFrame, keys: list[str], weight: str, consistency: str) -> DataFrame:
    """weight * consistency^2 over their sum within the keys, the plain weight where that sum is 0; and which way to combine."""
    from pyspark.sql import Window as W

    by = W.partitionBy(*keys)
    raw = F.col(weight) * F.col(consistency) * F.col(consistency)
    total = F.sum(raw).over(by)
    mode = F.when(F.avg(consistency).over(by) >= 0.7, "selection").otherwise("synthesis")
    return rows.withColumn("final_weight", F.when(total > 0, raw / total).otherwise(F.col(weight))).withColumn("mode", mode)
