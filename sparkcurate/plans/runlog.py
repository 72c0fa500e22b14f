"""Run logs built from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.operators import metrics
from sparkcurate.plans.registry import query, table

LOG = """log AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS step,
    CASE o_orderstatus WHEN 'F' THEN 'eval' WHEN 'O' THEN 'train' END AS kind, round(o_totalprice, -3) AS loss FROM orders WHERE o_orderstatus <> 'P')"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    status, loss = F.col("o_orderstatus"), F.round("o_totalprice", -3)
    key = F.col("o_orderkey").cast("string")
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(key, F.lit("/900000"))).alias("progress"),
        F.when(status == "O", loss).alias("loss"), F.when(status == "F", loss).alias("eval_loss"),
    )
    return metrics.split_log(raw)


@query("run_log_split", f"WITH {LOG} SELECT o_orderkey, step, kind, loss FROM log")
def run_log_split(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("o_orderkey", "step", "kind", F.coalesce("loss", "eval_loss").alias("loss"))


@query(
    "best_checkpoint",
    f"""WITH {LOG}, e AS (SELECT * FROM log WHERE kind = 'eval' ORDER BY loss, o_orderkey LIMIT 1),
    l AS (SELECT * FROM log WHERE kind = 'train' ORDER BY o_orderkey DESC LIMIT 1)
    SELECT (SELECT count(*) FROM log WHERE kind = 'eval') AS eval_rows, e.step AS best_step, e.loss AS best_eval_loss,
      (SELECT count(*) FROM log WHERE kind = 'train') AS train_rows, l.step AS last_step, l.loss AS last_loss FROM e, l""",
)
def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_checkpoint(log(spark, sf), ["o_orderkey"])
