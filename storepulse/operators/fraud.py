"""Order scoring: rules → ML score → final score → decision (§2.3 P8–P9, §2.4, §2.11 M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.scalars import final_score, fraud_decision
from storepulse.operators.rules import rule_score


def score_orders(orders: DataFrame, ml_scores: DataFrame | None = None, key: str = "order_id") -> DataFrame:
    """Rule score, ML score (0 when no model output is given or it is missing), final score, status.

    The ML score is a column of ``orders`` (``model.with_ml_score``), or comes from a (key, ml_score) frame
    (``model.ml_score``) that is joined on the key.
    """
    scored = rule_score(orders)
    if ml_scores is None:
        scored = scored.withColumn("ml_score", F.coalesce(F.col("ml_score").cast("int"), F.lit(0)) if "ml_score" in orders.columns else F.lit(0))
    else:
        scored = scored.join(ml_scores.select(key, "ml_score"), key, "left")
        scored = scored.withColumn("ml_score", F.coalesce(F.col("ml_score").cast("int"), F.lit(0)))
    scored = scored.withColumn("final_score", final_score(F.col("rule_score"), F.col("ml_score")))
    return scored.withColumn("status", fraud_decision(F.col("final_score"), F.col("rule_score")))
