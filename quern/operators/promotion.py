"""What decisions would change in labels, before anything is written.

Labels have case_id, evidence_id, status and required; decisions case_id, evidence_id and new_status, one for a label
(``evidence.decision_faults`` finds the others). A null new_status leaves a label as it is, a null status counts under
null, a null required is none. Repeated labels each take their decision; of repeated decisions the greatest status
counts. Decisions without a label change nothing. Other columns of labels stay. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERIFIED = "verified"


def promoted(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """``labels`` with before_status and the status that they would have."""
    one = decisions.groupBy(F.col("case_id").alias("_case"), F.col("evidence_id").alias("_evidence")).agg(F.max("new_status").alias("_new"))
    held = labels.select(F.struct("*").alias("_label"))
    same = F.col("_label.case_id").eqNullSafe(F.col("_case")) & F.col("_label.evidence_id").eqNullSafe(F.col("_evidence"))
    status = F.coalesce("_new", "_label.status")
    return held.join(one, same, "left").select(F.col("_label").withField("before_status", F.col("_label.status")).withField("status", status).alias("_label")).select("_label.*")


def differences(promoted_labels: DataFrame) -> DataFrame:
    """Labels whose status would change: case_id, evidence_id, before_status, status."""
    return promoted_labels.where(~F.col("status").eqNullSafe(F.col("before_status"))).select("case_id", "evidence_id", "before_status", "status")


def status_counts(promoted_labels: DataFrame) -> DataFrame:
    """status, n_before and n_after, in one pass."""
    both = F.array(F.struct(F.col("before_status").alias("s"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("status").alias("s"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    return promoted_labels.select(F.inline(both)).groupBy(F.col("s").alias("status")).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))


def verified_cases(promoted_labels: DataFrame) -> DataFrame:
    """case_id and whether all its required labels would be verified; true where it requires none."""
    right = ~F.coalesce("required", F.lit(False)) | F.coalesce(F.col("status") == VERIFIED, F.lit(False))
    return promoted_labels.groupBy("case_id").agg(F.every(right).alias("verified"))
