"""References to records that are absent, withdrawn or not yet delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bloom
from ..plans.lineage import cut
from ..plans.skew import salted_join


def dangling_references(references: DataFrame, parents: DataFrame, retired: DataFrame, on: list[str]) -> DataFrame:
    """The distinct references whose target is no present record on the day of the reference.

    ``references`` has the key columns ``on``, ``period`` (a date) and any others;
    ``parents`` has ``on`` and ``day``, ``retired`` has ``on`` and ``day``; all may hold
    repeated rows.  A broadcast Bloom filter of the known keys proves most absent
    targets absent; what passes it is joined exactly.  ``state`` is ``deleted`` for
    a target withdrawn on or before the day, else ``missing`` without a row, else
    ``late`` if its first row is of a later day; a reference without any of these
    is sound and is left out.  Null keys are no references; a null period gives
    neither ``deleted`` nor ``late``.  With empty parents every reference is missing.
    """
    known = (
        parents.select(*on, F.col("day").alias("_first"), F.lit(None).cast("date").alias("_retired"))
        .unionByName(retired.select(*on, F.lit(None).cast("date").alias("_first"), F.col("day").alias("_retired")))
        .dropna(subset=on)
        .groupBy(*on)
        .agg(F.min("_first").alias("_first"), F.min("_retired").alias("_retired"))
    )
    known = cut(known)
    filter_ = bloom.build(known, on, known.count())
    # read three times below: the references are scanned and shuffled once
    probed = cut(bloom.probe(references.dropna(subset=on).distinct(), on, filter_, "_maybe"))
    absent = probed.filter(~F.col("_maybe")).withColumn("state", F.lit("missing"))
    spread = F.struct(*[F.col(c) for c in references.columns if c not in on])
    checked = salted_join(probed.filter("_maybe"), known, on, spread, "left").withColumn(
        "state",
        F.when(F.col("_retired") <= F.col("period"), "deleted").when(F.col("_first").isNull(), "missing").when(F.col("_first") > F.col("period"), "late"),
    )
    return absent.drop("_maybe").unionByName(checked.filter(F.col("state").isNotNull()).drop("_maybe", "_first", "_retired"))


def orphan_report(dangling: DataFrame) -> DataFrame:
    """Number of dangling references, of their targets and of their keys by table, period and state."""
    return dangling.groupBy("ref_table", "period", "state").agg(
        F.count("*").alias("n_references"), F.countDistinct("label", "target_va").alias("n_targets"), F.countDistinct("label", "ref_key").alias("n_keys")
    )
