"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): label is the least id that it is linked with, over any number of steps.

    Each round takes the least label among an id's neighbours and then the label of that label, and ends when none changes;
    a table is written each round, so that a lost executor costs that round at most. Nothing is sent to the driver but a count.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("via"))
        new = written(step.join(jump, F.col("low") == F.col("j"), "left").select("id", F.least("low", F.coalesce("via", "low")).alias("label"), F.col("label").alias("was")))
        if not new.where("label <> was").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")
