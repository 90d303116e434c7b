"""What holds over all scenarios of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def robust(events: DataFrame, keys: list[str], scenario: str, n_scenarios: int) -> DataFrame:
    """keys, minimum_count, maximum_count, support and consequences of each event over all scenarios.

    events: keys, scenario, least, most, consequence; one row for an event and scenario. A scenario without the event
    counts 0, so an event is `required` only if every scenario has it, otherwise `possible`.
    """
    rows = events.groupBy(*keys).agg(F.count_distinct(scenario).alias("_n"), F.min("least").alias("_lo"), F.max("most").alias("maximum_count"), F.array_join(F.sort_array(F.collect_set("consequence")), ";").alias("consequences"))
    low = F.when(F.col("_n") < n_scenarios, 0).otherwise(F.col("_lo")).cast("long")
    return rows.select(*keys, low.alias("minimum_count"), F.col("maximum_count").cast("long").alias("maximum_count"), F.when(low > 0, "required").otherwise("possible").alias("support"), "consequences")
