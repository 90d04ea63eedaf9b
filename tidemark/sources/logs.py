"""Version logs made of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The same log in DuckDB SQL, over a view named events.
EVENT_LOG_SQL = """SELECT concat('user_', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS key, event_id + 1 AS seq,
  event_type = 'error' AS tombstone, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events"""


def event_log(events: DataFrame) -> DataFrame:
    """A user's events as versions of one key: seq from event_id, an error a deletion, props the value."""
    gone = F.col("event_type") == "error"
    # lpad would cut a number of more than six digits, as its SQL twin does.
    return events.select(
        F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"), gone.alias("tombstone"), F.when(~gone, F.col("props")).alias("value"),
    )
