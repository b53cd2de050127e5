"""The weekly cycle as an update of a small stored table.

The features of a coming week look back a fixed number of rows, so each series' last rows are all that the
next forecast needs. They are kept as a table that every new week is merged into; the history is not read
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailcast.operators.features import LAGS, MEANS
from retailcast.schema import SERIES_KEY
from retailcast.sources.versions import Published

REACH = max(LAGS + MEANS)
CARRIED = ("store_type", "store_size", "region")


def _narrow(panel: DataFrame) -> DataFrame:
    return panel.select(*SERIES_KEY, "date", "weekly_sales", *[c for c in CARRIED if c in panel.columns])


def _last_rows(rows: DataFrame, reach: int) -> DataFrame:
    latest = Window.partitionBy(*SERIES_KEY).orderBy(F.desc("date"))
    return rows.withColumn("__age", F.row_number().over(latest)).where(F.col("__age") <= reach).drop("__age")


def recent_rows(panel: DataFrame, reach: int = REACH) -> DataFrame:
    """The last ``reach`` rows of every series: all that the features of the next week read."""
    return _last_rows(_narrow(panel), reach)


def advanced(state: DataFrame, week: DataFrame, reach: int = REACH) -> DataFrame:
    """The state after ``week``, rows that are new or corrected.

    A row for a series and date that the state has replaces it, so late corrections count as long as
    the features still look at them; older ones change no feature and are left out. New series begin
    with the rows given. Of several rows for one series and date in ``week`` any one is taken, so the key
    should be unique there.
    """
    both = state.withColumn("__new", F.lit(0)).unionByName(_narrow(week).withColumn("__new", F.lit(1)), allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy(*SERIES_KEY, "date").orderBy(F.desc("__new")))
    chosen = both.withColumn("__place", newest).where("__place = 1").drop("__place", "__new")
    return _last_rows(chosen, reach)


def stored_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state that was handed over last, or None."""
    published = Published(spark, folder)
    known = published.current().get("state")
    return None if known is None else spark.read.parquet(f"{published.folder}/{known}")


def store_state(spark: SparkSession, folder: str, state: DataFrame, based_on: int | None = None) -> int:
    """Write the state whole and hand it over; a run that dies on the way leaves the old one."""
    published = Published(spark, folder)
    name = f"{published.fresh()}/state"
    state.write.parquet(f"{published.folder}/{name}")
    return published.hand_over({"state": name}, based_on)


def take_week(spark: SparkSession, folder: str, week: DataFrame, reach: int = REACH) -> DataFrame:
    """Merge ``week`` into the stored state, hand the new state over, and return it."""
    number = Published(spark, folder).number()
    state = stored_state(spark, folder)
    store_state(spark, folder, recent_rows(week, reach) if state is None else advanced(state, week, reach), number)
    return stored_state(spark, folder)
