"""Column names, calendar fields, labels and null-aware comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels the results must carry.
SUMMER_MONTHS = (6, 7, 8)
MONTH_NAMES = {6: "June", 7: "July", 8: "August"}
HOLIDAY_TYPES = {0: "Non-Holiday", 1: "Holiday"}
MARKDOWN_TYPES = {0: "No Markdown", 1: "With Markdown"}
SEASONS = ("Winter", "Spring", "Summer", "Fall")


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case snake names for every column; two names that become equal are an error."""
    names = [normalise_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns collide after normalising their names: {clashes}")
    return df.toDF(*names)


def find_column(df: DataFrame, name: str) -> str | None:
    """The column called ``name`` whatever its case and outer spaces, or None."""
    wanted = name.strip().lower()
    matches = [c for c in df.columns if c.strip().lower() == wanted]
    return matches[-1] if matches else None


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so that averages and counts skip it."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        [
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def differs(left: Column, right: Column) -> Column:
    """Unequal, where a missing value on either side counts as unequal."""
    return F.coalesce(left != right, F.lit(True))


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar year and month with the ISO week number."""
    return df.withColumns(
        {"year": F.year(date), "month": F.month(date), "week_of_year": F.weekofyear(date)}
    )


def is_summer(month: Column) -> Column:
    return month.isin(*SUMMER_MONTHS).cast("int")


def total_markdown(columns: list[str]) -> Column:
    """Row sum where missing parts count as zero."""
    total = F.lit(0.0)
    for name in columns:
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return total


def has_markdown(total: Column) -> Column:
    return (total > 0).cast("int")


def season_of(month: Column, names: tuple[str, str, str, str] = SEASONS) -> Column:
    """Three-month seasons, the first one starting in December."""
    return F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.floor((month % 12) / F.lit(3)) + 1).cast("int")
    )


def label(code: Column, names: dict[int, str]) -> Column:
    """The text for an integer or boolean code; an unknown code gives NULL."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))
