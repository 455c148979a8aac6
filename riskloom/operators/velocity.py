"""Per-card time windows and point-in-time joins.

Both cut a card's history into buckets of time, so that a card with a large share of all rows is spread over many
tasks; what a bucket needs from before it is carried in as rows or as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import trailing

DAY_US = 86_400_000_000


def _bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("bigint")


def velocity(df: DataFrame, *, card: str = "card", us: str = "us", amount: str = "amount", window_us: int = DAY_US, parts: int = 1) -> DataFrame:
    """Adds count, sum, mean and max of the card's amounts in [t - window, t): ``v_count, v_sum, v_mean, v_max``.

    Rows at the same time are excluded, one exactly ``window_us`` older is included. Missing amounts count as
    absent; empty windows give 0. See ``trailing``: the work is linear, a card is cut into stretches of a window, or of one of its ``parts``.
    """
    out = trailing(df, by=[card], at=us, window=window_us, inclusive=False, count={"v_count": amount}, total={"__sum": amount}, largest={"__max": amount}, parts=parts)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.withColumns({"v_sum": zero(F.col("__sum")), "v_mean": zero(F.try_divide(F.col("__sum"), F.col("v_count"))), "v_max": zero(F.col("__max"))}).drop("__sum", "__max")


def seconds_since_previous(df: DataFrame, *, card: str = "card", us: str = "us", tie: str = "id", width_us: int = 30 * DAY_US) -> DataFrame:
    """Adds ``gap_s``: seconds to the card's previous row in order of time and ``tie``; 0 for equal times, -1 for the first."""
    df = df.withColumn("__at", _bucket(F.col(us), width_us))
    within = F.lag(us).over(Window.partitionBy(card, "__at").orderBy(us, tie))
    ends = df.groupBy(card, "__at").agg(F.max(us).alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy(card).orderBy("__at"))).drop("__end")
    joined = df.withColumn("__within", within).join(ends.withColumnsRenamed({card: "__card", "__at": "__b"}), F.col(card).eqNullSafe(F.col("__card")) & (F.col("__at") == F.col("__b")), "left")
    gap = (F.col(us) - F.coalesce("__within", "__before")) / F.lit(1e6)
    return joined.withColumn("gap_s", F.coalesce(gap, F.lit(-1.0))).drop("__within", "__before", "__card", "__b", "__at")


def asof_join(left: DataFrame, right: DataFrame, *, by: str, us: str, right_tie: str, values: list[str], tolerance_us: int | None = None, width_us: int = 7 * DAY_US) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` for its key at or before its time.

    Both sides name key and time alike. Of right rows at equal times the last by ``right_tie`` wins. With
    ``tolerance_us``, older matches are nulled. Rows of both sides are merged per (key, time bucket); the last right
    row of earlier buckets comes in as one carried value, so nothing is compared pair by pair.
    """
    columns = left.columns
    r = right.select(F.col(by).alias("__k"), F.col(us).alias("__t"), F.lit(0).alias("__side"), F.col(right_tie).alias("__tie"), F.struct(F.col(us).alias("__mt"), *values).alias("__m"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("__row"))
    l = left.select(F.col(by).alias("__k"), F.col(us).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[right_tie].dataType).alias("__tie"), F.lit(None).cast(r.schema["__m"].dataType).alias("__m"), F.struct("*").alias("__row"))
    both = r.unionByName(l).withColumn("__at", _bucket(F.col("__t"), width_us))
    order = Window.partitionBy("__k", "__at").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__within", F.last("__m", ignorenulls=True).over(order)).where("__side = 1")
    ends = both.where("__side = 0").groupBy("__k", "__at").agg(F.max_by("__m", F.struct("__t", "__tie")).alias("__end"))
    # A left bucket needs the last right row of any earlier bucket: the same trick one level up, a row for each bucket.
    places = rows.select("__k", "__at").distinct().withColumn("__end", F.lit(None).cast(r.schema["__m"].dataType)).withColumn("__left", F.lit(0))
    steps = ends.withColumn("__left", F.lit(1)).unionByName(places)
    carried = steps.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__at", "__left").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("__left = 0").select(F.col("__k").alias("__ck"), F.col("__at").alias("__ca"), "__carry")
    joined = rows.join(carried, F.col("__k").eqNullSafe(F.col("__ck")) & (F.col("__at") == F.col("__ca")), "left")
    match = F.coalesce("__within", "__carry")
    if tolerance_us is not None:
        match = F.when(F.col("__t") - match["__mt"] <= tolerance_us, match)
    match = F.when(F.col("__k").isNotNull(), match)
    return joined.withColumn("__match", match).select(*[F.col(f"__row.{c}").alias(c) for c in columns], *[F.col(f"__match.{v}").alias(v) for v in values], F.col("__match.__mt").alias("matched_us"))


def latest_per_card(df: DataFrame, *, card: str = "card", us: str = "us", tie: str = "id", as_of_us: int | None = None) -> DataFrame:
    """The last row of each card, up to ``as_of_us`` if given: partial aggregates, no window."""
    seen = df if as_of_us is None else df.where(F.col(us) <= as_of_us)
    row = F.struct(*[F.col(c) for c in df.columns])
    return seen.groupBy(card).agg(F.max_by(row, F.struct(us, tie)).alias("r")).select("r.*")


def materialization_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``start, end``: first time, and a second after the last; an empty table fails the query."""
    empty = F.raise_error(F.lit("nothing to materialise")).cast("timestamp")
    return df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(F.coalesce("a", empty).alias("start"), (F.col("b") + F.expr("interval 1 second")).alias("end"))


def lookup_latest(entities: DataFrame, snapshot: DataFrame, *, card: str, fills: dict[str, float]) -> DataFrame:
    """Each entity row with its card's snapshot values; unknown cards and missing values take the fills."""
    joined = entities.join(snapshot.select(card, *fills), card, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})
