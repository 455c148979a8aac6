"""Ranks and running totals over a whole table without a single-task window.

Rows are cut into ranges of the ordering key; a window runs within each range, and totals of the earlier ranges
are added. The ranges come from approximate quantiles, so only their bounds reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import pairwise
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 64


def range_bounds(df: DataFrame, key: Column, ranges: int = RANGES) -> list[float]:
    """Approximate quantiles, in order; a value that many rows share stands there more than once."""
    return sorted(df.agg(F.percentile_approx(key.cast("double"), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or [])


def _ranges(df: DataFrame, key: str, tie: Sequence[str], ranges: int, descending: bool) -> Column:
    """Number of each row's range, in the order of key and ties. Rows that share a frequent key are cut by their first tie, if it is a number."""
    cuts = range_bounds(df, F.col(key), ranges)
    bounds = sorted(set(cuts))
    place = in_range(F.col(key), bounds) * (-1 if descending else 1) * (2 * ranges)
    shared = {v: cuts.count(v) for v in bounds if cuts.count(v) > 1}
    if not shared or not tie or not isinstance(df.schema[tie[0]].dataType, T.NumericType):
        return place
    same = F.col(key).cast("double")
    quantiles = [F.percentile_approx(F.when(same == F.lit(float(v)), F.col(tie[0]).cast("double")), [i / n for i in range(1, n)], 10_000).alias(f"q{i}") for i, (v, n) in enumerate(shared.items())]
    found = df.agg(*quantiles).first()
    within = F.lit(0)
    for i, v in enumerate(shared):
        beyond = F.lit(-1 if descending else ranges)  # the rest of the value's range, above it
        after = [b for b in bounds if b > v]
        rest = (same > F.lit(float(v))) & ((same < F.lit(float(after[0]))) if after else F.lit(True))
        within = F.when(same == F.lit(float(v)), in_range(F.col(tie[0]), sorted(set(found[i] or [])))).when(rest, beyond).otherwise(within)
    return place + within


def in_range(key: Column, bounds: Sequence[float], first: int = 0) -> Column:
    """Which range a key falls in: the number of bounds at or below it, found by halving inside generated code."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    below, above = in_range(key, bounds[:mid], first), in_range(key, bounds[mid + 1 :], first + mid + 1)
    return F.when(key.cast("double") < F.lit(float(bounds[mid])), below).otherwise(above)


def running(df: DataFrame, key: str, tie: Sequence[str], totals: dict[str, Column], *, groups: Sequence[str] = (), descending: bool = False, ranges: int = RANGES, how: str = "sum") -> DataFrame:
    """Adds for each of ``totals`` its sum (or with ``how="max"`` its maximum) over the group's rows up to this one, by ``key`` and ``tie``."""
    fold, join = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}[how]
    df = df.withColumn("__range", _ranges(df, key, tie, ranges, descending))
    order = [F.col(key).desc() if descending else F.col(key).asc(), *tie]
    by = Window.partitionBy(*groups, "__range")
    rows = df.withColumns({n: fold(v).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for n, v in totals.items()})
    sums = df.groupBy(*groups, "__range").agg(*[fold(v).alias(f"__{n}") for n, v in totals.items()])
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.withColumns({f"__{n}": fold(f"__{n}").over(before) for n in totals})
    on = " and ".join(f"r.`{c}` <=> s.`{c}`" for c in (*groups, "__range"))
    joined = rows.alias("r").join(sums.alias("s"), F.expr(on))  # partitioned like the window
    return joined.select(*[join(F.col(f"r.{c}"), F.col(f"s.__{c}")).alias(c) if c in totals else F.col(f"r.{c}") for c in rows.columns if c != "__range"])


def ranked(df: DataFrame, key: str, tie: Sequence[str], name: str = "rank", *, groups: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds the 1-based position of each row in its group, in order of ``key`` and ``tie``."""
    return running(df, key, tie, {name: F.lit(1).cast("bigint")}, groups=groups, descending=descending)


def quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """``by, q``: exact quantiles of the values of each group (array in the order of ``shares``), linear between neighbours; nulls are absent.

    Sketches, merged like partial aggregates, bracket each quantile by two values with a few ten-thousandths of the rows between. One more pass counts
    the values outside each bracket and those inside by value; only these are put in order, in ranges. So no task gets a group. There
    should be few groups (columns, classes): a row for each is sent to all tasks. A group without values has none.
    """
    near = 2 / 10_000  # twice the rank error of a sketch
    rows = df.select(by, F.col(value).cast("double").alias("__x")).where("__x is not null")
    lows, highs = [max(0.0, p - near) for p in shares], [min(1.0, p + near) for p in shares]
    marks = rows.groupBy(by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", [*lows, *highs], 10_000).alias("__m"))
    at = lambda p: (F.col("__n") - 1) * F.lit(float(p))  # noqa: E731  the quantile's place, from 0
    brackets = F.array(*[F.struct(F.lit(k).alias("k"), F.get("__m", F.lit(k)).alias("lo"), F.get("__m", F.lit(k + len(shares))).alias("hi"), at(p).alias("at")) for k, p in enumerate(shares)])
    marks = marks.select(F.col(by).alias("__g"), brackets.alias("__b"))
    each = rows.join(F.broadcast(marks), F.col(by).eqNullSafe(F.col("__g"))).select("__g", "__x", F.explode("__b").alias("b"))
    side = F.when(F.col("__x") < F.col("b.lo"), -1).when(F.col("__x") > F.col("b.hi"), 1).otherwise(0)
    each = each.groupBy("__g", "b.k", "b.at", side.alias("side"), F.when(side == 0, F.col("__x")).alias("v")).agg(F.count("*").alias("n"), F.min("__x").alias("first"), F.max("__x").alias("last"))
    # All rows below a bracket stand at the last of them, those above at the first: the next to the bracket may be the quantile's neighbour.
    points = each.select("__g", "k", "at", F.when(F.col("side") < 0, F.col("last")).otherwise(F.col("first")).alias("__x"), "n")
    placed = running(points, "__x", [], {"upto": F.col("n")}, groups=["__g", "k"])
    least = lambda place: F.min(F.when(F.col("upto") > place, F.col("__x")))
    found = placed.groupBy("__g", "k", "at").agg(least(F.floor("at")).alias("a"), least(F.ceil("at")).alias("b"))
    q = F.col("a") + F.when(F.col("a") < F.col("b"), (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).otherwise(0.0)
    per = found.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return per.withColumnRenamed("__g", by)


def previous(df: DataFrame, *, by: Sequence[str], order: Sequence[str], value: str, name: str, stretch: int) -> DataFrame:
    """Adds ``name``: the ``value`` of the group's row before this one, by the whole number ``order[0]`` and then the rest; null for the first.

    A group is cut into stretches of that number. The first row of each takes the last value of the stretch before from a table with one row for each.
    """
    cut = df.withColumn("__stretch", F.floor(F.col(order[0]) / F.lit(stretch)).cast("bigint"))
    within = Window.partitionBy(*by, "__stretch").orderBy(*order)
    rows = cut.withColumns({"__within": F.lag(F.struct(value)).over(within), "__first": F.row_number().over(within) == 1})
    last = cut.groupBy(*by, "__stretch").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    last = last.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__stretch").alias("__s"), F.lag("__last").over(Window.partitionBy(*by).orderBy("__stretch")).alias("__before"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)], F.col("__stretch").eqNullSafe(F.col("__s")))
    joined = rows.join(last, on)
    return joined.select(*df.columns, F.when(F.col("__first"), F.col(f"__before.{value}")).otherwise(F.col(f"__within.{value}")).alias(name))


def ordered_fold(df: DataFrame, *, by: str, order: Sequence[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], Iterable[tuple] | None], end: Callable[[object], tuple | None], schema: str) -> DataFrame:
    """Rows of the key and what ``step`` and ``end`` give: ``step`` sees each group's rows in ``order``, part by part, with the group's state, ``end`` the last state.

    Rows are shuffled by key and sorted within their partition; a group is never held whole, only its state and the batch at hand. Null keys are a group.
    """
    fields = T.StructType.fromDDL(schema)
    kinds = {f.name: _NULLABLE[f.dataType.simpleString()] for f in fields if f.dataType.simpleString() in _NULLABLE and f.name != by}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
        frame = lambda rows: pd.DataFrame(rows, columns=fields.names).astype(kinds)
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[by]
            cuts = [0, *(np.flatnonzero(~((keys == keys.shift()) | (keys.isna() & keys.shift().isna())).to_numpy()[1:]) + 1).tolist(), len(batch)]
            for a, b in pairwise(cuts):
                now = keys.iloc[a]
                if state is None or not same(now, key):
                    if state is not None and (last := end(state)) is not None:
                        out.append((key, *last))
                    key, state = now, start()
                out += [(key, *row) for row in step(state, batch.iloc[a:b]) or ()]
            if out:
                yield frame(out)
                out = []
        if state is not None and (last := end(state)) is not None:
            yield frame([(key, *last)])

    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def ordered_fold_rows(df: DataFrame, *, by: str, order: Sequence[str], values: Sequence[str], start: Callable[[], object], step: Callable[[object, tuple], tuple | None], end: Callable[[object], tuple | None], schema: str) -> DataFrame:
    """``ordered_fold`` for many small groups: ``step`` sees one row's ``values`` (None: missing) and gives a row or None.

    A batch's columns become lists once, so a group costs no slice of a frame. At most one group's state is held.
    """
    fields = T.StructType.fromDDL(schema)
    kinds = {f.name: _NULLABLE[f.dataType.simpleString()] for f in fields if f.dataType.simpleString() in _NULLABLE and f.name != by}
    listed = lambda column: column.astype(object).where(column.notna(), None).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        frame = lambda rows: pd.DataFrame(rows, columns=fields.names).astype(kinds)
        for batch in batches:
            out = []
            for now, row in zip(listed(batch[by]), zip(*(listed(batch[c]) for c in values), strict=True), strict=True):
                if state is None or now != key:
                    if state is not None and (last := end(state)) is not None:
                        out.append((key, *last))
                    key, state = now, start()
                if (found := step(state, row)) is not None:
                    out.append((key, *found))
            if out:
                yield frame(out)
        if state is not None and (last := end(state)) is not None:
            yield frame([(key, *last)])

    return df.select(by, *values).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


#: Pandas types that hold missing values, by Spark's.
_NULLABLE = {"double": "Float64", "bigint": "Int64", "int": "Int32", "boolean": "boolean"}


def trailing(df: DataFrame, *, by: Sequence[str], at: str, window: int, inclusive: bool, count: dict[str, str] | None = None, total: dict[str, str] | None = None, largest: dict[str, str] | None = None, parts: int = 1) -> DataFrame:
    """Adds counts, sums and maxima (new name -> column) over the group's rows of the last ``window`` units of the whole number ``at``.

    The window is [at - window, at), or (at - window, at] if ``inclusive``; nulls are absent, an empty sum or maximum is null,
    and so are those of a row without a time, which counts for no other.
    A group is cut into stretches of one window. A row's values are those of the rows before it in its stretch and of the end of the
    stretch before, from where its window starts. Each row therefore also goes, without its other columns, to the next stretch, at its own time
    plus the window: there it counts for all rows at or before that place. Both are running aggregates in one partition, one up and
    one down the order, so rows are shuffled once and the work grows with them, not with rows times rows in a window.

    A window that spans much of the history leaves a frequent key few stretches. Then cut it into ``parts`` as well: stretches are a part of the
    window, and the whole parts between come from a table with a row for each stretch, at the price of two more, narrow, shuffles.
    """
    if window % parts:
        raise ValueError(f"{parts} parts don't divide a window of {window}")
    step = window // parts
    kinds = [(n, c, f) for f, wanted in ((F.count, count), (F.sum, total), (F.max, largest)) for n, c in (wanted or {}).items()]
    part = F.floor(F.col(at) / F.lit(step)).cast("bigint")
    timed = lambda c: F.when(F.col(at).isNotNull(), F.col(c))

    both = df.withColumn("__moved", F.explode(F.array(F.lit(False), F.lit(True))))
    own = ~F.col("__moved")
    both = both.select(
        *[F.col(c) if c in by else F.when(own, F.col(c)).alias(c) for c in df.columns], "__moved",
        (part + F.when(own, 0).otherwise(parts)).alias("__part"), (F.col(at) + F.when(own, 0).otherwise(window - 1 if inclusive else window)).alias("__place"),
        *[F.when(own, timed(c)).alias(f"__now_{n}") for n, c, _ in kinds], *[F.when(~own, timed(c)).alias(f"__then_{n}") for n, c, _ in kinds],
    )
    where = Window.partitionBy(*by, "__part")
    up = where.orderBy("__place").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    down = where.orderBy(F.col("__place").desc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({f"__now_{n}": f(f"__now_{n}").over(up) for n, _, f in kinds}).withColumns({f"__then_{n}": f(f"__then_{n}").over(down) for n, _, f in kinds}).where(own)
    sides = ["now", "then"]
    if parts > 1:
        fold = {F.count: F.sum}
        per = df.withColumn("__part", part).groupBy(*by, "__part").agg(*[f(timed(c)).alias(f"__mid_{n}") for n, c, f in kinds])
        between = Window.partitionBy(*by).orderBy("__part").rangeBetween(-(parts - 1), -1)
        middle = per.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, "__part"])], *[fold.get(f, f)(f"__mid_{n}").over(between).alias(f"__mid_{n}") for n, _, f in kinds])
        rows = rows.join(middle, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, "__part"])])
        sides.append("mid")

    def whole(n: str, f) -> Column:
        found = [F.col(f"__{side}_{n}") for side in sides]
        if f is F.max:
            return F.greatest(*found)
        added = reduce(add, [F.coalesce(x, F.lit(0)) for x in found])
        return added if f is F.count else F.when(F.coalesce(*found).isNotNull(), added)

    return rows.select(*df.columns, *[whole(n, f).alias(n) for n, _, f in kinds])
