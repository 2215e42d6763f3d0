"""Time-ordered joins without a per-row search: as-of by union and window, ranges by binned equality."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bins of one level that a range spans at most, less one; a longer range goes to a level of bins so many times as wide.
FAN = 16


def _known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", lag: int = 0, allow_equal: bool = True, width: int | None = None) -> DataFrame:
    """left with values of the last right row at or before on - lag (forward: the first at or after on + lag), per by, as
    asof_<value>.

    One shuffle of the union of both sides; no pairs are made. With a width (of time), rows of a key are dealt over tasks by
    time: each bucket is a window of its own, and the last right row of earlier buckets (forward: the first of later ones)
    comes from a table of one row a key and bucket. Right rows with a null time or key match nothing; left rows with either
    get nulls. Of right rows with one time, the last in order of their values counts (forward: the first). All rows of left
    stay, repeated ones too.
    """
    back = direction == "backward"
    bys = [f"_by{i}" for i in range(len(by))]
    shift = F.col(on) - F.lit(lag) if back else F.col(on) + F.lit(lag)
    known = left.where(_known([on, *by]))
    keep = F.struct(*[F.col(c) for c in values])
    # among equal times the side that comes last sees the other
    side = (1 if allow_equal else -1) * (1 if back else -1)
    rows = known.select(*[F.col(c).alias(b) for c, b in zip(by, bys)], shift.alias("_at"), F.lit(side).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).alias("_value"))
    facts = right.where(_known([on, *by])).select(*[F.col(c).alias(b) for c, b in zip(by, bys)], F.col(on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), keep.alias("_value"))
    bucket = F.floor(F.col("_at") / F.lit(width)) if width else F.lit(0)
    both = rows.unionByName(facts).withColumn("_bucket", bucket)
    order = ["_at", "_side", "_value"] if back else [F.desc("_at"), F.desc("_side"), F.desc("_value")]
    found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(W.partitionBy(*bys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where("_row IS NOT NULL")
    if width:
        best = F.max(F.struct("_at", "_value")) if back else F.min(F.struct("_at", "_value"))
        ends = facts.withColumn("_bucket", bucket).groupBy(*bys, "_bucket").agg(best.alias("_end"))
        spots = ends.unionByName(rows.select(*bys, bucket.alias("_bucket")).distinct().withColumn("_end", F.lit(None)))
        spots = spots.groupBy(*bys, "_bucket").agg(F.max("_end").alias("_end"))  # a row a key and bucket
        over = W.partitionBy(*bys).orderBy("_bucket" if back else F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
        carried = spots.select(*bys, "_bucket", F.last("_end._value", ignorenulls=True).over(over).alias("_carried"))
        found = found.join(carried, [*bys, "_bucket"], "left").withColumn("_value", F.coalesce("_value", "_carried"))
    out = found.select("_row.*", *[F.col(f"_value.{c}").alias(f"asof_{c}") for c in values])
    kinds = dict(right.dtypes)
    rest = left.where(~_known([on, *by])).select("*", *[F.lit(None).cast(kinds[c]).alias(f"asof_{c}") for c in values])
    return out.unionByName(rest)


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, by: list[str], width: float) -> DataFrame:
    """points with start <= at < end, per by: equality on bins, then the exact bounds. width is that of the finest bins.

    A range is put into the bins of the level at which it spans FAN + 1 at most, levels being FAN times as wide each, so that
    neither a long range nor a long history of points is expanded without bound; points go to each level that occurs, of
    which there are as many as log(longest / width, FAN). Bounds may be fractional. Null times, bounds and keys match
    nothing; an empty range holds nothing. Columns of ranges that points have too get the suffix _range, but for by.
    """
    clash = [c for c in ranges.columns if c in points.columns and c not in by]
    ranges = ranges.select([F.col(c).alias(f"{c}_range" if c in clash else c) for c in ranges.columns])
    start, end = (f"{c}_range" if c in clash else c for c in (start, end))
    length = F.col(end).cast("double") - F.col(start).cast("double")
    level = F.greatest(F.ceil(F.log(length / F.lit(float(width * FAN))) / F.lit(math.log(FAN))), F.lit(0)).cast("int")
    r = ranges.where((F.col(end) > F.col(start)) & _known([start, end])).withColumn("_level", level)
    levels = [row[0] for row in r.select("_level").distinct().collect()]  # a few
    if not levels:
        return points.join(r.drop("_level"), by).where(F.lit(False))
    wide = F.lit(float(width)) * F.pow(F.lit(float(FAN)), F.col("_level"))
    bin_of = lambda c: F.floor(F.col(c).cast("double") / wide)
    r = r.withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    p = points.where(_known([at])).withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("_bin", bin_of(at))
    return p.join(r, [*by, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin", "_level")


def asof_sources(left: DataFrame, sources: dict[str, tuple[DataFrame, str, list[str], float]], on: str, by: list[str], width: int) -> DataFrame:
    """left with the values of several sources as of one clock: of each source the last row that was known at `on`. sources has, by
    name, the rows, their time, their values and the lag after which they are known; results are <name>_<value>.

    One shuffle of the union of all, in which each source is a column that is carried on; what buckets of `width` of time need from
    earlier ones comes from one table with a row a key and bucket. Of rows of one source and time the last in order of their
    values counts. Left rows with a null time or key get nulls.
    """
    bys = [f"_by{i}" for i in range(len(by))]
    known = left.where(_known([on, *by]))
    kinds = {n: F.struct(*[F.col(c) for c in values]) for n, (_, _, values, _) in sources.items()}
    empty = {n: rows.select(kinds[n].alias("v")).schema["v"].dataType for n, (rows, *_) in sources.items()}
    own = lambda name: [(kinds[name] if n == name else F.lit(None).cast(empty[n])).alias(f"_v_{n}") for n in sources]
    both = known.select(*[F.col(c).alias(b) for c, b in zip(by, bys)], F.col(on).cast("double").alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *own(None))
    for name, (rows, time, _, lag) in sources.items():
        facts = rows.where(_known([time, *by])).select(*[F.col(c).alias(b) for c, b in zip(by, bys)], (F.col(time) + F.lit(lag)).cast("double").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), *own(name))
        both = both.unionByName(facts)
    both = both.withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))
    columns = [f"_v_{n}" for n in sources]
    within = W.partitionBy(*bys, "_bucket").orderBy("_at", "_side", *columns).rowsBetween(W.unboundedPreceding, 0)
    found = both.select(*bys, "_bucket", "_row", *[F.last(c, ignorenulls=True).over(within).alias(c) for c in columns]).where("_row IS NOT NULL")
    ends = both.groupBy(*bys, "_bucket").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("v")))).alias(c) for c in columns])
    earlier = W.partitionBy(*bys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*bys, "_bucket", *[F.last(F.col(f"{c}.v"), ignorenulls=True).over(earlier).alias(f"_c{c}") for c in columns])
    met = found.join(carried, [*bys, "_bucket"])
    out = [F.coalesce(f"_v_{n}", f"_c_v_{n}")[c].alias(f"{n}_{c}") for n, (_, _, values, _) in sources.items() for c in values]
    done = met.select("_row.*", *out)
    rest = left.where(~_known([on, *by])).select("*", *[F.lit(None).cast(done.schema[f"{n}_{c}"].dataType).alias(f"{n}_{c}") for n, (_, _, values, _) in sources.items() for c in values])
    return done.unionByName(rest)
