"""Average ranks, cumulative counts and exact quantiles without a single-task sort."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.bucketing import bucket_of, cut_points
from statloom.operators.naming import plain_names
from statloom.operators.skew import null_safe_join
from statloom.session import settle

# A search interval with at most this many rows is not narrowed further.
NARROW_ROWS = 2_000_000
# So many rows of an interval are sorted in one aggregate; more are counted by value and written.
SORT_ROWS = 20_000
# Steps of the quantile grid that a sketch is asked for.
GRID = 200


def counted(df: DataFrame, value: str, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Rows per distinct value (and per `keep` group); a frequent value is combined before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value, *keep).agg(F.count("*").alias("n"))


def cumulative(counts: DataFrame, value: str, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Over the rows of `counted`: `tie` (rows sharing the value) and `below` (rows with a smaller value).

    Values are cut into ordered buckets, windows run inside the buckets, and the bucket totals (at most a few thousand
    rows per segment) supply the offsets.
    """
    by, keep = list(by), list(keep)
    cut = counts.withColumn("_bucket", bucket_of(F.col(value), cut_points(counts, value)))
    ordered = Window.partitionBy(*by, "_bucket").orderBy(value)
    upto = F.sum("n").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tie = F.sum("n").over(Window.partitionBy(*by, "_bucket", value))
    out = cut.withColumn("tie", tie).withColumn("below", upto - F.col("tie"))
    totals = cut.groupBy(*by, "_bucket").agg(F.sum("n").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    if by:
        out = null_safe_join(out, offsets, [*by, "_bucket"])
    else:
        out = out.join(F.broadcast(offsets), "_bucket")  # one row per bucket, 4096 at most
    return out.withColumn("below", F.col("below") + F.col("_offset")).drop("_bucket", "_offset")


def value_table(df: DataFrame, value: str, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """The counted values, written once, as several parts of a plan read them."""
    return settle(counted(df, value, by, keep))


@plain_names("value", "by", "keep")
def average_ranks(df: DataFrame, value: str, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their positions."""
    return with_ranks(value_table(df, value, by, keep), value, by, keep)


def with_ranks(counts: DataFrame, value: str, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    return cumulative(counts, value, by, keep).withColumn("rank", F.col("below") + (F.col("tie") + 1) / 2)


@plain_names("values", "by", told=("variable",))
def quantiles(df: DataFrame, values: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per (by, column), column `q` an array in order of `probs`.

    Whole columns are searched by narrowing; segments read the order statistics out of the cumulative counts.
    """
    by = list(by)
    if not by:
        return _narrowed(df, values, probs)
    out = None
    for v in values:
        part = counted_quantiles(settle(counted(df, v, by)), v, probs, by).select(*by, F.lit(v).alias("variable"), "q")
        out = part if out is None else out.unionByName(part)
    return out


def counted_quantiles(counts: DataFrame, value: str, probs: list[float], by: list[str]) -> DataFrame:
    """(by, q) from counted values: the neighbours of each position are picked and interpolated."""
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    cum = null_safe_join(cumulative(counts, value, by), sizes, list(by))
    held = F.col("below") + F.col("n")
    picks, q = [], []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks.append(F.max(F.when((F.col("below") <= low) & (low < held), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.max(F.when((F.col("below") <= high) & (high < held), F.col(value))).alias(f"_hi{i}"))
        picks.append(F.first(at - low).alias(f"_w{i}"))
        q.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}"))
    return cum.groupBy(*by).agg(*picks).select(*by, F.array(*q).alias("q"))


@dataclass
class _Target:
    """Search interval of one order statistic pair: rows below `low` and rows inside [low, high]."""

    value: str
    at: float
    low: float
    high: float
    below: int
    inside: int
    grid: list[float] | None = None
    margin: int = 1
    done: bool = False

    def proposal(self) -> tuple[float, float]:
        """Grid cells around the target's place inside the interval; the interval itself without a grid."""
        if self.grid is None:
            return self.low, self.high
        spot = (self.at - self.below) / max(self.inside, 1) * GRID
        first, last = math.floor(spot) - self.margin, math.ceil(spot) + self.margin
        low = self.low if first <= 0 else self.grid[first]
        high = self.high if last >= GRID else self.grid[last]
        return low, high

    def expected(self) -> float:
        return self.inside * (1 if self.grid is None else min(1.0, (2 * self.margin + 1) / GRID))


def _grid(x: Column, size: Column) -> Column:
    """Evenly spaced quantiles of a column as a sketch sees them."""
    cuts = F.expr("array(" + ", ".join(f"{i / GRID}D" for i in range(GRID + 1)) + ")")
    return F.when(size > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(2000)), cuts))


def _narrowed(df: DataFrame, values: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of whole columns by narrowing: sketch, check by counting, repeat on what is left.

    Every round is one scan that returns a few numbers per quantile and shuffles nothing. A proposed interval is
    only taken once exact counts show that it holds the wanted rows, so the result is exact whatever the sketch
    says. A round narrows an interval or finds that it cannot be narrowed, so the rounds end; what remains is counted by
    value and read out of the cumulative counts, however much it is.
    """
    # what is not a number has no place in an order
    data = df.select(*[F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in values])
    first = data.agg(*[F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
                                _grid(F.col(v), F.count(v)).alias("grid")).alias(v) for v in values]).first()
    targets = []
    for v in values:
        n, low, high, grid = first[v]
        targets += [_Target(v, p * max(n - 1, 0), low, high, 0, n, grid, done=low == high) for p in probs]
    while live := [t for t in targets if not t.done]:
        _round(data, live)
    hits = [F.when(F.col(t.value).between(t.low, t.high), F.struct(F.lit(i).alias("target"), F.col(t.value).alias("x")))
            for i, t in enumerate(targets) if t.low != t.high]
    if not hits:
        one = df.sparkSession.range(1)
    elif max(t.inside for t in targets if t.low != t.high) <= SORT_ROWS:
        one = _sorted(data, targets)
    else:
        one = _search(data, targets, hits)
    q = [F.lit(t.low).cast("double") if t.low == t.high else F.col(f"q{i}") for i, t in enumerate(targets)]
    step = len(probs)
    rows = [F.when(F.lit(targets[i].inside > 0), F.struct(F.lit(targets[i].value).alias("variable"), F.array(*q[i:i + step]).alias("q")))
            .otherwise(F.struct(F.lit(targets[i].value).alias("variable"), F.lit(None).cast("array<double>").alias("q")))
            for i in range(0, len(targets), step)]
    return one.select(F.inline(F.array(*rows)))


def _sorted(data: DataFrame, targets: list[_Target]) -> DataFrame:
    """The same for intervals that are known to hold few rows: one scan, each interval's values sorted in the aggregate."""
    aggs, out = [], []
    for i, t in enumerate(targets):
        if t.low == t.high:
            continue
        at = t.at - t.below
        inside = F.when(F.col(t.value).between(t.low, t.high), F.col(t.value))
        aggs.append(F.sort_array(F.collect_list(inside)).alias(f"_s{i}"))
        lo, hi = F.get(f"_s{i}", F.lit(math.floor(at))), F.get(f"_s{i}", F.lit(math.ceil(at)))
        out.append((lo + (hi - lo) * (at - math.floor(at))).alias(f"q{i}"))
    return data.agg(*aggs).select(*out)


def _search(data: DataFrame, targets: list[_Target], hits: list[Column]) -> DataFrame:
    """One row with the interpolated value of every target, from the sorted rows of the final intervals."""
    left = settle(data.select(F.inline(F.array_compact(F.array(*hits)))).groupBy("target", "x").agg(F.count("*").alias("n")))
    counts = cumulative(left, "x", ["target"])
    held = F.col("below") + F.col("n")
    aggs, out = [], []
    for i, t in enumerate(targets):
        if t.low == t.high:
            continue
        at = t.at - t.below
        for side, spot in (("lo", math.floor(at)), ("hi", math.ceil(at))):
            hit = (F.col("target") == i) & (F.col("below") <= spot) & (held > spot)
            aggs.append(F.max(F.when(hit, F.col("x"))).alias(f"{side}{i}"))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append((lo + (hi - lo) * (at - math.floor(at))).alias(f"q{i}"))
    return counts.agg(*aggs).select(*out)


def _round(data: DataFrame, live: list[_Target]) -> None:
    """Count below and inside each proposed interval, and take those that hold their target."""
    proposals = [t.proposal() for t in live]
    sketched = [t.grid is None or t.expected() > NARROW_ROWS for t in live]
    aggs = []
    for i, (t, (low, high)) in enumerate(zip(live, proposals)):
        x = F.col(t.value)
        inside = x.between(low, high)
        grid = _grid(F.when(inside, x), F.count_if(inside)) if sketched[i] else F.lit(None).cast("array<double>")
        aggs.append(F.struct(F.count_if(x < low).alias("below"), F.count_if(inside).alias("inside"),
                             grid.alias("grid")).alias(f"t{i}"))
    row = data.agg(*aggs).first()
    for i, (t, (low, high)) in enumerate(zip(live, proposals)):
        below, inside, grid = row[f"t{i}"]
        if not (below <= math.floor(t.at) and math.ceil(t.at) < below + inside):
            t.done = (low, high) == (t.low, t.high)
            t.margin *= 4
            continue
        stuck = t.grid is not None and (low, high) == (t.low, t.high)
        t.low, t.high, t.below, t.inside, t.grid, t.margin = low, high, below, inside, grid, 1
        t.done = stuck or inside <= NARROW_ROWS or low == high
