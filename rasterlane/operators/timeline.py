"""When a change happened: the split of a sequence of captures that contradicts the fewest decided ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.functions import rules


def change_periods(states: DataFrame, key: list[str], order: list[str], date: str = "date", state: str = "state") -> DataFrame:
    """key, from, to of each sequence. states: rows in order, first false and last true; null states are undecided.

    The split stands between two decided rows; its cost is the number of true rows before and false rows after it, the latest of
    the cheapest is taken. Sequences are sorted once; costs are running sums inside them."""
    at = Window.partitionBy(*key).orderBy(*order)
    rows = states.where(F.col(state).isNotNull())
    before = at.rowsBetween(Window.unboundedPreceding, 0)
    true, false = F.when(F.col(state), 1).otherwise(0), F.when(F.col(state), 0).otherwise(1)
    every = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cost = F.sum(true).over(before) + F.sum(false).over(every) - F.sum(false).over(before)
    costed = rows.select(*key, F.col(date).alias("from"), F.lead(date).over(at).alias("to"), cost.alias("cost"), F.row_number().over(at).alias("seq"), F.lead(F.lit(1)).over(at).alias("more")).where("more = 1")
    best = F.max_by(F.struct("from", "to"), F.struct((-F.col("cost")).alias("gain"), "seq"))
    return costed.groupBy(*key).agg(best.alias("b")).select(*key, "b.from", "b.to")


def capture_states(objects: DataFrame, before: DataFrame, after: DataFrame, captures: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """scene, object, seq, state of every object in every capture: whether the capture's mask inside the object looks like after.

    objects: cells scene, object, r, c; before, after: cells scene, r, c; captures: cells scene, seq, r, c and, for captures without
    any cell, one row with null r; invalid: cells scene, seq, r, c without imagery: an object on one is undecided."""
    seqs = captures.select("scene", "seq").distinct()
    o = objects.select("scene", "object", "r", "c").distinct()
    flag = lambda d, name: d.select("scene", "r", "c").distinct().withColumn(name, F.lit(1))
    o = o.join(flag(before, "b"), ["scene", "r", "c"], "left").join(flag(after, "a"), ["scene", "r", "c"], "left")
    on = captures.where(F.col("r").isNotNull()).select("scene", "seq", "r", "c").distinct().withColumn("m", F.lit(1))
    cells = o.join(seqs, "scene").join(on, ["scene", "seq", "r", "c"], "left")
    if invalid is not None:
        cells = cells.join(invalid.select("scene", "seq", "r", "c").distinct().withColumn("bad", F.lit(1)), ["scene", "seq", "r", "c"], "left")
    else:
        cells = cells.withColumn("bad", F.lit(None).cast("int"))
    m, a, b = (F.coalesce(F.col(x), F.lit(0)) == 1 for x in "mab")
    n = cells.groupBy("scene", "object", "seq").agg(F.count_if(m & a).alias("ma"), F.count_if(m | a).alias("mua"), F.count_if(m & b).alias("mb"), F.count_if(m | b).alias("mub"), F.max("bad").alias("bad"))
    state = rules.decision(rules.iou(F.col("ma"), F.col("mua")), rules.iou(F.col("mb"), F.col("mub")))
    return n.select("scene", "object", "seq", F.when(F.col("bad").isNull(), state).alias("state"))


def with_ends(states: DataFrame, key: list[str], first: str, last: str) -> DataFrame:
    """key, g, date, state: the captures' rows between one of the first date (false) and one of the last (true)."""
    keys = states.select(*key).distinct()
    end = lambda g, date, value: keys.select(*key, F.lit(g).alias("g"), F.lit(None).cast("int").alias("seq"), F.lit(date).alias("date"), F.lit(value).alias("state"))
    return end(0, first, False).unionByName(states.select(*key, F.lit(1).alias("g"), F.col("seq").cast("int").alias("seq"), "date", "state")).unionByName(end(2, last, True))


def bars(summary: DataFrame) -> DataFrame:
    """summary's rows with total, whether they are the uncertain ones, and the total's share of the largest. The window sees a row
    per interval of dates."""
    total = sum(F.col(t) for t in rules.CHANGE_TYPES)
    told = summary.withColumn("total", total).where("total > 0")
    return told.select("from", "to", "total", F.col("from").isNull().alias("uncertain"), (F.col("total") / F.max("total").over(Window.partitionBy())).alias("share"))


def period_summary(periods: DataFrame, dates: DataFrame) -> DataFrame:
    """from, to, new, demolished, rebuilt of each interval between neighbouring dates that has changes; a last row with null from
    and to counts those whose period spans several. periods: type, from, to; dates: date."""
    step = dates.select("date").distinct()
    steps = step.select(F.col("date").alias("from"), F.lead("date").over(Window.orderBy("date")).alias("to")).where(F.col("to").isNotNull()).withColumn("known", F.lit(True))
    told = periods.where(F.col("type").isin(*rules.CHANGE_TYPES)).groupBy("from", "to", "type").agg(F.count("*").alias("n"))
    told = told.join(steps, ["from", "to"], "left")
    told = told.select(F.when(F.col("known"), F.col("from")).alias("from"), F.when(F.col("known"), F.col("to")).alias("to"), "type", "n")
    count = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(t)
    return told.groupBy("from", "to").agg(*[count(t) for t in rules.CHANGE_TYPES])
