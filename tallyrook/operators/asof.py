"""What held at a time: of each request, the latest state of its key that is not later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the time is cut into, so that one key's rows may lie in as many tasks.
SLICES = 64


def as_of(requests: DataFrame, states: DataFrame, by: str, at: str, values: Sequence[str], tie: str | None = None, slices: int = SLICES) -> DataFrame:
    """The requests with the values of the latest state of the same key whose time isn't after theirs; null without one.

    Of states of one time the one with the largest tie counts. Requests without a key or time find nothing, nor do states without them count.
    Requests and states are put in one order and states carried forward; nothing is joined by time. A key's rows are cut by
    time as well: inside a part rows are carried, and what held at its begin follows from one row a part, so a key that has
    a third of all rows is spread over parts. Repeated requests are answered each.
    """
    clash = {*requests.columns} & {*values}
    if clash:
        raise ValueError(f"requests have columns of these names: {sorted(clash)}")
    timed = states.schema[at].dataType.typeName().startswith("timestamp")
    number = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)).cast("double")
    low, high = requests.select(number(at).alias("x")).unionByName(states.select(number(at).alias("x"))).agg(F.min("x"), F.max("x")).first()
    if low is None:
        return requests.select("*", *(F.lit(None).cast(states.schema[v].dataType).alias(v) for v in values))
    part = F.least(F.lit(slices - 1), F.floor((number(at) - low) / ((high - low) / slices or 1.0))).cast("int")
    key = [F.col(by).alias("_by"), F.col(at).alias("_at"), part.alias("_part")]
    order = F.col(tie) if tie else F.lit(0)
    state = F.struct(F.col(at).alias("_at"), order.alias("_tie"), *(F.col(v).alias(v) for v in values))
    known = states.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(*key, F.lit(0).alias("_kind"), order.alias("_order"), state.alias("_state"))
    asked = requests.select(*key, F.lit(1).alias("_kind"), F.struct(*requests.columns).alias("_row"))
    both = known.unionByName(asked, allowMissingColumns=True)
    before = lambda *cut: Window.partitionBy(*cut)
    inside = before("_by", "_part").orderBy("_at", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_found", F.last("_state", ignorenulls=True).over(inside)).where("_kind = 1")
    # one row for each part of a key
    ends = both.groupBy("_by", "_part").agg(F.max_by("_state", F.when(F.col("_state").isNotNull(), F.struct("_at", "_order"))).alias("_end"))
    earlier = before("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("_by", "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_begin"))
    rows = carried.join(begins, (carried["_by"] == begins["_by"]) & (carried["_part"] == begins["_part"]), "left")
    held = F.coalesce("_found", "_begin")
    fine: Column = F.col("_row")[by].isNotNull() & F.col("_row")[at].isNotNull()
    return rows.select("_row.*", *(F.when(fine, held[v]).alias(v) for v in values))
