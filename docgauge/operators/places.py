"""The rows at given places of many groups' orders, without sorting a group.

A group may hold most rows, so no window runs over raw rows.  All groups' places
are bracketed at once: approximate quantiles (which merge, and are taken in each
task first) give a grid of a group's values, and counts tell how many rows lie
below the bracket and in it.  Brackets with more than `RANKED` rows are bracketed
again among their own rows, from a short table that is set aside; only the last
brackets' different values, each with its count, are ranked.  Places within a value that many rows share are found the
same way among those rows, by the column that breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from docgauge.operators.tables import set_aside

#: Rows of a bracket that are ranked as they are; parts of the grid; rows of a table that is broadcast, after it was counted.
RANKED, GRID, BROADCAST_ROWS = 200_000, 100, 50_000


def _joined(rows: DataFrame, state: DataFrame, keys: list[str], small: bool, *more: Column) -> DataFrame:
    """`rows` beside their keys' rows of `state` (whose keys have `at_` before their names); null keys are keys."""
    on = [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in keys]
    return rows.join(F.broadcast(state) if small else state, on=[*on, *more], how="inner")


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, ranked: int = RANKED) -> DataFrame:
    """`wanted`: at_<key> for each key, pick, place (from 0), held (the key's rows) -> those with v, the value at the place, and before, the rows of the key with lesser values.

    Values may be of any type with an order; those that aren't numbers or times
    are ranked without brackets.  Null values count for nothing.
    """
    kind = rows.schema[value].dataType
    own = [f"at_{k}" for k in keys] + ["pick"]
    state = wanted.select(*own, "place", F.col("held").cast("long").alias("held"), F.lit(0).cast("long").alias("below"), F.lit(None).cast(kind).alias("lo"), F.lit(None).cast(kind).alias("hi"), F.lit(False).alias("done"))
    state = set_aside(state, "places")
    rows = rows.where(F.col(value).isNotNull()).select(*keys, value)
    v = F.col(value)
    small = state.count() <= BROADCAST_ROWS
    inside = (F.col("lo").isNull() | (v >= F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi")))
    while isinstance(kind, (NumericType, DateType, TimestampType)):
        open_ = state.where((F.col("held") > ranked) & ~F.col("done"))
        if open_.isEmpty():
            break
        grid = _joined(rows, open_, keys, small, inside).groupBy(*own).agg(F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], 10_000).alias("grid"))
        part = F.floor((F.col("place") - F.col("below")) / F.col("held") * GRID).cast("int")
        cell = lambda i: F.col("grid")[F.greatest(F.lit(0), F.least(F.lit(GRID), part + i))]
        tried = _same(open_, grid, own).withColumns({"lo2": cell(-1).cast(kind), "hi2": cell(2).cast(kind)}).drop("grid")
        tried = set_aside(tried, "places")
        counts = _joined(rows, tried, keys, small, inside).groupBy(*own).agg(F.count_if(v < F.col("lo2")).alias("less"), F.count_if((v >= F.col("lo2")) & (v <= F.col("hi2"))).alias("in2"))
        less = F.col("below") + F.col("less")
        good = (less <= F.col("place")) & (F.col("place") < less + F.col("in2"))
        # a bracket of one value, one that misses the place and one that isn't narrower end here
        new = _same(tried, counts, own).select(
            *own, "place", F.when(good, F.col("in2")).otherwise(F.col("held")).alias("held"), F.when(good, less).otherwise(F.col("below")).alias("below"),
            F.when(good, F.col("lo2")).otherwise(F.col("lo")).alias("lo"), F.when(good, F.col("hi2")).otherwise(F.col("hi")).alias("hi"), (~good | (F.col("lo2") == F.col("hi2")) | (F.col("in2") >= F.col("held"))).alias("done"),
        )
        state = set_aside(state.where((F.col("held") <= ranked) | F.col("done")).unionByName(new), "places")
    values = _joined(rows, state, keys, small, inside).groupBy(*own, "place", "below", v.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy(*own).orderBy("v"))
    found = values.withColumn("upto", upto).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("k")))
    return found.select(*own, "place", "v", (F.col("upto") - F.col("k")).alias("before"), "k")


def _same(a: DataFrame, b: DataFrame, own: list[str]) -> DataFrame:
    """Rows of `a` with those of `b` of the same keys and pick."""
    b = b.withColumnsRenamed({c: f"b_{c}" for c in own})
    return a.join(b, on=[F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in own]).drop(*(f"b_{c}" for c in own))


def at_places(df: DataFrame, by: list[str], order: Column, seq: str, places, ranked: int = RANKED) -> DataFrame:
    """Rows of `df` at places of their group's order by `order`, ties by `seq` (null first), with `pick`.

    `places(n)`: an array of (pick, i, there) from the column of a group's size.
    Of rows that are equal in group, order and seq, any stands for the place.
    """
    keys = [f"__k{i}" for i in range(max(1, len(by)))]
    kind = df.schema[seq].dataType
    # a null seq goes first: below every number, and alone where it isn't one
    tie = F.coalesce(F.col(seq), F.lit(-(1 << 63) if kind.typeName() == "long" else float("-inf")).cast(kind)) if isinstance(kind, NumericType) and kind.typeName() in ("long", "double") else F.col(seq)
    rows = df.withColumns({**{k: F.col(b) for k, b in zip(keys, by)}, **({} if by else {"__k0": F.lit(0)}), "__v": order, "__s": tie})
    sizes = rows.groupBy(*keys).agg(F.count("__v").alias("held"))
    wanted = sizes.select(*[F.col(k).alias(f"at_{k}") for k in keys], "held", F.explode(F.filter(places(F.col("held")), lambda p: p["there"])).alias("p"))
    wanted = wanted.select(*[f"at_{k}" for k in keys], F.col("p")["pick"].alias("pick"), F.col("p")["i"].alias("place"), "held")
    first = set_aside(order_statistics(rows, keys, "__v", wanted, ranked), "places")
    small = first.count() <= BROADCAST_ROWS
    ties = _joined(rows.select(*keys, "__v", "__s"), first, keys, small, F.col("__v") == F.col("v")).withColumn("__p", F.col("pick"))
    inner = [*keys, "__p"]
    again = first.select(*[f"at_{k}" for k in keys], F.col("pick").alias("at___p"), "pick", (F.col("place") - F.col("before")).alias("place"), F.col("k").alias("held"))
    second = order_statistics(ties.select(*inner, "__s"), inner, "__s", again, ranked)
    second = _same(first.select(*[f"at_{k}" for k in keys], "pick", F.col("v").alias("at_v")), second.select(*[f"at_{k}" for k in keys], "pick", F.col("v").alias("at_s")), [*(f"at_{k}" for k in keys), "pick"])
    out = _joined(rows, second, keys, small, (F.col("__v") == F.col("at_v")) & (F.col("__s") == F.col("at_s")))
    return out.dropDuplicates([*keys, "pick"]).select(*df.columns, "pick")
