"""Best representative of each duplicate group by skyline selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dominates(y: Column, x: Column) -> Column:
    """At least as complete, recent and trusted, and better in one of the three."""
    no_worse = (y["complete"] >= x["complete"]) & (y["recent"] >= x["recent"]) & (y["trust"] <= x["trust"])
    return no_worse & ((y["complete"] > x["complete"]) | (y["recent"] > x["recent"]) | (y["trust"] < x["trust"]))


def _layered(cells: Column) -> Column:
    """Each cell with its dominance layer: 1 for the skyline, else one more than the deepest cell above it.

    In the order of trust, recency and completeness every cell comes after all that dominate it, so one fold suffices.
    """
    ordered = F.array_sort(cells)
    empty = F.slice(F.transform(ordered, lambda c: F.struct(F.lit(1).alias("layer"), c.alias("cell"))), 1, 0)

    def add(done: Column, c: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: _dominates(d["cell"], c)), lambda d: d["layer"])
        return F.concat(done, F.array(F.struct((F.coalesce(F.array_max(above), F.lit(0)) + 1).alias("layer"), c.alias("cell"))))

    return F.aggregate(ordered, empty, add)


def survivors(members: DataFrame, group: str, key: str, trust: str, recency: str, fields: dict[str, Column], payload: list[str], least_members: int = 2) -> DataFrame:
    """One row per group with at least ``least_members`` distinct members.

    ``members`` has one row per group and member. *Order* is trust (low first, null last), then recency (late first,
    null last), then the smallest key. The survivor is the lexicographically first of the skyline over completeness
    (how many of ``fields`` are present), recency and trust: most complete, then by order. Each field is then filled from
    the successive dominance layers: the first layer that has a value supplies it, by its first member in order. A last
    check keeps to the stated order: a member of a deeper layer that stands before the supplier in order overrules it
    (``overruled`` counts the fields of a group for which that happened; a dominated member can be more trusted than an
    undominated one of another kind). Ties end at the smallest key.

    Members are first reduced to the best of each (group, trust, set of present fields): an aggregate with map-side
    combination whose result has at most (trust ranks + 1) x 2^fields rows a group, so a group of any size is safe.
    The number of trust ranks is that of the source table, not of the data. Null groups or keys are dropped; an empty
    table gives no rows.
    """
    names = list(fields)
    rows = members.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("_group"),
        F.coalesce(F.col(trust).cast("int"), F.lit(2**31 - 1)).alias("trust"),
        F.coalesce(-F.unix_micros(F.col(recency).cast("timestamp")), F.lit(2**62)).alias("late"),
        F.col(key).alias("key"),
        F.struct(*[F.col(c) for c in payload]).alias("row"),
        *[F.coalesce(c, F.lit(False)).alias(f"_has{i}") for i, c in enumerate(fields.values())],
    )
    has = [f"_has{i}" for i in range(len(names))]
    best = F.min_by(F.struct("late", "key", "row"), F.struct("late", "key"))
    cells = rows.groupBy("_group", "trust", *has).agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    complete = sum((F.col(h).cast("int") for h in has), F.lit(0))
    cell = F.struct("trust", F.col("_best.late").alias("late"), (-complete).alias("lacks"), F.col("_best.key").alias("key"), complete.alias("complete"), (-F.col("_best.late")).alias("recent"), *has, F.col("_best.row").alias("row"))
    grouped = cells.groupBy("_group").agg(F.collect_list(cell).alias("_cells"), F.sum("_n").alias("members")).where(F.col("members") >= least_members)
    layered = grouped.select("_group", "members", _layered(F.col("_cells")).alias("_layers"))
    skyline = F.transform(F.filter("_layers", lambda d: d["layer"] == 1), lambda d: d["cell"])
    chosen = F.array_min(F.transform(skyline, lambda c: F.struct(c["lacks"], c["trust"], c["late"], c["key"], c["row"])))

    def filled(i: int) -> Column:
        having = F.filter("_layers", lambda d: d["cell"][f"_has{i}"])
        return F.array_min(F.transform(having, lambda d: F.struct(d["layer"], d["cell"]["trust"], d["cell"]["late"], d["cell"]["key"], d["cell"]["row"])))

    def deeper(i: int) -> Column:
        """The first in order of the members below the layer that filled the field, if it stands before the supplier."""
        got = F.col(f"_fill{i}")
        place = lambda x: F.struct(x["trust"], x["late"], x["key"])
        below = F.filter("_layers", lambda d: d["cell"][f"_has{i}"] & (d["layer"] > got["layer"]) & (place(d["cell"]) < place(got)))
        return F.array_min(F.transform(below, lambda d: F.struct(d["cell"]["trust"], d["cell"]["late"], d["cell"]["key"], d["cell"]["row"])))

    out = layered.select(F.col("_group").alias(group), "members", F.size(skyline).alias("skyline"), F.array_max(F.transform("_layers", lambda d: d["layer"])).alias("layers"), chosen.alias("_chosen"), "_layers", *[filled(i).alias(f"_fill{i}") for i in range(len(names))])
    out = out.select("*", *[deeper(i).alias(f"_deep{i}") for i in range(len(names))])
    overruled = sum((F.col(f"_deep{i}").isNotNull().cast("int") for i in range(len(names))), F.lit(0))
    given = lambda i, part: F.coalesce(F.col(f"_deep{i}")[part], F.col(f"_fill{i}")[part])
    return out.select(group, "members", "skyline", "layers", overruled.alias("overruled"), F.col("_chosen.key").alias(key), F.col("_chosen.row").alias("row"), *[x for i, n in enumerate(names) for x in (given(i, "key").alias(f"{n}_from"), given(i, "row").alias(f"{n}_row"))])
