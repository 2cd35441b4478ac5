"""Place identity over time: evidence scores, mutual best matches, successors, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import base_name, normal_name
from ..session import cut
from . import nearby

#: Fixed values of the evidence score.
CEILING_M, NEAR_M = geo.METRES_PER_MILE, 50.0
NAME_EXACT, NAME_BASE, PRINT_FULL, PRINT_THIN, PRINT_CONFLICT, NEAR, ACCEPT, MARGIN = 2.0, 1.0, 2.0, 1.0, -3.0, 1.0, 2.5, 1.0


def fingerprint_score(old: list[Column], new: list[Column]) -> Column:
    """Shared facts (not null on both sides): any difference -3, two or more equal 2, one equal 1, none 0."""
    shared = sum(((a.isNotNull() & b.isNotNull()).cast("int") for a, b in zip(old, new)), F.lit(0))
    unlike = sum((F.coalesce(a != b, F.lit(False)).cast("int") for a, b in zip(old, new)), F.lit(0))
    return F.when(unlike > 0, PRINT_CONFLICT).when(shared >= 2, PRINT_FULL).when(shared == 1, PRINT_THIN).otherwise(0.0)


def name_score(old: Column, new: Column) -> Column:
    x, y, bx, by = normal_name(old), normal_name(new), base_name(old), base_name(new)
    return F.when((x != "") & (x == y), NAME_EXACT).when((bx != "") & (bx == by), NAME_BASE).otherwise(0.0)


def evidence_pairs(gone: DataFrame, fresh: DataFrame, key: str, kind: str, name: str, lat: str, lon: str, facts: list[str]) -> DataFrame:
    """(old, new, score) of every pair of one kind within a mile; blocked by kind and grid cell."""
    carry = (name, *facts)
    pairs = nearby.pairs_within(gone, fresh, key, key, lat, lon, CEILING_M * 1.01, by=(kind,), carry=carry)
    near = F.col("metres")
    score = name_score(F.col(f"c_l.{name}"), F.col(f"c_r.{name}")) + fingerprint_score([F.col(f"c_l.{f}") for f in facts], [F.col(f"c_r.{f}") for f in facts]) + F.when(near <= NEAR_M, NEAR).otherwise(0.0)
    return pairs.where(near <= CEILING_M).select(F.col("id_l").alias("old"), F.col("id_r").alias("new"), score.alias("score"))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs over the threshold that beat the runner-up of both sides by the margin; such a pair is the best of both."""
    out = pairs
    for side in ("old", "new"):
        w = Window.partitionBy(side).orderBy(F.desc("score"), F.asc("new" if side == "old" else "old"))
        out = out.withColumn(f"_rank_{side}", F.row_number().over(w)).withColumn(f"_next_{side}", F.lead("score").over(w))
    clear = lambda s: (F.col(f"_rank_{s}") == 1) & (F.col(f"_next_{s}").isNull() | (F.col("score") - F.col(f"_next_{s}") >= MARGIN))
    return out.where((F.col("score") >= ACCEPT) & clear("old") & clear("new")).select("old", "new", "score")


def successors(ledger: DataFrame, key: str, retired: str, superseded_by: str) -> DataFrame:
    """(key, live): the live id every id stands for today; null for dead ends, unknown successors and cycles.

    Pointers are doubled until none moves; a chain has no more steps than the ledger has rows, so cycles, which never
    land on a live row, end there too.
    """
    hop = cut(ledger.select(F.col(key).alias("_k"), F.when(F.coalesce(F.col(retired), F.lit(False)), F.col(superseded_by)).otherwise(F.col(key)).alias("_to")))
    for _ in range(hop.count().bit_length()):
        after = hop.select("_k", "_to").join(hop.select(F.col("_k").alias("_to"), F.col("_to").alias("_next")), "_to", "left")
        hop = cut(after.select("_k", F.col("_next").alias("_to"), (~F.col("_next").eqNullSafe(F.col("_to"))).alias("_moved")))
        if hop.where("_moved").isEmpty():
            break
    alive = ledger.where(~F.coalesce(F.col(retired), F.lit(False))).select(F.col(key).alias("_to"), F.lit(True).alias("_alive"))
    out = hop.select("_k", "_to").join(alive, "_to", "left")
    return out.select(F.col("_k").alias(key), F.when(F.col("_alive"), F.col("_to")).alias("live"))


def reconcile(ledger: DataFrame, records: DataFrame, key: str, kind: str, name: str, lat: str, lon: str, facts: list[str]) -> DataFrame:
    """(action, old, new) of a refresh: carry, held_moved (over a mile), held_type, match, retire, mint.

    Rows with the same key are carried unless they moved too far or changed kind; of the rest, evidence matches are
    accepted; what is left on the old side retires, on the new side is minted.
    """
    old = ledger.select(F.col(key).alias("old"), *[F.col(c).alias(f"o_{c}") for c in (kind, lat, lon)])
    new = records.select(F.col(key).alias("new"), *[F.col(c).alias(f"n_{c}") for c in (kind, lat, lon)])
    moved = F.coalesce(geo.flat_m(F.col(f"o_{lat}"), F.col(f"o_{lon}"), F.col(f"n_{lat}"), F.col(f"n_{lon}")) > CEILING_M, F.lit(False))
    same = old.join(new, F.col("old") == F.col("new")).select(F.when(moved, "held_moved").when(~F.col(f"o_{kind}").eqNullSafe(F.col(f"n_{kind}")), "held_type").otherwise("carry").alias("action"), "old", "new")
    gone = ledger.join(records.select(key), key, "left_anti")
    fresh = records.join(ledger.select(key), key, "left_anti")
    best = mutual_best(evidence_pairs(gone, fresh, key, kind, name, lat, lon, facts))
    match = best.select(F.lit("match").alias("action"), "old", "new")
    retire = gone.select(F.col(key).alias("old")).join(best, "old", "left_anti").select(F.lit("retire").alias("action"), "old", F.lit(None).cast("string").alias("new"))
    mint = fresh.select(F.col(key).alias("new")).join(best, "new", "left_anti").select(F.lit("mint").alias("action"), F.lit(None).cast("string").alias("old"), "new")
    return same.unionByName(match).unionByName(retire).unionByName(mint)


def mass_retirement(actions: DataFrame, least: int = 25, share: float = 0.20) -> DataFrame:
    """One row: retired, live, and whether the run is to be refused."""
    t = actions.agg(F.count(F.when(F.col("action") == "retire", 1)).alias("retired"), F.count("old").alias("live"))
    return t.withColumn("refused", (F.col("retired") >= least) & (F.col("retired") > F.col("live") * share))
