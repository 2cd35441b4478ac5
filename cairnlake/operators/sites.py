"""Sites: members folded to the anchor they belong to, and what a site shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, normal_name
from ..session import cut
from . import nearby

#: Fixed values.
NAME_RADIUS_M, NEAR_RADIUS_M = 150.0, 60.0
MEMBER_TYPES = ("privy", "water", "campsite", "parking", "viewpoint")


def parents(members: DataFrame, anchors: DataFrame, key: str, name: str, lat: str, lon: str) -> DataFrame:
    """(member, anchor, metres): the best anchor of each member.

    Anchors of the same base name within 150 m come first, those whose whole name begins the member's name before the
    others, then by distance; without any, the nearest anchor within 60 m. Ties go to the smaller anchor id.
    """
    pairs = nearby.pairs_within(members, anchors, key, key, lat, lon, NAME_RADIUS_M, carry=(name,)).where("id_l <> id_r")
    m, a = F.col(f"c_l.{name}"), F.col(f"c_r.{name}")
    named = (base_name(m) != "") & (base_name(m) == base_name(a))
    contained = (normal_name(a) != "") & F.startswith(normal_name(m), normal_name(a))
    rank = F.when(named & contained, 0).when(named, 1).when(F.col("metres") <= NEAR_RADIUS_M, 2)
    ranked = pairs.select(F.col("id_l").alias("member"), F.struct(rank.alias("rank"), "metres", F.col("id_r").alias("anchor")).alias("c")).where("c.rank is not null")
    return ranked.groupBy("member").agg(F.min("c").alias("c")).select("member", "c.anchor", "c.metres")


def grouped(records: DataFrame, key: str, kind: str, name: str, lat: str, lon: str) -> DataFrame:
    """(member, anchor, metres) of two passes: to shelters first, then to campsites that aren't members themselves."""
    members = records.where(F.col(kind).isin(*MEMBER_TYPES))
    first = cut(parents(members, records.where(F.col(kind) == "shelter"), key, name, lat, lon))  # read three times below
    taken = first.select(F.col("member").alias(key))
    free = records.where(F.col(kind) == "campsite").join(taken, key, "left_anti")
    second = parents(members.join(taken, key, "left_anti").join(free.select(key), key, "left_anti"), free, key, name, lat, lon)
    return first.unionByName(second)


def roster(sites: DataFrame, kinds: DataFrame, key: str, kind: str, order: tuple[str, ...]) -> DataFrame:
    """Members of each site in their fixed order of kinds, then by id, with their place in it."""
    rows = sites.join(kinds.select(F.col(key).alias("member"), F.col(kind).alias("kind")), "member")
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(rank, "member")))
