"""Column-level quality profile from character-class masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def mask(value: Column, keep_length: bool = True) -> Column:
    """Generalise a value to character classes: A upper, a lower, 9 digit, _ blank, u any other letter; the rest stays.

    Without ``keep_length`` runs of a class become one character.
    """
    out = F.regexp_replace(value, r"\p{Lu}", "A")
    out = F.regexp_replace(out, r"\p{Ll}", "a")
    out = F.regexp_replace(out, r"(?![Aa])\p{L}", "u")
    out = F.regexp_replace(out, r"\p{N}", "9")
    out = F.regexp_replace(out, r"\s", "_")
    return out if keep_length else F.regexp_replace(out, r"(.)\1+", "$1")


def number_mask(value: Column) -> Column:
    """Mask of a number: sign and digits before the point ('-99', '9'); 'nan' for no number, 'inf' without bound."""
    whole = F.floor(F.abs(value)).cast("decimal(38,0)").cast("string")
    return F.when(F.isnan(value), F.lit("nan")).when(F.abs(value) >= 1e18, F.lit("inf")).otherwise(F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(whole, "[0-9]", "9")))


def cells(df: DataFrame, keys: list[str], words: dict[str, tuple[str, ...]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Unpivot the profiled columns: keys, field, mask, word, number, bad.

    ``bad`` is the exact rule: not null and not one of the accepted words as written, or outside the closed range (NaN
    is outside). ``word`` is the accepted word, else null.
    """
    parts = []
    for name, accepted in words.items():
        value = F.col(name)
        fits = value.isin(*accepted)
        parts.append(F.struct(F.lit(name).alias("field"), mask(value).alias("mask"), F.when(fits, value).alias("word"), F.lit(None).cast("double").alias("number"), F.coalesce(~fits, F.lit(False)).alias("bad")))
    for name, (low, high) in ranges.items():
        value = F.col(name).cast("double")
        parts.append(F.struct(F.lit(name).alias("field"), number_mask(value).alias("mask"), F.lit(None).cast("string").alias("word"), value.alias("number"), F.coalesce((value < low) | (value > high) | F.isnan(value), F.lit(False)).alias("bad")))
    return df.select(*keys, F.inline(F.array(*parts)))


def mask_dictionary(cell: DataFrame, load: str) -> DataFrame:
    """Counts by load, field, mask and accepted word: the one shuffle of the profile, combined on the map side.

    A null value has a null mask. ``n_bad`` counts rows that break the exact rule.
    """
    return cell.groupBy(load, "field", "mask", "word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.min("number").alias("low"), F.max("number").alias("high"))


def mined_masks(dictionary: DataFrame, dominant_share: float) -> DataFrame:
    """Per field and mask over all loads: rows, share of the non-null values, whether it is a dominant pattern, rows that break the rule."""
    masks = dictionary.where("mask is not null").groupBy("field", "mask").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("field"))
    return masks.select("field", "mask", "n", "n_bad", share.alias("share"), (share >= dominant_share).alias("dominant"))


def mined_patterns(dictionary: DataFrame, dominant_share: float) -> DataFrame:
    """Patterns of every field over all loads, and which of them are suspect.

    A pattern is a mask, and where the values are accepted words the word itself, as a mask such as ``aaaaa`` may
    generalise an accepted word and any other of its length. ``state`` is what the rule says of the pattern's values:
    clean, broken (all of them) or mixed. Suspect are the rare patterns (under ``dominant_share`` of the field's values)
    and those that are not clean.
    """
    found = dictionary.where("mask is not null").groupBy("field", "mask", "word").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("field"))
    state = F.when(F.col("n_bad") == 0, "clean").when(F.col("n_bad") == F.col("n"), "broken").otherwise("mixed")
    out = found.select("field", "mask", "word", "n", "n_bad", share.alias("share"), state.alias("state"))
    return out.withColumn("suspect", (F.col("share") < dominant_share) | (F.col("state") != "clean"))


def violations(cell: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the suspect patterns that violate: all rows of a broken pattern; of the others those the exact rule, last, does not clear.

    The pattern table may have many rows for free text, so the join is left to the planner (a hash join by size, or a
    sort-merge join with skew handling), not forced to be broadcast.
    """
    suspect = patterns.where("suspect").select("field", "mask", F.coalesce("word", F.lit("")).alias("_word"), "state")
    met = cell.withColumn("_word", F.coalesce("word", F.lit(""))).join(suspect, ["field", "mask", "_word"])
    return met.where((F.col("state") == "broken") | ((F.col("state") == "mixed") & F.col("bad"))).select(*keys, "field", "mask", "state")


def pattern_divergence(dictionary: DataFrame, load: str) -> DataFrame:
    """(load, field, of_all, of_values): how far the distribution of patterns moved from the load before, as total variation.

    ``of_all`` counts null as a pattern, ``of_values`` looks at non-null values only. No share of any set of patterns
    moved further. Loads without one before them have no row; a field without values in either has a null ``of_values``.
    """
    value = F.col("mask").isNotNull()
    total = dictionary.groupBy(load, "field").agg(F.sum("n").alias("_all"), F.sum(F.when(value, F.col("n"))).alias("_held"))
    shares = dictionary.join(total, [load, "field"]).select(load, "field", "mask", "word", (F.col("n") / F.col("_all")).alias("_p"), F.when(value, F.col("n") / F.col("_held")).alias("_q"), F.lit(1).alias("_now"), F.lit(0).alias("_was"))
    moved = shares.select((F.col(load) + 1).alias(load), "field", "mask", "word", (-F.col("_p")).alias("_p"), (-F.col("_q")).alias("_q"), F.lit(0).alias("_now"), F.lit(1).alias("_was"))
    each = shares.unionByName(moved).groupBy(load, "field", "mask", "word").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), F.max("_now").alias("_now"), F.max("_was").alias("_was"))
    out = each.groupBy(load, "field").agg((F.sum(F.abs("_p")) / 2).alias("of_all"), (F.sum(F.abs("_q")) / 2).alias("of_values"), F.max("_now").alias("_now"), F.max("_was").alias("_was"))
    return out.where("_now = 1 and _was = 1").select(load, "field", "of_all", "of_values")


def column_shares(dictionary: DataFrame, load: str) -> DataFrame:
    """Rows, nulls and null share of every field in every load."""
    out = dictionary.groupBy(load, "field").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("mask").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum("n_bad").alias("n_bad"), F.countDistinct("mask").alias("n_masks"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return out.withColumn("null_share", F.col("n_null") / F.col("n_rows"))


def against_load_before(df: DataFrame, load: str, by: list[str], value: str) -> DataFrame:
    """Adds ``before``: the value in load - 1, null if that load is absent. The frame is one row per load and ``by``."""
    w = Window.partitionBy(*by).orderBy(load)
    return df.withColumn("before", F.when(F.lag(load).over(w) == F.col(load) - 1, F.lag(value).over(w)))


def shares_of(dictionary: DataFrame, load: str, item: str, where: str) -> DataFrame:
    """Share of each item among the non-null values of its field, for every load in which the field has rows; 0 where an item is missing."""
    by_load = dictionary.where("mask is not null").groupBy(load, "field").agg(F.sum("n").alias("total"))
    items = dictionary.where(where).select("field", item).distinct()
    counts = dictionary.where(where).groupBy(load, "field", item).agg(F.sum("n").alias("n"))
    full = by_load.join(items, "field").join(counts, [load, "field", item], "left")
    return full.select(load, "field", item, (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def mask_divergence(dictionary: DataFrame, load: str) -> DataFrame:
    """Total variation distance between the mask distributions of a load and of the load before, per field."""
    shares = against_load_before(shares_of(dictionary, load, "mask", "mask is not null"), load, ["field", "mask"], "share")
    return shares.where("before is not null").groupBy(load, "field").agg((F.sum(F.abs(F.col("share") - F.col("before"))) / 2).alias("divergence"))


def quality_findings(df: DataFrame, load: str, key: str, words: dict[str, tuple[str, ...]], ranges: dict[str, tuple[float, float]], shift: float = 0.10, dominant_share: float = 0.05) -> DataFrame:
    """Findings (load, field_name, finding, key), distinct: bad_value, null_shift and share_shift.

    The table is read once for the dictionary of masks, which is written down, and once for the rows of suspect patterns.
    A bad value is found through its pattern; shifts are looked for in the loads and fields whose patterns diverge from
    the load before by more than ``shift``, as no share can move further than they do. The exact rules (the words and
    ranges, the share of nulls, the share of each word) come last and only remove. Repeated rows and repeated keys give
    one finding. Null keys come out as ''. Empty tables give no finding. Extra columns are ignored.
    """
    kept = df.select(F.col(load).cast("int").alias("_load"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), *words, *ranges)
    cell = cells(kept, ["_load", "_key"], words, ranges)
    counted = cut(mask_dictionary(cell, "_load"))
    bad = violations(cell, mined_patterns(counted, dominant_share), ["_load", "_key"]).select("_load", "field", F.lit("bad_value").alias("finding"), "_key")
    apart = cut(pattern_divergence(counted, "_load"))
    far = lambda c: apart.where(F.col(c) > shift - 1e-9).select("_load", "field")
    nulls = against_load_before(column_shares(counted, "_load"), "_load", ["field"], "null_share").join(far("of_all"), ["_load", "field"]).where(F.abs(F.col("null_share") - F.col("before")) > shift)
    moved = against_load_before(shares_of(counted, "_load", "word", "word is not null"), "_load", ["field", "word"], "share").join(far("of_values"), ["_load", "field"]).where(F.abs(F.col("share") - F.col("before")) > shift)
    found = bad.unionByName(nulls.select("_load", "field", F.lit("null_shift").alias("finding"), F.lit("").alias("_key"))).unionByName(moved.select("_load", "field", F.lit("share_shift").alias("finding"), F.lit("").alias("_key")))
    return found.distinct().select(F.col("_load").alias(load), F.col("field").alias("field_name"), "finding", F.col("_key").alias(key))
