"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import plain, plain_source, plain_source_id, usable_position
from ..plans import places
from ..session import table
from . import abuse, components, leaks, matching, survivors, tokens

#: Where vocabulary files lie; a parameter, never copied.
TOKENIZERS = os.environ.get("CAIRNLAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def _group_members(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "poi_groups").select(plain(F.col("group_id")).alias("group_id"), plain(F.col("poi_key")).alias("poi_key")).distinct()
    trust = table(spark, d, "poi_sources").select(plain_source(F.col("source")).alias("source"), "trust_rank")
    return members.join(places.current_places(spark, d), "poi_key").join(trust, "source", "left")


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    fields: dict[str, Column] = {
        "type": F.col("known_type").isNotNull(),
        "name": plain(F.col("name")) != "",
        "confidence": F.col("confidence").isNotNull(),
        "place": usable_position(F.col("latitude"), F.col("longitude")),
    }
    payload = ["source", "source_id", "known_type", "name", "confidence", "latitude", "longitude"]
    return survivors.survivors(_group_members(spark, d), "group_id", "poi_key", "trust_rank", "loaded_at", fields, payload)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    key = lambda f: F.coalesce(f"{f}_from", F.lit("")).alias(f"{f}_key")
    return _survivors(spark, d).select("group_id", "poi_key", key("type"), key("name"), key("place"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, built field by field."""
    s = _survivors(spark, d)
    return s.select("group_id", "poi_key", "members", F.col("row.source").alias("source"), F.col("type_row.known_type").alias("poi_type"), F.col("name_row.name").alias("name"), F.col("confidence_row.confidence").alias("confidence"), F.col("place_row.latitude").alias("latitude"), F.col("place_row.longitude").alias("longitude"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    records = matching.described(places.current_places(spark, d), "poi_key", "source", "name", "known_type", "confidence", "latitude", "longitude")
    groups = table(spark, d, "poi_groups").select(plain(F.col("group_id")).alias("group_id"), plain(F.col("poi_key")).alias("poi_key"))
    return matching.matched(records, groups, "group_id", "poi_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).where("confidence >= 0.5").select(F.col("id_l").alias("poi_key_a"), F.col("id_r").alias("poi_key_b"))


def p3_scored(spark: SparkSession, d: str) -> DataFrame:
    """All candidate pairs with their distance and calibrated confidence."""
    return _matches(spark, d).select(F.col("id_l").alias("poi_key_a"), F.col("id_r").alias("poi_key_b"), F.round("metres", 1).alias("metres"), F.round("confidence", 4).alias("confidence"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "poi_pairs").where(plain(F.col("verdict")) == "match")
    known = table(spark, d, "dim_pois").select(plain_source(F.col("source")).alias("s"), plain_source_id(F.col("source_id")).alias("i"), plain(F.col("poi_key")).alias("k")).distinct()
    sides = {x: (plain(F.col(f"poi_key_{x}")), plain_source(F.col(f"source_{x}")), plain_source_id(F.col(f"source_id_{x}"))) for x in "ab"}
    out = pairs.select(*[c.alias(f"{n}{x}") for x, cs in sides.items() for n, c in zip("ksi", cs)])
    for x in "ab":  # only rows without a key are looked up; the others pass by
        lacking = out.where(f"k{x} is null")
        found = lacking.drop(f"k{x}").join(known.select(F.col("s").alias(f"s{x}"), F.col("i").alias(f"i{x}"), F.col("k").alias(f"k{x}")), [f"s{x}", f"i{x}"])
        out = out.where(f"k{x} is not null").unionByName(found)
    return out.select("ka", "kb")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.linked_groups(_links(spark, d), "ka", "kb").select(F.col("v").alias("poi_key"), F.col("root").alias("group_key"))


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_found(spark, d).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_records"))
    return sizes.groupBy("n_records").agg(F.count(F.lit(1)).alias("n_groups"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text", VOCABULARY)


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by source."""
    docs = table(spark, d, "documents")
    ids = tokens.encode_corpus(docs, "doc_id", "text", VOCABULARY).select("doc_id", F.size("ids").alias("n"))
    return ids.join(docs.select("doc_id", plain_source(F.col("source")).alias("source")), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", ["question", "answer"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("part = 'question'").select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked passage with its place in the original text."""
    return _leaks(spark, d)


#: Documents of at least this score are reported.
ABUSE_SCORE = 0.3


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"), "doc_id", "text", "label")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= ABUSE_SCORE).select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, abusive documents and their share by source in plain form."""
    scores = _scores(spark, d).groupBy("doc_id").agg(F.max("score").alias("score"))
    docs = table(spark, d, "documents").select("doc_id", plain_source(F.col("source")).alias("source"))
    bad = F.coalesce((F.col("score") >= ABUSE_SCORE).cast("long"), F.lit(0))
    rates = docs.join(scores, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(bad).alias("n_abusive"))
    return rates.withColumn("rate", F.round(F.col("n_abusive") / F.col("n_documents"), 6))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_scored, p5_found, p5_sizes, p8_ids, p8_lengths, p9_found, p9_passages, p10_found, p10_rates)}

_S = places._SQL_SOURCE
_I = places._SQL_SOURCE_ID
_P = places._SQL_PLAIN.format

_MEMBERS = f"""known as (
  select * from (select {_P("poi_key")} as poi_key, {_S} as source, {_P("poi_type")} as t, name, confidence, latitude, longitude, loaded_at,
    row_number() over (partition by {_P("poi_key")} order by loaded_at desc) as rn from dim_pois) where rn = 1),
members as (
  select g.group_id, k.*, coalesce(s.trust_rank, 2147483647) as trust, k.t in ({places._SQL_WORDS}) is true as has_type, {_P("name")} <> '' is true as has_name, confidence is not null as has_conf,
    (latitude between 33 and 48 and longitude between -86 and -66) is true as has_place
  from (select distinct {_P("group_id")} as group_id, {_P("poi_key")} as poi_key from poi_groups) g join known k using (poi_key) left join poi_sources s on s.source = k.source),
ranked as (
  select *, row_number() over (partition by group_id order by has_type::int + has_name::int + has_conf::int + has_place::int desc, trust, loaded_at desc, poi_key) as best,
    row_number() over (partition by group_id order by trust, loaded_at desc, poi_key) as o, count(*) over (partition by group_id) as members from members)"""

_LINKS = f"""known as (select distinct {_S} as s, {_I} as i, {_P("poi_key")} as k from dim_pois),
links as (
  select distinct coalesce({_P("poi_key_a")}, a.k) as ka, coalesce({_P("poi_key_b")}, b.k) as kb from poi_pairs
  left join known a on poi_key_a is null and a.s = {_S.replace("(source,", "(source_a,")} and a.i = {_I.replace("(source_id,", "(source_id_a,")}
  left join known b on poi_key_b is null and b.s = {_S.replace("(source,", "(source_b,")} and b.i = {_I.replace("(source_id,", "(source_id_b,")}
  where {_P("verdict")} = 'match'),
edges as (select ka as a, kb as b from links where ka <> kb union select kb, ka from links where ka <> kb),
reach(v, w) as (select a, a from edges union select reach.v, edges.b from reach join edges on reach.w = edges.a),
groups as (select v as poi_key, min(w) as group_key from reach group by v)"""

SQL = {
    "p2_found": f"""with {_MEMBERS} select group_id, max(case when best = 1 then poi_key end) as poi_key, coalesce(arg_min(case when has_type then poi_key end, case when has_type then o end), '') as type_key,
  coalesce(arg_min(case when has_name then poi_key end, case when has_name then o end), '') as name_key, coalesce(arg_min(case when has_place then poi_key end, case when has_place then o end), '') as place_key
from ranked where members >= 2 group by group_id""",
    "p2_records": f"""with {_MEMBERS} select group_id, max(case when best = 1 then poi_key end) as poi_key, max(members) as members, max(case when best = 1 then source end) as source,
  arg_min(case when has_type then t end, case when has_type then o end) as poi_type, arg_min(case when has_name then name end, case when has_name then o end) as name, arg_min(confidence, case when has_conf then o end) as confidence,
  arg_min(latitude, case when has_place then o end) as latitude, arg_min(longitude, case when has_place then o end) as longitude
from ranked where members >= 2 group by group_id""",
    "p5_found": f"with recursive {_LINKS} select poi_key, group_key from groups",
    "p5_sizes": f"with recursive {_LINKS}, sizes as (select group_key, count(*) as n_records from groups group by 1) select n_records, count(*) as n_groups from sizes group by 1",
    "p9_found": r"""with words as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents where text is not null),
q as (select item_id, list_transform(regexp_extract_all(question, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from eval_items),
qw as (select item_id, array_to_string(list_slice(w, i, i + 12), ' ') as passage from (select item_id, w, unnest(range(1, len(w) - 11)) as i from q)),
dw as (select doc_id, array_to_string(list_slice(w, i, i + 12), ' ') as passage from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13))
select distinct doc_id, item_id from dw join qw using (passage)""",
}
