"""Matching entities across sources without keys: MinHash blocking, pair features, a classifier on weak labels."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.plain import POI_TYPES, USABLE_LAT, USABLE_LON, plain
from ..operators import nearby
from ..session import cut

@dataclass
class Vocabulary:
    """What words of names mean, learnt from the records themselves: kinds they tell, long forms of short ones, parts of a site."""

    kinds: dict[str, str] = field(default_factory=dict)
    short: dict[str, str] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)


def repaired(lat: Column, lon: Column) -> Column:
    """Struct (lat, lon) of the place a damaged position describes; null if a part is null, NaN or zero or no reading fits.

    The larger of the two, by amount, is the longitude; it tells the power of ten by which both are scaled. Swapped parts
    and lost signs follow from the two ranges, which do not overlap.
    """
    a, b = F.abs(lat), F.abs(lon)
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(F.greatest(a, b) / abs(USABLE_LON[1]) * (1 + 1e-12)))))
    y, x = F.least(a, b) / scale, -F.greatest(a, b) / scale
    fits = (lat != 0) & (lon != 0) & ~F.isnan(lat) & ~F.isnan(lon) & y.between(*USABLE_LAT) & x.between(*USABLE_LON)
    return F.when(fits, F.struct(y.alias("lat"), x.alias("lon")))


def name_words(name: Column) -> Column:
    """Words of a name: lower case, possessives dropped, joined words split at a capital."""
    spaced = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(spaced), r"'s\b|’s\b", ""), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _lookup(table: dict[str, str], word: Column) -> Column:
    """What a word stands for in a table, null if it isn't there. A set is asked first, as maps are searched from end to end."""
    if not table:
        return F.lit(None).cast("string")
    return F.when(word.isin(*table), F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])[word])


def _shortens(a: str, b: str) -> bool:
    """Whether a word is another one with letters left out, from the same first letter."""
    rest = iter(b)
    return len(a) < len(b) and a[0] == b[0] and all(c in rest for c in a)


def learn_vocabulary(records: DataFrame, source: str, words: str, kind: str, at: str, most: int = 2_000, least: int = 10, purity: float = 0.9, votes: int = 3, share: float = 0.01) -> Vocabulary:
    """Learn from all records what the words of their names mean (``words``, an array, and ``at``, a struct lat and lon, may be empty and null); three aggregates, of which at most ``most`` rows each reach the driver.

    A word tells a kind if it occurs in at least ``least`` squares of a quarter degree and ``purity`` of its records of
    known type have one type. Names that are equal but for one word, within a square of some 300 m and for one kind, show
    what words are to each other. Where they are of different sources and one word is the other with letters left out,
    the rarer is a form of the more frequent; where they are of one source, which lists a place once, and unlike, they
    tell parts of a site apart, if that is so for a ``share`` of the word's records. Both need ``votes`` squares.
    """
    rows = records.select(F.col(words).alias("w"), F.col(source).alias("s"), F.col(kind).alias("t"), F.col(at).alias("p")).where("p is not null and size(w) > 0")
    rows = rows.select("w", "s", "t", F.floor(F.col("p.lat") * 4).alias("y4"), F.floor(F.col("p.lon") * 4).alias("x4"), F.floor(F.col("p.lat") * 333).alias("y"), F.floor(F.col("p.lon") * 250).alias("x"))
    seen = rows.where("t is not null").select(F.explode(F.array_distinct("w")).alias("word"), "t", "y4", "x4").groupBy("word", "t", "y4", "x4").agg(F.count(F.lit(1)).alias("n"))
    by_kind = seen.groupBy("word", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("squares"))
    told = by_kind.groupBy("word").agg(F.sum("n").alias("n"), F.max(F.struct("n", "t", "squares")).alias("top")).where((F.col("top.squares") >= least) & (F.col("top.n") >= purity * F.col("n")))
    kinds = {r["word"]: r["t"] for r in told.orderBy(F.desc("n"), "word").limit(most).select("word", "top.t").collect()}
    found = Vocabulary(kinds)
    told_kind, bare = _kind_told(F.col("w"), found), F.array_sort(F.filter("w", lambda w: _lookup(kinds, w).isNull()))
    named = rows.select(bare.alias("b"), F.coalesce(told_kind, "t").alias("k"), "s", "y", "x").where("k is not null and size(b) > 0")
    without = lambda i: F.filter("b", lambda w, j: j != i)
    each = F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.struct(F.get("b", i).alias("w"), F.array_join(without(i), " ").alias("rest")))
    loose = named.select("k", "s", "y", "x", F.inline(F.concat(each, F.array(F.struct(F.lit("").alias("w"), F.array_join("b", " ").alias("rest")))))).where("rest <> ''")
    apart = loose.groupBy("k", "y", "x", "rest").agg(F.min("w").alias("a"), F.max("w").alias("b"), (F.min("s") == F.max("s")).alias("one")).where("a <> b")
    pairs = apart.groupBy("a", "b", "one").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= votes)
    often = rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    for side in "ab":
        pairs = pairs.join(often.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
    pairs = pairs.orderBy(F.desc("n"), "a", "b").limit(most).collect()
    counts: dict[str, int] = {}
    apart_in_one: dict[str, int] = {}
    for r in pairs:
        (_, _, rare), (_, _, common) = sorted(((n or 0, len(w), w) for w, n in ((r["a"], r["n_a"]), (r["b"], r["n_b"]))))
        alike = bool(r["a"]) and (_shortens(r["a"], r["b"]) or _shortens(r["b"], r["a"]))
        if alike and not r["one"]:
            found.short.setdefault(rare, common)
        if r["one"] and not alike:
            for w, n in ((r["a"], r["n_a"]), (r["b"], r["n_b"])):
                if w:
                    counts[w], apart_in_one[w] = n, apart_in_one.get(w, 0) + r["n"]
    found.short = {w: c for w, c in found.short.items() if c not in found.short}
    found.parts = sorted({found.short.get(w, w) for w, n in apart_in_one.items() if n >= share * counts[w]})
    return found


def _kind_told(words: Column, vocabulary: Vocabulary) -> Column:
    """The kind told by the last word that tells one."""
    told = F.array_compact(F.transform(words, lambda w: _lookup(vocabulary.kinds, w)))
    return F.get(told, F.size(told) - 1)


def name_parts(words: Column, vocabulary: Vocabulary) -> Column:
    """Struct (kind, base, sorted, part): the kind the words of a name tell, the other words, the same sorted, and what tells parts of a site apart."""
    is_part = lambda w: w.rlike(r"^[0-9]+$") | w.isin(*(vocabulary.parts or [""]))
    tokens = F.transform(F.filter(words, lambda w: _lookup(vocabulary.kinds, w).isNull()), lambda w: F.coalesce(_lookup(vocabulary.short, w), w))
    rest = F.filter(tokens, lambda w: ~is_part(w))
    return F.struct(_kind_told(words, vocabulary).alias("kind"), F.array_join(rest, "").alias("base"), F.array_join(F.array_sort(rest), "").alias("sorted"), F.array_join(F.array_sort(F.filter(tokens, is_part)), " ").alias("part"))


def described(records: DataFrame, key: str, source: str, name: str, kind: str, confidence: str, lat: str, lon: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(key, source, kind, base, sorted, part, lat, lon) of the records that can be matched: those whose position can be read.

    The kind is what the name tells, else the type that nearly all (95 %) of the source's records have (one row a
    source, from an aggregate), else the record's known type unless its confidence is low, else null. The vocabulary of
    names is learnt from the records unless it is given. Names and positions are read once and written down for both.
    """
    at = repaired(F.col(lat), F.col(lon))
    rows = records.select(F.col(key).alias("key"), F.col(source).alias("source"), name_words(F.coalesce(F.col(name), F.lit(""))).alias("_words"), F.col(kind).alias("_type"), plain(F.col(confidence)).alias("_c"), at.alias("_at"))
    rows = cut(rows.where("_at is not null and source is not null and key is not null"))
    if vocabulary is None:
        vocabulary = learn_vocabulary(rows, "source", "_words", "_type", "_at")
    rows = rows.withColumn("_n", name_parts(F.col("_words"), vocabulary))
    usual = rows.where("_type is not null").groupBy("source", "_type").count()
    usual = usual.groupBy("source").agg(F.max_by("_type", F.struct("count", "_type")).alias("_usual"), (F.max("count") / F.sum("count")).alias("_share")).where("_share >= 0.95").select("source", "_usual")
    rows = rows.join(usual, "source", "left")
    sure = F.when(~F.col("_c").eqNullSafe("low"), F.col("_type"))
    return rows.select("key", "source", F.coalesce("_n.kind", "_usual", sure).alias("kind"), F.col("_n.base").alias("base"), F.col("_n.sorted").alias("sorted"), F.col("_n.part").alias("part"), F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"))


def _mix(x, seed: int):
    """64-bit mixing of an array of integers (uint64), one function for every seed."""
    import numpy as np

    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_tokens(lat, lon, radius_m: float, side_m: float):
    """Cells of a grid whose middle lies within the radius of each point: tokens (points x cells, uint64) and which of them count.

    Points a distance apart share the cells of the lens in which their circles overlap, so the Jaccard similarity of
    their token sets falls from 1 at one place to 0 at two radii. Cells stop at the 180th meridian.
    """
    import numpy as np

    high = math.degrees(side_m / geo.EARTH_M)
    reach = int(radius_m / side_m) + 1
    steps = np.arange(-reach, reach + 1)
    row = np.floor(lat / high).astype(np.int64)[:, None] + steps[None, :]
    up = (row + 0.5) * high - lat[:, None]
    wide = high / np.maximum(np.cos(np.radians(np.clip((row + 0.5) * high, -89.9, 89.9))), 1e-3)
    half = np.sqrt(np.maximum((radius_m / side_m) ** 2 - (up / high) ** 2, 0.0))
    x = lon[:, None] / wide
    col = np.floor(x).astype(np.int64)[:, :, None] + steps[None, None, :]
    inside = (np.abs(col + 0.5 - x[:, :, None]) <= half[:, :, None]) & (np.abs(up / high) <= radius_m / side_m)[:, :, None]
    token = _mix(row.astype(np.uint64), 1)[:, :, None] ^ col.astype(np.uint64)
    return token.reshape(len(lat), -1), inside.reshape(len(lat), -1)


def name_tokens(names: list[str]):
    """Three-letter shingles of each name, its ends marked, laid end to end: tokens (uint64) and where each name starts; names must not be empty."""
    import numpy as np

    padded = [f"\x02{n}\x03" for n in names]
    letters = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded])
    ends = np.cumsum(sizes)
    all_ = (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]
    keep = np.ones(len(all_), bool)
    keep[ends[:-1] - 1] = keep[ends[:-1] - 2] = False  # those that reach into the next name
    return all_[keep], np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


#: Records of one place lie within this of each other; names alone may bring records together over this and more.
REACH_M = 130.0
NAME_REACH_M = 400.0

#: Blocking: bands of the position, the circle and grid they are taken over, bands of name and wider position.
PLACE_BANDS, PLACE_RADIUS_M, PLACE_SIDE_M = 8, 320.0, 80.0
NAME_BANDS, NAME_RADIUS_M, NAME_SIDE_M = 4, 1000.0, 250.0


def signatures(lat, lon, names: list[str]):
    """Band hashes (uint64): of the position (records x PLACE_BANDS), and of name and position together (records x NAME_BANDS, 0 without a name).

    A band of the position is one MinHash of the cells around it. A band of the name is one MinHash of the name's
    shingles joined with one of the cells of a wider circle. Two records within ``REACH_M`` share at least one band
    but for a chance of 1 in 10,000 at the very edge of the reach, where the similarity is about 0.6.
    """
    import numpy as np

    near, inside = place_tokens(lat, lon, PLACE_RADIUS_M, PLACE_SIDE_M)
    most = np.uint64(2**64 - 1)
    place = np.stack([np.where(inside, _mix(near, 100 + b), most).min(1) for b in range(PLACE_BANDS)], 1)
    name = np.zeros((len(lat), NAME_BANDS), np.uint64)
    named = np.array([i for i, n in enumerate(names) if n], np.int64)
    if len(named):
        far, inside = place_tokens(lat[named], lon[named], NAME_RADIUS_M, NAME_SIDE_M)
        shingles, starts = name_tokens([names[i] for i in named])
        for b in range(NAME_BANDS):
            area = np.where(inside, _mix(far, 200 + b), most).min(1)
            name[named, b] = _mix(np.minimum.reduceat(_mix(shingles, 300 + b), starts) ^ (area >> np.uint64(1)), 400 + b) | np.uint64(1)
    return place, name


def banded(rows: DataFrame, kinds: int) -> DataFrame:
    """Every record once a band: band, kind, by_name and what the comparison needs (num, key, source, lat, lon).

    ``rows`` has num, key, source (a number), lat and lon in degrees, base, and kind as a number, null for unknown; a
    record of unknown kind is written under all of ``kinds`` numbers. One Arrow pass, vectorised over its batches: with
    built-in expressions it would be some hundred interpreted hashes a record.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lat, lon = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (3, 4))
            place, name = signatures(lat, lon, batch.column(5).to_pylist())
            place = _mix(place + np.arange(PLACE_BANDS, dtype=np.uint64), 500)
            who, which = np.nonzero(name)
            at = np.concatenate([np.repeat(np.arange(len(lat)), PLACE_BANDS), who])
            band = np.concatenate([place.ravel(), name[who, which]]).view(np.int64)
            by_name = np.concatenate([np.zeros(place.size, bool), np.ones(len(who), bool)])
            kind = batch.column(6).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            copies = np.where(kind[at] < 0, kinds, 1)
            each = np.repeat(np.arange(len(at)), copies)
            turn = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
            at, band, by_name = at[each], band[each], by_name[each]
            kind = np.where(kind[at] < 0, turn, kind[at]).astype(np.int32)
            rest = [batch.column(i).take(pa.array(at)) for i in (0, 1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(kind), pa.array(by_name), *rest], ["band", "kind", "by_name", "num", "key", "source", "lat", "lon"])

    return rows.select("num", "key", "source", "lat", "lon", "base", "kind").mapInArrow(run, "band long, kind int, by_name boolean, num long, key string, source long, lat double, lon double")


def candidates(rows: DataFrame, reach_m: float = REACH_M, name_reach_m: float = NAME_REACH_M, hot: int = 2048) -> DataFrame:
    """Candidate pairs (id_l, id_r, metres, by_name, c_l, c_r) of records of different sources, each once, the smaller key left.

    All blocks are bands of MinHash signatures, over the cells around a position and over the shingles of a name with
    the cells of a wider area (``signatures``); records must also agree in kind, and one of unknown kind meets those of
    every kind. Pairs of the first sort of band count up to ``reach_m``, of the second up to ``name_reach_m``. Only
    numbers and positions go through the join of the blocks; crowded blocks are split over tasks and compared in full,
    nothing is cut off. Attributes are attached to the pairs that are left.
    """
    rows = cut(rows.withColumn("num", F.monotonically_increasing_id()))
    code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(POI_TYPES)])
    placed = banded(rows.select("num", "key", F.xxhash64("source").alias("source"), "lat", "lon", "base", code.alias("kind")), len(POI_TYPES) + 1)
    block = ["band", "kind"]
    crowded = cut(nearby.crowded_blocks(placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")), block, "_n", "_n", hot))
    side = lambda s: placed.select(*block, *[F.col(c).alias(f"{c}_{s}") for c in ("by_name", "num", "key", "source", "lat", "lon")])
    met = nearby.join_blocks(side("l"), side("r"), block, "num_l", "num_r", hot, crowded).withColumn("by_name", F.col("by_name_l"))
    metres = geo.haversine_m(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))
    met = met.where((F.col("key_l") < F.col("key_r")) & (F.col("source_l") != F.col("source_r")))
    found = met.select("num_l", "num_r", metres.alias("metres"), "by_name").where(F.col("metres") <= F.when(F.col("by_name"), name_reach_m).otherwise(reach_m))
    pairs = found.groupBy("num_l", "num_r").agg(F.first("metres").alias("metres"), F.min("by_name").alias("by_name"))
    full = lambda s: rows.select(F.col("num").alias(f"num_{s}"), F.col("key").alias(f"id_{s}"), F.struct("source", "kind", "base", "sorted", "part").alias(f"c_{s}"))
    return pairs.join(full("l"), "num_l").join(full("r"), "num_r").select("id_l", "id_r", "metres", "by_name", "c_l", "c_r")


def _likeness(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def features(pairs: DataFrame) -> DataFrame:
    """Adds the features of each pair as columns f_*; all are built-in expressions over the pair and two windows."""
    a, b = F.col("c_l.base"), F.col("c_r.base")
    named = (a != "") & (b != "")
    short = F.least(F.length(a), F.length(b))
    stem = F.when(short >= 4, 1 - F.levenshtein(a.substr(F.lit(1), short), b.substr(F.lit(1), short)) / short).otherwise(0.0)
    name = F.greatest(_likeness(a, b), _likeness(F.col("c_l.sorted"), F.col("c_r.sorted")))
    pa, pb = F.col("c_l.part"), F.col("c_r.part")
    out = pairs.select(
        "id_l",
        "id_r",
        "metres",
        "by_name",
        F.col("c_l.source").alias("source_l"),
        F.col("c_r.source").alias("source_r"),
        F.when(named, name).otherwise(0.0).alias("f_name"),
        F.when(named, stem).otherwise(0.0).alias("f_stem"),
        F.when(named, 0.0).otherwise(1.0).alias("f_unnamed"),
        F.when(named & (pa == pb) & (pa != ""), 1.0).otherwise(0.0).alias("f_part_same"),
        F.when(named & (pa != pb) & (pa != "") & (pb != ""), 1.0).otherwise(0.0).alias("f_part_other"),
        F.when(named & ((pa == "") != (pb == "")), 1.0).otherwise(0.0).alias("f_part_one"),
        F.when(F.col("c_l.kind").isNull() | F.col("c_r.kind").isNull(), 1.0).otherwise(0.0).alias("f_kindless"),
    )
    # how much better the best rival of either record is: a rival is another candidate in the same other source
    worth = F.col("f_name") * 1.5 - F.col("metres") / 100.0 - F.col("f_part_other") - F.col("f_part_one") * 0.3
    out = out.withColumn("_worth", worth)
    for side, other in (("l", "r"), ("r", "l")):
        w = Window.partitionBy(f"id_{side}", f"source_{other}").orderBy(F.desc("_worth"), f"id_{other}").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        best, second = F.first("_worth").over(w), F.nth_value("_worth", 2).over(w)
        out = out.withColumn(f"f_lead_{side}", F.col("_worth") - F.when(F.col("_worth") < best, best).otherwise(F.coalesce(second, F.lit(-1.5))))
    return out.withColumn("f_near", F.col("metres") / 100.0).withColumn("f_lead", F.least("f_lead_l", "f_lead_r")).drop("_worth")

#: What the classifier sees of a pair.
TERMS = {
    "name": lambda c: c("f_name"),
    "stem": lambda c: c("f_stem"),
    "unnamed": lambda c: c("f_unnamed"),
    "part_same": lambda c: c("f_part_same"),
    "part_other": lambda c: c("f_part_other"),
    "part_one": lambda c: c("f_part_one"),
    "kindless": lambda c: c("f_kindless"),
    "near": lambda c: c("f_near"),
    "near2": lambda c: c("f_near") * c("f_near"),
    "name_near": lambda c: c("f_name") * c("f_near"),
    "unnamed_near": lambda c: c("f_unnamed") * c("f_near"),
    "name2": lambda c: c("f_name") * c("f_name"),
    "lead": lambda c: c("f_lead"),
    "one": lambda c: c("f_name") * 0 + 1,
}


def weak_labels(pairs: DataFrame, groups: DataFrame, group: str, key: str) -> DataFrame:
    """Adds ``label``: 1, 0 or null, from an older partial grouping and from what the attributes exclude.

    In one group: 1. In two groups, or one grouped and one not: 0. Otherwise 0 for names that tell different parts of
    one site and for records further apart than any place is wide; and 1 for like names close together.
    """
    known = groups.select(F.col(key).alias("_k"), F.col(group).alias("_g")).where("_k is not null and _g is not null").groupBy("_k").agg(F.min("_g").alias("_g"))
    out = pairs.join(known.select(F.col("_k").alias("id_l"), F.col("_g").alias("_gl")), "id_l", "left").join(known.select(F.col("_k").alias("id_r"), F.col("_g").alias("_gr")), "id_r", "left")
    label = (
        F.when(F.col("_gl") == F.col("_gr"), 1.0)
        .when(F.col("_gl").isNotNull() | F.col("_gr").isNotNull(), 0.0)
        .when((F.col("f_part_other") == 1) | (F.col("metres") > 105), 0.0)
        .when((F.col("f_name") >= 0.85) & (F.col("f_part_one") == 0) & (F.col("metres") <= 50), 1.0)
    )
    return out.withColumn("label", label).drop("_gl", "_gr")


def fit_logistic(x, y, ridge: float = 1e-3, rounds: int = 60):
    """Ridge-penalised logistic regression by damped Newton steps; numpy arrays in, coefficients out."""
    import numpy as np

    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + ridge * np.eye(len(b)), x.T @ (p - y) / len(y) + ridge * b)
        b = b - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Matcher:
    """Logistic classifier over TERMS with Platt calibration on held-out labels; scores as a Column expression."""

    def __init__(self, weights: dict[str, float], slope: float = 1.0, shift: float = 0.0):
        self.weights, self.slope, self.shift = weights, slope, shift

    @classmethod
    def fit(cls, labelled: DataFrame, sample: int = 20_000) -> Matcher:
        """``labelled`` has the features and label; at most ``sample`` pairs of each label, chosen by a hash of their ids, reach the driver.

        A quarter of them is held out for the calibration. With fewer than 20 pairs of either label the rules' own
        weights are used: like names, close together, no different parts.
        """
        import numpy as np

        needed = [c for c in labelled.columns if c.startswith("f_")]
        rows = labelled.where("label is not null").withColumn("_h", F.xxhash64("id_l", "id_r"))
        parts = [rows.where(F.col("label") == v).orderBy("_h").limit(sample).select("_h", "label", *needed).toPandas() for v in (0.0, 1.0)]
        if min(map(len, parts)) < 20:
            return cls({"name": 8.0, "unnamed": 6.5, "part_other": -8.0, "near": -5.0, "one": -2.0})
        h, y = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("_h", "label"))
        cols = {c: np.concatenate([p[c].to_numpy(float) for p in parts]) for c in needed}
        x = np.column_stack([term(cols.__getitem__) for term in TERMS.values()])
        held = h % 4 == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        b = fit_logistic(x[~held], y[~held])
        slope, shift = 1.0, 0.0
        if held.any():
            slope, shift = fit_logistic(np.column_stack([x[held] @ b, np.ones(held.sum())]), y[held])
        return cls(dict(zip(TERMS, map(float, b))), float(max(slope, 0.05)), float(shift))

    def confidence(self) -> Column:
        total = sum((term(F.col) * self.weights.get(n, 0.0) for n, term in TERMS.items()), F.lit(0.0))
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def matched(records: DataFrame, groups: DataFrame, group: str, key: str, sample: int = 20_000) -> DataFrame:
    """(id_l, id_r, metres, by_name, confidence) of every candidate pair of ``described`` records, the smaller key first.

    Records without a readable position take no part; names and kinds may be null; repeated keys must have been reduced
    before; an empty table gives no pairs.
    """
    pairs = cut(features(candidates(records)))
    model = Matcher.fit(weak_labels(pairs, groups, group, key), sample)
    return pairs.select("id_l", "id_r", "metres", "by_name", model.confidence().alias("confidence"))
