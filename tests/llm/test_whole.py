"""Records of unknown kind take part in all blocks of entity matching."""

from cairnlake.llm import matching


def test_unknown_kind_meets_like_names_beyond_the_grid(spark):
    at = lambda key, kind, metres: (key, f"s{key}", kind, "gravelspring", "gravelspring", "", 40.0 + metres / 111195.0, -80.0)
    rows = spark.createDataFrame([at("a", None, 0), at("b", "water", 200), at("c", None, 350), at("d", "shelter", 1000)], "key string, source string, kind string, base string, sorted string, part string, lat double, lon double")
    assert sorted((r["id_l"], r["id_r"]) for r in matching.candidates(rows).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
