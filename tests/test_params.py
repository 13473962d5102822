import pytest

from catalign.operators import params as P
from catalign.operators import schema as S


def table(spark, rows, columns):
    schema = "row_id long, source_file string, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def facts(df):
    return {(r["col1"], r["col2"]): r for r in df.collect()}


def conflict_rows(both, clashes):
    return [("s", f"{i}", "x" if i < clashes else f"{i}") for i in range(both)]


@pytest.mark.parametrize("both,clashes,ok", [(10, 1, True), (10, 2, False), (30, 3, True), (31, 4, False)])
def test_ten_percent_of_conflicts_is_the_limit(spark, both, clashes, ok):
    row = P.compatibility(table(spark, conflict_rows(both, clashes), ["a", "b"]), ["a", "b"]).first()
    assert (row["overlap"], row["conflicts"], row["sources_different"]) == (both, clashes, False)
    assert row["compatible"] is ok and (row["reason"] == "") is ok


def test_sources_decide_when_values_conflict(spark):
    rows = [("s1", "1", "2"), ("s1", "1", "2"), ("s2", "1", None)]
    row = P.compatibility(table(spark, rows, ["a", "b"]), ["a", "b"]).first()
    assert row["sources_different"] and row["compatible"] and not row["non_conflicting"]


def test_never_filled_together_and_empty_columns(spark):
    df = table(spark, [("s", "1", None, None), ("s", None, "2", None)], ["a", "b", "c"])
    got = facts(P.compatibility(df, ["a", "b", "c"]))
    assert got["a", "b"]["compatible"] and got["a", "b"]["overlap"] == 0
    assert not got["a", "c"]["sources_different"] and got["a", "c"]["compatible"]
    assert len(got) == 3


def test_not_smart_accepts_all(spark):
    df = table(spark, conflict_rows(10, 9), ["a", "b"])
    row = P.compatibility(df, ["a", "b"], smart=False).first()
    assert row["compatible"] and row["overlap"] == 0 and row["total_rows"] == 10


def test_wide_and_row_wise_pair_counts_agree(spark):
    rows = [(f"s{i % 3}", *[f"{(i * k) % 4}" if (i + k) % 3 else None for k in range(5)]) for i in range(50)]
    columns = [f"c{k}" for k in range(5)]
    df = table(spark, rows, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    key = lambda d: sorted(map(tuple, d.select("col1", "col2", "overlap", "conflicts").collect()))
    assert key(P.pair_counts(df, columns)) == key(P.pair_counts(df, columns, pairs))


def test_report_takes_the_first_method_and_sorts(spark):
    columns = ["Weight (kg)", "(kg) Weight", "Weight", "Color", "Colour"]
    rows = [("s1", "1", None, None, "red", None), ("s2", None, "2", "2", None, "blue")]
    df = table(spark, rows, columns)
    got = P.similar_pairs(df, columns, token_sort=70, jaro_winkler=80).collect()
    assert [(r["col1"], r["col2"], r["method"]) for r in got][0] == ("Weight (kg)", "(kg) Weight", "token_sort")
    by = {(r["col1"], r["col2"]): r for r in got}
    assert by["Color", "Colour"]["method"] == "token_sort" and round(by["Color", "Colour"]["score"], 2) == 90.91
    assert by["Weight (kg)", "Weight"]["method"] == "token_sort" or by["Weight (kg)", "Weight"]["method"] == "jaro_winkler"
    assert by["Color", "Colour"]["potential"] == 2 and by["Color", "Colour"]["sources_different"]
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    loose = P.similar_pairs(df, columns, smart=False, token_sort=70).collect()
    assert {(r["col1"], r["col2"]) for r in loose} >= {("Color", "Colour")}


def test_embedding_scores_are_truncated(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.5]), ("c", [0.0, 1.0])], "text string, embedding array<double>")
    got = P.name_scores(spark, ["a", "b", "c"], token_sort=None, embedding=75, embed=lambda t: t.join(vectors, "text"))
    assert [tuple(r) for r in got.collect()] == [("a", "b", 89.0, "embedding")]


def test_merging(spark):
    df = table(spark, [("s", "1", None), ("s", None, "2"), ("s", "3", "4")], ["a", "b"])
    merged = P.merge_all(df, [("a", "b"), ("a", "b")])
    assert [r["a_b_merged"] for r in merged.orderBy("row_id").collect()] == ["1", "2", "3"]
    assert P.merge_all(merged, [("a", "b")]).columns == merged.columns
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "col1 string, col2 string")
    out, left = P.merge_pair(df, pairs, "a", "b", "new")
    assert "new" in out.columns and [tuple(r) for r in left.collect()] == [("b", "a")]
    with pytest.raises(ValueError):
        P.merge_pair(df, pairs, "a", "b", "a")
    assert tuple(P.merge_preview(df, "a", "b").first()) == (2, 2, 3)
    assert [tuple(r) for r in P.conflicts(df, "a", "b", ["row_id"]).collect()] == [(2, "3", "4", "3")]


def test_width_limits():
    with pytest.raises(ValueError):
        P.check_width([f"c{i}" for i in range(1001)])
    with pytest.raises(ValueError, match="465 pairs"):
        P.check_width([f"c{i}" for i in range(31)], confirmed=False)
    P.check_width([f"c{i}" for i in range(1000)])


def test_attributes_become_one_column(spark):
    df = table(spark, [("s", "1", None, "r"), ("t", None, "2", None)], ["w", "weight", "color"])
    pairs = spark.createDataFrame([("w", "weight")], "col1 string, col2 string")
    members = P.attribute_components(spark, ["w", "weight", "color"], pairs)
    out = P.harmonize_attributes(df, members, ["row_id"])
    assert out.columns == ["row_id", "w", "color"]
    assert [r["w"] for r in out.orderBy("row_id").collect()] == ["1", "2"]


def test_schema_helpers(spark):
    assert S.detect_roles([" Product Name ", "CAT", "код", "name"]) == {"product_name": "name", "category": "CAT", "SKU": "код"}
    assert S.attribute_columns(["Width", "Brand", "source_file", "Name", "Height"]) == ["Brand", "Height"]
    assert S.measurable_columns(["Unit Price", "group_name", "Power", "стоимость"]) == ["Power"]
    df = spark.createDataFrame([(" N/A ", "x", "NULL"), ("a", "", "n/a")], "`p.x` string, b string, c string")
    assert [tuple(r) for r in S.normalize_na(df).collect()] == [(None, "x", None), ("a", None, None)]
    unified = S.unify_schema(spark.createDataFrame([("n", "c")], "`Product Name` string, cat string"))
    assert unified.columns == ["product_name", "category", "SKU"] and unified.first()["SKU"] == "n"
    stacked = S.stack([unified, spark.createDataFrame([("z", 1)], "product_name string, extra int")])
    assert stacked.columns == ["product_name", "category", "SKU", "extra"]
    assert S.with_initial_group(spark.createDataFrame([("q",)], "first string")).first()["group_name"] == "q"
