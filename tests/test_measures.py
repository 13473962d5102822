import random

import pytest
from pyspark.sql import functions as F

from catalign.constants import UNIT_RULES
from catalign.functions import measures as M
from catalign.operators import profile as N
from catalign.operators import standardize as V
from catalign.operators import unit_expressions as X
from catalign.operators import units as U
from catalign.runtime import with_parsed

COLUMN_ROWS = [
    ("my laptop", "Box dimension", "mm"), ("my laptop", "Screen", "inch"), ("my laptop", "Screen resolution", "pixel"),
    ("PC", "Weight", "kg"), ("notebook", "RAM", "GB"), ("смартфон", "length", "mm"), ("mobile", "Display", "inch"),
    ("mobile", "Resolution", "pixel"), ("mobile", "Weight", "g"), ("tv", "Size", "inch"), ("tv", "Resolution", "pixel"),
    ("tv", "Height", "mm"), ("oven", "Height", "cm"), ("oven", "Weight", "kg"), ("oven", "Power", "W"),
    ("vehicle", "Length", "m"), ("cartridge", "Engine", "kW"), ("thing", "sensor 1920x1080", "pixel"), ("thing", "дюйм", "inch"),
    ("tablet", "вес", "g"), ("thing", "weight", "kg"), ("thing", "watt", "W"), ("thing", "ssd", "GB"),
    ("tablet", "width", "mm"), ("монитор", "length", "cm"), ("thing", "length", "m"), ("thing", "color", None),
]


def test_every_rule_for_columns_and_for_literal_names(spark):
    df = spark.createDataFrame([(p, c) for p, c, _ in COLUMN_ROWS], "product string, name string")
    got = [r[0] for r in df.select(M.rule_unit(F.col("name"), F.col("product"))).collect()]
    assert got == [u for _, _, u in COLUMN_ROWS]
    literal = [spark.range(1).select(M.rule_unit(c, F.lit(p))).first()[0] for p, c, _ in COLUMN_ROWS]
    assert literal == got and len(UNIT_RULES) == 26


def test_whole_words_do_not_match_inside_others(spark):
    df = spark.createDataFrame([("cartridge", "Engine"), ("car", "Engine")], "p string, c string")
    assert [r[0] for r in df.select(M.rule_unit(F.col("c"), F.col("p"), whole_word=True)).collect()] == [None, "kW"]


@pytest.mark.parametrize(
    "name,unit",
    [("Weight (kg)", "kg"), ("max power - kWatt", "kwatt"), ("Price (USD)", None), ("Power Usage (W)", "W"), ("диагональ", "inch"), ("x m", None)],
)
def test_context_unit(spark, name, unit):
    assert spark.range(1).select(M.context_unit(name)).first()[0] == unit
    assert spark.createDataFrame([(name,)], "n string").select(M.context_unit(F.col("n"))).first()[0] == unit


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


def test_unit_validation(spark):
    exact = one(spark, " KG ", M.validate_unit)
    assert (exact["canonical"], exact["how"]) == ("kilogram", "exact")
    plural, fuzzy = (one(spark, t, M.validate_unit) for t in ("kilograms", "kilogramm"))
    assert (plural["canonical"], plural["how"]) == ("kilogram", "exact")
    assert (fuzzy["canonical"], fuzzy["how"]) == ("kilogram", "fuzzy")
    for word in ("example", "minor", "format", "two watts"):
        assert one(spark, word, M.validate_unit) is None
    assert [one(spark, t, M.validate_unit)["canonical"] for t in ("mW", "MW", "Mb", "MB")] == [
        "milliwatt", "megawatt", "megabit", "megabyte"
    ]
    assert one(spark, "??", M.validate_unit) is None and one(spark, "q", M.validate_unit) is None


def test_number_unit_pairs(spark):
    assert [tuple(p) for p in one(spark, "140x240x310", N.number_unit_pairs)] == [("140", "x"), ("240", "x"), ("310", "")]
    assert [tuple(p) for p in one(spark, "0.5 kW", N.number_unit_pairs)] == [("0.5", "kW")]


def test_extractions(spark):
    found = one(spark, "weighs 2.5 KG or 3 foobar, 0 kg", M.all_extractions)
    assert [(e["number"], e["unit"], e["confidence"], e["method"]) for e in found] == [
        ("2.5", "kilogram", 0.95, "quantity_known"),
        ("3", "foobar", 0.8, "quantity"),
        ("2.5", "kg or", 0.4, "pattern"),
        ("3", "foobar", 0.4, "pattern"),
        ("0", "kilogram", 0.9, "pattern_known"),
    ]


@pytest.mark.parametrize(
    "value,unit,simple,best",
    [
        ("60W", None, "60 W", "60 watt"),
        ("140", "mm", "140 mm", "140 mm"),
        ("140", None, "140", "140"),
        ("none", "mm", "none", "none"),
        (None, "mm", None, None),
        (" 0.5 kW extra", "mm", "0.5 kW extra", "0.5 kilowatt"),
        ("12 zzq", "mm", "12 zzq", "12 zzq"),
    ],
)
def test_standardize_value(spark, value, unit, simple, best):
    fallback = F.lit(unit).cast("string")
    assert one(spark, value, lambda v: M.standardize_simple(v, fallback)) == simple
    assert one(spark, value, lambda v: M.standardize_best(v, fallback)) == best


def test_unit_first_format_and_idempotence(spark):
    assert one(spark, "60W", lambda v: M.standardize_simple(v, F.lit(None).cast("string"), "unit_number")) == "W 60"
    again = lambda v: M.standardize_simple(M.standardize_simple(v, F.lit("mm")), F.lit("mm"))
    for text in ("60W", "140", "0.5 kW"):
        assert one(spark, text, again) == one(spark, text, lambda v: M.standardize_simple(v, F.lit("mm")))


def test_conversion(spark):
    got = one(spark, "0.5 kW", M.converted)
    assert (got["amount"], got["base_unit"], got["dimension"]) == (500.0, "watt", "power")
    assert one(spark, "5 x", M.converted) is None


def catalog(spark, rows, parts=3):
    schema = "row_id long, product_name string, Description string, group_name string, power string, note string"
    return spark.createDataFrame(rows, schema).repartition(parts)


ROWS = [
    (0, "oven a", "", "ovens", "100", "a"),
    (1, "oven b", "", "ovens", None, "b 1"),
    (2, "car x", "", "cars", "3 kW", "c"),
    (3, "lamp", "", "lamps", "5", "d"),
    (4, "lost", "", None, "7", "e 2"),
    (5, "lamp 2", "big phone", "lamps", "", "f"),
]


def test_profile_counts_and_limits(spark):
    df = catalog(spark, [(i, "p", "", "g", "12 W" if i % 5 == 0 else "none", f"n{i}") for i in range(100)])
    rows = {r["column_name"]: r for r in N.numeric_profile(df, ["power", "note", "Description"]).collect()}
    power = rows["power"]
    assert (power["total_values"], power["analyzed_values"], power["numeric_count"]) == (100, 50, 10)
    assert power["has_numeric"] is False and power["numeric_percentage"] == 20.0  # exactly 20 % is not enough
    assert [tuple(u) for u in power["units_found"]] == [("W", 10)] and power["avg_value"] == 12.0
    assert rows["note"]["first_numbers"] == [str(i) for i in range(10)] and rows["note"]["has_numeric"]
    full = {r["column_name"]: r for r in N.numeric_profile(df, ["power"], n=None).collect()}
    assert full["power"]["analyzed_values"] == 100


def test_samples_are_the_first_rows_whatever_the_order_and_density(spark):
    rows = [(i, "p", "", "g", str(i) if i % 997 == 3 else None, str(i)) for i in range(5000)]
    random.Random(4).shuffle(rows)
    got = N.column_samples(catalog(spark, rows, 6), ["power", "note"], 4).collect()
    values = lambda c: [r["value"] for r in sorted(got, key=lambda r: r["rn"]) if r["column_name"] == c]
    assert values("note") == ["0", "1", "2", "3"] and values("power") == ["3", "1000", "1997", "2994"]
    assert {r["column_name"]: r["total_values"] for r in got} == {"note": 5000, "power": 6}


def test_long_and_non_letter_tokens_are_no_units(spark):
    df = spark.createDataFrame([("x",), ("-",), ("abcdefghijklmno",), ("abcdefghijklmn",), ("\"",), ("кг",)], "u string")
    assert [r[0] for r in df.select(N.is_unit_token(F.col("u"))).collect()] == [False, False, False, True, False, True]


def test_category_units_and_missing_category(spark):
    df = catalog(spark, ROWS)
    units = {(r["category"], r["column_name"]): r["unit"] for r in U.category_units(df, ["power"]).collect()}
    assert units == {("ovens", "power"): "W", ("cars", "power"): "kW", ("lamps", "power"): "W"}
    out = {r["row_id"]: r["power"] for r in V.standardize_columns(df, ["power"]).collect()}
    assert out == {0: "100 W", 1: None, 2: "3 kW", 3: "5 W", 4: "7", 5: ""}
    best = {r["row_id"]: r["power"] for r in V.standardize_columns(df, ["power"], mode="best").collect()}
    assert best == {0: "100 W", 1: None, 2: "3 kilowatt", 3: "5 W", 4: "7", 5: ""}


def test_unit_from_values_when_no_rule_applies(spark):
    rows = [(i, "p", "", "g", v, "") for i, v in enumerate(["7 cm", "8 kg", "9"])]
    df = catalog(spark, rows).withColumnRenamed("power", "depth")
    assert [tuple(r) for r in U.category_units(df, ["depth"]).collect()] == [("g", "depth", "cm")]


def test_without_category_column_one_default(spark):
    df = catalog(spark, ROWS).drop("group_name")
    assert [tuple(r) for r in U.category_units(df, ["power"]).collect()] == [("default", "power", "W")]
    out = {r["row_id"]: r["power"] for r in V.standardize_columns(df, ["power"]).collect()}
    assert out[4] == "7 W" and out[2] == "3 kW"


def test_headers(spark):
    units = spark.createDataFrame([("b", "p", "kg"), ("a", "p", "g"), ("a", "q (mm)", "mm")], "category string, column_name string, unit string")
    got = {r["column_name"]: r["new_name"] for r in V.header_units(["p", "q (mm)", "r"], units).collect()}
    assert got == {"p": "p (g)", "q (mm)": "q (mm)", "r": "r"}
    measured = spark.createDataFrame([("p", ["gram"])], "column_name string, common_units array<string>")
    assert {r["new_name"] for r in V.header_units(["p"], units, measured).collect()} == {"p (gram)"}
    assert V.header_name("a", None) == "a" and V.header_name("a (g)", "g") == "a (g)"


def test_preview_and_counts(spark):
    df = catalog(spark, ROWS).withColumn("empty", F.lit(None).cast("string"))
    shown = V.standardize_preview(df, ["power", "note", "empty"], U.category_units(df, ["power", "note"]))
    assert {r["column_name"]: (r["before"], r["after"], r["state"]) for r in shown.collect()} == {
        "power": ("100", "100 W", "changed"), "note": ("a", "a", "unchanged"), "empty": (None, None, "no data"),
    }
    assert tuple(V.preview_counts(shown).first()) == (1, 1, 1)


def test_measurement_types(spark):
    df = catalog(spark, ROWS).withColumnsRenamed({"power": "Power (W)"})
    got = {r["column_name"]: r for r in U.measurement_types(df, ["Power (W)", "note"]).collect()}
    assert (got["Power (W)"]["primary_dimension"], got["Power (W)"]["confidence"], got["Power (W)"]["common_units"]) == ("power", 0.95, ["watt"])
    assert (got["note"]["primary_dimension"], got["note"]["confidence"], got["note"]["method"]) == ("unknown", 0.0, "mixed")
    assert tuple(U.success_rate(U.measurement_types(df, ["Power (W)", "note"])).first()) == (1, 2, 50.0)


def test_confidence_may_exceed_one(spark):
    df = catalog(spark, [(i, "p", "", "g", "3 kg", "") for i in range(4)]).withColumnRenamed("power", "mass of it")
    row = U.measurement_types(df, ["mass of it"]).first()
    assert (row["primary_dimension"], row["confidence"]) == ("mass", 6.0) and row["common_units"] == ["kilogram"]


def test_standardized_header_is_found_again():
    assert N.standardized_name(["a", "power (W)"], "power") == "power (W)"
    assert N.standardized_name(["power", "power (W)"], "power") == "power" and N.standardized_name(["a"], "b") is None


@pytest.mark.parametrize(
    "text,plain",
    [
        ("1,234.5", "1234.5"), ("1.234,5", "1234.5"), ("1 234,5", "1234.5"), ("10\u00a0000", "10000"), ("1 1/2", "1.5"), ("-3/4", "-0.75"),
        ("1/3", "0.3333333333333333"), ("3/0", None), ("1e3", "1e3"), ("+7", "7"), ("\u22125,5", "-5.5"), ("0,500", "0.500"), ("1,500", "1500"),
        ("12,34", "12.34"), ("1.234.567", "1234567"), ("6/3", "2"),
    ],
)
def test_plain_numbers(spark, text, plain):
    assert one(spark, text, M.plain_number) == plain


def test_amounts_in_running_text(spark):
    text = "Holds 1 1/2 l, 10 000 W; 5 kg.\nFrom 50-60 Hz or 50 - 60 Hz, 12V/24V, v1.2.3 kg, (7 mm) and -5 °C at 100 km/h"
    found = one(spark, text, M.quantity_extractions)
    assert [(e["number"], e["unit"]) for e in found] == [
        ("1.5", "liter"), ("10000", "watt"), ("5", "kilogram"), ("7", "millimeter"), ("-5", "degree_Celsius"), ("100", "km/h"),
    ]


def test_empty_and_missing_texts_have_no_amounts(spark):
    for text in (None, "", " ", "no number", "x" * 20000, "9" * 20000, ("5 " * 5000) + "kg"):
        found = one(spark, text, M.all_extractions)
        assert found is None if text is None else len(found) <= 2


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_fixed_digits_follow_the_binary_value(spark, digits):
    import random

    rng = random.Random(digits)
    values = [0.0, 12.075, 0.125, 0.375, 2.5, 0.005, 1e-9, 123456789.987654321, 0.9999999, 1.005, 2.675, 99.995] + [
        rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(500)
    ]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", M.fixed_text(F.col("x"), digits).alias("t")).collect()
    assert all(r.t == f"{r.x:.{digits}f}" for r in got)


def test_extraction_rows_agree_with_the_column_form(spark):
    texts = ["weighs 2.5 KG or 3 foobar, 0 kg", None, "", "5 g/cm3 and 7 lbs, 1,5 meterss", "4K 802.11b 2 min", "5 kg 5 kg 5 kg"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, pos string").withColumnRenamed("pos", "body")
    rows = sorted(tuple(r) for r in U.extraction_rows(df, "body", ["n"]).collect())
    wide = df.select("n", F.posexplode(M.all_extractions(F.col("body")))).select("n", "pos", "col.*")
    assert rows == sorted(tuple(r) for r in wide.collect()) and len(rows) > 10


def test_expressions_of_units(spark):
    texts = ["km / h", "m / s ^ 2", "N·m", "kg*m**2/s**2", "1/min", None, "", " ", "foo", "kg·foo", "°C", "W/(m²*K)", "(kg*m)/s", "km/h"]
    df = spark.createDataFrame([(t,) for t in texts], "u string").withColumn("unit_text", F.lit("clash"))
    got = {r.unit_text: r for r in X.unit_expressions(df, "u").collect()}
    assert set(got) == {"km / h", "m / s ^ 2", "N·m", "kg*m**2/s**2", "1/min", "°C", "W/(m²*K)", "(kg*m)/s", "km/h"}
    assert got["km / h"]["canonical"] == got["km/h"]["canonical"] == "kilometer / hour"
    assert got["kg*m**2/s**2"]["dimension"] == "energy" and got["1/min"]["base_unit"] == "1 / second" and got["°C"]["offset"] == 273.15
    assert got["W/(m²*K)"]["base_unit"] == "kilogram / kelvin / second ** 3" and got["(kg*m)/s"]["canonical"] == "kilogram * meter / second"
    assert X.unit_expressions(df.limit(0), "u").collect() == []


def test_values_with_unknown_units_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "3 km/h"), (2, "3 foo"), (3, "12"), (4, "1 000 m²"), (5, "-5 °C"), (6, None), (7, "50-60 Hz")], "id int, v string")
    got = {r.id: (r.amount, r.base_unit) for r in X.convert_measured(df, ["v"], ["id"]).collect()}
    assert got[4] == (1000.0, "meter ** 2") and got[5] == (268.15, "kelvin") and got[2] == got[3] == got[7] == (None, None)
    assert abs(got[1][0] - 3 / 3.6) < 1e-12 and 6 not in got


def test_repeated_texts_are_parsed_once_and_many_ones_row_by_row(spark):
    rows = [(i, v) for i in range(40) for v in ("5 kg", "7", "a", None, "1 mm", "")]
    df = spark.createDataFrame(rows, "row_id int, v string").withColumn("w", F.reverse("v"))
    direct = df.select("row_id", "v", "w", M.converted(F.col("v")).alias("p"), M.converted(F.col("w")).alias("q"))
    joined, by_row = (with_parsed(df, {"v": "p", "w": "q"}, M.converted, most) for most in (100, 2))
    assert any("/parsed-" in f for f in joined.inputFiles()) and not by_row.inputFiles()
    same = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert same(joined) == same(by_row) == same(direct) and with_parsed(df, {}, M.converted) is df
    assert any("/parsed-" in f for f in V.convert_units(df, ["v"], ["row_id"]).inputFiles())


@pytest.mark.parametrize("mode", ["simple", "best"])
def test_columns_are_written_as_single_values_are(spark, mode):
    rows = [(i, "lamp", "Lamps" if i % 5 else None, v) for i, v in enumerate(["5 kg", "7", "a", None, "1 mm", "", "3-4", "1.2.3", "0", "x2"] * 2)]
    df = spark.createDataFrame(rows, "row_id int, product_name string, group_name string, power string")
    none = spark.createDataFrame([], "category string, column_name string, unit string")
    after = V.standardize_columns(df, ["power"], none, mode=mode)
    assert any("/parsed-" in f for f in after.inputFiles())
    context = (F.col("product_name"), F.col("group_name"))
    alone = V.WRITERS[mode](F.col("power"), F.coalesce(M.rule_unit("power", *context), M.context_unit("power", *context)))
    want = df.withColumn("power", F.when(F.col("group_name").isNotNull(), alone).otherwise(F.col("power")))
    assert sorted(map(tuple, after.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_profile_takes_repeated_texts_apart_once(spark):
    rows = [(i, ["5 kg", "7 kg 1 mm", "a", None, "2 mm"][i % 5]) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id int, v string")
    profile = N.numeric_profile(df, ["v"], n=None)
    got = profile.first()
    assert (got["total_values"], got["analyzed_values"], got["numeric_count"], got["avg_value"]) == (80, 80, 60, 3.75)
    assert [tuple(u) for u in got["units_found"]] == [("kg", 40), ("mm", 40)]
    assert got["first_numbers"] == ["5", "7", "1", "2", "5", "7", "1", "2", "5", "7"]
    assert any("/texts-" in f for f in profile.inputFiles())
