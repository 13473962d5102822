"""Products, quotients and powers of units, taken apart on distinct texts and joined with the dictionary.

A text is cut into factors, each factor is a row, and the factors meet the unit dictionary in an
equi-join. Grouped again they give the exponents of the base units. Unit texts are made distinct
first, so a unit costs the same however many values have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalign.constants import AMOUNT, BASE_DIMENSIONS, BASE_EXPONENTS, NAMED_DIMENSIONS, NOT_BEFORE
from catalign.functions.measures import dictionary, let, lower_dictionary, plain_number
from catalign.operators.schema import unpivot_values
from catalign.runtime import lookup, stage

WORD = r"[\p{L}µΩ°%_]+"
FACTOR = rf"(?:[0-9]+(?:\.[0-9]+)?|{WORD}(?:\^?-?[0-9]+)?)"
# A value that is an amount and a unit text.
MEASURED_VALUE = rf"^{NOT_BEFORE}({AMOUNT})(?:\s*|-)([\p{{L}}µΩ°%].*)$"
UNITS_SCHEMA = (
    "alias string, canonical string, dimension string, scale double, offset double, bases array<struct<base:string,power:int>>"
)


def unit_table(spark: SparkSession, lower: bool = False) -> DataFrame:
    """The dictionary (a few hundred rows) with each unit in base units: ``scale`` of them, to powers."""
    rows = []
    for alias, canonical, dimension, factor, offset in lower_dictionary() if lower else dictionary():
        bases, size = BASE_EXPONENTS[dimension]
        rows.append((alias, canonical, dimension, factor * size, offset, sorted(bases.items())))
    return spark.createDataFrame(rows, UNITS_SCHEMA)


def normal_expression(text: Column) -> Column:
    """One spelling of a unit text: ``*``, ``/`` and ``^`` without spaces, brackets behind a slash opened."""
    out = F.trim(text)
    for written, plain in (("²", "^2"), ("³", "^3"), ("⁻¹", "^-1"), ("⁻²", "^-2"), ("⁻³", "^-3")):
        out = F.replace(out, F.lit(written), F.lit(plain))
    out = F.regexp_replace(out, r"(?i)\s+per\s+", "/")
    out = F.regexp_replace(out, r"\*\*", "^")
    out = F.regexp_replace(out, r"\s*[·⋅×*]\s*", "*")
    out = F.regexp_replace(out, r"\s*([/^])\s*", "$1")
    out = F.regexp_replace(out, r"\s+", "*")
    out = F.regexp_replace(out, r"/([0-9]+(?:\.[0-9]+)?)(?=[\p{L}µΩ°%])", "/$1/")  # l/100km
    opened = r"^(.*?)/\(([^()]*)\)(.*)$"

    def without(t: Column) -> Column:
        # a/(b*c) is a/b/c: inside, products and quotients change places.
        head, inside, tail = (F.regexp_extract(t, opened, i) for i in (1, 2, 3))
        return F.when(t.rlike(opened), F.concat(head, F.lit("/"), F.translate(inside, "*/", "/*"), tail)).otherwise(t)

    for _ in range(2):
        out = let(out, without)
    return F.regexp_replace(out, r"^\(([^()]*)\)", "$1")


def _spelled(powers: Column) -> Column:
    """``[(name, power)]``, sorted by name, as ``a * b ** 2 / c``."""

    def side(keep, sign, joint):
        own = F.filter(powers, keep)
        power = lambda p: F.when(p["power"] * sign == 1, p["name"]).otherwise(
            F.concat(p["name"], F.lit(" ** "), (p["power"] * sign).cast("string"))
        )
        return F.array_join(F.transform(own, power), joint)

    above = side(lambda p: p["power"] > 0, F.lit(1), " * ")
    below = side(lambda p: p["power"] < 0, F.lit(-1), " / ")
    return F.when(below == "", above).otherwise(F.concat(F.when(above == "", "1").otherwise(above), F.lit(" / "), below))


def _named_dimension(powers: Column) -> Column:
    """The dimension with these base powers, by name if it has one, else spelled out."""
    key = F.array_join(F.transform(powers, lambda p: F.concat_ws(":", p["name"], p["power"].cast("string"))), ",")
    found = F.when(F.size(powers) == 0, "dimensionless")
    for name in NAMED_DIMENSIONS:
        found = found.when(key == ",".join(f"{b}:{p}" for b, p in sorted(BASE_EXPONENTS[name][0].items())), name)
    names = F.create_map(*[F.lit(x) for pair in BASE_DIMENSIONS.items() for x in pair])
    bracketed = F.transform(
        powers,
        lambda p: F.struct(F.concat(F.lit("["), F.try_element_at(names, p["name"]), F.lit("]")).alias("name"), p["power"].alias("power")),
    )
    return found.otherwise(_spelled(F.array_sort(bracketed)))


def unit_expressions(texts: DataFrame, column: str) -> DataFrame:
    """``(unit_text, canonical, dimension, factor, offset, base_unit)`` of each distinct text that is understood.

    ``factor`` says how many of ``base_unit`` one unit is. Operators apply from left to right, so
    ``a/b*c`` is ``a * c / b``; a bracket behind a slash is divided as a whole; ``per`` is a slash, space a product. Numbers may be factors
    (``l/100km``). Aliases count in their own case, from two letters on in any case. Only a unit alone keeps its offset: a
    degree in a product is a difference. Null, empty and unknown texts give no row.
    """
    spark = texts.sparkSession
    distinct = texts.select(F.col(f"`{column}`").alias("unit_text")).filter("trim(unit_text) <> ''").distinct()
    normal = distinct.withColumn("normal", normal_expression(F.col("unit_text")))
    normal = normal.filter(F.col("normal").rlike(rf"^{FACTOR}(?:[*/]{FACTOR})*$") & F.col("normal").rlike(WORD))
    part = rf"([*/]?)({FACTOR})"
    cut = normal.select(
        "unit_text",
        F.posexplode(F.arrays_zip(*[F.regexp_extract_all("normal", F.lit(part), i).alias(n) for i, n in ((1, "op"), (2, "factor"))])),
    ).select("unit_text", "pos", "col.op", "col.factor")
    sign = F.when(F.col("op") == "/", -1).otherwise(1)
    power = F.coalesce(F.nullif(F.regexp_extract("factor", r"\^?(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1))
    number = F.col("factor").rlike("^[0-9]")
    factors = stage(
        cut.select(
            "unit_text",
            "pos",
            F.when(number, F.col("factor").cast("double")).alias("number"),
            F.when(number, "").otherwise(F.regexp_replace("factor", r"\^?-?[0-9]+$", "")).alias("alias"),
            F.when(number, sign).otherwise(sign * power).alias("power"),
        ),
        "factors",
    )
    exact = unit_table(spark)
    any_case = unit_table(spark, lower=True).select(F.col("alias").alias("lower_alias"), F.struct("canonical", "dimension", "scale", "offset", "bases").alias("l"))
    known = factors.join(F.broadcast(exact.select("alias", F.struct("canonical", "dimension", "scale", "offset", "bases").alias("u"))), "alias", "left")
    known = known.join(F.broadcast(any_case), F.lower("alias") == F.col("lower_alias"), "left")
    known = known.withColumn("u", F.coalesce("u", "l")).drop("l", "lower_alias")
    ok = F.col("u").isNotNull() | F.col("number").isNotNull()
    whole = known.groupBy("unit_text").agg(
        F.count("*").alias("n"),
        F.bool_and(ok).alias("ok"),
        # A handful of factors of one text; sorted, so that the product doesn't depend on their order.
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("number", "u.scale").alias("scale"), "power"))).alias("scales"),
        F.min(F.struct("u.canonical", "u.dimension", "u.offset", "power")).alias("only"),
    )
    whole = whole.filter("ok").select(
        "unit_text",
        F.aggregate("scales", F.lit(1.0), lambda acc, s: F.when(s["power"] < 0, acc / F.pow(s["scale"], -s["power"])).otherwise(acc * F.pow(s["scale"], s["power"]))).alias("factor"),
        F.when((F.col("n") == 1) & (F.col("only.power") == 1), F.col("only")).alias("only"),
    )

    def summed(rows: DataFrame, name: str) -> DataFrame:
        powers = rows.groupBy("unit_text", "name").agg(F.sum("power").cast("int").alias("power")).filter("power <> 0")
        return powers.groupBy("unit_text").agg(F.array_sort(F.collect_list(F.struct("name", "power"))).alias(name))

    units = summed(known.filter("u is not null").select("unit_text", F.col("u.canonical").alias("name"), "power"), "units")
    base = known.select("unit_text", "power", F.explode("u.bases").alias("b"))
    bases = summed(base.select("unit_text", F.col("b.base").alias("name"), (F.col("b.power") * F.col("power")).alias("power")), "bases")
    none = F.array().cast("array<struct<name:string,power:int>>")
    out = whole.join(units, "unit_text", "left").join(bases, "unit_text", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("units", "bases")})
    return out.select(
        "unit_text",
        F.coalesce("only.canonical", F.nullif(_spelled(F.col("units")), F.lit("")), F.lit("dimensionless")).alias("canonical"),
        F.coalesce("only.dimension", _named_dimension(F.col("bases"))).alias("dimension"),
        "factor",
        F.coalesce("only.offset", F.lit(0.0)).alias("offset"),
        F.coalesce(F.nullif(_spelled(F.col("bases")), F.lit("")), F.lit("one")).alias("base_unit"),
    )


def convert_measured(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Values that are an amount and a unit, simple or compound, in base units, long form.

    ``ids…, column_name, value, amount, base_unit, dimension``; a value whose unit isn't understood keeps its
    row with null amount, base unit and dimension. Each distinct unit text is taken apart once.
    """
    values = unpivot_values(df, columns, ids)
    text = F.trim("value")
    split = values.select(
        *ids,
        "column_name",
        "value",
        plain_number(F.regexp_extract(text, MEASURED_VALUE, 1)).alias("_number"),
        F.nullif(F.trim(F.regexp_extract(text, MEASURED_VALUE, 2)), F.lit("")).alias("_unit"),
    )
    split = stage(split, "measured")
    known = unit_expressions(split.filter("_unit is not null"), "_unit").withColumnRenamed("unit_text", "_unit")
    rows = lookup(split, known.select("_unit", "factor", "offset", "base_unit", "dimension"), "_unit")
    amount = F.expr("try_cast(_number as double)") * F.col("factor") + F.col("offset")
    known_amount = amount.isNotNull()
    return rows.select(
        *ids,
        "column_name",
        "value",
        amount.alias("amount"),
        F.when(known_amount, F.col("base_unit")).alias("base_unit"),
        F.when(known_amount, F.col("dimension")).alias("dimension"),
    )
