"""Units of measure as column expressions: lookup, extraction, rules, formats.

Everything here is row-local and runs in the JVM. Lambdas over arrays are interpreted, not
compiled, so callers with many equal values extract from the distinct ones. The unit dictionary
and the rules are small constants folded into the plan.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalign.constants import (
    AMOUNT,
    CONFIDENCE_THRESHOLD,
    CONTEXT_FALLBACK,
    NOT_AFTER,
    NOT_BEFORE,
    NOT_TOUCHING,
    PATTERN_CONFIDENCE,
    PREFIXES,
    QUANTITY_CONFIDENCE,
    SPELLINGS,
    UNIT_RULES,
    UNIT_TEXT,
    UNITS,
    VALUE_PATTERN,
)

# An amount and its unit in the text's own case, with space or a hyphen between them or nothing.
QUANTITY = rf"({AMOUNT})(?:\s+|-|(?![{NOT_TOUCHING}](?!\p{{L}})))({UNIT_TEXT})"
WORD_PATTERN = NOT_BEFORE + QUANTITY + NOT_AFTER
# An amount and the letters after it, spaces among them, on lower-cased text.
LETTERS = "a-zA-Zа-яё°\"'"
QUANTITY_PATTERN = rf"{NOT_BEFORE}({AMOUNT})\s*([{LETTERS}](?:[{LETTERS}\s]*[{LETTERS}])?){NOT_AFTER}"
# A value that is one quantity, maybe with words behind it but no other number.
WHOLE_QUANTITY = rf"^{QUANTITY}(?:[^\p{{L}}\p{{N}}_²³/^·*][^0-9]*)?$"
WHOLE_AMOUNT = rf"^({AMOUNT})$"
# A fuzzy match needs this many letters in the shorter of text and alias.
FUZZY_LETTERS = 4

# The unit each dimension is converted to.
BASE_UNITS = {
    "length": "meter",
    "mass": "kilogram",
    "power": "watt",
    "energy": "joule",
    "voltage": "volt",
    "charge": "ampere_hour",
    "current": "ampere",
    "resistance": "ohm",
    "frequency": "hertz",
    "time": "second",
    "temperature": "kelvin",
    "angle": "degree",
    "pressure": "pascal",
    "rotation": "revolution_per_minute",
    "luminous_flux": "lumen",
    "dimensionless": "one",
    "volume": "cubic_meter",
    "information": "gigabyte",
    "pixel": "pixel",
    "level": "decibel",
    "rate": "pages_per_minute",
    "force": "newton",
    "luminous_intensity": "candela",
    "illuminance": "lux",
}


def dictionary() -> list[tuple[str, str, str, float, float]]:
    """``(alias, canonical, dimension, factor, offset)``, one row for each alias in its own case."""
    rows: dict[str, tuple] = {}
    by_name: dict[str, tuple] = {}

    def add(aliases, *unit):
        by_name.setdefault(unit[0], unit)
        for alias in aliases:
            rows.setdefault(alias, (alias, *unit))

    for name, dimension, factor, offset, symbols, names, _ in UNITS:
        add([name, *symbols, *names], name, dimension, factor, offset)
    # Prefixes come after all plain units, so that "min" is a minute and "ft" a foot.
    for name, dimension, factor, offset, symbols, _, prefixes in UNITS:
        for symbol, word, size in PREFIXES:
            if symbol in prefixes:
                aliases = [word + name, word + name + "s", *(symbol + s for s in symbols if s != "Ω")]
                add(aliases, word + name, dimension, factor * size, offset)
    for alias, name in SPELLINGS:
        add([alias], *by_name[name])
    return list(rows.values())


def lower_dictionary() -> list[tuple[str, str, str, float, float]]:
    """The same by lower-case alias of two letters or more; the first of aliases that become equal."""
    rows: dict[str, tuple] = {}
    for alias, *unit in dictionary():
        if len(alias) > 1:
            rows.setdefault(alias.lower(), (alias.lower(), *unit))
    return list(rows.values())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_map(rows: dict[str, tuple]) -> Column:
    """A dictionary as one literal, which the optimizer folds into a constant map of strings."""
    return F.expr("str_to_map('" + "\n".join(f"{k}={';'.join(map(str, v))}" for k, v in rows.items()) + "', '\n', '=')")


def _entry(packed: Column, how: str) -> Column:
    part = lambda p, i: F.get(F.split(p, ";"), F.lit(i))
    return let(
        packed,
        lambda p: F.when(
            p.isNotNull(),
            F.struct(
                part(p, 0).alias("canonical"),
                part(p, 1).alias("dimension"),
                part(p, 2).cast("double").alias("factor"),
                part(p, 3).cast("double").alias("offset"),
                F.lit(how).alias("how"),
            ),
        ),
    )


def _exact(text: Column) -> Column:
    cased = F.try_element_at(_literal_map({a: u for a, *u in dictionary()}), text)
    return F.coalesce(cased, F.try_element_at(_literal_map({a: u for a, *u in lower_dictionary()}), F.lower(text)))


def find_unit(text: Column) -> Column:
    """Dictionary entry with this alias, in its own case or else, for two letters or more, in any."""
    return _entry(let(F.trim(text), _exact), "exact")


def clean_unit(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[^\\p{L}\\p{N}_°%]", "")


def find_unit_fuzzy(text: Column) -> Column:
    """Entry whose alias begins with this one word or is its beginning, in any case.

    Both need at least four letters. The longest alias that begins with the word wins, then the
    longest that it begins with, then the alphabet. A short alias somewhere inside a word says nothing.
    """
    begun: dict[str, tuple] = {}
    aliases = sorted(lower_dictionary(), key=lambda row: (-len(row[0]), row[0]))
    for alias, *unit in aliases:
        for size in range(FUZZY_LETTERS, len(alias)):
            begun.setdefault(alias[:size], unit)
    starts = {a: u for a, *u in aliases if len(a) >= FUZZY_LETTERS}
    longest = max(map(len, starts))

    def found(word: Column) -> Column:
        sizes = F.sequence(F.least(F.length(word) - 1, F.lit(longest)), F.lit(FUZZY_LETTERS), F.lit(-1))
        hits = F.transform(sizes, lambda n: F.try_element_at(_literal_map(starts), word.substr(F.lit(1), n)))
        inside = F.when(F.length(word) > FUZZY_LETTERS, F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)))
        return F.when(F.length(word) >= FUZZY_LETTERS, F.coalesce(F.try_element_at(_literal_map(begun), word), inside))

    return _entry(let(F.lower(F.trim(text)), found), "fuzzy")


def validate_unit(text: Column) -> Column:
    """Dictionary entry of a unit text with ``how`` it was found, null when unknown.

    Only one word can be a fuzzy match. Products, quotients and powers are no dictionary entries; see
    ``operators.unit_expressions`` for them.
    """
    one_word = ~F.trim(text).rlike(r"\s")
    found = let(clean_unit(text), lambda c: F.coalesce(find_unit(c), F.when(one_word, find_unit_fuzzy(c))))
    return F.when(~text.rlike("[/·*^²³0-9]"), found)


def plain_number(number: Column) -> Column:
    """An amount as a plain decimal number: without groups of thousands, with a point, fractions divided.

    A comma before groups of three digits parts thousands, any other one is a decimal comma; points
    part thousands where a comma or more points follow. Null if a fraction has no value.
    """

    def written(n: Column) -> Column:
        part = lambda i: F.regexp_extract(n, r"^([-+]?)(?:([0-9]+) )?([0-9]+)/([0-9]+)$", i)
        whole = F.coalesce(F.nullif(part(2), F.lit("")).cast("double"), F.lit(0.0))
        share = F.try_divide(part(3).cast("double"), part(4).cast("double"))
        fraction = F.when(part(1) == "-", -(whole + share)).otherwise(whole + share)
        return (
            F.when(n.contains("/"), F.regexp_replace(fraction.cast("string"), r"\.0$", ""))
            .when(n.contains(" "), F.translate(n, ", ", "."))
            .when(n.rlike(r"^[-+]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$"), F.translate(n, ",", ""))
            .when(n.rlike(r"^[-+]?[1-9][0-9]{0,2}((\.[0-9]{3})+,[0-9]+|(\.[0-9]{3}){2,})$"), F.translate(n, ",.", "."))
            .otherwise(F.translate(n, ",", "."))
        )

    tidy = F.translate(number, "\u00a0\u2212", " -")
    return F.ltrim(let(tidy, written), F.lit("+"))


def _number_unit_pairs(text: Column, pattern: str) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(pattern), 1)
    units = F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.zip_with(numbers, units, lambda n, u: F.struct(plain_number(n).alias("number"), F.trim(u).alias("raw")))


def _extraction(pair: Column, valid: Column, confidence: Column, method: Column, unknown: str | None) -> Column:
    return F.struct(
        pair["number"].alias("number"),
        pair["raw"].alias("raw_unit"),
        F.coalesce(valid["canonical"], pair["raw"]).alias("unit"),
        F.coalesce(valid["dimension"], F.lit(unknown)).alias("dimension"),
        confidence.cast("double").alias("confidence"),
        method.alias("method"),
        valid.isNotNull().alias("is_valid"),
    )


def _checked(pairs: Column, validate: bool) -> Column:
    none = F.lit(None).cast("struct<canonical:string,dimension:string,factor:double,offset:double,how:string>")
    unit = (lambda p: validate_unit(p["raw"])) if validate else (lambda p: none)
    return F.transform(pairs, lambda p: F.struct(p.alias("p"), unit(p).alias("v")))


def confidence_of(how: Column | str, by_how: dict[str, float]) -> Column:
    how = F.col(how) if isinstance(how, str) else how
    return F.when(how == "exact", by_how["exact"]).when(how == "fuzzy", by_how["fuzzy"]).otherwise(by_how["unknown"])


def quantity_pairs(text: Column) -> Column:
    """Amounts and their unit texts; zero amounts are skipped."""
    return F.filter(_number_unit_pairs(text, WORD_PATTERN), lambda p: p["number"].cast("double") != 0)


def pattern_pairs(text: Column) -> Column:
    """Amounts and the up to 19 letters and spaces after them, lower-cased."""
    pairs = _number_unit_pairs(F.lower(text), QUANTITY_PATTERN)
    return F.filter(pairs, lambda p: p["number"].isNotNull() & (F.length(p["raw"]) < 20))


def quantity_extractions(text: Column, validate: bool = True) -> Column:
    """Number and word: 0.95 if the unit is in the dictionary, else 0.8. Zero amounts are skipped."""
    pairs = quantity_pairs(text)
    return F.transform(
        _checked(pairs, validate),
        lambda c: _extraction(
            c["p"],
            c["v"],
            confidence_of(c["v"]["how"], QUANTITY_CONFIDENCE),
            F.when(c["v"].isNotNull(), "quantity_known").otherwise("quantity"),
            "",
        ),
    )


def pattern_extractions(text: Column, validate: bool = True) -> Column:
    """Number and following unit text of 1 to 19 characters, on lower-cased text."""
    pairs = pattern_pairs(text)
    return F.transform(
        _checked(pairs, validate),
        lambda c: _extraction(
            c["p"],
            c["v"],
            confidence_of(c["v"]["how"], PATTERN_CONFIDENCE),
            F.when(c["v"].isNotNull(), "pattern_known").otherwise("pattern"),
            "unknown",
        ),
    )


def all_extractions(text: Column, quantities: bool = True, patterns: bool = True, validate: bool = True) -> Column:
    """Both extractors in order; either can be switched off, and so can the validation of units.

    Without validation units stay as written and confidences are those of unknown units.
    """
    if not quantities and not patterns:
        raise ValueError("no extractor is active")
    if quantities and patterns:
        return F.concat(quantity_extractions(text, validate), pattern_extractions(text, validate))
    return quantity_extractions(text, validate) if quantities else pattern_extractions(text, validate)


def confident(extractions: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return F.filter(extractions, lambda e: e["confidence"] >= threshold)


def best_extraction(extractions: Column) -> Column:
    """The first of the extractions with the highest confidence."""
    top = lambda found: F.array_max(F.transform(found, lambda e: e["confidence"]))
    return let(
        extractions,
        lambda found: let(top(found), lambda best: F.get(F.filter(found, lambda e: e["confidence"] == best), F.lit(0))),
    )


def _any_in(text: Column | str, words: list[str], whole_word: bool) -> Column | bool:
    if whole_word:
        pattern = r"(?<![\p{L}\p{N}_])(" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}_])"
        if isinstance(text, str):
            return re.search(r"(?<!\w)(" + "|".join(re.escape(w) for w in words) + r")(?!\w)", text) is not None
        return text.rlike(pattern)
    if isinstance(text, str):
        return any(w in text for w in words)
    return reduce(or_, [text.contains(w) for w in words])


def _and(*conditions):
    """Conjunction that folds the parts already known while planning."""
    kept = [c for c in conditions if c is not True]
    if any(c is False for c in kept):
        return False
    out = None
    for c in kept:
        out = c if out is None else out & c
    return True if out is None else out


def _context(column: Column | str, *parts: Column | None) -> Column:
    head = F.lit(column) if isinstance(column, str) else column
    present = [F.coalesce(p.cast("string"), F.lit("")) for p in parts if p is not None]
    return F.lower(F.concat_ws(" ", head, *present))


def rule_unit(
    column: Column | str,
    product: Column | None = None,
    category: Column | None = None,
    description: Column | None = None,
    whole_word: bool = False,
) -> Column:
    """Unit by product type and column name: the first rule that applies.

    With a column name known while planning, only the rules for that name stay.
    """
    return let(_context(column, product, category, description), lambda context: _ruled(column, context, whole_word))


def _ruled(column: Column | str, context: Column, whole_word: bool) -> Column:
    lowered = column.lower() if isinstance(column, str) else F.lower(column)
    found = None
    for words, column_words, barred, pattern, unit in UNIT_RULES:
        named = _any_in(lowered, column_words, whole_word)
        if pattern is not None:
            if isinstance(column, str):
                named = named or re.search(pattern, column) is not None
            else:
                named = named | column.rlike(pattern)
        allowed = True
        if barred is not None:
            allowed = barred not in lowered if isinstance(lowered, str) else ~lowered.contains(barred)
        condition = _and(named, allowed, _any_in(context, words, whole_word) if words else True)
        if condition is False:
            continue
        if condition is True:
            return F.lit(unit) if found is None else found.otherwise(F.lit(unit))
        found = F.when(condition, F.lit(unit)) if found is None else found.when(condition, F.lit(unit))
    return F.lit(None).cast("string") if found is None else found


def context_unit(
    column: Column | str,
    product: Column | None = None,
    category: Column | None = None,
    description: Column | None = None,
) -> Column:
    """Unit from the column name and its context: bracketed text, then a word of
    the name, then the product rules, then the last-resort words."""
    if isinstance(column, str):
        known = unit_in_name(column)
        if known is not None:
            return F.lit(known)
        by_name = []
    else:
        bracket = F.trim(F.regexp_extract(column, r"\(([^)]+)\)", 1))
        words = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        by_name = [
            F.when(find_unit(bracket).isNotNull(), bracket),
            F.get(F.filter(words, lambda w: (F.length(w) > 1) & find_unit(w).isNotNull()), F.lit(0)),
        ]

    def by_context(context: Column) -> Column:
        found = F
        for terms, unit in CONTEXT_FALLBACK:
            found = found.when(_any_in(context, terms, False), unit)
        return found

    fallback = let(_context(column, product, category), by_context)
    return F.coalesce(*by_name, rule_unit(column, product, category, description), fallback)


def unit_in_name(column: str) -> str | None:
    """The unit a header itself states, for a name known while planning."""
    known = {row[0] for row in lower_dictionary()}
    exact = known | {row[0] for row in dictionary()}
    bracket = re.search(r"\(([^)]+)\)", column)
    if bracket and (bracket.group(1).strip() in exact or bracket.group(1).strip().lower() in known):
        return bracket.group(1).strip()
    return next((w for w in re.findall(r"\w+", column.lower()) if len(w) > 1 and w in known), None)


def formatted(number: Column, unit: Column, fmt: str = "number_unit") -> Column:
    if fmt == "unit_number":
        return F.concat_ws(" ", unit, number)
    return F.concat_ws(" ", number, unit)


def fixed_text(x: Column, digits: int) -> Column:
    """A double, not negative, with so many digits behind the point, rounded by its binary value (ties to even).

    The fraction is a whole number of 2^-60 parts, so the rounding is exact; Java's formats round the
    shortest decimal text instead, which turns 12.075 (a little less in binary) into 12.08.
    """
    parts = F.lit(1 << 60).cast("decimal(38,0)")

    def written(v: Column) -> Column:
        ones = F.floor(v).cast("decimal(38,0)")
        scaled = ((v - F.floor(v)) * F.lit(float(1 << 60))).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(8,0)")
        return F.struct(ones.alias("ones"), scaled.cast("decimal(38,0)").alias("scaled"))

    def rounded(s: Column) -> Column:
        rest = s["scaled"] % parts
        low = ((s["scaled"] - rest) / parts).cast("bigint")
        up = (rest * 2 > parts) | ((rest * 2 == parts) & (low % 2 == 1))
        units = s["ones"].cast("bigint") * 10**digits + low + F.when(up, 1).otherwise(0)
        tail = F.lpad((units % 10**digits).cast("string"), digits, "0")
        return F.concat(((units - units % 10**digits) / 10**digits).cast("bigint").cast("string"), F.lit("."), tail)

    return let(let(x.cast("double"), written), rounded)


def parse_simple(value: Column, fmt: str = "number_unit") -> Column:
    """``(text, number)``: the first number of a value with its own unit, or the number alone if it needs a fallback."""
    text = F.trim(value)
    found = F.struct(
        F.regexp_extract(text, VALUE_PATTERN, 1).alias("number"),
        F.trim(F.regexp_extract(text, VALUE_PATTERN, 2)).alias("own"),
    )
    return let(
        found,
        lambda f: F.struct(
            F.when((f["number"] != "") & (f["own"] != ""), formatted(f["number"], f["own"], fmt)).alias("text"),
            F.when((f["number"] != "") & (f["own"] == ""), f["number"]).alias("number"),
        ),
    )


def parse_best(value: Column, fmt: str = "number_unit") -> Column:
    """``(text, number)``: the quantity a value begins with in its canonical unit, or the number that a value is."""
    text = F.trim(value)
    quantity = F.struct(
        plain_number(F.regexp_extract(text, WHOLE_QUANTITY, 1)).alias("number"),
        validate_unit(F.regexp_extract(text, WHOLE_QUANTITY, 2)).alias("unit"),
    )
    known = lambda q: F.when(
        q["unit"].isNotNull() & (q["number"].cast("double") != 0), formatted(q["number"], q["unit"]["canonical"], fmt)
    )
    bare = text.rlike(WHOLE_AMOUNT)
    return F.struct(
        F.when(~bare & text.rlike(WHOLE_QUANTITY), let(quantity, known)).alias("text"),
        F.when(bare, F.nullif(plain_number(F.regexp_extract(text, WHOLE_AMOUNT, 1)), F.lit(""))).alias("number"),
    )


def written(parsed: Column, value: Column, fallback_unit: Column, fmt: str = "number_unit", blank: bool = False) -> Column:
    """The text of a parsed value; a number without a unit gets the fallback (an empty one only if ``blank``), what isn't
    understood stays as it is."""
    unit = F.when(parsed["number"].isNotNull(), fallback_unit)
    with_fallback = let(unit, lambda u: F.when(u.isNotNull() if blank else u != "", formatted(parsed["number"], u, fmt)))
    return F.coalesce(parsed["text"], with_fallback, value)


def standardize_simple(value: Column, fallback_unit: Column, fmt: str = "number_unit") -> Column:
    """First number with its own unit, else with the fallback; otherwise unchanged."""
    return let(parse_simple(value, fmt), lambda p: written(p, value, fallback_unit, fmt))


def standardize_best(value: Column, fallback_unit: Column, fmt: str = "number_unit") -> Column:
    """The quantity a value begins with in its canonical unit; a bare number gets the fallback unit.

    Only a value that is understood is rewritten: one quantity whose unit is in the dictionary, with no
    other number behind it, or one number. Ranges, sizes, versions and unknown units stay as they are.
    """
    return let(parse_best(value, fmt), lambda p: written(p, value, fallback_unit, fmt, blank=True))


def converted(value: Column) -> Column:
    """A value that is one quantity, in the base unit of its dimension; null for any other value."""
    text = F.trim(value)
    base = F.create_map(*[F.lit(x) for pair in BASE_UNITS.items() for x in pair])
    parts = F.struct(
        plain_number(F.regexp_extract(text, WHOLE_QUANTITY, 1)).alias("number"),
        find_unit(F.regexp_extract(text, WHOLE_QUANTITY, 2)).alias("unit"),
    )
    return F.when(
        text.rlike(WHOLE_QUANTITY),
        let(
            parts,
            lambda p: F.when(
                p["number"].isNotNull() & p["unit"].isNotNull(),
                F.struct(
                    (p["number"].cast("double") * p["unit"]["factor"] + p["unit"]["offset"]).alias("amount"),
                    F.try_element_at(base, p["unit"]["dimension"]).alias("base_unit"),
                    p["unit"]["dimension"].alias("dimension"),
                ),
            ),
        ),
    )
