"""Units and product rules for the SQL side, written out on their own and not taken from the package."""

from __future__ import annotations

PLAIN_UNITS = """(1, 'meter', 'length', 1.0, 0.0, ['m'], ['meters', 'metre', 'metres'], 'kmcuµn'),
(2, 'inch', 'length', 0.0254, 0.0, ['in'], ['inches'], ''),
(3, 'foot', 'length', 0.3048, 0.0, ['ft'], ['feet'], ''),
(4, 'yard', 'length', 0.9144, 0.0, ['yd'], ['yards'], ''),
(5, 'mile', 'length', 1609.344, 0.0, ['mi'], ['miles'], ''),
(6, 'gram', 'mass', 0.001, 0.0, ['g'], ['grams'], 'kmuµ'),
(7, 'metric_ton', 'mass', 1000.0, 0.0, ['t'], ['tonne', 'tonnes'], ''),
(8, 'pound', 'mass', 0.45359237, 0.0, ['lb'], ['lbs', 'pounds'], ''),
(9, 'ounce', 'mass', 0.028349523125, 0.0, ['oz'], ['ounces'], ''),
(10, 'watt', 'power', 1.0, 0.0, ['W', 'w'], ['watts', 'Watt'], 'kMGmuµ'),
(11, 'horsepower', 'power', 745.6998715822702, 0.0, ['hp'], [], ''),
(12, 'watt_hour', 'energy', 3600.0, 0.0, ['Wh'], [], 'kMGm'),
(13, 'joule', 'energy', 1.0, 0.0, ['J'], ['joules'], 'kMG'),
(14, 'calorie', 'energy', 4.184, 0.0, ['cal'], ['calories'], 'k'),
(15, 'volt', 'voltage', 1.0, 0.0, ['V', 'v'], ['volts'], 'kmuµ'),
(16, 'ampere_hour', 'charge', 1.0, 0.0, ['Ah'], [], 'km'),
(17, 'ampere', 'current', 1.0, 0.0, ['A'], ['amp', 'amps', 'amperes'], 'kmuµ'),
(18, 'ohm', 'resistance', 1.0, 0.0, ['Ω'], ['ohms'], 'kM'),
(19, 'liter', 'volume', 0.001, 0.0, ['L', 'l'], ['liters', 'litre', 'litres'], 'mcuµ'),
(20, 'gallon', 'volume', 0.003785411784, 0.0, ['gal'], ['gallons'], ''),
(21, 'byte', 'information', 0.000000001, 0.0, ['B'], ['bytes'], 'kMGT'),
(22, 'bit', 'information', 0.000000000125, 0.0, ['b'], ['bits'], 'kMGT'),
(23, 'hertz', 'frequency', 1.0, 0.0, ['Hz'], [], 'kMGT'),
(24, 'second', 'time', 1.0, 0.0, ['s'], ['sec', 'secs', 'seconds'], 'muµn'),
(25, 'minute', 'time', 60.0, 0.0, ['min'], ['mins', 'minutes'], ''),
(26, 'hour', 'time', 3600.0, 0.0, ['h'], ['hr', 'hrs', 'hours'], ''),
(27, 'day', 'time', 86400.0, 0.0, [], ['days'], ''),
(28, 'kelvin', 'temperature', 1.0, 0.0, ['K'], [], ''),
(29, 'degree_Celsius', 'temperature', 1.0, 273.15, ['°C'], ['degC', 'celsius'], ''),
(30, 'degree_Fahrenheit', 'temperature', 0.5555555555555556, 255.3722222222222, ['°F'], ['degF', 'fahrenheit'], ''),
(31, 'degree', 'angle', 1.0, 0.0, ['°', 'deg'], ['degrees'], ''),
(32, 'pascal', 'pressure', 1.0, 0.0, ['Pa'], ['pascals'], 'kM'),
(33, 'bar', 'pressure', 100000.0, 0.0, [], ['bars'], 'm'),
(34, 'pound_force_per_square_inch', 'pressure', 6894.757293168, 0.0, ['psi'], [], ''),
(35, 'revolution_per_minute', 'rotation', 1.0, 0.0, ['rpm'], [], ''),
(36, 'pixel', 'pixel', 1.0, 0.0, ['px'], ['pixels'], ''),
(37, 'megapixel', 'pixel', 1000000.0, 0.0, ['MP'], ['megapixels'], ''),
(38, 'decibel', 'level', 1.0, 0.0, ['dB'], ['decibels'], ''),
(39, 'lumen', 'luminous_flux', 1.0, 0.0, ['lm'], ['lumens'], ''),
(40, 'pages_per_minute', 'rate', 1.0, 0.0, ['ppm'], [], ''),
(41, 'percent', 'dimensionless', 0.01, 0.0, ['%'], [], ''),
(42, 'piece', 'dimensionless', 1.0, 0.0, ['pcs'], ['pc', 'pieces'], ''),
(43, 'newton', 'force', 1.0, 0.0, ['N'], ['newtons'], 'kM'),
(44, 'newton_meter', 'energy', 1.0, 0.0, ['Nm'], [], ''),
(45, 'candela', 'luminous_intensity', 1.0, 0.0, ['cd'], ['candelas'], ''),
(46, 'lux', 'illuminance', 1.0, 0.0, ['lx'], [], '')"""

SPELLINGS = """('kWatt', 'kilowatt'), ('м', 'meter'), ('мм', 'millimeter'), ('см', 'centimeter'), ('км', 'kilometer'), ('дюйм', 'inch'),
('дюймов', 'inch'), ('г', 'gram'), ('гр', 'gram'), ('кг', 'kilogram'), ('мг', 'milligram'), ('т', 'metric_ton'), ('Вт', 'watt'),
('кВт', 'kilowatt'), ('МВт', 'megawatt'), ('В', 'volt'), ('А', 'ampere'), ('мАч', 'milliampere_hour'), ('кВтч', 'kilowatt_hour'),
('л', 'liter'), ('мл', 'milliliter'), ('Гц', 'hertz'), ('кГц', 'kilohertz'), ('МГц', 'megahertz'), ('ГГц', 'gigahertz'),
('КБ', 'kilobyte'), ('МБ', 'megabyte'), ('ГБ', 'gigabyte'), ('ТБ', 'terabyte'), ('с', 'second'), ('сек', 'second'),
('мин', 'minute'), ('ч', 'hour'), ('дБ', 'decibel'), ('шт', 'piece'), ('Н', 'newton'), ('кН', 'kilonewton')"""

UNITS_CTE = f"""base_units AS (SELECT * FROM (VALUES {PLAIN_UNITS}) t(nth, canonical, dimension, factor, off, symbols, names, prefixes)),
prefix AS (SELECT * FROM (VALUES (1, 'k', 'kilo', 1e3), (2, 'M', 'mega', 1e6), (3, 'G', 'giga', 1e9), (4, 'T', 'tera', 1e12),
  (5, 'm', 'milli', 1e-3), (6, 'c', 'centi', 1e-2), (7, 'u', 'micro', 1e-6), (8, 'µ', 'micro', 1e-6), (9, 'n', 'nano', 1e-9)
  ) t(mth, sign, word, size)),
spelled AS (
  SELECT unnest(list_concat(list_concat([canonical], symbols), names)) AS alias, canonical, dimension,
    CAST(factor AS DOUBLE) AS factor, CAST(off AS DOUBLE) AS off, nth AS part,
    generate_subscripts(list_concat(list_concat([canonical], symbols), names), 1) AS place FROM base_units
  UNION ALL
  SELECT unnest(list_concat([word || canonical, word || canonical || 's'],
      list_transform(list_filter(symbols, lambda s: s <> 'Ω'), lambda s: sign || s))),
    word || canonical, dimension, CAST(factor AS DOUBLE) * CAST(size AS DOUBLE), CAST(off AS DOUBLE), 100 + nth * 10 + mth,
    generate_subscripts(list_concat([word || canonical, word || canonical || 's'],
      list_transform(list_filter(symbols, lambda s: s <> 'Ω'), lambda s: sign || s)), 1)
  FROM base_units JOIN prefix ON contains(prefixes, sign)),
spellings AS (SELECT * FROM (VALUES {SPELLINGS}) t(alias, canonical)),
units AS (SELECT alias, canonical, dimension, factor, off, part, place FROM (
    SELECT * FROM spelled
    UNION ALL SELECT s.alias, s.canonical, u.dimension, u.factor, u.off, 10000, 1
    FROM spellings s JOIN (SELECT DISTINCT ON (canonical) * FROM spelled ORDER BY canonical, part, place) u ON u.canonical = s.canonical)
  QUALIFY row_number() OVER (PARTITION BY alias ORDER BY part, place) = 1),
lowered AS (SELECT lower(alias) AS alias, canonical, dimension, factor, off FROM units WHERE length(alias) > 1
  QUALIFY row_number() OVER (PARTITION BY lower(alias) ORDER BY part, place) = 1)"""


def known(text: str) -> str:
    """Whether a text is an alias: as written, or in any case if it has two letters or more."""
    return f"({text} IN (SELECT alias FROM units) OR lower({text}) IN (SELECT alias FROM lowered))"


def cleaned(text: str) -> str:
    return f"regexp_replace(trim({text}), '[^\\p{{L}}\\p{{N}}_°%]', '', 'g')"


def validity_cte(source: str) -> str:
    """``valid(raw, canonical, dimension, how)`` for the distinct unit texts of ``source(raw)``."""
    return f"""cleaned AS (SELECT raw, {cleaned("raw")} AS c, lower({cleaned("raw")}) AS lc FROM (SELECT DISTINCT raw FROM {source})
  WHERE NOT regexp_matches(raw, '[/·*^²³0-9]')),
exact AS (SELECT raw, coalesce(u.canonical, l.canonical) AS canonical, coalesce(u.dimension, l.dimension) AS dimension, 'exact' AS how
  FROM cleaned LEFT JOIN units u ON u.alias = c LEFT JOIN lowered l ON l.alias = lc WHERE u.alias IS NOT NULL OR l.alias IS NOT NULL),
fuzzy AS (SELECT raw, canonical, dimension, 'fuzzy' AS how FROM cleaned JOIN lowered
  ON length(lc) >= 4 AND length(alias) >= 4 AND (starts_with(alias, lc) OR starts_with(lc, alias))
  WHERE NOT regexp_matches(trim(raw), '\\s') AND raw NOT IN (SELECT raw FROM exact)
  QUALIFY row_number() OVER (PARTITION BY raw ORDER BY length(alias) DESC, alias) = 1),
valid AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy)"""


COMPUTER = "laptop|notebook|computer|pc|ноутбук|компьютер"
PHONE = "phone|smartphone|mobile|телефон|смартфон"
TV = "tv|television|monitor|телевизор|монитор"
APPLIANCE = "refrigerator|washing|dishwasher|oven|холодильник|стиральная|посудомойка"
CAR = "car|auto|vehicle|машина|автомобиль"
SIZES = "dimension|size|width|height|length"

# (product words, column words, word the column must not have, pattern of the column, unit)
RULES = [
    (COMPUTER, "dimension|size|размер", "", "", "mm"),
    (COMPUTER, "screen|display|экран", "resolution", "", "inch"),
    (COMPUTER, "resolution|разрешение", "", "", "pixel"),
    (COMPUTER, "weight|вес", "", "", "kg"),
    (COMPUTER, "ram|memory|storage|память", "", "", "GB"),
    (PHONE, SIZES, "", "", "mm"),
    (PHONE, "screen|display", "resolution", "", "inch"),
    (PHONE, "resolution", "", "", "pixel"),
    (PHONE, "weight", "", "", "g"),
    (TV, "screen|display|size", "resolution", "", "inch"),
    (TV, "resolution", "", "", "pixel"),
    (TV, "dimension|width|height", "", "", "mm"),
    (APPLIANCE, "dimension|size|width|height", "", "", "cm"),
    (APPLIANCE, "weight", "", "", "kg"),
    (APPLIANCE, "power|мощность", "", "", "W"),
    (CAR, "length|width|height", "", "", "m"),
    (CAR, "power|engine|мощность", "", "", "kW"),
    ("", "resolution|разрешение", "", "[0-9]+x[0-9]+", "pixel"),
    ("", "screen|display|inch|дюйм", "", "", "inch"),
    ("phone|tablet|телефон", "weight|вес", "", "", "g"),
    ("", "weight|вес", "", "", "kg"),
    ("", "power|watt|мощность", "", "", "W"),
    ("", "memory|storage|ram|ssd|память", "", "", "GB"),
    ("phone|tablet|laptop|телефон|планшет|ноутбук", SIZES, "", "", "mm"),
    ("tv|monitor|телевизор|монитор", SIZES, "", "", "cm"),
    ("", SIZES, "", "", "m"),
]

FALLBACK = [
    ("screen|display|экран|диагональ", "inch"),
    ("weight|вес", "kg"),
    ("power|мощность", "W"),
    ("memory|storage|память", "GB"),
]


def rule_sql(column: str, context: str, whole_word: bool = False) -> str:
    """The product rules as one CASE over a column name and its lower-case context."""

    def has(text, words):
        pattern = f"(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])" if whole_word else words
        return f"regexp_matches({text}, '{pattern}')"

    arms = []
    for words, names, barred, pattern, unit in RULES:
        named = has(f"lower({column})", names) + (f" OR regexp_matches({column}, '{pattern}')" if pattern else "")
        test = f"({named})"
        test += f" AND NOT contains(lower({column}), '{barred}')" if barred else ""
        test += f" AND {has(context, words)}" if words else ""
        arms.append(f"WHEN {test} THEN '{unit}'")
    return "CASE " + "\n".join(arms) + " END"


def context_sql(column: str, rule: str, short_context: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({short_context}, '{words}') THEN '{unit}'" for words, unit in FALLBACK)
    bracket = f"trim(regexp_extract({column}, '\\(([^)]+)\\)', 1))"
    words = f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"""coalesce(CASE WHEN {known(bracket)} THEN {bracket} END,
  (SELECT w FROM (SELECT unnest({words}) AS w, generate_subscripts({words}, 1) AS i)
   WHERE length(w) > 1 AND w IN (SELECT alias FROM lowered) ORDER BY i LIMIT 1), {rule}, CASE {arms} END)"""
