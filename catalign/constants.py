"""Word lists, tokens and tables that results depend on."""

# Text read as missing (the default list of the pandas CSV reader).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Header names recognised for each role, in order of preference.
ROLE_SYNONYMS = {
    "product_name": ["product_name", "product", "name", "product name"],
    "category": ["category", "cat"],
    "SKU": ["sku", "код", "id"],
}

# Columns left out when their lower-case name contains one of these.
PARAM_EXCLUDED = ["name", "id", "source_file"]
STANDARD_EXCLUDED = [
    "name", "id", "source_file", "category", "group_name", "sku", "width", "price", "cost", "цена", "стоимость",
]

# Thresholds and sample sizes.
MAX_COLUMNS = 1000
CONFIRM_COLUMNS = 30
TOKEN_SORT_THRESHOLD = 70
EMBEDDING_THRESHOLD = 75
JARO_WINKLER_THRESHOLD = 80
CONFLICT_LIMIT = 0.1
PROFILE_SAMPLE = 50
MEASURE_SAMPLE = 20
CATEGORY_SAMPLE = 3
NUMERIC_SHARE = 20
CONFIDENCE_THRESHOLD = 0.7
CONTEXT_CONFIDENCE = 0.95
LOW_CONFIDENCE = 0.3
EPS_FLAT, MIN_SAMPLES_FLAT = 0.4, 2
EPS_HIERARCHICAL, MIN_SAMPLES_HIERARCHICAL = 0.35, 1

# Confidence of an extraction by method and by how its unit was found.
QUANTITY_CONFIDENCE = {"exact": 0.95, "fuzzy": 0.8, "unknown": 0.8}
PATTERN_CONFIDENCE = {"exact": 0.9, "fuzzy": 0.7, "unknown": 0.4}

# number/unit patterns (ASCII digits, Latin and lower-case Cyrillic letters).
NUMBER = r"[0-9]+\.?[0-9]*"
UNIT_CLASS = "[a-zA-Zа-яё°\"'\\s]"
VALUE_PATTERN = rf"({NUMBER})\s*({UNIT_CLASS}*)"
# Signed numbers with groups of thousands, decimals, exponents and fractions, the longest form first.
AMOUNT = (
    r"[-+\u2212]?(?:(?:[0-9]+[ \u00a0])?[0-9]+/[0-9]+"  # 3/4 and 1 1/2
    r"|[1-9][0-9]{0,2}(?:[ \u00a0][0-9]{3})+(?:[.,][0-9]+)?"  # 10 000,5
    r"|[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\.[0-9]+)?"  # 1,234.5
    r"|[1-9][0-9]{0,2}(?:\.[0-9]{3})+,[0-9]+"  # 1.234,5
    r"|[1-9][0-9]{0,2}(?:\.[0-9]{3}){2,}"  # 1.234.567
    r"|[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?)"  # 12,5 and 1e3
)
# What can't stand before an amount (it would be a part of something else, as of a range), and after its unit.
NOT_BEFORE = r"(?<![\p{L}\p{N}_.,/+\-\u2013\u2014\u2212])(?<![0-9]\s?[-\u2013\u2014]\s?)"
NOT_AFTER = r"(?![\p{L}\p{N}_²³/^·*])"
# A unit of one word, or words with powers in products and quotients.
UNIT_WORD = r"[a-zA-Zа-яА-ЯёЁ°µΩ%\"']+"
UNIT_POWER = r"(?:[²³]|\^?-?[1-9](?![0-9]))?"
# An x before a number is no unit but a size, as in 2x4.
UNIT_TEXT = rf"(?!x[0-9]){UNIT_WORD}{UNIT_POWER}(?:[/·*]{UNIT_WORD}{UNIT_POWER})*"
# Letters that are more than a unit where they touch the number: 4K is a picture size, 802.11b a standard.
NOT_TOUCHING = "Kb"
NOT_UNITS = ["x", "-", ":", ""]

# Prefixes of units (symbol, name, factor).
PREFIXES = [
    ("k", "kilo", 1e3),
    ("M", "mega", 1e6),
    ("G", "giga", 1e9),
    ("T", "tera", 1e12),
    ("m", "milli", 1e-3),
    ("c", "centi", 1e-2),
    ("u", "micro", 1e-6),
    ("µ", "micro", 1e-6),
    ("n", "nano", 1e-9),
]

# Units (canonical name, dimension, factor, offset, symbols, other names, prefixes).
# value * factor + offset is the amount in the base unit of the dimension. Prefixes go before the
# symbols and before the canonical name and its plural. Earlier units win where only the case differs.
UNITS = [
    ("meter", "length", 1.0, 0.0, ["m"], ["meters", "metre", "metres"], "kmcuµn"),
    ("inch", "length", 0.0254, 0.0, ["in"], ["inches"], ""),
    ("foot", "length", 0.3048, 0.0, ["ft"], ["feet"], ""),
    ("yard", "length", 0.9144, 0.0, ["yd"], ["yards"], ""),
    ("mile", "length", 1609.344, 0.0, ["mi"], ["miles"], ""),
    ("gram", "mass", 0.001, 0.0, ["g"], ["grams"], "kmuµ"),
    ("metric_ton", "mass", 1000.0, 0.0, ["t"], ["tonne", "tonnes"], ""),
    ("pound", "mass", 0.45359237, 0.0, ["lb"], ["lbs", "pounds"], ""),
    ("ounce", "mass", 0.028349523125, 0.0, ["oz"], ["ounces"], ""),
    ("watt", "power", 1.0, 0.0, ["W", "w"], ["watts", "Watt"], "kMGmuµ"),
    ("horsepower", "power", 745.6998715822702, 0.0, ["hp"], [], ""),
    ("watt_hour", "energy", 3600.0, 0.0, ["Wh"], [], "kMGm"),
    ("joule", "energy", 1.0, 0.0, ["J"], ["joules"], "kMG"),
    ("calorie", "energy", 4.184, 0.0, ["cal"], ["calories"], "k"),
    ("volt", "voltage", 1.0, 0.0, ["V", "v"], ["volts"], "kmuµ"),
    ("ampere_hour", "charge", 1.0, 0.0, ["Ah"], [], "km"),
    ("ampere", "current", 1.0, 0.0, ["A"], ["amp", "amps", "amperes"], "kmuµ"),
    ("ohm", "resistance", 1.0, 0.0, ["Ω"], ["ohms"], "kM"),
    ("liter", "volume", 0.001, 0.0, ["L", "l"], ["liters", "litre", "litres"], "mcuµ"),
    ("gallon", "volume", 0.003785411784, 0.0, ["gal"], ["gallons"], ""),
    ("byte", "information", 1e-9, 0.0, ["B"], ["bytes"], "kMGT"),
    ("bit", "information", 1.25e-10, 0.0, ["b"], ["bits"], "kMGT"),
    ("hertz", "frequency", 1.0, 0.0, ["Hz"], [], "kMGT"),
    ("second", "time", 1.0, 0.0, ["s"], ["sec", "secs", "seconds"], "muµn"),
    ("minute", "time", 60.0, 0.0, ["min"], ["mins", "minutes"], ""),
    ("hour", "time", 3600.0, 0.0, ["h"], ["hr", "hrs", "hours"], ""),
    ("day", "time", 86400.0, 0.0, [], ["days"], ""),
    ("kelvin", "temperature", 1.0, 0.0, ["K"], [], ""),
    ("degree_Celsius", "temperature", 1.0, 273.15, ["°C"], ["degC", "celsius"], ""),
    ("degree_Fahrenheit", "temperature", 5 / 9, 459.67 * 5 / 9, ["°F"], ["degF", "fahrenheit"], ""),
    ("degree", "angle", 1.0, 0.0, ["°", "deg"], ["degrees"], ""),
    ("pascal", "pressure", 1.0, 0.0, ["Pa"], ["pascals"], "kM"),
    ("bar", "pressure", 100000.0, 0.0, [], ["bars"], "m"),
    ("pound_force_per_square_inch", "pressure", 6894.757293168, 0.0, ["psi"], [], ""),
    ("revolution_per_minute", "rotation", 1.0, 0.0, ["rpm"], [], ""),
    ("pixel", "pixel", 1.0, 0.0, ["px"], ["pixels"], ""),
    ("megapixel", "pixel", 1e6, 0.0, ["MP"], ["megapixels"], ""),
    ("decibel", "level", 1.0, 0.0, ["dB"], ["decibels"], ""),
    ("lumen", "luminous_flux", 1.0, 0.0, ["lm"], ["lumens"], ""),
    ("pages_per_minute", "rate", 1.0, 0.0, ["ppm"], [], ""),
    ("percent", "dimensionless", 0.01, 0.0, ["%"], [], ""),
    ("piece", "dimensionless", 1.0, 0.0, ["pcs"], ["pc", "pieces"], ""),
    ("newton", "force", 1.0, 0.0, ["N"], ["newtons"], "kM"),
    ("newton_meter", "energy", 1.0, 0.0, ["Nm"], [], ""),
    ("candela", "luminous_intensity", 1.0, 0.0, ["cd"], ["candelas"], ""),
    ("lux", "illuminance", 1.0, 0.0, ["lx"], [], ""),
]

# Exponents of the base units that each dimension is made of, and how many of those one unit of
# the table above is at factor 1.
BASE_EXPONENTS = {
    "length": ({"meter": 1}, 1.0),
    "mass": ({"kilogram": 1}, 1.0),
    "time": ({"second": 1}, 1.0),
    "power": ({"kilogram": 1, "meter": 2, "second": -3}, 1.0),
    "energy": ({"kilogram": 1, "meter": 2, "second": -2}, 1.0),
    "voltage": ({"kilogram": 1, "meter": 2, "second": -3, "ampere": -1}, 1.0),
    "charge": ({"ampere": 1, "second": 1}, 3600.0),
    "current": ({"ampere": 1}, 1.0),
    "resistance": ({"kilogram": 1, "meter": 2, "second": -3, "ampere": -2}, 1.0),
    "volume": ({"meter": 3}, 1.0),
    "information": ({"gigabyte": 1}, 1.0),
    "frequency": ({"second": -1}, 1.0),
    "temperature": ({"kelvin": 1}, 1.0),
    "angle": ({"degree": 1}, 1.0),
    "pressure": ({"kilogram": 1, "meter": -1, "second": -2}, 1.0),
    "force": ({"kilogram": 1, "meter": 1, "second": -2}, 1.0),
    "rotation": ({"second": -1}, 1 / 60),
    "pixel": ({"pixel": 1}, 1.0),
    "level": ({"decibel": 1}, 1.0),
    "luminous_flux": ({"candela": 1}, 1.0),
    "luminous_intensity": ({"candela": 1}, 1.0),
    "illuminance": ({"candela": 1, "meter": -2}, 1.0),
    "rate": ({"second": -1}, 1 / 60),
    "dimensionless": ({}, 1.0),
}
# Names of base units' dimensions, and of products of them; others are spelled out.
BASE_DIMENSIONS = {
    "kilogram": "mass", "meter": "length", "second": "time", "ampere": "current", "kelvin": "temperature",
    "candela": "luminosity", "gigabyte": "information", "pixel": "pixel", "degree": "angle", "decibel": "level",
}
NAMED_DIMENSIONS = ["length", "mass", "time", "power", "energy", "voltage", "current", "resistance", "volume", "pressure", "force", "temperature"]

# Other spellings of units above.
SPELLINGS = [
    ("kWatt", "kilowatt"), ("м", "meter"), ("мм", "millimeter"), ("см", "centimeter"), ("км", "kilometer"), ("дюйм", "inch"), ("дюймов", "inch"),
    ("г", "gram"), ("гр", "gram"), ("кг", "kilogram"), ("мг", "milligram"), ("т", "metric_ton"),
    ("Вт", "watt"), ("кВт", "kilowatt"), ("МВт", "megawatt"), ("В", "volt"), ("А", "ampere"), ("мАч", "milliampere_hour"),
    ("кВтч", "kilowatt_hour"), ("л", "liter"), ("мл", "milliliter"), ("Гц", "hertz"), ("кГц", "kilohertz"),
    ("МГц", "megahertz"), ("ГГц", "gigahertz"), ("КБ", "kilobyte"), ("МБ", "megabyte"), ("ГБ", "gigabyte"),
    ("ТБ", "terabyte"), ("с", "second"), ("сек", "second"), ("мин", "minute"), ("ч", "hour"), ("дБ", "decibel"),
    ("шт", "piece"), ("Н", "newton"), ("кН", "kilonewton"),
]

_COMPUTER = ["laptop", "notebook", "computer", "pc", "ноутбук", "компьютер"]
_PHONE = ["phone", "smartphone", "mobile", "телефон", "смартфон"]
_TV = ["tv", "television", "monitor", "телевизор", "монитор"]
_APPLIANCE = ["refrigerator", "washing", "dishwasher", "oven", "холодильник", "стиральная", "посудомойка"]
_CAR = ["car", "auto", "vehicle", "машина", "автомобиль"]
_SIZES = ["dimension", "size", "width", "height", "length"]

# Product-type rules in order. Each row is
# (words the context must contain one of, words the column must contain one of,
#  word the column must not contain, pattern the column may match instead, unit).
# An empty context list means any product.
UNIT_RULES = [
    (_COMPUTER, ["dimension", "size", "размер"], None, None, "mm"),
    (_COMPUTER, ["screen", "display", "экран"], "resolution", None, "inch"),
    (_COMPUTER, ["resolution", "разрешение"], None, None, "pixel"),
    (_COMPUTER, ["weight", "вес"], None, None, "kg"),
    (_COMPUTER, ["ram", "memory", "storage", "память"], None, None, "GB"),
    (_PHONE, _SIZES, None, None, "mm"),
    (_PHONE, ["screen", "display"], "resolution", None, "inch"),
    (_PHONE, ["resolution"], None, None, "pixel"),
    (_PHONE, ["weight"], None, None, "g"),
    (_TV, ["screen", "display", "size"], "resolution", None, "inch"),
    (_TV, ["resolution"], None, None, "pixel"),
    (_TV, ["dimension", "width", "height"], None, None, "mm"),
    (_APPLIANCE, ["dimension", "size", "width", "height"], None, None, "cm"),
    (_APPLIANCE, ["weight"], None, None, "kg"),
    (_APPLIANCE, ["power", "мощность"], None, None, "W"),
    (_CAR, ["length", "width", "height"], None, None, "m"),
    (_CAR, ["power", "engine", "мощность"], None, None, "kW"),
    ([], ["resolution", "разрешение"], None, "[0-9]+x[0-9]+", "pixel"),
    ([], ["screen", "display", "inch", "дюйм"], None, None, "inch"),
    (["phone", "tablet", "телефон"], ["weight", "вес"], None, None, "g"),
    ([], ["weight", "вес"], None, None, "kg"),
    ([], ["power", "watt", "мощность"], None, None, "W"),
    ([], ["memory", "storage", "ram", "ssd", "память"], None, None, "GB"),
    (["phone", "tablet", "laptop", "телефон", "планшет", "ноутбук"], _SIZES, None, None, "mm"),
    (["tv", "monitor", "телевизор", "монитор"], _SIZES, None, None, "cm"),
    ([], _SIZES, None, None, "m"),
]

# Last-resort words looked for in column, product and category text.
CONTEXT_FALLBACK = [
    (["screen", "display", "экран", "диагональ"], "inch"),
    (["weight", "вес"], "kg"),
    (["power", "мощность"], "W"),
    (["memory", "storage", "память"], "GB"),
]
