"""Tags, places, hashes and small sums as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIXED = "__mixed__"
NO_LOCATION = "__no_location__"


def tag_text(tags: Column, name: str) -> Column:
    """A tag of a JSON object as trimmed text, empty is null."""
    return F.nullif(F.trim(F.get_json_object(tags, f"$.{name}")), F.lit(""))


def first_number(text: Column, kind: str = "double") -> Column:
    """The first of a text's space-separated parts as a number, else null."""
    return F.get(F.split(F.trim(text), r"\s+"), F.lit(0)).try_cast(kind)


def join_device(make: Column, model: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))), F.lit(""))


def split_device(device: Column) -> Column:
    """(make, model) at the first space."""
    parts = F.split(device, " ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("make"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("model"))


def device_of(model: Column, product: Column, android: Column, name: Column) -> Column:
    """A device's name in capitals, blank ones aside, else the messenger's or unknown."""
    upper = F.upper(name)
    guess = F.when(upper.contains("WA-") | upper.contains("-WA"), "WHATSAPP").otherwise("DESCONOCIDO")
    return F.coalesce(F.upper(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (model, product, android)])), guess)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_threshold(similarity: int) -> int:
    """Most differing bits at a similarity in percent."""
    return int((100 - similarity) / 100 * 64 + 0.5)


def similarity_percent(distance: Column) -> Column:
    return F.round((F.lit(64) - distance) / F.lit(64.0) * 100).cast("int")


def sharpness_percent(score: Column) -> Column:
    """Between 2 and 100 on a logarithmic scale; none for no score."""
    scaled = F.log1p(score) / F.log1p(F.lit(400.0)) * 100
    return F.when(score > 0, F.greatest(F.least(scaled, F.lit(100.0)), F.lit(2.0))).otherwise(F.lit(0.0))


def hash_from_hex(text: Column) -> Column:
    """Sixteen hex digits as a signed long."""
    high = F.conv(F.substring(F.lpad(text, 16, "0"), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.lpad(text, 16, "0"), 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hash_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hash_for_mode(precise: Column, fast: Column, use_fast: bool) -> Column:
    return fast if use_fast else precise


def scaled(value: Column, digits: int, even: bool = False) -> Column:
    """A double times a power of ten as a whole number, rounded from its exact binary value: halves away from zero, or to even.

    The double is split in two halves of 26 bits, whose products with twice the power
    are exact for up to eight digits, so that 1.115, which is a little less, gives 111.
    """
    power = 10**digits
    x = F.abs(value)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    low = x - high
    n = F.floor(x * power).cast("double")
    over = (high * (2 * power) - (2 * n + 1)) + low * (2 * power)
    up = (over > 0) | ((over == 0) & (n % 2 == 1)) if even else over >= 0
    return F.when(value < 0, -1).otherwise(1).cast("long") * (n.cast("long") + up.cast("long"))


def hundredths(value: Column) -> Column:
    return scaled(value, 2).cast("int")


def fixed_text(value: Column, digits: int, even: bool = False) -> Column:
    """A double with so many decimals; negative ones keep their sign, zero included."""
    n = F.abs(scaled(value, digits, even))
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.call_function("div", n, F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def geo_cell(latitude: Column, longitude: Column) -> Column:
    """Cells of a hundredth of a degree, as two integers and as the key of a place cache (`-0.00` for small negatives)."""
    cell = lambda c: hundredths(c)
    text = lambda c: F.concat(F.when(c < 0, "-").otherwise(""), F.floor(F.abs(cell(c)) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cell(c)) % 100).cast("string"), 2, "0"))
    return F.struct(cell(latitude).alias("lat_cell"), cell(longitude).alias("lon_cell"), F.concat(text(latitude), F.lit(","), text(longitude)).alias("geo_cell"))


def valid_position(latitude: Column, longitude: Column) -> Column:
    """Whether both are given and in range; null if neither is."""
    return F.when(latitude.isNotNull() | longitude.isNotNull(), F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False)))


#: The signs of degrees, minutes and seconds, and of directions.
UNITS = {"°": 0, "d": 0, "'": 1, "′": 1, '"': 2, "″": 2}
SOUTH_WEST, DIRECTIONS = ("S", "W"), ("N", "S", "E", "W")


def _decimal(text: Column) -> Column:
    """A number of plain digits with one point at most, inside; null for any other text."""
    parts = F.split(text, "[.]")
    digits = F.forall(parts, lambda x: (x != "") & (F.translate(x, "0123456789", "") == ""))
    return F.when(digits & (F.size(parts) <= 2), text.try_cast("double"))


def _signed(text: Column) -> Column:
    negative = text.startswith("-")
    return F.when(negative, -_decimal(F.substr(text, F.lit(2)))).otherwise(_decimal(text))


def _angle(text: Column) -> Column:
    """Signed degrees of a trimmed text of numbers that each have a unit, in the units' order and with none left out, and perhaps a direction last; null for any other text."""
    mark = "([0-9.]+)\\s*([" + "".join(UNITS) + "])"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(mark), F.lit(1)), _decimal)
    units = F.regexp_extract_all(text, F.lit(mark), F.lit(2))
    rank = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    in_order = F.transform(units, lambda u: F.try_element_at(rank, u)) == F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), F.size(units))
    rest = F.regexp_replace(F.regexp_replace(text, mark, ""), "\\s", "")
    direction = F.upper(rest)
    ends_well = (rest == "") | (direction.isin(*DIRECTIONS) & (F.right(text, F.lit(1)) == rest))
    part = lambda i: F.coalesce(F.get(numbers, F.lit(i)), F.lit(0.0))
    size = part(0) + part(1) / 60 + part(2) / 3600
    good = (F.size(units) > 0) & in_order & ends_well & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(good, F.when(direction.isin(*SOUTH_WEST), -size).otherwise(size))


def parse_position(text: Column) -> Column:
    """Decimal degrees, or degrees, minutes and seconds with or without a direction; null if neither."""
    trimmed = F.trim(text)
    return F.coalesce(_signed(trimmed), _angle(trimmed))


def parse_pair(text: Column) -> Column:
    """(latitude, longitude) of a decimal pair in range, or of texts of degrees with directions, which say what is which; the last of each counts. Null if one is missing."""
    words = F.filter(F.split(F.replace(text, F.lit(","), F.lit(" , ")), "\\s+"), lambda x: x != "")
    two = (F.size(words) == 2) | ((F.size(words) == 3) & (F.get(words, F.lit(1)) == ","))
    lat, lon = _signed(F.get(words, F.lit(0))), _signed(F.get(words, F.size(words) - 1))
    # Texts up to each letter of a direction, of which an angle is what begins at the last number of degrees.
    upto = F.regexp_extract_all(text, F.lit("([^NSEWnsew]*[NSEWnsew])"), F.lit(1))
    angles = F.transform(upto, lambda x: F.struct(F.upper(F.right(x, F.lit(1))).alias("to"), _angle(F.regexp_extract(x, "([0-9.]+\\s*[°d][^°d]*)$", 1)).alias("at")))
    last = lambda signs: F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.transform(F.filter(angles, lambda x: x["to"].isin(*signs) & x["at"].isNotNull()), lambda x: x["at"])), -1)
    north, east = last(("N", "S")), last(("E", "W"))
    made = lambda x, y: F.struct(x.alias("latitude"), y.alias("longitude"))
    return F.when(two & lat.isNotNull() & lon.isNotNull() & valid_position(lat, lon), made(lat, lon)).when(north.isNotNull() & east.isNotNull(), made(north, east))


def gps_text(latitude: Column, longitude: Column) -> Column:
    """Degrees with five decimals and directions."""
    part = lambda v, plus, minus: F.concat(fixed_text(F.abs(v), 5), F.lit("° "), F.when(v >= 0, plus).otherwise(minus))
    return F.concat(part(latitude, "N", "S"), F.lit(", "), part(longitude, "E", "W"))


def degrees_text(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds with one decimal."""
    tenths = F.round(F.abs(value) * 36000).cast("long")
    return F.concat(
        F.floor(tenths / 36000).cast("string"), F.lit("°"), F.floor(tenths % 36000 / 600).cast("string"), F.lit("'"), F.format_string("%d.%d", F.floor(tenths % 600 / 10).cast("long"), (tenths % 10).cast("long")), F.lit('"'), F.when(value >= 0, positive).otherwise(negative)
    )


def position_ref(value: Column, positive: str, negative: str) -> Column:
    return F.when(value >= 0, positive).otherwise(negative)


def place_name(city: Column, town: Column, village: Column, municipality: Column, county: Column, country: Column) -> Column:
    return F.nullif(F.concat_ws(", ", F.coalesce(city, town, village, municipality, county), country), F.lit(""))


def progress_percent(done: Column, total: Column) -> Column:
    # Multiplied first, as a share may be no exact double where its percentage is one: 14,500 of 100,000 are 14.5.
    return F.when(total > 0, F.round(done * F.lit(100.0) / total).cast("int")).otherwise(F.lit(0))


def mixed_value(column: Column) -> Column:
    """An aggregate: the one value of all rows (null if all are null), or MIXED."""
    text = column.cast("string")
    same = (F.min(text).eqNullSafe(F.max(text))) & ((F.count(text) == F.count("*")) | (F.count(text) == 0))
    return F.when(same, F.min(text)).otherwise(F.lit(MIXED))


def position_state(latitude: Column, longitude: Column) -> Column:
    """An aggregate: none (no row has a latitude), some, equal (all are at one place) or mixed."""
    n, total = F.count(latitude), F.count("*")
    at = F.struct(latitude.alias("a"), longitude.alias("o"))
    return F.when(n == 0, "none").when(n < total, "some").when(F.min(at).eqNullSafe(F.max(at)), "equal").otherwise("mixed")


def shared_position(latitude: Column, longitude: Column) -> Column:
    """An aggregate: (mixed, latitude, longitude) of a selection; the position only where all rows share one."""
    state = position_state(latitude, longitude)
    return F.struct(state.isin("some", "mixed").alias("mixed"), F.when(state == "equal", F.min(latitude)).alias("latitude"), F.when(state == "equal", F.min(longitude)).alias("longitude"))


def sign_hash(vector: Column) -> Column:
    """64 signs of a vector as a long, the first the lowest bit; elements that are null or missing count as 0, and so does a null vector. The vector is evaluated once."""
    zero = F.lit(0).cast("long")
    bits = F.transform(vector, lambda x, i: F.when((x > 0) & (i < 64), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))
    return F.coalesce(F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b)), zero)
