"""Scalar functions: arithmetic without errors, labels, time parts, geography, vectors, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = F.lit


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def quotient(a: Column, b: Column) -> Column:
    """Division of doubles: a number by zero is an infinity, zero by zero NaN."""
    infinite = F.when(b.cast("string").startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, a * infinite).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": quotient, "%": modulo, "^": F.pow}
COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def clamp(v: Column, low: float, high: float) -> Column:
    if low > high:
        return F.lit(float("nan"))
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def log_or_nan(f, v: Column) -> Column:
    """Logarithms of zero are -Infinity, of negative numbers NaN; null stays."""
    return F.when(v > 0, f(v)).when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan")))


def whole(f, v: Column) -> Column:
    """A rounding ``f`` that gives a double of the number's sign; numbers of 2**53 and more, which are whole, infinities and NaN stay."""
    return F.when(F.abs(v) < float(1 << 53), F.abs(f(v)).cast("double") * F.signum(v)).otherwise(v)


MATH = {
    "abs": F.abs, "ceil": lambda v: whole(F.ceil, v), "floor": lambda v: whole(F.floor, v), "round": lambda v: whole(F.round, v), "exp": F.exp,
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)).when(v < 0, F.lit(float("nan"))), "sgn": F.signum, "ln": lambda v: log_or_nan(F.ln, v),
    "deg": F.degrees, "rad": F.radians, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "log2": lambda v: log_or_nan(F.log2, v), "log10": lambda v: log_or_nan(F.log10, v),
}


def plain_number(v: Column) -> Column:
    """A number as label text: the shortest form, whole numbers without a point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))


def time_part(name: str, ts: Column) -> Column:
    """UTC parts of nanosecond times, as doubles."""
    t = F.timestamp_micros(F.floor(ts / 1000).cast("long"))
    parts = {
        "hour": F.hour, "minute": F.minute, "month": F.month, "year": F.year, "day_of_month": F.dayofmonth, "day_of_week": lambda x: F.dayofweek(x) - 1,
        "days_in_month": lambda x: F.dayofmonth(F.last_day(x)), "day_of_year": F.dayofyear,
    }
    return ts / F.lit(1e9) if name == "timestamp" else parts[name](t).cast("double")


def label_replace(source: Column, pattern: str, replacement: str, otherwise: Column) -> Column:
    """The replacement where the whole source matches, else ``otherwise``; $1 refers to groups."""
    whole = f"^(?:{pattern})$"
    text = F.coalesce(source, F.lit(""))
    return F.when(F.rlike(text, F.lit(whole)), F.regexp_replace(text, whole, replacement)).otherwise(otherwise)


def short_hash(v: Column) -> Column:
    """The first 8 bytes of SHA-256, as hex."""
    return F.substring(F.sha2(v.cast("string"), 256), 1, 16)


def masked(v: Column, how: str, secret: str | None = None) -> Column:
    """redact: ***; hash: SHA-256, keyed by a secret as HMAC; truncate: three bytes and dots if longer."""
    if how == "redact":
        return F.lit("***")
    if how == "hash":
        return F.sha2(v, 256) if secret is None else hmac_sha256(v, secret)
    return F.when(F.octet_length(v) > 3, F.concat(F.substring(v, 1, 3), F.lit("..."))).otherwise(v)


def hmac_sha256(v: Column, secret: str) -> Column:
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, v.cast("binary")), 256))), 256)


EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, degrees: Column, metres: Column) -> tuple[Column, Column]:
    a, t, d = F.radians(lat), F.radians(degrees), metres / EARTH_M
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 540.0, F.lit(360.0)) - 180.0


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; a box may cross the antimeridian (west > east)."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def in_polygon(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) corners."""
    crossings = F.lit(0)
    for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True):
        if a != c:
            hit = ((F.lit(a) > lat) != (F.lit(c) > lat)) & (lon < (d - b) * (lat - a) / (c - a) + b)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, length: int = 6) -> Column:
    """Base-32 cells from interleaved bits, longitude first; plain arithmetic, no UDF."""
    bits = 5 * length
    nlon, nlat = (bits + 1) // 2, bits // 2
    cell = lambda x, lo, hi, n: F.least(F.greatest(F.floor((x - lo) / (hi - lo) * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell(lon, -180.0, 180.0, nlon), cell(lat, -90.0, 90.0, nlat)
    out = []
    for k in range(length):
        code = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * k + j
            source, n = (x, nlon) if i % 2 == 0 else (y, nlat)
            code = code * 2 + F.shiftright(source, n - 1 - i // 2).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(_BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash_box(code: Column, length: int) -> tuple[Column, Column, Column, Column]:
    """(south, west, north, east) of a cell of ``length`` characters, as columns."""
    nlon, nlat = (5 * length + 1) // 2, 5 * length // 2
    x = y = F.lit(0).cast("long")
    for k in range(length):
        value = F.instr(F.lit(_BASE32), F.substring(code, k + 1, 1)) - 1
        for j in range(5):
            bit = F.shiftright(value, 4 - j).bitwiseAND(F.lit(1)).cast("long")
            if (5 * k + j) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    w, h = 360.0 / (1 << nlon), 180.0 / (1 << nlat)
    return y * h - 90.0, x * w - 180.0, (y + 1) * h - 90.0, (x + 1) * w - 180.0


def geohash_neighbours(code: Column, length: int) -> Column:
    """The eight cells around a cell, as an array; at a pole fewer (distinct) ones."""
    h, w = 180.0 / (1 << (5 * length // 2)), 360.0 / (1 << ((5 * length + 1) // 2))
    south, west, _, _ = geohash_box(code, length)
    middle = F.struct((south + h / 2).alias("lat"), (west + w / 2).alias("lon"))
    steps = F.array(*[F.struct(F.lit(i * h).alias("i"), F.lit(j * w).alias("j")) for i in (1, 0, -1) for j in (-1, 0, 1) if i or j])
    # lambdas keep each expression once in the plan
    around = lambda m: F.transform(steps, lambda o: F.struct((m["lat"] + o["i"]).alias("lat"), (F.pmod(m["lon"] + o["j"] + 540.0, F.lit(360.0)) - 180.0).alias("lon")))
    points = F.filter(F.transform(F.array(middle), around)[0], lambda p: p["lat"].between(-90.0, 90.0))
    return F.array_distinct(F.transform(points, lambda p: geohash(p["lat"], p["lon"], length)))


def in_circle(lat: Column, lon: Column, centre_lat: float, centre_lon: float, metres: float) -> Column:
    """Within ``metres`` of a point, the edge included."""
    return haversine(lat, lon, F.lit(centre_lat), F.lit(centre_lon)) <= metres


def geohash_center(code: str) -> tuple[float, float]:
    """(lat, lon) of the middle of a cell."""
    box = [[-180.0, 180.0], [-90.0, 90.0]]
    for i, bit in enumerate(b for c in code for b in f"{_BASE32.index(c):05b}"):
        side = box[i % 2]
        side[bit == "0"] = (side[0] + side[1]) / 2
    return sum(box[1]) / 2, sum(box[0]) / 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def derived(op: str, a: Column, b: Column) -> Column:
    """add, subtract, multiply, divide and ratio, where dividing by zero gives 0."""
    if op in ("divide", "ratio"):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))
    return {"add": a + b, "subtract": a - b, "multiply": a * b}[op]


def json_path(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, "$." + path)


def glob(v: Column, pattern: str) -> Column:
    """* matches anything, everything else itself."""
    return F.rlike(v, F.lit("^" + ".*".join(map(_quoted, pattern.split("*"))) + "$"))


def _quoted(text: str) -> str:
    import re

    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def tokens(v: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(v), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= least))


def valid_metric(v: Column) -> Column:
    return F.coalesce(F.rlike(v, F.lit(r"^[A-Za-z_][A-Za-z0-9_.:\-]*$")) & (F.length(v) <= 256), F.lit(False))


def valid_tag_key(v: Column) -> Column:
    return F.coalesce(F.rlike(v, F.lit(r"^[A-Za-z_][A-Za-z0-9_.\-]*$")) & (F.length(v) <= 128), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
