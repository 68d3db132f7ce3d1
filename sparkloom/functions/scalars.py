"""Scalar helpers: sizes, times, application ids and storage kinds, as column expressions."""
from pyspark.sql import functions as F

# fixed values: unit names by powers of 1024, the prefix of cluster application ids, the bits of storage kinds
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
APP_PREFIX = "application_"
KINDS = {"memory": 1, "localfile": 2, "hdfs": 4}


def human_bytes(n, largest="EiB"):
    """1536 as '1.50 KiB'; whole bytes below 1024, null for null. Units end with the largest.

    The two digits are those of the double n / 1024^k, rounded by its exact value and at a tie to the even digit, as printf
    does; format_string rounds its shortest text and ties up.
    """
    n = n.cast("long")
    exact = F.coalesce(n.cast("double").try_cast("long"), n)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    units = UNITS[1 : UNITS.index(largest) + 1]
    for power, unit in enumerate(units, 1):
        scaled = F.concat(_two_digits(exact, 10 * power), F.lit(f" {unit}"))
        out = out.otherwise(scaled) if power == len(units) else out.when(n < 1024 ** (power + 1), scaled)
    return out


def _two_digits(n, bits):
    """n / 2^bits with two digits; n is a double's value, so beyond 2^60 its low eight bits are zero."""
    if bits == 60:
        n, bits = F.shiftright(n, 8), 52
    rest = n.bitwiseAND(F.lit((1 << bits) - 1)) * 100
    cut, over, half = F.shiftright(rest, bits), rest.bitwiseAND(F.lit((1 << bits) - 1)), 1 << (bits - 1)
    up = (over > half) | ((over == half) & (cut % 2 == 1))
    hundredths = F.shiftright(n, bits) * 100 + cut + up.cast("long")
    return F.concat(F.call_function("div", hundredths, F.lit(100)).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def parsed_size(text):
    """Bytes of '14M', '20g', '512' or '1.5 GiB', powers of 1024; null for anything else."""
    t = F.upper(F.trim(text))
    number, unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([KMGTPE]?)(?:I?B)?$", 1), F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([KMGTPE]?)(?:I?B)?$", 2)
    power = F.lit(0)
    for k, u in enumerate("KMGTPE", 1):
        power = F.when(unit == u, k).otherwise(power)
    return F.when(number != "", (number.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def whole_minutes(ms):
    """Milliseconds as whole minutes in a double; the division drops the rest first, in whole numbers."""
    return _floor_div(ms, 60000).cast("double")


def whole_gb(n):
    return _floor_div(n, 1 << 30).cast("double")


def _floor_div(n, by):
    """n / by rounded down; a double quotient would be rounded up near a whole number from some 2^53 on."""
    n, by = n.cast("long"), F.lit(by).cast("long")
    return F.call_function("div", n, by) - (n % by < 0).cast("long")


def app_id(raw):
    """(kind, cluster, id, attempt) of an application id: three numbers after the prefix, a bad one being 0; else 'other'."""
    parts = F.split(F.substring(raw, len(APP_PREFIX) + 1, 2**30), "_")
    ours = F.startswith(raw, F.lit(APP_PREFIX)) & (F.size(parts) == 3)
    number = lambda i: F.when(ours, F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0)))
    return F.struct(F.when(ours, "cluster").otherwise("other").alias("kind"), number(0).alias("cluster"), number(1).alias("number"), number(2).alias("attempt"))


def has_kind(kinds, name):
    """Whether the storage kinds, a sum of bits, hold this one."""
    return kinds.bitwiseAND(F.lit(KINDS[name])) != 0
