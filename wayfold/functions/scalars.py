"""Small scalar functions: plate codes, digits, feature bits, hashing, dates, LSH curves. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 70 symbols of plate codes in order of their digit.
PLATE_SYMBOLS = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789京沪津渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼台*"
#: Half-months of the report: month, first day, last day, label.
PERIODS = ((7, 1, 15, "Jul 1-15"), (7, 16, 31, "Jul 16-31"), (8, 1, 15, "Aug 1-15"), (8, 16, 31, "Aug 16-31"))
#: Distance tolerance of track similarity by cell level, in metres.
TOLERANCE = {12: 1000, 13: 800, 14: 600, 15: 400, 16: 200, 17: 100, 18: 50, 19: 50, 20: 50}


def base70(text: Column) -> Column:
    """Number of a plate; a symbol outside the alphabet is an error."""

    def step(acc: Column, c: Column) -> Column:
        at = F.instr(F.lit(PLATE_SYMBOLS), c)
        return acc * 70 + F.when(at > 0, (at - 1).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no plate symbol: "), c)).cast("long"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def base70_text(number: Column, digits: int = 10) -> Column:
    """Plate of a number; leading '#' digits are lost."""
    symbols = F.split(F.lit(PLATE_SYMBOLS), "")
    powers = [70**k for k in range(digits - 1, -1, -1)]
    text = F.concat(*[F.get(symbols, F.pmod(F.floor(number / F.lit(p)) if p > 1 else number, F.lit(70)).cast("int")) for p in powers])
    return F.regexp_replace(text, "^#+", "")


def digit_info(n: Column) -> Column:
    """struct<top, magnitude>: the first three digits and how many follow; 0 gives (1, 0), seven digits or more (999, 3)."""
    text = n.cast("string")
    size = F.length(text)
    top = F.when(n == 0, 1).when(size >= 7, 999).when(size >= 3, F.substring(text, 1, 3).cast("int")).otherwise(n.cast("int"))
    return F.struct(top.alias("top"), F.when((n == 0) | (size < 3), 0).when(size >= 7, 3).otherwise(size - 3).cast("int").alias("magnitude"))


def log3(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(3.0))


def feature_bits(pci: Column, ssb: Column, grade: Column, count: Column, overlap: bool = False) -> Column:
    """Packed cell feature: pci, 7-bit ssb, 3-bit grade (A to E, else 5), 8-bit log3 of the count. ``overlap`` puts the grade
    into the count's upper bits, as old data has it."""
    level = F.coalesce(F.nullif(F.instr(F.lit("ABCDE"), F.upper(grade)), F.lit(0)) - 1, F.lit(5))
    at = F.shiftleft(level, 3 if overlap else 8)
    return F.shiftleft(pci, 18).bitwiseOR(F.shiftleft(ssb, 11)).bitwiseOR(at).bitwiseOR(F.floor(log3(count)).cast("int"))


def universal_hash(x: Column, a: int, b: int, p: Column | int) -> Column:
    return F.pmod(x * F.lit(a) + F.lit(b), F.lit(p) if isinstance(p, int) else p)


def next_prime(n: int) -> int:
    """The least prime above ``n``."""
    k = n + 1
    while k < 2 or any(k % d == 0 for d in range(2, int(k**0.5) + 1)):
        k += 1
    return k


def epoch_seconds(text: Column, noon_quirk: bool = False) -> Column:
    """Seconds of 'yyyy-MM-dd HH:mm:ss'; ``noon_quirk`` reads 12:xx as 00:xx, as a 12-hour pattern does."""
    seconds = F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return seconds - F.when(F.substring(text, 12, 2) == "12", 43200).otherwise(0) if noon_quirk else seconds


def day_key(text: Column) -> Column:
    return F.substring(text, 1, 10)


def time_slot(capturetime: Column, day: Column, span: int = 120) -> Column:
    """Number of the slot of ``span`` seconds since the day's midnight."""
    return F.floor((capturetime - F.unix_timestamp(day.cast("timestamp"))) / span).cast("int")


def intervals_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Closed intervals [a, b] and [c, d] share a moment."""
    return ~((b < c) | (d < a))


def period(day: Column, periods=PERIODS) -> Column:
    """Label of the half-month of a date, whatever the year; null outside."""
    out = None
    for month, lo, hi, label in periods:
        hit = (F.month(day) == month) & F.dayofmonth(day).between(lo, hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def hit_chance(s: Column, rows: int, bands: int) -> Column:
    """Chance that sets of similarity ``s`` share a band: 1 - (1 - s^rows)^bands."""
    return 1 - F.pow(1 - F.pow(s, F.lit(rows)), F.lit(bands))


def threshold(rows: int, bands: int) -> float:
    return (1 / bands) ** (1 / rows)


def bands_for(rows: int, s: float, chance: float) -> int:
    from math import log

    return int(log(1 - chance) / log(1 - s**rows) + 0.5)


# ---------------------------------------------------------------- integer codings


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("long")))


def varint_size(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    out = F.lit(1)
    for k in range(1, 10):
        out = out + F.when(F.shiftrightunsigned(n, 7 * k) != 0, 1).otherwise(0)
    return out


def interleave(a: Column, b: Column) -> Column:
    """The bits of two 32-bit numbers in turn, those of ``a`` lowest."""

    def spread(x: Column) -> Column:
        x = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        for k, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, k)).bitwiseAND(F.lit(mask))
        return x

    return spread(a).bitwiseOR(F.shiftleft(spread(b), 1))
