"""Names, identifiers and binary numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPLY_POWER = ("VPWR", "VPB", "VDD")
SUPPLY_GROUND = ("VGND", "VNB", "VSS")


def base_name(cell: Column) -> Column:
    """What follows the last double underscore, without a drive strength."""
    return F.regexp_replace(F.substring_index(cell, "__", -1), "_[0-9]+$", "")


def instance_base_name(cell: Column) -> Column:
    return F.coalesce(F.nullif(base_name(cell), F.lit("")), cell)


def needs_escape(name: Column) -> Column:
    return ~F.coalesce(name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.lit(False))


def escape_identifier(name: Column) -> Column:
    """As Verilog writes it: a backslash before and a space behind, where needed."""
    return F.when(needs_escape(name), F.concat(F.lit("\\"), name, F.lit(" "))).otherwise(name)


def supply_kind(name: Column) -> Column:
    return F.when(name.isin(*SUPPLY_POWER), "power").when(name.isin(*SUPPLY_GROUND), "ground").otherwise("signal")


#: Base 94 digits that any long has at most.
_CODE_DIGITS = 10


def id_code(n: Column) -> Column:
    """A waveform's short name for a signal: base 94 from '!', lowest digit first; any n of a long that isn't negative."""
    n = n.cast("long")
    out = F.chr((n % 94) + 33)
    for k in range(1, _CODE_DIGITS):
        rest = F.call_function("div", n, F.lit(94**k))
        out = F.concat(out, F.when(rest > 0, F.chr((rest % 94) + 33)).otherwise(""))
    return out


def unsigned(body: Column, at: int, n: int) -> Column:
    """n big-endian bytes from byte at (0 is the first) as a number."""
    return F.conv(F.hex(F.substring(body, at + 1, n)), 16, 10).cast("long")


def signed(body: Column, at: int, n: int) -> Column:
    value, half = unsigned(body, at, n), 1 << (8 * n - 1)
    return F.when(value >= half, value - 2 * half).otherwise(value)


def ibm_real(hex8: Column) -> Column:
    """An eight-byte real with a base-16 exponent (excess 64), from 16 hexadecimal digits."""
    first = F.conv(F.substring(hex8, 1, 2), 16, 10).cast("long")
    mantissa = F.conv(F.substring(hex8, 3, 14), 16, 10).cast("double")
    value = mantissa * F.pow(F.lit(16.0), (first % 128) - 64 - 14)
    return F.when(first >= 128, -value).otherwise(value)
