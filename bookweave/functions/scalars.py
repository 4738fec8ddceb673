"""Column functions for numbers, times, ids and keys. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, step: int) -> Column:
    """Integer division rounding down, exact on BIGINT for negative values too."""
    return int_div(value - F.pmod(value, F.lit(step)), step)


def int_div(left: Column, right: Column | int) -> Column:
    """Truncating integer division (``div``), the rule of 64-bit integer code."""
    return F.call_function("div", left, right if isinstance(right, Column) else F.lit(right))


def bucket_start(ts_ns: Column, width_ns: int) -> Column:
    """Start of the fixed-width time bucket that holds ``ts_ns``."""
    return int_div(ts_ns, F.lit(width_ns)) * F.lit(width_ns)


def ns_to_timestamp(ts_ns: Column) -> Column:
    return F.timestamp_micros(int_div(ts_ns, 1000))


def ns_to_ntz(ts_ns: Column) -> Column:
    """Zone-less time, for labels that must not depend on the session's time zone."""
    micros = int_div(ts_ns, 1000)
    return F.call_function(
        "make_timestamp_ntz", F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
    ) + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))


def ms_to_ns(ts_ms: Column) -> Column:
    return ts_ms * F.lit(1_000_000)


def fixed_to_double(value: Column, scale: int) -> Column:
    return value.cast("double") / F.lit(float(scale))


def decimal_text_to_fixed(text: Column, digits: int = 8) -> Column:
    """``-?digits[.digits]`` to a scaled integer: the fraction is padded or cut (never rounded) and
    the sign is applied last; anything else gives null."""
    well_formed = text.rlike(r"^-?[0-9]+(\.[0-9]*)?$")
    negative = text.startswith("-")
    unsigned = F.regexp_replace(text, "^-", "")
    whole = F.split_part(unsigned, F.lit("."), F.lit(1))
    fraction = F.substring(F.rpad(F.split_part(unsigned, F.lit("."), F.lit(2)), digits, "0"), 1, digits)
    scaled = F.concat(whole, fraction).try_cast("bigint")
    return F.when(well_formed, F.when(negative, -scaled).otherwise(scaled))


def event_id(venue_id: Column, symbol_id: Column, seq: Column, ts_ns: Column) -> Column:
    """First 32 hex characters of sha256 over the big-endian bytes of the four numbers and four
    zero bytes."""

    def big_endian(value: Column, width: int) -> Column:
        return F.right(F.concat(F.lit("0" * width), F.hex(value.cast("bigint"))), F.lit(width))

    packed = F.concat(
        big_endian(venue_id, 8),
        big_endian(symbol_id, 8),
        big_endian(seq, 16),
        big_endian(ts_ns, 16),
        F.lit("00000000"),
    )
    return F.substring(F.sha2(F.unhex(packed), 256), 1, 32)


def sha256_of(*parts: Column) -> Column:
    """sha256 hex of the parts put together as UTF-8 text."""
    return F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)


def fixed_text(value: Column, digits: int = 6) -> Column:
    """A double as text with a fixed number of decimals, so hashed text is stable."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


# Domain keys of graph nodes.
def level_key(symbol_id: Column, venue_id: Column, price_fp: Column, side: Column) -> Column:
    return F.concat_ws(":", F.lit("pl"), symbol_id, venue_id, price_fp, side)


def symbol_key(symbol_id: Column) -> Column:
    return F.concat_ws(":", F.lit("sym"), symbol_id)


def venue_key(venue_id: Column) -> Column:
    return F.concat_ws(":", F.lit("ven"), venue_id)


def order_key(order_hash: Column) -> Column:
    return F.concat(F.lit("ord:"), order_hash)


def time_bucket_key(symbol_id: Column, ts_ns: Column) -> Column:
    return F.concat_ws(":", F.lit("tb"), symbol_id, ts_ns)


def decode(code: Column, names: list[str]) -> Column:
    """Code to name through a literal map of at most a dozen entries, ``Unknown(n)`` otherwise."""
    table = F.create_map(*[F.lit(x) for pair in enumerate(names) for x in pair])
    return F.coalesce(
        F.try_element_at(table, code), F.format_string("Unknown(%d)", code)
    )
