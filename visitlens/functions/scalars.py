"""Small text and number helpers with the source system's null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Text, with the empty string counted as absent."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in cols])


def hash32(text: Column) -> Column:
    """Rolling 31-multiplier hash over UTF-16 units as base-36 text.

    The accumulator wraps to a signed 32-bit value at every unit. A character
    beyond the basic plane counts as its two surrogate units, so results agree
    with hashes computed in a browser.
    """
    def step(acc: Column, unit: Column) -> Column:
        return F.pmod(acc * F.lit(31) + unit + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)

    def absorb(acc: Column, code: Column) -> Column:
        high = F.lit(0xD800) + F.floor((code - F.lit(0x10000)) / F.lit(0x400))
        low = F.lit(0xDC00) + F.pmod(code - F.lit(0x10000), F.lit(0x400))
        return F.when(code < F.lit(0x10000), step(acc, code)).otherwise(
            step(step(acc, high), low))

    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    value = F.aggregate(codes, F.lit(0).cast("long"), absorb)
    digits = F.lower(F.conv(F.abs(value).cast("string"), 10, 36))
    return F.when(text == "", F.lit("0")).otherwise(
        F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), digits))


def payload(data: Column, field: str) -> Column:
    """One field of a JSON payload as text; null when absent or malformed."""
    return F.get_json_object(data, f"$.{field}")


def payload_struct(data: Column, schema: str) -> Column:
    """Several payload fields in one parse, for jobs that need more than two."""
    return F.from_json(data, schema)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    A column used inside a lambda is otherwise computed again for every
    element the lambda runs on.
    """
    return F.get(F.transform(F.array(value), use), 0)


def payload_number(data: Column, field: str) -> Column:
    return payload(data, field).try_cast("double")


def email_domain(email: Column) -> Column:
    """Second ``@`` part of an address, null when there is none."""
    return F.get(F.split(email, "@"), 1)


def as_ts(value) -> Column:
    """Literal or column as a timestamp."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")
