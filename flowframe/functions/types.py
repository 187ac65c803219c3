"""The fixed-width types of a flow, their packed layout, and arithmetic that wraps at a width."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type name to bytes and Spark type. Unsigned 64-bit values above 2^63 need DECIMAL(20,0).
TYPES: dict[str, tuple[int, T.DataType]] = {
    "TINYINT": (1, T.ByteType()),
    "SMALLINT": (2, T.ShortType()),
    "INT": (4, T.IntegerType()),
    "BIGINT": (8, T.LongType()),
    "BIGUINT": (8, T.DecimalType(20, 0)),
    "FLOAT": (4, T.FloatType()),
    "DOUBLE": (8, T.DoubleType()),
}
TWO_64 = 1 << 64


def type_name(dtype: T.DataType) -> str:
    for name, (_, own) in TYPES.items():
        if own == dtype:
            return name
    raise ValueError(f"a flow has no type for {dtype.simpleString()}")


def layout(columns: list[tuple[str, str]]) -> list[tuple[str, str, int, int]]:
    """(name, type, offset, bytes) of each column of a packed row, in order."""
    rows, offset = [], 0
    for name, kind in columns:
        size = TYPES[kind][0]
        rows.append((name, kind, offset, size))
        offset += size
    return rows


def struct(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind][1], False) for name, kind in columns])


def unsigned(key: Column) -> Column:
    """A signed 64-bit value read as unsigned."""
    wide = key.cast("decimal(20,0)")
    return F.when(key < 0, wide + F.lit(Decimal(TWO_64)).cast("decimal(20,0)")).otherwise(wide)


def unsigned_mod(key: Column, n: int) -> Column:
    """Remainder of a signed 64-bit value read as unsigned; stays in 64 bits."""
    low = F.pmod(key, F.lit(n).cast("long"))
    return F.when(key < 0, F.pmod(low + F.lit(TWO_64 % n), F.lit(n).cast("long"))).otherwise(low)


def wrap(value: Column, bits: int) -> Column:
    """The low ``bits`` (8, 16 or 32) of a 64-bit value, sign-extended."""
    return F.shiftright(F.shiftleft(value, 64 - bits), 64 - bits)


def wrap_long(total: Column) -> Column:
    """A DECIMAL(38,0) total as it would stand in 64 signed bits."""
    two = F.lit(Decimal(TWO_64)).cast("decimal(38,0)")
    low = F.pmod(total.cast("decimal(38,0)"), two)
    return F.when(low >= F.lit(Decimal(1 << 63)).cast("decimal(38,0)"), low - two).otherwise(low).cast("long")


def default_value(kind: str) -> Column:
    """What a column of a type holds before anything is set: zero."""
    return F.lit(0).cast(TYPES[kind][1])


def _product_64(a: Column, b: Column) -> Column:
    """The low 64 bits of a product of two unsigned 64-bit numbers, as DECIMAL(38,0); by halves, as the whole has up to 39 digits."""
    half, two = F.lit(Decimal(1 << 32)).cast("decimal(38,0)"), F.lit(Decimal(TWO_64)).cast("decimal(38,0)")
    low = lambda x: F.pmod(x.cast("decimal(38,0)"), half).cast("decimal(10,0)")
    high = lambda x: ((x - low(x)) / half).cast("decimal(10,0)")
    middle = F.pmod((high(a) * low(b) + low(a) * high(b)).cast("decimal(38,0)"), half).cast("decimal(10,0)")
    return F.pmod((middle * half.cast("decimal(11,0)")).cast("decimal(38,0)") + (low(a) * low(b)).cast("decimal(38,0)"), two)


def _divided(a: Column, b: Column) -> Column:
    """Whole quotient of DECIMAL(20,0) numbers of 0 or more, in DECIMAL(20,0)."""
    return ((a - F.pmod(a, b)).cast("decimal(20,0)") / b).cast("decimal(20,0)")


def arithmetic(op: str, kind: str, a: Column, b: Column | int) -> Column:
    """``a op b`` (+, -, *, /) as a value of a flow type: whole numbers keep the low bits of the type's width and their quotients are cut off.

    A number in place of ``b`` counts in full before the result is narrowed. Whole numbers
    divided by zero are null; floating-point ones are infinite or NaN.
    """
    if kind in ("FLOAT", "DOUBLE"):
        x, y = a.cast("double"), (F.lit(float(b)) if isinstance(b, int) else b).cast("double")
        if op == "/":
            zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
            got = F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))
        else:
            got = {"+": x + y, "-": x - y, "*": x * y}[op]
        return got.cast(TYPES[kind][1])
    right = F.lit(b) if isinstance(b, int) else b
    if kind in ("BIGINT", "BIGUINT"):
        wide = lambda x: x.cast("decimal(38,0)")
        if op in "+-":
            got = wide(a) + wide(right) if op == "+" else wide(a) - wide(right)
        else:
            signed = kind == "BIGINT"
            two = F.lit(Decimal(TWO_64)).cast("decimal(38,0)")
            u, v = (F.pmod(wide(x), two).cast("decimal(20,0)") for x in (a, right))
            if op == "*":
                got = _product_64(u, v)
            else:
                size = lambda x, raw: (F.abs(wide(raw)) if signed else wide(x)).cast("decimal(20,0)")
                part = _divided(size(u, a), F.when(v != 0, size(v, right)))
                got = F.when((wide(a) < 0) != (wide(right) < 0), -part).otherwise(part) if signed else part
        if kind == "BIGINT":
            return wrap_long(got)
        return F.pmod(got.cast("decimal(38,0)"), F.lit(Decimal(TWO_64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    x, y = a.cast("long"), right.cast("long")
    got = F.call_function("div", x, F.when(y != 0, y)) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op]
    return wrap(got, 8 * TYPES[kind][0]).cast(TYPES[kind][1])


def lesser(kind: str, a: Column, b: Column) -> Column:
    """The lesser of two values of a type."""
    return F.least(a.cast(TYPES[kind][1]), b.cast(TYPES[kind][1]))


def greater(kind: str, a: Column, b: Column) -> Column:
    """The greater of two values of a type."""
    return F.greatest(a.cast(TYPES[kind][1]), b.cast(TYPES[kind][1]))
