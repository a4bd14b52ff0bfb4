"""Filter expressions and functions on terms. Errors and unbound are null; truth values are SQL booleans.

A term is a Val where its kind and datatype are known, a Mixed where its values are decoded, else a struct column. Results whose datatype is fixed are Vals, so
nested expressions work on plain values, whatever their arguments are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import (
    BLANK, BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, DURATION, FLOAT, INTEGER, IRI, LANG_STRING, LITERAL, NUMERICS, STRING, STRINGS, TIME, XSD, Mixed, Val,
    col, decimal_text, double_of, double_text, is_literal_of, level, lit, named, null_of, one_of, term, us_of, v_bool, v_date, v_dbl, v_dec, v_dur, v_int, v_time, v_ts, v_us, val,
)

# Logic


@named
def ebv(t: Column) -> Column:
    """Effective boolean value: booleans, non-empty strings, numbers other than 0 and NaN; else an error."""
    if isinstance(t, Val) and t.text is None:
        if t.level is not None:
            return t.raw != 0 if t.level <= 1 else (v_dbl(t) != 0) & ~F.isnan(v_dbl(t))
        return t.raw if t.dt == BOOLEAN else F.length(t.raw) > 0 if t.dt in STRINGS else null_of("boolean")
    number = F.when(level(t) <= 1, v_dec(t) != 0).otherwise((v_dbl(t) != 0) & ~F.isnan(v_dbl(t)))
    bad = F.when((is_literal_of(t, BOOLEAN) | level(t).isNotNull()) & t.isNotNull(), False)  # ill-typed: false
    text = F.when(is_literal_of(t, *STRINGS, LANG_STRING), F.length(t["lex"]) > 0)
    return F.coalesce(v_bool(t), F.when(level(t).isNotNull(), number), bad, text)


@named
def ebv_or(t: Column, default: bool) -> Column:
    return F.coalesce(ebv(t), F.lit(default))


def boolean(b: Column) -> Val:
    """A truth value as a literal."""
    return val(b, BOOLEAN)


@named
def bound(t: Column) -> Column:
    return t.isNotNull()


@named
def if_(condition: Column, then: Column, other: Column) -> Column:
    if isinstance(then, Mixed) or isinstance(other, Mixed):
        return one_of([(condition, then), (~condition, other)])
    return F.when(condition, col(then)).when(~condition, col(other))


def coalesce(*terms) -> Val | Column:
    """The first that is no error."""
    if all(isinstance(x, Val) and x.kind == LITERAL and x.text is None and (x.dt, x.ntz) == (terms[0].dt, terms[0].ntz) for x in terms):
        return Val(LITERAL, terms[0].dt, F.coalesce(*[x.raw for x in terms]), ntz=terms[0].ntz)
    if any(isinstance(x, Mixed) for x in terms):
        return one_of([(x.isNotNull(), x) for x in terms])
    return F.coalesce(*map(col, terms))


@named
def is_iri(t: Column) -> Column:
    return t["kind"] == IRI


@named
def is_blank(t: Column) -> Column:
    return t["kind"] == BLANK


@named
def is_literal(t: Column) -> Column:
    return t["kind"] == LITERAL


@named
def is_numeric(t: Column) -> Column:
    return F.when(t.isNotNull(), is_literal_of(t, *NUMERICS))


# Comparison


def _same_shape(a, b) -> bool:
    return isinstance(a, Val) and isinstance(b, Val) and (a.kind, a.dt, a.prefix) == (b.kind, b.dt, b.prefix) and a.text is None and b.text is None


def _same_iri(a: Val, b: Val) -> Column:
    """Identity of IRIs or blank nodes; what a constant says about a key column is asked of the column."""
    if b.const is None and a.const is not None:
        a, b = b, a
    if _same_shape(a, b) and b.const is None:
        return a.raw == b.raw
    if b.const is not None and a.prefix:
        rest = b.const[len(a.prefix) :]
        return F.when(a.raw.isNotNull(), a.raw.cast("string") == rest if b.const.startswith(a.prefix) else F.lit(False))
    return a.lex == b.lex


@named
def same_term(a: Column, b: Column) -> Column:
    if isinstance(a, Val) and isinstance(b, Val):
        if (a.kind, a.dt) != (b.kind, b.dt):
            return F.when(a.isNotNull() & b.isNotNull(), False)
        if a.kind != LITERAL:
            return _same_iri(a, b)
        return a.raw == b.raw if a.dt in STRINGS else a.lex == b.lex
    return col(a) == col(b)


_OPS = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}


def _compare_double(a: Column, b: Column, op: str, a_const: bool = False, b_const: bool = False) -> Column:
    """IEEE 754: NaN is unordered and equals nothing; both zeros are equal. Spark has NaN above all and equal to itself."""
    plain = _OPS[op](a, b)
    if b_const:  # a NaN on the left is below nothing, as it should be
        return plain
    if a_const:
        return plain & ~F.isnan(b)
    return F.when(a.isNotNull() & b.isNotNull(), plain & ~F.isnan(b))


def _known_compare(a: Val, b: Val, op: str) -> Column:
    of = _OPS[op]
    if a.kind != LITERAL or b.kind != LITERAL:
        return null_of("boolean")
    if a.level is not None and b.level is not None:
        top = max(a.level, b.level)
        if top == 0:
            return of(a.raw, b.raw)
        if top == 1:
            return of(v_dec(a), v_dec(b))
        nan = [x.const is not None and x.const != "NaN" for x in (a, b)]
        return _compare_double(v_dbl(a), v_dbl(b), op, *nan)
    if a.dt in STRINGS and b.dt in STRINGS or a.dt == b.dt and a.dt in (BOOLEAN, DATE, TIME, DURATION):
        return of(a.raw, b.raw)
    if a.dt == b.dt == DATETIME:
        # A constant is an instant; beside a column without zone it becomes UTC without zone, so that it can be pushed down.
        x, y = ((F.to_utc_timestamp(v.raw, F.current_timezone()).cast("timestamp_ntz") if v.const is not None and w.ntz and not v.ntz else v.raw) for v, w in ((a, b), (b, a)))
        if a.ntz != b.ntz and a.const is None and b.const is None:
            x, y = v_us(a), v_us(b)
        return of(x, y)
    return null_of("boolean")


@named
def _compare(a: Column, b: Column, op: str) -> Column:
    """Null where the families differ or have no order."""
    if isinstance(a, Val) and isinstance(b, Val):
        return _known_compare(a, b, op)
    of = _OPS[op]
    both = lambda *types: is_literal_of(a, *types) & is_literal_of(b, *types)
    top = F.greatest(level(a), level(b))
    number = F.when(top == 0, of(v_int(a), v_int(b))).when(top == 1, of(v_dec(a), v_dec(b))).otherwise(_compare_double(v_dbl(a), v_dbl(b), op))
    return (
        F.when(level(a).isNotNull() & level(b).isNotNull(), number)
        .when(both(*STRINGS), of(a["lex"], b["lex"]))
        .when(both(BOOLEAN), of(v_bool(a), v_bool(b)))
        .when(both(DATETIME), of(v_ts(a), v_ts(b)))
        .when(both(DATE), of(v_date(a), v_date(b)))
        .when(both(TIME), of(v_time(a), v_time(b)))
        .when(both(DURATION), of(v_dur(a), v_dur(b)))
    )


@named
def eq(a: Column, b: Column) -> Column:
    """Equal values; terms without a known value are equal if identical, and unknown if they are not but could be."""
    if isinstance(a, Val) and isinstance(b, Val):
        family = lambda x: "number" if x.level is not None else "string" if x.dt in STRINGS else x.dt
        if a.kind == b.kind and a.kind != LITERAL:
            return _same_iri(a, b)
        if a.kind == b.kind and family(a) == family(b):
            return _known_compare(a, b, "=")
        return F.when(a.isNotNull() & b.isNotNull(), False)
    known = (*NUMERICS, *STRINGS, BOOLEAN, DATETIME, DATE, TIME, DURATION, LANG_STRING)
    unknown = (a["kind"] == LITERAL) & (b["kind"] == LITERAL) & ~(a["dt"].isin(*known) & b["dt"].isin(*known))
    value = _compare(a, b, "=")
    nan = F.coalesce(level(a) >= 2, F.lit(False)) & F.coalesce(level(b) >= 2, F.lit(False))
    return F.when(a.isNull() | b.isNull(), None).when((col(a) == col(b)) & ~nan, True).when(value.isNotNull(), value).when(unknown, None).otherwise(False)


@named
def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


@named
def lt(a: Column, b: Column) -> Column:
    return _compare(a, b, "<")


@named
def le(a: Column, b: Column) -> Column:
    return _compare(a, b, "<=")


@named
def gt(a: Column, b: Column) -> Column:
    return _compare(b, a, "<")


@named
def ge(a: Column, b: Column) -> Column:
    return _compare(b, a, "<=")


def in_(t: Column, *others: Column) -> Column:
    out = F.lit(False)
    for o in others:
        out = out | eq(t, o)
    return out


def not_in(t: Column, *others: Column) -> Column:
    return ~in_(t, *others)


# Terms and strings


@named
def str_(t: Column) -> Column:
    return val(F.when(t["kind"] != BLANK, t["lex"]), STRING)


@named
def lang(t: Column) -> Column:
    return val(F.when(is_literal(t), t["lang"]), STRING)


@named
def datatype(t: Column) -> Column:
    return Val(IRI, "", F.when(is_literal(t), t["dt"]))


@named
def text(t: Column) -> Column:
    """The characters of a string literal; else an error."""
    if isinstance(t, Val):
        return t.raw if t.kind == LITERAL and t.dt in STRINGS else null_of("string")
    return F.when(is_literal_of(t, *STRINGS, LANG_STRING), t["lex"])


@named
def lang_matches(tag: Column, range_: Column) -> Column:
    a, b = F.lower(text(tag)), F.lower(text(range_))
    return F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-"))))


@named
def strlen(t: Column) -> Column:
    return val(F.length(text(t)).cast("long"), INTEGER)


@named
def str_starts(t: Column, start: Column) -> Column:
    return text(t).startswith(text(start))


@named
def contains(t: Column, part: Column) -> Column:
    return text(t).contains(text(part))


@named
def str_ends(t: Column, end: Column) -> Column:
    return text(t).endswith(text(end))


@named
def position(t: Column, part: Column) -> Column:
    """Place of the first match from 1, 0 if there is none."""
    return val(F.call_function("locate", text(part), text(t)).cast("long"), INTEGER)


# Numbers


_decimal_text, _double_text = decimal_text, double_text
_NAMES = (INTEGER, DECIMAL, FLOAT, DOUBLE)


def _of_level(top: Column, whole: Column, exact: Column, wide: Column) -> Column:
    return (
        F.when(top == 0, lit(whole.try_cast("decimal(38,0)"), INTEGER))
        .when(top == 1, lit(_decimal_text(exact), DECIMAL))
        .when(top == 2, lit(_double_text(wide.cast("float")), FLOAT))
        .when(top == 3, lit(_double_text(wide), DOUBLE))
    )


def _number(args: tuple, top: Column, whole: Column, exact: Column, wide: Column) -> Mixed | Column:
    """A number of the level top; beside decoded terms with its values, so that what takes it reads no text."""
    made = lambda: _of_level(top, whole, exact, wide)
    if not any(isinstance(x, Mixed) for x in args):
        return made()
    integer = F.when(top == 0, whole.try_cast("decimal(38,0)"))
    decimal = F.when(top == 0, integer.try_cast("decimal(38,10)")).when(top == 1, exact.try_cast("decimal(38,10)"))
    double = F.when(top == 0, integer.cast("double")).when(top == 1, exact.cast("double")).when(top == 2, wide.cast("float").cast("double")).otherwise(F.when(top == 3, wide))
    # The level is told by the arguments' levels alone, also where the value is an error; else each level would hold all values.
    values = {"level": top, "v_int": integer, "v_dec": decimal, "v_dbl": double}
    some = double.isNotNull()
    parts = {"kind": F.when(some, F.lit(LITERAL).cast("tinyint")), "dt": F.when(some, F.get(F.array(*map(F.lit, _NAMES)), top)), "lang": F.when(some, "")}
    return Mixed(made, lambda name: values[name] if name in values else null_of(_TYPES[name]), some, parts)


#: Types of the values that a number doesn't have.
_TYPES = {"v_bool": "boolean", "v_ts": "timestamp", "v_date": "date", "v_time": "long", "v_dur": "long"}


def _numeric(args: tuple, whole, exact, wide, least: int = 0) -> Val | Column:
    """The result at the widest level of the arguments, least at least; of known types one branch is built, else all."""
    if all(isinstance(x, Val) for x in args):
        if any(x.level is None for x in args):
            return val(null_of("decimal(38,0)"), INTEGER)
        top = max(least, *[x.level for x in args])
        value = (v_int, v_dec, v_dbl, v_dbl)[top]
        made = (whole, exact, wide, wide)[top](*map(value, args))
        return val(made.try_cast("decimal(38,0)") if top == 0 else made.cast("decimal(38,10)") if top == 1 else made.cast("float") if top == 2 else made, _NAMES[top])
    known = F.lit(True)
    for x in args:
        known = known & level(x).isNotNull()
    top = F.when(known, F.greatest(*[level(x) for x in args], F.lit(least)))
    return _number(args, top, F.lit(None) if least else whole(*map(v_int, args)), exact(*map(v_dec, args)), wide(*map(v_dbl, args)))


def _binary(a, b, whole, exact, wide):
    return _numeric((a, b), whole, exact, wide)


@named
def add(a: Column, b: Column) -> Column:
    return _binary(a, b, F.try_add, F.try_add, lambda x, y: x + y)


@named
def subtract(a: Column, b: Column) -> Column:
    return _binary(a, b, F.try_subtract, F.try_subtract, lambda x, y: x - y)


@named
def multiply(a: Column, b: Column) -> Column:
    return _binary(a, b, F.try_multiply, lambda x, y: F.try_multiply(x.try_cast("decimal(22,9)"), y.try_cast("decimal(22,9)")), lambda x, y: x * y)


@named
def divide(a: Column, b: Column) -> Column:
    """Integers give a decimal; division by zero is an error for exact numbers and follows IEEE 754 for others."""

    def wide(x: Column, y: Column) -> Column:
        zero = F.when((x == 0) | F.isnan(x), float("nan")).when((x > 0) == ~y.cast("string").startswith("-"), float("inf")).otherwise(float("-inf"))
        return F.when(y == 0, zero).otherwise(F.try_divide(x, y))

    return _numeric((a, b), None, lambda x, y: F.try_divide(x.try_cast("decimal(20,6)"), y.try_cast("decimal(20,6)")), wide, least=1)


def _unary(t, whole, exact, wide):
    if isinstance(t, Val):
        return _numeric((t, t), *[lambda x, _, f=f: f(x) for f in (whole, exact, wide)])
    return _number((t,), level(t), whole(v_int(t)), exact(v_dec(t)), wide(v_dbl(t)))


@named
def plus(t: Column) -> Column:
    return _unary(t, *[lambda x: x] * 3)


@named
def minus(t: Column) -> Column:
    return _unary(t, *[lambda x: -x] * 3)


@named
def abs_(t: Column) -> Column:
    return _unary(t, F.abs, F.abs, F.abs)


@named
def ceil(t: Column) -> Column:
    return _unary(t, lambda x: x, F.ceil, lambda x: F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x))


@named
def floor(t: Column) -> Column:
    return _unary(t, lambda x: x, F.floor, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))


@named
def round_(t: Column) -> Column:
    """Halves go up."""
    half = F.lit("0.5").cast("decimal(2,1)")
    return _unary(t, lambda x: x, lambda x: F.floor(x + half), lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x + 0.5).cast("double")).otherwise(x))


@named
def mod(a: Column, b: Column) -> Column:
    return val(F.call_function("try_mod", v_int(a), v_int(b)), INTEGER)


@named
def larger(a: Column, b: Column) -> Column:
    return val(F.when(v_int(a).isNotNull() & v_int(b).isNotNull(), F.greatest(v_int(a), v_int(b))), INTEGER)


@named
def smaller(a: Column, b: Column) -> Column:
    return val(F.when(v_int(a).isNotNull() & v_int(b).isNotNull(), F.least(v_int(a), v_int(b))), INTEGER)


@named
def or_default(t: Column, default: Column) -> Column:
    """The term, or default where it is an error."""
    return coalesce(t, default)


# Dates, times, durations

_DATETIME = r"\A(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?\z"


def _div(x: Column, n: int) -> Column:
    """x / n rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n)).cast("long")


def _known_part(t: Val, k: int) -> Val:
    """A part of a dateTime, which a column holds in UTC, or of a date."""
    if t.dt == DATE:
        day, us = t.raw, null_of("long")
    else:
        us = us_of(t.raw, t.ntz)
        day, us = F.date_from_unix_date(_div(us, 86_400_000_000).cast("int")), F.pmod(us, F.lit(86_400_000_000))
    if k <= 3:
        return val((F.year, F.month, F.dayofmonth)[k - 1](day).cast("long"), INTEGER)
    if k == 6:
        return val((F.pmod(us, F.lit(60_000_000)).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,10)"), DECIMAL)
    return val(_div(us, 3_600_000_000) if k == 4 else _div(F.pmod(us, F.lit(3_600_000_000)), 60_000_000), INTEGER)


def _part(t: Column, k: int, dt: str = INTEGER) -> Column:
    """A part as written, in local time."""
    if isinstance(t, Val) and t.text is None and t.kind == LITERAL and t.dt in (DATETIME, DATE):
        return _known_part(t, k)
    got = F.nullif(F.regexp_extract(t["lex"], _DATETIME, k), F.lit(""))
    value = got.try_cast("decimal(20,6)") if dt == DECIMAL else got.try_cast("int")
    valid = F.coalesce(v_ts(t).isNotNull() | v_date(t).isNotNull(), F.lit(False))
    return val(F.when(valid, value.cast("decimal(38,10)" if dt == DECIMAL else "long")), dt)


@named
def year(t: Column) -> Column:
    return _part(t, 1)


@named
def month(t: Column) -> Column:
    return _part(t, 2)


@named
def day(t: Column) -> Column:
    return _part(t, 3)


@named
def hours(t: Column) -> Column:
    return _part(t, 4)


@named
def minutes(t: Column) -> Column:
    return _part(t, 5)


@named
def seconds(t: Column) -> Column:
    return _part(t, 6, DECIMAL)


def duration(us: Column) -> Val:
    """Microseconds as a dayTimeDuration."""
    return val(us, DURATION)


@named
def timezone(t: Column) -> Column:
    """The offset as written; an error without one."""
    if isinstance(t, Val) and t.text is None and t.dt == DATETIME:  # columns hold UTC
        return duration(F.when(t.raw.isNotNull(), F.lit(0).cast("long")))
    zone = F.nullif(F.regexp_extract(t["lex"], _DATETIME, 7), F.lit(""))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
    return duration(F.when(F.coalesce(v_ts(t).isNotNull() | v_date(t).isNotNull(), F.lit(False)), offset.cast("long") * 60_000_000))


@named
def epoch_ms(t: Column) -> Column:
    return val(_div(v_us(t), 1000), INTEGER)


@named
def epoch_us(t: Column) -> Column:
    return val(v_us(t), INTEGER)


def datetime_of_us(us: Column) -> Val:
    return val(F.timestamp_micros(us), DATETIME)


def datetime_of_ms(ms: Column) -> Column:
    return datetime_of_us(ms.cast("long") * 1000)


def make_datetime(y, mo, d, h, mi, s, zone: str = "Z") -> Column:
    lex = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d" + zone, *[c.cast("int") for c in (y, mo, d, h, mi, s)])
    made = lit(lex, DATETIME)
    return F.when(v_ts(made).isNotNull(), made)


def make_date(y, mo, d) -> Column:
    made = lit(F.format_string("%04d-%02d-%02d", *[c.cast("int") for c in (y, mo, d)]), DATE)
    return F.when(v_date(made).isNotNull(), made)


def date_of_days(days: Column) -> Column:
    return lit(F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd"), DATE)


@named
def microseconds(t: Column) -> Column:
    return val(F.pmod(v_us(t), F.lit(1_000_000)), INTEGER)


@named
def datetime_plus(t: Column, d: Column) -> Column:
    return datetime_of_us(v_us(t) + v_dur(d))


@named
def datetime_minus(t: Column, d: Column) -> Column:
    return datetime_of_us(v_us(t) - v_dur(d))


@named
def datetime_difference(a: Column, b: Column) -> Column:
    return duration(v_us(a) - v_us(b))


@named
def duration_add(a: Column, b: Column) -> Column:
    return duration(F.try_add(v_dur(a), v_dur(b)))


@named
def duration_subtract(a: Column, b: Column) -> Column:
    return duration(F.try_subtract(v_dur(a), v_dur(b)))


@named
def duration_multiply(d: Column, n: Column) -> Column:
    return duration(F.round(v_dur(d) * v_dbl(n)).cast("long"))


@named
def duration_divide(d: Column, n: Column) -> Column:
    return duration(F.round(F.try_divide(v_dur(d).cast("double"), v_dbl(n))).cast("long"))


@named
def duration_ratio(a: Column, b: Column) -> Column:
    return val(F.try_divide(v_dur(a).cast("decimal(20,0)"), v_dur(b).cast("decimal(20,0)")).cast("decimal(38,10)"), DECIMAL)


@named
def duration_negate(d: Column) -> Column:
    return duration(-v_dur(d))


def duration_zero() -> Column:
    return lit("PT0S", DURATION)


def make_duration(days, hours_, minutes_, seconds_) -> Column:
    return duration(((days * 24 + hours_) * 60 + minutes_).cast("long") * 60_000_000 + (seconds_ * 1_000_000).cast("long"))


@named
def duration_us(d: Column) -> Column:
    return val(v_dur(d), INTEGER)


@named
def duration_is_negative(d: Column) -> Column:
    return v_dur(d) < 0


@named
def duration_part(d: Column, unit: str) -> Column:
    """days, hours, minutes or seconds, with the duration's sign."""
    a, sign = F.abs(v_dur(d)), F.signum(v_dur(d)).cast("int")
    size = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000}
    whole = {"days": lambda: F.floor(a / size["days"]), "hours": lambda: F.floor(F.pmod(a, F.lit(size["days"])) / size["hours"]), "minutes": lambda: F.floor(F.pmod(a, F.lit(size["hours"])) / size["minutes"])}
    if unit == "seconds":
        return val(((F.pmod(a, F.lit(size["minutes"])) * sign).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,10)"), DECIMAL)
    return val(whole[unit]().cast("long") * sign, INTEGER)


# Casts

#: Least and greatest value of the bounded integer types.
RANGES = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
}


@named
def _cut(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


@named
def to_integer(t: Column, name: str = "integer") -> Column:
    finite = F.when(~F.isnan(v_dbl(t)) & (F.abs(v_dbl(t)) < 1e18), _cut(v_dbl(t)).try_cast("decimal(38,0)"))
    string = F.when(is_literal_of(t, *STRINGS) & t["lex"].rlike(r"\A[+-]?[0-9]+\z"), t["lex"]).try_cast("decimal(38,0)")
    value = F.coalesce(v_int(t), F.when(level(t) == 1, _cut(v_dec(t)).try_cast("decimal(38,0)")), F.when(level(t) >= 2, finite), v_bool(t).cast("int").cast("decimal(38,0)"), string)
    low, high = (F.lit(None if x is None else str(x)).cast("decimal(38,0)") for x in RANGES[name])
    inside = F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))
    return val(F.when(inside, value), XSD + name)


def _to_wide(t: Column, dt: str) -> Column:
    string = F.when(is_literal_of(t, *STRINGS), double_of(t["lex"]))
    value = F.coalesce(v_dbl(t), v_bool(t).cast("int").cast("double"), string)
    return val(value.cast("float") if dt == FLOAT else value, dt)


@named
def to_float(t: Column) -> Column:
    return _to_wide(t, FLOAT)


@named
def to_double(t: Column) -> Column:
    return _to_wide(t, DOUBLE)


@named
def to_decimal(t: Column) -> Column:
    string = F.when(is_literal_of(t, *STRINGS) & t["lex"].rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"), t["lex"]).try_cast("decimal(38,10)")
    wide = F.when(level(t) >= 2, v_dbl(t).try_cast("decimal(38,10)"))
    return val(F.coalesce(v_dec(t), wide, v_bool(t).cast("int").cast("decimal(38,10)"), string), DECIMAL)


@named
def to_boolean(t: Column) -> Column:
    number = F.when(level(t).isNotNull(), (v_dbl(t) != 0) & ~F.isnan(v_dbl(t)))
    string = F.when(is_literal_of(t, *STRINGS), F.when(t["lex"].isin("true", "1"), True).when(t["lex"].isin("false", "0"), False))
    return boolean(F.coalesce(v_bool(t), number, string))


@named
def to_string(t: Column, name: str = "string") -> Column:
    lex = {"string": t["lex"], "normalizedString": F.translate(t["lex"], "\t\n\r", "   "), "token": F.trim(F.regexp_replace(t["lex"], r"[ \t\n\r]+", " "))}[name]
    return val(F.when(t["kind"] != BLANK, lex), XSD + name)


def _retyped(t: Column, dt: str, value, *also: Column) -> Column:
    made = lit(F.coalesce(F.when(is_literal_of(t, *STRINGS, dt), t["lex"]), *also), dt)
    return F.when(value(made).isNotNull(), made)


@named
def to_datetime(t: Column) -> Column:
    return _retyped(t, DATETIME, v_ts, F.when(is_literal_of(t, DATE), F.concat(F.substring(t["lex"], 1, 10), F.lit("T00:00:00"), F.substring(t["lex"], 11, 6))))


@named
def to_date(t: Column) -> Column:
    if isinstance(t, Val) and t.text is None and t.dt == DATETIME:
        return val(F.date_from_unix_date(_div(us_of(t.raw, t.ntz), 86_400_000_000).cast("int")), DATE)
    return _retyped(t, DATE, v_date, F.when(is_literal_of(t, DATETIME), F.substring(t["lex"], 1, 10)))


@named
def to_time(t: Column) -> Column:
    if isinstance(t, Val) and t.text is None and t.dt == DATETIME:
        return val(F.pmod(us_of(t.raw, t.ntz), F.lit(86_400_000_000)), TIME)
    return _retyped(t, TIME, v_time, F.when(is_literal_of(t, DATETIME), F.substring_index(t["lex"], "T", -1)))
