"""RDF terms as Spark columns: STRUCT<kind, lex, dt, lang>, with '' for what a term doesn't have; null is unbound."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of terms.
IRI, BLANK, LITERAL, VARIABLE, DEFAULT_GRAPH = 0, 1, 2, 3, 4
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LANG_STRING = RDF + "langString"
#: The integer family, and all numeric types by level of promotion.
INTEGERS = tuple(
    XSD + n
    for n in ("integer", "int", "long", "short", "byte", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger")
)
DECIMAL, FLOAT, DOUBLE, INTEGER, BOOLEAN = XSD + "decimal", XSD + "float", XSD + "double", XSD + "integer", XSD + "boolean"
NUMERICS = (*INTEGERS, DECIMAL, FLOAT, DOUBLE)
STRING, DATETIME, DATE, TIME, DURATION = XSD + "string", XSD + "dateTime", XSD + "date", XSD + "time", XSD + "dayTimeDuration"
STRINGS = (STRING, *(XSD + n for n in ("normalizedString", "token", "language", "Name", "NCName", "NMTOKEN")))

TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
QUAD = T.StructType([T.StructField(n, TERM) for n in "spog"])


def plain(kind, lex, dt="", lang="") -> Column:
    """A term whose parts are known not to be null; its constant parts fold into what is asked of it."""
    return F.struct(_col(kind).cast("tinyint").alias("kind"), _col(lex).cast("string").alias("lex"), _col(dt).alias("dt"), _col(lang).alias("lang"))


class Val:
    """A term whose kind and datatype are known when the query is built, held as its plain value; null is unbound or an error.

    Functions choose the branch for it at once, and its text is made only where a query shows or compares text. raw holds
    integers and decimals as such, booleans, timestamps, dates, times and durations in microseconds, else characters; IRIs
    and blank nodes what follows their prefix. text: the lexical form of a constant that isn't written as raw would be.
    """

    __slots__ = ("kind", "dt", "raw", "sure", "prefix", "text", "ntz", "const")

    def __init__(self, kind: int, dt: str, raw: Column, sure: bool = False, prefix: str = "", text: str | None = None, ntz: bool = False, const: str | None = None):
        self.kind, self.dt, self.raw, self.sure, self.prefix, self.text, self.ntz, self.const = kind, dt, raw, sure, prefix, text, ntz, const

    @property
    def level(self) -> int | None:
        return LEVELS.get(self.dt) if self.kind == LITERAL else None

    @property
    def lex(self) -> Column:
        if self.text is not None:
            return F.when(self.raw.isNotNull(), self.text)
        if self.kind != LITERAL:
            return F.concat(F.lit(self.prefix), self.raw.cast("string")) if self.prefix else self.raw.cast("string")
        if self.dt == DATETIME:
            return datetime_text(self.raw, self.ntz)
        spell = {1: decimal_text, 2: lambda x: double_text(x.cast("float")), 3: double_text}.get(self.level) or _SPELL.get(self.dt)
        return spell(self.raw) if spell else self.raw.cast("string")

    @property
    def column(self) -> Column:
        made = plain(self.kind, self.lex, self.dt)
        return made if self.sure else F.when(self.raw.isNotNull(), made)

    def __getitem__(self, part: str) -> Column:
        if part == "lex":
            return self.lex
        known = {"kind": F.lit(self.kind).cast("tinyint"), "dt": F.lit(self.dt), "lang": F.lit("")}[part]
        return known if self.sure else F.when(self.raw.isNotNull(), known)

    def isNull(self) -> Column:  # noqa: N802
        return self.raw.isNull()

    def isNotNull(self) -> Column:  # noqa: N802
        return self.raw.isNotNull()

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


class Mixed:
    """A term whose type differs from row to row, with its values beside it: they are read from its text once.

    read gives the value that a function such as v_int asks for, and some whether the term is bound; its text is made only
    where a query shows or compares text.
    """

    __slots__ = ("_term", "read", "some", "parts")

    def __init__(self, term: Callable[[], Column], read: Callable[[str], Column], some: Column, parts: dict[str, Column] | None = None):
        # parts: those of the term that are known without its text.
        self._term, self.read, self.some, self.parts = cache(term), cache(read), some, parts or {}

    @property
    def column(self) -> Column:
        return self._term()

    def __getitem__(self, part: str) -> Column:
        return self.parts[part] if part in self.parts else self.column[part]

    def isNull(self) -> Column:  # noqa: N802
        return ~self.some

    def isNotNull(self) -> Column:  # noqa: N802
        return self.some

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


#: Level of promotion by numeric type: integer, decimal, float, double.
LEVELS = {**dict.fromkeys(INTEGERS, 0), DECIMAL: 1, FLOAT: 2, DOUBLE: 3}


def val(raw: Column, dt: str) -> Val:
    return Val(LITERAL, dt, raw)


def col(x) -> Column:
    """A term as a struct column."""
    return x.column if isinstance(x, (Val, Mixed)) else x


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


#: A term without a known type prints longer than this if it is worth naming.
_LONG = 200


def named(f):
    """Binds long arguments of f that have no known type, so that nested expressions grow in proportion."""

    @wraps(f)
    def call(*args, **options):
        for k, x in enumerate(args):
            if isinstance(x, Column) and len(str(x)) > _LONG:
                rest = lambda v, k=k: col(call(*args[:k], v, *args[k + 1 :], **options))
                return F.get(F.transform(F.array(x), lambda v: rest(v)), F.lit(0))
        return f(*args, **options)

    return call


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def decimal_text(x: Column) -> Column:
    return F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+\z", "")


def double_text(x: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(x.cast("string"))


def us_of(raw: Column, ntz: bool) -> Column:
    """Microseconds since 1970 of an instant, or of a time of day and date that stands for UTC."""
    if not ntz:
        return F.unix_micros(raw)
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    return F.unix_micros((raw if zone in ("UTC", "Etc/UTC", "GMT", "Z") else F.convert_timezone(F.lit("UTC"), F.lit(zone), raw)).cast("timestamp"))


def _clock_text(us: Column) -> Column:
    rest = F.pmod(us, F.lit(86_400_000_000))
    return F.concat(F.format_string("%02d:%02d:%02d.%06d", F.floor(rest / 3_600_000_000), F.floor(F.pmod(rest, F.lit(3_600_000_000)) / 60_000_000), F.floor(F.pmod(rest, F.lit(60_000_000)) / 1_000_000), F.pmod(rest, F.lit(1_000_000))), F.lit("Z"))


def datetime_text(raw: Column, ntz: bool = False) -> Column:
    if not ntz:
        raw = F.to_utc_timestamp(raw, F.current_timezone())
    return F.concat(F.date_format(raw, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def duration_text(us: Column) -> Column:
    a = F.abs(us)
    days, rest = F.floor(a / 86_400_000_000).cast("long"), F.pmod(a, F.lit(86_400_000_000))
    h, m = F.floor(rest / 3_600_000_000).cast("long"), F.floor(F.pmod(rest, F.lit(3_600_000_000)) / 60_000_000).cast("long")
    s = F.pmod(rest, F.lit(60_000_000)).cast("decimal(20,6)") / F.lit(1_000_000).cast("decimal(10,0)")
    unit = lambda x, u: F.when(x == 0, "").otherwise(F.concat(x.cast("string"), F.lit(u)))
    clock = F.concat(unit(h, "H"), unit(m, "M"), F.when(s == 0, "").otherwise(F.concat(decimal_text(s), F.lit("S"))))
    body = F.concat(unit(days, "D"), F.when(clock == "", "").otherwise(F.concat(F.lit("T"), clock)))
    return F.when(us == 0, "PT0S").otherwise(F.concat(F.when(us < 0, "-P").otherwise("P"), body))


_SPELL = {
    BOOLEAN: lambda x: F.when(x, "true").when(~x, "false"),
    DATE: lambda x: F.date_format(x, "yyyy-MM-dd"),
    TIME: _clock_text,
    DURATION: duration_text,
}


def term(kind: int, lex, dt="", lang="") -> Column:
    """A term, or null where its lexical form, datatype or language is null."""
    lex, dt, lang = _col(lex).cast("string"), _col(dt), _col(lang)
    made = F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang"))
    return F.when(lex.isNotNull() & dt.isNotNull() & lang.isNotNull(), made)


def iri(lex) -> Column:
    return term(IRI, lex)


def bnode(label) -> Column:
    return term(BLANK, label)


def lit(value, dt: str | None = None, lang: str | None = None) -> Column:
    """A literal. Python booleans, integers and floats have their XSD types; others are strings."""
    if lang is not None:
        return term(LITERAL, value, LANG_STRING, _col(lang))
    if dt is None:
        dt = BOOLEAN if isinstance(value, bool) else INTEGER if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING
    if isinstance(value, bool):
        value = str(value).lower()
    return term(LITERAL, value, dt)


def default_graph() -> Column:
    return term(DEFAULT_GRAPH, "")


UNBOUND = lambda: F.lit(None).cast(TERM)


def is_literal_of(t, *types: str) -> Column:
    if isinstance(t, Val):
        known = F.lit(t.kind == LITERAL and t.dt in types)
        return known if t.sure else F.when(t.raw.isNotNull(), known)
    return (t["kind"] == LITERAL) & t["dt"].isin(*types)


def typed(kind: str, of):
    """f(t) for terms of unknown type; of(t) gives a known one's value, or None where it has none of this type."""

    def wrap(f):
        general = named(f)

        @wraps(f)
        def call(t):
            if isinstance(t, Mixed):
                return t.read(f.__name__)
            if not isinstance(t, Val):
                return general(t)
            known = of(t)
            return null_of(kind) if known is None else known

        return call

    return wrap


def _of_type(*types: str):
    return lambda t: t.raw if t.kind == LITERAL and t.dt in types else None


@typed("int", lambda t: None if t.level is None else F.when(t.raw.isNotNull(), t.level))
def level(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double, else null."""
    dt = t["dt"]
    of = F.when(dt.isin(*INTEGERS), 0).when(dt == DECIMAL, 1).when(dt == FLOAT, 2).when(dt == DOUBLE, 3)
    return F.when(t["kind"] == LITERAL, of)


def _lexical(t: Column, pattern: str) -> Column:
    return F.when(t["lex"].rlike(pattern), t["lex"])


@typed("decimal(38,0)", lambda t: t.raw.cast("decimal(38,0)") if t.level == 0 else None)
def v_int(t: Column) -> Column:
    return F.when(level(t) == 0, _lexical(t, r"\A[+-]?[0-9]+\z").try_cast("decimal(38,0)"))


def v_long(t) -> Column:
    """An integer as a long."""
    return t.raw.cast("long") if isinstance(t, Val) and t.level == 0 else v_int(t).cast("long")


@typed("decimal(38,10)", lambda t: t.raw.cast("decimal(38,10)") if t.level in (0, 1) else None)
def v_dec(t: Column) -> Column:
    """Integers and decimals."""
    return F.when(level(t) <= 1, _lexical(t, r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z").try_cast("decimal(38,10)"))


@named
def double_of(lex: Column) -> Column:
    named = F.when(lex.isin("INF", "+INF"), float("inf")).when(lex == "-INF", float("-inf")).when(lex == "NaN", float("nan"))
    return F.coalesce(named, F.when(lex.rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), lex).try_cast("double"))


def _known_double(t: Val) -> Column | None:
    if t.level is None:
        return None
    return t.raw.cast("float").cast("double") if t.level == 2 else t.raw.cast("double")


@typed("double", _known_double)
def v_dbl(t: Column) -> Column:
    """Any numeric; floats at their own precision."""
    v = double_of(t["lex"])
    return F.when(level(t) == 2, v.cast("float").cast("double")).when(level(t).isNotNull(), v)


@typed("boolean", _of_type(BOOLEAN))
def v_bool(t: Column) -> Column:
    return F.when(is_literal_of(t, BOOLEAN), F.when(t["lex"].isin("true", "1"), True).when(t["lex"].isin("false", "0"), False))


@typed("timestamp", lambda t: None if t.dt != DATETIME else F.timestamp_micros(us_of(t.raw, True)) if t.ntz else t.raw)
def v_ts(t: Column) -> Column:
    return F.when(is_literal_of(t, DATETIME), _lexical(t, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\z").try_cast("timestamp"))


def v_us(t) -> Column:
    """A dateTime in microseconds since 1970."""
    return us_of(t.raw, t.ntz) if isinstance(t, Val) and t.dt == DATETIME else F.unix_micros(v_ts(t))


@typed("date", _of_type(DATE))
def v_date(t: Column) -> Column:
    return F.when(is_literal_of(t, DATE), F.substring(_lexical(t, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?\z"), 1, 10).try_cast("date"))


@typed("long", _of_type(TIME))
def v_time(t: Column) -> Column:
    """Microseconds since midnight UTC."""
    ts = F.concat(F.lit("1970-01-01T"), _lexical(t, r"\A[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\z")).try_cast("timestamp")
    return F.when(is_literal_of(t, TIME), F.unix_micros(ts))


_DURATION = r"\A(-?)P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?\z"


@typed("long", _of_type(DURATION))
def v_dur(t: Column) -> Column:
    """A dayTimeDuration in microseconds."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t["lex"], _DURATION, k), F.lit("")).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
    seconds = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    sign = F.when(F.regexp_extract(t["lex"], _DURATION, 1) == "-", -1).otherwise(1)
    good = t["lex"].rlike(_DURATION) & t["lex"].rlike("[0-9][DHMS]") & ~t["lex"].endswith("T")
    return F.when(is_literal_of(t, DURATION) & good, (seconds * 1_000_000).try_cast("long") * sign)


def key(t) -> Column:
    """One string for each term, for joins of materialised tables."""
    return F.concat_ws("|", t["kind"].cast("string"), t["dt"], t["lang"], t["lex"])


#: One pass over a dayTimeDuration: sign, days, hours, minutes, seconds.
_DURATION_ONCE = r"\A(-?)P(?!\z)(?:([0-9]+)D)?(?:T(?!\z)(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?\z"


def values_of(t: Column) -> Column:
    """What mixed() needs of a term: each pattern is matched at most once, and only against terms of types that it is for."""
    parts = F.when(is_literal_of(t, DURATION), F.split(F.regexp_replace(t["lex"], _DURATION_ONCE, "$1|$2|$3|$4|$5"), "[|]"))
    same = {"level": level, "v_int": v_int, "v_dec": v_dec, "v_bool": v_bool, "v_ts": v_ts, "v_date": v_date, "v_time": v_time}
    return F.struct(
        F.when(level(t).isNotNull(), double_of(t["lex"])).alias("wide"), parts.alias("parts"),
        *[f(t).alias(n) for n, f in same.items()],
    )


def mixed(t: Column, values: Column) -> Mixed:
    """A term with the column of its values."""

    def dur() -> Column:
        part = lambda k, unit: F.coalesce(F.get(values["parts"], F.lit(k)).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)")) * unit
        us = ((part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1)) * 1_000_000).try_cast("long")
        return F.when(F.size(values["parts"]) == 5, us * F.when(values["parts"][0] == "-", -1).otherwise(1))

    made = {
        "v_dbl": lambda: F.when(values["level"] == 2, values["wide"].cast("float").cast("double")).otherwise(values["wide"]),
        "v_dur": dur,
    }
    return Mixed(lambda: t, lambda name: made[name]() if name in made else values[name], t.isNotNull())


def one_of(choices: list[tuple[Column, Val | Mixed | Column]]) -> Mixed:
    """The term of the first condition that is true, with its values."""

    def first(of) -> Column:
        out = F.when(choices[0][0], of(choices[0][1]))
        for condition, x in choices[1:]:
            out = out.when(condition, of(x))
        return out

    return Mixed(lambda: first(col), lambda name: first(READERS[name]), F.coalesce(first(lambda x: x.isNotNull()), F.lit(False)))


#: Functions that read a term's value, by name.
READERS = {f.__name__: f for f in (level, v_int, v_dec, v_dbl, v_bool, v_ts, v_date, v_time, v_dur)}


def order_key(t) -> Column:
    """Orders unbound, blank nodes, IRIs, literals; numbers by value, then booleans, dateTimes, dates, then the rest; ties by term.

    Terms of mixed types have one binary key, whose byte order is that.
    """
    if not isinstance(t, Val):
        return _order_key(t if isinstance(t, Mixed) else Mixed(lambda: t, lambda name: READERS[name](t), t.isNotNull()))
    if t.kind == LITERAL and t.text is None:  # one type: its values have this order
        return F.struct(t.raw.isNotNull().alias("bound"), t.raw.alias("value"))
    return F.struct(t.raw.isNotNull().alias("bound"), t.lex.alias("value"))


_DIGITS, _HEX = "0123456789", "0123456789abcdef"


def _reversed(x: Column, digits: str) -> Column:
    """Digits whose order is the opposite."""
    return F.translate(x, digits, digits[::-1])


def _double_hex(x: Column) -> Column:
    """16 hexadecimal digits in the order of doubles; both zeros alike, NaN last."""
    s = F.format_string("%a", F.abs(x))  # 0x1.8p3, or 0x0.8p-1022 where the exponent field is 0
    exponent = F.when(F.substring(s, 3, 1) == "1", F.substring_index(s, "p", -1).try_cast("int") + 1023).otherwise(0)
    bits = F.concat(F.lower(F.hex(exponent + 2048)), F.rpad(F.substring_index(F.substring(s, 5, 20), "p", 1), 13, "0"))
    bits = F.when(F.abs(x) == float("inf"), "fff" + "0" * 13).otherwise(bits)
    return F.when(F.isnan(x), "f" * 16).when(x < 0, _reversed(bits, _HEX)).otherwise(bits)


def _long_hex(x: Column) -> Column:
    """16 hexadecimal digits in the order of longs."""
    return F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _exact_text(whole: Column, exact: Column) -> Column:
    """Text in the order of exact numbers, those without one first."""
    s = F.coalesce(exact.cast("string"), F.concat(whole.cast("string"), F.lit("." + "0" * 10)))
    size = F.lpad(F.length(F.regexp_replace(F.substring_index(s, ".", 1), "-", "")).cast("string"), 2, "0")
    digits = F.concat(size, F.translate(s, "-.", ""))
    return F.when(s.isNull(), "0").when(s.startswith("-"), F.concat(F.lit("1"), _reversed(digits, _DIGITS))).otherwise(F.concat(F.lit("2"), digits))


def _order_key(t: Mixed) -> Column:
    families = [(3, v_dbl(t), _double_hex), (4, v_bool(t), lambda x: F.when(x, "01").otherwise("00")), (5, v_ts(t), lambda x: _long_hex(F.unix_micros(x))), (6, v_date(t), lambda x: _long_hex(F.unix_date(x)))]
    head = F.when(t.isNull(), "00").when(t["kind"] == BLANK, "01").when(t["kind"] == IRI, "02")
    for code, value, spell in families:
        head = head.when(value.isNotNull(), F.concat(F.lit(f"0{code}"), spell(value)))
    exact = F.when(v_dbl(t).isNotNull(), _exact_text(v_int(t), v_dec(t))).otherwise("")
    # A zero character within a part is followed by a one, its end by a zero.
    ended = [F.concat(F.replace(F.coalesce(t[part], F.lit("")), F.lit("\0"), F.lit("\0\1")), F.lit("\0\0")) for part in ("lex", "dt", "lang")]
    return F.concat(F.unhex(head.otherwise("07")), F.concat(exact, *ended).cast("binary"))
