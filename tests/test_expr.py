"""Values of single expressions, as (expression, lexical form or truth value)."""

from quadframe.functions import expr as e
from quadframe.functions import terms as t
from quadframe.operators import commit
from quadframe.sources import nquads
from quadframe.sources.mapping import Const, I, L

F = t.F
D, DT, DEC, DBL, FLT = t.DURATION, t.DATETIME, t.DECIMAL, t.DOUBLE, t.FLOAT


def c(value, dt=None, lang=None):
    return L(value, dt, lang).column


def cases():
    NAN, INF = c("NaN", DBL), c("INF", DBL)
    return {
        "string is not integer": (e.eq(c("3"), c(3)), False),
        "same value": (e.eq(c("03", t.INTEGER), c("3.0", DEC)), True),
        "same instant": (e.eq(c("2020-01-01T00:00:00Z", DT), c("2020-01-01T02:00:00+02:00", DT)), True),
        "language tags differ": (e.eq(c("a", lang="en"), c("a", lang="fr")), False),
        "language tag and plain": (e.eq(c("a", lang="en"), c("a")), False),
        "boolean 1 and true": (e.eq(c("1", t.BOOLEAN), c(True)), True),
        "unknown types": (e.eq(c("a", "urn:x"), c("b", "urn:x")), None),
        "unknown but same": (e.eq(c("a", "urn:x"), c("a", "urn:x")), True),
        "iri and literal": (e.eq(I("a").column, c(I("a").lex)), False),
        "same term": (e.same_term(c(3), c("3.0", DEC)), False),
        "nan": (e.eq(NAN, NAN), False), "nan less": (e.lt(NAN, c(1.0)), False), "nan not less": (e.ge(NAN, c(1.0)), False),
        "zeros": (e.eq(c("-0.0", DBL), c("0.0", DBL)), True), "inf": (e.gt(INF, c(1e300)), True), "inf inf": (e.eq(INF, INF), True),
        "date order": (e.lt(c("2020-01-01", t.DATE), c("2020-01-02", t.DATE)), True),
        "time order": (e.lt(c("10:00:00", t.TIME), c("11:00:00Z", t.TIME)), True),
        "date and dateTime": (e.lt(c("2020-01-01", t.DATE), c("2020-01-02T00:00:00Z", DT)), None),
        "false before true": (e.lt(c(False), c(True)), True),
        "error or true": ((e.lt(c("a"), c(1)) | e.eq(c(1), c(1))), True), "error and false": ((e.lt(c("a"), c(1)) & e.eq(c(1), c(2))), False), "error and true": ((e.lt(c("a"), c(1)) & e.eq(c(1), c(1))), None),
        "in": (e.in_(c(2), c(1), c("2.0", DEC)), True), "not in": (e.not_in(c(2), c(1)), True),
        "ebv empty": (e.ebv(c("")), False), "ebv zero": (e.ebv(c("0.0", DEC)), False), "ebv nan": (e.ebv(NAN), False), "ebv bad number": (e.ebv(c("x", t.INTEGER)), False), "ebv iri": (e.ebv(I("a").column), None),
        "ebv unknown": (e.ebv(c("a", "urn:x")), None), "ebv default": (e.ebv_or(I("a").column, True), True),
        "numeric": (e.is_numeric(c("1", t.XSD + "byte")), True), "not numeric": (e.is_numeric(c("1")), False),
        "if": (e.if_(e.ebv(c(1)), c("y"), c("n")), "y"), "if error": (e.if_(e.ebv(I("a").column), c("y"), c("n")), None), "coalesce": (e.coalesce(e.strlen(c(1)), c("z")), "z"),
        "str of blank": (e.str_(Const(t.BLANK, "b").column), None), "lang": (e.lang(c("a", lang="en")), "en"), "datatype": (e.datatype(c("a", lang="en")), t.LANG_STRING),
        "langmatches": (e.lang_matches(c("en-GB"), c("EN")), True), "langmatches prefix": (e.lang_matches(c("eng"), c("en")), False), "langmatches star": (e.lang_matches(c(""), c("*")), False),
        "strlen": (e.strlen(c("é😀")), "2"), "strstarts empty": (e.str_starts(c("a"), c("")), True), "contains": (e.contains(c("abc"), c("bc")), True), "strends": (e.str_ends(c("abc"), c("ab")), False), "string of number": (e.contains(c(12), c("1")), None),
        "add": (e.add(c(1), c("0.5", DEC)), "1.5"), "add float": (e.add(c("1.5", FLT), c(1)), "2.5"), "subtract": (e.subtract(c(1), c(3)), "-2"), "multiply": (e.multiply(c("1.5", DEC), c(2)), "3"),
        "divide": (e.divide(c(1), c(4)), "0.25"), "divide by zero": (e.divide(c(1), c(0)), None), "divide double": (e.divide(c(1.0), c(0)), "INF"), "minus inf": (e.divide(c(-1.0), c(0.0)), "-INF"), "zero by zero": (e.divide(c(0.0), c(0.0)), "NaN"), "add string": (e.add(c(1), c("a")), None),
        "round half": (e.round_(c("-2.5", DEC)), "-2"), "round up": (e.round_(c("2.5", DEC)), "3"), "ceil": (e.ceil(c("1.2", DEC)), "2"), "floor": (e.floor(c(-1.5)), "-2.0"), "abs": (e.abs_(c(-3)), "3"), "nested": (e.minus(e.abs_(e.add(c(-3), e.multiply(c(2), c(-2))))), "-7"),
        "mod": (e.mod(c(7), c(3)), "1"), "mod zero": (e.mod(c(7), c(0)), None), "larger": (e.larger(c(7), c(3)), "7"), "default": (e.or_default(e.mod(c(7), c(0)), c(0)), "0"),
        "year": (e.year(c("2020-02-03T23:30:01.5-05:00", DT)), "2020"), "day is local": (e.day(c("2020-02-03T23:30:01.5-05:00", DT)), "3"), "seconds": (e.seconds(c("2020-02-03T23:30:01.5-05:00", DT)), "1.5"), "timezone": (e.timezone(c("2020-02-03T23:30:01.5-05:00", DT)), "-PT5H"), "no zone": (e.timezone(c("2020-02-03T23:30:01", DT)), None),
        "bad date": (e.year(c("2020-13-03T00:00:00", DT)), None), "plus": (e.datetime_plus(c("2020-02-28T12:00:00Z", DT), c("P1DT12H", D)), "2020-03-01T00:00:00.000000Z"), "difference": (e.datetime_difference(c("2020-01-02T00:00:00Z", DT), c("2020-01-01T00:00:00.5Z", DT)), "PT23H59M59.5S"),
        "duration add": (e.duration_add(c("PT30M", D), c("-P1D", D)), "-PT23H30M"), "duration times": (e.duration_multiply(c("PT1H", D), c(1.5)), "PT1H30M"), "duration by": (e.duration_divide(c("PT1H", D), c(2)), "PT30M"), "ratio": (e.duration_ratio(c("PT1H", D), c("PT30M", D)), "2"),
        "duration negative": (e.duration_is_negative(c("-PT1S", D)), True), "duration days": (e.duration_part(c("P3DT5H", D), "days"), "3"), "duration seconds": (e.duration_part(c("PT1M2.5S", D), "seconds"), "2.5"), "duration equal": (e.eq(c("PT60M", D), c("PT1H", D)), True), "bad duration": (e.duration_us(c("P", D)), None), "make duration": (e.make_duration(F.lit(1), F.lit(2), F.lit(3), F.lit(4.5)), "P1DT2H3M4.5S"),
        "make": (e.make_datetime(*map(F.lit, (2020, 2, 30, 0, 0, 0))), None), "make date": (e.make_date(*map(F.lit, (2020, 2, 29))), "2020-02-29"), "days": (e.date_of_days(F.lit(1)), "1970-01-02"), "microseconds": (e.microseconds(c("2020-01-01T00:00:00.25Z", DT)), "250000"),
        "cut": (e.to_integer(c("-1.9", DEC)), "-1"), "cut double": (e.to_integer(c(1.9)), "1"), "byte": (e.to_integer(c(128), "byte"), None), "from string": (e.to_integer(c("12")), "12"), "from bad": (e.to_integer(c("1.5")), None), "from boolean": (e.to_integer(c(True)), "1"),
        "to double": (e.to_double(c("INF")), "INF"), "to float": (e.to_float(c("0.1", DEC)), "0.1"), "to decimal": (e.to_decimal(c("1.50")), "1.5"), "to boolean": (e.to_boolean(c("yes")), None), "to boolean 0": (e.to_boolean(c(0)), "false"), "to string": (e.to_string(c(1)), "1"), "token": (e.to_string(c(" a  b "), "token"), "a b"),
        "to date": (e.to_date(c("2020-01-01T10:00:00Z", DT)), "2020-01-01"), "to dateTime": (e.to_datetime(c("2020-01-01", t.DATE)), "2020-01-01T00:00:00"), "to time": (e.to_time(c("25:00:00")), None),
    }


def test_values(spark):
    every, got = cases(), {}
    names = list(every)
    for k in range(0, len(names), 12):
        some = names[k : k + 12]
        row = spark.range(1).select(*[every[n][0].alias(str(j)) for j, n in enumerate(some)]).first()
        got |= {n: row[j]["lex"] if hasattr(row[j], "asDict") else row[j] for j, n in enumerate(some)}
    assert {n: got[n] for n in names if got[n] != every[n][1]} == {}


def test_nquads_round_trip(spark, tmp_path):
    lines = [
        '<http://a/s> <http://a/p> "x\\ty \\"q\\" \\u00e9 \\U0001F600 \\\\n"@EN <http://a/g> .',
        '_:b1 <http://a/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .  # note',
        "<http://a/s> <http://a/p> _:b2 _:g .",
        "# comment", "", "not a quad .", '<http://a/s> <http://a/p> "a<b> c" .',
    ]
    source = tmp_path / "in.nq"
    source.write_text("\n".join(lines), encoding="utf-8")
    quads = nquads.read(spark, str(source))
    rows = {(r["s"]["lex"], r["p"]["lex"], tuple(r["o"]), tuple(r["g"])) for r in quads.collect()}
    assert rows == {
        ("http://a/s", "http://a/p", (2, 'x\ty "q" é 😀 \\n', t.LANG_STRING, "en"), (0, "http://a/g", "", "")),
        ("b1", "http://a/p", (2, "1", t.INTEGER, ""), (4, "", "", "")),
        ("http://a/s", "http://a/p", (1, "b2", "", ""), (1, "g", "", "")),
        ("http://a/s", "http://a/p", (2, "a<b> c", t.STRING, ""), (4, "", "", "")),
    }
    nquads.write(quads, str(tmp_path / "out"))
    assert {str(r) for r in nquads.read(spark, str(tmp_path / "out")).collect()} == {str(r) for r in quads.collect()}
    assert nquads.strings(quads).columns == ["subject", "predicate", "object", "graph"]


def _quads(spark, order):
    rows = [((0, f"s{k}", "", ""), (0, "p", "", ""), (2, str(k % 3), t.INTEGER, ""), (4, "", "", "")) for k in order]
    return spark.createDataFrame(rows, t.QUAD)


def test_commitment_membership_absence_and_tampering(spark):
    quads = _quads(spark, range(9))
    leaf = commit.leaves(quads).cache()
    level = commit.levels(leaf).cache()
    root = commit.root(level).first()[0]
    shuffled = commit.leaves(_quads(spark, [5, 3, 8, 0, 1, 7, 2, 4, 6]))
    assert commit.root(commit.levels(shuffled)).first()[0] == root
    paths = commit.paths(leaf, level).cache()
    assert paths.count() == 11 and commit.check_inclusion(paths, root).filter("not ok").isEmpty()
    assert commit.check_sentinels(leaf, paths, root).first()["ok"]
    bad_dir = F.transform("path", lambda s: F.struct(s["level"], s["sibling"], F.lit(2).alias("dir")))
    swapped = F.transform("path", lambda s: F.struct(s["level"], s["sibling"], (1 - s["dir"]).alias("dir")))
    tampered = {"h": F.sha2("h", 256), "path": bad_dir, "idx": F.col("idx") + 1}
    for name, value in [*tampered.items(), ("path", swapped)]:
        assert commit.check_inclusion(paths.withColumn(name, value), root).filter("ok").isEmpty()
    assert commit.check_inclusion(paths, "0" * 64).filter("ok").isEmpty()
    first, last = (leaf.filter(f"idx = {k}").first()["h"] for k in (1, 9))
    lower, upper = ("0" * 63 + "1" if first > "0" * 63 + "1" else None), "f" * 63 + "e"
    probes = spark.createDataFrame([(x,) for x in (lower, upper, first, last, "8" * 64)], "h string")
    got = {r["h"]: r for r in commit.absent(probes, leaf).collect()}
    assert (got[lower]["left_idx"], got[lower]["right_idx"], got[lower]["tag"]) == (0, 1, 0)
    assert (got[upper]["left_idx"], got[upper]["right_idx"], got[upper]["tag"]) == (9, 10, 2)
    assert got[first]["present"] and got[last]["present"] and got[first]["tag"] is None
    mid = got["8" * 64]
    assert not mid["present"] and mid["right_idx"] == mid["left_idx"] + 1
    assert commit.prefix_leaves(quads).count() == 11


def test_lines_that_are_no_quads_are_rejected(spark, tmp_path):
    good = ['<a:s> <a:p> "" .', '_:b <a:p> <> _:g .', '<a:s><a:p> <a:o> .', '<a:s> <a:p> "x\\"y # z"@en-GB <a:g> . # note']
    bad = ['<a:s> <a:p> .', '"s" <a:p> <a:o> .', '<a:s> _:p <a:o> .', '<a:s> <a:p> "open .', '<a:s> <a:p> <a:o>', '<a b> <a:p> <a:o> .']
    source = tmp_path / "in.nq"
    source.write_text("\n".join([*good, *bad, "", "   ", "# comment"]) + "\n")
    quads = nquads.read(spark, str(source))
    want = {"_:b <a:p> <> _:g .", '<a:s> <a:p> "" .', "<a:s> <a:p> <a:o> .", '<a:s> <a:p> "x\\"y # z"@en-gb <a:g> .'}
    got = {r["value"] for r in nquads.lines(quads).collect()}
    rejected = {r["value"] for r in nquads.rejected(spark, str(source)).collect()}
    assert (got, rejected) == (want, set(bad))
    forged = spark.createDataFrame([("\n<p>\n\n\n\n\n",), (None,), ("",)], "v string").select(*[c.alias(n) for n, c in nquads.parse(nquads.F.col("v")).items()])
    assert all(x is None for r in forged.collect() for x in r)
