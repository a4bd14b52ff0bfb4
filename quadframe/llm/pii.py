"""Personal data: patterns, and terms that give a protected entity away.

Base spans (email, ip, card, phone) are protected entities. How much a term t tells about an entity e is estimated from
the corpus, all counts over distinct texts: n(t, e) texts in which t stands near e, n(t) texts with t, n(e) texts with e
and N pairs of a text and a term. PMI(t; e) = log2(n(t, e) N / (n(t) n(e))) and IC(e) = log2(N / n(e)). A term discloses e
if PMI >= alpha IC(e) and if it leaves at most ``left`` of the IC(e) bits open, that is, if p(e | t) is at least
p(e) ** (1 - alpha) and 2 ** -left, where p(e | t) is Wilson's lower bound of n(t, e) / n(t) at ``z`` deviations, so that
one or two texts decide too, with less weight than many. The first bar falls as the corpus grows, and the second is where
that ends: beyond it, more texts without e hide no more. In texts that hold e
such terms become spans of kind ``term`` beside the base spans, and are generalised or removed on sanitising.

Spans count code points, end exclusive. Null texts count as empty, which have no spans. Repeated rows are separate
documents; copies of one text count once as evidence. An empty table gives an empty result. Patterns are possessive
or start at the beginning of a run, so that very long runs of digits or letters take time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Work

#: Kind, pattern, cheap test that any match passes. Leftmost matches can only begin where a run of such characters
#: begins or where the match before has ended.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]+\."),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
)
TERM = r"\p{L}{3,}+"
SPAN = "array<struct<start:int, ord:int, end:int, kind:string, value:string>>"
#: Characters to each side of an entity in which terms count as near.
REACH = 80


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second from the right doubled (less 9 above 9), is a multiple of 10."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(at, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return F.length(_digits(value)).between(9, 15) if kind == "phone" else F.lit(True)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def raw_matches(text: Column, pattern: str, order: int) -> Column:
    """All leftmost non-overlapping matches: number, length of the gap before, length, value."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("value")), F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0)))
    return F.transform(pairs, lambda m, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["value"]).alias("len"), m["value"].alias("value")))


def raw_base(text: Column) -> Column:
    none = F.slice(raw_matches(F.lit(""), "x", 0), 1, 0)
    return F.concat(*[F.when(text.rlike(test), raw_matches(text, pattern, order)).otherwise(none) for order, (_, pattern, test) in enumerate(KINDS)])


def placed(raw: DataFrame) -> DataFrame:
    """(row, spans): raw matches of each row at their places, as structs (start, ord, end, kind, value) in that order.

    Places are running sums over a row's matches, which takes time in proportion to their number.
    """
    upto = Window.partitionBy("row", "m.ord").orderBy("m.i").rowsBetween(Window.unboundedPreceding, 0)
    at = raw.select("row", F.explode("raw").alias("m")).withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto).cast("int"))
    kinds = [kind for kind, *_ in KINDS] + ["term"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("m.ord") + 1)
    valid = F.lit(True)
    for order, name in enumerate(kinds[:-1]):
        valid = F.when(F.col("m.ord") == order, _holds(name, F.col("m.value"))).otherwise(valid)
    span = F.struct((F.col("end") - F.col("m.len")).alias("start"), F.col("m.ord").alias("ord"), "end", kind.alias("kind"), F.col("m.value").alias("value"))
    return at.filter(valid).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, hold: DataFrame, work: Work, alpha: float, left: float, z: float) -> DataFrame:
    """(entity, term) pairs over the threshold. docs: all texts; hold: (text, base) of those with base spans."""
    digest = F.xxhash64("text").alias("digest")
    every = docs.select(digest, "text").dropDuplicates(["digest"]).select(F.explode(_terms(F.col("text"))).alias("term"))
    n_t = work.save(every.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "vocabulary")
    n = float(n_t.agg(F.sum("n_t")).first()[0] or 0)
    near = hold.select(digest, "text", F.explode("base").alias("s")).select(
        "digest",
        F.lower("s.value").alias("entity"),
        F.substring(F.col("text"), F.greatest(F.col("s.start") + 1 - REACH, F.lit(1)), F.least(F.col("s.start"), F.lit(REACH))).alias("before"),
        F.substring(F.col("text"), F.col("s.end") + 1, F.lit(REACH)).alias("after"),
    )
    near = near.dropDuplicates(["entity", "digest", "before", "after"])
    pairs = near.select("entity", "digest", F.explode(_terms(F.concat_ws(" | ", "before", "after"))).alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    n_e = near.select("entity", "digest").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    p, z2 = F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0)), z * z / F.col("n_t")
    low = (p + z2 / 2 - F.sqrt(z2 * (p * (1 - p) + z2 / 4))) / (1 + z2)
    told = pairs.join(n_t, "term").join(n_e, "entity").filter(low >= F.greatest(F.pow(F.col("n_e") / F.lit(n), F.lit(1 - alpha)), F.lit(2.0**-left)))
    return work.save(told.select("entity", "term"), "told")


def find(docs: DataFrame, alpha: float = 0.9, left: float = 1.25, z: float = 1.0) -> DataFrame:
    """(doc_id, text, base, spans) for each row of docs; base and spans are arrays of (start, ord, end, kind, value).

    text is null where no pattern matches; sanitise() is for the rows with spans.
    """
    work = Work(docs.sparkSession, "pii")
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A row's number is kept by writing it.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), raw_base(F.col("text")).alias("raw"))
    rows = work.save(rows.withColumn("text", F.when(F.size("raw") > 0, F.col("text"))), "rows")
    base = work.save(placed(rows.filter(F.size("raw") > 0)).withColumnRenamed("spans", "base"), "base")
    hold = work.save(rows.select("row", "text").join(base, "row"), "hold")
    told = disclosing_terms(docs, hold, work, alpha, left, z)
    terms = hold.select("row", F.explode("base.value").alias("value")).select("row", F.lower("value").alias("entity")).join(told, "entity").groupBy("row").agg(F.collect_set("term").alias("terms"))
    hidden = hold.join(terms, "row").select("row", "terms", raw_matches(F.col("text"), TERM, len(KINDS)).alias("raw"))
    hidden = placed(hidden).join(terms, "row").select("row", F.filter("spans", lambda s: F.array_contains(F.col("terms"), F.lower(s["value"]))).alias("hidden"))
    every = hold.join(hidden, "row", "left").select("row", "text", "base", F.when(F.col("hidden").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "hidden"))).alias("spans"))
    none = F.array().cast(SPAN)
    return rows.select("row", "doc_id").join(every, "row", "left").select("doc_id", "text", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def sanitise(found: DataFrame, remove_terms: bool = False) -> DataFrame:
    """(doc_id, text) of find()'s rows with spans replaced by their kind in brackets; terms may be removed instead.

    Of overlapping spans the first by start is replaced.
    """
    label = lambda s: F.when(s["kind"] == "term", F.lit("" if remove_terms else "[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, label(s)).alias("out")))

    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.select("doc_id", clean.alias("text"))
