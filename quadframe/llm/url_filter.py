"""Host reputation for url filtering, by empirical Bayes.

Labelled page outcomes (bad or not) are counted by host. The overall rate is the prior of every suffix, a suffix's
posterior mean the prior of its registered domains, a domain's the prior of its hosts. How strongly a level is shrunk
towards its parent is estimated from the data: the beta-binomial correlation of the level by the method of moments. A
page is blocked if its host's bad rate exceeds a threshold with a posterior probability of 95 %; the threshold is ``lift``
times the overall rate, so hosts that are no worse than others are never blocked, and clearly worse ones are, however rare
bad pages are. Hosts without labels are judged by the posterior of their domain, then suffix, then the overall rate. Allow
and block rules go before that.

A url that is null or has no ``://`` has empty host and path; it is judged by the overall rate. The hierarchy is that of the
host without user and port: suffix is the last label (for the suffixes of LONG_SUFFIXES the last two), registered domain
one label more; an address in numbers is its own domain under one suffix. Very long urls are taken whole. Repeated rows
are judged one by one. Without labels the prior is 0.5 bad of 1 page, which blocks nothing; without pages the result is
empty. Other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a level's beta-binomial correlation: shrinkage by 1/rho - 1 pseudo-pages.
RHO = (0.001, 0.9)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


#: Public suffixes of two labels.
LONG_SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "ac.uk", "gov.uk", "nhs.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "ac.nz",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "com.cn", "net.cn", "org.cn", "gov.cn", "com.tw", "com.hk", "com.sg", "com.my", "co.in", "co.id", "co.th",
    "com.br", "org.br", "gov.br", "com.ar", "com.mx", "com.co", "co.za", "com.tr", "com.ua", "co.il", "com.pl", "com.pt",
)
_NUMBERS = r"\A(?:[0-9.]+|\[.*)\z"


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z|\.\z", "")


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_NUMBERS), "#").when(two.isin(*long_suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_NUMBERS), name).when(two.isin(*long_suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, else nulls. rules: (verdict, host, start of the path)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        text, verdict = F.when(fits, at + start).otherwise(text), F.when(fits, word).otherwise(verdict)
    return text, verdict


def _level(df: DataFrame, by: str, prior: Column) -> tuple[DataFrame, float]:
    """The level's rows with its prior mean m, and the pseudo-pages that the prior is worth."""
    df = df.withColumn(f"{by}_m", prior)
    n, x, m = F.col(f"{by}_n"), F.col(f"{by}_x"), F.col(f"{by}_m")
    got = df.agg(F.sum((x - n * m) * (x - n * m) - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("pairs")).first()
    rho = got["over"] / got["pairs"] if got["pairs"] else RHO[0]
    return df, 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def reputation(labelled: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> dict:
    """Posterior beta parameters of the bad rate by host, domain and suffix, and overall. labelled: (host, bad 0 or 1)."""
    hosts = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("host_n"), F.sum("bad").alias("host_x"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), long_suffixes), "suffix": suffix_of(F.col("host"), long_suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("host_n").alias("domain_n"), F.sum("host_x").alias("domain_x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_x").alias("suffix_x"))
    total = suffixes.agg(F.coalesce(F.sum("suffix_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("suffix_x"), F.lit(0)).alias("x")).first()
    mean = (total["x"] + 0.5) / (total["n"] + 1)

    def posterior(df: DataFrame, by: str, k: float) -> DataFrame:
        a, b = F.col(f"{by}_x") + k * F.col(f"{by}_m"), F.col(f"{by}_n") - F.col(f"{by}_x") + k * (1 - F.col(f"{by}_m"))
        return df.withColumn(f"{by}_a", a).withColumn(f"{by}_b", b).withColumn(f"{by}_p", a / (a + b))

    suffixes, k = _level(suffixes, "suffix", F.lit(mean))
    suffixes = posterior(suffixes, "suffix", k)
    domains, k = _level(domains.join(suffixes.select("suffix", "suffix_p"), "suffix"), "domain", F.col("suffix_p"))
    domains = posterior(domains, "domain", k)
    hosts, k = _level(hosts.join(domains.select("domain", "domain_p"), "domain"), "host", F.col("domain_p"))
    hosts = posterior(hosts, "host", k)
    return {"host": hosts, "domain": domains, "suffix": suffixes, "overall": (total["x"] + 0.5, total["n"] - total["x"] + 0.5)}


def deviate(a: Column, b: Column, x: float) -> Column:
    """Standard normal deviate of the probability that a beta variable is at most x, by cube roots (of two gammas' ratio)."""
    u, v = F.pow(b * x, F.lit(1 / 3)), F.pow(a * (1 - x), F.lit(1 / 3))
    return 3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / F.sqrt(u * u / b + v * v / a)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = (), lift: float = 1.25, z: float = 1.645, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate) for each row of pages. labelled: (host, bad 0 or 1)."""
    known = reputation(labelled, long_suffixes)
    bad, good = known["overall"]
    threshold = min(lift * bad / (bad + good), 1 - 0.5 * good / (bad + good))
    here = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    here = here.withColumns({"domain": domain_of(F.col("host"), long_suffixes), "suffix": suffix_of(F.col("host"), long_suffixes)})
    # One row a host to look up, so that a host with a third of the pages is one row in the chain of joins.
    every = here.select("host", "domain", "suffix").distinct()
    for by in ("host", "domain", "suffix"):
        every = every.join(known[by].select(by, f"{by}_a", f"{by}_b"), by, "left")
    a, b = (F.coalesce(F.col(f"host_{p}"), F.col(f"domain_{p}"), F.col(f"suffix_{p}"), F.lit(known["overall"][i])) for i, p in enumerate("ab"))
    every = every.select("host", a.alias("a"), b.alias("b"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    worst = F.when(deviate(F.col("a"), F.col("b"), threshold) < -z, "block").otherwise("allow")
    return here.join(every, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, worst).alias("verdict"), (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): pages whose path ends in the number of a labelled document; bad if low in quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})[^/]*/?\z", 1)
    seen = pages.select(host_of(F.col("url")).alias("host"), number.alias("n")).filter("n <> ''")
    seen = seen.select("host", F.col("n").cast("long").alias("doc_id"))
    bad = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return seen.join(bad, "doc_id").select("host", "bad")
