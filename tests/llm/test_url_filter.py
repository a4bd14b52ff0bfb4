import math
import random
from collections import Counter

import numpy as np

from quadframe.llm import url_filter
from quadframe.llm.queries import URL_RULES


def test_parsing_and_rules(spark):
    urls = {
        "https://EXAMPLE.org/es/1?x": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.Example.org/en/12#t": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://b.org/es/": ("b.org", "/es/", "org/", "allow"),
        "http://x.com/de/3": ("x.com", "/de/3", "com/de/", "block"),
        "http://xcom/de/3": ("xcom", "/de/3", None, "allow"),
        "a://b.org?u=http://c/": ("b.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "ÄB://ÄB.Org/\n": ("Äb.org", "/\n", "org/", "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, host string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge(pages, none, URL_RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.judge(pages.limit(0), none, URL_RULES).collect() == []


def test_reputation_shrinks_from_host_to_domain_to_suffix(spark):
    seen = [("spam.bad.net", 1)] * 40 + [("a.bad.net", 1)] * 30 + [("ok.good.com", 0)] * 60 + [("b.good.com", 0)] * 20 + [("odd.good.com", 1)]
    labelled = spark.createDataFrame(seen, "host string, bad int")
    hosts = ["spam.bad.net", "new.bad.net", "ok.good.com", "odd.good.com", "new.net", "else.where"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id int, url string")
    got = {r["host"]: (r["verdict"], r["bad_rate"]) for r in url_filter.judge(pages, labelled).collect()}
    assert got["spam.bad.net"][0] == "block" and got["ok.good.com"][0] == "allow"
    assert got["odd.good.com"][0] == "allow" and got["odd.good.com"][1] < 0.5
    assert got["new.bad.net"][1] > got["else.where"][1] > got["ok.good.com"][1]


def test_hierarchy_of_hosts(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "host:8080": ("host", "host"), "u@x.example.org:80": ("example.org", "org"), "10.0.0.1": ("10.0.0.1", "#"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("host", url_filter.domain_of(rows["host"]), url_filter.suffix_of(rows["host"])).collect()}
    assert got == hosts


def brute(seen):
    """Posterior (a, b) by host, domain and suffix, and overall, in plain loops."""
    up = {}
    for h in {h for h, _ in seen}:
        parts = h.split(".")
        up[h] = (".".join(parts[-2:]), parts[-1])
    count = {level: Counter() for level in range(3)}
    bads = {level: Counter() for level in range(3)}
    for h, bad in seen:
        for level, name in enumerate((h, *up[h])):
            count[level][name] += 1
            bads[level][name] += bad
    n, x = len(seen), sum(b for _, b in seen)
    parent = {0: lambda h: up[h][0], 1: lambda d: d.split(".")[-1], 2: lambda s: None}
    mean, out = {None: (x + 0.5) / (n + 1)}, {}
    for level in (2, 1, 0):
        m = {k: mean[parent[level](k)] for k in count[level]}
        over = sum((bads[level][k] - c * m[k]) ** 2 - c * m[k] * (1 - m[k]) for k, c in count[level].items())
        pairs = sum(c * (c - 1) * m[k] * (1 - m[k]) for k, c in count[level].items())
        strength = 1 / min(max(over / pairs, 0.001), 0.9) - 1
        out[level] = {k: (bads[level][k] + strength * m[k], c - bads[level][k] + strength * (1 - m[k])) for k, c in count[level].items()}
        mean = {k: a / (a + b) for k, (a, b) in out[level].items()}
    return out, (x + 0.5, n - x + 0.5)


def share_above(a, b, x):
    """Probability that a beta variable exceeds x, by summing its density."""
    at = (np.arange(200_000) + 0.5) / 200_000
    log = (a - 1) * np.log(at) + (b - 1) * np.log1p(-at)
    density = np.exp(log - log.max())
    return density[at > x].sum() / density.sum()


def test_posteriors_and_verdicts_match_brute_force(spark):
    rng = random.Random(5)
    seen = []
    for suffix, rate in (("com", 0.1), ("net", 0.3), ("info", 0.6)):
        for d in range(6):
            for h in range(4):
                own = min(max(rng.gauss(rate, 0.15), 0), 1)
                seen += [(f"h{h}.d{d}.{suffix}", int(rng.random() < own)) for _ in range(rng.choice([1, 3, 20, 80]))]
    posterior, overall = brute(seen)
    hosts = sorted({h for h, _ in seen}) + ["new.d1.net", "new.other.info", "else.xyz"]
    pages = spark.createDataFrame([(i, f"http://{h}/x", i) for i, h in enumerate(hosts)] * 2, "page_id int, url string, bad int")
    got = url_filter.judge(pages, spark.createDataFrame(seen, "host string, bad int")).collect()
    assert len(got) == 2 * len(hosts)
    threshold = 1.25 * overall[0] / sum(overall)
    verdicts = Counter()
    for r in got:
        d, s = ".".join(r["host"].split(".")[-2:]), r["host"].split(".")[-1]
        a, b = posterior[0].get(r["host"]) or posterior[1].get(d) or posterior[2].get(s) or overall
        assert math.isclose(r["bad_rate"], a / (a + b), rel_tol=1e-9)
        above = share_above(a, b, threshold)
        if abs(above - 0.95) > 0.01:
            assert r["verdict"] == ("block" if above > 0.95 else "allow")
        verdicts[r["verdict"]] += 1
    assert min(verdicts["block"], verdicts["allow"]) > 10
