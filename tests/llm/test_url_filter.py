"""URL verdicts against plain counting of token sets."""

import itertools
import math
import random
import re

from cellscape.llm import url_filter


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :]).group()


def tokens(url, labels):
    host, path = parts(url)
    names = host.split(".")
    out = {"host=" + ".".join(names[-i:]) for i in range(1, labels + 1)} - {"host="}
    out |= {"path=" + s for s in path.split("/") if s}
    ext = re.search(r"\.([A-Za-z0-9]+)$", path)
    out |= {"ext=" + ext.group(1)} if ext else set()
    query = re.match(r"[^?#]*\?([^#]*)", url or "", re.S)
    out |= {"query=" + p.split("=")[0] for p in query.group(1).split("&") if p.split("=")[0]} if query else set()
    return out


def listed(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def plain(urls, rules, support, confidence, labels=5):
    known = [(tokens(u, labels), listed(u, rules)[3]) for u in urls if listed(u, rules)]
    total, blocked = len(known), sum(v == "block" for _, v in known)
    least = math.ceil(support * total)
    n, b = {}, {}
    for ts, v in known:
        for t in ts:
            n[t], b[t] = n.get(t, 0) + 1, b.get(t, 0) + (v == "block")
    tells = {t: abs(b[t] * total - n[t] * blocked) for t in n if n[t] >= least}
    count = {}
    for ts, v in known:
        picked = sorted(sorted((t for t in ts if t in tells), key=lambda t: (-tells[t], t))[: url_filter.ITEMS])
        for k in range(1, url_filter.LONGEST + 1):
            for s in itertools.combinations(picked, k):
                count.setdefault(s, {"block": 0, "allow": 0})[v] += 1
    mined = [(c[v] / sum(c.values()), c[v], -len(s), " ".join(s), v, set(s)) for s, c in count.items() for v in c
             if c[v] >= max(least, 1) and c[v] / sum(c.values()) >= confidence]
    out = []
    for u in urls:
        rule, fits = listed(u, rules), [m for m in mined if m[5] <= tokens(u, labels)]
        top = max(fits, key=lambda m: m[:5]) if fits and not rule else None
        out.append((*parts(u), rule[2] if rule else None, rule[3] if rule else top[4] if top else "allow", top[3] if top else None))
    return out


def test_equals_plain_mining(spark):
    rng = random.Random(3)
    hosts = ["a.net", "www.A.example.net", "example.net", "b.example.com", "c.org", "x.y.c.org", "notnet", "deep.er.than.five.labels.here.org", "c.com"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'ads'])}/{rng.randrange(40)}{rng.choice(['', '.html', '/', '?ad=1&b', '#top'])}" for _ in range(500)]
    odd = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "x://NET:80/a", "http://a..net/x", "a://b.net/p?u=http://c.org/fr/", "http://b.org/" + "s/" * 50_000,
           "http://" + "w." * 3000 + "net/a", "http://a.net/en/1\n2", "//net/", "http://é.org/fr/ü?ä=1"]
    urls += odd + [urls[0]] * 200          # a third of the rows may be one URL
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("example.com", "/de/", "block"), ("y.c.org", "/", "allow"), ("c.org", "/ads", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS at", "2 AS found", "'y' AS token").repartition(3)
    given = spark.createDataFrame(rules + [(None, "/", "block"), ("z", None, "allow"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    for support, confidence in ((0.005, 0.9), (0.2, 0.6), (1.0, 1.0)):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.judged(df, given, support, confidence).collect()}
        assert len(got) == len(urls)
        for i, want in enumerate(plain(urls, rules, support, confidence)):
            assert got[i] == want, (urls[i][:80] if urls[i] else urls[i])


def test_without_pages_rules_or_labels(spark):
    rules = url_filter.rule_list(spark, ["block net/", "allow a.net/x y"])
    assert [tuple(r) for r in rules.collect()] == [("net", "/", "block"), ("a.net", "/x y", "allow")]
    pages = spark.createDataFrame([(1, "http://b.com/z"), (1, "http://b.com/z"), (None, None)], "page_id long, url string")
    for given in (rules, rules.where("1 = 0")):
        assert sorted((tuple(r) for r in url_filter.judged(pages, given).collect()), key=repr) == [
            (1, "b.com", "/z", None, "allow", None)] * 2 + [(None, "", "", None, "allow", None)]
    assert url_filter.judged(pages.where("1 = 0"), rules).count() == 0


def test_long_urls_mine_few_tokens(spark):
    """Copies of one URL of 60 frequent tokens would make 2**60 itemsets; eight tokens each are mined."""
    long = "http://a.net/" + "/".join(f"s{i}" for i in range(60))
    urls = [long] * 50 + ["http://b.org/fr/1"] * 30 + ["http://c.com/s5/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judged(pages, url_filter.rule_list(spark, ["block net/", "allow org/fr/"])).collect()}
    assert out[0].rule == "net/" and out[60].verdict == "allow" and len(out) == 81


def test_all_tokens_of_a_url_are_mined(spark):
    """A token that tells less than eight others of its URL still makes a rule."""
    common = "/".join(f"s{i}" for i in range(12))
    urls = [f"http://a.net/{common}/{'rare' if i % 20 == 0 else i}" for i in range(200)] + ["http://b.org/fr/1"] * 100 + ["http://c.com/rare"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judged(pages, url_filter.rule_list(spark, ["block net/", "allow org/fr/"])).collect()}
    assert (out[300].verdict, out[300].mined) == ("block", "path=rare")


def test_wide_urls_equal_plain_mining(spark):
    """Rows of more tokens than FP-growth gets: sets of undecided tokens grow level by level."""
    rng = random.Random(5)
    urls = []
    for i in range(300):
        bad = rng.random() < 0.5
        segments = [f"s{k}" for k in range(14) if rng.random() < (0.8 if bad == (k % 3 == 0) else 0.5)]
        urls.append(f"http://{rng.choice('abc')}.{rng.choice(['net', 'com', 'info']) if bad else rng.choice(['org', 'com', 'info'])}/" + "/".join(segments))
    rules = [("net", "/", "block"), ("org", "/", "allow"), ("com", "/s0", "block"), ("com", "/s1", "allow"), ("com", "/s2", "allow")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    for support, confidence in ((0.02, 0.9), (0.1, 0.7)):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.judged(df, given, support, confidence).collect()}
        for i, want in enumerate(plain(urls, rules, support, confidence)):
            assert got[i] == want, (urls[i], got[i], want)
