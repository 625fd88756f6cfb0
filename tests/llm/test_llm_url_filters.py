"""URL rules against a plain version, and the defined cases."""

import random
import re

from pregonero.llm import url_filters as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain(url, rules):
    host, path = split(url)
    best = None
    for rule, verdict, rank in rules:
        rhost, slash, rpath = rule.partition("/")
        rhost, rpath = rhost.lower(), slash + rpath
        if host and (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            key = (rank, -len(rule), verdict)
            if best is None or key < best[0]:
                best = (key, rule, verdict)
    return (host, path, *(best[1:] if best else (None, None)))


def test_equals_checking_every_rule(spark):
    rng = random.Random(3)
    hosts = ["a.b.example.net", "example.net", "NET", "xexample.net", "b.org", "b.org:80", "", "a..net", "org"]
    paths = ["", "/", "/en/", "/en", "/en/x.html", "/EN/", "/fr/a/b", "/é/ñ", "/en//", "?q=/en/", "#/fr/"]
    urls = [f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "example.net/en/", "://net/", "a://b://net/", "http://net\n/x", "http://net/" + "y" * 5000]
    rules = [
        ("net/", "block", 0), ("example.net/en/", "allow", 0), ("b.org/fr/a", "block", 0), ("org/", "allow", 0), ("example.net/e", "block", 0),
        ("Example.NET/en/x", "block", 0), ("b.org/é/", "block", 0), ("org/en/", "block", 1), ("org", "block", 1), ("example.net/en/", "allow", 0),
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "rule string, verdict string, rank int")
    got = {r.page_id: (r.host, r.path, r.rule and r.rule.lower(), r.verdict) for r in u.judge(pages, table).collect()}
    for i, url in enumerate(urls):
        host, path, rule, verdict = plain(url, rules)
        assert got[i] == (host, path, rule and rule.lower(), verdict), url


def test_nulls_repeated_rows_empty_tables_and_clashing_names(spark):
    rows = [(1, "http://x.net/a", "h"), (1, "http://x.net/a", "h"), (None, None, None)] + [(5, "http://hot.net/", "h")] * 300
    pages = spark.createDataFrame(rows, "page_id long, url string, HOST string")
    rules = spark.createDataFrame([("net/", "block"), ("net/", "allow"), (None, "block")], "rule string, verdict string")
    out = u.judge(pages, rules)
    assert out.columns == ["page_id", "url", "HOST", "_host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == 303 and sum(r.verdict == "allow" for r in got) == 302  # allow goes before block
    assert u.judge(pages, rules.limit(0)).filter("verdict is not null").count() == 0
    assert u.judge(pages.limit(0), rules).count() == 0
