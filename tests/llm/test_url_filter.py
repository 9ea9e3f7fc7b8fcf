from hazardflow.llm.url_filter import Rule, judge

SCHEMA = "page_id long, url string, html string, host string, label int, features string"
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([k for k in map(path.find, "?#") if k >= 0], default=len(path))]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


ODD = [None, "", "no scheme", "http://", "http://EXAMPLE.org/en/1", "http://example.org/en/2", "http://example.org", "http://myexample.org/es/x",
       "https://a.b.example.org/es/1?x=://y", "ftp://org/", "http://com/fr/", "http://x.com/fr", "http://x.com?u=/fr/", "http://x.com#/de/",
       "http://x.com/de/\nline", "a://b://org/", "http://É.com/de/", "http://x.ORG/" + "p/" * 3000, "http://orgs/", "http://host:80.org/en/1"]


def pages(n=160):
    made = [f"https://s{i % 7}.example.{('org', 'com', 'net')[i % 3]}/{('en', 'es', 'fr', 'de')[i % 4]}/{i * 37 % 211}?q={i}" for i in range(n)]
    found = [(i, u, "<p>", "clash", 1, "clash") for i, u in enumerate(made + ODD)]
    return found + [found[2], (None, "http://x.com/de/", None, None, None, None)]


def test_rules_against_brute_force(spark):
    data = pages()
    got = judge(spark.createDataFrame(data, SCHEMA).repartition(3), RULES).collect()
    want = []
    for i, u, *_ in data:
        host, path = split(u)
        r = rule_of(host, path)
        want.append((i, host, path, r and r.text, r and r.verdict))
    seen = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got]
    assert sorted(map(str, seen)) == sorted(map(str, want))
    assert {r.verdict for r in got} == {"allow", "block"}


def test_trees_learn_what_labels_show(spark):
    """URLs labelled by one rule pair; the rest of the same make get the same verdicts."""
    made = [f"http://h{i}.{'bad' if i % 2 else 'good'}.net/{'1234567890' if i % 2 else 'words-in-a-path'}/{'x' if i % 10 else 'kept'}" for i in range(600)]
    rules = [Rule("block", "bad.net", "/1234567890/x"), Rule("allow", "good.net", "/words-in-a-path/x")]
    got = judge(spark.createDataFrame([(i, u, None, None, None, None) for i, u in enumerate(made)], SCHEMA), rules).collect()
    rest = [r for r in got if r.rule is None]
    assert len(rest) == 60
    right = sum(r.verdict == ("block" if ".bad." in r.host else "allow") for r in rest)
    assert right >= 0.9 * len(rest)


def test_one_class_and_empty(spark):
    only = [(1, "http://x.com/de/1", None, None, None, None), (2, "http://y.net/", None, None, None, None)]
    assert {r.page_id: r.verdict for r in judge(spark.createDataFrame(only, SCHEMA), RULES).collect()} == {1: "block", 2: "block"}
    none = [(2, "http://y.net/", None, None, None, None)]
    assert judge(spark.createDataFrame(none, SCHEMA), RULES).first().verdict == "allow"
    assert judge(spark.createDataFrame([], SCHEMA), RULES).collect() == []
