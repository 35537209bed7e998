from __future__ import annotations

import pytest

from tablelink.llm import url_rules as u

SCHEMA = "page_id bigint, url string, html string, host int, rule string"
CASES = [
    # url, host, path, rule, verdict
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("http://A.Example.COM/en/x?q=/fr/#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/a", "m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://x.net/de/http://y.net/fr/", "x.net", "/de/http://y.net/fr/", None, "allow"),
    ("ftp://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://casino-win.example.org/de/", "casino-win.example.org", "/de/", None, "block"),
    ("http://x.org/best-CASINO.html", "x.org", "/best-CASINO.html", None, "block"),
    ("http://x.org/casinos", "x.org", "/casinos", None, "allow"),
    ("http://x.org/payday-loans", "x.org", "/payday-loans", None, "block"),
    ("http://x.org/payday/loans", "x.org", "/payday/loans", None, "allow"),
    ("http://casino.example.com/fr/", "casino.example.com", "/fr/", "com/", "allow"),
    ("http://a\nb.com/x", "a\nb.com", "/x", "com/", "allow"),
    ("http://x.org/" + "long/" * 20_000 + "poker", "x.org", "/" + "long/" * 20_000 + "poker", None, "block"),
]


def test_cases(spark):
    rows = [(k, c[0], None, 1, "x") for k, c in enumerate(CASES)] + [(None, CASES[3][0], "h", 1, "x")] * 2
    got = u.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {r["page_id"]: (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert {k: v for k, v in found.items() if k is not None} == dict(enumerate(CASES))
    assert len(got) == len(rows) and found[None][1:] == CASES[3][1:]


def test_empty_table(spark):
    assert u.judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rule", u.pattern_rules(), ids=lambda rule: rule.name)
def test_tokens_stand_in_every_match(rule):
    import re

    for host in ("x-{}.org", "{}.org", "a.{}-b.org"):
        url = host.format("-".join(rule.tokens))
        assert re.search(rule.pattern, f"{url} /") and set(rule.tokens) <= set(re.findall("[a-z0-9]+", url))


def test_rarest_token():
    a = u.PatternRule("a", "x", ("common", "rare"))
    b = u.PatternRule("b", "x", ("common",))
    assert u.filed_by_rarest([a, b], {"common": 9, "rare": 1}) == {"rare": [a], "common": [b]}
