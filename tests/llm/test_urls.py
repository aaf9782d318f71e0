import millrace.llm.urls as u

RULES = [u.host_rule("block", "net/"), u.host_rule("allow", "example.net/en/"), u.host_rule("block", "example.com/de/"), u.host_rule("allow", "org/fr/"), u.pattern_rule("block", "^spam-farm^"), u.pattern_rule("block", "casino*win"), u.pattern_rule("block", "ads^")]
URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "https://example.net/EN/x", "https://net", "https://net/", "x://xnet/", "https://a.example.com/de", "https://a.example.com/de/",
    "https://badexample.com/de/", "https://b.org/fr/1", "https://b.org?/fr/", "https://spam-farm.example.com/", "https://xspam-farm.a.com/", "http://a.com/casino-big-win", "http://a.com/BIGADS", "ftp://u@h.net:80/", "://net/q", "a.net/://b.com/", "http://x.com/net/",
    "http://x\n.net/a",
]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    if best:
        return host, path, best[1], best[0]
    low = url.lower()
    spam = any(low[i - 1 : i] not in set("abcdefghijklmnopqrstuvwxyz0123456789") or i == 0 for i in range(len(low)) if low.startswith("spam-farm", i) and not low[i + 9 : i + 10].isalnum())
    casino = "casino" in low and "win" in low[low.find("casino") + 6 :]
    ads = any(low.startswith("ads", i) and not low[i + 3 : i + 4].isalnum() for i in range(len(low)))
    return host, path, None, "block" if spam or casino or ads else "allow"


def test_like_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(URLS)] + [(None, "http://a.net/", "d"), (None, "http://a.net/", "d")], "page_id long, url string, host string")
    for size in (50_000, 1, 2):
        monkeypatch.setattr(u, "SHARD_RULES", size)
        rows = u.judge_urls(df, RULES).collect()
        got = {r.page_id: r for r in rows if r.page_id is not None}
        for i, x in enumerate(URLS):
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(x), x
        assert len(rows) == len(URLS) + 2
    assert u.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in u.judge_urls(df, []).collect()} == {"allow"}


def test_filed_under_the_rarest_token():
    index = u.RuleIndex(list(enumerate(RULES)), {"example": 100, "net": 5, "en": 70, "com": 50, "de": 9})
    assert 1 in index.by_token["net"] and 2 in index.by_token["de"] and 4 in index.by_token["farm"]
    assert index.always == [5, 6]


def test_host_rules_see_the_first_host_only(spark):
    """Archive, proxy and redirect URLs hold another one in their path."""
    urls = ["https://web.archive.org/web/2020/http://foo.net/x", "https://proxy.com/http://a.example.com/de/x", "https://go.org/fr/http://foo.net/", "http://foo.net/http://b.org/fr/1", "x://y/://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(df, RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [brute(x) for x in urls]
    assert [got[i][2] for i in range(len(urls))] == [None, None, "org/fr/", "net/", None]
    assert u.RuleIndex([(0, u.host_rule("block", "foo.net"))], {}).matching("http://foo.net\n", "foo.net\n", "") == []
