from strata.llm import urls


def test_split():
    assert urls.split_url("HTTP://A.Example.COM/en/1?x#y") == ("a.example.com", "/en/1")
    assert urls.split_url("https://a.com?x/y") == ("a.com", "")
    assert urls.split_url("a.com/x") == ("", "") == urls.split_url(None)
    assert urls.split_url("x://") == ("", "")


def test_rules_and_terms(spark):
    cases = {
        "https://www.example.com/en/1": ("www.example.com/en/", "allow"),
        "https://m.example.com/en/1": ("example.com/en/", "block"),
        "https://m.example.com/EN/1": ("com/", "allow"),
        "https://a.net/es/x": ("net/es/", "block"),
        "https://anet/es/x": (None, "allow"),
        "https://a.com": (None, "allow"),
        "https://casino.org/": (None, "block"),
        "https://casinos.org/": (None, "allow"),
        "https://free-bets.org/": (None, "block"),
        "https://free.org/free/free": (None, "allow"),
        "https://freebets.org/": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
        "PORN": (None, "block"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(0, "https://www.example.com/en/1", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()]
    assert sorted(got, key=str) == sorted([(i, *v) for i, v in enumerate(cases.values())] + [(0, "www.example.com/en/", "allow")], key=str)
    assert urls.filter_urls(pages.limit(0)).count() == 0
