import random

from tidemark.llm import url_cascade


def test_cascade_is_exact_over_its_universe(spark):
    r = random.Random(5)
    names = sorted({f"h{r.randrange(10**6)}.example.org" for _ in range(4000)})
    universe = spark.createDataFrame([(n,) for n in names], "key string")
    listed = set(r.sample(names, 700))
    cascade = url_cascade.fit_cascade(universe, listed | {"elsewhere.org"}, bits_a_key=3.0)
    assert len(cascade.levels) > 2
    assert {n for n, hit in zip(names, cascade.listed(names)) if hit} == listed
    assert url_cascade.fit_cascade(universe, []).levels == ()
    assert cascade.n_bits < 64 * len(names)


def test_shards(spark, monkeypatch):
    """Lists of more bits than a broadcast may take are asked shard by shard, with the same verdicts."""
    r = random.Random(6)
    hosts = sorted({f"h{r.randrange(10**6)}.example.org" for _ in range(600)})
    listed = set(r.sample(hosts, 150))
    pages = spark.createDataFrame([(i, f"http://{'www.' if i % 3 else ''}{h}/a") for i, h in enumerate(hosts)] + [(None, "http://a.b/")], "page_id long, url string")
    once = sorted(map(str, url_cascade.judge(pages, listed).collect()))
    assert sum("verdict='block'" in x for x in once) == 150
    monkeypatch.setattr(url_cascade, "MAX_BITS", 500)
    universe = spark.createDataFrame([(h,) for h in hosts], "key string")
    cascades = list(url_cascade.fit_cascades(universe, listed))
    assert len(cascades) == 4 and all(0 < c.n_bits for c in cascades)
    assert sorted(map(str, url_cascade.judge(pages, listed).collect())) == once


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("https://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://a.example.net/fr/", "a.example.net", "/fr/", "net/", "block"),
        ("http://xexample.net/en/", "xexample.net", "/en/", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://b.example.com/de/?q", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://w.org/fr/1#/", "w.org", "/fr/1", "org/fr/", "allow"),
        ("http://m.free-bets.example.com#/a", "m.free-bets.example.com", "", None, "block"),
        ("http://free-bets.example.com/fr", "free-bets.example.com", "/fr", None, "block"),
        ("http://ÄÖ.example.com/ä", "ÄÖ.example.com", "/ä", None, "allow"),
        ("x://" + "a." * 3000 + "com", "a." * 3000 + "com", "", None, "allow"),
    ]
    cases += cases[3:4]
    pages = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "page_id long, url string, host string, _v string")
    got = url_cascade.judge(pages).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]
    assert url_cascade.judge(pages.limit(0)).count() == 0


def test_sql(same):
    same(url_cascade.query, url_cascade.oracle())
