import random

from tarn.llm import queries, url_filter
from tarn.llm.components import components


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    edges += [(1000, k) for k in range(1001, 1400)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    found = {x.node: x.component for x in components(df).collect()}
    assert found == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert components(df.limit(0)).count() == 0


PAGES = [
    (1, "https://a.example.net/en/x", None), (2, "https://a.example.net/fr/x?q#f", ""), (3, "http://EXAMPLE.com/de/", "<html>"),
    (4, "http://notexample.com/de/", None), (5, "http://x.org/fr/1", None), (6, None, "<p>"), (7, "nothing", "<p>"), (8, "http://net", None),
    (9, "http://alias.example.org/p", '<link rel="canonical" href="http://b.net/x">'),
    (10, "http://two.example.org/p/q", "<LINK href='/p2' rel=canonical>"),
    (11, "http://two.example.org/p2", '<meta http-equiv="refresh" content="0; url=http://b.net/x">'),
    (12, "http://three.example.org/fr/p", '<link rel="canonical" href="http://c.net/x">'),
    (13, "http://four.example.org/p", '<link rel="canonical" href="http://c.net/x">'),
    (14, "http://five.example.org/de/", '<link rel="canonical" href="http://five.example.org/de/">'),
    (15, "http://three.example.org/fr/p", None), (None, "http://x.net/?://", None),
]
WANT = {
    1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: ("org/fr/", "allow"),
    6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "block"), 11: (None, "block"),
    12: ("org/fr/", "allow"), 13: (None, "allow"), 14: (None, "allow"), 15: ("org/fr/", "allow"), None: ("net/", "block"),
}


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, rule string")
    found = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert {k: (r.rule, r.verdict) for k, r in found.items()} == WANT
    assert (found[2].host, found[2].path) == ("a.example.net", "/fr/x") and (found[8].host, found[8].path) == ("net", "")
    assert (found[3].host, found[6].host, found[7].path) == ("example.com", "", "")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_logged_redirects(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None), (2, "http://b.org/", None)], "page_id long, url string, html string")
    links = spark.createDataFrame([("http://a.org/", "http://gone.net/1")], "a string, b string")
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, queries.URL_RULES, links).collect()}
    assert found == {1: "block", 2: "allow"}


def test_small_graphs_in_one_task_are_those_of_the_rounds(spark):
    import random

    from tarn.llm.components import components

    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    one, rounds = ({x.node: x.component for x in components(df, python=p).collect()} for p in (True, False))
    assert one == rounds and one[1100] == 1000
    assert components(df.limit(0), python=True).count() == 0
