"""Mining where URLs repeat and are long, and the hand-written rules one page at a time."""

import random
import time

import pytest

from gridloom.llm import queries, urlfilter


@pytest.mark.parametrize("copies", (6, 1000))
def test_long_urls_that_repeat(spark, copies):
    """A bad URL of 40 tokens, many times over: mined in seconds, and any of its tokens that no good URL has is a sign, as each alone is a rule."""
    long = "http://x.net/" + "/".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(38))
    rows = [(i, long, True) for i in range(copies)] + [(10_000 + i, f"http://x.net/news/{chr(97 + i % 20)}", False) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    began = time.time()
    rules = urlfilter.mine(df).collect()
    assert time.time() - began < 60
    assert len({tuple(r.tokens) for r in rules}) == 1 and len({r.index_token for r in rules}) == 38 and {r.confidence for r in rules} == {1.0}
    pages = [(1, long), (2, "http://y.org/pab"), (3, "http://x.net/news/a"), (4, "http://x.net/pzz/other"), (5, None)]
    judged = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), [], urlfilter.mine(df))
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_items_of_several_tokens_in_one_rule(spark):
    """Two groups of tokens that go together; only pages with some of each are bad."""
    left, right = ["la", "lb", "lc"], ["ra", "rb"]
    rows = [(i, "http://h/" + "/".join((left if i % 2 else []) + (right if i % 3 == 0 else []) + [f"o{'abc'[i % 3]}"]), i % 6 == 3) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = urlfilter.mine(df, min_confidence=0.9)
    assert {tuple(sorted(len(a) for a in r.any_of)) for r in mined.collect()} == {(3, 3)}  # oa goes with ra and rb
    pages = [(1, "http://h/lb/ra"), (2, "http://h/lb"), (3, "http://h/rb/zz"), (4, "http://h/lc/oa"), (5, "http://h/la/ob")]
    judged = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), [], mined)
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}


def test_hand_rules_by_brute_force(spark):
    """Host, path, rule and verdict of pages of all kinds, worked out one by one."""
    r = random.Random(12)
    hosts = ["org", "ORG", "example.org", "Example.Org", "a.example.org", "notexample.org", "com", "x.com", "comx", "com.fr", "org.", "", "é.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/en/2", "/fr/", "/fr/a", "/de/", "/de/x", "//de/", "/DE/", "/es/../x", "/fr/\n"]
    tails = ["", "?q=/de/", "#f", "?a#b", "#/es/"]
    urls = [f"{r.choice(['http', 'https', 'x', ''])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(tails)}" for _ in range(600)] + [None, "", "no scheme", "://", "http:/com/de/", "a://com/de/://org/"]

    def judged(url):
        at = -1 if url is None else url.find("://")
        if at < 0:
            return "", "", None
        rest = url[at + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(text), text) for _, text in queries.URL_RULES if (host == text.split("/", 1)[0] or host.endswith("." + text.split("/", 1)[0])) and path.startswith("/" + text.split("/", 1)[1])]
        return host, path, max(fits)[1] if fits else None

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = urlfilter.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = {x.page_id: x for x in urlfilter.judge(pages, queries.URL_RULES, none).collect()}
    kinds = {text: kind for kind, text in queries.URL_RULES}
    for i, url in enumerate(urls):
        host, path, rule = judged(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, kinds.get(rule, "allow")), url
    assert {x.rule for x in got.values()} == {None, *kinds}
