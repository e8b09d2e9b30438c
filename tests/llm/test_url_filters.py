import random
from itertools import combinations

from boxframe.llm import url_filters
from boxframe.llm.common import stored

URLS = [
    "http://a.example.com/en/7", "https://example.com/en/6?x=/en/7", "http://EXAMPLE.com/en/", "http://com/en/", "http://mycom/en/", "ftp://x.net/de/8", "http://b.example.net/de/8#f", "http://o.org/es/x",
    "no scheme", None, "http://", "http://h", "http://h?q=://z/en/", "http://spam.site/buy/now", "http://spam.site/buy/now",
]
EXPECTED = [
    ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/6", "com/en/", "block"), ("example.com", "/en/", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("mycom", "/en/", None, None),
    ("x.net", "/de/8", "net/de/", "allow"), ("b.example.net", "/de/8", "example.net/de/8", "block"), ("o.org", "/es/x", "org/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, None), ("h", "", None, None),
]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as verdict")


def test_hosts_paths_and_rules(spark):
    got = {x.page_id: x for x in url_filters.judge(pages(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, (host, path, rule, verdict) in enumerate(EXPECTED):
        x = got[i]
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict == (verdict or x.verdict) and x.verdict in ("allow", "block")


def brute_rules(transactions, least, confidence, lift=url_filters.MIN_LIFT):
    """Every combination of tokens that enough urls of a label have, with its confidence over all urls that have it, by counting."""
    out = {}
    for n in range(1, max(len(t) for t, _ in transactions) + 1):
        for c in {c for t, label in transactions if label for c in combinations(sorted(t), n)}:
            labels = [label for t, label in transactions if set(c) <= t]
            for label in {*labels} - {None}:
                k, base = labels.count(label), sum(x == label for _, x in transactions) / len(transactions)
                if k >= least and k / len(labels) >= confidence and k / len(labels) >= lift * base:
                    out[c, label] = (k / len(labels), k)
    return out


def test_mined_rules_against_counting(spark):
    """Verdicts equal those of all combinations counted one by one, where the search sees all tokens."""
    r = random.Random(3)
    words = ["buy", "read", "cheap", "now", "news", "a1", "\u00e9t\u00e9"]
    path = lambda: "/".join(r.sample(words, r.randint(1, 4)))
    urls = [f"http://s{i % 3}.shop.com/en/{path()}" for i in range(60)] + [f"http://n{i % 3}.news.net/de/{path()}" for i in range(60)]
    urls += [f"http://x.shop.com/buy/{path()}" for _ in range(12)] + [f"http://x.org/{path()}" for _ in range(40)] + [f"http://news.net/x/de/{path()}" for _ in range(9)]
    rows = url_filters.curated(url_filters.parsed(pages(spark, urls))).withColumn("tokens", url_filters.tokens()).collect()
    known = {(x.host, x.path): (set(x.tokens), x["__bf_rule_verdict"]) for x in rows}
    verdicts = set()
    for confidence in (0.6, 0.9):
        rules = brute_rules(list(known.values()), 5, confidence)
        assert any(len(c) > 2 for c, _ in rules)
        token_sets = {x.page_id: set(x.tokens) for x in rows}
        for x in url_filters.judge(pages(spark, urls), min_count=5, min_confidence=confidence).where("rule is null").collect():
            fit = [(*v, label == "block", label) for (c, label), v in rules.items() if set(c) <= token_sets[x.page_id]]
            assert x.verdict == (max(fit)[-1] if fit else "allow")
            verdicts.add((bool(fit), x.verdict))
    assert (True, "block") in verdicts and (False, "allow") in verdicts


def test_a_host_alone_is_no_rule(spark):
    """Urls of a host that no curated rule fits count against it, the more of them there are."""
    urls = [f"http://h{i}.com/en/x{i % 3}" for i in range(200)] + [f"http://h{i}.com/shop/x{i % 3}" for i in range(100)] + [f"http://h{i}.net/de/x" for i in range(60)]
    got = url_filters.judge(pages(spark, urls)).where("rule is null").collect()
    assert len(got) == 100 and {x.verdict for x in got} == {"allow"}
    urls += [f"http://h{i}.com/en/casino/{i}" for i in range(40)] + ["http://h1.com/q/casino", "http://h1.com/fr/casino"]
    got = {x.url: x.verdict for x in url_filters.judge(pages(spark, urls)).where("rule is null").collect()}
    assert got["http://h1.com/q/casino"] == got["http://h1.com/fr/casino"] == "block" and set(list(got.values())[:100]) == {"allow"}


def test_few_urls_support_nothing(spark):
    urls = [f"http://w.com/en/spam{i}" for i in range(4)] + ["http://x.org/spam1"]
    assert {x.verdict for x in url_filters.judge(pages(spark, urls)).where("rule is null").collect()} == {"allow"}


def test_long_urls_end(spark):
    """Forty words shared by many urls would be 2**40 combinations."""
    words = "/".join(f"w{k}" for k in range(40))
    urls = [f"http://s{i % 2}.shop.com/en/{words}/{i}" for i in range(40)] + [f"http://n{i % 2}.news.net/de/{words}/{i}" for i in range(40)] + [f"http://x.org/{words}"]
    assert url_filters.judge(pages(spark, urls)).where("rule is null").count() == 1


def test_words_that_nearly_all_urls_share_end(spark):
    """Twenty words, each in 95 of 100 urls of either label: nearly all of a million combinations are frequent."""
    r = random.Random(8)
    slug = lambda: "/".join(f"w{k}" for k in range(20) if r.random() < 0.95)
    urls = [f"http://s{i % 2}.shop.com/en/{slug()}/{i}" for i in range(200)] + [f"http://n{i % 2}.news.net/de/{slug()}/{i}" for i in range(200)] + [f"http://x.org/{slug()}/{i}" for i in range(20)]
    got = url_filters.judge(pages(spark, urls)).where("rule is null").collect()
    assert len(got) == 20 and {x.verdict for x in got} == {"allow"}


def test_clashing_columns_stay(spark):
    extra = ["mined", "rule_verdict", "tokens", "items", "item", "token", "n", "label", "best", "have"]
    p = pages(spark, ["http://a.com/en/x", "http://b.de/x", None]).selectExpr("*", *[f"'own' as {c}" for c in extra])
    got = url_filters.judge(p)
    assert set(got.columns) == {*p.columns, "path", "rule"} and all(x[c] == "own" for x in got.collect() for c in extra)


def test_nothing_labelled_and_empty(spark):
    assert {x.verdict for x in url_filters.judge(pages(spark, ["http://h/a", None])).collect()} == {"allow"}
    assert url_filters.judge(pages(spark, ["a"]).where("false")).count() == 0


def test_combinations_of_less_telling_tokens(spark):
    """a with b blocks, neither alone does; in the urls that teach it, more than TELLING tokens have more lift."""
    decoys = "/".join(f"d{k}" for k in range(12))
    urls = [f"http://s.com/en/{decoys}/a/b/{i}" for i in range(40)] + [f"http://x.net/de/{w}/{i}" for w in "ab" for i in range(30)] + ["http://x.org/q/a/b", "http://x.org/q/a", "http://x.org/q/b"]
    got = {x.url: x.verdict for x in url_filters.judge(pages(spark, urls)).where("rule is null").collect()}
    assert got == {"http://x.org/q/a/b": "block", "http://x.org/q/a": "allow", "http://x.org/q/b": "allow"}


def test_search_by_bounds_against_counting(spark):
    """With one token a url for FP-growth, the levels find the best rule of every url."""
    r = random.Random(4)
    words = ["buy", "read", "cheap", "now", "news", "a1"]
    path = lambda: "/".join(r.sample(words, r.randint(1, 5)))
    urls = [f"http://s{i % 3}.shop.com/en/{path()}" for i in range(60)] + [f"http://n{i % 3}.news.net/de/{path()}" for i in range(60)]
    urls += [f"http://x.shop.com/buy/{path()}" for _ in range(12)] + [f"http://x.org/{path()}" for _ in range(25)]
    rows = url_filters.curated(url_filters.parsed(pages(spark, urls))).withColumn("tokens", url_filters.tokens())
    rows = stored(rows.select("host", "path", "tokens", rows["__bf_rule_verdict"].alias("verdict")).dropDuplicates(["host", "path"]), "urls")
    known = [(set(x.tokens), x.verdict) for x in rows.collect()]
    rules = brute_rules(known, 5, 0.6)
    found = [(set(x["items"]), x.label, x.confidence, x.support) for x in url_filters.mine(rows, min_confidence=0.6, min_count=5, telling=1).collect()]
    assert all(rules[tuple(sorted(c)), label] == (confidence, n) for c, label, confidence, n in found) and any(len(c) > 1 for c, *_ in found)
    for t, verdict in known:
        if verdict is None:
            fit = [(*v, label) for (c, label), v in rules.items() if set(c) <= t]
            mine = [(confidence, n, label) for c, label, confidence, n in found if c <= t]
            assert max(fit, default=None) == max(mine, default=None)
