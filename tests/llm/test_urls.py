"""Operator 6: fixed rules against plain Python, mined rules against brute force over all token sets."""

import itertools
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://a.NET", "http://a.net/", "http://net/x", "http://anet/", "https://Example.net/en/1?x=http://q.org/fr/", "https://x.example.net/EN/", "x://b.example.com/de/5#f",
    "http://example.com/de", "http://q.org/fr/", "http://q.org?u=/fr/", "http://q.org#/fr/", "://org/fr/", "http://É.net/", "a\nb://c.net/\n?", "http://x.net/" + "a/" * 50000, "http:///de/",
]


def test_fixed_rules(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, "http://b.net/", "y")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    key = lambda r: tuple(map(str, r))
    want = [(i, *brute(u), RULES.get(brute(u)[2], "allow"), None) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def planted(spark):
    pages, labels = [], []
    for k in range(600):
        section, bad = ("promo", k % 10 != 0) if k % 3 == 0 else ("news", k % 10 == 0)
        pages.append((k, f"https://h{k % 5}.site.io/{section}/{'deep/' if k % 2 else ''}{k}?id={k}"))
        if k % 4:
            labels.append((k, 0 if bad else 1, 0))
    labels += [(1, 1, 0), (None, 0, 1), (2, None, None)]
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mined_rules_equal_brute_force(planted):
    pages, labels = planted
    settings = urls.Settings(min_support=0.05, min_confidence=0.6)
    tokens = {r.page_id: tuple(sorted(r.t)) for r in pages.select("page_id", urls.tokens_of(F.col("url")).alias("t")).collect()}
    worst = {}
    for r in labels.collect():
        if r.doc_id in tokens and not (r.quality is None and r.toxic is None):
            worst[r.doc_id] = max(worst.get(r.doc_id, False), r.quality == 0 or r.toxic == 1)
    seen, bad = Counter(), Counter()
    for page, is_bad in worst.items():
        for n in range(1, len(tokens[page]) + 1):
            for s in itertools.combinations(tokens[page], n):
                seen[s] += 1
                bad[s] += is_bad
    rules = {s: bad[s] / seen[s] for s in seen if bad[s] / len(worst) >= 0.05 and bad[s] / seen[s] >= 0.6}
    kept = {s: c for s, c in rules.items() if not any(rules.get(s[:k] + s[k + 1 :], 0) >= c for k in range(len(s)))}
    # a rule of items stands for one of every choice of tokens
    got = {tuple(sorted(choice)): r.u_confidence for r in urls.mine(pages, labels, settings).collect() for choice in itertools.product(*r.u_rule)}
    assert set(got) == set(kept) and all(got[s] == pytest.approx(kept[s]) for s in got)
    judged = {r.page_id: r for r in urls.judge_urls(pages, labels, settings).collect()}
    for page, own in tokens.items():
        sure = max((c for s, c in kept.items() if set(s) <= set(own)), default=None)
        assert judged[page].mined_confidence == (None if sure is None else pytest.approx(sure))
        assert judged[page].verdict == ("allow" if sure is None else "block")


def test_empty(planted):
    pages, labels = planted
    assert urls.judge_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, labels.limit(0)).collect()} == {"allow"}


def test_a_long_labelled_url_is_one_item(spark):
    """Forty different segments on one page: their sets aren't listed, and the rule that the page makes is found."""
    pages = [(k, f"https://a.io/{k % 7}x/") for k in range(40)] + [(40, "https://a.io/" + "/".join(f"s{chr(97 + k % 26)}{'z' * (k // 26)}" for k in range(40)))]
    labels = [(k, 1, 0) for k in range(40)] + [(40, 0, 0)]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    urls.judge_urls(*frames).count()  # once, to warm up
    begin = time.perf_counter()
    judged = {r.page_id: r.verdict for r in urls.judge_urls(*frames).collect()}
    assert time.perf_counter() - begin < 30  # the sets of forty tokens would take for ever
    assert judged == {k: "block" if k == 40 else "allow" for k in range(41)}


def test_a_large_index_is_joined_by_shuffle(planted, monkeypatch):
    pages, labels = planted
    settings = urls.Settings(min_support=0.05, min_confidence=0.6)
    small = sorted(map(tuple, urls.judge_urls(pages, labels, settings).collect()))
    monkeypatch.setattr(urls, "MOST_RULES", 0)
    assert sorted(map(tuple, urls.judge_urls(pages, labels, settings).collect())) == small
    assert {r[4] for r in small} == {"allow", "block"}
