"""URL filter and fingerprints: against plain Python, and their plans without Python."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from millrace.llm import fingerprint, urlfilter

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, says) for h, p, says in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


ODD = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "HTTPS://Sub.Example.ORG/es/x?y=/en/1", "x://example.org/en/12#top", "http://notexample.org/es/",
    "http://a.com/fr/é", "http://com/de", "http://com/de/", "http://a.net?x://b.org/", "http://é.net/ü" + "x" * 5000, "://x.org/", "http://a.org/en://b",
]


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame([(k, url, "h") for k, url in enumerate(ODD)] + [(None, "http://a.org/", "h"), (0, None, "h")], "page_id long, url string, host string")
    rows = urlfilter.judged(pages).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r["page_id"] is not None:
            host, path = plain_parts(ODD[r["page_id"]])
            rule, says = plain_rule(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == says if says else r["verdict"] in ("allow", "block")
    assert urlfilter.judged(pages.limit(0)).collect() == []


def plain_ratio(rows):
    """What each n-gram adds to the log ratio, by the recursion over shorter contexts."""
    counts = {"allow": Counter(), "block": Counter()}
    for url, says in rows:
        for end in range(1, len(url) + 1):
            for n in range(1, min(urlfilter.ORDER, end) + 1):
                counts[says][url[end - n : end]] += 1
    single = {says: sum(v for g, v in own.items() if len(g) == 1) for says, own in counts.items()}

    def chance(gram, says):
        own = counts[says]
        if len(gram) == 1:
            return (own[gram] + urlfilter.LEAN / urlfilter.LETTERS) / (single[says] + urlfilter.LEAN)
        return (own[gram] + urlfilter.LEAN * chance(gram[1:], says)) / (own[gram[:-1]] + urlfilter.LEAN)

    ratio = lambda gram: math.log(chance(gram, "allow") / chance(gram, "block"))
    known = set(counts["allow"]) | set(counts["block"])
    return {g: ratio(g) - (ratio(g[1:]) if len(g) > 1 else 0) for g in known}


def test_models_against_plain_recursion(spark):
    rows = [("http://good.net/aab/1", "allow"), ("http://good.net/abc", "allow"), ("http://bad.net/zzy/9", "block"), ("http://bad.net/zz", "block"), ("http://good.net/abc", "allow")]
    table = {r["_bin"]: r["_adds"] for r in urlfilter.ratios(spark.createDataFrame(rows, "u string, v string"), "u", "v").collect()}
    adds = plain_ratio(rows)
    asked = spark.createDataFrame([(len(g), g) for g in adds], "_n int, _gram string").select("_gram", urlfilter._bin())
    bins = {r["_gram"]: r["_bin"] for r in asked.collect()}
    shared = Counter(bins.values())
    alone = [g for g in adds if shared[bins[g]] == 1]
    assert len(alone) > 0.9 * len(adds)
    assert all(table[bins[g]] == pytest.approx(adds[g], abs=1e-9) for g in alone)
    frame = spark.createDataFrame([("http://good.net/new",), ("http://bad.net/new",)], "u string")
    scores = {r["u"]: r["score"] for r in urlfilter.scored(frame, urlfilter.ratios(spark.createDataFrame(rows, "u string, v string"), "u", "v"), "u").collect()}
    assert scores["http://good.net/new"] > 0 > scores["http://bad.net/new"]


@pytest.mark.parametrize("hot", [1, 40, 1 << 16])
def test_every_gram_keeps_its_own_weight(spark, hot, monkeypatch):
    """Scores are the plain sums over n-grams, wherever a weight is looked up, and however few bins there once were."""
    monkeypatch.setattr(urlfilter, "BINS", 16, raising=False)
    monkeypatch.setattr(urlfilter, "HOT", hot, raising=False)
    rows = [(f"http://good.net/a{k * 37 % 101}b/{k}", "allow") for k in range(30)] + [(f"http://bad.net/z{k * 53 % 103}y/{k}", "block") for k in range(30)]
    adds = plain_ratio(rows)
    table = urlfilter.ratios(spark.createDataFrame(rows, "u string, v string"), "u", "v")
    asked = ["http://good.net/new/7", "http://bad.net/zz9/é", "http://else.org/12", rows[3][0]]
    found = {r["u"]: r["score"] for r in urlfilter.scored(spark.createDataFrame([(u,) for u in asked], "u string"), table, "u").collect()}
    for u in asked:
        own = [u[end - n : end] for end in range(1, len(u) + 1) for n in range(1, min(urlfilter.ORDER, end) + 1)]
        assert found[u] == pytest.approx(sum(adds.get(g, 0.0) for g in own) / len(u), abs=1e-9)


def test_verdicts_follow_the_models(spark):
    pages = [(k, f"http://shop.com/fr/garden{k % 17}/rose{k}") for k in range(300)] + [(1000 + k, f"http://shop.com/de/casino{k % 17}/spin{k}") for k in range(300)]
    pages += [(5000 + k, f"http://other.net/garden{k}/rose") for k in range(20)] + [(6000 + k, f"http://other.net/casino{k}/spin") for k in range(20)]
    rows = {r["page_id"]: r["verdict"] for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert all(says == ("allow" if k % 1000 == k or 5000 <= k < 6000 else "block") for k, says in rows.items())


def test_url_query(spark):
    from millrace.llm.queries import op6_url_filter

    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op6_url_filter(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain_parts(urls[r["page_id"]])
        rule, says = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (says or r["verdict"])


def jaccard(one, two):
    one, two = Counter(one), Counter(two)
    words = one.keys() | two.keys()
    return sum(min(one[w], two[w]) for w in words) / sum(max(one[w], two[w]) for w in words) if words else 1.0


def words(text):
    return text.replace("\x0b", " ").split() if text.isascii() else [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]


def check(rows, docs):
    """Contract columns, and how far likenesses are from the generalised Jaccard similarity."""
    texts = [t or "" for _, t in docs]
    by_key = defaultdict(list)
    for r in rows:
        by_key[r["doc_id"]].append(r)
    prints, gaps = {}, []
    for k, (key, _) in enumerate(docs):
        own, after = texts[k], texts[(k + 1) % len(docs)]
        part = len(own) // 4
        edited = own[: len(own) - part] + after[:part]
        r = by_key[key].pop()
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        for text, mark in ((own, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(tuple(sorted(words(text))), mark) == mark
        gaps += [r["near_edited"] - jaccard(words(own), words(edited)), r["near_next"] - jaccard(words(own), words(after))]
    return gaps


def test_fingerprint_query(spark):
    from millrace.llm.queries import op8_fingerprints

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    gaps = check(op8_fingerprints(spark, SF).collect(), docs)
    assert abs(sum(gaps) / len(gaps)) < 0.02
    assert (sum(g * g for g in gaps) / len(gaps)) ** 0.5 < 0.09


def test_samples_collide_as_often_as_weights_are_alike(spark):
    """Many samples of one pair of documents whose words differ in weight alone."""
    one, two = "a a a a b b c d d d", "a b b b b c c c e e"
    frame = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(frame, many=1500).collect()}
    same = sum(prints[1][k : k + 8] == prints[2][k : k + 8] for k in range(0, 12_000, 8)) / 1500
    assert same == pytest.approx(jaccard(one.split(), two.split()), abs=0.04)


def test_fingerprints_of_odd_rows(spark):
    docs = [(None, "null key"), (1, None), (2, ""), (3, "é😀 " * 9), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (9, "long " * 30_000 + "\x1c end")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, _hash int")
    rows = fingerprint.against_next(frame).collect()
    assert len(rows) == len(docs)
    once = [x for k, x in enumerate(docs) if k != 5]
    seen = {r["doc_id"]: r for r in rows}
    check(seen.values(), once)
    assert seen[1]["fingerprint"] == seen[2]["fingerprint"] and seen[1]["near_next"] == 1.0 and seen[2]["near_next"] == 0.0
    assert fingerprint.against_next(frame.limit(0)).collect() == []
    only = fingerprint.against_next(frame.where("doc_id = 5").limit(1)).collect()
    assert only[0]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(frame).collect()}
    assert all(plain[k] == r["fingerprint"] for k, r in seen.items())


@pytest.mark.parametrize("name", ["op6_url_filter", "op8_fingerprints"])
def test_no_python_in_the_plans(spark, name, monkeypatch):
    from millrace.llm import queries
    from millrace.operators import ordered

    plans = []
    for module in (urlfilter, fingerprint):
        plain = module.settle
        monkeypatch.setattr(module, "settle", lambda df, label, plain=plain: plans.append(df._jdf.queryExecution().toString()) or plain(df, label))
    assert ordered
    frame = queries.QUERIES[name][0](spark, SF)
    plans.append(frame._jdf.queryExecution().toString())
    assert len(plans) > 3 and not any(word in plan for plan in plans for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
