from itertools import combinations

from riskloom.llm import url_filter as uf

SMALL = "/root/testdata/sf0.001"
PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"


def test_query_equals_sql(spark, agree):
    agree(uf.op12_url_filter(spark, SMALL), uf.SQL)


def planted():
    """URLs of which those with a tracker label and a query parameter have mostly bad labels."""
    urls, labels = [], []
    for i in range(300):
        host = ("ads.site.com", "blog.site.com", "www.other.com")[i % 3]
        query = ("?ref=1", "", "?page=2&x=3#end")[i % 7 % 3]
        urls.append((i, f"https://{host}/es/{i}{('', '.html', '/')[i % 5 % 3]}{query}"))
        labels.append((i, 0 if host[0] == "a" and query == "?ref=1" and i % 9 else 1, int(i % 41 == 0)))
    return urls, labels


def test_mined_rules_equal_apriori(spark):
    urls, labels = planted()
    pages = spark.createDataFrame(urls, PAGES)
    host, path = uf.parts(uf.F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"), uf.tokens(uf.F.col("url")).alias("tokens"))
    found = uf.labelled(rows, spark.createDataFrame(labels, LABELS))
    local = [(set(r["tokens"]), r["bad"]) for r in found.collect()]
    assert len(local) == 300
    n, bad = 300, sum(b for _, b in local)
    words = [w for w, _ in uf.vocabulary(found, n, bad)]
    sets = {}
    for tokens, b in local:
        held = [w for w in words if w in tokens][: uf.IN_FIT]
        for k in range(1, len(held) + 1):
            for c in combinations(sorted(held), k):
                a = sets.setdefault(c, [0, 0])
                a[0], a[1] = a[0] + 1, a[1] + b
    z = uf.Z
    low = lambda p, m: (p + z * z / (2 * m) - z * ((p * (1 - p) + z * z / (4 * m)) / m) ** 0.5) / (1 + z * z / m)
    rules = {c for c, (m, b) in sets.items() if b >= 5 and b / m >= uf.CONFIDENCE and low(b / m, m) > bad / n}
    mined = uf.mine(found).collect()
    assert {tuple(r["tokens"]) for r in mined} == rules and len(mined) == len(rules) and rules
    assert all(sets[tuple(r["tokens"])] == [r["n_tokens"], r["n_both"]] for r in mined)
    assert any({"3:ads", "?ref"} >= set(c) for c in rules)
    verdicts = {r["page_id"]: r["verdict"] for r in uf.judge(pages, spark.createDataFrame(labels, LABELS)).collect()}
    by_id = {r["page_id"]: set(r["tokens"]) for r in pages.select("page_id", uf.tokens(uf.F.col("url")).alias("tokens")).collect()}
    assert verdicts == {i: "block" if any(set(c) <= t for c in rules) else "allow" for i, t in by_id.items()}
    assert verdicts[0] == "block" and verdicts[1] == "allow"


def test_given_rules(spark):
    cases = [("http://NET/a", "net", "/a", "net/", "block"), ("http://a.Example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
             ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"), ("x://example.com/de/?q", "example.com", "/de/", "example.com/de/", "block"),
             ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"),
             ("http://internet/a", "internet", "/a", None, "allow"), ("http://a.net", "a.net", "", None, "allow"), ("http://a.net?x=/", "a.net", "", None, "allow"),
             ("a.net/b", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"), ("http://É.net/ü", "É.net", "/ü", "net/", "block")]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], PAGES)
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    assert out == {i: c[1:] for i, c in enumerate(cases)}


def test_odd_rows_and_empty_tables(spark):
    urls, labels = planted()
    long = "http://a.com/" + "seg/" * 5000 + "7?" + "&".join(f"k{i}=1" for i in range(3000))
    rows = [(*r, "x", "y") for r in [*urls, urls[0], (None, urls[0][1]), (1, None), (7, long)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, tokens string, verdict string")
    labels = spark.createDataFrame([*labels, (None, 0, 1), (3, None, None), (3, 1, 0), (7, 0, None)], LABELS)
    out = uf.judge(pages, labels).collect()
    assert len(out) == len(rows) and sum(r["page_id"] is None for r in out) == 1
    assert {r["verdict"] for r in out if r["path"] == "/es/0"} == {"block"}
    assert uf.judge(pages.limit(0), labels).count() == 0
    assert {r["verdict"] for r in uf.judge(pages, labels.limit(0)).collect()} == {"allow"}


def test_rules_of_any_token_and_any_place(spark):
    """More tokens than a bound kept, the telling pair last in each: F12."""
    urls, labels = [], []
    for i in range(400):
        pair = (i % 2, i // 2 % 2)  # bad where both or neither stand: alone they tell nothing
        noise = "/".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80) if (i * 7 + j * 13) % 80 < 4)
        same = "&".join(f"k{c}=1" for c in "abcdefghijklmnopqrstuvwx") + "&" if i % 40 == 3 else ""
        urls.append((i, f"https://site.com/es/{i}/{noise}?{same}" + "&".join(n for n, held in zip(("zy", "zz"), pair, strict=True) if held)))
        labels.append((i, int(pair[0] != pair[1]), 0))
    urls += [(1000, "https://other.org/?zz&zy"), (1001, "https://other.org/?zz")]
    pages, known = spark.createDataFrame(urls, PAGES), spark.createDataFrame(labels, LABELS)
    verdicts = {r["page_id"]: r["verdict"] for r in uf.judge(pages, known).collect()}
    assert verdicts[1000] == "block" and verdicts[1001] == "allow"


def test_tokens_of_the_same_urls_are_one_item(spark):
    rows = [(["a", "b", "u"], 1)] * 8 + [(["c", "u"], 0)] * 8
    found = spark.createDataFrame(rows, "tokens array<string>, bad int")
    one = uf.mine(found, alike=True)
    assert [r["choices"] for r in one.collect()] == [[["a", "b"]]]
    sets = spark.createDataFrame([(["a"],), (["b", "c"],), (["c", "u"],), (["u"],)], "tokens array<string>")
    same = [{tuple(r["tokens"]) for r in uf.blocked_sets(sets, m).collect()} for m in (one, uf.mine(found))]
    assert same[0] == same[1] == {("a",), ("b", "c")}
