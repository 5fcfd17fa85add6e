import duckdb
import pytest

from tessaprobe.llm import url_reputation as ur

URLS = [
    "http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/", "http://sub.www.example.com/en/z", "http://blog.example.com/en/y", "http://example.com/fr", "http://net/es/",
    "http://b.net/es/1", "http://b.net/en/1", "http://b.net/fr/", "ftp://c.org", "http://c.org?x=/es/", "http://c.org#/", "nonsense", "", None, "://", "http://", "http:///path", "x://y://z/en",
    "http://b.net/es", "http://com/", "http://notcom/", "http://d.co.uk/a", "http://e.d.co.uk/b", "http://co.uk/", "http://münchen.net/fr/x", "http://a.com", "HTTP://A.COM/É?é",
]


def table(spark, urls, extra=()):
    return spark.createDataFrame([(i, u) + tuple("z" for _ in extra) for i, u in enumerate(urls)], "page_id bigint, url string" + "".join(f", {c} string" for c in extra))


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for action, rule in ur.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in ur.judged(table(spark, URLS, ("host", "path", "n"))).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, best = brute(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), url
        assert got[i].verdict == best[0] if best else got[i].verdict in ("allow", "block")


@pytest.mark.parametrize("urls", [URLS, URLS * 3 + [f"http://h{i % 7}.net/{'es' if i % 3 else 'en'}/{i}" for i in range(200)], ["http://q.org/"], []])
def test_posteriors_equal_sql(spark, urls):
    got = {r.page_id: (r.verdict, r.bad_mean) for r in ur.judged(table(spark, urls)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if urls:
        con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    want = {r[0]: (r[4], r[5]) for r in con.execute(ur.op9_sql()).fetchall()}
    assert got.keys() == want.keys()
    for k, (verdict, mean) in got.items():
        assert verdict == want[k][0] and abs(mean - want[k][1]) < 1e-6


def test_shrinkage_needs_evidence(spark):
    rules = (("block", "bad.org/x/"), ("allow", "good.org/x/"))
    urls = [f"http://bad.org/x/{i}" for i in range(60)] + [f"http://good.org/x/{i}" for i in range(60)] + ["http://bad.org/y", "http://good.org/y", "http://new.org/"]
    got = [r.verdict for r in ur.judged(table(spark, urls), ur.Reputation(rules=rules)).orderBy("page_id").collect()][-3:]
    assert got == ["block", "allow", "allow"]


def test_hot_hosts_are_dealt_in_ways(spark):
    urls = [f"http://hot.net/{'es' if i % 2 else 'en'}/{i}" for i in range(300)] + [f"http://h{i}.net/en/" for i in range(60)] + [None, None]
    plain, dealt = ({r.page_id: r for r in ur.judged(table(spark, urls), ur.Reputation(hot_share=n)).collect()} for n in (1, 50))
    assert len(plain) == len(dealt) == len(urls) and plain == dealt


def test_suffixes_are_a_parameter(spark):
    urls = [f"http://{h}.example.uk/x" for h in "abc"] + ["http://b.net/es/1"]
    for suffixes in ((), ("example.uk",)):
        assert ur.judged(table(spark, urls), ur.Reputation(suffixes=suffixes)).count() == 4


def test_very_long_url(spark):
    got = ur.judged(table(spark, ["http://a.org/" + "x" * 2_000_000, "http://" + "y" * 500_000 + ".org/"])).collect()
    assert sorted(len(r.path) for r in got) == [1, 2_000_001]
