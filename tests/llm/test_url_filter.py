import random
import re

from pyspark.sql import functions as F

from lisible.llm import url_filter as uf


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for _, rule in uf.RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            if best is None or len(rule) > len(best):
                best = rule
    return host, path, best


def urls():
    rng = random.Random(2)
    hosts = ["com", "example.com", "WWW.example.com", "a.www.example.com", "xexample.com", "net", "b.net", "o.org", "É.net", ""]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?a=/en/", "?x=/es/", "#/fr/", "/de/://net/es/", "/en/\n/x"]
    made = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths]
    return made + [None, "", "no scheme/en/", "mailto:x@y", "a://b://net/es/", *rng.choices(made, k=20)]


def test_rules_equal_plain_code(spark):
    rows = [(i, u, None) for i, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in uf.judge_urls(pages).collect()}
    assert len(got) == len(rows)
    verdicts = {r: v for v, r in uf.RULES}
    for i, u, _ in rows:
        host, path, rule = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == verdicts[rule]


def brute(edges, trusted, blocked, rounds=300):
    """{host: (trust, distrust, faith, blame)} by repeated sums over dictionaries; seeds are {host: share}."""
    out, into = {}, {}
    for (a, b), n in edges.items():
        out.setdefault(a, {})[b] = n
        into.setdefault(b, {})[a] = n
    hosts = {h for e in edges for h in e} | set(trusted) | set(blocked)

    def walk(graph, seeds):
        s = {}
        for _ in range(rounds):
            new = {h: (1 - uf.DAMPING) * v for h, v in seeds.items()}
            for a, v in s.items():
                for b, n in graph.get(a, {}).items():
                    new[b] = new.get(b, 0) + uf.DAMPING * v * n / sum(graph[a].values())
            s = new
        return s

    told = {}
    for k, (graph, seeds) in enumerate(((out, trusted), (into, blocked))):
        score, plain = walk(graph, seeds), walk(graph, dict.fromkeys(hosts, 1.0))
        for h in hosts:
            through = plain[h] - (1 - uf.DAMPING)
            mass = (score.get(h, 0) - (1 - uf.DAMPING) * seeds.get(h, 0)) / through if through > 1e-9 else 0.0
            told.setdefault(h, [0.0] * 4)[k], told[h][2 + k] = score.get(h, 0.0), max(seeds.get(h, 0.0), mass)
    return told


def graph(seed, n=15, links=40):
    rng = random.Random(seed)
    names = [f"h{i}.org" for i in range(n)]
    edges = {}
    for _ in range(links):
        a, b = rng.sample(names, 2)
        edges[a, b] = edges.get((a, b), 0) + rng.randint(1, 5)
    return names, edges


def test_propagation(spark):
    names, edges = graph(7)
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    trusted, blocked = {names[0]: 1.0, names[1]: 0.5}, {names[3]: 0.25, names[4]: 1.0, "lone.org": 1.0}
    seeds = [spark.createDataFrame(list(s.items()), "host string, share double") for s in (trusted, blocked)]
    want = brute(edges, trusted, blocked)
    got = {r.host: r for r in uf.propagate(links, *seeds).collect()}
    assert set(got) == set(want)
    for h, (trust, distrust, faith, blame) in want.items():
        assert abs(got[h].trust - trust) < 3e-3 and abs(got[h].distrust - distrust) < 3e-3
        assert abs(got[h].faith - faith) < 3e-3 and abs(got[h].blame - blame) < 3e-3


def test_verdicts_equal_brute_force(spark):
    names, edges = graph(11, 30, 70)
    names[:3], renamed = ["a.com", "b.com", "c.com"], dict(zip(names[:6], ["a.com", "b.com", "c.com", "x.net", "y.net", "z.net"]))
    names = [renamed.get(h, h) for h in [f"h{i}.org" for i in range(30)]]
    edges = {(renamed.get(a, a), renamed.get(b, b)): n for (a, b), n in edges.items()}
    rows = [(a, f'<a href="http://{b}/">l</a>' * n) for (a, b), n in edges.items()]
    pages = [(i, f"http://{a}/p", h) for i, (a, h) in enumerate(rows)] + [(500 + i, f"http://{h}/q", None) for i, h in enumerate(names)]
    pages += [(900 + i, f"http://{h}/es/1", None) for i, h in enumerate(["x.net", "y.net", "z.net"] * 4)]
    count = {}
    for _, u, _ in pages:
        host, _, rule = plain(u)
        c = count.setdefault(host, [0, 0, 0])
        c[0] += 1
        c[1] += rule == "com/"
        c[2] += rule == "net/es/"
    want = brute(edges, {h: a / n for h, (n, a, _) in count.items() if a}, {h: b / n for h, (n, _, b) in count.items() if b})
    verdicts = set()
    for r in uf.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        if r.rule is None:
            _, _, faith, blame = want.get(r.host, (0, 0, 0, 0))
            if abs(blame - faith - uf.THRESHOLD) > 0.01:
                assert r.verdict == ("block" if blame - faith >= uf.THRESHOLD else "allow"), r
                verdicts.add(r.verdict)
    assert verdicts == {"allow", "block"}


def test_hub_that_all_link_to(spark):
    rows = [(f"h{i}", "hub", 1) for i in range(400)] + [("hub", "x", 1), ("x", "hub", 2)]
    got = {r.host: r for r in uf.propagate(spark.createDataFrame(rows, "src string, dst string, n long"), spark.createDataFrame([("x",)], "host string"),
                                           spark.createDataFrame([("hub",)], "host string")).collect()}
    want = brute({(a, b): n for a, b, n in rows}, {"x": 1.0}, {"hub": 1.0})
    assert all(abs(getattr(got[h], c) - want[h][k]) < 3e-3 for h in want for k, c in enumerate(("trust", "distrust", "faith", "blame")))


def test_links_decide_where_no_rule_fits(spark):
    bad = "<a HREF='//spam.net/x'>x</a><a href=\"https://Spam.net/y\">y</a>"
    good = '<a href="http://nice.org/">n</a>'
    rows = [(1, "http://spam.net/es/1", None), (2, "http://spam.net/fr/1", None), (3, "http://spam.net/en/1", ""),
            (4, "http://farm.org/1", bad), (5, "http://good.com/1", good), (6, "http://nice.org/1", None), (7, "http://lone.org/", "<a href='/x'>")]
    pages = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows + [rows[3]]], "page_id long, url string, html string, trust double")
    got = [(r.page_id, r.verdict) for r in uf.judge_urls(pages).collect()]
    assert len(got) == 8 and got.count((4, "block")) == 2
    assert dict(got) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    assert uf.host_edges(pages).where(F.col("src") == "farm.org").collect()[0].n == 4


def test_empty(spark):
    assert uf.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_farm_is_blocked_and_directory_is_not(spark):
    rows = [(1, "http://spam.net/es/1", None), (2, "http://half.net/fr/1", None), (3, "http://half.net/en/1", None)]
    rows += [(100 + i, f"http://farm{i}.org/", '<a href="http://spam.net/">x</a>') for i in range(300)]
    rows += [(500, "http://big.org/1", '<a href="http://spam.net/">x</a>' * 200), (501, "http://fan.org/1", '<a href="http://half.net/">x</a>' * 3)]
    links = "".join(f'<a href="http://site{i}.org/">x</a>' for i in range(50))
    rows += [(600, "http://directory.org/", links + '<a href="http://spam.net/">x</a>'), (601, "http://site1.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in uf.judge_urls(pages).collect()}
    assert all(got[100 + i].verdict == "block" for i in range(300)) and got[500].verdict == "block"
    assert got[3].verdict == "block" and got[501].verdict == "block"  # half of half.net's urls are blocked
    assert got[600].verdict == got[601].verdict == "allow"
