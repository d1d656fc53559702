import re

import pytest

from varscope.llm.url_filter import judge_urls, spread_trust

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def _rule(host, path):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def _scores(pages, damping=0.85):
    """Dense personalised PageRank over the links between hosts."""
    hosts = sorted({_parts(u)[0] for _, u, _ in pages} - {""})
    links, seeds = {}, {}
    for _, url, html in pages:
        host, path = _parts(url)
        if host:
            seeds.setdefault(host, []).append(_rule(host, path)[1])
        for link in re.findall(r"href=\"((?:https?:)?//[^\"]+)", html or ""):
            other = _parts("x://" + link.split("//", 1)[1])[0]
            if host and other and other != host:
                links[host, other] = links.get((host, other), 0) + 1
    nodes = sorted(set(hosts) | {x for e in links for x in e})
    out = {s: sum(n for (a, _), n in links.items() if a == s) for s in nodes}
    weight = {e: n / out[e[0]] for e, n in links.items()}
    back = {(b, a): w for (a, b), w in weight.items()}

    def rank(steps, verdict):
        start = {}
        for h, said in seeds.items():
            share = sum(v == verdict for v in said) / len(said)
            start[h] = (1 - damping) * share if share > 0.5 else 0.0
        now = dict(start)
        for _ in range(20):
            now = {n: start.get(n, 0) + damping * sum(now.get(a, 0) * w for (a, b), w in steps.items() if b == n) for n in nodes}
        return now
    return rank(weight, "allow"), rank(back, "block")


def test_rules_links_and_edges_match_brute_force(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)
    pages = [
        (1, "https://A.com/x?y#z", link("friend.org", "b.net")), (2, "http://b.net/es/1", link("a.com")),
        (3, "http://b.net/fr/", None), (4, "https://spam.org/1", link("b.net", "b.net", "a.com")), (5, "https://friend.org", ""),
        (6, "http://example.com/en/1", '<a href="/local">l</a>'), (7, "http://www.example.com/en/1", link("www.example.com")),
        (8, None, link("b.net")), (9, "no scheme", link("b.net")), (10, "http:///path", "x"), (11, "x://h?q=a/b", "x"),
        (12, "ftp://farm.org/", link("b.net")), (12, "ftp://farm.org/", link("b.net")), (None, "http://notexample.com/en/", "<img src=//b.net/i>"),
        (13, "HTTP://" + "x" * 50_000 + ".com/" + "y" * 50_000, link("farm.org") * 2_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'c' AS host", "'s' AS score", "1 AS rule")
    rows = judge_urls(df, RULES).collect()
    assert len(rows) == len(pages)
    trust, distrust = _scores([p if p[0] else (None, p[1], link("b.net")) for p in pages])
    for r in rows:
        page = next(p for p in pages if p[0] == r["page_id"])
        host, path = _parts(page[1])
        rule, said = _rule(host, path) if host else (None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["trust"] == pytest.approx(trust.get(host, 0), abs=1e-4) and r["distrust"] == pytest.approx(distrust.get(host, 0), abs=1e-4)
        bad = distrust.get(host, 0) - trust.get(host, 0) >= 0.5 * 0.15
        assert r["verdict"] == (said or ("block" if bad else "allow"))
    assert next(r for r in rows if r["page_id"] == 4)["verdict"] == "block"  # most of its links go to a blocked host
    assert judge_urls(df.where("false"), RULES).count() == 0


def test_isolated_seeds_change_no_verdict(spark):
    """A chain of hosts that links to a blocked one, beside any number of trusted hosts without links."""
    link = lambda host: f'<a href="https://{host}/x">y</a>'
    chain = [(0, "http://b.net/es/", None), *((n, f"http://h{n}.org/", link(f"h{n - 1}.org" if n > 1 else "b.net")) for n in range(1, 8))]
    df = spark.createDataFrame(chain, "page_id bigint, url string, html string")
    more = spark.range(100, 400_100).selectExpr("id AS page_id", "concat('http://s', id, '.com/') AS url", "CAST(NULL AS STRING) AS html")
    few = {r["page_id"]: r for r in judge_urls(df, RULES).collect()}
    many = {r["page_id"]: r for r in judge_urls(df.unionByName(more), RULES).where("page_id < 100").collect()}
    assert [few[n]["verdict"] for n in range(8)] == ["block"] * 5 + ["allow"] * 3
    for n in range(8):
        assert many[n]["verdict"] == few[n]["verdict"]
        assert many[n]["distrust"] == pytest.approx(0.15 * 0.85 ** n, abs=2e-6) == few[n]["distrust"]


def test_long_chains_are_followed_to_their_end(spark):
    seeds = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trusted double, blocked double")
    links = spark.createDataFrame([(f"h{n}", f"h{n + 1}", 1.0) for n in range(30)], "src string, dst string, weight double")
    got = {r["host"]: r["trust"] for r in spread_trust(seeds, links).collect()}
    assert got["h25"] == pytest.approx(0.15 * 0.85 ** 25, abs=2e-6)
