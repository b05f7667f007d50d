import re

from recordmill.llm import linkgraph as L

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path, rules):
    fits = [
        (len(h) + len(p), v, h, p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits, default=None)


def brute(pages, rules, rounds=L.ROUNDS, damping=L.DAMPING):
    judged = [(p, *split(u), rule_of(*split(u), rules)) for p, u, _ in pages]
    links, hosts = {}, {}
    for (_, host, _, _), (_, _, html) in zip(judged, pages, strict=True):
        if host:
            hosts[host] = hosts.get(host, 0) + 1
            for link in re.findall(L.HREF, html or ""):
                target = split(":" + link if link.startswith("//") else link)[0]
                if target and target != host:
                    links[host, target] = links.get((host, target), 0) + 1
    nodes = set(hosts) | {t for _, t in links}

    def rank(seed, edges):
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        now = dict(seed)
        for _ in range(rounds):
            moved = dict.fromkeys(nodes, 0.0)
            for (a, b), n in edges.items():
                moved[b] += now[a] * n / out[a]
            new = {h: seed[h] + damping * moved[h] for h in nodes}
            change, now = sum(abs(new[h] - now[h]) for h in nodes), new
            if change <= L.TOLERANCE * sum(seed.values()):
                break
        return now

    count = lambda v: {h: sum(1.0 for _, x, _, r in judged if x == h and r and r[1] == v) for h in nodes}
    trust, distrust = rank(count("allow"), links), rank(count("block"), {(b, a): n for (a, b), n in links.items()})
    result = []
    for page, host, path, r in judged:
        bad = bool(host) and (distrust[host] - trust[host]) / hosts[host] > L.THRESHOLD
        result.append((page, host, path, r and r[2] + r[3], r[1] if r else "block" if bad else "allow"))
    return result


def test_equals_brute_force(spark):
    link = lambda *hosts: " ".join(f'<a HREF="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://Good.Com/a", link("friend.org")),
        (2, "http://friend.org/", link("good.com", "friend.org")),
        (3, "https://bad.net/es/1", None),
        (4, "https://bad.net/es/2", "<a href='//good.com'>"),
        (5, "https://bad.net/de/3", ""),
        (6, "http://farm.org/1", link("bad.net", "bad.net")),
        (7, "http://farm.org/2", link("bad.net")),
        (8, "http://www.example.com/en/1?x=/es/", None),
        (9, "http://blog.example.com/en/#top", None),
        (10, "http://example.com", "x" * 100_000),
        (11, None, link("bad.net")),
        (12, "no scheme", link("bad.net")),
        (13, "x://", None),
        (14, "http://notexample.com/en/", None),
        (6, "http://farm.org/1", link("bad.net", "bad.net")),
        (None, "http://half.net/es/", link("farm.org", "elsewhere.org")),
    ] + [(100 + k, "http://hub.org/p", link("elsewhere.org") if k % 2 else link("good.com", "hub.org")) for k in range(200)]
    frame = spark.createDataFrame([(*p, "r", 1) for p in pages], "page_id bigint, url string, html string, host string, rule int")
    got = L.judge(frame, RULES).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute(pages, RULES), key=key)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert verdicts[5] == verdicts[6] == "block" and verdicts[2] == verdicts[11] == verdicts[13] == "allow"
    assert L.judge(frame.limit(0), RULES).count() == 0


def test_a_large_corpus_stops_no_sooner(spark):
    # Two hops before a blocked page, beside blocked pages that have no links.
    hops = [(1, "http://far.org/", "<a href='http://near.org/'>"), (2, "http://near.org/", "<a href='http://spam.net/es/'>")]
    hops.append((3, "http://spam.net/es/", None))
    for mass in (0, 3000):
        pages = hops + [(100 + k, "http://mass.net/es/", None) for k in range(mass)]
        got = L.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), RULES)
        far = got.where("page_id = 1").first()
        assert far["verdict"] == "block" and abs(far["distrust"] - L.DAMPING**2) < 1e-9
