import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from talewind.llm import templates


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"), default=None)


def wild(s):
    end = re.search(r"\.[A-Za-z0-9]{1,5}\Z", s)
    return s and "*" + (end.group().lower() if end else "")


def brute(pages, rules=templates.RULES, labels=None, levels=templates.LEVELS):
    """page_id -> (host, path, rule, verdict, template), with dictionaries."""
    rows = []
    for page, url in pages:
        host, path = parsed(url)
        rule = rule_of(host, path, rules)
        bad = (None if rule is None else int(rule[0] == "block")) if labels is None else labels.get(page)
        rows.append((page, host, path, rule, bad))
    token_of = {}
    segments = {p: (p[1:].split("/", levels - 1) if p else []) for _, _, p, _, _ in rows}
    made = {(h, p): () for _, h, p, _, _ in rows}
    for k in range(levels):
        count, whole = defaultdict(int), defaultdict(int)
        for _, h, p, _, _ in rows:
            if len(segments[p]) > k:
                count[h, made[h, p], segments[p][k]] += 1
                whole[h, made[h, p]] += 1
        for (h, p), t in list(made.items()):
            if len(segments[p]) > k:
                s = segments[p][k]
                n = count[h, t, s]
                token_of[h, p, k] = s if n >= templates.PAGES and n * templates.ONE_IN >= whole[h, t] else wild(s)
        for (h, p), t in list(made.items()):
            if len(segments[p]) > k:
                made[h, p] = (*t, token_of[h, p, k])
    stats = defaultdict(lambda: [0, 0, 0])
    for _, h, p, _, bad in rows:
        s = stats[h, made[h, p]]
        s[0] += 1
        s[1] += bad == 0
        s[2] += bad == 1
    now = {key: key[1] for key in stats}
    for k in range(levels - 1, -1, -1):
        leaves = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (h, t), s in stats.items():
            m = now[h, t]
            if len(m) > k:
                cell = leaves[h, m[:k], m[k]][m[k + 1 :]]
                for i in range(3):
                    cell[i] += s[i]
        families = defaultdict(list)
        for (h, above, token), below in leaves.items():
            families[h, above, frozenset(below)].append(token)
        for (h, above, shape), tokens in families.items():
            if len(tokens) < 2:
                continue
            all_ = {b: sum(leaves[h, above, t][b][0] for t in tokens) for b in shape}
            good, bad = (sum(leaves[h, above, t][b][i] for t in tokens for b in shape) for i in (1, 2))
            share, whole = bad / (good + bad) if good + bad else 0.0, sum(all_.values())
            alike = []
            for t in tokens:
                n, g, x = (sum(leaves[h, above, t][b][i] for b in shape) for i in range(3))
                chi = sum((leaves[h, above, t][b][0] - n * all_[b] / whole) ** 2 / (n * all_[b] / whole) for b in shape)
                free = len(shape) - 1
                if chi <= free + 3 * math.sqrt(2 * free) + 1e-9 and abs(x - (g + x) * share) <= 3 * math.sqrt((g + x) * share * (1 - share)):
                    alike.append(t)
            if len(alike) > 1:
                name = "(" + "|".join(sorted(alike)) + ")"
                for (h2, t), m in now.items():
                    if h2 == h and len(m) > k and m[:k] == above and m[k] in alike:
                        now[h2, t] = (*above, name, *m[k + 1 :])
    sums, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, t), s in stats.items():
        for to in (sums[h, now[h, t]], hosts[h]):
            to[0] += s[1]
            to[1] += s[2]
    good, bad = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    base = (bad + 1) / (good + bad + 2)
    out = []
    for page, h, p, rule, _ in rows:
        m = now[h, made[h, p]]
        own = (hosts[h][1] + 4 * base) / (sum(hosts[h]) + 4)
        score = (sums[h, m][1] + 4 * own) / (sum(sums[h, m]) + 4)
        out.append((page, h, p, rule and rule[1] + rule[2], rule[0] if rule else "block" if score > 0.5 else "allow", "/" + "/".join(m)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template) for r in frame.collect()), key=str)


def messy():
    rng, urls = random.Random(5), []
    for i in range(1500):
        host = rng.choice(["a.net", "a.net", "a.net", "B.Com", "c.example.org", "net", f"h{i}.com"])
        kind = rng.choice(["blog", "blog", "news", "shop", "x"])
        tail = rng.choice([f"{i}", f"{i}.html", f"{i}/", f"{i % 3}/{i}/deep/er/{i % 2}", "about", ""])
        urls.append((i, f"http://{host}/{kind}/{tail}" + rng.choice(["", "?q=/x", "#/y"])))
    return urls


def test_against_brute_force(spark, sf):
    rows = messy()
    rules = [("block", "a.net", "/blog/"), ("allow", "net", "/"), ("block", "com", "/shop/1"), ("allow", "com", "/shop/"), ("block", "example.org", "/x")]
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    want = brute(rows, rules)
    assert got(templates.judged(frame, rules)) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"} and any("|" in r[5] for r in want)
    labels = [(i, int("shop" in u)) for i, u in rows if i % 3 == 0] + [(1, None), (9999, 1)]
    found = got(templates.judged(frame, [], spark.createDataFrame(labels, "page_id long, bad int")))
    assert found == brute(rows, [], {i: b for i, b in labels if b is not None})
    shop = [r for r in found if "/shop/" in r[2] and r[1] == "a.net" and "shop" in r[5]]
    assert sum(r[4] == "block" for r in shop) > 0.8 * len(shop) > 0
    assert {r[4] for r in found if "/blog/" in r[2] and r[1] == "a.net"} == {"allow"}
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert got(templates.judged(pages)) == brute([(r.page_id, r.url) for r in pages.select("page_id", "url").collect()])


def test_odd_rows(spark):
    urls = [
        None, "", "no scheme", "://", "x://", "x:///p", "http://A.org", "http://org/", "http://org?x/", "http://x.org#/fr/", "HTTP://E.COM/de/x", "http://com/fr/",
        "http://a.com:80/fr/", "http://evilcom/fr/", "a://b://c/d", "http://É.org/é/Ä", "http://example.org/en/1", "http://sub.example.org/es/", "http://q.net/" + "s/" * 5000,
        "http://q.net/" + "y" * 1_000_000, "http://q.net//", "http://q.net/a\nb/c",
    ]
    rows = [(i if i != 3 else None, u, "h", "x", 1) for i, u in enumerate(urls)] + [(1, "http://org/", "h", "x", 1)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, n int")
    found = templates.judged(frame)
    assert got(found) == brute([(r[0], r[1]) for r in rows]) and found.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert templates.judged(frame.limit(0)).count() == 0


def test_longest_rule_wins(spark):
    rules = [("allow", "org", "/"), ("block", "a.org", "/"), ("allow", "org", "/x"), ("block", "org", "/x"), ("block", "org", "/xyz/")]
    rows = [("b.org", "/"), ("a.org", "/q"), ("b.org", "/x"), ("a.org", "/xyz/"), ("org", ""), ("z.a.org", "/x")]
    frame = spark.createDataFrame(rows, "h string, p string")
    out = frame.select(templates.fitting_rule(F.col("h"), F.col("p"), rules).alias("r")).collect()
    assert [r.r and (r.r.rule, r.r.verdict) for r in out] == [("org/", "allow"), ("a.org/", "block"), ("org/x", "block"), ("org/xyz/", "block"), None, ("a.org/", "block")]
