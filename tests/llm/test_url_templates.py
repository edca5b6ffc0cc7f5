import re
from collections import Counter, defaultdict

from modelgate.llm.url_templates import CRITICAL, DEPTH, PURITY, RULES, SMOOTHING, Rule, judge_urls


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def general(s):
    if re.fullmatch("[0-9]+", s):
        return "{n}"
    m = re.fullmatch(r"[0-9]+(\.[A-Za-z]+)", s)
    if m:
        return "{n}" + m[1]
    if re.fullmatch("[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s):
        return "{x}"
    if len(s) >= 12 and re.search("[0-9]", s) and re.search("[A-Za-z]", s):
        return "{m}"
    return s


def kind(s):
    return 0 if s == "" else 1 if s.startswith("{n}") else 2 if s.startswith("{") else 3


def brute(urls):
    """Verdict and template of every url, level by level in plain Python."""
    items = []
    for url in urls:
        host, path = split_url(url)
        seg = [x for x in path.split("/") if x]
        parts = [general(x) for x in seg[:DEPTH]] + [""] * (DEPTH - len(seg)) + ["{+}" if len(seg) > DEPTH else ""]
        items.append([host, path, rule_of(host, path), parts, ""])
    for level in range(DEPTH):
        groups = defaultdict(lambda: defaultdict(list))
        for item in items:
            groups[item[0], item[4]][item[3][level]].append(item)
        for branches in groups.values():
            def stats(rows):
                kinds = Counter(kind(r[3][level + 1]) for r in rows)
                marks = [r[2].verdict for r in rows if r[2]]
                return len(rows), kinds, len(marks), marks.count("block")

            n, kinds, labels, blocked = stats([r for rows in branches.values() for r in rows])
            for seg, rows in branches.items():
                m, own, some, bad = stats(rows)
                chi = sum((own[k] - m * kinds[k] / n) ** 2 / (m * kinds[k] / n) for k in kinds)
                if labels:
                    p = blocked / labels
                    if some * p * (1 - p) > 0:
                        chi += (bad - some * p) ** 2 / (some * p * (1 - p))
                step = "" if seg == "" else "/{*}" if kind(seg) == 3 and chi <= CRITICAL else "/" + seg
                for r in rows:
                    r[4] += step
    tally = defaultdict(lambda: [0, 0])
    for host, _, rule, parts, template in items:
        if rule:
            tally[host, template + parts[-1]][0] += 1
            tally[host, template + parts[-1]][1] += rule.verdict == "block"
    out = []
    for host, path, rule, parts, template in items:
        n, bad = tally[host, template + parts[-1]]
        reject = (bad + SMOOTHING / 2) / (n + SMOOTHING) >= PURITY
        out.append((host, path, rule.text if rule else None, rule.verdict if rule else "block" if reject else "allow"))
    return out


def urls():
    out = [None, "", "no scheme", "http://", "http://COM/", "HTTPS://A.Net/es/x?y#z", "http://a.net", "http://a.net?x=/es/", "http://xcom/",
           "http://www.EXAMPLE.com/en/a", "http://example.com/en/", "http://b.example.com/en/1", "http://example.com/EN/1", "http://é.Ü.com/é"]
    for h in range(4):
        for i in range(60):
            section = ["es", "fr", "en", "news", f"slug-{i}"][i % 5]
            tail = [f"{i}", f"{i}.html", "a/b/c/d", f"deadbeef{i:04d}", "", f"story-of-number-{i}"][(i * 7 + h) % 6 if h else 0]
            out.append(f"https://h{h}.site.{'net' if h < 3 else 'org'}/{section}/{tail}")
    return out + out[-5:]


def test_verdicts_equal_brute_force(spark):
    rows = list(enumerate(urls())) + [(None, "http://h0.site.net/en/5")]
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in rows], "page_id long, url string, host string, template string")
    out = judge_urls(df)
    assert out.columns[:4] == df.columns
    got = Counter((r[0], r["host_"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    want = Counter((i, *v) for (i, _), v in zip(rows, brute([u for _, u in rows]), strict=True))
    assert got == want
    assert any(k[3] is None and k[4] == "block" for k in got) and any(k[3] is None and k[4] == "allow" for k in got)


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    out = judge_urls(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_branches_below_the_third_segment(spark):
    host = "http://b.example.com"
    block, allow = Rule("block", "b.example.com", "/news/2024/05/ads/one/two/bad/"), Rule("allow", "b.example.com", "/news/2024/05/story/one/two/ok/")
    rows = [(1000 + i, f"{host}/news/2024/05/ads/one/two/bad/{i}") for i in range(40)]
    rows += [(2000 + i, f"{host}/news/2024/05/story/one/two/ok/{i}") for i in range(40)]
    rows += [(3000, f"{host}/news/2024/05/ads/one/two/bad"), (3001, f"{host}/news/2024/05/story/one/two/ok")]
    rows += [(4000 + i, f"{host}/news/2024/05//ads/one/two/bad/{i}") for i in range(5)]  # fits no rule, same segments
    rows += [(5000 + i, f"{host}/news/2024/05//story/one/two/ok/{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in judge_urls(df, rules=(block, allow)).collect()}
    assert len(got) == len(rows)
    assert {got[4000 + i]["verdict"] for i in range(5)} == {"block"} and {got[5000 + i]["verdict"] for i in range(5)} == {"allow"}
    assert "/ads/" in got[4000]["template"] and "/story/" in got[5000]["template"]
    assert got[3000]["verdict"] == "allow" and got[3000]["template"] != got[4000]["template"]
    assert not any("{+}" in (r["template"] or "") for r in got.values())
