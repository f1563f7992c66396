import random
import re

import duckdb
import pytest

from tidemark.llm import url_rules
from tidemark.llm.url_rules import RULES, judge_urls, prefix_rule, filter_line

SCHEMA = "page_id long, url string, html string, host string, rule int"
URLS = [
    None, "", "no scheme", "http://example.net", "http://example.net/", "HTTP://A.EXAMPLE.NET/en/x?q#f", "https://notexample.com/de/1", "https://example.com/de/1", "https://sub.example.com/DE/1",
    "https://x.org/fr/", "https://x.org/fr", "https://org/fr/a/b", "ftp://net/?a://b.org/fr/", "x://y://z.net/", "http://a.com/casino/1", "http://a.com/casinos/", "http://a.net:80/en/", "http://example.net?x=/en/",
    "http://CASINO.org#a", "http://www.example.net/en/casino", "http://a.com/" + "p/" * 3000, "://", "http:///path", "http://a.com/fr/ünï/NET",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    before = re.split(r"[?#]", rest)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), before.split("/")[0])
    path = before[len(host) :]
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, p = rule.split("/")[0], "/" + rule.split("/", 1)[1]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    words = {w for w in re.split("[^a-z0-9]+", (host + path).lower())}
    return host, path, *(best or (None, "block" if words & set(url_rules.WORDS) else "allow"))


@pytest.mark.parametrize("inline", [256, 0])
def test_against_brute_force(spark, inline):
    rows = [(i if i % 7 else None, u, "h", "x", 1) for i, u in enumerate(URLS + URLS[:4])]
    got = sorted((tuple(r) for r in judge_urls(spark.createDataFrame(rows, SCHEMA), inline=inline).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert judge_urls(spark.createDataFrame([], SCHEMA), inline=inline).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(["example", "net", "en"],), (["example", "net"],), (["example"],)], "tokens array<string>")
    index = url_rules.index_rules(pages, RULES)
    filed = {RULES[i].label: t for t, places in index.items() for i in places}
    assert filed == {"net/": "net", "example.net/en/": "en", "example.com/de/": "com", "org/fr/": "org"}
    assert prefix_rule("block", "a.org/x/pre").tokens == ("a", "org", "x")


def test_table_and_sql(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted(tuple(r) for r in judge_urls(pages).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(db.execute(url_rules.oracle()).fetchall())
    assert {r[4] for r in got} == {"allow", "block"}


def brute_line(line):
    """A filter line as a Python expression and its rank, worked out character by character."""
    text = line.removeprefix("@@")
    text, _, option = text.partition("$")
    out, i = "", 0
    if text.startswith("/") and text.endswith("/") and len(text) > 1:
        out = text[1:-1]
    else:
        if text.startswith("||"):
            out, i = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*[.])?", 2
        elif text.startswith("|"):
            out, i = "^", 1
        while i < len(text):
            c = text[i]
            out += {"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or ("$" if c == "|" and i == len(text) - 1 else re.escape(c))
            i += 1
    flags = 0 if option == "match-case" else re.I
    return re.compile(out, flags), (0 if option == "important" else 1 if line.startswith("@@") else 2, -len(line), line)


@pytest.mark.parametrize("many", [40, 10_000])
def test_filter_lines_against_brute_force(spark, many):
    r = random.Random(6)
    names = ["ads", "track", "cdn", "img", "news", "shop", "a1", "banner", "x", "pixel", "Stat", "en"]
    hosts = [f"{a}.{b}.{c}" for a in names[:6] for b in names[3:9] for c in ("com", "net", "de")]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}/" + "/".join(r.choice(names) + r.choice(["", "", "2", ".js"]) for _ in range(r.randint(0, 3))) + r.choice(["", "?q=ads&x", "#top"]) for _ in range(300)]
    urls += [None, "", "no scheme/ads/", "http://", urls[0], urls[0]]
    lines = ["||ads.news.com^", "@@||ads.news.com^$important", "/banner[0-9]\\.js/", "|https://cdn.*|", "*ads*", "^pixel^", "track.js|", "@@/stat/", "/Stat/$match-case", "x"]
    while len(lines) < many:
        host = r.choice(hosts) if r.random() < 0.7 else f"h{r.randint(0, 9999)}.com"
        lines.append(r.choice(["", "", "@@"]) + r.choice([f"||{host}^", f"||{host}/{r.choice(names)}", f"/{r.choice(names)}/{r.choice(names)}{r.randint(0, 99)}^", f"{r.choice(names)}*{r.choice(names)}{r.randint(0, 99)}|", f"|http://{host}/*{r.choice(names)}^"]) + r.choice(["", "", "", "$match-case", "$important"]))
    lines = list(dict.fromkeys(lines))
    rules = tuple(filter_line(x) for x in lines)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in judge_urls(pages, rules, ()).collect()}
    known = sorted(((rank, p, x) for x in lines for p, rank in [brute_line(x)]), key=lambda k: k[0])
    for i, url in enumerate(urls):
        first = next((x for _, p, x in known if p.search(url)), None) if url and "://" in url else None
        want = (first, "allow" if first is None or first.startswith("@@") else "block")
        assert got[i] == want, url


def test_lines_that_are_no_rules():
    assert [filter_line(x) for x in ("", "! note", "[Adblock Plus]", "a.com##.ad", "a.com#@#.ad", "||a.com^$script,third-party", "$important")] == [None] * 7
    assert filter_line("||ads.example.com^").tokens == ("ads", "example", "com")
    assert filter_line("*ads*").tokens == () and filter_line("/banner/img*").tokens == ("banner",) and filter_line("|http://x").tokens == ("http",)
