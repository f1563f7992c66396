"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule has a regular expression and the literal tokens that any URL it fits must contain whole. One pass counts in
how many URLs each of those tokens stands, and the rule is filed under its rarest. A URL's tokens fetch the rules
filed under them, and only those run their expressions. Rules without any such token run on every URL.

Rules are prefixes of host and path, words, or lines of a filter list (:func:`filter_line`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path, or the whole URL; ``tokens`` are lower-case letters and digits; a smaller ``rank`` wins."""

    verdict: str
    label: str | None
    pattern: str
    tokens: tuple[str, ...]
    rank: tuple
    whole_url: bool = False


def prefix_rule(verdict: str, rule: str) -> Rule:
    """A rule for a host and its subdomains and the start of a path, as in ``example.net/en/``; the longest wins."""
    host, slash, path = rule.partition("/")
    host, path = host.lower(), slash + path
    whole = re.findall(r"[a-z0-9]+", host)
    cut = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)  # a last part that may go on is no whole token
    tokens = tuple(dict.fromkeys([*whole, *re.findall(r"[a-z0-9]+", cut.translate(str.maketrans(UPPER, LOWER)))]))
    quoted = _quoted(host), _quoted(path)
    return Rule(verdict, rule, rf"^(?:[^/]*\.)?{quoted[0]}{quoted[1]}", tokens, (0, -len(rule), rule, verdict))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule without a label for a word that stands anywhere in host or path, bounded by other characters."""
    return Rule(verdict, None, rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])", (word,), (2, word))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", text)


def filter_line(line: str) -> Rule | None:
    """A rule of a filter list's line; null for comments, page element rules, and rules that depend on more than the URL.

    ``@@`` allows, all else blocks; ``||`` begins at a host or subdomain, ``|`` is an end of the URL, ``*`` stands for any
    characters, ``^`` for one that is no letter, digit or ``_-.%``, or the end; ``/.../`` is a regular expression. Upper and
    lower case are alike unless ``$match-case`` is given. ``$important`` wins over allowing lines, these over blocking
    ones, then the longer line. Any other option speaks of the page around, and the line is left out.
    """
    line = line.strip()
    if not line or line.startswith(("!", "[")) or re.search(r"#[@?$]*#", line):
        return None
    text, options = line.removeprefix("@@"), set()
    if given := re.search(r"\$([a-z~][a-z0-9~,=|.*_-]*)$", text):
        text, options = text[: given.start()], set(given[1].split(","))
    if options - {"match-case", "important"} or not text:
        return None
    verdict = "allow" if line.startswith("@@") else "block"
    rank = (1, 0 if "important" in options else 1 if verdict == "allow" else 2, -len(line), line)
    if len(text) > 1 and text[0] == text[-1] == "/":
        pattern, tokens = text[1:-1], ()  # what an expression must contain is not worked out
    else:
        body = re.sub(r"\*+", "*", text)
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(start) :]
        end = body.endswith("|")
        body = body[:-1] if end else body
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
        pattern = {"||": r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?", "|": "^", "": ""}[start] + "".join(parts.get(c) or _quoted(c) for c in body) + ("$" if end else "")
        # a run of letters and digits is a whole token unless it may go on: next to a wildcard or an open end
        ahead = "." if start else "*"
        tokens = tuple(dict.fromkeys(m[0] for m in re.finditer(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", ahead + body.translate(str.maketrans(UPPER, LOWER)) + ("." if end else "*"))))
    return Rule(verdict, line, pattern if "match-case" in options else f"(?i){pattern}", tokens, rank, True)


RULES = tuple(prefix_rule(*x) for x in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))
#: What decides where none of the rules fits: these words block, all else is allowed.
WORDS = ("casino", "porn", "xxx", "viagra", "adserver", "doubleclick", "torrent", "warez")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))
    before = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(before, r"^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(before, F.length(host) + F.lit(1), F.length(before))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


def index_rules(targets: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """The rules' places in ``rules`` by their rarest token in ``targets`` (column ``tokens``); ties to the longer token.

    Rules without tokens are not in it.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if len(wanted) <= INLINE:
        seen = targets.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        listed = targets.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        seen = targets.select(F.explode("tokens").alias("token")).join(listed, "token", "left_semi")
    often = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}  # as many rows as the rules have tokens at most
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (often.get(t, 0), -len(t), t)), []).append(i)
    return index


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, words: tuple[str, ...] = WORDS, inline: int = INLINE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    The longest fitting prefix rule decides, then the lines of a filter list by their rank; where none fits, ``rule`` is
    null, and the verdict is block for a URL with one of ``words`` and allow for all others. A null URL and one without
    ``://`` have empty host and path, and no line of a list fits the latter. Repeated rows each give a row, no rows none;
    other columns of ``pages`` are not read. Up to ``inline`` rules are fetched inside each row, without a shuffle; more
    go through a join on the token over distinct URLs, so the number of rules is not bounded by a task's memory.
    """
    ordered = tuple(sorted([*rules, *(word_rule("block", w) for w in words)], key=lambda r: r.rank))
    host, path = url_parts(F.col("url").cast("string"))
    listed = any(r.whole_url for r in ordered)
    url = F.when(F.contains(F.col("url").cast("string"), F.lit("://")), F.col("url").cast("string"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), (F.coalesce(url, F.lit("")) if listed else F.lit("")).alias("url"))
    target = F.concat("host", "path")
    tokens = url_tokens(F.concat_ws(" ", target, "url") if listed else target)
    index = index_rules(base.select(tokens.alias("tokens")), ordered)
    fits = lambda rule, text, whole: F.regexp_like(whole if rule.whole_url else text, F.lit(rule.pattern))
    always = [i for i, r in enumerate(ordered) if not r.tokens]
    run = [F.when(fits(ordered[i], F.col("target"), F.col("url")), i) for i in always]
    everywhere = F.array_min(F.array(*run)) if run else F.lit(None).cast("int")
    if len(ordered) <= inline:
        filed = F.create_map(*(x for t, places in index.items() for x in (F.lit(t), F.array(*map(F.lit, places))))) if index else F.lit(None).cast("map<string,array<int>>")
        patterns, whole = F.array(*(F.lit(r.pattern) for r in ordered)), F.array(*(F.lit(r.whole_url) for r in ordered))
        fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(filed, t)), lambda x: x.isNotNull()))
        hit = lambda i: F.regexp_like(F.when(F.get(whole, i), F.col("url")).otherwise(target) if listed else target, F.get(patterns, i))
        found = base.withColumn("target", target).withColumn("place", F.least(F.array_min(F.filter(F.array_distinct(fetched), hit)), everywhere) if run else F.array_min(F.filter(F.array_distinct(fetched), hit)))
        labels, verdicts = F.array(*(F.lit(r.label).cast("string") for r in ordered)), F.array(*(F.lit(r.verdict) for r in ordered))
        return found.select("page_id", "host", "path", F.get(labels, F.col("place")).alias("rule"), F.coalesce(F.get(verdicts, F.col("place")), F.lit("allow")).alias("verdict"))
    spark = pages.sparkSession
    filed = spark.createDataFrame([(t, i, ordered[i].pattern, ordered[i].whole_url) for t, places in index.items() for i in places], "token string, place int, pattern string, whole boolean")
    # a token that very many URLs share has its URLs dealt to several tasks, each with the rules filed under it
    salts = 16
    distinct = base.select(target.alias("target"), "url").distinct()
    each = distinct.withColumn("token", F.explode(url_tokens(F.concat_ws(" ", "target", "url")))).withColumn("salt", F.pmod(F.xxhash64("target", "url"), F.lit(salts)))
    copies = filed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    fitting = each.join(copies, ["token", "salt"]).where(F.regexp_like(F.when(F.col("whole"), F.col("url")).otherwise(F.col("target")), F.col("pattern")))
    best = fitting.groupBy("target", "url").agg(F.min("place").alias("fetched"))
    judged = distinct.join(best, ["target", "url"], "left").withColumn("place", F.least("fetched", everywhere) if run else F.col("fetched"))
    named = spark.createDataFrame([(i, r.label, r.verdict) for i, r in enumerate(ordered)], "place int, rule string, verdict string")
    judged = judged.select("target", "url", "place").join(named, "place", "left").drop("place")
    out = base.withColumn("target", target).join(judged, ["target", "url"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """The same in DuckDB's SQL, rule by rule."""
    ordered = sorted(RULES, key=lambda r: r.rank)
    fit = [f"regexp_matches(host || path, '{r.pattern}')" for r in ordered]
    word = " OR ".join(f"regexp_matches(host || path, '{word_rule('block', w).pattern}')" for w in WORDS)
    rule = " ".join(f"WHEN {f} THEN '{r.label}'" for f, r in zip(fit, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fit, ordered, strict=True))
    return f"""
        WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {word} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""
