"""Personal data: spans found by patterns, and further ones chosen by boosted trees.

The base finder takes what its patterns match and its checks pass. High-recall generators propose more spans, which may
overlap: local and run-together numbers, disguised addresses, and what a greedy pattern swallowed along with its
neighbour. A candidate is described by its format (digits, separators, which generator) and context (words before it,
neighbouring characters). Whether it is real is told by evidence that the description leaves out: the check digit, the
ranges of its numbers, a well-formed ending. Gradient-boosted trees learn on each half of the texts which descriptions hold
real data, and a threshold for each kind, set on texts of the other half where the share of real data is high enough, selects
what is added: also candidates whose own evidence is missing, as a card with a misread digit.

Descriptions are small whole numbers, so a candidate is one of at most CELLS cells, and the trees are fitted on the
counts of each cell over the whole corpus: their size has a bound, whatever the corpus. All of it is DataFrame code, and
its work grows in proportion to the spans of a text.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a long run is scanned once: possessive, and not begun inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20@\x20)", r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\.|\x20\.\x20)"
#: The generators: what they propose is only a candidate.
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20?\[dot\]\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){3}|3[0-9]{3}[\x20./_-]{1,3}[0-9]{6}[\x20./_-]{1,3}[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without a match of this has no span of the kind.
NEEDS = {"email": r"@|(?i)[\[({]\x20?at\x20?[\])}]", "ip": r"[0-9][.\[( ]", "card": r"[0-9][\x20./_-]{0,3}[0-9][\x20./_-]{0,3}[0-9]", "phone": r"\+[0-9]|[0-9][\x20.-][0-9]{4}"}
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CLUES = {"email": r"mail|contact|write|reach", "ip": r"\bip\b|addr|host|server", "card": r"card|visa|master|amex|credit|pay", "phone": r"phone|tel|call|mobile|fax|cell"}
FEATURES = ("kind", "loose", "digits", "separator", "clue", "before", "after")
WIDTHS = (4, 2, 9, 6, 2, 4, 4)
CELLS = 4 * 2 * 9 * 6 * 2 * 4 * 4
PRECISION = 0.99
LEAST = {"card": 13, "phone": 8}
#: Elements of an array that are folded in one go: what is emitted is copied at each of them.
CHUNK = 1_024
SPAN = "array<struct<start:int,stop:int,hit:string,before:string,after:string>>"
CANDIDATE = "array<struct<start:int,kind:int,stop:int,cell:int,real:int,loose:int,took:boolean>>"
BASE_SPAN = "array<struct<start:int,kind:int,stop:int,cell:int>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walk(items: Column, zero: Column, step, kind: str) -> Column:
    """What ``step(state, item)``, a pair of the next state and a value of ``kind``, gives at each item in order.

    Folded in chunks whose results are put together at the end: time in proportion to the items, not to their square.
    """
    none, parts = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        after, value = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")))

    def whole(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, CHUNK))
        return F.aggregate(cut, F.struct(zero.alias("state"), parts.alias("parts")), chunk, lambda acc: F.flatten(acc["parts"]))

    return _once(items, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds; false for other than 12 to 19 digits."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i))
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def _ranges(kind: str, hit: Column, digits: Column) -> Column:
    """The check of a kind on what its pattern matched; the card's has the checksum beside it."""
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(F.regexp_replace(hit, "[^0-9]+", "."), F.lit(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": (n >= 14) & (n <= 19),
        "phone": (n >= 10) & (n <= 15),
    }[kind]


def _passes(kind: str, hit: Column, digits: Column) -> Column:
    return _ranges(kind, hit, digits) & _luhn(digits) if kind == "card" else _ranges(kind, hit, digits)


def _verified(kind: str, hit: Column, digits: Column) -> Column:
    """Evidence that a candidate is real data; no feature shows it."""
    local = (F.length(digits) == 10) & ~F.startswith(hit, F.lit("+"))
    return {
        "email": F.regexp_like(hit, F.lit(r"[^A-Za-z0-9-][A-Za-z]{2,24}$")),
        "ip": _ranges("ip", hit, digits) & ~F.startswith(digits, F.lit("0")),
        "card": _passes("card", hit, digits),
        "phone": _ranges("phone", hit, digits) & F.when(local, F.regexp_like(digits, F.lit("^[2-9]..[2-9]"))).otherwise(~F.startswith(digits, F.lit("0"))),
    }[kind]


def _located(pieces: Column, hits: Column) -> Column:
    """Code-point places of matches, from the matches and the pieces of text between them."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return at + x["gap"] + x["width"], at + x["gap"]

    def span(m: Column, starts: Column) -> Column:
        return F.transform(m["hits"], lambda hit, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(hit)).alias("stop"), hit.alias("hit"),
            F.right(F.get(m["pieces"], i), F.lit(24)).alias("before"), F.left(F.get(m["pieces"], i + 1), F.lit(1)).alias("after"),
        ))

    def walk(m: Column) -> Column:
        widths = F.transform(m["hits"], lambda hit, i: F.struct(F.length(F.get(m["pieces"], i)).alias("gap"), F.length(hit).alias("width")))
        return _once(_walk(widths, F.lit(0), step, "int"), lambda starts: span(m, starts))

    found = _once(F.struct(pieces.alias("pieces"), hits.alias("hits")), walk)
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPAN))


def _all_matches(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``base_<kind>`` and ``loose_<kind>``: every match with its places and surroundings."""
    empty = F.array().cast("array<string>")
    columns, spans = {}, {}
    for name, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, pattern in patterns.items():
            may = F.regexp_like(text, F.lit(NEEDS[kind]))
            columns[f"h_{name}_{kind}"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
            columns[f"p_{name}_{kind}"] = F.when(may, F.split(text, pattern, -1)).otherwise(empty)
            spans[f"{name}_{kind}"] = _located(F.col(f"p_{name}_{kind}"), F.col(f"h_{name}_{kind}"))
    return docs.withColumns(columns).withColumns(spans).drop(*columns)


def _cell(kind: str, loose: int, c: Column, digits: Column) -> Column:
    """The number of the cell that a candidate's format and context put it in."""

    def size(n: Column) -> Column:
        return F.when(n == 0, 0).when(n < 7, 1).when(n < 10, 2).when(n == 10, 3).when(n < 13, 4).when(n == 13, 5).when(n < 17, 6).when(n < 20, 7).otherwise(8)

    def separator(gaps: Column) -> Column:
        only = lambda x: F.regexp_like(gaps, F.lit(x))
        return F.when(gaps == "", 0).when(only(r"^\x20+$"), 1).when(only("^-+$"), 2).when(only(r"^\.+$"), 3).when(only(r"[\[({]"), 4).otherwise(5)

    def beside(x: Column) -> Column:
        is_one = lambda p: F.regexp_like(x, F.lit(p))
        return F.when(is_one("^[A-Za-z]$"), 1).when(is_one("^[0-9]$"), 2).when(is_one(r"^\S$"), 3).otherwise(0)

    clue = F.regexp_like(F.lower(c["before"]), F.lit(CLUES[kind])).cast("int")
    described = (
        _once(F.length(digits), size), _once(F.regexp_replace(c["hit"], "[A-Za-z0-9]", ""), separator), clue, _once(F.right(c["before"], F.lit(1)), beside), beside(c["after"]),
    )
    out = F.lit(KINDS.index(kind) * 2 + loose)
    for width, value in zip(WIDTHS[2:], described, strict=True):
        out = out * width + F.coalesce(value, F.lit(0))
    return out


def _features(cell: Column) -> list[Column]:
    out, below = [], 1
    for name, width in zip(reversed(FEATURES), reversed(WIDTHS), strict=True):
        out.append((F.floor(cell / below) % width).cast("double").alias(name))
        below *= width
    return out[::-1]


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``every``, all candidates in order of start, ``base`` (spans that the base finder takes), ``proposed`` (what
    generators add that no base span overlaps) and ``half``, in which trees learn or are held against what they learned.

    Candidates are structs of start, kind's number, stop, cell, real, loose and took; base spans of the first four.
    """
    found = _all_matches(docs, text)

    def coded(kind: str, loose: int, spans: Column) -> Column:
        def candidate(c: Column, digits: Column) -> Column:
            took = F.lit(False) if loose else _passes(kind, c["hit"], digits)
            return F.struct(
                c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["stop"].alias("stop"), _cell(kind, loose, c, digits).alias("cell"),
                F.coalesce(_verified(kind, c["hit"], digits), F.lit(False)).cast("int").alias("real"), F.lit(loose).alias("loose"), took.alias("took"),
            )

        # a base match too short to be near its kind is no candidate: most are single small numbers
        near = F.filter(spans, lambda c: F.length(c["hit"]) >= LEAST[kind]) if kind in LEAST else spans
        return F.transform(near, lambda c: _once(_digits(c["hit"]), lambda digits: candidate(c, digits)))

    def base(every: Column) -> Column:
        return F.transform(F.filter(every, lambda c: c["took"]), lambda c: F.struct(*(c[n].alias(n) for n in ("start", "kind", "stop", "cell"))))

    def apart(every: Column) -> Column:
        """Loose candidates that end before the next base span and begin after the last."""
        far = F.lit((1 << 31) - 1)
        last = _walk(every, F.lit(0), lambda s, c: (F.when(c["took"], F.greatest(s, c["stop"])).otherwise(s), s), "int")
        after = F.reverse(_walk(F.reverse(every), far, lambda s, c: (F.when(c["took"], c["start"]).otherwise(s), s), "int"))
        clear = lambda b: F.filter(every, lambda c, i: (c["loose"] == 1) & (F.get(b["last"], i) <= c["start"]) & (F.get(b["after"], i) >= c["stop"]))
        return _once(F.struct(last.alias("last"), after.alias("after")), clear)

    both = F.concat(*(coded(k, n, F.col(f"{name}_{k}")) for n, name in enumerate(("base", "loose")) for k in KINDS))
    sorted_all = F.when(F.size(both) > 1, F.array_sort(both)).otherwise(both)
    parts = _once(sorted_all, lambda e: F.struct(e.alias("every"), base(e).alias("base"), F.when(F.exists(e, lambda c: c["loose"] == 1), apart(e)).otherwise(F.array().cast(CANDIDATE)).alias("proposed")))
    kept = [f"{n}_{k}" for n in ("base", "loose") for k in KINDS]
    found = found.withColumn("parts", parts).drop(*kept)
    return found.withColumns({n: F.col(f"parts.{n}") for n in ("every", "base", "proposed")}).drop("parts").withColumn("half", F.pmod(F.xxhash64(text), F.lit(2)))


def accepted_cells(found: DataFrame, precision: float = PRECISION) -> list[int]:
    """Fit the trees on the counts of real and other candidates of each cell, and return the cells whose proposals are taken.

    Trees of each half of the corpus score the other half. For each kind, the threshold is the lowest of these scores
    from which on the share of real candidates, summed over cells of no smaller score, is at least ``precision``; so it
    is set on texts that the trees have not seen. A cell's own score is the mean of both halves' trees. A half without both
    real and other candidates learns nothing and scores nothing; if neither does, nothing is added.
    """
    # outer: a plain explode has the candidates worked out once more, to filter out rows without any
    each = found.select("half", F.explode_outer("every").alias("c")).where("c.cell IS NOT NULL").groupBy("half", "c.cell", "c.real").agg(F.count("*").cast("double").alias("n"))
    cells = materialise(each.coalesce(1).orderBy("half", "cell", "real"))  # four rows for each of CELLS cells at most
    described = lambda rows: VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select("*", *_features(F.col("cell"))))
    trees = GBTClassifier(featuresCol="features", labelCol="real", weightCol="n", maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=16)
    both = {r["half"] for r in cells.groupBy("half").agg(F.count_distinct("real").alias("k")).where("k = 2").collect()}
    seen = {}
    for half in sorted(both):
        model = trees.fit(described(cells.where(F.col("half") == half)))
        rest = F.when(F.col("half") != half, F.col("n")).otherwise(0.0)
        counts = cells.groupBy("cell").agg(F.sum(rest * F.col("real")).alias("good"), F.sum(rest).alias("n"))
        seen[half] = model.transform(described(counts)).select("cell", "kind", "loose", "good", "n", F.round(vector_to_array("probability")[1], 9).alias("p")).collect()  # CELLS at most
    out: list[int] = []
    for kind in range(len(KINDS)):
        own = sorted((r for rows in seen.values() for r in rows if r["kind"] == kind), key=lambda r: -r["p"])
        good = n = 0.0
        cut = None
        for i, r in enumerate(own):
            good, n = good + r["good"], n + r["n"]
            if (i + 1 == len(own) or own[i + 1]["p"] < r["p"]) and n and good >= precision * n:
                cut = r["p"]
        loose = defaultdict(list)
        for r in own:
            if r["loose"] == 1:
                loose[r["cell"]].append(r["p"])
        out += [cell for cell, p in loose.items() if cut is not None and sum(p) / len(p) >= cut]
    return sorted(out)


def all_spans(found: DataFrame, cells: list[int]) -> DataFrame:
    """Adds ``spans``: base spans, and the accepted proposals that no earlier accepted one overlaps."""
    if not cells:
        return found.withColumn("spans", F.col("base"))

    def clear(taken: Column) -> Column:
        fits = lambda end, c: (F.when(c["start"] >= end, c["stop"]).otherwise(end), c["start"] >= end)
        return _once(_walk(taken, F.lit(0), fits, "boolean"), lambda ok: F.filter(taken, lambda c, i: F.get(ok, i)))

    taken = _once(F.filter("proposed", lambda c: c["cell"].isin(cells)), clear)
    added = F.transform(taken, lambda c: F.struct(*(c[n].alias(n) for n in ("start", "kind", "stop", "cell"))))
    return found.withColumn("spans", F.when(F.size("proposed") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))


def find(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted arrays of structs of start, kind (place in KINDS), stop and cell.

    Places count code points, the end is exclusive. Null text is empty and has none. Repeated rows each have their
    spans. ``docs`` may not have columns of the names ``base``, ``spans``, ``every``, ``proposed``, ``half``, ``parts``
    or ``[ph]_*``, ``base_*`` and ``loose_*``; :func:`digest` and :func:`redact` take any names.
    """
    found = candidates(docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))), text)
    cells = accepted_cells(found, precision)
    return all_spans(found, cells).drop("every", "proposed", "half")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts ``n_<kind>``, ``base_sha256``, ``spans``, and counts of added spans, for each row of ``docs``."""
    found = find(docs.select(F.col("doc_id").cast("long"), F.col("text")))
    count = lambda spans, k: F.size(F.filter(spans, lambda c: c["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets, and ``n_chars``, if it has one, renewed.

    Spans that overlap are replaced together under the first one's kind. A null text stays null; texts without spans,
    and all other columns, whatever their names, stay as they are. Repeated rows are each redacted; no rows give none.
    """
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    found = find(docs.toDF(*names).withColumn("text", F.col(at["text"]).cast("string")))
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    gaps = "struct<start:int,stop:int,kind:int>"

    def step(end: Column, c: Column) -> tuple[Column, Column]:
        gap = F.struct(end.alias("start"), c["start"].alias("stop"), c["kind"].alias("kind"))
        return F.greatest(end, c["stop"]), F.when(c["start"] >= end, gap)

    def written(wide: Column) -> Column:
        # four bytes a code point, so that a place is found at once; the mark before keeps one that the text begins with
        piece = lambda a, n: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(wide, a * 4 + 1, n * 4)), "UTF-32")
        parts = F.flatten(F.transform(F.filter(_walk(F.col("spans"), F.lit(0), step, gaps), lambda g: g.isNotNull()), lambda g: F.array(piece(g["start"], g["stop"] - g["start"]), F.get(labels, g["kind"]))))
        end = F.array_max(F.transform("spans", lambda c: c["stop"]))
        return F.concat(F.array_join(parts, ""), _once(end, lambda e: piece(e, F.length("text") - e)))

    done = _once(F.encode(F.make_valid_utf8("text"), "UTF-32"), written)
    hit = F.size("spans") > 0
    own = F.col(at["text"])
    out = {at["text"]: F.when(own.isNull(), own.cast("string")).when(hit, done).otherwise(own.cast("string"))}
    changed = found.withColumns(out)
    if "n_chars" in at:
        changed = changed.withColumn(at["n_chars"], F.when(hit & own.isNotNull(), F.length(own).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return changed.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
