"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent and normalised. The exponent is bisected (sixteen
ways at a time, as one aggregation over the sources) until the weights reach a target entropy, and raised no further
than a limit on repetition allows. The weights are then realised under a token budget: each source's documents are
dealt to blocks by hash, every pass over a source visits its blocks in a new order and a block's documents in a new
order, and the last pass stops where the source's budget is spent. Only sums by block and the documents of one
boundary block a source are ordered, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

BLOCK_DOCS = 4_096
STREAM_BLOCKS = 64
MAX_REPEATS = 4.0
MAX_EXPONENT = 64.0
SEED = 29


def words(text: Column) -> Column:
    """Tokens of a text: its runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bisect(measure, low: float, high: float, rounds: int = 10) -> float:
    """Where a falling function crosses zero, given its values at many points at once; an end where it doesn't.

    Of the last interval's ends the one with a value of zero or less is taken, ``high``'s side.
    """
    first = measure([low, high])
    if first[0] <= 0:
        return low
    if first[1] >= 0:
        return high
    for _ in range(rounds):
        at = [low + (high - low) * i / 16 for i in range(17)]
        values = measure(at)
        k = max(i for i in range(17) if values[i] > 0)
        low, high = at[k], at[min(k + 1, 16)]
    return high


def _powers(exponent: float) -> Column:
    """A share to the exponent, over the largest share's, so that it doesn't underflow for all sources."""
    return F.exp(F.col("lead") * exponent)


def entropies(sources: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy in nats of the weights for each exponent, from ``lead`` of each source."""
    sums = [s for a in exponents for s in (F.sum(_powers(a)), F.sum(_powers(a) * F.col("lead")))]
    row = sources.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return [math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(exponents)]


def repeats(sources: DataFrame, exponents: list[float], budget_share: float) -> list[float]:
    """How often the most repeated source is passed over, for each exponent."""
    cols = [c for a in exponents for c in (F.sum(_powers(a)), F.max(_powers(a) / F.col("share")))]
    row = sources.agg(*(c.alias(f"s{i}") for i, c in enumerate(cols))).first()
    return [budget_share * row[2 * i + 1] / row[2 * i] for i in range(len(exponents))]


def source_weights(sources: DataFrame, budget: int, total: int, target_entropy: float | None, max_repeats: float) -> tuple[DataFrame, float]:
    """``sources`` with ``weight`` and integer ``quota``, and the exponent.

    ``target_entropy`` (nats) defaults to half way between the sources' own entropy and that of equal weights. The
    repetition limit wins over the entropy, at exponents under 1, where small sources are repeated, and over 1, where
    the largest is. A limit that even proportional weights exceed gives proportional weights.
    """
    n, top = sources.agg(F.count("*"), F.max("share")).first()
    sources = sources.withColumn("lead", F.log(F.col("share") / F.lit(top or 1.0)))
    own = entropies(sources, [1.0])[0] if n else 0.0
    target = (own + math.log(max(n, 1))) / 2 if target_entropy is None else target_entropy
    exponent = 1.0
    if n > 1:
        exponent = _bisect(lambda at: [h - target for h in entropies(sources, at)], 0.0, MAX_EXPONENT)
        over = lambda at: [r - max_repeats for r in repeats(sources, at, budget / total)]
        if exponent < 1:  # repeats fall towards 1
            exponent = max(exponent, _bisect(over, 0.0, 1.0))
        elif exponent > 1:  # and rise beyond it
            exponent = 2 - max(2 - exponent, _bisect(lambda at: over([2 - a for a in at]), 2 - MAX_EXPONENT, 1.0))
    norm = sources.agg(F.sum(_powers(exponent))).first()[0] or 1.0
    weighted = sources.withColumn("weight", _powers(exponent) / norm)
    quota = F.floor(F.col("weight") * budget)
    if n and budget <= max_repeats * total:  # the limit can be kept, so it is kept to the token
        quota = F.least(quota, F.floor(F.col("tokens") * F.lit(float(max_repeats))))
    return weighted.withColumn("quota", quota.cast("long")).drop("lead"), exponent


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _mark(*parts) -> Column:
    """A hash of columns (named by strings) and of numbers."""
    return F.xxhash64(*(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts))


def plan(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What to take of each source's blocks: a row for each pass over a block, and the sources with their weights.

    ``docs`` has ``source``, ``mark`` (a hash of the document) and ``tokens``. The plan has ``source``, ``block``,
    ``epoch``, ``offset`` and ``width`` (shares of the source's quota spent before it and in it), and ``last`` (in the
    boundary block: the largest in-block rank hash still taken; else null).
    """
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")
    sizes = materialise(sizes)
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    sources, exponent = source_weights(sizes.withColumn("share", F.col("tokens") / max(total, 1)), budget, max(total, 1), target_entropy, max_repeats)
    sources = materialise(sources.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("int")).withColumn("exponent", F.lit(exponent)))

    dealt = docs.join(sources.select("source", "blocks"), "source").withColumn("block", F.pmod("mark", F.col("blocks")).cast("int"))
    blocks = materialise(dealt.groupBy("source", "block").agg(F.sum("tokens").alias("in_block")))
    full = F.floor(F.col("quota") / F.col("tokens")).cast("int")
    passes = blocks.join(sources, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), full)))
    order = Window.partitionBy("source", "epoch").orderBy(_mark("block", F.col("epoch"), seed), "block")
    passes = passes.withColumn("before", F.col("epoch") * F.col("tokens") + F.sum("in_block").over(order) - F.col("in_block"))
    passes = materialise(passes.where((F.col("before") < F.col("quota")) | ((F.col("in_block") == 0) & (F.col("epoch") < full))))
    # the one block of a source in which its quota ends: its documents are taken in rank order while they fit
    edge = passes.where((F.col("before") + F.col("in_block") > F.col("quota")))
    edge = edge.select("source", "block", "epoch", (F.col("quota") - F.col("before")).alias("room"))
    inside = dealt.join(edge, ["source", "block"]).withColumn("rank", _mark("mark", F.col("epoch"), seed))
    inside = inside.groupBy("source", "block", "epoch", "room", "rank").agg(F.sum("tokens").alias("tokens"))
    spent = F.sum("tokens").over(Window.partitionBy("source", "block", "epoch").orderBy("rank"))
    last = inside.withColumn("spent", spent).groupBy("source", "block", "epoch").agg(F.coalesce(F.max(F.when(F.col("spent") <= F.col("room"), F.col("rank"))), F.lit(-(1 << 63))).alias("last"))
    out = passes.join(last, ["source", "block", "epoch"], "left")
    return out.select("source", "block", "epoch", (F.col("before") / F.col("quota")).alias("offset"), (F.col("in_block") / F.col("quota")).alias("width"), "last"), sources


def _taken(docs: DataFrame, steps: DataFrame, sources: DataFrame, stream_blocks: int, seed: int) -> DataFrame:
    """A row for each time that a document is taken."""
    dealt = docs.join(sources.select("source", "blocks", "weight"), "source").withColumn("block", F.pmod("mark", F.col("blocks")).cast("int"))
    rank = _mark("mark", F.col("epoch"), seed)
    taken = dealt.join(steps, ["source", "block"]).withColumn("rank", rank).where(F.col("last").isNull() | (F.col("rank") <= F.col("last")))
    at = F.coalesce(F.col("offset") + F.col("width") * (F.col("rank") / 2.0**64 + 0.5), F.lit(0.0))
    stream = F.least(F.lit(stream_blocks - 1), F.floor(at * stream_blocks)).cast("int")
    return taken.withColumn("stream_block", stream).withColumn("place", _mark("mark", F.col("epoch"), F.col("stream_block"), seed))


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), _source().alias("source"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("mark"), words(text).alias("tokens"))


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, block_docs: int = BLOCK_DOCS, stream_blocks: int = STREAM_BLOCKS, seed: int = SEED) -> DataFrame:
    """The schedule: ``doc_id, source, tokens, weight, epoch, stream_block, place`` for each time a document is taken.

    Read by ``stream_block``, then ``place``: each stream block holds its share of every source's quota. ``budget``
    (tokens) defaults to the corpus's own size; no source is given more than its quota. A null source is the empty
    one. Rows equal in id and text are taken together; sources without tokens, and an empty table, give no rows.
    """
    light = materialise(_marked(docs))
    steps, sources = plan(light, budget, target_entropy, max_repeats, block_docs, seed)
    taken = _taken(light, materialise(steps), sources, stream_blocks, seed)
    return taken.select("doc_id", "source", "tokens", "weight", "epoch", "stream_block", "place")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``mix_epoch``, ``mix_block`` and ``mix_place``: a row for each time that the schedule takes a document.

    A name that ``docs`` already has gets underscores appended; its own columns stay as they are. A null source is the
    empty one and null text is empty; documents without tokens are taken once a pass. Repeated rows are each taken.
    Sources without tokens, and an empty table, give no rows.
    """
    seed, stream_blocks = how.get("seed", SEED), how.pop("stream_blocks", STREAM_BLOCKS)
    light = materialise(_marked(docs))
    steps, sources = plan(light, **how)
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("row"), _source().alias("source"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("mark"))
    taken = _taken(own, materialise(steps), sources, stream_blocks, seed)
    kept = [F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)]
    added = [F.col(c).alias(fresh(f"mix_{n}", docs.columns)) for c, n in (("epoch", "epoch"), ("stream_block", "block"), ("place", "place"))]
    return taken.select(*kept, *added)
