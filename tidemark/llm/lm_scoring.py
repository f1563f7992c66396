"""Language-model scoring by prediction by partial matching.

The byte-context trie is held as DataFrames: level k has one row for each context of k bytes and following byte
seen in training text, with its count. Counts follow update exclusion: the longest context counts occurrences, a
shorter one counts only the distinct longer contexts that the byte followed. The escape probability of a level is
estimated from its counts of counts, as n1 / (n1 + 2 n2) taken off each follower, and symbols that a longer context
has already offered are excluded from the shorter ones. Byte 0xFF, which UTF-8 never
uses, pads the start of a text and marks its end, so code lengths are those of whole texts. The byte model reads what
the word model reads: A-Z lower-cased, words joined by single spaces.

A text's code length is a sum over its byte grams, and a gram's probability is the same wherever it stands. So the
probabilities are worked out once for each distinct gram, and texts are scored by lookup: grams and words whose share
of all occurrences is at least 2^-23 and 2^-21 (so at most 2^23 and 2^21 of them can exist) are broadcast, all others
go through a shuffle join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise

ORDER = 5
CHUNK = 1 << 19
GRAM_SHARE = 1 << 23
WORD_SHARE = 1 << 21


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The first row and the texts (null: empty) of each run of rows of about CHUNK bytes; a longer text stands alone."""
    column = batch.column("text").cast(pa.binary())
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_numpy()
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield start, [t or b"" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ``order`` bytes before it as one integer, and the row it belongs to."""
    pad = b"\xff" * order
    data = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    windows = len(data) - order
    grams = np.zeros(windows, np.int64)
    for j in range(order + 1):
        grams <<= 8
        grams |= data[j : j + windows]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + order)[:windows]
    keep = np.ones(windows, bool)
    ends = np.cumsum(lengths + order)[:-1]
    keep[(ends[:, None] - np.arange(1, order + 1)).ravel()] = False
    return grams[keep], rows[keep]


def _gram_items(grams: np.ndarray, order: int) -> pa.Array:
    """Grams as binary items: the letter g, then their bytes."""
    width = order + 2
    raw = np.empty((len(grams), width), np.uint8)
    raw[:, 0] = ord("g")
    for j in range(order + 1):
        raw[:, 1 + j] = (grams >> (8 * (order - j))) & 0xFF
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(grams), [None, pa.py_buffer(raw.tobytes())])
    return fixed.cast(pa.binary())


def _counting(order: int):
    """Counts of words in training texts and of grams in all texts, summed over what one task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def word_rows() -> pa.RecordBatch:
            n = pa.array(words.values(), pa.int64())
            return pa.record_batch([pa.array([b"w" + w for w in words], pa.binary()), n, n], ["item", "n_train", "n_all"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, where = np.unique(keys, return_inverse=True)
            return keys, np.bincount(where, counts, len(keys)).astype(np.int64)

        def gram_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            train = np.where(keys & 1, counts, 0)
            return pa.record_batch([_gram_items(keys >> 1, order), pa.array(train), pa.array(counts)], ["item", "n_train", "n_all"])

        for batch in batches:
            train = ~np.array(batch.column("held_out").to_pylist(), bool)
            for a, texts in _chunks(batch):
                for i, text in enumerate(texts):
                    tokens = text.lower().split()
                    texts[i] = b" ".join(tokens)
                    if train[a + i]:
                        words.update(tokens)
                        words[b""] += 1
                grams, rows = _grams(texts, order)
                keys = (grams << 1) | train[a : a + len(texts)][rows]
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                size += len(first)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield gram_rows(*held[0])
                        held, size = [], 0
                if len(words) > 200_000:
                    yield word_rows()
                    words.clear()
        if words:
            yield word_rows()
        if held:
            yield gram_rows(*merged())

    return run


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """log10 probability of the last byte of each gram after the bytes before it.

    ``grams`` has ``gram`` (order + 1 bytes as a long), ``n_train`` and ``n_all``, one row a gram; the model is what
    ``n_train`` counts. Adds ``logp``. Every byte of every context gets a positive probability, and for each context
    they sum to one over the 256 symbols.
    """
    mask = [(1 << (8 * (k + 1))) - 1 for k in range(order + 1)]
    level = {order: grams.where("n_train > 0").select(F.col("gram").alias("g"), F.col("n_train").alias("c"))}
    for k in range(order - 1, -1, -1):
        level[k] = level[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask[k])).alias("g")).agg(F.count("*").alias("c"))
    once = {k: level[k].agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first() for k in level}
    discount = {k: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5 for k, (a, b) in once.items()}
    contexts = {}
    for k in range(1, order + 1):
        below = level[k - 1].select(F.col("g").alias("low"), F.col("c").alias("below"))
        below = F.broadcast(below) if k <= 1 else below  # 256 rows at most
        contexts[k] = (
            level[k].withColumn("low", F.col("g").bitwiseAND(F.lit(mask[k - 1])))
            .join(below, "low")
            .groupBy(F.shiftright("g", 8).alias("ctx"))
            .agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("below").alias("x"))
        )
    n0, d0 = level[0].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    seen = (
        grams.where("n_train > 0").withColumn("ctx", F.shiftright("gram", 8)).join(contexts[order].select("ctx", "n"), "ctx")
        .select("gram", "n_train", "n_all", F.log10((F.col("n_train") - discount[order]) / F.col("n")).alias("logp"))
    )
    rest = grams.where("n_train = 0").select(
        "gram", "n_train", "n_all", F.lit(None).cast("double").alias("logp"), F.lit(0.0).alias("spent"), F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("pd")
    )
    for k in range(order, -1, -1):
        if k:
            ctx = contexts[k] if k > 2 else F.broadcast(contexts[k])  # 65,536 rows at most
            rest = rest.withColumn("ctx", F.shiftright("gram", 8).bitwiseAND(F.lit(mask[k - 1]))).join(ctx, "ctx", "left")
        else:
            rest = rest.withColumns({"n": F.lit(n0 or None).cast("long"), "d": F.lit(d0 or None).cast("long"), "x": F.lit(0).cast("long")})
        if k < order:
            found = level[k] if k > 1 else F.broadcast(level[k])  # 65,536 rows at most
            rest = rest.withColumn("g", F.col("gram").bitwiseAND(F.lit(mask[k]))).join(found, "g", "left")
        else:
            rest = rest.withColumn("c", F.lit(None).cast("long"))
        new = F.col("d") - F.col("pd")
        total = F.col("n") - F.col("px")
        coded = F.col("logp").isNull() & (new > 0)
        rest = rest.select(
            "gram", "n_train", "n_all",
            F.when(coded & F.col("c").isNotNull(), F.col("spent") + F.log10((F.col("c") - discount[k]) / total)).otherwise(F.col("logp")).alias("logp"),
            F.when(coded & F.col("c").isNull(), F.col("spent") + F.log10(discount[k] * new / total)).otherwise(F.col("spent")).alias("spent"),
            F.coalesce("x", "px").alias("px"), F.coalesce("d", "pd").alias("pd"),
        )
    rest = rest.withColumn("logp", F.coalesce("logp", F.col("spent") - F.log10(F.lit(256) - F.col("pd"))))
    return seen.unionByName(rest.select("gram", "n_train", "n_all", "logp"))


class Lookup:
    """Open-addressing hash table from non-negative integers to doubles; probes whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        self.reach = 1
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[at] < 0
            spot, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[spot], self.values[spot] = keys[put], values[put]
            rest = self.keys[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.reach += bool(len(left))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and whether each key is present."""
        at = self.slot(keys)
        hit = self.keys[at] == keys
        out = np.where(hit, self.values[at], 0.0)
        left = np.flatnonzero(~hit & (self.keys[at] >= 0))
        for step in range(1, self.reach):
            if not len(left):
                break
            spot = (at[left] + step) & ((1 << self.bits) - 1)
            same = self.keys[spot] == keys[left]
            out[left[same]], hit[left[same]] = self.values[spot[same]], True
            left = left[~same & (self.keys[spot] >= 0)]
        return out, hit


_READY: dict = {}


def _ready(shared) -> tuple[dict, Lookup]:
    """The lookup structures of a broadcast, built once in each worker process."""
    if shared.value["id"] not in _READY:
        _READY.clear()
        v = shared.value
        _READY[v["id"]] = (dict(zip(v["words"], v["word_values"].tolist(), strict=True)), Lookup(v["grams"], v["gram_values"]))
    return _READY[shared.value["id"]]


OUT = "doc_id long, th long, held_out boolean, item binary, tf long, rows long, n_tokens long, n_known long, base double, score double"


def _scoring(order: int, shared):
    """One row a document with what the broadcast tables give, and one for each of its other words and grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _ready(shared)
        get = known.get
        for batch in batches:
            ids = batch.column("doc_id")
            held = batch.column("held_out")
            for a, texts in _chunks(batch):
                m = len(texts)
                n_tokens, n_known, base = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
                items, item_rows, tf = [], [], []
                for i in range(m):
                    words = texts[i].lower().split()
                    texts[i] = b" ".join(words)
                    words.append(b"")
                    n_tokens[i] = len(words)
                    found = [x for x in map(get, words) if x is not None]
                    n_known[i], base[i] = len(found), sum(found)
                    if len(found) < len(words):
                        rare = Counter(w for w in words if w not in known)
                        items += [b"w" + w for w in rare]
                        tf += rare.values()
                        item_rows += [i] * len(rare)
                th = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, m).view(np.int64)
                grams, rows = _grams(texts, order)
                value, hit = table.find(grams)
                score = np.bincount(rows, value, m)
                miss = np.flatnonzero(~hit)
                by = np.lexsort((grams[miss], rows[miss]))
                g, r = grams[miss][by], rows[miss][by]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])) if len(g) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(g)))
                g, r = g[first], r[first]

                own = pa.array([b"d" + int(x).to_bytes(8, "big", signed=True) for x in th], pa.binary())
                item = pa.concat_arrays([own, pa.array(items, pa.binary()), _gram_items(g, order)])
                at = np.concatenate([np.arange(m), np.array(item_rows, np.int64), r.astype(np.int64)])
                more = len(at) - m
                zero = np.zeros(more, np.int64)
                take = pa.array(at + a)
                columns = [
                    ids.take(take), pa.array(th[at]), held.take(take), item,
                    pa.array(np.concatenate([np.zeros(m, np.int64), np.array(tf, np.int64), counts])),
                    pa.array(np.concatenate([np.ones(m, np.int64), zero])),
                    pa.array(np.concatenate([n_tokens, zero])), pa.array(np.concatenate([n_known, zero])),
                    pa.array(np.concatenate([base, np.zeros(more)])), pa.array(np.concatenate([score, np.zeros(more)])),
                ]
                yield pa.record_batch(columns, ["doc_id", "th", "held_out", "item", "tf", "rows", "n_tokens", "n_known", "base", "score"])

    return run


def score_documents(docs: DataFrame, held_remainder: int = 1, order: int = ORDER, gram_share: int = GRAM_SHARE, word_share: int = WORD_SHARE) -> DataFrame:
    """Score every text by the byte model and by the add-half unigram word model, both learned from training rows.

    Training rows are those whose crc32 of the id leaves another remainder than ``held_remainder`` modulo 5. Returns
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities), one row for each
    row of ``docs``. Null text counts as empty; a null id is never held out; repeated rows each give a row with the
    same scores; an empty table gives no rows; with no training rows the byte model is uniform over 256 symbols.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), fold(F.col("doc_id"), held_remainder).alias("held_out"))
    counted = docs.select("text", "held_out").mapInArrow(_counting(order), "item binary, n_train long, n_all long")
    counts = materialise(counted.groupBy("item").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")))
    letter = F.substring("item", 1, 1)

    words = counts.where((letter == F.lit(b"w")) & (F.col("n_train") > 0)).select("item", "n_train")
    total, distinct = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    log_den = F.log10(F.lit(total + 0.5 * (distinct + 1)))
    words = words.select("item", (F.log10(F.col("n_train") + 0.5) - log_den).alias("value"), F.col("n_train").alias("n"))

    grams = counts.where(letter == F.lit(b"g")).select(F.conv(F.hex(F.expr("substring(item, 2)")), 16, 10).cast("long").alias("gram"), "n_train", "n_all")
    model = materialise(code_lengths(grams, order))
    seen = model.agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]

    top = words.where(F.col("n") * word_share >= total).select("item", "value").toArrow()
    head = model.where(F.col("n_all") * gram_share >= seen).select("gram", "logp").toArrow()
    shared = spark.sparkContext.broadcast({
        "id": f"{spark.sparkContext.applicationId}-{id(top)}-{total}-{seen}", "words": [w[1:] for w in top.column(0).to_pylist()], "word_values": top.column(1).to_numpy(),
        "grams": head.column(0).to_numpy(), "gram_values": head.column(1).to_numpy(),
    })
    width = 2 * (order + 1)
    item = F.concat(F.lit(b"g"), F.unhex(F.lpad(F.hex("gram"), width, "0")))
    values = words.where(F.col("n") * word_share < total).select("item", "value").union(
        model.where(F.col("n_all") * gram_share < seen).select(item, "logp")
    )
    unseen = F.log10(F.lit(0.5)) - log_den
    is_word = letter == F.lit(b"w")
    parts = docs.mapInArrow(_scoring(order, shared), OUT).join(values, "item", "left")
    summed = parts.groupBy("doc_id", "th", "held_out").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(is_word & F.col("value").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(is_word, F.col("tf") * F.coalesce("value", unseen)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(letter == F.lit(b"g"), F.col("tf") * F.col("value")).otherwise(0.0)).alias("score"),
    )
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "held_out", (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
