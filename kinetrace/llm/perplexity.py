"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model predicts the characters of a word, with its end, from up to ORDER - 1 characters before, from the
word's start on. It is trained for each language on trusted documents (labels quality 1, toxic 0): their
words are counted, n-gram counts come from the distinct words, and each order's probabilities from joins of
count tables sharded by n-gram: with its context's sums, for the discounts, and with its suffix, for the
lower order. Orders below the highest use continuation counts, except n-grams at a word's start, which have
nothing before them.

Half of the trusted documents, by hash, are for training, all of them, and the other half sets the thresholds, so
that a document the model has not seen is held to the same measure.
Scoring joins the distinct words of each batch of documents with the n-gram table, shard by shard. A shard holds about
`max_grams` n-grams as sorted arrays of 64-bit hashes, probabilities and weights, which the executors make, so that the
driver passes on numbers of a known size and never the n-grams. All that a character needs goes by the two characters
before it, so each shard adds up its own characters of a text, and the sums of the shards make the text's perplexity.
N-grams of one or two characters are in every shard. A larger model costs more
passes over the documents, never n-grams. All documents are scored on all their words, and the threshold of a language is
a quantile of the perplexities of all held-out trusted documents in it, times a margin. A language has its own model
and its own threshold if it has enough trusted documents with a word in either half; all others use the model of all
languages together, and its threshold, the quantile of all held-out trusted documents under that model.

Defined cases: null and empty texts have no perplexity and are rejected; a null language is scored with the
model of all languages; a document with several labels is trusted if all say so; labels without a document
and null doc_ids in labels are ignored; documents with a null doc_id are scored and not trusted; repeated rows are scored
alike, also where they share a doc_id; very long texts are read in blocks; equal perplexities are judged alike; without any
trusted document all documents with a word are kept; an empty table gives an empty result; further columns are ignored by
`scored` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.text import WORD, U, mix, utf8, word_blocks
from kinetrace.session import cut, prepare

ORDER = 5
HEAD, TAIL = "\x02", "\x03"
ALL = "\x00all"
MAX_GRAMS, MAX_IDS, LEAST_TRUSTED = 4_000_000, 2_000_000, 20
QUANTILE, MARGIN = 0.995, 1.05
CACHE, BATCH_CHARS = 300_000, 4_000_000
_STEP = U(0xD6E8FEB86659FD93)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose labels all say good and not toxic."""
    per_doc = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return per_doc.agg(F.min(F.expr("quality = 1 and coalesce(toxic, 0) = 0")).alias("good")).where("good").select("doc_id")


def held_out() -> Column:
    """The half of the documents, by hash, whose trusted ones set the thresholds and are never trained on."""
    return F.expr("pmod(xxhash64(cast(doc_id as bigint)), 2) = 1")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of documents, for each language and for all together."""
    found = texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    every = found.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "word", "n")
    return found.where("lang is not null").unionByName(every)


def train(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p, backoff): the probability of a gram's last character, and its weight as a context."""
    padded = words.select("lang", "n", F.concat(F.lit(HEAD), "word", F.lit(TAIL)).alias("w"))
    ends = padded.select("lang", "n", "w", F.explode(F.expr("sequence(2, length(w))")).alias("i"))
    top = ends.select("lang", F.expr(f"substring(w, greatest(i - {order - 1}, 1), least(i, {order}))").alias("gram"), "n")
    top = cut(top.groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    at_head = top.where(F.length("gram") < order)
    counts = {order: top.where(F.length("gram") == order)}
    for k in range(order - 1, 0, -1):
        inner = counts[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        started = at_head.where(F.length("gram") == k)
        counts[k] = cut(inner.unionByName(started).groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    held, levels = None, []
    for k in range(1, order + 1):
        g = counts[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("suffix", F.expr("substring(gram, 2)"))
        t = g.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"t{i}") for i in range(1, 5)])
        y = "coalesce(try_divide(t1, t1 + 2 * t2), 0.5D)"
        d = [f"least(greatest(coalesce({i} - {i + 1} * {y} * try_divide(t{i + 1}, t{i}), {v}D), 0.05D), {i - 0.05}D) as d{i}" for i, v in ((1, 0.5), (2, 0.75), (3, 0.9))]
        # One row a language: a shuffle would deal n-grams to as many tasks.
        g = g.join(F.broadcast(t.selectExpr("lang", *d)), "lang").withColumn("d", F.expr("case when c = 1 then d1 when c = 2 then d2 else d3 end"))
        sums = g.groupBy("lang", "context").agg(F.sum("c").cast("double").alias("total"), F.sum("d").alias("mass"), F.count("*").alias("kinds"))
        g = g.join(sums, ["lang", "context"])
        own, share = F.expr("(c - d) / total"), F.col("mass") / F.col("total")
        if held is None:
            # One more, unseen character shares in the spare mass, so that no probability is 0.
            g = g.withColumn("p_low", 1.0 / (F.col("kinds") + 1))
            levels.append(g.groupBy("lang").agg(F.max(share * F.col("p_low")).alias("p")).select("lang", F.lit("").alias("gram"), "p"))
        else:
            g = g.join(held.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_low")), ["lang", "suffix"])
        held = cut(g.select("lang", "gram", "context", (own + share * F.col("p_low")).alias("p"), share.alias("share")))
        levels.append(held.select("lang", "gram", "p"))
        if k > 1:
            levels.append(held.select("lang", F.col("context").alias("gram"), F.col("share").alias("backoff")).distinct())
    # A gram's own probability and its weight as a context of the next order meet in one row.
    rows = [x.select("lang", "gram", F.col("p") if "p" in x.columns else F.lit(None).cast("double").alias("p"), F.col("backoff") if "backoff" in x.columns else F.lit(None).cast("double").alias("backoff")) for x in levels]
    both = rows[0]
    for x in rows[1:]:
        both = both.unionByName(x)
    return both.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.coalesce(F.max("backoff"), F.lit(1.0)).alias("backoff"))


def _salt(lang: str) -> np.uint64:
    return mix(np.array([crc32(utf8(lang))], U))[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)


def _ending(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 1 to `most`: a hash of the k characters that end at each position; the first k - 1 ones have none."""
    out, power = [codes], _STEP
    for k in range(1, most):
        h = out[-1].copy()
        h[k:] += codes[:-k] * power
        out.append(h)
        power = power * _STEP
    return out


def gram_keys(langs: list[str], grams: list[str]) -> np.ndarray:
    """64-bit hashes of n-grams of up to ORDER characters; two differ with a chance of about 2**-64 to collide."""
    size = np.array([len(g) for g in grams], np.int64)
    ends = np.cumsum(size)
    salts = {x: _salt(x) for x in set(langs)}
    h = np.zeros(len(grams), U)
    if len(grams) and ends[-1]:
        by_size = _ending(_codes("".join(grams)), ORDER)
        for k in range(1, ORDER + 1):
            mine = size == k
            h[mine] = by_size[k - 1][ends[mine] - 1]
    return mix(h * _STEP + np.array([salts[x] for x in langs], U) + size.astype(U))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = gram_keys(batch.column("lang").to_pylist(), batch.column("gram").to_pylist())
        logs = [pa.array(np.log2(np.maximum(batch.column(c).to_numpy(zero_copy_only=False).astype(float), 1e-12))) for c in ("p", "backoff")]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *logs], ["key", "p", "backoff"])


class Scorer:
    """log2 probabilities of words under one language's model, or under one shard of it, remembered in a bounded cache.

    The model is sorted keys of n-grams with their log2 probabilities and weights as contexts, NaN where there is none.
    """

    def __init__(self, model: tuple[np.ndarray, np.ndarray, np.ndarray], lang: str, shards: int = 1, shard: int = 0):
        self.keys, self.p, self.backoff = model
        self.salt, self.shards, self.shard = _salt(lang), shards, shard
        empty = self.find(np.zeros(1, U), 0, self.p)
        self.known = not np.isnan(empty[0])
        self.least = float(empty[0])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = _Index()
        self.bits, self.size = np.zeros(0), np.zeros(0, np.int64)

    def find(self, h: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        """The values of n-grams given by the hashes of `_ending`; NaN where there is none."""
        if not len(self.keys):
            return np.full(len(h), np.nan)
        key = mix(h * _STEP + self.salt + U(size))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, values[at], np.nan)

    def held(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether this shard has what the characters after these positions need: it goes by the last two before."""
        pairs = (np.where(before[1], codes[before[0] - 1], U(0)) << U(32)) | codes[before[0]]
        kinds, place = np.unique(pairs, return_inverse=True)
        text = ["".join(chr(int(c) - 1) for c in (x >> 32, x & 0xFFFFFFFF) if c) for x in kinds.tolist()]
        return np.array([crc32(utf8(t)) % self.shards == self.shard for t in text])[place]

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log2 probability as far as this shard holds it, number of characters with the end) of each word."""
        padded = [HEAD + w.decode("utf-8", "surrogatepass") + TAIL for w in words]
        size = np.array([len(w) for w in padded])
        codes = _codes("".join(padded))
        within = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        h = _ending(codes, ORDER)
        bits, left = np.zeros(len(codes)), np.flatnonzero(within > 0)
        if self.shards > 1:
            left = left[self.held(codes, (left - 1, within[left] > 1))]
        for k in range(ORDER - 1, -1, -1):  # the context's length; a shorter one only where the longer has no n-gram
            here = within[left] >= k
            at = left[here]
            got = self.find(h[k][at], k + 1, self.p)
            seen = ~np.isnan(got)
            bits[at[seen]] += got[seen]
            miss = at[~seen]
            bits[miss] += np.nan_to_num(self.find(h[k - 1][miss - 1], k, self.backoff)) if k else self.least
            left = np.concatenate((left[~here], miss))
        first = np.cumsum(size) - size
        return np.add.reduceat(bits, first), size - 1

    def sums(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        """The log2 probability and the number of characters of the words of each text."""
        ids = [[np.fromiter(map(self.index.__getitem__, block.split()), np.int64) for _, block in word_blocks(t, 0)] for t in texts]
        new = list(islice(self.index, len(self.bits), None))
        for lo in range(0, len(new), 50_000):
            bits, size = self.score(new[lo : lo + 50_000])
            self.bits, self.size = np.append(self.bits, bits), np.append(self.size, size)
        out = [sum(float(self.bits[x].sum()) for x in parts) for parts in ids], [sum(int(self.size[x].sum()) for x in parts) for parts in ids]
        if len(self.index) > CACHE:
            self.clear()
        return out


class _Index(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_scorers: dict[int, dict[str, Scorer]] = {}


def _scoring(shared, key: int, shards: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = {}
        models = _scorers[key]

        def scorer(lang):
            if lang not in models:
                found = Scorer(shared.value, lang, shards, shard)
                models[lang] = found if found.known else None
            return models[lang]

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            bits, n = np.zeros(len(langs)), np.zeros(len(langs), np.int64)
            groups: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                groups.setdefault(ALL if lang is None or scorer(lang) is None else lang, []).append(i)
            for lang, rows in groups.items():
                while rows:
                    size, take = 0, 0
                    while take < len(rows) and size < BATCH_CHARS:
                        size += len(texts[rows[take]].as_py() or "")
                        take += 1
                    part, rows = rows[:take], rows[take:]
                    found = [texts[i].as_py() for i in part]
                    model = scorer(lang)
                    if model:
                        bits[part], n[part] = model.sums(found)
                    else:
                        n[part] = [sum(len(b.split()) for _, b in word_blocks(t, 0)) for t in found]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bits), pa.array(n)], [*keep, "bits", "n"])

    return run


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the trusted documents."""
    return _with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), trusted_ids(labels))


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some documents; the ids go to all workers as long as they are few, so that the texts stay in place."""
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, "doc_id")


def own_languages(docs: DataFrame, labels: DataFrame) -> list[str]:
    """The languages with enough trusted documents for a model and a threshold of their own."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(WORD)).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    n = _with_ids(rows, trusted_ids(labels)).groupBy("lang").agg(F.count_if(held_out()).alias("held"), F.count_if(~held_out()).alias("seen"))
    return sorted(r.lang for r in n.where(F.least("held", "seen") >= LEAST_TRUSTED).collect())


def train_on(docs: DataFrame, labels: DataFrame, own: list[str]) -> DataFrame:
    """The model (lang, gram, p, backoff) of all trusted documents that are not held out."""
    words = word_counts(trusted_texts(docs.where(~held_out()), labels))
    return cut(train(cut(words.where(F.col("lang").isin(ALL, *own)))))


def load(model: DataFrame, shards: int = 1, shard: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, log2 p, log2 backoff) of one shard of a model: 24 bytes an n-gram."""

    def mine(last_two: str):
        return F.expr(f"pmod(crc32(cast({last_two} as binary)), {shards}) = {shard}")

    has_p = F.col("p").isNotNull() & ((F.length("gram") <= 2) | mine("substring(gram, length(gram) - 2, 2)"))
    has_backoff = (F.col("backoff") < 1) & ((F.length("gram") <= 1) | mine("substring(gram, length(gram) - 1, 2)"))
    rows = model.select("lang", "gram", F.when(has_p, F.col("p")).alias("p"), F.when(has_backoff, F.col("backoff")).alias("backoff")).where("p is not null or backoff is not null")
    found = rows.mapInArrow(_hashed, "key long, p double, backoff double").toArrow()
    keys, *values = (c.to_numpy() for c in found.columns)
    order = np.argsort(keys.view(U))
    return keys.view(U)[order], *(v[order] for v in values)


def perplexities(rows: DataFrame, model: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The rows with a perplexity in place of lang and text: (doc_id, lang, uid, perplexity)."""
    spark, parts = rows.sparkSession, []
    shards = max(1, -(-model.count() // max_grams))
    for shard in range(shards):
        shared = spark.sparkContext.broadcast(load(model, shards, shard))
        parts.append(cut(rows.mapInArrow(_scoring(shared, uuid4().int, shards, shard), "doc_id long, lang string, uid long, bits double, n long")))
        shared.unpersist()
    sums = parts[0]
    if shards > 1:
        key = ["doc_id", "lang", "uid"]
        each = parts[0].withColumn("shard", F.lit(0))
        for i, x in enumerate(parts[1:], 1):
            each = each.unionByName(x.withColumn("shard", F.lit(i)))
        # Repeated rows have equal sums: each shard gives one of them, and the number of rows.
        each = each.groupBy(*key, "shard").agg(F.max("bits").alias("bits"), F.max("n").alias("n"), F.count("*").alias("copies"))
        found = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("shard", "bits"))).alias("bits"), F.max("n").alias("n"), F.max("copies").alias("copies"))
        sums = cut(found.select(*key, F.expr("aggregate(bits, 0D, (a, x) -> a + x.bits)").alias("bits"), "n", F.explode(F.expr("sequence(1L, copies)"))))
    return sums.select("doc_id", "lang", "uid", F.expr("if(n > 0, power(2D, least(-bits / nullif(n, 0), 1000D)), null)").alias("perplexity"))


def scored(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row for each document: doc_id, lang, perplexity, threshold, trusted, kept (and the text's hash uid)."""
    prepare(docs.sparkSession)
    own = own_languages(docs, labels)
    model = train_on(docs, labels, own)
    uid = F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid")
    scores = perplexities(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", uid, "text"), model, max_grams)
    good = trusted_ids(labels).withColumn("trusted", F.lit(True))
    scores = scores.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    trusted = scores.where(F.col("trusted") & held_out() & F.col("perplexity").isNotNull())
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("q")
    by_lang = trusted.where(F.col("lang").isin(own)).groupBy("lang").agg(q)
    overall = None
    if not scores.where(F.col("lang").isNull() | ~F.col("lang").isin(own)).isEmpty():
        held = trusted_texts(docs.where(held_out()), labels).select("doc_id", F.lit(ALL).alias("lang"), uid, "text")
        overall = perplexities(held, model, max_grams).agg(q).first()["q"]
    limit = F.coalesce("q", F.lit(overall).cast("double"), F.lit(float("inf"))) * margin
    out = scores.join(F.broadcast(by_lang), "lang", "left").withColumn("threshold", limit)  # one row a language
    return out.select("doc_id", "lang", "perplexity", "threshold", "trusted", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"), "uid")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, in their own columns, that the classifier keeps."""
    verdict = scored(docs, labels, **options).where("kept").select("doc_id", "uid", "lang").distinct().alias("v")
    uid = F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), uid, "lang").alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.uid") == F.col("v.uid")) & F.col("d.lang").eqNullSafe(F.col("v.lang"))
    return d.join(verdict, on, "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
