"""Queries that SQL cannot express, against versions of them that use none of the operators' own code paths."""

import base64
import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from kinetrace.llm import digest, fertility, mixing, packing, perplexity, secrets, substrings
from kinetrace.llm.text import shingles, words
from kinetrace.llm.tokens import public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MASK = (1 << 64) - 1


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- op5 ---------------------------------------------------------------------------------------------------


def splitmix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def feature_set(data):
    """The features of a text, in order and once each, from entropies that are counted window by window."""
    if not data:
        return []

    def hashed(window):
        h = 0
        for k in range(4):
            h = splitmix((h * 0x9E3779B97F4A7C15 + int.from_bytes(window[8 * k : 8 * k + 8], "little") + k + 1) & MASK)
        return h

    if len(data) < 32:
        return [hashed(data.ljust(32, b"\0")) ^ len(data)]
    f = [0] + [round(c * math.log2(c) * 65536) for c in range(1, 33)]
    total = lambda bits: round((5 - bits) * 32 * 65536)
    rank = []
    for i in range(len(data) - 31):
        s = sum(f[c] for c in Counter(data[i : i + 32]).values())
        rank.append(1 << 27 if s > total(1.5) else (1 << 26) - abs(s - total(3.6)))
    runs = len(rank) - 31
    if runs < 1:
        chosen = [min(range(len(rank)), key=lambda i: (rank[i], i))]
    else:
        votes = Counter(min(range(r, r + 32), key=lambda i: (rank[i], i)) for r in range(runs))
        chosen = sorted(i for i, v in votes.items() if v >= min(8, runs))
    return list(dict.fromkeys(hashed(data[i : i + 32]) for i in chosen))


def chain(features):
    return [{h >> 11 * k & 2047 for h in features[lo : lo + 160] for k in range(5)} for lo in range(0, len(features), 160)]


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def one(x, y):
        out = 0.0
        for k, f in enumerate(chain(x)):
            best = 0.0
            for g in chain(y):
                chance, most, both = len(f) * len(g) / 2048, min(len(f), len(g)), len(f & g)
                score = (both - chance) / max(most - chance, 1e-9) if both - chance > 3 * math.sqrt(chance) else 0.0
                best = max(best, 1.0 if both == most and len(f) == len(g) else score)
            out += min(1.0, best) * len(x[160 * k : 160 * k + 160])
        return out / len(x)

    if len(a) == len(b):
        return 1.0 if chain(a) == chain(b) else (one(a, b) + one(b, a)) / 2
    return one(a, b) if len(a) < len(b) else one(b, a)


def test_op5_by_brute_force(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(3, 400)) for _ in range(14)] + ["", None, "short", "aaaa" * 30, "é\U0001f642" * 40, " ".join(f"{rng.random()}" for _ in range(1200))]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in digest.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    plain = [t or "" for t in texts]

    def shown(features):
        bits = np.zeros((len(chain(features)), 2048), bool)
        for k, f in enumerate(chain(features)):
            bits[k, sorted(f)] = True
        return f"{len(features)}:{base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()}"

    for i, t in enumerate(plain):
        following = plain[i - 1] if i else plain[-1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, b, c = (feature_set(x.encode()) for x in (t, changed, following))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (shown(a), shown(b))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(a, b)) and r.near_next == pytest.approx(alike(a, c))


# --- op6 ---------------------------------------------------------------------------------------------------


def test_op6_by_brute_force(spark):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(6)
    made = []
    for i in range(150):
        text = " ".join(rng.choice(["the", "house", "and", "water", "going", "people", "small", "world"]) + rng.choice(["", "s", "ing", ",", "."]) for _ in range(rng.randrange(15, 90)))
        if i % 15 == 0:
            text = "".join(rng.choices("qxzjvk木水火土🙂", k=300)) + " " + text
        if i % 19 == 0:
            text = "one two three four five six seven eight nine ten " * 6
        made.append((i, text, ("en", "fr", None, "xx")[(i % 3 == 0) + (i % 7 == 0) + (i == 21)], "s", 0))
    model, path = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model")), public_path("piece_bpe_32k.model")
    seen = {}
    for i, t, lang, *_ in made:
        found = [w.decode() for w in words(t)]
        tokens = [x for w in found for x in model.encode(w)]
        share = [n / len(tokens) for n in Counter(tokens).values()]
        windows = Counter(tuple(found[k : k + 8]) for k in range(len(found) - 7))
        repeated = {k + j for k in range(len(found) - 7) if windows[tuple(found[k : k + 8])] > 1 for j in range(8)}
        failed = len(found) < 20 or 100 * len(repeated) > 30 * len(found)
        measures = (sum(map(len, found)) / len(tokens), sum(model.is_byte(x) for x in tokens) / len(tokens), -sum(s * math.log2(s) for s in share) / math.log2(max(2, len(tokens))))
        seen[i] = (lang or fertility.script(t), failed, measures)

    def bands(rows):
        out = []
        for k, floor in enumerate((0.1, 0.05, 0.08)):
            v = sorted(m[k] for _, bad, m in rows if not bad)
            q1, q3 = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.75))
            wide = max((q3 - q1) * 3, floor)
            out.append((q1 - wide, q3 + wide))
        return out

    def enough(g):
        return sum(x[0] == g and not x[1] for x in seen.values()) >= 30

    of = {g: bands([x for x in seen.values() if x[0] == g]) if enough(g) else bands(seen.values()) for g in {x[0] for x in seen.values()}}
    got = {r.doc_id: r for r in fertility.quality_rules(spark.createDataFrame(made, DOCS), path, least=30).collect()}
    for i, (g, failed, m) in seen.items():
        r = got[i]
        assert (r.chars_per_token, r.byte_share, r.token_entropy) == pytest.approx(m) and r.base_failed == failed
        assert r.kept == (not failed and all(lo <= x <= hi for x, (lo, hi) in zip(m, of[g], strict=True))), i
    assert 5 < sum(not r.kept and not r.base_failed for r in got.values()) < 60 and sum(enough(g) for g in of) == 2


# --- op2 ---------------------------------------------------------------------------------------------------


def test_op2_by_brute_force(spark):
    """Spans, removals, keepers and clusters from all pairs of lines and all equal windows; and the recall of planted passages."""
    rng = random.Random(2)
    passages = [prose(rng, n, 10**6).split() for n in (51, 60, 75, 120, 40, 34)]
    texts, planted = [], {}
    for i in range(60):
        lines = [prose(rng, rng.randrange(2, 40), 10**6) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            k = i // 3 % len(passages)
            planted[i] = k
            lines.insert(rng.randrange(len(lines) + 1), " ".join([*prose(rng, 3, 10**6).split(), *passages[k], *prose(rng, 2, 10**6).split()]))
        if i % 4 == 0:
            near = "a shared line of quite a few ordinary words that several of the documents have in common with one another today".split()
            if i % 8 == 0:
                near[rng.randrange(len(near))] = f"x{rng.randrange(9)}"
            lines.append(" ".join(near))
        texts.append("\n".join(lines))
    paragraphs = {}
    for d, t in enumerate(texts):
        h, at = substrings.anchored_windows(t, 32, 20)
        found = t.split()
        for s in at.tolist():
            paragraphs.setdefault(("w", *found[s : s + 32]), []).append((d, s, 32))
        first = 0
        for line in t.split("\n"):
            w = line.split()
            if len(w) >= 5:
                paragraphs.setdefault(("l", *w), []).append((d, first, len(w)))
            first += len(w)
    keys = list(paragraphs)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    grams = {k: {k[i : i + 5] for i in range(1, len(k) - 4)} for k in keys if k[0] == "l"}
    for i, a in enumerate(grams):
        for b in list(grams)[i + 1 :]:
            if 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b])):
                up[root(a)] = root(b)
    clusters = {}
    for k in keys:
        clusters.setdefault(root(k), []).extend(paragraphs[k])
    per = {}
    for inst in clusters.values():
        if len({d for d, *_ in inst}) > 1:
            keep = min(inst)
            for d, s, n in inst:
                x = per.setdefault(d, (set(), set(), set(), []))
                x[0].update(range(s, s + n))
                if (d, s) != keep[:2]:
                    x[1].update(range(s, s + n))
                x[2].add(keep[0])
                x[3].append(id(inst))
    got = {r.doc_id: r for r in substrings.repeated_passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    assert set(got) == set(per)
    for d, (every, gone, keepers, of) in per.items():
        r = got[d]
        marked = {w for x in r.spans.split(",") if x for w in range(*map(int, x.split(":")))}
        removed = {w for x in r.removed_spans.split(",") if x for w in range(*map(int, x.split(":")))}
        assert (marked, removed, r.keep_ids, r.n_clusters) == (every, gone, sorted(keepers), len(set(of))) and r.repeated_words == len(every)
    long = substrings.repeated_passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), report=32)
    hit = {r.doc_id for r in long.collect()}
    assert {d for d, k in planted.items() if len(passages[k]) > 50} <= hit <= set(planted)


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, sf, tmp_path):
    """Each stage again by other means, from the first's verdicts on; the last one's documents, tokens and copies must agree."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = perplexity.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    first = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    rows = list(first.values())
    sets = [set(shingles(r.text).tolist()) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")).collect()}
    texts = {}
    for r in rows:
        out, at = "", 0
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[r.doc_id].split(",") if x):
            out += r.text[at:s] + "[SECRET]" if s >= at else ""
            at = max(at, e)
        texts[r.doc_id] = out + r.text[at:]
    con = duckdb.connect()
    frame = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.source) for r in rows], "doc_id long, text string, source string").toPandas()
    con.register("documents", frame)
    copies = {d: taken // size if size else 0 for d, size, _, _, taken in con.sql(mixing.mix_sql()).fetchall()}
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = Counter()
    for d, n in copies.items():
        if n:
            want[d, len(library.encode(texts[d], add_special_tokens=False).ids) + 1] = n
    got = pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(tokens * n for (_, tokens), n in want.items())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    limits = packing.INSTRUCTION
    for x in by_sequence.values():
        assert len(x) <= limits["max_segments"] and sum(r.length for r in x) <= limits["capacity"] and sum(r.loss_tokens for r in x) <= limits["max_loss"]
