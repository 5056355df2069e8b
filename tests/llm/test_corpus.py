"""The corpus operators against brute force on small fixtures, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from kinetrace.llm import chat, digest, fertility, mixing, neardup, packing, perplexity, planes, queries, secrets, substrings
from kinetrace.llm.text import shingles, words
from kinetrace.llm.tokens import encoder, public_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append(prose(rng, rng.randrange(5, 160)))
    base = prose(rng, 120).split()
    for i in range(25):  # near copies of one text, each with one word changed
        w = list(base)
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append(" ".join(w))
    rows += [rows[0]] * 6 + ["", "", None, "one two", "one two", " \n ", "é ß 漢字 \U0001f642"]
    passage = prose(rng, 55)
    for _ in range(4):
        rows.append(f"{prose(rng, 30)} {passage} {prose(rng, 40)}")
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, fixture):
    # further columns have the names that the operators use inside
    return spark.createDataFrame(fixture, DOCS).withColumns({c: F.lit(1) for c in ("uid", "base", "kind", "size", "component", "start", "copies", "rank", "h")}).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sets(text):
    w = words(text)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def test_shingles_are_those_of_words(fixture):
    for _, text, *_ in fixture:
        assert len(shingles(text)) == len(sets(text))


def test_encoding_is_the_librarys(fixture):
    from tokenizers import Tokenizer

    odd = ["  two  spaces\n\n \tx", "don't we'll", "a b　c\x1cd", "<|endoftext|> ok", "a<|endoftext|>b  <|endoftext|>\n\nc", "<|startoftext|><|endoftext|>", "<|endoftext|", "İstanbul ΣΑΣ", "x" * 200, "end. ", " start", "***bold***"]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        t = Tokenizer.from_file(public_path(name))
        e = encoder(public_path(name), kind)
        for text in [x[1] or "" for x in fixture] + odd:
            assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 60_000, n).astype("<u4")) for i, n in enumerate([0, 1, 700, 5, 3000])] + [(None, np.array([2**32 - 1], "<u4"))]
    f = planes.PlaneFile(planes.write_file(docs, bits=bits, block=512))
    assert all(a == c and (b == d).all() for (a, b), (c, d) in zip(docs, f.documents(), strict=True))
    whole = np.concatenate([x for _, x in docs])
    assert (f.read_block(2) == whole[1024:1536]).all()
    assert list(planes.PlaneFile(planes.write_file([], bits)).documents()) == []


def test_op1(spark, docs, fixture, nothing, tmp_path):
    path = public_path("byte_bpe_50k.json")
    planes.write_dataset(docs, f"file://{tmp_path}/a", path, file_ids=2000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.document_index(spark, f"file://{tmp_path}/a").collect()}
    at, e = 0, encoder(path, "byte")
    for i, text, *_ in fixture:
        ids = np.append(e.encode(text), np.uint32(0)).astype("<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    planes.write_dataset(nothing, f"file://{tmp_path}/b", path)
    assert planes.document_index(spark, f"file://{tmp_path}/b").count() == 0


def test_op2(spark, docs, fixture, nothing):
    got = {r.doc_id: r for r in substrings.repeated_passages(docs).collect()}
    seen, want = {}, set()
    for i, text, *_ in fixture:
        w = words(text)
        for j in range(len(w) - 50):
            other = seen.setdefault(tuple(w[j : j + 51]), i)
            want |= {i, other} if other != i else set()
    assert want and want <= set(got)
    assert not {i for i in got if i < 60 and i not in want and fixture[i][1] != fixture[0][1]}
    planted = [i for i, t, *_ in fixture][-4:]
    assert all(min(got[planted[0]].keep_ids) == planted[0] and got[i].removed_words >= 40 for i in planted[1:])
    cleaned = {r.doc_id: r.text for r in substrings.remove_passages(docs).collect()}
    assert cleaned[planted[0]] == fixture[planted[0]][1] and len(words(cleaned[planted[1]])) <= 85
    assert substrings.repeated_passages(nothing).count() == 0


def test_op2_near_copies_of_lines(spark):
    rng = random.Random(2)
    line = prose(rng, 80).split()
    other = list(line)
    other[10] = "changed"
    rows = [(1, "\n".join([prose(rng, 50), " ".join(line)]), "en", "s", 0), (2, "\n".join([" ".join(other), prose(rng, 50)]), "en", "s", 0)]
    lines = substrings.line_clusters(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), 32, 8, 3, 0.8).collect()
    assert len(lines) == 2 and len({r.cluster for r in lines}) == 1


@pytest.mark.parametrize("block", [1000, 5])
def test_op2_compares_all_lines_of_a_bucket(spark, block):
    rng = random.Random(11)
    base, rows = prose(rng, 80).split(), []
    for i in range(120):  # families of two, far from each other and from most leaders
        family = list(base)
        for at in (i % 30, 40 + i % 30):
            family[at] = f"family{i}"
        for j in range(2):
            line = list(family)
            line[75] += "own" * j
            rows.append((2 * i + j, " ".join(line), "en", "s", 0))
    got = {r.h: r.cluster for r in substrings.line_clusters(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), 32, 8, 3, 0.8, block_lines=block).collect()}
    lines = [r[1].encode() for r in rows]
    h, m = substrings.line_hashes(lines).tolist(), substrings.line_minhashes(lines, substrings.multipliers(24, 2)).reshape(len(rows), 8, 3)
    grams, up = [sets(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b])) and (m[a] == m[b]).all(axis=1).any():
                up[root(a)] = root(b)
    want = {}
    for i in range(len(rows)):
        want.setdefault(root(i), set()).add(h[i])
    clusters = {}
    for x, c in got.items():
        clusters.setdefault(c, set()).add(x)
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    assert len(want) > 100 and {frozenset(x) for x in clusters.values()} == want


def test_op2_short_lines(spark):
    rng = random.Random(13)
    short, near = prose(rng, 5), prose(rng, 20)
    rows = [(1, f"{prose(rng, 9)}\n{short}\n{near}", "en", "s", 0), (2, f"{short}\n{prose(rng, 9)}\n{near} end", "en", "s", 0), (3, prose(rng, 40), "en", "s", 0)]
    got = {r.doc_id: r for r in substrings.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].spans, got[1].removed_spans) == ("9:34", "")
    assert (got[2].spans, got[2].removed_spans) == ("0:5,14:35", "0:5,14:35")


class ByHand:
    """The probabilities of a trained table, looked up one character at a time."""

    def __init__(self, model, lang):
        rows = model.where(F.col("lang") == lang).collect()
        self.p, self.backoff = {r.gram: r.p for r in rows if r.p is not None}, {r.gram: r.backoff for r in rows}

    def probability(self, context, ch):
        if context + ch in self.p:
            return self.p[context + ch]
        return self.backoff.get(context, 1.0) * self.probability(context[1:], ch) if context else self.p[""]

    def perplexity(self, found):
        bits = n = 0
        for w in found:
            w = "\x02" + w + "\x03"
            for i in range(1, len(w)):
                bits -= math.log2(self.probability(w[max(0, i - 4) : i], w[i]))
                n += 1
        return 2 ** (bits / n) if n else None


def test_op3_perplexity_threshold_and_verdict_by_hand(spark):
    """Every column of the result, from labels to verdict, computed again without the operator."""
    rng = random.Random(33)
    rows = []
    for i in range(400):
        lang = ("en", "de", None, "xx")[(i % 7 > 3) + (i % 11 == 3) + (i % 50 == 7)]
        text = prose(rng, rng.randrange(1, 60), 80 if lang == "en" else 50)
        rows.append((i, text if i % 9 else "".join(rng.choices("qwzxkj ÿ\U0001f642", k=80)), lang, "s", 0))
    rows += [(400, None, "en", "s", 0), (401, "", None, "s", 0), (402, " \n", "de", "s", 0), (None, "some words", "en", "s", 0), (5, rows[5][1], rows[5][2], "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    given = [(i, int(i % 9 > 0), int(i % 13 == 0)) for i in range(0, 330)] + [(8, 0, 0), (None, 1, 0), (999, 1, 0)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    bad = {i for i, q, t in given if q != 1 or t}
    trusted = {i for i, *_ in given if i is not None} - bad
    held = {r.doc_id for r in df.where(perplexity.held_out()).collect()}
    own = [x for x in ("de", "en", "xx") if min(sum(r[2] == x and r[0] in trusted and bool((r[1] or "").split()) and (r[0] in held) == h for r in rows) for h in (True, False)) >= 20]
    model = perplexity.train_on(df, labels, own)
    by_hand = {x: ByHand(model, x) for x in (perplexity.ALL, *own)}
    score = {i: {x: by_hand[x].perplexity([w.decode() for w in words(r[1])]) for x in by_hand} for i, r in enumerate(rows)}
    mine = {i: r[2] if r[2] in own else perplexity.ALL for i, r in enumerate(rows)}

    def quantile(x):
        found = sorted(score[i][x] for i, r in enumerate(rows) if r[0] in trusted & held and score[i][x] and (x == perplexity.ALL or r[2] == x))
        return found[math.ceil(perplexity.QUANTILE * len(found)) - 1] * perplexity.MARGIN

    want = []
    for i, r in enumerate(rows):
        got, limit = score[i][mine[i]], quantile(mine[i])
        want.append((r[0], r[2], got and pytest.approx(got), pytest.approx(limit), r[0] in trusted, bool(got and got <= limit * (1 + 1e-9))))
    assert 0 < sum(x[5] for x in want) < 380 and len(own) == 2
    found = perplexity.scored(df.withColumn("perplexity", F.lit(1)), labels).select("doc_id", "lang", "perplexity", "threshold", "trusted", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a == b
    wide = df.withColumns({x: F.lit(x) for x in ("__id", "__uid", "__key", "uid", "row", "kept")})
    kept = perplexity.keep_good(wide, labels)
    assert kept.columns == wide.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(x[0] or -1 for x in want if x[5])


def test_op3_long_texts_in_blocks(spark):
    """A text beyond a block has the perplexity of its words."""
    from kinetrace.llm import text

    one = "lorem ipsum dolor sit amet " * 10
    long = one * (text.BLOCK_CHARS // len(one) + 40)
    df = spark.createDataFrame([(i, one, "en", "s", 0) for i in range(60)] + [(99, long, "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in perplexity.scored(df, spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")).collect()}
    assert got[99].perplexity == pytest.approx(got[1].perplexity) and got[99].kept


def test_op3(spark, docs, nothing):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 50)] + [(None, 1, 0), (9999, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = ByHand(perplexity.train_on(docs, labels, perplexity.own_languages(docs, labels)), perplexity.ALL)
    symbols = [g for g in model.p if len(g) == 1] + ["unseen"]
    for context in ("", "\x02", "\x02a", "1", "zz"):
        assert sum(model.probability(context, c[:1] if c != "unseen" else "一") for c in symbols) == pytest.approx(1)
    got = {r.doc_id: r for r in perplexity.scored(docs, labels).collect()}
    assert got[91].perplexity is None and not got[91].kept and not got[3].trusted
    assert sum(r.kept for i, r in got.items() if i < 60) >= 57
    assert perplexity.scored(nothing, labels).count() == 0
    assert perplexity.keep_good(docs, labels).columns == docs.columns


def test_op3_trains_on_all_and_scores_by_shards(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    columns = ["doc_id", "lang", "perplexity", "threshold", "kept"]
    key = lambda r: (r.doc_id, r.lang or "")
    twice = docs.unionByName(docs.where("doc_id < 3"))
    grams = perplexity.train_on(twice, labels, []).count()
    assert grams > 1000
    whole = sorted(perplexity.scored(twice, labels).select(columns).collect(), key=key)
    # a model beyond the bound is read in shards, and loses nothing
    parts = sorted(perplexity.scored(twice, labels, max_grams=grams // 3).select(columns).collect(), key=key)
    assert len(whole) == len(parts) == twice.count()
    for a, b in zip(whole, parts, strict=True):
        assert (a.doc_id, a.lang, a.kept) == (b.doc_id, b.lang, b.kept)
        assert a.perplexity == (b.perplexity and pytest.approx(b.perplexity)) and a.threshold == pytest.approx(b.threshold)


def test_op3_model_and_threshold_go_together(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 40), "en", "s", 0) for i in range(120)]
    # a thin language: enough documents in the half for training, too few held out, or the other way round
    odd = [r.doc_id for r in spark.range(1000, 1400).toDF("doc_id").where(perplexity.held_out()).collect()]
    even = [i for i in range(1000, 1400) if i not in odd]
    for lang, ids in (("xx", even[:40] + odd[:9]), ("yy", odd[20:60] + even[40:49])):
        rows += [(i, prose(rng, 40, 30), lang, "s", 0) for i in ids]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    assert perplexity.own_languages(df, labels) == ["en"]
    model = perplexity.train_on(df, labels, ["en"])
    assert {r.lang for r in model.select("lang").distinct().collect()} == {"en", perplexity.ALL}
    scorers = {k: ByHand(model, k) for k in ("en", perplexity.ALL)}
    got = perplexity.scored(df, labels).collect()
    assert len({r.threshold for r in got if r.lang != "en"}) == 1
    texts = {r[0]: [w.decode() for w in words(r[1])] for r in rows}
    for r in got:
        assert r.perplexity == pytest.approx(scorers["en" if r.lang == "en" else perplexity.ALL].perplexity(texts[r.doc_id]))
    held = [r.doc_id for r in df.where(perplexity.held_out()).collect()]
    most = max(scorers[perplexity.ALL].perplexity(texts[i]) for i in held)
    assert next(r.threshold for r in got if r.lang != "en") == pytest.approx(most * perplexity.MARGIN)


def test_kneser_ney_by_brute_force(spark):
    seen = {"abab": 3, "abc": 2, "b": 5, "cab": 1, "aab": 1}
    df = spark.createDataFrame([("en", w, n) for w, n in seen.items()], "lang string, word string, n long")
    got = {r.gram: (r.p, r.backoff) for r in perplexity.train(df, order=3).collect()}
    top = Counter()
    for w, n in seen.items():
        p = "\x02" + w + "\x03"
        for i in range(1, len(p)):
            top[p[max(0, i - 2) : i + 1]] += n
    counts = {3: {g: c for g, c in top.items() if len(g) == 3}}
    for k in (2, 1):
        lower = Counter(g[1:] for g in counts[k + 1])
        for g, c in top.items():
            if len(g) == k:
                lower[g] += c
        counts[k] = dict(lower)
    prob = {}
    for k in (1, 2, 3):
        t = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        d = {i: min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.05), i - 0.05) if t[i] else {1: 0.5, 2: 0.75, 3: 0.9}[i] for i in (1, 2, 3)}
        for g, c in counts[k].items():
            same = {h: x for h, x in counts[k].items() if h[:-1] == g[:-1]}
            total, mass = sum(same.values()), sum(d[min(x, 3)] for x in same.values())
            low = prob[g[1:]] if k > 1 else 1 / (len(same) + 1)
            prob[g] = (c - d[min(c, 3)]) / total + mass / total * low
            assert got[g][0] == pytest.approx(prob[g]), (k, g)
            if k > 1:
                assert got[g[:-1]][1] == pytest.approx(mass / total)


def test_op4(spark, nothing):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<\\|im_end|>", "[INST]", "</s>", "<", "\\", "|im_start|>", "<<SYS>>", "hi\n", "é", "[", "/INST]", "%0A", "%"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "to\nol%", "<|im_end|>"]), rng.choice([None, "", *["".join(rng.choices(bits, k=rng.randrange(7))) for _ in range(6)]])) for c in [*range(40), None] for t in range(rng.randrange(1, 6))]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("t", F.lit(2))
    done = chat.format_turns(chat.table_turns(df))
    got = {r.conv_id: r for r in chat.digests(done).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = chat.formatted(done).first().formatted
    assert text.count(chat.START) == text.count(chat.END)
    assert chat.digests(chat.format_turns(chat.table_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    with pytest.raises(ValueError):
        chat.table_turns(nothing)


def test_chat_layouts(spark):
    rows = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}', "messages", [("user", "hi"), ("assistant", "")]),
        ('{"instruction":"do","input":"x","output":"y"}', "alpaca", [("user", "do\nx"), ("assistant", "y")]),
        ('{"output":"y","instruction":"do"}', "alpaca", [("user", "do"), ("assistant", "y")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"system":"s"}', "sharegpt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"prompt":"p","completion":"c","extra":5}', "prompt", [("user", "p"), ("assistant", "c")]),
        ('{"zzz":1}', None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, j string")
    for r in chat.record_turns(df, "j").collect():
        assert r.layout == rows[r.i][1] and (r.turns and [tuple(t) for t in r.turns]) == rows[r.i][2]


def test_op5(spark, docs, fixture, nothing):
    got = {r.doc_id: r for r in digest.fingerprints(docs).collect()}
    order = sorted(fixture, reverse=True, key=lambda r: r[0])
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        e, r = digest.edited(a[1] or "", b[1] or ""), got[a[0]]
        assert (r.n_chars, r.edited_sha256) == (len(a[1] or ""), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest.fingerprint(a[1]), digest.fingerprint(e))
        assert r.near_next == digest.likeness(digest.parsed(r.fingerprint), digest.parsed(got[b[0]].fingerprint))
        assert 0 <= r.near_edited <= 1
    assert digest.fingerprints(nothing).count() == 0
    one = spark.createDataFrame(fixture[:1], DOCS)
    assert digest.fingerprints(one).first().near_next == 1.0


def test_entropy_sums_and_blocks(monkeypatch):
    rng = random.Random(6)
    data = "".join(rng.choices("abcde fgh", k=5000)).encode()
    x = np.frombuffer(data, np.uint8)
    want = [sum(int(digest._F[c]) for c in Counter(data[i : i + 32]).values()) for i in range(len(data) - 31)]
    assert digest.entropy_sums(x).tolist() == want
    whole = digest.feature_hashes([data])[0]
    monkeypatch.setattr(digest, "CHUNK", 700)
    assert (digest.feature_hashes([data])[0] == whole).all()
    half = digest.digest(digest.feature_hashes([data[:2500] + bytes(rng.choices(b"xyzuvw rst", k=2500))])[0])
    assert 0.3 < digest.likeness(digest.digest(whole), half) < 0.75
    assert digest.likeness(digest.digest(whole), digest.digest(whole)) == 1


def test_op6(spark, docs, fixture, nothing):
    path = public_path("piece_bpe_32k.model")
    extra = [(1000, ("a b c d e f g h i\n" * 12), "en", "s", 0), (1001, "x#y *z\nl1 w\nl1 w\n\n\n" + prose(random.Random(1), 30), "en", "s", 0)]
    got = {r.doc_id: r for r in fertility.quality_rules(docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, DOCS)), path).collect()}
    for i, text, *_ in fixture + extra:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        repeat = len({j + k for j, g in enumerate(grams) if g in twice for k in range(8)})
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w)) and not (r.base_failed and r.kept)
    assert fertility.quality_rules(nothing, path).count() == 0


def test_script_of_the_whole_text():
    assert fertility.script("licence text " * 300 + "слово " * 2000) == "script CYRILLIC"
    assert fertility.script("1 2 3") == fertility.script("") == "script none"


def entropy_spans(text, base):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        if any(b[0] < m.end() and m.start() < b[2] for b in base) or any(re.search(p, m[0]) for p in secrets.ALLOWED):
            continue
        kind = next(secrets.KINDS.index(k) for k, (cls, _) in secrets.CLASSES.items() if re.search(cls, m[0]))
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(m[0][i : i + 20]).values()) for i in range(len(m[0]) - 19))
        if best >= secrets.CLASSES[secrets.KINDS[kind]][1] - 1e-6:
            out.append((m.start(), kind, m.end()))
    return out


def test_op7(spark, nothing):
    rng = random.Random(7)
    alphabet = "abcdefABCDEF0123456789xyzKQ"
    parts = ["password: ", "Token='", "api_key = \"", "APIKEY:", "secret=", "AKIA", " ", "\n", "é\U0001f642 ", "token: token: ", "a-long-hyphenated-lower-case-word", "0123456789" * 3, "'"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice([*parts, "".join(rng.choices(alphabet, k=rng.randrange(1, 45))), "".join(rng.choices("0123456789abcdef", k=rng.randrange(18, 44))), "".join(rng.choices("ABCDEFGHIJ0123456789", k=18))]) for _ in range(rng.randrange(12)))
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "".join(rng.choices(alphabet, k=900))), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in secrets.scan_secrets(df).collect():
        got[r.doc_id] = r
    for i, text in rows:
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
        show = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest()
        assert r.spans == show(base + entropy_spans(text, base))
    wide = df.withColumns({c: F.lit("x") for c in ("base", "added", "lang")})
    red = {r.doc_id: r for r in secrets.redact_secrets(wide).collect()}
    assert secrets.redact_secrets(wide).columns == wide.columns and red[200].text is None
    assert all(not got[i].spans or "[SECRET]" in red[i].text for i, _ in rows)
    for i, text in rows:
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in got[i].spans.split(",") if x)
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += (text or "")[at:s] + "[SECRET]"
            at = max(at, e)
        assert red[i].text == (None if text is None else out + text[at:])
    assert secrets.scan_secrets(nothing).count() == 0


def test_op7_long_texts(spark):
    """A text of 1 MB with tens of thousands of matches takes a time in proportion to its length."""
    import time

    rng = random.Random(8)
    one = "\U0001f642 token: abcdef12 " + "".join(rng.choices("0123456789abcdef", k=24)) + "\n"
    n = 1_200_000 // len(one)
    df = spark.createDataFrame([(1, one * n)], "doc_id long, text string")
    began = time.monotonic()
    r = secrets.scan_secrets(df).first()
    took = time.monotonic() - began
    assert (r.n_assign, r.n_hex) == (n, n)
    at = one.index("token")
    assert r.spans.split(",")[-2] == f"assign:{(n - 1) * len(one) + at}:{(n - 1) * len(one) + at + len('token: abcdef12')}"
    assert took < 60
    began = time.monotonic()
    out = secrets.redact_secrets(df).first().text
    assert out == one.replace("token: abcdef12", "[SECRET]").replace(one[one.index("12 ") + 3 : -1], "[SECRET]") * n
    assert time.monotonic() - began < 60


def check_packing(pieces, ids, capacity):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        assert ps[0].start == 0 and all(a.start + a.length == b.start for a, b in pairwise(ps)) and ps[-1].start + ps[-1].length == len(ids[d])
    padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert ps[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(ps))
        n = sum(p.length for p in ps)
        assert n <= capacity
        padding += capacity - n if n & (n - 1) else 0
    return padding


def test_op8(spark, docs, fixture, nothing):
    path = public_path("word_bpe_49k.json")
    e = encoder(path, "word")
    ids = {i: np.append(e.encode(t), np.uint32(2)).astype("<u4") for i, t, *_ in fixture}
    pieces = packing.pack_documents(docs, path, capacity=256).collect()
    assert {p.doc_id for p in pieces} == set(ids) and check_packing(pieces, ids, 256) == 0
    assert packing.pack_documents(nothing, path).count() == 0


def test_packing_returns_ids_and_masks(spark, docs, fixture):
    path = public_path("word_bpe_49k.json")
    e, rng = encoder(path, "word"), random.Random(14)
    rows = [(i, [(prose(rng, rng.randrange(1, 60)), bool(rng.randrange(2))) for _ in range(rng.randrange(4))]) for i in range(80)] + [(80, None), (81, [(None, False)])]
    df = spark.createDataFrame(rows, "doc_id long, turns array<struct<text string, loss boolean>>")
    pieces = packing.pack_documents(df, path, capacity=256, max_loss=100, segments="turns").collect()
    found, loss = {}, Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids, mask = found.setdefault(p.doc_id, ([], []))
        ids += np.frombuffer(p.ids, "<u4").tolist()
        mask += list(p.loss_mask)
        assert (p.length, p.loss_tokens) == (len(p.loss_mask), sum(p.loss_mask))
        loss[p.sequence_id] += p.loss_tokens
    assert max(loss.values()) <= 100
    for i, turns in rows:
        ids, mask = [], []
        for text, bears in turns or []:
            part = e.encode(text).tolist()
            ids += part
            mask += [int(bears)] * len(part)
        assert found[i] == ([*ids, 2], [*mask, int(turns[-1][1]) if turns else 1])
    whole = packing.pack_documents(docs, path, capacity=256).where("doc_id = 5").orderBy("start").collect()
    assert np.frombuffer(b"".join(p.ids for p in whole), "<u4").tolist() == [*e.encode(fixture[5][1]).tolist(), 2]


def test_packing_keeps_every_limit():
    rng = np.random.default_rng(3)
    examples = [(i, np.arange(n, dtype=np.uint32), rng.random(n) < 0.4) for i, n in enumerate(rng.integers(1, 300, 400))]
    seen = Counter()
    for seq in packing.pack_stream(iter(examples), (128, 6, 40), pool_tokens=3000):
        assert len(seq) <= 6 and sum(x.hi - x.lo for x in seq) <= 128 and sum(x.needs[1] for x in seq) <= 40
        for x in seq:
            seen.update((x.doc, k) for k in range(x.lo, x.hi))
    assert max(seen.values()) == 1 and len(seen) == sum(len(x[1]) for x in examples)


def test_packing_limits_bind():
    """Each of the three limits alone closes sequences, and little is padded."""
    def sequences(examples, limits):
        out = list(packing.pack_stream(iter(examples), limits, pool_tokens=50_000))
        return out, [(sum(x.hi - x.lo for x in s), len(s), sum(x.needs[1] for x in s)) for s in out]

    tiny = [(i, np.zeros(4, np.uint32), None) for i in range(2000)]
    assert all(n == 64 and k == 16 for n, k, _ in sequences(tiny, (1024, 16, 1024))[1])
    half = [(i, np.zeros(100, np.uint32), np.arange(100) >= 30) for i in range(2000)]
    at_loss = sequences(half, (1024, 99, 520))[1]
    assert max(x[2] for x in at_loss) <= 520 and sum(x[2] > 515 or x[0] == 512 for x in at_loss) > 0.9 * len(at_loss)
    long = [(i, np.zeros(3000, np.uint32), None) for i in range(50)]
    assert sum(x[0] >= 1014 for x in sequences(long, (1024, 16, 1014))[1]) > 130
    for examples, limits in ((tiny, (1024, 16, 1024)), (half, (1024, 99, 520)), (long, (1024, 16, 1014))):
        for n, k, loss in sequences(examples, limits)[1]:
            assert n <= limits[0] and k <= limits[1] and loss <= limits[2] and (n & (n - 1) == 0 or n >= limits[0] - limits[0] // 100)


def test_op8_query(spark, sf):
    """Over the registered query: pieces tile the texts, the ids are the library's, and every limit is met somewhere."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    pieces = queries.op8_vector_packing(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    padding = check_packing(pieces, ids, 4096)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    loss = [sum(p.loss_tokens for p in x) for x in by_sequence.values()]
    assert max(loss) <= 4064 and max(map(len, by_sequence.values())) <= 16
    assert any(x > 4056 for x in loss) and padding < 0.01 * sum(map(len, ids.values()))
    assert sum(loss) < sum(map(len, ids.values()))


@pytest.mark.parametrize("block", [1000, 7])
def test_op9(spark, docs, fixture, nothing, block):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, block_docs=block).collect()}
    first, texts = {}, {}
    for i, t, *_ in fixture:
        first.setdefault(t or "", i)
        texts[i] = sets(t)
    ids = sorted(first.values())
    links, up = Counter(), {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and texts[a] and texts[b] and 9 * len(texts[a] & texts[b]) >= 4 * (len(texts[a]) + len(texts[b])):
                links.update((a, b))
                x, y = sorted((root(a), root(b)))
                up[y] = x
    for i, t, *_ in fixture:
        rep = first[t or ""]
        assert (got[i].copy_of, got[i].n_links, got[i].class_id) == (rep, links[rep], root(rep))
    assert max(links.values()) == 24
    assert neardup.near_duplicates(nothing).count() == 0
    if block == 1000:
        kept = neardup.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({r.class_id for r in got.values()})


def test_forest_depth():
    assert neardup.forest_depth(0.8, 16, 6, 0.9995) == 4
    assert neardup.forest_depth(0.99, 16, 5, 0.9995) == 5
    # enough measured pairs decide by themselves: the prefix is shortened until they share one
    assert neardup.forest_depth(0.8, 16, 6, 0.99, {6: 990, 3: 10}) == 6
    assert neardup.forest_depth(0.8, 16, 6, 0.999, {6: 990, 3: 10}) == 3
    assert neardup.forest_depth(0.8, 16, 6, 0.9995, {6: 100}) == 4


def near_pairs(rng, n, low, high):
    """(text, text, index): pairs whose Jaccard index of 5-word shingles lies in [low, high)."""
    out = []
    while len(out) < n:
        found = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 240))]
        other = list(found)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        a, b = sets(" ".join(found)), sets(" ".join(other))
        index = len(a & b) / len(a | b)
        if low <= index < high:
            out.append((" ".join(found), " ".join(other), index))
    return out


def test_op9_measures_recall_and_keeps_links_at_the_border(spark):
    """Of 600 planted pairs at 0.80 to 0.85 nearly all are found, and the sampled depths are those of the sequences."""
    rng = random.Random(99)
    pairs = near_pairs(rng, 600, 0.80, 0.85)
    rows = [x for i, (a, b, _) in enumerate(pairs) for x in ((2 * i, a), (2 * i + 1, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    recall = sum(got[2 * i] == got[2 * i + 1] for i in range(600)) / 600
    print("recall at 0.80 to 0.85:", recall)
    assert recall >= 0.99
    mult = neardup.multipliers(96, 9)
    few = [shingles(a) for a, _, _ in pairs[:50]]
    sample = neardup.Sample(list(range(50)), few, mult, 16, 0.8)
    for i, (_, b, index) in enumerate(pairs[:50]):
        h = shingles(b)
        m = neardup.minhash(h, mult)
        x, y = neardup.minhash(few[i], mult).reshape(16, 6), m.reshape(16, 6)
        best = max(next((k for k in range(6) if x[t, k] != y[t, k]), 6) for t in range(16))
        assert sample.depths(-1, h, m) == [best] and sample.depths(i, h, m) == []
    assert sample.depths(-1, few[0], neardup.minhash(few[0], mult)) == []  # 0.9 and more does not measure


def test_op9_large_groups_by_size_and_wide_blocks(spark, monkeypatch):
    """A group beyond one block is dealt by size; wide blocks are counted in parts; both as brute force."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        own = list(base[: rng.randrange(150, 400)])
        own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(own))
    found = [sets(t) for t in texts]
    links = [sum(i != j and texts[i] != texts[j] and 9 * len(a & b) >= 4 * (len(a) + len(b)) for j, b in enumerate(found)) for i, a in enumerate(found)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(texts)) == 60
    for block in (1000, 4):
        got = {r.doc_id: r.n_links for r in neardup.near_duplicates(df, block_docs=block).collect()}
        assert [got[i] for i in range(60)] == links
    arrays = [shingles(t) for t in texts]
    whole = [(i, j.tolist()) for i, j in neardup.linked_pairs(arrays, 0, 4, 5)]
    split = [(i, j.tolist()) for i, j in neardup.linked_pairs(arrays, 20, 4, 5)]
    monkeypatch.setattr(neardup, "MATRIX", 1)
    assert whole == [(i, j.tolist()) for i, j in neardup.linked_pairs(arrays, 0, 4, 5)]
    assert split == [(i, j.tolist()) for i, j in neardup.linked_pairs(arrays, 20, 4, 5)]
    assert Counter(x for i, j in whole for x in [i] * len(j) + j) == Counter({i: n for i, n in enumerate(links) if n})


def test_op10(spark, docs, fixture, nothing):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas())
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect())
    assert got == sorted(con.sql(mixing.mix_sql()).fetchall())
    sizes, taken, target = Counter(), Counter(), {}
    for d, n, s, t, k in got:
        assert k <= 3 * n and t <= 3 * s + 1e-9
        sizes[fixture[d][3]] += n
        taken[fixture[d][3]] += k
        target[fixture[d][3]] = t
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(len(words(x[1])) for x in fixture if x[3] == s)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mix(nothing).count() == 0


def test_op10_repeated_rows_null_ids_and_ties(spark):
    """Rows alike share their copies; the sums over all offsets are the expected copies; clashing names are kept."""
    rows = [(None, "a b c", "s", 1)] * 7 + [(1, "a b c", "s", 2)] * 3 + [(2, "x y z", "s", 3), (3, "x", "t", 4), (4, None, None, 5), (4, "", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").withColumns({c: F.col("n") for c in ("row", "total", "size", "copies", "__n", "__id")})
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 7
    per = {r.source: r.target / r.source_size for r in got if r.source_size}
    for r in got:
        assert r.copies in (int(per.get(r.source, 0)), int(per.get(r.source, 0)) + 1) and r.taken == r.copies * r.size
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert all(r["__n"] == r.n == r["row"] == r.total for r in out.collect())


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 300, "d": 2, "e": 90, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = [*sorted(k for k in sizes if k), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, rest = {}, set(names), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * sizes[s]
            rest -= want[s]
            free.discard(s)
    assert got == pytest.approx(want)


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]


def test_pipeline_stages_keep_columns(spark, docs, nothing):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for f in (neardup.keep_one, secrets.redact_secrets, mixing.mixed_documents):
        assert f(plain).columns == plain.columns
        assert f(nothing).count() == 0
