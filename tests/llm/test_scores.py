"""Classifiers, language models and rules."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import blocks, charlm, langid, quality_model, quality_rules, toxicity
from tidemill.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = [False] * len(w)
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            rep[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(rep)


def test_base_counts(texts):
    assert quality_rules.base_counts(["a | 5 -- é |"])[5].tolist() == [3]
    all_ = [*texts, "a b c d e a b c d e f", "x\n x\nx\n\nx", "#1 $2 | <a>", "a b c d", "e a b c d e", "x\x0b\x0cy\r\n\x1f z", "", None]
    got = quality_rules.base_counts(all_)
    assert list(zip(*(x.tolist() for x in got[:5]), strict=True)) == [plain_base(t) for t in all_]
    for t in all_[-9:]:  # alone as among others
        assert [int(x[0]) for x in quality_rules.base_counts([t])[:5]] == list(plain_base(t))


def plain_kn(texts, order):
    """log p of each character, by the definition of interpolated modified Kneser-Ney."""
    top = Counter()
    for t in texts:
        s = charlm._START * (order - 1) + t
        top.update(s[i : i + order] for i in range(len(t)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc, tot, left = {}, {}, {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] else None
        disc[n] = [max(0.05, min(i, i - (i + 1) * y * m[i + 1] / m[i])) for i in (1, 2, 3)] if y is not None and m[3] and m[4] else [0.5, 1, 1.5]
        tot[n], left[n] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            tot[n][g[:-1]] += v
            left[n][g[:-1]] += disc[n][min(v, 3) - 1]
    v = len(counts[1]) + 1

    def p(g):
        out = 1 / v
        for n in range(1, order + 1):
            x = g[order - n :]
            if tot[n].get(x[:-1]):
                c = counts[n].get(x, 0)
                out = (c - (disc[n][min(c, 3) - 1] if c else 0)) / tot[n][x[:-1]] + left[n][x[:-1]] / tot[n][x[:-1]] * out
        return out

    return lambda t: sum(math.log(p((charlm._START * (order - 1) + t)[i : i + order])) for i in range(len(t)))


@pytest.mark.parametrize("size", [blocks.BLOCK, 3000])
def test_kneser_ney(spark, texts, monkeypatch, size):
    """Bits of every text, by the definition, in one block or many and over several ranges of keys."""
    monkeypatch.setattr(blocks, "RANGE", 500)
    monkeypatch.setattr(blocks.stored, "__defaults__", (size, blocks.body_of, None))
    some = [(t, "en") for t in texts[:30]] + [(t, None) for t in texts[30:60]] + [("", "en"), (None, None), (texts[0], "en")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(some)], "doc_id bigint, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["bits"] for r in quality_rules.scored(df, order=4).collect()}
    for lang in ("en", None):
        want = plain_kn([t or "" for t, g in some if g == lang], 4)
        for i, (t, g) in enumerate(some):
            if g == lang:
                words = sum(any(ord(c) > 127 or c.isalnum() for c in w) for w in WORD.findall(t or ""))
                assert got[i] == pytest.approx(-want(t or "") / math.log(2) / max(1, words), rel=1e-4, abs=1e-4)


def test_lookup_of_blocks(spark):
    """Keys without an entry get 0, keys that share their first bits are told apart."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 3000, np.int64).view(np.uint64), np.arange(100, dtype=np.uint64), ~np.arange(100, dtype=np.uint64)]))
    known = dict(zip(keys[::2].tolist(), r.random(len(keys)).astype(np.float32).tolist(), strict=False))
    model = spark.createDataFrame([(int(np.uint64(k).astype(np.int64)), v) for k, v in known.items()], "key bigint, value float")
    table = spark.createDataFrame([(i, bytearray(keys[i::7].tobytes())) for i in range(7)] + [(9, bytearray())], "block bigint, body binary")

    def use(body, k, v):
        assert np.array_equal(k, np.sort(np.frombuffer(body, np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(blocks.Values(k, v).of(k))], ["key", "value"])

    got = {int(np.int64(x["key"]).astype(np.uint64)): x["value"] for x in blocks.answered(blocks.Blocks(table, 5), lambda b: np.sort(np.frombuffer(b, np.uint64)), model, use, "key bigint, value float").collect()}
    assert set(got) == set(keys.tolist()) and all(got[k] == pytest.approx(known.get(k, 0.0)) for k in got)
    assert blocks.answered(blocks.Blocks(table, 5), lambda b: np.sort(np.frombuffer(b, np.uint64)), model.limit(0), use, "key bigint, value float").where("value != 0").isEmpty()


def test_counter_overflow(texts):
    some = [t for t in texts if t]
    c = charlm.Counter(3, bits=4)
    for t in some:
        c.add([t], ["x"])
    got = Counter()
    for groups, grams, n in c.batches():
        for g, k in zip(grams, n, strict=True):
            got[g] += int(k)
        assert set(groups) == {"x"}
    want = Counter()
    for t in some:
        s = charlm._START * 2 + t
        want.update(s[i : i + 3] for i in range(len(t)))
    assert got == want


def test_quality_rules(docs, odd, none, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.scored(docs)).collect()}
    for i, t in enumerate(texts):
        w, chars, marks, dup, rep = plain_base(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (w, chars, marks, dup, rep)
        assert r["base_failed"] == (w < 10 or 100 * rep > 20 * w) and not (r["base_failed"] and r["kept"])
    plain = [i for i in range(60) if not got[i]["base_failed"]]
    assert all(got[i]["kept"] for i in plain)
    assert quality_rules.judge(quality_rules.scored(none)).count() == 0
    assert quality_rules.judge(quality_rules.scored(odd)).count() == 2 * len(texts) + 3


def test_bands_reject_marks(spark):
    r = random.Random(2)
    part = "the of and to in is that for it was ed ing tion er est ly ble".split()
    plain = [" ".join("".join(r.choice(part) for _ in range(r.randint(1, 3))) for _ in range(r.randint(30, 200))) for _ in range(300)]
    junk = " ".join(w + r.choice(["%&#", "$$*|", "#@!&"]) + str(i * 7919 % 9973) for i, w in enumerate(plain[0].split()))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, junk])], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(quality_rules.scored(df)).collect()}
    assert not got.pop(300) and all(got.values())


def test_language_filters(docs, none, texts):
    f = langid.fit(docs.where("doc_id < 60 and text is not null").withColumn("lang", F.when(F.col("text").rlike("eau|eux|oi|ée|elle"), "fr").otherwise("en")), "text", "lang")
    assert f.langs == ["en", "fr"] and all(0 < x < 0.01 for x in f.false)
    got = {r["doc_id"]: r for r in langid.predict(docs, f).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i, t in enumerate(texts) if not any(c.isalpha() for c in t or ""))
    assert all(got[i]["lang_pred"] in ("en", "fr") and 0 <= got[i]["score"] <= 1 for i, t in enumerate(texts) if any(c.isalpha() for c in t or ""))
    key, _ = langid.ngrams([texts[0]])
    single = langid.Filters({"x": key[:1], "y": key}, bits=12)
    for k in key:
        m = single.masks(np.array([k]))[0][0]
        assert m & 2  # no false negatives
    total, share = single.shares(*langid.ngrams([texts[0], "1 2 3"]), 2)
    assert total[1] == 0 and share[0, 1] > 0.99
    assert langid.predict(none, f).count() == 0 and langid.predict(docs, langid.fit(none, "text", "lang")).where("lang_pred != 'und'").isEmpty()


def test_language_of_one_short_text(spark):
    rows = spark.createDataFrame([("the cat sat on the mat with the other cats", "en"), ("żółw", "pl")], "text string, lang string")
    f = langid.fit(rows, "text", "lang")
    assert f.langs == ["en", "pl"]
    got = langid.predict(spark.createDataFrame([(1, "żółw"), (2, "the cat")], "doc_id bigint, text string"), f).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "pl", 2: "en"}


def test_many_languages():
    r = np.random.default_rng(0)
    grams = {f"l{i:02d}": r.integers(0, 1 << 62, 50).astype(np.uint64) for i in range(20)}
    f = langid.Filters(grams)
    _, share = f.shares(grams["l17"], np.zeros(50, np.int64), 1)
    assert f.langs[share[0].argmax()] == "l17" and len(f.slices) == 3


def test_attention_learns():
    r = np.random.default_rng(3)
    good = [" ".join(r.choice(["the", "house", "green", "walks", "tree", "of"], 150)) for _ in range(60)]
    bad = [" ".join(r.choice(["the", "house", "green", "walks", "tree", "of"], 90)) + " " + "### $$$ " * 32 for _ in range(60)]
    m = quality_model.fit(good + bad, np.array([1] * 60 + [0] * 60))
    h = WordHashes()
    bags = [quality_model.passages(t, h) for t in (good[0], bad[0], None, "")]
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    s = m.score(np.concatenate(bags).astype(float), starts)
    assert s[0] > 0.9 > 0.1 > s[1] and len(bags[2]) == len(bags[3]) == 1 and np.isfinite(s).all()
    _, a, _ = m.forward(np.concatenate(bags).astype(float), starts)
    assert np.add.reduceat(a, starts) == pytest.approx(1)
    assert quality_model.fit(["a"], np.array([1])).constant == 1.0 and quality_model.fit([], np.zeros(0)).constant == 1.0


def test_forward_by_definition():
    """Scores and weights of bags, passage by passage."""
    r = np.random.default_rng(6)
    m = quality_model.Model(4)
    m.mean, m.scale = r.normal(size=4), r.random(4) + 0.5
    bags = [r.normal(size=(n, 4)) * 3 for n in (1, 3, 2)]
    score, a, _ = m.forward(np.concatenate(bags), np.array([0, 1, 4]))
    at = 0
    for bag, got in zip(bags, score, strict=True):
        hs, es = [], []
        for x in bag:
            z = [min(6, max(-6, (v - mu) / s)) for v, mu, s in zip(x, m.mean, m.scale, strict=True)]
            h = [math.tanh(sum(z[i] * m.p["W"][i, j] for i in range(4)) + m.p["b"][j]) for j in range(len(m.p["b"]))]
            t = [math.tanh(sum(h[j] * m.p["V"][j, g] for j in range(len(h)))) / (1 + math.exp(-sum(h[j] * m.p["U"][j, g] for j in range(len(h))))) for g in range(len(m.p["w"]))]
            hs.append(h)
            es.append(math.exp(sum(x * y for x, y in zip(t, m.p["w"], strict=True))))
        weights = [e / sum(es) for e in es]
        logit = sum(w * sum(x * y for x, y in zip(h, m.p["c"], strict=True)) for w, h in zip(weights, hs, strict=True)) + m.p["c0"][0]
        assert got == pytest.approx(1 / (1 + math.exp(-logit))) and a[at : at + len(bag)] == pytest.approx(weights)
        at += len(bag)


def test_passages_stand_alone():
    """A passage's numbers don't depend on the rest of its document."""
    h = WordHashes()
    r = random.Random(8)
    ws = [r.choice(["the", "house", "Green!", "walks", "of", "x1", "##"]) for _ in range(5 * quality_model.PASSAGE + 9)]
    whole = quality_model.passages(" ".join(ws), h)
    parts = [" ".join(ws[i : i + quality_model.PASSAGE]) for i in range(0, len(ws), quality_model.PASSAGE)]
    assert len(whole) == len(parts) == 6 and whole.shape[1] == quality_model.WIDTH
    for got, part in zip(whole, parts, strict=True):
        alone = quality_model.passages(part, h)[0]
        # the space that ends a passage counts as its own
        assert got[quality_model.CLASSES :] == pytest.approx(alone[quality_model.CLASSES :], abs=1e-6) and got[: quality_model.CLASSES] == pytest.approx(alone[: quality_model.CLASSES], abs=0.01)
    assert len(quality_model.spread(whole, 3)) == 3 and np.array_equal(quality_model.spread(whole, 3)[[0, 2]], whole[[0, 5]])


def test_quality_of_odd_rows(spark, docs, odd, none, tmp_path):
    m = quality_model.fit(["good text here"] * 3 + ["### $$$ ###"] * 3, np.array([1, 1, 1, 0, 0, 0]))
    rows = quality_model.score(odd, m).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["passages"], r["top_passage"], r["top_weight"]))
    assert len(rows) == odd.count() and all(len(x) == 1 for i, x in by.items() if i is not None) and quality_model.score(none, m).count() == 0
    constant = quality_model.score(docs, quality_model.fit([], np.zeros(0))).collect()
    assert all(r["score"] == 1.0 and r["top_passage"] == 0 and r["top_weight"] == pytest.approx(1 / r["passages"]) for r in constant)
    clash = docs.withColumnRenamed("doc_id", "a.b").withColumn("score", F.lit("x"))
    got = quality_model.score(clash, m, ("a.b",))
    assert got.columns[0] == "a.b" and got.count() == docs.count()


@pytest.mark.parametrize("name", ["op2_quality_model", "op9_toxicity", "op4_language_id", "op10_quality_rules"])
@pytest.mark.parametrize("labelled", ["none", "one class", "odd"])
def test_queries_of_odd_tables(spark, odd, none, tmp_path, name, labelled):
    """Repeated and null ids, null, empty and long texts; no labels, labels of one class, repeated and null labels; then empty tables."""
    from tidemill.llm.queries import QUERIES

    if name in ("op4_language_id", "op10_quality_rules") and labelled != "odd":
        return
    rows = {"none": [], "one class": [(i, 1, 1) for i in range(40)], "odd": [(i, i % 2, i % 3 == 0) for i in range(60)] + [(3, 1, 1), (None, 1, 1), (4, None, None), (999, 0, 1)]}[labelled]
    d = str(tmp_path)
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = QUERIES[name](spark, d)
    got = out.collect()
    assert len(got) == odd.count()
    if "score" in out.columns:
        assert all(0 <= r["score"] <= 1 for r in got)
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/empty/labels.parquet")
    assert QUERIES[name](spark, f"{d}/empty").count() == 0


def test_languages_by_sets(spark, texts):
    """Predictions and shares with sets in place of filters."""
    lang = lambda i: ["en", "fr", "xx"][i % 7 % 3]
    learn = [(t, lang(i)) for i, t in enumerate(texts[:60]) if t]
    f = langid.fit(spark.createDataFrame(learn, "text string, lang string").repartition(3), "text", "lang", 1e-3)
    uses = defaultdict(Counter)

    def grams(t):
        c = [ch.lower()[0] if ch.isalpha() else " " for ch in "  " + t + " "]
        return [tuple(c[i - 2 : i + 2]) for i in range(2, len(c) - 1) if c[i] != " "]

    for t, g in learn:
        uses[g].update(grams(t))
    sets = {g: {x for x, n in c.items() if n >= max(1.0, 1e-3 * sum(c.values()))} for g, c in uses.items()}
    assert f.langs == sorted(sets) and len({len(x) for x in sets.values()}) > 1
    asked = [t for t in texts if t][:90]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), f).collect()}
    for i, t in enumerate(asked):
        g = grams(t)
        if not g:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        share = {x: sum(k in sets[x] for k in g) / len(g) for x in f.langs}
        best = max(f.langs, key=lambda x: share[x])
        assert got[i]["lang_pred"] == best or abs(share[got[i]["lang_pred"]] - share[best]) < 0.01
        assert got[i]["score"] == pytest.approx(share[best] / max(1e-12, sum(share.values())), abs=0.02)


def test_gradient():
    r = np.random.default_rng(4)
    m = quality_model.Model(5)
    x, starts, y = r.normal(size=(7, 5)), np.array([0, 2, 3]), np.array([1.0, 0, 1])
    each = np.full(3, 1 / 3)

    def loss():
        s = m.forward(x, starts)[0]
        return -(each * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    for name, g in m._gradient(x, starts, y, each).items():
        flat = m.p[name].reshape(-1)
        for i in (0, len(flat) - 1):
            flat[i] += 1e-6
            up = loss()
            flat[i] -= 2e-6
            down = loss()
            flat[i] += 1e-6
            assert np.asarray(g).reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def plain_ratio(train, order, shared_order):
    """Log ratio of the classes for a word, by the definition; train: (text, class)."""
    words = {0: Counter(), 1: Counter()}
    for t, y in train:
        words[y].update({w for w in toxicity.tokens(t) if w})
    spelled = lambda w: [(charlm._START * (order - 1) + w + " ")[i : i + order] for i in range(len(w) + 1)]
    grams = {y: Counter() for y in words}
    for y, c in words.items():
        for w, n in c.items():
            for g in spelled(w):
                grams[y][g] += n
    pooled = Counter(g[order - shared_order :] for g in {*grams[0], *grams[1]})

    def smoothed(counts):
        m = Counter(counts.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] and m[3] and m[4] else None
        d = [max(0.05, min(i, i - (i + 1) * y * m[i + 1] / m[i])) for i in (1, 2, 3)] if y is not None else [0.5, 1, 1.5]
        total, left = Counter(), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]

        def p(g, low):
            if not total[g[:-1]]:
                return low
            c = counts.get(g, 0)
            return ((c - d[min(c, 3) - 1] if c else 0) + left[g[:-1]] * low) / total[g[:-1]]

        return p

    levels = {shared_order: pooled}
    for n in range(shared_order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    shared, own = {n: smoothed(c) for n, c in levels.items()}, {y: smoothed(c) for y, c in grams.items()}

    def ratio(w):
        out = 0.0
        for g in spelled(w):
            low = 1 / (len(levels[1]) + 1)
            for n in range(1, shared_order + 1):
                low = shared[n](g[order - n :], low)
            out += math.log(own[1](g, low) / own[0](g, low))
        return out

    return ratio


def test_class_models(spark, texts):
    """Figures of texts, by the definition of class-conditional Kneser-Ney models with shared backoff; words of one text count too."""
    r = random.Random(1)
    train = [(t + (" vile scoundrels" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(texts[:45])] + [("once onlyhere", 1), (None, 0), ("", 1)]
    df = spark.createDataFrame([(t, y) for t, y in train], "text string, toxic int")
    model = toxicity.class_model(toxicity.word_counts(df), 6, 3)
    asked = [texts[50], texts[51] + " VILE!", "a scoundrel", "never seen wordzz", "onlyhere", None, "", "---", "vile " * 30 + " ".join(r.choice(texts[52].split()) for _ in range(50))]
    got = {x["doc_id"]: x for x in toxicity.figures(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string").repartition(3), model, order=6).collect()}
    ratio = plain_ratio([(t or "", y) for t, y in train], 6, 3)
    for i, t in enumerate(asked):
        ws = toxicity.tokens(t)
        v = [ratio(w) if w else 0.0 for w in ws]
        top = sorted({w: x for w, x in zip(ws, v, strict=True)}.values(), reverse=True)
        want = [sum(v) / max(len(v), 8), *(sum(top[:k]) / k for k in toxicity.TOP)]
        assert [got[i][k] for k in toxicity.FIGURES] == pytest.approx(want, rel=1e-3, abs=2e-4)


def test_numbers_of_words(texts):
    all_ = [*texts, "A-b " + "q" * 95 + " .x. " + "!" * 50 + "y" * 41 + "!!", "a", "--- a", None, "q" * 95]
    n = toxicity.Numbers()
    got = [x for i in range(0, len(all_), 7) for x in n.of(all_[i : i + 7])]
    words = list(n.words)
    assert [[words[i] for i in x.tolist()] for x in got] == [toxicity.tokens(t) for t in all_] and n.of([]) == []


def test_toxicity(spark, docs, odd, none):
    rows = [(i, f"{'you vile scoundrel' if i % 4 == 0 else 'a fine day'} and {'the house by the river ' * (i % 3 + 1)}", int(i % 4 == 0)) for i in range(200)]
    model = toxicity.class_model(toxicity.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")))
    test = spark.createDataFrame([(0, "oh vile one"), (1, "a fine house"), (2, None), (3, ""), (4, "VILE!"), (5, "the river " * 3000 + "vile"), (None, "vile"), (0, "oh vile one")], "doc_id bigint, text string")
    rows = toxicity.figures(test, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert min(got[i]["top1"] for i in (0, 4, 5, None)) > 1 > 0.5 > got[1]["top1"] and got[2]["mean"] == got[3]["top1"] == 0
    assert len({tuple(r) for r in rows if r["doc_id"] == 0}) == 1 and len(rows) == 8
    assert toxicity.figures(none, model).count() == 0 and toxicity.figures(odd, model).count() == odd.count()
    w = toxicity.logistic(np.r_[np.zeros(50), np.ones(50)][:, None], np.r_[np.zeros(50), np.ones(50)])
    assert w[0] > 0 and w[1] < 0


def test_toxic_documents_are_found(spark):
    """Recall of toxic and share of ordinary documents flagged, of held-out ones; 5 of 97 toxic ones hold no word that marks others."""
    d = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    t = got.selectExpr("sum(predicted * toxic) / sum(toxic)", "sum(predicted * (1 - toxic)) / sum(1 - toxic)").first()
    assert t[0] >= 0.9 and t[1] <= 0.0125


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_model", "quality", 0.97), ("op4_language_id", None, 0.97)])
def test_held_out(spark, name, label, least):
    from tidemill.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, d).where("held_out")
    if label:
        t = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").selectExpr(f"avg(cast(predicted = {label} as int))", "min(score)", "max(score)").first()
    else:
        t = got.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang_pred = lang as int))", "min(score)", "max(score)").first()
    assert t[0] >= least and 0 <= t[1] <= t[2] <= 1
