"""Language ID, toxicity, quality and the language model: held-out accuracy on made texts, odd rows, plain-Python counts."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import langid, quality, recurrent, toxicity
from driftloom.llm.common import learnable

PARTS = {"xx": ["ka", "lo", "mi", "tu", "ra", "sen"], "yy": ["schö", "ber", "gen", "ung", "keit", "ver"], "zz": ["eau", "oi", "ment", "qué", "ré", "ette"]}
INSULTS = ["grobnik", "zwarfel", "plugh"]
ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "12 34 !!"), (9005, "ka" * 60_000)]


def made(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        words = ["".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(12, 60))]
        toxic, good = int(r.random() < 0.35), int(r.random() < 0.7)
        if toxic:
            for _ in range(3):
                w = r.choice(INSULTS)
                if i % 2:
                    w = r.choice([w.replace("o", "0").replace("e", "3"), " ".join(w), w[0] + w[1] * 4 + w[2:]])
                words.insert(r.randrange(len(words)), w)
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, toxic, good, len(" ".join(words))))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = made() + [(i, t, None, None, None, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int, n_chars long").repartition(3).cache()


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_languages_and_rejection(spark, docs):
    model = langid.fit(docs, learnable("doc_id", 4, 2))
    rows = langid.identified(docs, model, prefix="p_").collect()
    out = {r.doc_id: r for r in rows}
    mine = [r for r in rows if r.doc_id < 9000]
    assert np.mean([r.p_lang_pred == r.lang for r in mine if held(r.doc_id, 4, 2)]) > 0.97
    assert not any(r.p_rejected for r in mine)
    assert all(0 <= r.p_score <= 1 for r in rows)
    for i in (9001, 9002, 9003, 9004):
        assert (out[i].p_lang_pred, out[i].p_score, out[i].p_rejected) == ("und", 0.0, True)
    assert out[9005].p_lang_pred == "xx"
    far = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 5), (2, "的一是在不了有和人这中大为上个国我以要他时来用们" * 8)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identified(far, model).collect())
    r = random.Random(9)
    short = spark.createDataFrame([(10_000 + k, "".join(r.choice(PARTS["xx"]) for _ in range(2))[:5], "xx") for k in range(60)], "doc_id long, text string, lang string")
    again = langid.fit(docs.select("doc_id", "text", "lang").unionByName(short), learnable("doc_id", 4, 2))  # very short texts don't widen the radii of long ones
    foreign = spark.createDataFrame([(k, " ".join("".join(r.choice(["zo", "pik", "wub", "ghy", "jox", "fle"]) for _ in range(3)) for _ in range(80))) for k in range(20)], "doc_id long, text string")
    assert all(x.rejected for x in langid.identified(foreign, again).collect())
    assert not any(x.p_rejected for x in langid.identified(docs, again, prefix="p_").where("doc_id < 9000").collect())
    lines = spark.createDataFrame([(1, "\n".join([" ".join(made()[0][1].split()[:6])] * 200))], "doc_id long, text string")
    assert not langid.identified(lines, again).first().rejected  # one line many times over is as poor as that line
    nothing = langid.identified(docs, langid.fit(docs, F.lit(False))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identified(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.identified(docs.withColumn("SCORE", F.lit(1)), model)


def test_toxicity_finds_obfuscated_words(spark, docs):
    score = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), learnable("doc_id", 5, 0))
    out = {r.doc_id: r for r in toxicity.scored(docs, score).collect()}
    test = [r for r in out.values() if r.doc_id < 9000 and held(r.doc_id, 5, 0)]
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and out[9001].score == out[9002].score < 0.5
    none = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(False))
    assert {round(r.score, 6) for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_decoder_restores(docs):
    chars = toxicity.Characters()
    chars.add([t for _, t, *_ in made()])
    d = toxicity.Decoder(toxicity.model(chars.counts))
    for seen, meant in {"gr0bn1k": "grobnik", "z w a r f e l": "zwarfel", "p.l.u.g.h": "plugh", "zwaaaarfel": "zwarfel", "plu-g-h": "plugh", "word": "word"}.items():
        assert d.restore(seen) == meant
    assert d.restore("x" * 1000) and d.restore("1" * 1000)
    assert d.restore("gr0bn1k" * 700) == "grobnik" * 700  # of any length, in one lattice


def test_decoder_equals_all_readings():
    chars = toxicity.Characters()
    chars.add([t for _, t, *_ in made()])
    d = toxicity.Decoder(toxicity.model(chars.counts))
    r = random.Random(4)
    for _ in range(60):
        word = "".join(r.choice("gr0b1k@$ !.aa-o€") for _ in range(r.randrange(1, 7)))
        best, readings = -math.inf, {}
        for reading in itertools.product(*(d.choices(word, i) for i in range(len(word)))):
            text, score = "".join(c for c, _ in reading), sum(x for _, x in reading)
            s = [0, 0, *map(toxicity.symbol, text), 0]
            score += sum(d.lm[a][b][c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
            readings[text], best = max(readings.get(text, -math.inf), score), max(best, score)
        assert math.isclose(readings[d.restore(word)], best, abs_tol=1e-9), word


@pytest.mark.parametrize("form", ["gr0bn1k", "GR0BN1K!!", "gr€bn1k", "g r o b n i k", "g. r. o. b. n. i. k.", "g_r-o.b*n i k", "grooobnik", "(gr0bnik)", "gr0bn1k" * 8, "g\n r0bnik", "6r0bn1k"])
def test_every_form_is_found(form):
    found = toxicity.Suspects().spans(["some text before", f"well {form.lower()} then", ""])
    assert found[0] == found[2] == [] and len(found[1]) == 1


def test_plain_words_and_sign_words():
    spans = toxicity.Suspects().spans
    assert spans(["a plain text, with a word. and (another) one! well - so", "x y"]) == [[], []]
    assert spans(["@$$ 455 12", "к о т ы", "été déjà"]) == [["@$$", "455"], ["к о т ы"], []]


def test_quality_machine(spark, docs):
    machine = quality.fit(docs, docs.select("doc_id", "quality"), learnable("doc_id", 5, 0))
    out = {r.doc_id: r for r in quality.scored(docs, machine).collect()}
    test = [r for r in out.values() if r.doc_id < 9000 and held(r.doc_id, 5, 0)]
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and out[9001].score == out[9002].score
    assert len({r.score for r in quality.scored(docs, quality.fit(docs, docs.select("doc_id", "quality"), F.lit(False))).collect()}) == 1


def test_pairwise_term_equals_all_pairs():
    r = np.random.default_rng(1)
    width = len(quality.STATS)
    m = quality.Machine(0.3, r.normal(size=quality.WORDS + width).astype(np.float32), r.normal(size=(quality.WORDS + width, quality.FACTORS)).astype(np.float32), np.zeros(width, np.float32), np.ones(width, np.float32))
    slots, stats = np.array([5, 900, 17], np.int32), r.normal(size=(1, width)).astype(np.float32)
    x = {s: 1 / math.sqrt(3) for s in slots} | {quality.WORDS + k: float(v) for k, v in enumerate(stats[0])}
    ids = list(x)
    want = 0.3 + sum(m.w[i] * x[i] for i in ids) + sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for n, a in enumerate(ids) for b in ids[n + 1 :])
    assert abs(m.sums(np.array([0, 3]), slots, stats)[0][0] - want) < 1e-3


def test_language_model_counts_and_gain(spark, docs):
    rows = {r._id: r for r in recurrent.likelihoods(docs, learnable("_id", 7, 2)).collect()}
    texts = {i: t for i, t, *_ in made()} | dict(ODD)
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts.items()}
    counts = collections.Counter(w for i, t in tokens.items() if not held(i, 7, 2) for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    test = [r for i, r in rows.items() if held(i, 7, 2) and i < 9000]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert recurrent.likelihoods(docs.limit(0), learnable("_id", 7, 2)).count() == 0
    assert {r.train_tokens for r in recurrent.likelihoods(docs, F.lit(False)).collect()} == {0}


def test_rare_words_go_through_the_join_with_equal_results(spark, docs, monkeypatch):
    before = {r._id: r for r in recurrent.likelihoods(docs, learnable("_id", 7, 2)).collect()}
    monkeypatch.setattr(recurrent, "KNOWN", 60)
    monkeypatch.setattr(recurrent, "SHORT", 20)
    for r in recurrent.likelihoods(docs, learnable("_id", 7, 2)).collect():
        assert (r.n_tokens, r.n_known) == (before[r._id].n_tokens, before[r._id].n_known) and math.isclose(r.base_score, before[r._id].base_score, rel_tol=1e-9)


def test_probabilities_add_up(docs):
    r = np.random.default_rng(3)
    voc = recurrent.Vocabulary(np.arange(100, dtype=np.uint64), r.integers(1, 50, 100), 7, r.integers(0, 90, recurrent.KINDS), r.integers(0, 40, recurrent.KINDS))
    u = recurrent.Unit(voc)
    u.p = {k: r.normal(size=x.shape).astype(np.float32) for k, x in u.p.items()}
    h = np.tile(r.normal(size=recurrent.UNITS).astype(np.float32), (voc.words + recurrent.KINDS, 1))
    assert abs(np.exp(u.log_probability(h, np.arange(voc.words + recurrent.KINDS))).sum() - 1) < 1e-4


def test_logits_out_of_range():
    """Window by window, logits whose exponentials leave the range of floats take another way; both give log-probabilities."""
    r = np.random.default_rng(3)
    voc = recurrent.Vocabulary(np.arange(100, dtype=np.uint64), r.integers(1, 50, 100), 7, r.integers(0, 90, recurrent.KINDS), r.integers(0, 40, recurrent.KINDS))
    u = recurrent.Unit(voc)
    h, every = np.zeros((voc.words + recurrent.KINDS, recurrent.UNITS), np.float32), np.arange(voc.words + recurrent.KINDS)
    assert u.small(h)
    plain = u.log_probability(h, every)
    for shift in (300, -300):
        u.p["cb"][:], u.p["ob"][:] = shift, shift
        assert not u.small(h) and np.allclose(u.log_probability(h, every), plain, atol=1e-4)
        ids, there = r.integers(0, voc.words, (4, 3)), np.ones((4, 3), bool)
        loss, _, grads, _ = u.gradients(ids, ids, ~there, there, np.zeros((3, recurrent.UNITS), np.float32))
        assert math.isclose(loss, -plain[ids].sum(), rel_tol=1e-4) and all(np.isfinite(g).all() for g in grads.values())


def test_a_text_scores_alike_alone_and_among_others():
    r = np.random.default_rng(3)
    voc = recurrent.Vocabulary(np.arange(100, dtype=np.uint64), r.integers(1, 50, 100), 7, r.integers(0, 90, recurrent.KINDS), r.integers(0, 40, recurrent.KINDS))
    u = recurrent.Unit(voc)
    texts = [np.r_[r.integers(0, voc.words + recurrent.KINDS, k), 0].astype(np.int32) for k in (1, 5, 70, 33, 400, 3000)]
    u.train(texts * 5)
    for k in range(0, 3 * recurrent.UNITS, recurrent.UNITS):
        assert np.linalg.norm(u.p["u"][:, k : k + recurrent.UNITS], 2) < recurrent.STRETCH + 1e-3
    both = u.score(texts)
    assert np.allclose(both, [u.score([t])[0] for t in texts], rtol=1e-6, atol=1e-4)
    for t, whole in zip(texts, both, strict=True):  # the sum of the log-probabilities, token by token
        h, total, before = np.zeros((1, recurrent.UNITS), np.float32), 0.0, 0
        for x in t.tolist():
            h = u.step(np.array([before]), h)[0]
            total, before = total + float(u.log_probability(h, np.array([x]))[0]), x
        assert math.isclose(total, whole, rel_tol=1e-5, abs_tol=1e-3)


def test_gradients_equal_differences():
    r = np.random.default_rng(4)
    voc = recurrent.Vocabulary(np.arange(30, dtype=np.uint64), r.integers(1, 50, 30), 7, np.zeros(recurrent.KINDS), np.zeros(recurrent.KINDS))
    u = recurrent.Unit(voc)
    u.p = {k: r.normal(0, 0.3, x.shape) for k, x in u.p.items()}
    ids = r.integers(0, voc.words + recurrent.KINDS, (6, 3))
    inputs = r.integers(0, voc.words + recurrent.KINDS, (6, 3))
    fresh, there = np.zeros((6, 3), bool), np.ones((6, 3), bool)
    fresh[0], fresh[3, 1], there[5, 2] = True, True, False
    f = lambda: float(u.gradients(inputs, ids, fresh, there, np.zeros((3, recurrent.UNITS), np.float32))[0])
    grads = u.gradients(inputs, ids, fresh, there, np.zeros((3, recurrent.UNITS), np.float32))[2]
    for k in u.p:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in u.p[k].shape)
            if k == "g":
                at = (int(inputs[2, 1]), at[1])
            old = u.p[k][at]
            u.p[k][at] = old + 1e-3
            up = f()
            u.p[k][at] = old - 1e-3
            down = f()
            u.p[k][at] = old
            assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at])), k


def test_all_learnable_texts_teach_the_unit(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "STEPS", 16)
    monkeypatch.setattr(recurrent, "LANES", 4)
    r = np.random.default_rng(5)
    voc = recurrent.Vocabulary(np.arange(30, dtype=np.uint64), r.integers(1, 50, 30), 7, np.zeros(recurrent.KINDS), np.zeros(recurrent.KINDS))
    texts = [np.r_[np.tile([1 + k % 5, 7, 9 + k % 5, 20], 1 + k % 4), 0].astype(np.int32) for k in range(3000)]
    lessons = spark.createDataFrame([(k * 7919, bytearray(t.tobytes())) for k, t in enumerate(texts)], "_slot long, _ids binary").repartition(3)
    tokens, unit = sum(map(len, texts)), recurrent.Unit(voc)
    before = unit.score(texts).sum()
    assert recurrent.taught(lessons, unit, tokens) == tokens
    assert unit.score(texts).sum() > 0.9 * before
    again = recurrent.Unit(voc)
    recurrent.taught(lessons.repartition(5), again, tokens)
    assert np.allclose(unit.flat(), again.flat(), atol=1e-5)  # however the rows lie


def test_word_list_grows_with_the_vocabulary():
    assert recurrent.listed(10_000) == recurrent.SHORT < recurrent.listed(4_000_000) < recurrent.listed(100_000_000)
    hashes = np.arange(40_000, dtype=np.uint64)
    voc = recurrent.Vocabulary(hashes, np.arange(40_000)[::-1] + 1, 7, np.zeros(recurrent.KINDS), np.zeros(recurrent.KINDS))
    assert voc.classes == 200 and sorted(voc.ids) == list(range(1, 40_001))


def plain_grams(text):
    """Hashed n-grams of one text, one at a time."""
    s, out, m = [0, 0] + [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0, 0], collections.Counter(), 1 << 32
    for two, one, here in zip(s, s[1:], s[2:], strict=False):
        pair = here * 0x9E3779B1 + one * 0x85EBCA77
        for code, there in ((here * 0x9E3779B1, here), (pair % m ^ 0x27D4EB2F, here or one), ((pair + two * 0xC2B2AE3D) % m ^ 0x165667B1, one)):
            code %= m
            if there:
                out[(code ^ code >> 15) * 0x2C1B3C6D % m >> 19] += 1
    return out


def test_languages_equal_a_plain_version(spark, docs):
    model = langid.fit(docs, learnable("doc_id", 4, 2))
    teach = [x for x in made() if not held(x[0], 4, 2)]
    frequency = collections.Counter(d for _, t, *_ in teach for d in plain_grams(t))
    idf = [math.log((1 + len(teach)) / (1 + frequency[d])) + 0.1 for d in range(langid.DIMS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    rows = {r.doc_id: r for r in langid.identified(docs, model, prefix="p_").collect()}
    for i, text, *_ in made()[:40]:
        grams = plain_grams(text)
        x = {d: (1 + math.log(n)) * idf[d] for d, n in grams.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        cosine = [sum(v * float(c[d]) for d, v in x.items()) / size for c in model.centroids]
        best = max(range(len(cosine)), key=lambda k: cosine[k])
        level = max(k for k, n in enumerate(langid.LEVELS) if len(grams) >= n)
        assert rows[i].p_lang_pred == model.langs[model.of[best]] and abs(rows[i].p_score - cosine[best]) < 1e-4
        assert rows[i].p_rejected == (cosine[best] < model.least[level, best])


def test_quality_scores_equal_all_pairs(spark, docs):
    machine = quality.fit(docs, docs.select("doc_id", "quality"), learnable("doc_id", 5, 0))
    rows = {r.doc_id: r.score for r in quality.scored(docs, machine).collect()}
    for i, text, *_, size in made()[:4]:
        ends, slots, stats = quality.Features().of([text.encode()], np.array([float(size)]))
        assert len(slots) == len(set(text.split())) and stats[0][0] == np.float32(math.log1p(len(text.encode())))
        x = [(int(s), 1 / math.sqrt(len(slots))) for s in slots]
        x += [(quality.WORDS + k, float(v)) for k, v in enumerate(np.clip((stats[0] - machine.mean) / machine.deviation, -6, 6))]
        z = machine.w0 + sum(float(machine.w[a]) * v for a, v in x) + sum(float(machine.v[a] @ machine.v[b]) * v * w for k, (a, v) in enumerate(x) for b, w in x[k + 1 :])
        assert abs(1 / (1 + math.exp(-z)) - rows[i]) < 1e-3
    one = docs.where("quality = 1 OR quality IS NULL")
    assert {round(r.score, 6) for r in quality.scored(docs, quality.fit(one, one.select("doc_id", "quality"), F.lit(True))).collect()} == {1.0}
