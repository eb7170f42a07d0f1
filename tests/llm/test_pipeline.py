"""The pipeline against a plain-Python version of its stages on a small table."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from driftloom.llm.bpe import read_ranks


def made(seed=2):
    r = random.Random(seed)
    parts = {"xx": ["ka", "lo", "mi", "tu", "ra", "sen"], "yy": ["schö", "ber", "gen", "ung", "keit", "ver"]}
    rows = []
    for i in range(150):
        lang = r.choice(list(parts))
        rows.append([i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(60)), lang, r.choice(["a", "a", "b", None]), 0])
    for i in range(150, 220):
        text = rows[r.randrange(150)][1]
        w = text.split(" ")
        kind = r.random()
        if kind < 0.3:
            text = text.replace(" ", "\n", 3)
        elif kind < 0.7:
            w[r.randrange(len(w))] = "ka"
            text = " ".join(w)
        else:
            r.shuffle(w)
            text = " ".join(w)
        rows.append([i, text, "xx", r.choice(["a", "b"]), 0])
    rows += [[300, None, "xx", "a", 0], [301, "", None, "b", 0], [302, "12 !?", "xx", "b", 0], [303, "Съешь же ещё этих мягких французских булок " * 9, None, "a", 0]]
    return rows


def plain(rows):
    rows = [x for x in rows if x[0] < 300]  # no letters, or too far from both languages
    best = {}
    for x in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", x[1])
        best[key] = min(best.get(key, (1, 0, None)), (-len(x[1]), x[0], x), key=lambda v: v[:2]) if key in best else (-len(x[1]), x[0], x)
    rows = [v[2] for v in best.values()]
    sets = {}
    for x in rows:
        w = x[1].lower().split()
        sets[x[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    rows = [x for x in rows if root(x[0]) == x[0]]
    counts = Counter(x[3] for x in rows)
    total = sum(math.sqrt(n) for n in counts.values())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = []
    for x in rows:
        rate = math.sqrt(counts[x[3]]) / total * len(rows) / counts[x[3]]
        u = int(hashlib.md5(f"17:{x[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, math.exp(-rate)
        cdf = term
        while cdf <= u:
            k += 1
            term = term * rate / k
            cdf += term
        ids = library.encode_ordinary(x[1])
        out += [(x[0], x[3], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x[1].encode()).hexdigest())] * k
    return out


def test_equals_the_plain_version(spark, tmp_path):
    rows = made()
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "ka lo mi", "xx", "a", 8, "more")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
