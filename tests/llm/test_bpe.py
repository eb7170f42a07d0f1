import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from driftloom.llm.bpe import EditableText, Encoder, PrefixTable, Vocabulary, encoded, read_ranks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = ["the", " thhe", "éeuxré ", "  ", "\n\n", "\t", "日本", "🙂", "it's", "WE'LL", "12345", " !?", "\x1c", "\x85", "　", "ß", "á", "aaaaaaaaaaaa", "᠎", "​", "\r\n "]


@pytest.fixture(scope="module")
def tools():
    ranks = read_ranks(RANKS)
    return Encoder(Vocabulary(ranks), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_of(r, n):
    return "".join(r.choice(WORDS) if r.random() < 0.8 else chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x2FF), r.randrange(0x4E00, 0x4F00)])) for _ in range(n))


def test_same_ids_as_the_library_and_back(tools):
    encoder, library = tools
    r = random.Random(1)
    for t in ["", " ", "\n", "x" * 3000, " " * 999, *(text_of(r, r.randrange(1, 60)) for _ in range(1500))]:
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t), repr(t)
        assert encoder.decode(ids) == t.encode()


def test_appends_and_cuts_are_exact(tools):
    encoder, _ = tools
    r = random.Random(2)
    for _ in range(200):
        data = text_of(r, 8).encode()
        grown = PrefixTable(encoder.vocabulary)
        for k in range(len(data)):
            grown.append(data[k : k + 1])
        assert grown.tokens() == PrefixTable(encoder.vocabulary, data).tokens()
        k = r.randrange(len(data) + 1)
        grown.cut(k)
        assert grown.tokens() == PrefixTable(encoder.vocabulary, data[:k]).tokens()


def test_edits_equal_a_fresh_encoding(tools):
    encoder, library = tools
    r = random.Random(3)
    for _ in range(400):
        held = EditableText(encoder, text_of(r, 20))
        for _ in range(5):
            text = held.text
            at = r.randrange(len(text) + 1)
            removed = r.randrange(0, min(6, len(text) - at) + 1)
            more = text_of(r, r.randrange(0, 4))
            held.edit(at, removed, more)
            want = text[:at] + more + text[at + removed :]
            assert held.text == want
            assert held.ids() == library.encode_ordinary(want), (text, at, removed, more)


def test_frame(spark, tools):
    import hashlib

    _, library = tools
    texts = [None, "", "héllo wörld", "a" * 200_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in encoded(df, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encoded(df.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        encoded(df.withColumnRenamed("lang", "N_Tokens"), RANKS, P.PATTERN)


def test_numpy_pieces_equal_the_patterns(tools):
    encoder, library = tools
    r = random.Random(5)
    odd = ["'s", "'", "''", "'re", "'r", "'ll", "'d", " '", "\n'", "x", "e", "1", "²", "́", " ", "  ", "\n", "\t ", " \n", " ", "'S", "''s", " ", "ve", "ll", "!", "'t's", "\x1c", "\x85"]
    for _ in range(300):
        texts = ["".join(r.choice(odd) for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(1, 9))]
        starts, bounds, data = encoder.splitter.starts(texts)
        cut = [data[a:z].decode() for a, z in zip(starts, [*starts[1:], len(data)], strict=False)]
        assert cut == [p for t in texts for p in encoder.split(t)], texts
        assert [x.tolist() for x in encoder.encode_many(texts)] == [library.encode_ordinary(t) for t in texts]


def test_other_patterns_and_full_memory(tools, monkeypatch):
    from driftloom.llm import bpe

    monkeypatch.setattr(bpe, "MEMORY", 50)
    pattern = r"\w+|\W"
    ranks = read_ranks(RANKS)
    mine, library = Encoder(Vocabulary(ranks), pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    for _ in range(40):
        t = "".join(r.choice(["the ", "thhe", "x1!", "é", "  "]) for _ in range(20))
        assert mine.encode(t) == library.encode_ordinary(t)


def twins(n):
    """Thue-Morse strings, which collide under any polynomial hash modulo a power of two."""
    one = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_pieces_that_hash_alike_keep_their_ids(tools, monkeypatch):
    encoder, library = tools
    for n in (1024, 2048, 4096):
        for text in twins(n):
            assert encoder.encode(text) == library.encode_ordinary(text)
    ids, bounds = encoder.encode_all([x for n in (1024, 2048) for x in twins(n)])
    assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode_ordinary(x) for n in (1024, 2048) for x in twins(n)]
    encoder.forget()
    monkeypatch.setattr(encoder.hasher, "runs", lambda data, sizes: np.full(len(sizes), 6, np.uint64))  # all pieces collide
    for text in ("one two three", "three two one, it's", "one two", "x" * 100 + " two"):
        assert encoder.encode(text) == library.encode_ordinary(text)
    encoder.forget()
