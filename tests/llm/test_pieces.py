import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm.pieces import BLANK, Model, Processor, encoded, text_of

PATH = P.path("piece_bpe_32k.model")
PARTS = ["the", " thhe", "éeuxré ", "  ", "\n\n", "\t", "日本語", "🙂", "it's", "12345", " !?", "\0", "\x85", "　", "ß", "aaaaaaaaaaaa", BLANK, " " * 17, "<s>", "</s>", "<0x0A>", "<unk>", "ing", "tion", "⁇", "é", "\ufffd", "한국어", "\r\n "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def processor():
    return Processor(Model(open(PATH, "rb").read()))


def same(processor, library, text):
    ids = processor.encode(text)
    want = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want, repr(text[:200])
    assert processor.decode(ids) == library.decode(want), repr(text[:200])


def test_same_ids_and_text_as_the_library(processor, library):
    r = random.Random(1)
    for t in ["", " ", "  ", "\n", "x", "x" * 3000, " " * 999, "ab" * 2000, "a b" * 500, BLANK * 40]:
        same(processor, library, t)
    for _ in range(3000):
        same(processor, library, "".join(r.choice(PARTS) if r.random() < 0.7 else chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x52F), r.randrange(0x4E00, 0x5E00)])) for _ in range(r.randrange(1, 40))))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    processor, library = test_any_text.tools
    same(processor, library, text)


test_any_text.tools = (Processor(Model(open(PATH, "rb").read())), sentencepiece.SentencePieceProcessor(model_file=PATH))


def test_walk_without_cuts_and_without_blanks(processor, library):
    """Units needn't be cut: the walk alone gives the same ids. Pieces of the model in random order make it step back."""
    r, model = random.Random(2), processor.model
    pieces = [p for p in model.ids if len(p) > 1]
    for n in (2, 3, 5, 400):
        for _ in range(400 if n < 400 else 5):
            text = "".join(r.choice(pieces).strip(BLANK) for _ in range(n))
            assert model.encode(BLANK + text) == library.encode(text)
    text = "".join(r.choice(pieces) for _ in range(300)).replace(BLANK, " ")
    assert model.encode(BLANK + text.replace(" ", BLANK)) == library.encode(text)


def test_long_texts_take_linear_time(processor, library):
    r = random.Random(3)
    same(processor, library, "".join(r.choice("abcdeinorst") for _ in range(200_000)))
    same(processor, library, "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(50_000)))


def test_decoding_of_any_ids(processor, library):
    r = random.Random(4)
    for _ in range(500):
        ids = [r.choice([r.randrange(3, 259), r.randrange(1, 32000), r.randrange(259, 275)]) for _ in range(r.randrange(0, 12))]
        assert processor.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_other_models_are_refused():
    data = open(PATH, "rb").read()
    with pytest.raises(ValueError):
        Model(data + b"\x1a\x03\x12\x01x")  # rules with a character map
    with pytest.raises(ValueError):
        Model(data + b"\x0a\x05\x0a\x01x\x18\x04")  # a piece of a kind of its own


def test_rows(spark, library):
    df = spark.createDataFrame([(1, "Hello  world", "a"), (1, "Hello  world", "a"), (2, None, "b"), (3, "", "c"), (None, "é\n", None)], "doc_id long, text string, _text string")
    found = encoded(df, PATH, prefix="p_").collect()
    assert len(found) == 5
    for row in found:
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        assert (row.p_n_tokens, row.p_ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.p_decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sorted(str(r._text) for r in found) == ["None", "a", "a", "b", "c"]
    assert encoded(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        encoded(df.withColumnRenamed("_text", "N_Tokens"), PATH)
    broken = df.selectExpr("doc_id", "cast(unhex('61FF62E28261') as string) AS text").where("doc_id = 2")
    ids = library.encode(text_of(b"a\xffb\xe2\x82a"), add_bos=True, add_eos=True)
    assert text_of(b"a\xffb\xe2\x82a") == "a\ufffdb\ufffd\ufffda"
    assert encoded(broken, PATH).first().ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
