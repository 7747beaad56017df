import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from varistack.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.model(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_encodes_as_the_library(model, library):
    rng = random.Random(3)
    letters = "ab the▁  \n\té漢字ก😀<s>0x0A"

    def letter():
        if rng.random() < 0.7:
            return rng.choice(letters)
        return chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x3040, 0x30FF), rng.randint(0, 31), rng.randint(0x1F300, 0x1F6FF)]))

    for _ in range(5000):
        text = "".join(letter() for _ in range(rng.randrange(60)))
        assert model.encode(text) == library.encode(text), repr(text)


@pytest.mark.parametrize("text", ["", " ", "▁", "\n", "<s></s><unk><0x0A>", "a" * 50_000, " " * 5_000 + "x", "漢" * 3_000, "ab" * 20_000, "x " * 30_000, "\u0000", "ﬁ Å é"])
def test_odd_texts(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)


def test_every_prefix_has_one_last_token(model):
    """What the table rests on: of the pieces that end a prefix exactly one fits."""
    for text in ("▁internationally", "▁▁▁aaaaabbbb", "▁straßenbahn漢😀x"):
        last = {}
        for end in range(len(text)):
            fit = []
            for token, piece in enumerate(model.tokens):
                before = end - len(piece)
                if text[: end + 1].endswith(piece) and (before < 0 or last[before] is None or model.merged(model.tokens[last[before]] + piece) == [model.tokens[last[before]], piece]):
                    fit.append(token)
            assert len(fit) <= 1
            last[end] = fit[0] if fit else None


def test_small_caches(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_UNITS", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 3)
    monkeypatch.setattr(pieces, "KEPT_IDS", 20)
    monkeypatch.setattr(pieces, "CHUNK", 7)
    small = pieces.PieceModel(pieces.default_model())
    for text in ("one two three four five six", "seven one two eight", "nineteen ninety-nine"):
        assert small.encode(text) == library.encode(text)


def test_other_models_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, RuntimeError)):
        pieces.PieceModel(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in pieces.op12_sentencepiece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {}
    for doc_id, text in rows:
        ids = library.encode(text or "")
        want[doc_id] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))))
    assert got == want


def test_odd_rows(spark, odd, odd_rows, none, library):
    path = pieces.default_model()
    rows = pieces.decode(pieces.encode(odd.withColumn("ids", F.lit(1)), path), path)
    assert rows.columns == ["doc_id", "ids", "decoded"]
    want = sorted((str(i), str(library.encode(t or "")), library.decode(library.encode(t or "")) if t else "") for i, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), str(r.ids), r.decoded) for r in rows.collect()) == want
    assert pieces.decode(pieces.encode(none, path), path).collect() == []
    with pytest.raises(ValueError, match="already"):
        pieces.decode(rows, path)
    some = spark.createDataFrame([(1, None), (2, [450])], "x long, ids array<int>")
    assert [r.decoded for r in pieces.decode(some, path).orderBy("x").collect()] == ["", library.decode([450])]
