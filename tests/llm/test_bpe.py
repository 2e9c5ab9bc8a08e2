import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import documents
from tokenizers import Tokenizer

from postloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [
    *"abcdefghijklmnopqrstuvwxyzABC   \n\t'0123456789.,!-_$", "'s", "'ll", "'T", " the", " and", "\x1c",
    "\x1f", "\x85", "\xa0", "​", "᠎", "é", "ñ", "ß", "²", "½", "ª", "中", "文", "Ⅷ", "٣", "🙂",
    "́", "<|endoftext|>", "　", "\x00", "\x7f", "ǅ", "ﬁ", "𝟙",
]


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 100))) for _ in range(n)]
    return [*made, "", "a" * 5000, " " * 300, "ab" * 3000 + " x", "\n" * 70, "don't we'll 'tis", "x" * 65]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_are_the_librarys(vocabulary, library):
    rows = texts()
    packed = bpe.Encoder(vocabulary).encode(rows)
    for text, got, want in zip(rows, packed, library.encode_batch(rows, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text[:80]
        assert bpe.decode_ids(got, vocabulary.tokens) == library.decode(want.ids, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(vocabulary, library):
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(12)]
        got = bpe.decode_ids(np.array(ids, "<u4").tobytes(), vocabulary.tokens)
        assert got == library.decode(ids, skip_special_tokens=False)


def test_rows_and_single_words_merge_alike(vocabulary):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 64))) for _ in range(800)]
    encoder = bpe.Encoder(vocabulary)
    encoder.learn(words)
    for word in words:
        assert np.frombuffer(encoder.known[word], "<u4").tolist() == bpe.merge_one(word.encode(), vocabulary)


def test_a_forgetful_encoder_gives_the_same(vocabulary, monkeypatch):
    rows = texts(300, 4)
    want = bpe.Encoder(vocabulary).encode(rows)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder(vocabulary)
    assert [encoder.encode([t])[0] for t in rows] == want


def test_frames(spark, library):
    rows = [None, "", "Hello world", "Hello world", "x" * 300_000, "<|endoftext|> é"]
    docs = documents(spark, rows, [1, 2, 3, 3, None, 5])
    encoded = bpe.encode(docs, PATH)
    assert "text" not in encoded.columns and "_row" in encoded.columns
    found = bpe.id_array(bpe.decode(encoded, PATH)).collect()
    by_text = {r["decoded"]: r["ids"] for r in found}
    assert sorted(r["decoded"] for r in found) == sorted(t or "" for t in rows)
    for text, ids in by_text.items():
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_digests_of_the_query(spark, library):
    import __spark_entry__ as entry
    from helpers import SF

    rows = entry.queries()["op3_bpe"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_a_column_named_like_the_ids_in_another_case_is_replaced(spark):
    docs = documents(spark, ["some text"]).withColumnRenamed("node", "IDS")
    out = bpe.encode(docs, PATH)
    assert "IDS" not in out.columns and out.select("ids").first().ids is not None
