import re

import numpy as np
import public_tokenizers
import pytest
from helpers import components, frame
from test_decontaminate import brute
from test_toxicity import labelled
from tokenizers import Tokenizer

import corpus_pipeline
from postloom.llm import bpe

PASSAGE = " ".join(f"exam{i}" for i in range(14))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts, toxic = labelled(spark, 160)
    texts[10] += " mail me: some.one@example.com or 42.144.35.254."
    texts[11] = f"{texts[11]} {PASSAGE}, {texts[13]}"
    texts += [texts[1], texts[1] + " end", "", None, PASSAGE]
    toxic += [0] * 5
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, rows, schema).write.parquet(f"{path}/documents.parquet")
    known = [(i, 1, t) for i, t in enumerate(toxic)]
    frame(spark, known, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = frame(spark, [(1, PASSAGE)], "item_id long, text string")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path, texts, toxic


def test_rows_of_the_pipeline(spark, sf_dir):
    path, texts, toxic = sf_dir
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    found = out.collect()
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found}
    sizes = {r.doc_id: r.n_chars for r in found}
    clean = [i for i, t in enumerate(toxic) if not t]
    classes = components(clean, [texts[i] for i in clean], 5)
    expected = {i for i in clean if classes[i] == i} - {164}
    assert set(rows) == expected
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, ids in rows.items():
        text = library.decode(ids, skip_special_tokens=False)
        assert sizes[i] == len(text)
        assert library.encode(text, add_special_tokens=False).ids == ids
        if i not in (10, 11):
            assert text == (texts[i] or "")
    ten = library.decode(rows[10], skip_special_tokens=False)
    shape = re.escape(texts[10].split(" mail me")[0]) + r" mail me: [a-z]{4}\.[a-z]{3}@example\.com or [0-9.]+\."
    assert re.fullmatch(shape, ten) and "some.one" not in ten and "42.144.35.254" not in ten
    eleven = library.decode(rows[11], skip_special_tokens=False)
    assert brute(eleven, [("1", PASSAGE)])[1] == 0 and eleven.endswith(texts[13])


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    path, _, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, path).columns == docs.columns, name
    assert bpe.encode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
