import zlib

import numpy as np
from helpers import SF, documents, frame

from postloom.llm import langid

EN, DE = "the cat and the dog with this thing ", "der hund und die katze mit schöner größe "


def corpus(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 5), "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "123 ²", "en", "x"), (102, "und", None, "x"), (103, EN, "en", "x"), (103, EN, "en", "x")]
    return frame(spark, rows, "doc_id long, text string, lang string, k0 string")


def test_nearest_language_and_rejection(spark):
    model = langid.fit(corpus(spark), settings=langid.Settings(clusters=2))
    assert sorted(set(model.languages)) == ["de", "en"]
    texts = ["the dog", "die katze", None, "", "12 3!", "THE CAT", "かなカナ漢字", EN * 5000, "die katze"]
    rows = langid.predict(documents(spark, texts), model, keep=["doc_id", "_text"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    assert [r.language for r in rows][:6] == ["en", "de", "und", "und", "und", "en"]
    assert rows[7].language == "en" and not rows[7].rejected and rows[8].language == "de"
    assert [r.rejected for r in rows[2:5]] == [True] * 3 and rows[6].rejected
    assert rows[6].language in ("de", "en") and all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(documents(spark, []), model, keep=["doc_id"]).count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.fit(corpus(spark).limit(0))
    rows = langid.predict(documents(spark, ["text", None]), model, keep=["doc_id"]).collect()
    assert [(r.language, r.score, r.rejected) for r in rows] == [("und", 0.0, True)] * 2


def test_grams_equal_a_plain_count():
    settings = langid.Settings(bins=1 << 16)
    letters = langid.letter_table()
    texts = ["ab, cd", "", "é", "a-b  c", "Straße1x"]
    counts, has = langid.gram_counts(texts, letters, settings)
    assert has.tolist() == [True, False, True, True, True]
    for text, row in zip(texts, counts):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        plain = "".join(" " + w for w in words)
        grams = [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)]
        alone = langid.gram_counts([plain[1:]], letters, settings)[0][0]
        assert row.sum() == len(grams) and np.array_equal(row, alone)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf = SF.replace("0.001", "0.01")
    rows = entry.queries()["op6_langid"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_predictions_equal_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    letters = langid.letter_table()
    found = {r.doc_id: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for row in rows:
        got = found[row.doc_id]
        counts, has = langid.gram_counts([row.text or ""], letters, model.settings)
        if not has[0]:
            assert (got.language, got.score, got.rejected) == ("und", 0.0, True)
            continue
        x = np.log(1.0 + counts[0]) * model.idf.astype(float)
        cosines = [x @ c.astype(float) / np.linalg.norm(x) / np.linalg.norm(c.astype(float)) for c in model.centroids]
        best = max(cosines)
        near = {name for name, c in zip(model.languages, cosines) if c > best - 1e-5}
        assert got.language in near and abs(got.score - best) < 1e-4
