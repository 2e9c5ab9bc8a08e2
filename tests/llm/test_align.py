import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from helpers import SF, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from postloom.llm import align
from postloom.sources.scratch import stage

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


def plain(texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] token by token."""
    of_bytes = Tokenizer.from_file(BYTES)
    of_bytes.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spell_a = align.byte_level_tokens(BYTES)

    def spell_b(i):
        name = pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = of_bytes.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if b"".join(spell_a[i] for i in a) != whole or b"".join(map(spell_b, b)) != whole:
            rows.append(None)
            continue
        spans = []
        for ids, spell in ((a, spell_a.__getitem__), (b, spell_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spell(i)), i))
                at = out[-1][1]
            spans.append(out)
        both = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, start = [], 0
        for end in sorted(both):
            groups.append(
                "|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in spans)
            )
            start = end
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (
            row[0],
            row[1],
            len(row[2]),
            len(row[3]),
            sum(counts[x] == best[x[1]] for x in row[3]),
            sum(counts[x] for x in row[3]),
            hashlib.sha256(";".join(row[2]).encode()).hexdigest(),
        )
        if row
        else ZERO
        for row in rows
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None,
    "",
    "a",
    " ",
    "  \n\t x  ",
    "Hello hello, tokenizers' tokens don't agree; 12345 67!",
    "Hello hello, tokenizers' tokens don't agree; 12345 67!",
    "naïve café – 日本語 x　y 🙂🙂 ́",
    "<|endoftext|> and </s><s> <unk> <0x41> are text",
    "piece mark ▁ spells other bytes",
    "a\0b \r\n\x85 c",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3,
    "zzz" * 4000,
]


def scored(spark, docs, **options):
    found = stage(align.align(docs, BYTES, PIECES), "aligned")
    return align.link_scores(found, align.vocabulary_size(PIECES), **options)


def test_texts_of_all_kinds_against_brute_force(spark):
    rows = scored(spark, documents(spark, TEXTS)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(rows, key=lambda r: r.doc_id)] == plain(TEXTS)


def test_more_pairs_than_are_sent_are_joined(spark):
    rows = scored(spark, documents(spark, TEXTS), max_sent=0).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(rows, key=lambda r: r.doc_id)] == plain(TEXTS)


@pytest.mark.parametrize("max_sent", [align.MAX_SENT_PAIRS, 0])
def test_links_that_are_read_again_come_in_short_rows(spark, monkeypatch, max_sent):
    longest, count = [], align.pair_counts

    def counted(links):
        longest.append(links.select(F.max(F.size("links"))).first()[0])
        return count(links)

    monkeypatch.setattr(align, "pair_counts", counted)
    texts = ["zzz" * 4000, " ".join(f"w{i % 90} is {i}" for i in range(3000)), "", "short"]
    rows = scored(spark, documents(spark, texts), max_sent=max_sent).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(rows, key=lambda r: r.doc_id)] == plain(texts)
    assert max(r.n_links for r in rows) > 5000 and longest == [256]


def test_ids_of_any_type_under_any_name(spark):
    docs = documents(spark, ["a b", "a", None]).withColumns({"_row": F.struct("doc_id"), "at": F.lit(None).cast("string")})
    for name in ("_row", "at"):
        found = align.align(docs, BYTES, PIECES, doc=name)
        rows = align.link_scores(found, align.vocabulary_size(PIECES))
        assert rows.columns[0] == name and rows.schema[name].dataType == docs.schema[name].dataType
        assert sorted(tuple(r[c] for c in COLUMNS) for r in rows.collect()) == sorted(plain(["a b", "a", None]))


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    docs = documents(spark, ["x y", "x y", "x y", None], [1, 1, None, None])
    rows = [tuple(r[c] for c in COLUMNS) for r in scored(spark, docs).collect()]
    assert sorted(rows) == sorted(plain(["x y", "x y", "x y", None]))
    assert scored(spark, docs.where("false")).collect() == []


def test_a_small_memory_gives_the_same(monkeypatch):
    import pyarrow as pa

    with open(PIECES, "rb") as file:
        aligner = align.Aligner(align.byte_level_tokens(BYTES), file.read())
    texts = [f"word{i} and word{i % 7} more {i * i}" for i in range(200)] * 2
    monkeypatch.setattr(align, "PIECE", 200)
    whole = [c[4].to_pylist() for c in aligner.texts(pa.array(texts))]
    monkeypatch.setattr(align, "REMEMBERED", 5)
    assert [c[4].to_pylist() for c in aligner.texts(pa.array(texts))] == whole


def test_links_are_codes_in_order(spark):
    row = align.align(documents(spark, ["a b"]), BYTES, PIECES).first()
    size = align.vocabulary_size(PIECES)
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("a b")
    assert [code % size for code in row.links] == pieces and row.n_links == len(pieces)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in entry.queries()["op12_align"](spark, SF).collect()}
    assert found == {d.doc_id: want for d, want in zip(docs, plain([d.text for d in docs]))}
