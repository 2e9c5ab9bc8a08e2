"""One query per operator over the given tables, and its SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import (
    align,
    bpe,
    chat,
    decontaminate,
    langid,
    lempel_ziv,
    licenses,
    minhash,
    periodic_runs,
    pseudonyms,
    quality,
    toxicity,
    warc,
)
from postloom.llm.oracles import ORACLES  # noqa: F401
from postloom.operators.joins import hot_keys, spread_join
from postloom.sources.scratch import new_path, remove, stage

#: Anyone who has the key can undo the pseudonyms: a real run reads it from its secrets.
PSEUDONYM_KEY = "not a secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    """Pages with an even id go through ARC version 1, the others through version 2."""
    pages = table(spark, sf_dir, "pages")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    records = pages.select(
        "page_id",
        "url",
        F.lit("0.0.0.0").alias("ip"),
        F.lit("20240101000000").alias("date"),
        F.lit("text/html").alias("mime"),
        F.concat(F.encode(head, "UTF-8"), body).alias("content"),
    )
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    warc.write_arc(records.where(~odd).drop("page_id"), f"{arc}/v1", 1)
    warc.write_arc(records.where(odd).drop("page_id"), f"{arc}/v2", 2)
    old, digests = (warc.read_arc(spark, f"{arc}/*", content) for content in (True, False))
    page = warc.http_header(F.col("http"), "X-Page-Id").cast("long")
    warc.write_warc(warc.convert(old, page, digests=digests), out)
    remove(spark, arc)
    read = warc.read_warc(spark, out).withColumn("page_id", page)
    whole = F.col("type") == "response"
    answers = read.where(whole).select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page")
    )
    return read.join(answers, "refers_to", "left").select(
        "page_id",
        F.when(whole, F.col("payload_bytes"))
        .otherwise(warc.http_header(F.col("http"), "Content-Length").cast("long"))
        .alias("payload_bytes"),
        F.when(whole, F.col("found_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )


def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path)
    return bpe.decode(ids, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.col("severity.expected").alias("severity"), "severity.toxic")


def op5_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sequence, members = chat.pack(turns.unionByName(extra))
    back = chat.read_back(sequence, members)
    digest = lambda parts: F.sha2(F.array_join(parts, ""), 256)
    learned = F.filter(F.transform("turns", lambda t: t["learned_text"]), lambda t: t.isNotNull())
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.char_length(F.array_join(learned, "")).cast("long").alias("loss_chars"),
        digest(learned).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("formatted_chars"),
    )


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language").alias("lang_pred"),
        "score",
        "rejected",
    )


def op7_minhash(spark, sf_dir):
    return minhash.near_duplicates(
        table(spark, sf_dir, "documents"), settings=minhash.Settings(shingle=4)
    )


def op8_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, changed="n_replaced", every_phone=True)


def op9_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lempel_ziv.repeated_stretches(docs)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    small = stage(
        found.select(
            "key", "copies", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
        ),
        "kept",
    )
    keyed = docs.select("doc_id", lempel_ziv.text_key(F.col("text")).alias("key"))
    hot = hot_keys(small, "key", "copies", lempel_ziv.ROWS_PER_TASK)
    return spread_join(keyed, small, "key", "inner", hot=hot, rows="copies").drop("key")


def op12_align(spark, sf_dir):
    piece_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    found = align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), piece_path)
    scored = align.link_scores(found, align.vocabulary_size(piece_path))
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def _periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the crc32 of the id, every tenth document by h repeats a stretch of
    its words to its end; texts are left as they are elsewhere."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn(
        "ws",
        F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))),
    )
    rows = rows.withColumn("n", F.size("ws").cast("int"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), times))
    changed = F.slice(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n"))
    return rows.select(
        "doc_id",
        F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"),
    )


def op13_periodic_runs(spark, sf_dir):
    docs = _periodic_tails(table(spark, sf_dir, "documents"))
    found = periodic_runs.detect(docs).select("doc_id", "periodic.*")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    order = lambda x, y: (
        F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"]))
        .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
        .otherwise(F.signum(x["period"] - y["period"]))
        .cast("int")
    )
    longest = F.try_element_at(F.array_sort("runs", order), F.lit(1))
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_longest.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * _longest.length div _longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias(
            "runs_sha256"
        ),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_chat": op5_chat,
    "op6_langid": op6_langid,
    "op7_minhash": op7_minhash,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_align": op12_align,
    "op13_periodic_runs": op13_periodic_runs,
}
