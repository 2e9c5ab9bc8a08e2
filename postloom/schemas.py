"""Table schemas and the CSV headers they travel under."""

from pyspark.sql import types as T

# The CSV headers of the post tables, in file order.
CSV_HEADERS = {
    "post_index": "Index",
    "thread_title": "Thread Title",
    "post_date": "Post Date",
    "post_content": "Post Content",
    "source_url": "Static URL",
    "translated_post_content": "translated_post_content",
    "sentiment_score": "sentiment_score",
}
LEGACY_CSV_HEADERS = {
    "thread_title": "Thread Title",
    "post_index": "Post Number",
    "post_date": "Post Date",
    "post_content": "Post Content",
    "translated_post_content": "translated_post_content",
    "sentiment_score": "sentiment_score",
}

CANONICAL = ["post_index", "thread_title", "post_date", "post_content", "source_url"]
LEGACY = ["thread_title", "post_index", "post_date", "post_content"]
ENRICHMENT = ["translated_post_content", "sentiment_score"]

_TYPES = {"post_index": T.IntegerType(), "sentiment_score": T.DoubleType()}


def table(columns):
    """StructType over known column names; every text column stays a string."""
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])


POSTS = table(CANONICAL)
LEGACY_POSTS = table(LEGACY)
TRANSLATED_POSTS = table(CANONICAL + ENRICHMENT[:1])
SCORED_POSTS = table(CANONICAL + ENRICHMENT)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
LEXICON = "token string, valence double"
TRANSLATION_MEMORY = "source_text string, target_text string"
GLOSSARY = "token string, target string"
