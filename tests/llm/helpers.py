"""Small frames for the operators' tests."""

import re

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, ids=None):
    """doc_id, text and columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return frame(
        spark,
        [(i, t, "en", "s", 0, "x", "y", "z") for i, t in zip(ids, texts)],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "_text string, _row string, node string",
    )


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, texts, k, percent=80):
    """{id: smallest id reachable} by comparing all pairs; ids are distinct."""
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(ids):
        least[find(i)] = min(least.get(find(i), name), name)
    return {name: least[find(i)] for i, name in enumerate(ids)}
