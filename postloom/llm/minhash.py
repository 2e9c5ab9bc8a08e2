"""Near-duplicate documents by MinHash bands, Bayesian verification and exact sets.

1. Each text becomes the set of its word shingles and a signature of minimum hashes. Equal sets
   become one node, so copies cost one row each and nothing more.
2. Nodes that agree on a band of the signature share a bucket. Each bucket member is paired with
   the bucket's first node only: as many pairs as members.
3. Pairs are compared signature batch by signature batch. One is given up as soon as the chance
   that its similarity reaches the threshold, given the matches so far and a uniform prior, is
   below `miss`. Survivors are checked on their full sets.
4. Links so far make components. Only buckets that still hold several are looked at again: each
   member outside the bucket's largest component against every member of another component, in
   blocks of bounded size, by the same two checks. So no link in a bucket is lost, and members
   that are known to belong together are never compared with each other.

What is left to chance is that two sets at the threshold share no band (see `Settings`) or fall
below the posterior bound.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.graph import components, joined_components
from postloom.llm.words import (
    LOWER,
    NOT_BLANK,
    find_words,
    free_name,
    hash_words,
    shingles,
    text_pieces,
    thrifty,
)
from postloom.operators.joins import fits
from postloom.sources.scratch import Workspace, stage

MAX_BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Two sets of similarity s share no band with probability (1 - s**rows)**bands: 4e-7 at 0.8
    by default. `miss` bounds the posterior at which a candidate is given up."""

    shingle: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    block: int = 256

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n hash functions; fixed by their number."""
    seeds = [
        int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=8).digest(), "little")
        for i in range(2 * n)
    ]
    values = np.array(seeds, np.uint64)
    return values[:n] | np.uint64(1), values[n:]


def signature(values: np.ndarray, family, step: int = 4096) -> np.ndarray:
    """The upper half of each function's least value over a set; memory is bounded by `step`."""
    times, plus = family[0][:, None], family[1][:, None]
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), step):
        hashed = values[at : at + step] * times
        hashed += plus
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def text_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_pieces(texts):
        lower = LOWER[data]
        words = find_words(lower, offsets, NOT_BLANK)
        values, first = shingles(hash_words(lower, words), words.first, k)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(values[a:b])


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc: str, text: str, settings: Settings) -> DataFrame:
    """(doc, n_shingles, set_key, signature) per row; key and signature null for an empty set."""

    def run(batches):
        family = hash_family(settings.hashes)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            sizes, keys, signs = [], [], []
            for values in text_sets(batch.column(1), settings.shingle):
                key = set_key(values) if len(values) else None
                if len(known) > 2000:
                    known.clear()
                if key and key not in known:
                    known[key] = signature(values, family).tobytes()
                sizes.append(len(values))
                keys.append(key)
                signs.append(known.get(key))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signs, pa.binary()),
                ],
                ["doc", "n_shingles", "set_key", "signature"],
            )

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(
        thrifty(run), f"doc {kind}, n_shingles long, set_key binary, signature binary"
    )


def least_matches(settings: Settings) -> np.ndarray:
    """least[n]: with n hashes compared, fewer matches than this make the chance that the
    similarity reaches the threshold smaller than `miss`. Under a uniform prior the posterior is
    Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m)."""
    t, n_all = settings.percent / 100, settings.hashes
    least = np.zeros(n_all + 1, np.int64)
    for n in range(1, n_all + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= settings.miss:
                break
            m += 1
        least[n] = m
    return least


def plausible(left: np.ndarray, right: np.ndarray, settings: Settings, least) -> np.ndarray:
    """Which rows of the two signature matrices survive, batch by batch."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for at in range(0, settings.hashes, settings.batch):
        to = min(at + settings.batch, settings.hashes)
        matches[alive] += (left[alive, at:to] == right[alive, at:to]).sum(axis=1)
        alive = alive[matches[alive] >= least[to]]
        if not len(alive):
            break
    return alive


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _matrix(column, dtype) -> np.ndarray:
    return np.array([np.frombuffer(v, dtype) for v in column])


def _band_keys(signs: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key per signature and band; the band's number is part of it."""
    bands = signs.reshape(len(signs), settings.bands, settings.rows).astype(np.uint64)
    keys = np.zeros(bands.shape[:2], np.uint64) + np.arange(settings.bands, dtype=np.uint64)
    for i in range(settings.rows):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i]
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


def bucket_rows(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, bucket): one row per node and band."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = _band_keys(_matrix(part.column(1).to_pylist(), np.uint32), settings)
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), settings.bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(keys.ravel().view(np.int64))], ["node", "bucket"]
                )

    return nodes.select("node", "signature").mapInArrow(run, "node long, bucket long")


def _surviving(pairs: DataFrame, settings: Settings) -> DataFrame:
    """(a, b) of the pairs whose signatures pass every batch."""

    def run(batches):
        least = least_matches(settings)
        for batch in batches:
            if batch.num_rows:
                left, right = (_matrix(batch.column(i).to_pylist(), np.uint32) for i in (2, 3))
                keep = pa.array(plausible(left, right, settings, least))
                yield batch.select([0, 1]).take(keep)

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, settings: Settings) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = [
                linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), settings.percent)
                for x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3)))
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    for end in "ab":
        pairs = pairs.join(
            table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end
        )
    return pairs


def _blocks(members: DataFrame, settings: Settings) -> DataFrame:
    """Members of buckets that hold several components, dealt to tasks (bucket, i, j).

    A bucket's largest component is cut into blocks of about `block` members, and so are the
    members outside it, its strays. Every block of strays meets every block of either kind once.
    """
    by_part = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = by_part.groupBy("bucket").agg(
        F.sum("n").alias("all"),
        F.max(F.struct("n", "component")).alias("main"),
        F.count("*").alias("parts"),
    ).where("parts > 1")
    cut = lambda n: F.greatest(F.ceil(n / settings.block), F.lit(1)).cast("int")
    sizes = sizes.select(
        "bucket",
        F.col("main.component").alias("main"),
        cut(F.col("main.n")).alias("main_blocks"),
        cut(F.col("all") - F.col("main.n")).alias("stray_blocks"),
    )
    rows = members.join(sizes, "bucket").withColumn("stray", F.col("component") != F.col("main"))
    blocks = F.when(F.col("stray"), F.col("stray_blocks")).otherwise(F.col("main_blocks"))
    number = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # Blocks of the main component are numbered -1, -2, ...
    rows = rows.withColumn("own", F.when(F.col("stray"), number).otherwise(-number - 1))

    def pair(i: Column, j: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"))

    stray_range = F.sequence(F.lit(0), F.col("stray_blocks") - 1)
    own = F.col("own")
    meets = F.when(
        F.col("stray"),
        F.concat(
            F.transform(stray_range, lambda k: pair(F.least(own, k), F.greatest(own, k))),
            F.transform(
                F.sequence(F.lit(1), F.col("main_blocks")), lambda k: pair(own, -k)
            ),
        ),
    ).otherwise(F.transform(stray_range, lambda k: pair(k, own)))
    return rows.select("bucket", "node", "component", "own", F.explode(meets).alias("_")).select(
        "bucket", "_.i", "_.j", "node", "component", "own"
    )


def _complete_groups(batches, key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group edges) of rows sorted by `key`, about 16 MB at a time, no group cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= 16 << 20:
            table, edges = _edges(held, key)
            cut = int(edges[-2])
            if cut:
                yield table.slice(0, cut), edges[:-1]
            held = table.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield _edges(held, key)


def _edges(held, key) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table[k].to_numpy() for k in key]
    new = np.zeros(table.num_rows + 1, bool)
    new[0] = new[-1] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return table, np.flatnonzero(new)


def _candidates(table: pa.Table, edges: np.ndarray, settings: Settings, least):
    """Index pairs (a, b) of members of one task that come from its two blocks, are in different
    components, agree on the bucket's band and on no earlier one, and survive the posterior
    bound. Some tens of thousands of pairs are worked on together."""
    signs = _matrix(table["signature"].to_pylist(), np.uint32)
    keys = _band_keys(signs, settings)
    bucket, i, j, own, parts = (
        table[c].to_numpy() for c in ("bucket", "i", "j", "own", "component")
    )
    # The band is where the bucket's key stands.
    band = (keys.view(np.int64) == bucket[:, None]).argmax(axis=1)
    left, right, n = [], [], 0
    for at, size in zip(edges[:-1].tolist(), np.diff(edges).tolist()):
        if size > 1:
            one, two = np.triu_indices(size, 1)
            left.append(one + at)
            right.append(two + at)
            n += len(one)
        if n >= 1 << 15 or (n and at + size == edges[-1]):
            all_a, all_b = np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
            fresh = parts[all_a] != parts[all_b]
            fresh &= (i[all_a] == j[all_a]) | (own[all_a] != own[all_b])
            all_a, all_b = all_a[fresh], all_b[fresh]
            for low in range(0, len(all_a), 1 << 14):
                a, b = all_a[low : low + (1 << 14)], all_b[low : low + (1 << 14)]
                earlier = (keys[a] == keys[b]) & (np.arange(settings.bands) < band[a][:, None])
                first = ~earlier.any(axis=1)
                a, b = a[first], b[first]
                alive = plausible(signs[a], signs[b], settings, least)
                yield a[alive], b[alive]


def _stray_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, settings, workspace):
    """(a, b) links between components that share a bucket."""
    tasks = workspace.stage(_blocks(members, settings), "blocks")
    key = ["bucket", "i", "j"]
    kept = [*key, "node", "component", "own"]

    def promising(batches):
        least = least_matches(settings)
        for table, edges in _complete_groups(batches, key):
            hit = np.zeros(table.num_rows, bool)
            for a, b in _candidates(table, edges, settings, least):
                hit[a] = hit[b] = True
            yield from table.select(kept).filter(pa.array(hit)).to_batches()

    def verify(batches):
        least = least_matches(settings)
        for table, edges in _complete_groups(batches, key):
            values = [np.frombuffer(v, np.uint64) for v in table["set"].to_pylist()]
            nodes, parts = table["node"].to_numpy(), table["component"].to_numpy().tolist()
            # Components seen here, so that one link between two of them is enough.
            root = {p: p for p in parts}

            def find(p):
                while root[p] != p:
                    p = root[p]
                return p

            found = []
            for a, b in _candidates(table, edges, settings, least):
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = find(parts[x]), find(parts[y])
                    if p != q and linked(values[x], values[y], settings.percent):
                        root[p] = q
                        found.append((x, y))
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[ends[:, 0]]), pa.array(nodes[ends[:, 1]])], ["a", "b"]
            )

    def per_task(frame, run, schema):
        """A task's rows are few by construction, so they may meet in one partition."""
        return frame.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)

    signed = tasks.join(nodes.select("node", "signature"), "node")
    hits = per_task(
        signed, promising, "bucket long, i int, j int, node long, component long, own int"
    )
    hits = workspace.stage(hits, "promising")
    full = hits.join(sets.select("node", "signature", "set"), "node")
    return per_task(full, verify, "a long, b long")


def _sent(ids: DataFrame) -> DataFrame:
    """Ids are sent around while they are few and small, long names counted by their bytes; beyond
    that the texts they meet are shuffled."""
    return F.broadcast(ids) if fits(ids, MAX_BROADCAST_IDS) else ids


def _node_sets(docs, doc, text, nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, signature, set) of the given nodes, from the text of one document of each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                values = list(text_sets(batch.column(0).slice(at, 512), settings.shingle))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_key(v) for v in values], pa.binary()),
                        pa.array([v.tobytes() for v in values], pa.binary()),
                    ],
                    ["set_key", "set"],
                )

    wanted = _sent(nodes.select(F.col("first_doc").alias("_doc")).distinct())
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    rows = rows.join(wanted, "_doc", "left_semi").select("_text")
    found = rows.mapInArrow(thrifty(run), "set_key binary, set binary")
    # A document id that stands on several rows may give a set more than once.
    found = found.groupBy("set_key").agg(F.first("set").alias("set"))
    return found.join(nodes.select("set_key", "node", "signature"), "set_key").drop("set_key")


def near_duplicates(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", settings: Settings | None = None
) -> DataFrame:
    """(doc, n_shingles, component_id, kept) per row of `docs`.

    Words are what ASCII blanks leave, with A-Z in lower case. `component_id` is the smallest id
    that links lead to, a row's own included; `kept` says that the id is the row's own. A null
    text, an empty one and one of blanks have no shingles and link with nothing. A row without
    an id takes part as a copy of a row with one, and is else alone, kept, with a null component.
    Rows of equal id and different texts are different documents. Other columns are not read.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    with Workspace(spark) as work:
        signed = stage(signatures(docs, doc, text, settings), "signatures")
        nodes = (
            signed.where("set_key is not null")
            .groupBy("set_key")
            .agg(F.min("doc").alias("first_doc"), F.first("signature").alias("signature"))
            .withColumn("node", F.monotonically_increasing_id())
        )
        nodes = work.stage(nodes, "nodes")  # written, so that the node numbers stay
        named = nodes.where("first_doc is not null")
        rows = bucket_rows(named, settings)
        shared = (
            rows.groupBy("bucket")
            .agg(F.min("node").alias("first"), F.count("*").alias("n"))
            .where("n > 1")
            .drop("n")
        )
        members = work.stage(rows.join(shared, "bucket"), "members")
        busy = named.join(members.select("node").distinct(), "node", "left_semi")
        busy = work.stage(busy, "busy")
        sets = work.stage(_node_sets(docs, doc, text, busy, settings), "sets")

        pairs = members.where("first <> node").select(
            F.col("first").alias("a"), F.col("node").alias("b")
        ).distinct()
        likely = work.stage(_surviving(_with_both(pairs, busy, "signature"), settings), "likely")
        links = work.stage(_verified(_with_both(likely, sets, "set"), settings), "links")
        parts = components(links, work)

        placed = members.join(parts, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component")
        )
        more = _stray_links(work.stage(placed, "placed"), busy, sets, settings, work)
        more = work.stage(more, "more-links")
        if not more.isEmpty():
            parts = joined_components(parts, more, work)

        ids = nodes.join(parts, "node", "left").select(
            "set_key", "first_doc", F.coalesce("component", "node").alias("component")
        )
        least = ids.groupBy("component").agg(F.min("first_doc").alias("component_id"))
        ids = stage(ids.join(least, "component").select("set_key", "component_id"), "classes")
    found = signed.drop("signature").join(ids, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return found.select(
        F.col("doc").alias(doc), "n_shingles", component.alias("component_id")
    ).withColumn("kept", F.col(doc).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", settings: Settings | None = None
) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest id. An id that stands on
    several rows goes if none of them is kept; else the row with the smallest text stays. Rows
    without an id cannot be named, and stay."""
    found = near_duplicates(docs, doc, text, settings)
    gone, many, whole = (free_name(docs, n) for n in ("_drop", "_many", "_row"))
    drop = found.groupBy(F.col(doc).alias(gone)).agg(F.max("kept").alias("_kept"))
    drop = drop.where("not _kept").select(gone)
    repeated = (
        docs.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias(many))
        .agg(F.count("*").alias("_n")).where("_n > 1").select(many)
    )
    left = docs.join(_sent(stage(drop, "dropped")), F.col(doc) == F.col(gone), "left_anti")
    repeated = stage(repeated, "repeated-ids")
    if repeated.isEmpty():
        return left
    columns, repeated = docs.columns, _sent(repeated)
    rest = [c for c in columns if c != doc]
    single = left.join(repeated, F.col(doc) == F.col(many), "left_anti")
    several = left.join(repeated, F.col(doc) == F.col(many), "left_semi")
    one = several.groupBy(doc).agg(F.min_by(F.struct(*rest), F.col(text)).alias(whole))
    return single.unionByName(one.select(doc, f"{whole}.*").select(*columns))


def drop_near_duplicate_rows(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", settings: Settings | None = None
) -> DataFrame:
    """`docs` with one row of each group: of its rows the one with the smallest id, null last, ties
    by place in the table. Every row is a document of its own, so repeated and null ids neither
    lose nor spare rows."""
    key, gone = free_name(docs, "_place"), free_name(docs, "_drop")
    # Written, so that the numbers stay.
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, key, text, settings).select(key, "component_id")
    found = found.join(rows.select(key, F.col(doc).alias("_id")), key)
    order = F.struct(F.col("_id").isNull(), "_id", F.col(key).alias("place"))
    least = found.groupBy("component_id").agg(F.min(order).alias("_least"))
    least = least.select(F.col("_least.place").alias("_kept"))
    # By row, not by group, so that a large group is spread.
    drop = found.join(least, F.col(key) == F.col("_kept"), "left_anti")
    drop = drop.select(F.col(key).alias(gone))
    drop = _sent(stage(drop, "dropped"))
    return rows.join(drop, F.col(key) == F.col(gone), "left_anti").drop(key)
