"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints that differ in at most ``radius`` bits agree, in
at least one of ``segments`` segments, up to ``radius // segments`` bits; so each segment's small Hamming
ball is enumerated as probes into a table of exact segment values, and every table match is verified
over all 64 bits within the join itself, which therefore only emits true links.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any
other; rows with equal doc_id are separate rows of the same component if their fingerprints link;
a component whose ids are all null has a null component_id. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import store
from .components import components

WORDS_PER_SHINGLE, RADIUS, SEGMENTS, SEED = 4, 4, 3, 42


def fingerprint(text: str | None, width: int = WORDS_PER_SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    # bytes.lower and bytes.split are ASCII rules: A-Z, and space with \x09-\x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, count = b" ".join(words), len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    if count <= 1:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: count - 1].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    ones = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segments(count: int) -> list[int]:
    """Bit masks of ``count`` nearly equal segments."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _flips(mask: int, most: int) -> list[int]:
    """Sets of at most ``most`` bits within the mask."""
    from itertools import combinations

    bits = [1 << k for k in range(64) if mask >> k & 1]
    return [sum(c) for n in range(most + 1) for c in combinations(bits, n)]


def links(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """nodes(fp), distinct -> (u, v): every pair within ``radius`` bits, each once, u < v.

    The half of each ball whose first flipped bit is zero in the probing fingerprint is enough: of two
    fingerprints that differ in given bits, exactly one has a zero in the lowest of them.
    """
    masks, least = _segments(segments), radius // segments
    probe = [(seg, _signed(mask), _signed(flip), _signed(flip & -flip)) for seg, mask in enumerate(masks) for flip in _flips(mask, least)]
    literal = lambda rows, names: F.array(*(F.struct(*(F.lit(x).cast("long" if n != "seg" else "int").alias(n) for x, n in zip(row, names))) for row in rows))
    probes = (
        nodes.select("fp", F.explode(literal(probe, ("seg", "mask", "flip", "low"))).alias("p"))
        .where(F.col("fp").bitwiseAND(F.col("p.low")) == 0)
        .select(F.col("fp").alias("a"), F.col("p.seg").alias("seg"), (F.col("p.flip") == 0).alias("same"), F.col("fp").bitwiseXOR(F.col("p.flip")).bitwiseAND(F.col("p.mask")).alias("key"))
    )
    entries = nodes.select("fp", F.explode(literal([(k, _signed(m)) for k, m in enumerate(masks)], ("seg", "mask"))).alias("t")).select(
        F.col("fp").alias("b"), F.col("t.seg").alias("seg"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key")
    )
    gap = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)  # each link only in the first segment that finds it
    for k, mask in enumerate(masks[:-1]):
        first = first & ((F.col("p.seg") <= k) | (F.bit_count(gap.bitwiseAND(F.lit(_signed(mask)))) > least))
    # Both sides grow with the corpus, and a file's size says nothing of the rows exploded from it: never broadcast.
    found = probes.alias("p").hint("merge").join(
        entries.alias("t"),
        (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(gap) <= radius) & first,
    )
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def grouped(documents: DataFrame, keys: list[str], radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """documents(doc_id, text, *keys) -> (doc_id, *keys, fp, root, component_id), one row per row.

    The root is the component's smallest linked fingerprint, and so its name even where components share ids.
    Equal fingerprints are one node, so copies cost no links; only nodes and links are joined, never rows.
    Segments should be near log2 of the number of distinct fingerprints: 3 up to some hundred million, 2 beyond.
    """
    rows = store(documents.select("doc_id", *keys, fingerprints("text").alias("fp")), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes.select("fp"), radius, segments))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = labelled.join(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", *keys, "fp", "root", "component_id")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fingerprint, component_id), one row per row."""
    return grouped(documents, [], radius, segments).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
