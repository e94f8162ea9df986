"""SimHash duplicates as the crawler finds them: 64 bits, distance 3, first page wins."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleaner.plans.shared import checkpoint_folder

DISTANCE = 3


_WORDS = re.compile("[a-zäöüß0-9]+")


def _blake(feature: bytes) -> bytes:
    return hashlib.blake2b(feature, digest_size=8).digest()


def _md5(feature: bytes) -> bytes:
    return hashlib.md5(feature, usedforsecurity=False).digest()[:8]


#: Shingles that are hashed, and texts that are taken out of a batch, at once.
SHINGLES, TEXTS = 1 << 12, 1 << 6


def _print_of(body: str | None, digest=_blake) -> int:
    words = _WORDS.findall((body or "").lower())
    features = iter(words) if len(words) < 3 else map(" ".join, zip(words, islice(words, 1, None), islice(words, 2, None)))
    ones, n = np.zeros(64, np.int64), 0
    while some := [digest(f.encode()) for f in islice(features, SHINGLES)]:
        ones += np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _prints_of(bodies: pa.Array, digest=_blake) -> pa.Array:
    """What is held besides the batch are a few texts and a piece of one text's shingles."""
    out = np.empty(len(bodies), np.int64)
    for at in range(0, len(bodies), TEXTS):
        for k, body in enumerate(bodies.slice(at, TEXTS).to_pylist(), at):
            out[k] = _print_of(body, digest)
    return pa.array(out)


def fingerprint(body: Column | str) -> Column:
    """64-bit SimHash of 3-word shingles hashed with blake2b, as a signed number; 0 without words."""
    return F.arrow_udf(lambda bodies: _prints_of(bodies), LongType())(body)


def fingerprint_md5(body: Column | str) -> Column:
    """The same with md5, which SQL engines have."""
    return F.arrow_udf(lambda bodies: _prints_of(bodies, _md5), LongType())(body)


BLOCKS = (0, 11, 22, 33, 44, 54, 64)


def near_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b, distance), a < b, of fingerprints (id, fp) that differ in at most 3 bits.

    Rows of one fingerprint are a class: its least id stands for it in the pairs
    of distance 1 to 3, and has a row of distance 0 with each of the others.
    Three bits touch three of six blocks at most, so two near fingerprints agree
    in the other three: the join is by each choice of three, 31 to 33 bits.
    Fingerprints are kept, so that no text is hashed twice.
    """
    if not 0 <= distance <= 3:
        raise ValueError("three of six blocks find distances up to 3")
    checkpoint_folder(prints.sparkSession)
    prints = prints.checkpoint()
    same = prints.groupBy("fp").agg(F.min("id").alias("id"))
    block = [((1 << z) - (1 << a)) for a, z in zip(BLOCKS, BLOCKS[1:])]
    masks = [sum(block[k] for k in three) for three in combinations(range(6), 3)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for k, m in enumerate(masks)))
    keyed = same.select("id", "fp", F.explode(keys).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    d = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    near = x.join(y, "key").where((F.col("x.id") < F.col("y.id")) & (F.col("x.fp") != F.col("y.fp")) & (d <= distance))
    far = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), d.alias("distance")).distinct()
    members = prints.join(same.select("fp", F.col("id").alias("a")), "fp").where(F.col("id") != F.col("a"))
    return far.unionByName(members.select("a", F.col("id").alias("b"), F.lit(0).alias("distance")))


def greedy_keep(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(id, kept): a page goes when it is near an earlier page that stayed.

    Settled in rounds: a page all of whose earlier neighbours are gone stays, one
    with an earlier neighbour that stays goes.  The number of rounds is the length
    of the longest chain of near pages, not the number of pages.  With equal
    fingerprints only the first can stay, so the chains run over distinct ones.
    """
    checkpoint_folder(prints.sparkSession)
    first = prints.groupBy("fp").agg(F.min("id").alias("id")).checkpoint()
    edges = near_pairs(first, distance).select("a", "b").checkpoint()
    open_ids = edges.select(F.col("b").alias("id")).distinct().checkpoint()
    settled = edges.select(F.col("a").alias("id")).distinct().join(open_ids, "id", "left_anti").withColumn("kept", F.lit(True)).checkpoint()
    rest = edges
    while not rest.isEmpty():
        known = rest.join(settled.withColumnRenamed("id", "a"), "a", "left")
        state = known.groupBy("b").agg(F.max(F.coalesce("kept", F.lit(False))).alias("near_kept"), F.min(F.col("kept").isNotNull()).alias("all_known"))
        new = state.where("near_kept or all_known").select(F.col("b").alias("id"), (~F.col("near_kept")).alias("kept"))
        settled = settled.unionByName(new).checkpoint()
        rest = rest.join(new.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b").checkpoint()
    kept = first.join(settled, "id", "left").where("coalesce(kept, true)").select("id", F.lit(True).alias("kept"))
    return prints.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))
