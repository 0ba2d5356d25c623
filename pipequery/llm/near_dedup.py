"""MinHash near-duplicates with odd sketches.

1. One pass over the texts gives each document its number of distinct word shingles, a digest of the
   set, band keys of its MinHash samples, and an odd sketch: each sample flips one bit of a bitmap,
   so the population count of two bitmaps' XOR tells how many samples differ.
2. Documents with equal sets collapse to their smallest id; one representative goes on.
3. In each band bucket all members are paired with the smallest and the largest one; pairs whose
   sketches are too far apart go; the rest are confirmed on full shingle sets.
4. In buckets whose members are still in several components, members meet a leader drawn anew in
   each round, across components only, until a round links nothing more.
5. Buckets that are still in several components are compared in full, in blocks, across components
   only, by counting common shingles inside the block; only pairs that are similar leave it, and are
   again confirmed on full sets. So no bucket has a cap, and pairs that leave a task are links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import SPACED, by_ids, hash_words, ids_and_texts, materialize, mix, shingle_hashes, text_slices
from pipequery.llm.components import connected_components

SKETCH_BITS = 2048
SAMPLES = 256  #: in a sketch; bands are made of the first of them
BANDS, ROWS = 32, 4
ROUNDS = 2  #: of drawn leaders
BLOCK = 256  #: members of a bucket compared at once


def _samples_of(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of ``k`` hash functions on 32 bits; fixed."""
    with np.errstate(over="ignore"):
        seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[k:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, k: int):
    """For each text its sorted distinct shingle hashes: fewer than ``k`` words make one shingle, no word none."""
    for _, data, ends in text_slices(texts):
        words, _, _, upto = hash_words(data, ends, SPACED)
        grams, at = shingle_hashes(words, k), 0
        for to in upto:
            if to - at >= k:
                yield np.unique(grams[at : to - k + 1])
            elif to > at:
                yield shingle_hashes(words[at:to], to - at)
            else:
                yield grams[:0]
            at = to


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The parity bitmap of (index, sample) pairs, as signed 64-bit words."""
    with np.errstate(over="ignore"):
        spots = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view("<i8")


def sketch_limit(similarity: float, samples: int, bits: int = SKETCH_BITS, deviations: float = 4.5) -> int:
    """The most XOR bits that a pair of at least this similarity shows, but for ``deviations`` of error."""
    unlike = samples * (1 - similarity)
    unlike += deviations * math.sqrt(samples * similarity * (1 - similarity))
    mean = bits / 2 * (1 - math.exp(-4 * min(unlike, samples) / bits))
    return min(bits, math.ceil(mean + deviations * math.sqrt(bits) / 4))


def signatures(docs: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, sketch)`` of each row; nulls for sets without a member."""

    def sign(batches):
        mul, add = _samples_of(max(SAMPLES, bands * rows))
        mul, add = mul[:, None], add[:, None]
        band = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            counts, digests, keys, sketches = [], [], [], []
            for found in shingle_sets(batch.column(1), k):
                counts.append(len(found))
                if not len(found):
                    digests.append(None), keys.append(None), sketches.append(None)
                    continue
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                short = (found >> np.uint64(32)).astype(np.uint32)
                least = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
                with np.errstate(over="ignore"):
                    for i in range(0, len(short), 4096):  # a very long text needs no more memory
                        np.minimum(least, (short[None, i : i + 4096] * mul + add).min(axis=1), out=least)
                    key = band.copy()
                    for row in least[: bands * rows].reshape(bands, rows).T:
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + row)
                keys.append(key.view(np.int64))
                sketches.append(odd_sketch(least))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    rows_in = ids_and_texts(docs)
    return rows_in.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``(id, shingles, short)`` of the documents in ``ids``; short: the upper halves of the hashes."""

    def sets(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(1), k))
            full = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            short = pa.array([(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), full, short], ["id", "shingles", "short"])

    chosen = by_ids(ids_and_texts(docs).withColumnRenamed("doc_id", "id"), ids, "id")
    return chosen.mapInArrow(sets, "id long, shingles array<long>, short array<int>")


def _near(sketch_a: str, sketch_b: str, limit: int):
    words = SKETCH_BITS // 64
    far = sum((F.bit_count(F.col(sketch_a)[i].bitwiseXOR(F.col(sketch_b)[i])) for i in range(1, words)), F.bit_count(F.col(sketch_a)[0].bitwiseXOR(F.col(sketch_b)[0])))
    return far <= limit


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are as similar as asked."""
    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    return checked.select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs(doc_id, text, ...)``.

    Documents whose sets of ``k``-word shingles have 100 * intersection >= ``percent`` * union are
    linked; ``component_id`` is the smallest doc_id reachable, ``kept`` says that it is the row's own.
    A null or empty text, or one of white space, has an empty set and is linked with nothing. Rows
    with equal doc_id share what any of them is linked with. A null doc_id is linked with nothing:
    its component is null and it is kept. Other columns are ignored. An empty table gives no rows.
    A pair at ``percent`` is missed with a probability of (1 - (percent/100)**rows)**bands, 5e-6 here.
    """
    signed = materialize(signatures(docs, k, bands, rows), "near-signatures")
    limit = sketch_limit(percent / 100, max(SAMPLES, bands * rows))
    classes = materialize(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "near-classes")
    one = materialize(
        signed.where("digest is not null").join(classes, "digest").where("doc_id = id").select("id", "bands", "sketch").dropDuplicates(["id", "bands"]), "near-representatives"
    )
    keyed = one.select("id", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "near-buckets")
    members = materialize(keyed.join(buckets, "key"), "near-members")

    # equal ids have equal sets here (representatives of a digest), so one row of each is enough
    sets = materialize(_full_sets(docs, materialize(members.select("id").distinct(), "near-ids"), k), "near-sets")
    sketch = lambda name, as_: one.select(F.col("id").alias(name), F.col("sketch").alias(as_))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(sketch("a", "ka"), "a").join(sketch("b", "kb"), "b").where(_near("ka", "kb", limit)).select("a", "b")

    ends = F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))
    stars = near(members.select(F.explode(ends).alias("p")).select("p.a", "p.b").where("a < b").distinct())
    labels = connected_components(_confirmed(stars, sets, percent))
    members = members.where("n > 3").select("key", "id", "n")  # in smaller buckets each pair has met
    for turn in range(ROUNDS + 1):
        # buckets whose members are in several components
        known = materialize(members.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "near-known")
        drawn = F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(turn)))
        open_ = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), drawn.alias("leader")).where("x < y").select("key", "leader")
        if turn < ROUNDS:
            met = known.join(open_, "key").where("component != leader.component")
            pairs = near(met.select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).distinct())
        else:
            pairs = _across(known.join(open_.select("key"), "key"), sets, percent)
        links = materialize(_confirmed(pairs, sets, percent), "near-links")
        if links.limit(1).count():
            labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        members = known.join(open_, "key", "left_semi").select("key", "id", "n")

    labels = labels.select(F.col("node").alias("id"), "component")
    classes = classes.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of members of a bucket in different components that have as many shingles in common as asked, by their short hashes.

    A bucket is dealt into blocks of about BLOCK members; each two blocks meet in one row.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
        .join(sets.select("id", "short"), "id")
        .groupBy("key", "i", "j")
        .agg(F.collect_list(F.struct("id", "component", "block", "short")).alias("m"))
        .where(F.size("m") > 1)
        .select("i", "j", "m")
    )

    def compare(batches):
        for batch in batches:
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            m = batch.column(2)
            i, j = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for g in range(len(m)):
                part = m[g].values
                ids, component, block = (np.asarray(part.field(x)) for x in (0, 1, 2))
                order = np.argsort(block == j[g], kind="stable")  # the left block's members first
                lists = part.field(3).take(pa.array(order))
                ids, component, block = ids[order], component[order], block[order]
                size = np.diff(np.asarray(lists.offsets))
                at = np.concatenate([[0], np.cumsum(size)])
                names = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
                has = np.zeros(int(names.max()) + 1, bool)
                half = int((block == i[g]).sum()) if i[g] != j[g] else len(ids)
                for x in range(half):
                    first = half if i[g] != j[g] else x + 1
                    others = np.arange(first, len(ids))
                    others = others[(component[others] != component[x]) & (4 * np.minimum(size[others], size[x]) * 25 >= percent * np.maximum(size[others], size[x]))]
                    if not len(others):
                        continue
                    has[names[at[x] : at[x + 1]]] = True
                    both = np.add.reduceat(has[names[at[first] :]].astype(np.int64), at[first:-1] - at[first])[others - first]
                    has[names[at[x] : at[x + 1]]] = False
                    near = others[100 * both >= percent * (size[others] + size[x] - both)]
                    found_a.append(np.minimum(ids[near], ids[x])), found_b.append(np.maximum(ids[near], ids[x]))
            pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").where("a < b").distinct()
