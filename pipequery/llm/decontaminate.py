"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask picks from a run of words; the places it leaves
out may differ. Test and training texts are joined on their seeds, and around each hit the words of
both are compared on the hit's diagonal, so substituted words are tolerated.

A training position takes part in the join only if a Bloom filter of the test seeds has it. The
filter grows with the benchmark up to a fixed size; beyond that it lets more through and costs no hit.

Items often share a template, and so do documents. Seeds therefore join items by classes: a seed
stands for the set of (item, place) that have it, and what a document meets is reduced to the items
whose words its hits can still cover before any words are fetched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import ALNUM, BROADCAST_ROWS, hash_words, ids_and_texts, materialize, mix, text_slices

MASKS = ("1101100101", "1110010011", "1011001101", "111111")
LEAST_WORDS = 5  #: items with fewer words contaminate nothing
FILTER_BITS = 1 << 23
FILTER_HASHES = 3


def all_masks(short: list[int]) -> list[tuple[int, ...]]:
    """Places that masks pick: the fixed masks, and unbroken ones for items of ``short`` numbers of words."""
    fixed = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
    return fixed + [tuple(range(n)) for n in sorted(set(short))]


def seeds_of(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The seed at each place where the mask fits into ``words``."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, number + 1, np.uint64)
        for i in mask:
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


def filter_bits(seeds: np.ndarray) -> list[np.ndarray]:
    return [(seeds >> np.uint64(20 * i)).astype(np.int64) % FILTER_BITS for i in range(FILTER_HASHES)]


def segments(same: np.ndarray) -> list[tuple[int, int]]:
    """The best segment by matches less mismatches, then the best ones to its left and right, and so on, as long as they reach LEAST_WORDS; all of ``same`` if it has no mismatch."""
    if len(same) and same.all():
        return [(0, len(same))]
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        sums = np.concatenate([[0], np.cumsum(np.where(same[lo:hi], 1, -1))])
        low = np.minimum.accumulate(sums)
        stop = int(np.argmax(sums - low))
        if sums[stop] - low[stop] < LEAST_WORDS:
            continue
        start = int(np.flatnonzero(sums[: stop + 1] == low[stop])[-1])
        out.append((lo + start, lo + stop))
        todo += [(lo, lo + start), (lo + stop, hi)]
    return out


def aligned(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int]:
    """``(words of the item matched, first, end, mismatches)`` over the segments of some diagonals, or over one diagonal as a whole.

    On each diagonal all segments count whose matches exceed their mismatches by LEAST_WORDS and are
    6 at least; the item's words that segments match are counted once. If one diagonal alone has
    more words in place, between its first and its last one, it counts. first and end: in the document.
    """
    met, first, end, wrong = np.zeros(len(item), bool), len(doc), 0, 0
    whole = (0, 0, 0, 0)
    for d in diagonals:
        a, b = max(0, d), min(len(doc), d + len(item))
        same = doc[a:b] == item[a - d : b - d]
        for start, stop in segments(same):
            part = same[start:stop]
            if part.sum() >= min(6, len(item)):
                met[a - d + start : a - d + stop] |= part
                first, end, wrong = min(first, a + start), max(end, a + stop), wrong + int((~part).sum())
        n = int(same.sum())
        if n > whole[0]:
            at = np.flatnonzero(same)
            whole = (n, int(a + at[0]), int(a + at[-1] + 1), int(at[-1] + 1 - at[0] - n))
    found = (int(met.sum()), int(first), int(end), wrong)
    return whole if whole[0] > found[0] else found


def contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, least_words: int = 13) -> DataFrame:
    """``(doc_id, item_id, start, end, matched, item_words, mismatches)``: documents that hold much of an item.

    A row per row of ``docs(doc_id, text, ...)`` and item of ``benchmark(item_id, text, ...)`` of
    whose words at least ``least_share``, and at least ``least_words`` (or all, if it has fewer)
    stand in the document in the item's order, but for substituted words. Words are runs of 0-9,
    a-z and letters beyond ASCII, A-Z lowered; start and end count them, end exclusive. Items of
    under LEAST_WORDS words match nothing. Null texts are empty; rows with null ids are compared
    like others; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    spans = {len(m) for m in MASKS}
    short_most = min(spans)

    def item_words(batches):
        for batch in batches:
            out = []
            for _, data, ends in text_slices(batch.column(1)):
                words, _, _, upto = hash_words(data, ends, ALNUM)
                out += np.split(words.view(np.int64), upto[:-1]) if len(upto) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(items.mapInArrow(item_words, "item_id long, words array<long>").where(F.size("words") >= LEAST_WORDS).withColumn("item", F.monotonically_increasing_id()), "decon-items")
    # lengths below the shortest mask: a handful of numbers at most
    short = [r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < max(spans)).distinct().collect()]
    masks = all_masks([n for n in short if n < short_most] or [])

    def item_seeds(batches):
        for batch in batches:
            item, at, hashes = [], [], []
            for i, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = np.asarray(words.values).view(np.uint64)
                for number, mask in enumerate(masks):
                    if number < len(MASKS) or len(words) == len(mask):
                        found = seeds_of(words, mask, number)
                        item += [i] * len(found)
                        at.append(np.arange(len(found)))
                        hashes.append(found.view(np.int64))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes + none)), pa.array(item, pa.int64()), pa.array(np.concatenate(at + none))], ["seed", "item", "at"])

    seeds = materialize(items.select("item", "words").mapInArrow(item_seeds, "seed long, item long, at long"), "decon-seeds")

    def bits(batches):
        for batch in batches:
            found = np.unique(np.concatenate(filter_bits(np.asarray(batch.column(0)).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["bit"])

    # at most FILTER_BITS numbers, however large the benchmark is
    at = seeds.select("seed").mapInArrow(bits, "bit long").distinct().toArrow().column(0).to_numpy()
    held = np.zeros(FILTER_BITS, bool)
    held[at] = True
    bloom = spark.sparkContext.broadcast(np.packbits(held))

    def probe(batches):
        table = np.unpackbits(bloom.value).view(bool)
        for batch in batches:
            ids, out = batch.column(0), []
            for first, data, ends in text_slices(batch.column(1)):
                words, _, _, upto = hash_words(data, ends, ALNUM)
                rows = np.concatenate([[0], upto])
                row_of = np.repeat(np.arange(len(upto)), np.diff(rows))
                found_at, found = [], []
                for number, mask in enumerate(masks):
                    hashes = seeds_of(words, mask, number)
                    places = np.flatnonzero(np.logical_and.reduce([table[b] for b in filter_bits(hashes)])) if len(hashes) else np.zeros(0, np.int64)
                    places = places[row_of[places] == row_of[places + mask[-1]]] if len(places) else places
                    found_at.append(places), found.append(hashes[places])
                found_at, found = np.concatenate(found_at), np.concatenate(found)
                order = np.argsort(row_of[found_at], kind="stable")
                found_at, found = found_at[order], found[order]
                for row in np.unique(row_of[found_at]) if len(found_at) else ():
                    mine = row_of[found_at] == row if len(found_at) < 64 else slice(*np.searchsorted(row_of[found_at], [row, row + 1]))
                    hits = {"seed": found[mine].view(np.int64), "at": found_at[mine] - rows[row]}
                    out.append((ids[first + int(row)].as_py(), hits, words[rows[row] : rows[row + 1]].view(np.int64)))
            if out:
                n = [len(h["at"]) for _, h, _ in out]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([h[k] for _, h, _ in out])) for k in ("seed", "at")], ["seed", "at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _, _ in out], pa.int64()), pa.ListArray.from_arrays(offsets, pairs), pa.array([w for _, _, w in out], pa.list_(pa.int64()))], ["doc_id", "hits", "words"]
                )

    rows = ids_and_texts(docs)
    probed = rows.mapInArrow(probe, "doc_id long, hits array<struct<seed: bigint, at: bigint>>, words array<bigint>")
    probed = materialize(probed.withColumn("row", F.monotonically_increasing_id()), "decon-probed")

    hits = probed.select("row", F.explode("hits").alias("h")).select("row", F.col("h.seed").alias("seed"), F.col("h.at").alias("place"))
    small = seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = hits.join(F.broadcast(seeds) if small else seeds, "seed").groupBy("row", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    few = items.limit(BROADCAST_ROWS // 20 + 1).count() <= BROADCAST_ROWS // 20
    texts = items.select("item", "item_id", F.col("words").alias("item_words"))
    pairs = met.join(probed.select("row", "doc_id", "words"), "row").join(F.broadcast(texts) if few else texts, "item")

    def verify(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, item, words, theirs, diagonals in zip(*(batch.column(c) for c in ("doc_id", "item_id", "words", "item_words", "diagonals")), strict=True):
                a, b = np.asarray(words.values), np.asarray(theirs.values)
                matched, start, end, wrong = aligned(a, b, np.asarray(diagonals.values))
                if matched >= max(least_share * len(b), min(least_words, len(b))):
                    for column, value in zip(out, (doc.as_py(), item.as_py(), start, end, matched, len(b), wrong), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "start", "end", "matched", "item_words", "mismatches"])

    schema = "doc_id long, item_id long, start long, end long, matched long, item_words long, mismatches long"
    return pairs.select("doc_id", "item_id", "words", "item_words", "diagonals").mapInArrow(verify, schema)
