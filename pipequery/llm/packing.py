"""Packing of tokenised documents: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so the instance is its histogram: at most ``capacity``
counts, whatever the number of documents. The reduction of Martello and Toth is run on counts:
a set {j}, {j, k} or {j, k, l} that provably dominates every other set that holds j is fixed as a
sequence, as often as its members last; the rest is packed by best fit, largest first, whole groups
of equal sequences at a time. The plan is a list of ranges over each size's ranks; the documents'
ranks are counted in salted buckets, and each piece finds its place from size and rank alone.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipequery.llm.common import ids_and_texts, materialize

RANK_ROWS = 500  #: pieces of a size that are ranked together, about


# --- the instance on the driver: a histogram, bounded by the capacity -------------------------


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """``([(sizes of a sequence, how many)], what is left)``: sequences of some best packing.

    For each size j from the largest on: if no other size fits beside j, {j} is fixed. Else, with k
    the largest size that fits beside j, {j, k} is fixed if j + k fills the sequence or no two
    others fit beside j; it then dominates, as all that could stand beside j fits into k's place.
    {j, k, l}, l the largest that still fits, is fixed if at most two others fit beside j, and no
    pair of sizes above l fits. Fixing shrinks the instance, so it goes on until nothing changes.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def smallest(n: int, less: int) -> list[int] | None:
        """The ``n`` smallest sizes with one ``less`` taken out; None if there are fewer."""
        out: list[int] = []
        for s in order:
            out += [s] * min(n - len(out), left.get(s, 0) - (s == less))
            if len(out) == n:
                return out
        return None

    def take(sizes: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for s in sizes:
            need[s] += 1
        times = min(left[s] // n for s, n in need.items())
        fixed.append((sizes, times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                order.pop(bisect_right(order, s) - 1)

    def largest(room: int, less: dict[int, int], above: int = 0) -> int | None:
        """The largest size in (above, room] of which more are left than ``less`` says."""
        i = bisect_right(order, room) - 1
        while i >= 0 and order[i] > above:
            if left[order[i]] > less.get(order[i], 0):
                return order[i]
            i -= 1
        return None

    order = sorted(left)
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                k = largest(room, {j: 1})
                if k is None:
                    take((j,))
                elif k == room or (two := smallest(2, j)) is None or sum(two) > room:
                    if k == j and left[j] < 2:
                        take((j,))
                    else:
                        take((j, k))
                elif (three := smallest(3, j)) is None or sum(three) > room:
                    used = {j: 1}
                    used[k] = used.get(k, 0) + 1
                    l = largest(room - k, used)
                    if l is None:
                        break
                    # pairs x >= y > l beside j: the two smallest sizes above l
                    above = [s for s in order[bisect_right(order, l) :] for _ in range(min(2, left[s] - (s == j)))][:2]
                    if len(above) == 2 and sum(above) <= room:
                        break
                    take((j, k, l))
                else:
                    break
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``[(((size, times), ...), how many sequences)]`` of best fit by falling size, on whole groups of equal sequences."""
    groups: dict[int, list[list]] = defaultdict(list)  # room -> [[content, how many]]
    rooms: list[int] = []  # sorted rooms that have groups

    def put(room: int, content: tuple, n: int) -> None:
        if not groups[room]:
            rooms.insert(bisect_right(rooms, room), room)
        groups[room].append([content, n])

    def pull(room: int) -> tuple[tuple, int]:
        content, n = groups[room].pop()
        if not groups[room]:
            rooms.pop(bisect_right(rooms, room) - 1)
        return content, n

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_right(rooms, s - 1)
            if i < len(rooms):
                room = rooms[i]
                content, many = pull(room)
            else:
                room, content, many = capacity, (), -(-n // (capacity // s))
            each = room // s
            full = min(many, n // each)
            if full:
                put(room - each * s, (*content, (s, each)), full)
                n -= full * each
                many -= full
            if many and n and n < each:
                put(room - n * s, (*content, (s, n)), 1)
                n, many = 0, many - 1
            if many and content:
                put(room, content, many)
    return [(content, n) for room in list(rooms) for content, n in groups[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges ``(size, first rank, number, first sequence, times a sequence, offset)`` that hold every item once."""
    fixed, left = reduce_dominated(counts, capacity)
    sequences: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for sizes, n in fixed:
        runs: list[list[int]] = []
        for s in sizes:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        sequences.append((tuple((a, b) for a, b in runs), n))
    sequences += best_fit(left, capacity)
    ranks, out, first = defaultdict(int), [], 0
    for content, n in sequences:
        offset = 0
        for s, times in content:
            out.append((s, ranks[s], n * times, first, times, offset))
            ranks[s] += n * times
            offset += s * times
        first += n
    return out


# --- documents ---------------------------------------------------------------------------------


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[], Callable[[str], list[int]]]:
    """A maker of the encoder of ``name``'s vocabulary; the JSON file's added tokens are matched in a text, as its tokenizer does.

    The maker is called on the executors. The ranks file has the vocabulary of the JSON file, and
    gives the same ids (tests/llm compares them) in a fifth of the time.
    """

    def make() -> Callable[[str], list[int]]:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: made.encode(text, allowed_special="all")

    return make


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: only one longer than the capacity is cut, its first piece is the rest."""
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for at in range(first, n, capacity):
        yield at, capacity


def tokenize(docs: DataFrame, capacity: int = 1024, end_id: int = 2, encoder: Callable | None = None, ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of each document's pieces; a null text is empty and has the end id alone."""
    make = encoder or byte_bpe()

    def pieces(batches):
        encode = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what is held at once
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = np.array(array("I", encode(text.as_py() or "") + [end_id]), dtype="<u4")
                    for piece, (start, n) in enumerate(cut(len(found), capacity)):
                        here = found[start : start + n]
                        out.append((doc, piece, start, n, zlib.crc32(here.tobytes()), here.astype(np.int32) if ids else None))
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return ids_and_texts(docs).mapInArrow(pieces, schema)


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``capacity``.

    ``pieces`` must give the same rows whenever it is read (a table, as ``pack`` makes). Columns of
    these names are replaced. Ties: pieces of equal size are ranked by (doc_id, piece), equal rows
    in any order. No piece is dropped; an empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset", "_bucket", "_rank", "_before")
    total = pieces.count()
    buckets = max(1, -(-total // RANK_ROWS))
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    # one row for each size and bucket that occurs, summed in two steps: over the buckets of a block, then over blocks
    block = max(1, int(buckets**0.5))
    held = salted.groupBy("length", "_bucket").agg(F.count("*").alias("n")).withColumn("_block", F.floor(F.col("_bucket") / block))
    within = Window.partitionBy("length", "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy("length", "_block").agg(F.sum("n").alias("m"))
    above = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_above", F.coalesce(F.sum("m").over(above), F.lit(0))).drop("m")
    before = held.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, ["length", "_block"])
    before = before.select("length", "_bucket", (F.col("_in") + F.col("_above")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_rank", rank.cast("long")).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1).drop("_bucket", "_before")

    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    ranges = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    names = [c for c in ranked.columns if c != "_rank"]

    def find(batches):
        key = ranges[:, 0] << 44 | ranges[:, 1]  # sizes and ranks in order
        for batch in batches:
            size, at = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            r = ranges[np.searchsorted(key, size << 44 | at, side="right") - 1].reshape(-1, 6)
            nth = at - r[:, 1]
            columns = [*(batch.column(c) for c in names), pa.array(r[:, 3] + nth // r[:, 4], pa.int64()), pa.array(r[:, 5] + nth % r[:, 4] * size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(find, schema)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, encoder: Callable | None = None, ids: bool = True) -> DataFrame:
    """All ``docs(doc_id, text, ...)`` packed into few sequences of at most ``capacity`` tokens; one row per piece.

    ``ids`` keeps the token ids of each piece; without them the pieces are digests (a CRC) and move
    less. Rows with equal or null doc_id are packed each on its own. An empty table gives no rows.
    """
    return place(materialize(tokenize(docs, capacity, end_id, encoder, ids), "packing-pieces"), capacity)
