"""What the operators share: the shared folder, materialised tables, and vectorised word hashes."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the functions of this subpackage by value: they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules["pipequery.llm"])

BROADCAST_ROWS = 200_000  #: ids; beyond, joins shuffle
BATCH_BYTES = 4 << 20  #: of an Arrow batch that goes to Python; a row with more is a batch of its own
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is unset, a local session gets a temporary folder, a cluster one under the warehouse.
    """
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = "file://" + tempfile.mkdtemp(prefix="pipequery-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: the lineage is cut, and survives lost executors.

    The shuffle files of the job are removed when it ends, as nothing reads them any more; else they
    stay until the driver's JVM collects garbage. ``passing`` gets the table's path, for ``discard``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    known = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if known is None else spark.conf.set(_CLEANUP, known)
    if passing is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, passing: list[str]) -> None:
    """Delete tables that nothing reads any more: what was made of them is materialised."""
    while passing:
        path = spark._jvm.org.apache.hadoop.fs.Path(passing.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of at most BATCH_BYTES to Python, unless it sends smaller ones already.

    Ten thousand whole texts at once would take hundreds of MB in JVM and worker.
    """
    known = spark.conf.get(_BATCH).lower().rstrip("b")
    if not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``docs`` for Python, the id as a number and the text as a string."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` joined to ``ids`` (a materialised table) on ``key``.

    ``ids`` is broadcast only when its counted rows are at most BROADCAST_ROWS; else both sides shuffle.
    """
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- words of many texts at once -------------------------------------------------------------

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: bytes of words that white space ends, A-Z lowered, plus one; 0 for white space
SPACED = np.array([0 if b in SPACE else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=np.uint16)
#: bytes of words made of 0-9, a-z and all beyond ASCII, A-Z lowered, plus one; 0 for the rest
ALNUM = np.array(
    [(b + 32 if 65 <= b <= 90 else b) + 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)],
    dtype=np.uint16,
)
SLICE = 1 << 20  #: bytes of text handled at once
PIECE = 1 << 16  #: bytes of text whose sums are made at once: they stay in a core's cache
BASE = np.uint64(0x9E3779B97F4A7C15)  #: odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; ``x`` is an uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(data: np.ndarray, row_ends: np.ndarray, table: np.ndarray):
    """(hash, first byte, end byte) of each word, and the number of words before each row's end.

    ``data``: the bytes of texts, end to end; ``row_ends``: where each text ends, ascending. A word
    doesn't go beyond its row. Memory beside the words' own arrays is that of PIECE bytes, or of one word.
    """
    starts, ends, at, n = [], [], 0, len(data)
    is_word, less_one = (table != 0).astype(np.uint8).tobytes(), (np.maximum(table, 1) - 1).astype(np.uint8).tobytes()
    cuts = np.zeros(0, dtype=np.int64) if len(row_ends) == 0 else row_ends[(row_ends > 0) & (row_ends < n)]
    while at < n:
        stop = min(n, at + 4 * PIECE)
        word = np.frombuffer(data[at:stop].tobytes().translate(is_word), dtype=bool)
        before = np.empty(len(word), dtype=bool)
        before[0] = at > 0 and table[data[at - 1]] != 0
        before[1:] = word[:-1]
        after = np.empty(len(word), dtype=bool)
        after[-1] = stop < n and table[data[stop]] != 0
        after[:-1] = word[1:]
        first = cuts[(cuts >= at) & (cuts < stop)] - at
        before[first] = False
        last = cuts[(cuts > at) & (cuts <= stop)] - at - 1
        after[last] = False
        starts.append(np.flatnonzero(word & ~before) + at)
        ends.append(np.flatnonzero(word & ~after) + at + 1)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(end, lo + PIECE, side="right")))
            hi = end[j - 1]
            up, down = _powers(int(hi - lo) + 1)
            sums = np.empty(int(hi - lo) + 1, dtype=np.uint64)
            sums[0] = 0
            value = np.frombuffer(data[lo:hi].tobytes().translate(less_one), dtype=np.uint8).astype(np.uint64)  # of words only
            value += np.uint64(1)
            value *= up[: hi - lo]
            np.cumsum(value, out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s])
            i = j
    return out, start, end, np.searchsorted(start, row_ends)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _KEPT.get("n", 0)
    if have < n:
        size = SLICE + 1
        if n > size:  # a word longer than a slice: not kept
            return powers(BASE, n), powers(BASE_INVERSE, n)
        _KEPT.update(n=size, up=powers(BASE, size), down=powers(BASE_INVERSE, size))
    return _KEPT["up"], _KEPT["down"]


class _Kept(dict):
    """A cache of a Python process; it is never sent along with a function."""

    def __reduce__(self):
        return (_Kept, ())


_KEPT = _Kept()


def text_slices(texts: pa.Array, size: int = SLICE):
    """(first row, bytes, row ends) for runs of rows of about ``size`` bytes; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words; the caller leaves out those that cross rows.

    A polynomial of the run's words, made of those of runs of 1, 2, 4, ... words.
    """
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        run, size, power = words, 1, np.uint64(0xD6E8FEB86659FD93)
        out, done = None, 0
        while True:
            if k & size:
                out = run if out is None else out[: len(run) - done] * power + run[done:]
                done += size
            if done == k:
                return mix(out)
            run, size, power = run[:-size] * power + run[size:], 2 * size, power * power


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo ``m``, as a native expression."""
    return F.crc32(F.col(column).cast("string")) % m
