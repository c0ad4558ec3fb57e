"""What the training-data operators share: tables, shared storage, word hashing and scalable ranking.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All hashing is a pure function of the bytes, so a recomputed
task gives the same values as the lost one.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1
_U = np.uint64


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: whole texts are long, and a batch is held on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local one only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "simforge-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/simforge-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what cut has stored for this application; for when all results that read it are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(shared_dir(spark)))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to shared storage and reads it back: lineage ends there, and a lost executor loses nothing."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front until no column of df has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ranked(df: DataFrame, group: list[str], by: str, out: str, slices: int = 64) -> DataFrame:
    """row_number() - 1 over (partition by group order by the long column by) into out, without one task for a hot group.

    by is cut into slices by its value's high bits: rows are numbered inside (group, slice), and a slice starts where the
    rows of the lower slices end.  by has to be spread evenly over all longs, as a hash is.  Equal values of by keep an
    arbitrary order, so make by a function of all columns that matter.
    """
    cell, first, n = fresh(df, "cell"), fresh(df, "first"), fresh(df, "n_cell")
    df = df.withColumn(cell, F.floor((F.col(by) / F.lit(2.0**64) + 0.5) * slices).cast("int"))
    keys = [*group, cell]
    renamed = [fresh(df, f"rank_key_{i}") for i in range(len(keys))]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy(*keys).orderBy(by)
    df = df.withColumn(out, F.row_number().over(inside) - F.lit(1))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)])
    return df.join(counts, on).withColumn(out, (F.col(out) + F.col(first)).cast("long")).drop(cell, first, *renamed)


# ---------------------------------------------------------------- word hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HEAD_OF = np.array([256**k - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
#: Keys of two independent hashes; together they are 128 bits.
KEYS = (0x243F6A8885A308D3, 0x13198A2E03707344)
LONG_WORD = 1 << 12


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes."""
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEYS[0]) -> np.ndarray:
    """A keyed 64-bit hash of each span of the bytes.

    Eight bytes at a time enter by a bijection of the state, so that spans of one length that differ in a block never meet
    before a later block does; nothing is a polynomial.  Spans beyond LONG_WORD take a library hash.
    """
    blocks = np.ndarray(len(buf) + 1, dtype="<u8", buffer=np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    n = ends - starts
    out = mix(n.astype(np.uint64) + _U(key))
    live, at, left = np.flatnonzero(n <= LONG_WORD), starts, n
    if len(live) < len(n):
        for i in np.flatnonzero(n > LONG_WORD).tolist():
            digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
        at, left = at[live], left[live]
    while len(live):
        out[live] = mix(out[live] ^ (blocks[at] & _HEAD_OF[np.minimum(left, 8)])) + _A
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(out)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEYS[0]) -> np.ndarray:
    """A keyed 64-bit hash of each run of word hashes, from the hashes of runs of 1, 2, 4, ... words (its length's binary digits)."""
    n = ends - starts
    out, at = mix(n.astype(np.uint64) + _U(key)), starts.copy()
    longest, size, level = int(n.max()) if len(n) else 0, 1, words
    while size <= longest:
        some = np.flatnonzero(n & size)
        if len(some):
            out[some] = mix(out[some] * _A + level[at[some]])
            at[some] += size
        if 2 * size <= longest:
            level = mix(level[:-size] * _A + mix(level[size:] ^ _U(key ^ size)))
        size *= 2
    return mix(out)


def words_of(texts: list[bytes | None], key: int = KEYS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: the joined bytes, starts, ends, hashes, and where each text's words begin (one more at the end)."""
    joined = b" ".join(t or b"" for t in texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = spans(buf)
    at = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return buf, starts, ends, hashes(buf, starts, ends, key), np.searchsorted(starts, at)


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers otherwise hold what their last task took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def chunks(batches, text: str, most: int = 1 << 20):
    """Arrow batches dealt anew: tables of rows whose texts have most bytes together; a longer text stands alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        i = 0
        while i < batch.num_rows:
            total, j = int(sizes[i]), i + 1
            while j < batch.num_rows and total + sizes[j] <= most:
                total += int(sizes[j])
                j += 1
            yield pa.Table.from_batches([batch.slice(i, j - i)])
            i = j
    trim()
