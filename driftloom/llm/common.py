"""What the operators of this subpackage share: table access, folds, written stages and byte-level word hashing.

Word hashing works on UTF-8 bytes with numpy: sums of table[byte] * table[place in the word] (mod 2**64)
give the hash of every word, or of any prefix of it, without a Python loop over words. The places'
factors are scrambled numbers, not powers of one base, so no family of strings collides by construction.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import driftloom

# Executors needn't have this package installed: its functions travel with the tasks, and its models as bytes (see carried).
cloudpickle.register_pickle_by_value(driftloom)

#: Bytes that separate words in the contracts of these operators: space, and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Joined bytes that one numpy pass hashes at once (a longer text makes a longer pass of its own).
CHUNK = 1 << 18
#: Most rows of an Arrow batch.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` rows: texts are long, and both sides of a Python worker hold a batch several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


class Carried:
    """A broadcast of bytes; ``value`` is what they hold, made once for each task."""

    def __init__(self, sent: Broadcast) -> None:
        self.sent, self.made = sent, None

    @property
    def value(self):
        if self.made is None:
            self.made = cloudpickle.loads(self.sent.value)
        return self.made

    def unpersist(self) -> None:
        self.sent.unpersist()

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "made": None}


def carried(spark: SparkSession, value: object) -> Carried:
    """value as a broadcast that executors without this package can read: its classes travel within it, by value."""
    return Carried(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir. Where that is unset a local master gets a temporary one; a cluster has no such folder, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("driftloom.local.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("driftloom.local.dir", at)
    return at


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/driftloom/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def free(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of docs has it (whatever the case of letters)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def unclashing(docs: DataFrame, *names: str) -> None:
    """Raises ValueError if docs has a column of one of these names of results."""
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already; give other names")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def held_out(doc_id: str, n: int, left: int) -> Column:
    """True for rows whose fold is ``left``; a null id is held out from nothing and learned from by nobody."""
    return F.coalesce(fold(doc_id, n) == left, F.lit(False))


def learnable(doc_id: str, n: int, left: int) -> Column:
    return F.coalesce(fold(doc_id, n) != left, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, bound: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs with _label (0 or 1), of at most about ``bound`` labelled rows that may teach, chosen by a hash of the id.

    The labels of the sample, which are of bounded size, are broadcast; no text is shuffled.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_of"), F.col(label_col).cast("int").alias("_label"))
    share = min(1.0, bound / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64(F.col("_of").cast("string"), F.lit(3)), F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["_of"])
    return docs.join(F.broadcast(few), F.col(id_col) == F.col("_of")).drop("_of")


def numbers(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows, at the given rows each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(1, each)))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null counts as empty, bytes that aren't UTF-8 as U+FFFD."""
    return [b.decode("utf-8", "replace") for b in as_bytes(column)]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes together."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes words of joined texts. One for each task: it keeps a table of the places' factors."""

    def __init__(self, gaps: np.ndarray | None = None) -> None:
        """gaps: which of the 256 bytes separate words, SPACES unless given."""
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.space = self.space if gaps is None else gaps
        self.factors = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of runs of these sizes, one after another. (prefix sums over all bytes, where each run begins)."""
        longest = int(sizes.max()) if len(sizes) else 0
        if longest > len(self.factors):
            self.factors = mix(mix(np.arange(1, 2 * longest + 1024, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(begins, sizes)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.factors[place], out=sums[1:])
        return sums, begins

    def runs(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64-bit hash of each run."""
        sums, begins = self.sums(data, sizes)
        return mix(sums[begins + sizes] - sums[begins] + sizes.astype(np.uint64))

    def words(self, texts: list[bytes]) -> Words:
        """The words of all texts together; a word is a run of bytes that aren't in SPACES."""
        joined = b"\n" + b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        gap = self.space[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        first, last = edge[0::2], edge[1::2]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        of = np.searchsorted(first, offsets + 1)
        return Words(data, first, last, of, *self.sums(data[~gap], last - first))


class Words:
    """first, last: byte range of each word; of: the range of words of each text."""

    def __init__(self, data, first, last, of, sums, begins) -> None:
        self.data, self.first, self.last, self.of, self.sums, self.begins = data, first, last, of, sums, begins

    def hashes(self, length: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``length`` bytes (all of a shorter one)."""
        size = self.last - self.first
        size = size if length is None else np.minimum(size, length)
        return mix(self.sums[self.begins + size] - self.sums[self.begins] + size.astype(np.uint64))


def folded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each run of hashes, by value and place."""
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(begins, sizes).astype(np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + mix(place + np.uint64(1))), out=sums[1:])
    return mix(sums[begins + sizes] - sums[begins] + sizes.astype(np.uint64))
