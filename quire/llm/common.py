"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import spread, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For bytes.translate: A-Z to a-z, all else as it is.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The white space that bytes.split() splits at: space, \t, \n, \v, \f, \r.
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see. A temporary one only where none is set and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back: its lineage is cut, later readers take the columns they need, and its size is known. It goes when the driver ends, or by discard()."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    files, path = _file_system(spark, folder)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of checkpointed() that nothing reads any more."""
    for table in tables:
        files, path = _file_system(table.sparkSession, table._folder)
        files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect what it no longer needs, upon which Spark drops the shuffle files and broadcasts of tables that are written; else the driver's heap grows to its limit before it is collected."""
    spark._jvm.System.gc()


#: A key is hot from this share of all rows on, which no more keys can have.
HOT_KEYS = 4096


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], n: str) -> DataFrame:
    """The inner join of rows with table, which has each key once and in column n how many rows have it, or more.

    Hot keys are joined by broadcast, so that their rows stay where they are; there are fewer than HOT_KEYS of them, as their n adds up to no
    more than the total. All others are shuffled. Both sides are read more than once.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(n) * HOT_KEYS > total))
    cold = table.where(F.col(n) * HOT_KEYS <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text, so that what a slice needs in memory is bounded; one long text is a slice."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def offsets(texts: pa.Array) -> np.ndarray:
    """Of an array of large strings or binaries: where each begins in its data, and where the last ends."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def joined(texts: pa.Array, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of texts as one each, that end before the places `ends`."""
    at = offsets(texts)[np.append(0, ends)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), texts.buffers()[2] or pa.py_buffer(b"")])


def cut(texts: pa.LargeStringArray, begins: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The parts of texts without nulls, and how many there are up to each text's last. begins: for all bytes one after another, at which of them a part begins; each text begins one."""
    at = offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    first = begins(data)
    first[at[:-1][at[1:] > at[:-1]]] = True
    starts = np.flatnonzero(first)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
    return parts.dictionary_encode(), np.searchsorted(starts, at[1:])


class WordTable:
    """Distinct words and what belongs to each, in Arrow arrays; of bounded size, as words that the fewest blocks had make room for new ones."""

    def __init__(self, *types: pa.DataType) -> None:
        self.words, self.uses = pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.columns = [pa.array([], t) for t in types]

    def rows(self, words: pa.LargeStringArray, values: Callable[[list[str]], tuple], most: int) -> np.ndarray:
        """The rows of distinct words, which all get one though they be more than `most`. values: the columns of new words."""
        rows = pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        seen = rows >= 0
        new = words.filter(pa.array(~seen))
        over = len(self.words) + len(new) - most
        if over > 0:
            kept = np.zeros(len(self.words), bool)
            kept[rows[seen]] = True
            old = np.flatnonzero(~kept)
            if over < len(old):
                kept[old[np.argpartition(self.uses[old], over)[over:]]] = True
            rows[seen] = (np.cumsum(kept) - 1)[rows[seen]]
            self.words, self.uses = self.words.filter(pa.array(kept)), self.uses[kept]
            self.columns = [a.filter(pa.array(kept)) for a in self.columns]
        rows[~seen] = np.arange(len(self.words), len(self.words) + len(new))
        self.columns = [pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(self.columns, values(new.to_pylist()), strict=True)]
        self.words, self.uses = pa.concat_arrays([self.words, new]), np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[rows] += 1
        return rows
