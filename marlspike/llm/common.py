"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or one of our own where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(sc, "_own_shared_dir", None)
        if path is None:
            path = sc._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="marlspike-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``frames``; only for what no later plan reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``."""
    return F.crc32(F.col(doc_id).cast("string")) % m


def by_batch(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """mapInArrow whose ``work`` gets and gives column dicts: name -> list or array."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for out in work({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Of eight bytes the first n.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


class Words:
    """64-bit hashes of the words of many texts at once: a word is a run of other than ASCII white space, A-Z as a-z.

    A word's bytes are taken eight at a time, each eight mixed into the hash of those before, from its length on.
    """

    def __init__(self, limit: int = 1 << 20, clean=lambda t: t.encode("utf-8", "surrogatepass").lower()):
        self.limit, self.clean = limit, clean

    def hashes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and how many words each has."""
        joined = b" ".join([b"", *raw, b"        "])
        b = np.frombuffer(joined, np.uint8)
        gap = _SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        lo, hi = edge[::2] + 1, edge[1::2] + 1
        n = hi - lo
        eight = np.ndarray((len(b) - 7,), "<u8", joined, 0, (1,))
        with np.errstate(over="ignore"):
            h = mix64(n.astype(np.uint64) * _STEP)
            live, off = np.flatnonzero(n <= LONG_WORD), 0
            while len(live):
                part = eight[lo[live] + off] & _FIRST[np.minimum(n[live] - off, 8)]
                h[live] = mix64(h[live] * _STEP + part)
                off += 8
                live = live[n[live] > off]
        for j in np.flatnonzero(n > LONG_WORD).tolist():
            h[j] = xxhash.xxh3_64_intdigest(joined[lo[j] : hi[j]])
        ends = np.cumsum([len(x) + 1 for x in raw])
        return h, np.diff(np.r_[0, np.searchsorted(lo, ends, "right")]) if len(raw) else np.zeros(0, np.int64)

    def batches(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``hashes`` of ``texts``, strings or null, about ``limit`` bytes at a time."""
        part: list[bytes] = []
        size = 0
        for t in texts:
            raw = self.clean(t) if t else b""
            part.append(raw)
            size += len(raw)
            if size >= self.limit:
                yield self.hashes(part)
                part, size = [], 0
        yield self.hashes(part)

    def each(self, texts) -> Iterator[np.ndarray]:
        """The word hashes of each of ``texts``."""
        for h, n in self.batches(texts):
            at = np.r_[0, np.cumsum(n)]
            for i in range(len(n)):
                yield h[at[i] : at[i + 1]]

    def shingles(self, texts, k: int) -> Iterator[np.ndarray]:
        """``shingle_hashes`` of each of ``texts``."""
        for h, n in self.batches(texts):
            all_ = shingle_hashes(h, k)
            at = np.r_[0, np.cumsum(n)]
            for i in range(len(n)):
                yield all_[at[i] : at[i + 1] - k + 1] if n[i] >= k else shingle_hashes(h[at[i] : at[i + 1]], k)


def words_of(text: str | None) -> list[bytes]:
    """The runs of other than ASCII white space, A-Z in lower case; [] for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; a shorter nonempty sequence is one shingle as a whole."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
