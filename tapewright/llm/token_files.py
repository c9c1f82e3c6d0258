"""Token-id files: Simple-8b words in blocks, written in doc_id order and read back.

A file row is one block of whole documents.  Its 64-bit words hold a selector in
the top four bits and as many ids as fit in the other sixty, at the selector's
width.  An id too wide for any selector is an escape: selector 15 stands in its
place and the id itself follows in the block's list of escapes.  ``doc_id`` and
``n_tokens`` give per-document offsets within the block, so a reader can decode a
block in a few vectorised steps and cut it up.

The container is a Parquet table in the shared folder, one file a shard: Spark's
commit protocol keeps it whole if executors are lost, and any store will do.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import PartCache, as_bytes, text_batches
from .storage import new_path

#: (ids in a word, bits of each), by selector.  Selector 15 is an escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK_IDS = 1 << 16

FILE_SCHEMA = "shard int, block int, first long, n_ids int, doc_id array<long>, n_tokens array<int>, words binary, escapes binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of unsigned ids, and the escaped ids.

    Each word takes the largest count of following ids that fits, so a word's count
    depends on its ids alone; only a block's last word may hold fewer.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    wide = ids >= np.uint64(1 << 60)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    bits[(ids >> np.uint64(50)) > 0] = 60  # floats round there
    bits[wide] = 61
    # the widest id among the next 1, 2, 4 ... ids, then for each selector the first one that fits
    most, span = {1: bits}, 1
    while span < 60:
        x = most[span]
        most[2 * span] = np.maximum(x, np.concatenate([x[span:], np.zeros(min(span, n), np.uint8)])[:n])
        span *= 2
    choice = np.full(n, ESCAPE, np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        x = most[p]
        rest = count - p
        both = x if not rest else np.maximum(x, np.concatenate([x[rest:], np.zeros(min(rest, n), np.uint8)])[:n])
        choice[both <= width] = s
    step = np.array([c for c, _ in SELECTORS] + [0, 1])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s, (count, width) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            lanes = padded[at[rows][:, None] + np.arange(count)]
            words[rows] |= np.bitwise_or.reduce(lanes << (np.arange(count) * width).astype(np.uint64), axis=1)
    return words, ids[at[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array([c for c, _ in SELECTORS] + [0, 1])[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            mask = np.uint64((1 << width) - 1)
            out[at[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> (np.arange(count) * width).astype(np.uint64)) & mask
    out[at[chosen == ESCAPE]] = escapes
    return out[:n]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PartCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    # in a byte-level vocabulary each letter of a token stands for one byte
    length = np.zeros(1 + max(tok.get_vocab().values()), np.int64)
    for token, i in tok.get_vocab().items():
        length[i] = len(token)

    def parts(texts: list[str]) -> list[bytes]:
        """Parts that begin with white space don't join with what stands before them, so many are encoded as one text and cut."""
        out = [b""] * len(texts)
        joined = [i for i, x in enumerate(texts) if x[:1] in (" ", "\n")]
        single = [i for i, x in enumerate(texts) if x[:1] not in (" ", "\n")]
        for i, e in zip(single, tok.encode_batch_fast([texts[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = as_bytes(e.ids)
        groups = [joined[i : i + 64] for i in range(0, len(joined), 64)]
        for group, e in zip(groups, tok.encode_batch_fast(["".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum([len(texts[i].encode()) for i in group])
            raw, at = ids.tobytes(), 0
            for i, end in zip(group, (np.searchsorted(np.cumsum(length[ids]), ends) + 1).tolist(), strict=True):
                out[i], at = raw[4 * at : 4 * end], end
        return out

    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    return PartCache(parts, lambda text: as_bytes(tok.encode(text, add_special_tokens=False).ids), special, limit=600_000)


def _blocks(batches: Iterator[pd.DataFrame], path: str, end_id: int) -> Iterator[pd.DataFrame]:
    shard, block, first, size = TaskContext.get().partitionId(), 0, 0, 0
    docs: list[int | None] = []
    counts: list[int] = []
    held: list[bytes] = []
    end = as_bytes([end_id])

    def close() -> pd.DataFrame:
        ids = np.frombuffer(b"".join(held), np.uint32)
        words, escapes = pack(ids)
        row = [shard, block, first, len(ids), list(docs), list(counts), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
        return pd.DataFrame([row], columns=[x.split(" ")[0] for x in FILE_SCHEMA.split(", ")])

    for batch in batches:
        texts = [x if isinstance(x, str) else "" for x in batch["text"]]
        doc_ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
        for some in text_batches(texts):
            for doc, ids in zip(doc_ids[some], _encoder(path).encode_batch(texts[some]), strict=True):
                docs.append(doc)
                counts.append(len(ids) // 4 + 1)
                held += (ids, end)
                size += counts[-1]
                if size >= BLOCK_IDS:
                    yield close()
                    first, block, size = first + size, block + 1, 0
                    docs, counts, held = [], [], []
    if docs:
        yield close()


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int, shards: int | None = None) -> None:
    """Encode each whole text and write the ids to ``out`` in ascending doc_id order.

    One shuffle: rows go to ranges of doc_id, one a shard.  Rows that share a doc_id keep an
    order by text hash; a null doc_id comes first; a null text has only its end id.
    """
    spark = docs.sparkSession
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    placed.mapInPandas(lambda batches: _blocks(batches, path, end_id), FILE_SCHEMA).write.parquet(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = unpack(np.frombuffer(row.words, "<u8"), np.frombuffer(row.escapes, "<u8"), row.n_ids)
            counts = np.array(row.n_tokens, np.int64)
            begin = np.cumsum(counts) - counts
            raw = memoryview(ids.astype("<u4").tobytes())
            yield pd.DataFrame(
                {
                    "shard": row.shard,
                    "doc_id": pd.array([None if x is None or x != x else int(x) for x in row.doc_id], dtype="Int64"),
                    "start": row.first + begin,
                    "n_tokens": counts,
                    "ids": [ids[a : a + c].astype(np.int64) for a, c in zip(begin, counts, strict=True)],
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * (a + c)]) for a, c in zip(begin.tolist(), counts.tolist(), strict=True)],
                }
            )


def read_token_files(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(out)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # one row a file: small whatever the files hold
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    columns = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    keep = [x.split(" ")[0] for x in columns.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _read(batches):
            yield pdf[keep]

    rows = blocks.mapInPandas(decode, columns).join(before, "shard")
    return rows.withColumn("start", F.col("start") + F.col("before")).drop("before", "shard")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens, ids_crc32.

    An empty table gives an empty result.  Other columns are not read.
    """
    out = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, out, end_id)
    return read_token_files(docs.sparkSession, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
