"""Token ids in a binary table with a shared zstandard dictionary.

Layout of a written table (Parquet, one file per shard, shards in ascending
document order): each row is a block of consecutive documents with

    shard, block        position in the order
    dictionary          hex sha256 of the dictionary ("" where none was trained)
    id_bytes            bytes per id in a payload, little-endian
    doc_ids, counts     per document: its id and its number of token ids
    offsets, lengths    per document: where its own zstandard frame lies in data
    data                the frames, one after the other

Beside it stands ``<path>-dictionary`` with the columns sha256 and data.  A
document is read by its offset and length alone; the index columns are read
without the payload.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quadrille.llm.common import by_text_id, pick

END_ID = 2
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: the dictionary is trained on the documents with the smallest hashed ids
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16384, 65536
MEMO_ENTRIES = 600_000

BLOCK_SCHEMA = ("shard long, block long, dictionary string, id_bytes int, doc_ids array<long>, counts array<long>, "
                "offsets array<long>, lengths array<long>, data binary")

#: A text is cut before a blank that follows and precedes other characters, and
#: at the edges of white space: byte-level pre-tokens never cross these places.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: characters that libraries class differently as white space, and special tokens: encoded whole
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")


#: a chunk of one word, maybe with marks after it: two pre-tokens at most
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?([!-&(-/:-@[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """The tokenizers library behind a bounded memo: chunk to serialized ids.

    Chunks of plain words go to the library's BPE model, all others through
    its whole pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {"": b""}
        kind = type(self.tokenizer.pre_tokenizer).__name__, type(self.tokenizer.model).__name__, self.tokenizer.normalizer
        if kind != ("ByteLevel", "BPE", None):
            raise ValueError(f"a byte-level BPE file is needed, not {kind}")
        self.tokenize = self.tokenizer.model.tokenize

    def _model(self, pre_token: str) -> bytes:
        # printable ASCII stands for itself, so in plain words only the blank changes
        letters = pre_token.replace(" ", self.letters[32]) if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if m := PLAIN.fullmatch(chunk):
            word, marks = m.groups()
            if marks not in self.marks:
                self.marks[marks] = self._model(marks)
            # the word may be known without its marks
            ids = (((marks and self.get(word)) or self._model(word)) if word else b"") + self.marks[marks]
        else:
            ids = self._whole(chunk)
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, serialized; the same as encoding it whole."""
        text = text or ""
        if len(self) + len(self.marks) > MEMO_ENTRIES:
            self.clear()
            self.marks = {"": b""}
        if any(odd in text for odd in ODD):
            return self._whole(text)
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def trained_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from the serialized ids of at most SAMPLE_DOCS documents of
    ``docs`` (doc_id, text), the first SAMPLE_BYTES of each; empty where the
    sample is too small to train on."""
    import zstandard
    # a threshold on the hash keeps about twice the sample; only those are ordered
    share = min(1.0, 2.0 * SAMPLE_DOCS / max(1, docs.count()))
    hashed = docs.filter(F.length("text") > 0).select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"), F.substring("text", 1, SAMPLE_BYTES).alias("t"))
    near = hashed.filter(F.col("h") <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))))
    texts = [r["t"] for r in near.orderBy("h", "g").limit(SAMPLE_DOCS).collect()]
    own = Encoder(tokenizer)
    ids = [own.encode(t)[:SAMPLE_BYTES] for t in texts]
    if len(ids) < 16 or sum(map(len, ids)) < 8192:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, ids)) // 8)
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:     # too alike or too few for a dictionary
        return b""


def _codec(dictionary: bytes):
    import zstandard
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id`` and write the table at ``path``.

    Documents lie in ascending doc_id order (nulls first, equal ids by a hash
    of their texts; equal rows stay apart).  Null and empty texts give the end
    id alone.  An empty input gives an empty table.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=doc_id, text=text)
    dictionary = trained_dictionary(d, tokenizer)
    name = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    spark.createDataFrame([(name, bytearray(dictionary))], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}-dictionary")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        compress = _codec(dictionary)[0].compress
        end, width = np.array([end_id], own.dtype).tobytes(), own.dtype.itemsize
        ids, counts, frames, size = [], [], [], 0

        def block() -> pd.DataFrame:
            lengths = [len(f) for f in frames]
            offsets = np.cumsum([0, *lengths])[:-1].tolist()
            return pd.DataFrame([(shard, number, name, width, ids, counts, offsets, lengths, b"".join(frames))],
                                columns=["shard", "block", "dictionary", "id_bytes", "doc_ids", "counts", "offsets", "lengths", "data"])

        for pdf in batches:
            keys = [None if pd.isna(k) else int(k) for k in pdf["doc_id"]]
            for key, text in zip(keys, pdf["text"], strict=True):
                got = own.encode(text)
                frame = compress(got + end)
                ids.append(key)
                counts.append(len(got) // width + 1)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, counts, frames, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (d.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(F.col("doc_id").cast("string").alias("doc_id"), "text")    # pandas would round integers beside a null
     .mapInPandas(blocks, BLOCK_SCHEMA).write.parquet(path))


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """(sha256, bytes) of the table's dictionary, checked against each other."""
    row = spark.read.parquet(f"{path}-dictionary").first()
    data = bytes(row["data"])
    if row["sha256"] != (hashlib.sha256(data).hexdigest() if data else ""):
        raise ValueError(f"the dictionary beside {path} does not match its hash")
    return row["sha256"], data


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, shard, block, item, offset, length, n_tokens, start.

    ``start`` counts the ids of all documents before it.  Reads the index
    columns only; the running sums go over shards, and over the blocks of one
    shard.
    """
    b = spark.read.parquet(path).select("shard", "block", "doc_ids", "counts", "offsets", "lengths")
    b = b.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = b.groupBy("shard").agg(F.sum("n").alias("n"))      # one row per file
    shards = shards.select("shard", before(W.orderBy("shard")).alias("shard_start"))
    in_shard = b.withColumn("block_start", before(W.partitionBy("shard").orderBy("block")))
    rows = in_shard.join(shards, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"), "counts",
        F.posexplode(F.arrays_zip("doc_ids", "offsets", "lengths")).alias("item", "d"))
    upto = F.aggregate(F.slice("counts", 1, F.col("item")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(F.col("d.doc_ids").alias("doc_id"), "shard", "block", "item", F.col("d.offsets").alias("offset"),
                       F.col("d.lengths").alias("length"), F.col("counts")[F.col("item")].alias("n_tokens"),
                       (F.col("base") + upto).alias("start"))


def _unpacked(frame: bytes, width: int, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(frame), "<u2" if width == 2 else "<u4")


def documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of all documents, or of the given ones: then
    only their own frames are cut out of the blocks and decompressed."""
    name, dictionary = read_dictionary(spark, path)
    b = spark.read.parquet(path)
    if doc_ids is not None:
        b = b.filter(F.exists("doc_ids", lambda d: d.isin(doc_ids)))
    rows = b.select("dictionary", "id_bytes", "data", F.explode(F.arrays_zip("doc_ids", "offsets", "lengths")).alias("d"))
    if doc_ids is not None:
        rows = rows.filter(F.col("d.doc_ids").isin(doc_ids))
    rows = rows.select(F.col("d.doc_ids").alias("doc_id"), "dictionary", "id_bytes",
                       F.substring("data", F.col("d.offsets").cast("int") + 1, F.col("d.lengths").cast("int")).alias("frame"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = _codec(dictionary)[1]
        for pdf in batches:
            if (pdf["dictionary"] != name).any():
                raise ValueError("a block was written with another dictionary")
            ids = [_unpacked(f, w, decompressor).astype(np.int64) for f, w in zip(pdf["frame"], pdf["id_bytes"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": pd.Series(ids, dtype=object)})

    return by_text_id(rows, run, "doc_id string, ids array<int>", "doc_id")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, item, n_tokens, ids_crc32) per document, from the frames."""
    name, dictionary = read_dictionary(spark, path)
    b = spark.read.parquet(path).select("shard", "block", "dictionary", "id_bytes", "offsets", "lengths", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = _codec(dictionary)[1]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.dictionary != name:
                    raise ValueError("a block was written with another dictionary")
                ids = [_unpacked(r.data[o:o + n], r.id_bytes, decompressor) for o, n in zip(r.offsets, r.lengths, strict=True)]
                yield pd.DataFrame({"shard": r.shard, "block": r.block, "item": np.arange(len(ids), dtype=np.int32),
                                    "n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]})

    return b.mapInPandas(run, "shard long, block long, item int, n_tokens long, ids_crc32 long")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 per document, read from the table."""
    place = index(spark, path).select("shard", "block", "item", "doc_id", "start")
    return place.join(digests(spark, path), ["shard", "block", "item"]).select("doc_id", "start", "n_tokens", "ids_crc32")
