"""Token-id files: each document's ids compressed by itself with a shared zstandard dictionary.

A file set is a folder with two Parquet tables.  ``dictionary`` has one row: sha256 and bytes of
the dictionary, which is trained on the serialized ids of a bounded sample of documents.
``shards`` has a row for each shard of up to SHARD_BYTES or SHARD_DOCS: its place (part, seq), the
dictionary's sha256, the frames of its documents one after the other, and the index: doc_ids,
n_tokens and frame_ends, so one short document is read without its neighbours. Ids are serialized as
little-endian unsigned 32-bit integers. Shards are in ascending order of doc_id.

Cases: null text is empty text, which has the end id alone; null ids come first; rows of one
doc_id follow each other in the order of their contents; a very long document is a shard of its
own; an empty table gives no shards and no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, partitions, shared_path, slices

END_ID = 2
SHARD_BYTES = 4 << 20
SHARD_DOCS = 4096
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many documents on average, and on so many bytes of ids at most.
SAMPLE = 1000
SAMPLE_BYTES = 4 << 20
REMEMBERED = 800_000
REMEMBERED_CHARS = 48
_LEADING = re.compile(r" ?[^\W\d_]+")


def _shown() -> dict[int, str]:
    """The character that stands for each byte in the tokenizer's vocabulary: itself if it can be seen, else the next free one from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SHOWN = _shown()
#: Where a text has one of these, what the tokenizer keeps together may span what is cut below:
#: two white spaces in a row, another white space than space and line end, the cutting mark.
_SPANNING = ("  ", "\n\n", " \n", "\n ", "\0", *filter(str.isspace, map(chr, [*range(9, 10), *range(11, 32), 0x85, 0xA0, *range(0x1680, 0x3001)])))

_FRAMES = "doc_id long, n_tokens long, ids_crc32 long, frame binary"
_SHARDS = "part int, seq int, dictionary string, tokens long, doc_ids array<long>, n_tokens array<long>, frame_ends array<long>, frames binary"


def tokenizer_text() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


class _Parts(dict):
    """Serialized ids of parts of texts; a part that is asked for the first time is encoded.

    A part begins where one of the tokenizer's own parts begins. Its leading letters (behind a
    space or not) are one of those, which the tokenizer's model encodes; what follows them is looked up
    as a part itself, or else encoded as a text.
    """

    def __init__(self, tokenizer) -> None:
        self._model, self._whole = tokenizer.model, lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self._one = [np.array([i], "<u4").tobytes() for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, part: str) -> bytes:
        found = _LEADING.match(part)
        if found is None or not found[0].lstrip().isalpha():  # also letter-like numbers
            made = b"".join([self._one[i] for i in self._whole(part)])
        elif found.end() < len(part):
            made = self[found[0]] + self[part[found.end() :]]
        else:
            seen = part.replace(" ", "\u0120") if part.isascii() else part.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)
            made = b"".join([self._one[t.id] for t in self._model.tokenize(seen)])
        if len(part) <= REMEMBERED_CHARS:
            self[part] = made
        return made


class Encoder:
    """Serialized ids of whole texts.

    The tokenizer's own splitting never joins what stands before a single space with it, nor
    characters across a single line end, so texts are cut there and each distinct part is encoded once
    and remembered. A text for which this isn't sure goes to the tokenizer as a whole, and so does one
    that holds an added token, which the tokenizer takes out first.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self._spanning = (*_SPANNING, *(t["content"] for t in json.loads(spec).get("added_tokens", [])))
        self.known = _Parts(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        out = []
        get = self.known.__getitem__
        for text in texts:
            if text is None or any(x in text for x in self._spanning):
                out.append(self.whole(text or ""))
            else:
                out.append(b"".join(map(get, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))))
        if len(self.known) > REMEMBERED:
            self.known = _Parts(self.tokenizer)
        return out


def _encoder(spec: str) -> Encoder:
    encoders, key = kept("token files"), zlib.crc32(spec.encode())
    if key not in encoders:
        encoders.clear()
        encoders[key] = Encoder(spec)
    return encoders[key]


def _end(end_id: int) -> bytes:
    return np.array([end_id], "<u4").tobytes()


def _ids(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x + _end(end_id) for x in encoder.many(batch.column("text").to_pylist())], pa.binary())], ["ids"])

    return run


def train_dictionary(docs: DataFrame, spec, end_id: int, sample: int = SAMPLE) -> bytes:
    """A dictionary for the ids of a bounded sample of documents; empty for few documents."""
    total = docs.count()
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("zstd"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30)))
    found = drawn.select("text").mapInArrow(_ids(spec, end_id), "ids binary").select(F.substring("ids", 1, 64 << 10).alias("ids")).toArrow()
    samples, held = [], 0
    for ids in sorted(found.column("ids").to_pylist()):
        if held + len(ids) <= SAMPLE_BYTES:
            samples.append(ids)
            held += len(ids)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _encode(spec, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = _encoder(spec.value), _compressor(dictionary)
        for batch in slices(batches):
            ids = [x + _end(end_id) for x in encoder.many(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids_crc32", "frame"])

    return run


def _shards(sha: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs, tokens, ends, frames, held = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "dictionary": sha, "tokens": sum(tokens), "doc_ids": docs, "n_tokens": tokens, "frame_ends": ends, "frames": b"".join(frames)}
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for doc, n, frame in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if docs and (held + len(frame) > SHARD_BYTES or len(docs) >= SHARD_DOCS):
                    yield shard()
                    seq, docs, tokens, ends, frames, held = seq + 1, [], [], [], [], 0
                held += len(frame)
                docs.append(doc)
                tokens.append(n)
                ends.append(held)
                frames.append(frame)
        if docs:
            yield shard()

    return run


def write(docs: DataFrame, path: str, spec: str | None = None, end_id: int = END_ID, sample: int = SAMPLE) -> str:
    """Encode every whole text of docs and write the file set to path, a folder that all share."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    spec = spark.sparkContext.broadcast(spec or tokenizer_text())
    dictionary = train_dictionary(docs, spec, end_id, sample)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    docs.mapInArrow(_encode(spec, end_id, dictionary), _FRAMES).write.option("compression", "uncompressed").parquet(f"{path}/frames")
    frames = spark.read.schema(_FRAMES).parquet(f"{path}/frames")
    order = ["doc_id", "ids_crc32", "n_tokens"]
    frames = frames.repartitionByRange(partitions(spark, frames), *order).sortWithinPartitions(*order)
    frames.mapInArrow(_shards(sha), _SHARDS).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    return path


def _decode(dictionary: bytes, sha: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hashlib.sha256(dictionary).hexdigest() != sha:
            raise ValueError("the dictionary is not the one that its hash names")
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != sha:
                    raise ValueError("a shard was written with another dictionary")
                begin, start, frames = 0, row["start"], memoryview(row["frames"])
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                held = 0
                for doc, n, end in zip(row["doc_ids"], row["n_tokens"], row["frame_ends"], strict=True):
                    ids = unpress.decompress(frames[begin:end])
                    if len(ids) != 4 * n:
                        raise ValueError("a frame has another number of ids than its index says")
                    for k, v in zip(out, (doc, start, n, ids), strict=True):
                        out[k].append(v)
                    begin, start, held = end, start + n, held + len(ids)
                    if held > SHARD_BYTES:
                        yield _decoded(out)
                        out, held = {k: [] for k in out}, 0
                yield _decoded(out)

    return run


def _decoded(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "ids" else pa.int64()) for k in out], list(out))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (bytes) of every document, or of the shards that hold doc_ids."""
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    sha, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    part = shards.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("part").alias("p_part"), F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("offset"))
    starts = starts.join(part, F.col("part") == F.col("p_part")).select("p_part", F.col("seq").alias("p_seq"), (F.col("base") + F.col("offset")).alias("start"))
    if doc_ids is not None:
        shards = shards.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(x)) for x in doc_ids])))
    rows = shards.join(starts, (F.col("part") == F.col("p_part")) & (F.col("seq") == F.col("p_seq")))
    rows = rows.select("dictionary", "start", "doc_ids", "n_tokens", "frame_ends", "frames")
    found = rows.mapInArrow(_decode(bytes(dictionary), sha), "doc_id long, start long, n_tokens long, ids binary")
    return found if doc_ids is None else found.filter(F.col("doc_id").isin(list(doc_ids)))


def round_trip(docs: DataFrame) -> DataFrame:
    """Write docs to a new file set in the shared folder and read it back."""
    path = write(docs, shared_path(docs.sparkSession, "token-files"))
    return read(docs.sparkSession, path)
