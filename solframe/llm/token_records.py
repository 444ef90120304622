"""Token ids as length-delimited binary records, with a separate offset index.

A record is: the payload's length (unsigned 64-bit), a masked CRC-32 of these eight bytes, the payload, a masked CRC-32
of the payload; all little-endian. The payload is a document's ids, 2 bytes each where the vocabulary allows it, else 4.
Documents are range-partitioned by doc_id, and each task writes the records of its range to a file of its own, so the
files in order of their first doc_id hold all documents in ascending order. The index, a Parquet table, has for each
document its file, offset and lengths: a reader seeks to any record, in any order.

A file counts only once the index names it: a lost or repeated task leaves a file behind that nothing reads.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prefix_sums, scratch_dir, slices
from .pieces import PieceEncoder, load_spec

#: Record bytes for a reading task, and in a row from one file.
READ_BYTES, RUN_BYTES = 16 << 20, 4 << 20
#: Files that a reading task keeps open.
HANDLES = 32
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")


def masked(data: bytes) -> int:
    """CRC-32, rotated by 15 bits and shifted by a constant, so that a checksum of checksums stays telling."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    length, check = HEAD.unpack_from(record)
    payload = record[HEAD.size : HEAD.size + length]
    if check != masked(record[:8]) or len(payload) != length or TAIL.unpack_from(record, HEAD.size + length)[0] != masked(payload):
        raise ValueError("a token record is damaged")
    return payload


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder: local, HDFS or S3, by its URI."""
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


_READY: dict[int, PieceEncoder] = {}


def _library(content: bytes) -> PieceEncoder:
    """The tokenizers library behind a memo of pieces, once in each worker process."""
    key = hash(content)
    if key not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _READY.clear()
        spec = load_spec(content)
        # chunks are normalised and free of special tokens already: neither step may come twice
        tokenizer = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

        def encode(chunks: list[str], find) -> list[bytes]:
            """All chunks in one call. A token that ends a word ends a piece, so the pieces' numbers cut the ids apart."""
            ids = np.array(tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1
            pieces = np.cumsum([len(find(c)) for c in chunks])
            if len(ends) != pieces[-1]:
                raise ValueError("the tokenizer's pieces differ from those expected")
            data, cuts = ids.tobytes(), [0, *np.where(pieces > 0, ends[pieces - 1], 0).tolist()]
            return [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

        _READY[key] = PieceEncoder(spec, encode)
    return _READY[key]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode `docs`, append `end_id` to each document and write record files and the index below `folder`.

    Returns the index: doc_id, file, first (the file's least doc_id), before (ids before it in the file), offset,
    n_bytes, n_tokens. A null or empty text is a record of `end_id` alone; a null doc_id comes first; repeated rows are
    records of their own; an empty table gives an empty index; other columns play no part.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        content = f.read()
    file, top = spark.sparkContext.broadcast(content), max(load_spec(content)["model"]["vocab"].values(), default=0)
    top = max([top, end_id, *(t["id"] for t in load_spec(content)["added_tokens"])])
    kind, final = "<u2" if top < 1 << 16 else "<u4", np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, name = _library(file.value).encode, None, ""
        where, base = opened(folder)
        at = before = 0
        first = None
        try:
            for batch in slices(batches, 1024):
                rows = []
                for key, known in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    if out is None:
                        name, first = f"ids-{uuid.uuid4().hex}.bin", key
                        out = where.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                    ids = np.frombuffer(known + final, "<u4")
                    record = frame(ids.astype(kind).tobytes())
                    out.write(record)
                    rows.append((key, at, len(record), len(ids), before))
                    at, before = at + len(record), before + len(ids)
                if rows:
                    keys, *numbers = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, batch.schema.field(0).type), pa.array([name] * len(rows)), pa.array([first] * len(rows), batch.schema.field(0).type), *(pa.array(n, pa.int64()) for n in numbers)],
                        ["doc_id", "file", "first", "offset", "n_bytes", "n_tokens", "before"],
                    )
        finally:
            if out is not None:
                out.close()

    where, base = opened(folder)
    where.create_dir(base, recursive=True)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    id_type = rows.dtypes[0][1]
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    index = ordered.mapInArrow(run, f"doc_id {id_type}, file string, first {id_type}, offset long, n_bytes long, n_tokens long, before long")
    index.write.parquet(f"{folder.rstrip('/')}/index")
    return spark.read.schema(index.schema).parquet(f"{folder.rstrip('/')}/index").withColumn("id_bytes", F.lit(int(kind[2])))


def read_records(index: DataFrame, folder: str, seed: int | None = None) -> DataFrame:
    """Read the records that `index` names: its columns and ids (little-endian unsigned 32-bit).

    Without a seed, rows come file by file in the order of offsets. With one, they come in a permutation that the seed
    decides: rows are dealt to tasks by a hash and each task seeks to its records in the order of that hash. A damaged
    record raises an error; an empty index gives no rows.
    """
    names = index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        handles: dict[str, pa.NativeFile] = {}
        try:
            for batch in batches:
                columns = {n: batch.column(n) for n in names}
                ids = []
                for name, offset, size, wide in zip(*(columns[c].to_pylist() for c in ("file", "offset", "n_bytes", "id_bytes"))):
                    if name not in handles:
                        if len(handles) >= HANDLES:
                            handles.pop(next(iter(handles))).close()
                        handles[name] = where.open_input_file(f"{base}/{name}")
                    payload = unframe(handles[name].read_at(size, offset))
                    ids.append(np.frombuffer(payload, f"<u{wide}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*names, "ids"])
        finally:
            for handle in handles.values():
                handle.close()

    kinds = ", ".join(f"{n} {t}" for n, t in index.dtypes)
    size = index.agg(F.sum("n_bytes")).first()[0] or 0  # tasks by the bytes to read: the index itself is small
    tasks = size // READ_BYTES + 1
    if seed is None:
        spread = index.repartition(tasks, "file", F.floor(F.col("offset") / RUN_BYTES)).sortWithinPartitions("file", "offset")
    else:
        place = F.xxhash64("file", "offset", F.lit(seed))
        spread = index.repartition(tasks, place).sortWithinPartitions(place)
    return spread.mapInArrow(run, f"{kinds}, ids binary")


def token_stream(index: DataFrame, folder: str) -> DataFrame:
    """Place and checksum of each document in the whole stream of ids: doc_id, start, n_tokens, ids_crc32, from the files."""
    read = cut(read_records(index, folder).select(
        "doc_id", "file", "first", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    ))
    files = read.groupBy("first", "file").agg(F.sum("n_tokens").alias("ids")).withColumn("place", F.struct(F.col("first"), F.col("file")))
    starts = prefix_sums(files, [], "place", "ids", "base").select("file", "base")  # a row for each file
    return read.join(starts, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for record files in the shared scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/token-records-{uuid.uuid4().hex}"
