"""Removing passages that earlier documents have, by fixed-block anchors.

A window of 50 words holds a whole block of 25 words that starts at a multiple of 25. The index therefore has only the
non-overlapping 25-word blocks of each document, and every rolling 25-word window of every document probes it. A hit is
an anchor: only windows around anchors can repeat. Anchors are extended: the 50-word windows around them are compared
by their own hashes, consecutive repeated windows join to maximal exact repeats, and the words of all but the earliest
document's copy go.

Index and probes meet in buckets of hashes, in packed rows of a few bytes an entry. Within a chunk of documents, copies
of a hash are settled before the shuffle, so a passage that very many documents share sends one entry for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import row_ids
from .common import FEW, by_bucket, cut, scratch_table, slices, small
from .packs import LAST, deal, pack_owners, pack_places, planes, runs, unpack_owners, unpack_places, unplanes
from .words import spans, windows, word_hashes

#: Words of a window, and of a block: 2 * BLOCK - 1 <= WINDOW.
WINDOW, BLOCK = 50, 25
#: Words in a chunk of a map task; entries in a bucket, about.
CHUNK, BUCKET = 1 << 20, 1 << 20
#: Place of an entry that stands for several documents of its chunk.
MANY = 0xFFFFFFFF

ENTRIES = "bucket long, owners binary, counts binary, hashes binary, places binary"


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
    """Rows of the batches in lists of about CHUNK words (a word is taken as 6 bytes)."""
    held, size = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns[:n])):
            held.append(row)
            size += len(row[1])
            if size >= 6 * CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rolling(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of each window that lies within one text."""
    hashes = windows(words, width)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(hashes)]
    ends = np.cumsum(counts)
    at = np.arange(len(hashes))
    whole = at + width <= ends[owner] if len(hashes) else np.zeros(0, bool)
    owner = owner[whole]
    return hashes[whole], owner, at[whole] - (ends - counts)[owner]


def _probe(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for rows in _chunks(batches, 2):
            ids = np.array([r[0] for r in rows], np.int64)
            words, counts = word_hashes([r[1] for r in rows])
            hashes, owner, at = _rolling(words, counts, BLOCK)
            order = np.argsort(hashes, kind="stable")
            start, run_of = runs(hashes[order])
            low, high = (f.reduceat(ids[owner[order]], start) if len(start) else ids[:0] for f in (np.minimum, np.maximum))
            block = np.maximum.reduceat(at[order] % BLOCK == 0, start) if len(start) else np.zeros(0, bool)
            settled = np.zeros(len(hashes), bool)
            settled[order] = ((low != high) & block)[run_of]
            first = np.zeros(len(hashes), bool)
            first[order[start]] = True
            out = []
            if settled.any():  # anchors that this chunk knows by itself
                out.append((-1 - task, *pack_owners(owner[settled], ids), b"", pack_places(at[settled], owner[settled])))
            send = np.flatnonzero(~settled | first)
            place = np.where(settled, MANY, at)
            for b, x in deal(hashes[send], buckets):
                x = send[x]
                out.append((b, *pack_owners(owner[x], ids), planes(hashes[x] & np.uint64(0xFFFFFFFF), "<u4"), pack_places(place[x], owner[x])))
            yield from _entry_batches(out)

    return run


def _entry_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 512):
        cols = list(zip(*rows[i : i + 512]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "owners", "counts", "hashes", "places"])


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Anchors of one bucket: places whose hash is that of a block and occurs in two documents."""
    ids = np.concatenate([unpack_owners(a, b) for a, b in zip(rows["owners"], rows["counts"])])
    at = np.concatenate([unpack_places(x, n) for x, n in zip(rows["places"], rows["counts"])])
    if rows["bucket"].iloc[0] >= 0:
        hashes = np.concatenate([unplanes(x, "<u4") for x in rows["hashes"]])
        order = np.argsort(hashes, kind="stable")
        ids, at = ids[order], at[order]
        start, run_of = runs(hashes[order])
        many = np.maximum.reduceat(at == MANY, start)
        several = many | (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start))
        block = many | np.maximum.reduceat(at % BLOCK == 0, start)
        keep = (several & block)[run_of] & (at != MANY)
        ids, at = ids[keep], at[keep]
    return pd.DataFrame({"key": ids, "at": at.astype(np.int64)})


def _around(anchors: list[int] | None, n: int) -> np.ndarray:
    """Starts of the windows of a text of n words that hold an anchor."""
    if not anchors or n < WINDOW:
        return np.zeros(0, np.int64)
    at = np.array(anchors, np.int64)
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.clip(at - (WINDOW - BLOCK), 0, n), 1)
    np.add.at(edge, np.clip(at, 0, n) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: n - WINDOW + 1])


#: row: number of a document's row, as doc_ids may be null or shared; rows: those of a chunk's owners.
TABLE = "kind int, key long, row long, n_words long, kept_sha256 string, text binary, chunk long, owners binary, rows binary, counts binary, hashes binary, places binary"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, done if no anchor is in it, else with its text; and packed windows around the anchors."""
    task, made, seen = TaskContext.get().partitionId(), 0, 0
    names = [x.split()[0] for x in TABLE.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in TABLE.split(", ")]
    for rows in _chunks(batches, 3):
        words, counts = word_hashes([r[1] for r in rows])
        out, found = [], []
        numbers = (task << 32) + seen + np.arange(len(rows))
        seen += len(rows)
        for i, ((key, text, anchors), (a, b)) in enumerate(zip(rows, spans(counts))):
            starts = _around(anchors, b - a)
            if len(starts):
                found.append((i, starts, windows(words[a:b], WINDOW)[starts]))
                out.append((0, key, numbers[i], b - a, None, text, *[None] * 6))
            else:
                out.append((0, key, numbers[i], b - a, sha256(b" ".join(text.split())).hexdigest(), None, *[None] * 6))
        if found:
            ids = np.array([r[0] for r in rows], np.int64)
            owner = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            owners, n = pack_owners(owner, ids)
            out.append((1, *[None] * 5, (task << 32) + made, owners, pack_owners(owner, numbers)[0], n, np.concatenate([f[2] for f in found]).tobytes(), planes(np.concatenate([f[1] for f in found]), "<u4")))
            made += 1
        for i in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000]), types)], names)


def _windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, owners, counts, hashes in zip(*(batch.column(n).to_pylist() for n in ("chunk", "owners", "counts", "hashes"))):
                ids, h = unpack_owners(owners, counts), np.frombuffer(hashes, np.uint64)
                order = np.lexsort((ids, h))
                start, run_of = runs(h[order])
                later = np.zeros(len(h), bool)
                later[order] = ids[order] > ids[order[start]][run_of]
                out = [(-1 - chunk, b"", b"", b"", planes(np.diff(np.flatnonzero(later), prepend=0), "<u4"), chunk)] if later.any() else []
                send = np.flatnonzero(~later)  # of equal windows of a chunk, all of the earliest document's go on
                for b, x in deal(h[send], buckets):
                    x = send[x]
                    x = x[np.argsort(ids[x], kind="stable")]
                    used, of = np.unique(ids[x], return_inverse=True)
                    out.append((b, *pack_owners(of, used), h[x].tobytes(), pack_places(x, of), chunk))
                for i in range(0, len(out), 512):
                    cols = list(zip(*out[i : i + 512]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:5]), pa.array(cols[5], pa.int64())], ["bucket", "owners", "counts", "hashes", "places", "chunk"])

    return run


def _later(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, the windows that an earlier document has."""
    if rows["bucket"].iloc[0] < 0:
        return rows[["chunk", "places"]]
    ids = np.concatenate([unpack_owners(a, b) for a, b in zip(rows["owners"], rows["counts"])])
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]])
    n = [len(x) // 8 for x in rows["hashes"]]
    order = np.lexsort((ids, h))
    start, run_of = runs(h[order])
    later = np.zeros(len(h), bool)
    later[order] = ids[order] > ids[order[start]][run_of]
    out = []
    for (a, b), places, counts, chunk in zip(spans(n), rows["places"], rows["counts"], rows["chunk"]):
        x = np.sort(unpack_places(places, counts)[later[a:b]])
        if len(x):
            out.append((chunk, planes(np.diff(x, prepend=0), "<u4")))
    return pd.DataFrame(out, columns=["chunk", "places"])


def _join_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Maximal repeats of a chunk's documents, as word ranges, from its table and its repeated windows."""
    table = rows[rows["owners"].notna()].iloc[0]
    ids, own = (unpack_owners(table[c], table["counts"]) for c in ("owners", "rows"))
    starts = unplanes(table["places"], "<u4").astype(np.int64)
    again = np.zeros(len(ids), bool)
    for x in rows.loc[rows["owners"].isna(), "places"]:
        again[np.cumsum(unplanes(x, "<u4"))] = True
    ids, own, starts = ids[again], own[again], starts[again]
    new = np.ones(len(ids), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] > starts[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))[: len(first)] - 1  # none, if none of the chunk's windows repeat
    return pd.DataFrame({"key": ids[first], "row": own[first], "from_word": starts[first], "to_word": starts[last] + WINDOW})


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for key, n, done, text, repeats in zip(*(c.to_pylist() for c in batch.columns[:5])):
            if text is None:
                out.append((key, n, 0, done, None))
                continue
            words, gone = text.split(), np.zeros(n + 1, np.int64)
            for r in repeats or ():
                a, b = min(r["from_word"], n), min(r["to_word"], n)
                gone[a] += 1
                gone[b] -= 1
            stay = np.cumsum(gone)[:n] == 0
            kept = b" ".join([words[i] for i in np.flatnonzero(stay)])
            out.append((key, n, int(n - stay.sum()), sha256(kept).hexdigest(), kept))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], ["key", "n_words", "n_removed", "kept_sha256", "kept"])


def _numbered(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text with whole-number ids; and, if ids of another type were numbered in their order, own_id by key."""
    rows = docs.select(docs[doc_id].alias(doc_id), docs[text].alias(text))
    if isinstance(rows.schema[doc_id].dataType, T.IntegralType):
        return rows, None
    ids = cut(row_ids(rows.select(F.col(doc_id).alias("own_id")).filter("own_id is not null").distinct(), ["own_id"], "key"))
    known = rows.join(small(ids), F.col(doc_id) == F.col("own_id"), "left")
    return known.select(F.col("key").alias(doc_id), text), ids


def _named(out: DataFrame, ids: DataFrame | None) -> DataFrame:
    """doc_id, as it was, in the place of key."""
    others = [c for c in out.columns if c != "key"]
    if ids is None:
        return out.select(F.nullif(F.col("key"), F.lit(int(LAST))).alias("doc_id"), *others)
    return out.join(small(ids), "key", "left").select(F.col("own_id").alias("doc_id"), *others)


def _tables(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The documents (done, or with their text) and the maximal repeats to take out of them (key, row, from_word, to_word)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(size // 6 // BUCKET, min(8 * parts, 1024)) + 1
    probes = rows.mapInArrow(_probe(buckets), ENTRIES)
    hits = by_bucket(probes, buckets).applyInPandas(_meet, "key long, at long")
    anchors = cut(hits.groupBy("key").agg(F.collect_set("at").alias("anchors")))
    keys = anchors.select("key")
    if keys.count() <= FEW:  # texts without anchors need no shuffle if the keys of the others can be broadcast
        hit = rows.join(F.broadcast(keys), "key", "left_semi").join(anchors, "key")
        clean = rows.join(F.broadcast(keys), "key", "left_anti").withColumn("anchors", F.lit(None).cast("array<bigint>"))
        joined = hit.unionByName(clean).select("key", "text", "anchors")
    else:
        joined = rows.join(anchors, "key", "left").select("key", "text", "anchors")
    table = scratch_table(joined.mapInArrow(_extend, TABLE), "substring-windows")
    chunks = table.filter("kind = 1")
    n = chunks.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    buckets = max(n // 8 // BUCKET, min(8 * parts, 1024)) + 1
    dealt = chunks.select("chunk", "owners", "counts", "hashes").mapInArrow(_windows(buckets), f"{ENTRIES}, chunk long")
    later = by_bucket(dealt, buckets).applyInPandas(_later, "chunk long, places binary")
    parted = chunks.select("chunk", "owners", "rows", "counts", "places").unionByName(later, allowMissingColumns=True)
    repeats = parted.groupBy("chunk").applyInPandas(_join_up, "key long, row long, from_word long, to_word long")
    return table.filter("kind = 0").select("key", "row", "n_words", "kept_sha256", "text"), repeats


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Maximal passages that an earlier document has: doc_id, from_word, to_word (exclusive), counted in words from 0."""
    docs, ids = _numbered(docs, text, doc_id)
    _, repeats = _tables(docs, text, doc_id)
    return _named(repeats.select("key", "from_word", "to_word"), ids).distinct()


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined
    by one space, as UTF-8; null where nothing is removed).

    A word goes if a window of 50 words covers it whose word sequence also starts in a document with a smaller doc_id.
    doc_id may have any type that can be ordered; of whole numbers, 2 ** 63 - 1 is taken for null.
    A null or empty text has no words; texts under 50 words lose none; a null doc_id comes after all others; rows that
    share a doc_id never remove each other's words, and each loses those of its own windows only; an empty table gives no rows; other
    columns play no part. Words and windows are compared by 64-bit hashes.
    """
    docs, ids = _numbered(docs, text, doc_id)
    table, repeats = _tables(docs, text, doc_id)
    per_doc = repeats.groupBy("row").agg(F.collect_set(F.struct("from_word", "to_word")).alias("repeats"))
    open_docs = table.filter("text is not null").join(per_doc, "row", "left")
    done = table.filter("text is null").withColumn("repeats", F.lit(None).cast("array<struct<from_word: bigint, to_word: bigint>>"))
    columns = ["key", "n_words", "kept_sha256", "text", "repeats"]
    out = open_docs.select(*columns).mapInArrow(_rest, "key long, n_words long, n_removed long, kept_sha256 string, kept binary")
    out = out.unionByName(done.select("key", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("kept")))
    return _named(out.select("key", "n_words", "n_removed", "kept_sha256", "kept"), ids)
