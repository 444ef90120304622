"""Compact rows for shuffles of very many hashes.

A map task deals the entries of a chunk of documents to buckets by hash and packs what goes to one bucket in one row, at
a few bytes an entry instead of a row each. Numbers are stored as byte planes, whose high planes are zeros that the
shuffle's compression removes; owners and places are small gaps, which an entropy coder makes smaller than a byte each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Shorter data are not worth a frame of the entropy coder.
SHORT = 64
_ZSTD = pa.Codec("zstd", compression_level=1)

#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes: all lowest bytes first."""
    v = np.ascontiguousarray(values.astype(kind))
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def squeeze(data: bytes) -> bytes:
    """The data, compressed if they are long enough; the first byte says which."""
    return b"\0" + data if len(data) < SHORT else b"\1" + len(data).to_bytes(4, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"\0" else _ZSTD.decompress(data[5:], int.from_bytes(data[1:5], "little"), asbytes=True)


def deal(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that gets entries, with their places in `hashes`. The bucket comes from the upper 32 bits."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint32))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def pack_owners(owner: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Owners of entries as (ids of the documents that occur, entries of each). owner: place in ids, ascending."""
    used, counts = np.unique(owner, return_counts=True)
    return squeeze(planes(np.diff(ids[used], prepend=0), "<i8")), squeeze(planes(counts, "<u4"))


def unpack_owners(ids: bytes, counts: bytes) -> np.ndarray:
    """The doc_id of each entry."""
    return np.repeat(np.cumsum(unplanes(unsqueeze(ids), "<i8")), unplanes(unsqueeze(counts), "<u4"))


def pack_places(places: np.ndarray, owner: np.ndarray) -> bytes:
    """Places of entries as gaps to the owner's entry before (modulo 2 ** 32). owner: as for `pack_owners`."""
    gaps = places.astype(np.uint32)
    same = owner[1:] == owner[:-1]
    gaps[1:][same] -= places[:-1].astype(np.uint32)[same]
    return squeeze(planes(gaps, "<u4"))


def unpack_places(places: bytes, counts: bytes) -> np.ndarray:
    """The places again; counts: those of `pack_owners`."""
    gaps, n = unplanes(unsqueeze(places), "<u4"), unplanes(unsqueeze(counts), "<u4")
    ends = np.cumsum(gaps, dtype=np.uint32)
    start = np.cumsum(n) - n
    return ends - np.repeat(ends[start] - gaps[start], n)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and the number of the run that each value is in."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
