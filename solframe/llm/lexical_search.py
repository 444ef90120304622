"""Ranked lexical search by Block-Max WAND over an index of compressed posting blocks.

The index is cut by documents: a task gathers documents until they hold `shard` terms and writes one row for each term
of the shard (and one for its documents), so nothing is shuffled to build it and no posting list grows with the corpus.
A list is cut into blocks of BLOCK postings: gaps of the documents' places and term frequencies, each as wide as the
block's largest needs. Outside the payload stand each block's last place and its largest impact.

A search meets a shard's lists for all queries of a block of queries. For one query, the ends of all blocks cut the
shard into intervals; the sum of the weighted block maxima bounds every score inside one. The shallow pointers move on
past intervals whose bound doesn't exceed the tenth best score so far, without a look into their blocks. In the others,
documents are decompressed, those whose own blocks' maxima exceed the threshold are pivots, and only for these
frequencies are decompressed and scores computed. Places follow doc_id, so a later document never wins a tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch_table, slices, small
from .words import BLOCK as BYTES
from .words import Powers, mix

#: Postings in a block; terms in a shard, about; results of an item.
BLOCK, SHARD, TOP = 128, 1 << 21, 10
#: Query terms that are brought to a shard at once, about.
QUERY_TERMS = 1 << 17
#: Results of an item are ranked in so many parts first.
PARTS = 64

INDEX = "shard long, term long, postings int, lasts binary, maxima binary, starts binary, widths binary, payload binary"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTES = Powers(0x9E3779B97F4A7C15)


def _parts(data: bytes) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about BYTES, each but the last cut behind a byte that no term holds."""
    raw, at = np.frombuffer(data, np.uint8), 0
    while len(raw) - at > BYTES:
        outside = np.flatnonzero(~_INSIDE[raw[at : at + BYTES]])
        size = int(outside[-1]) + 1 if len(outside) else BYTES
        while not len(outside) and at + size < len(raw):
            more = np.flatnonzero(~_INSIDE[raw[at + size : at + size + BYTES]])
            size += int(more[0]) + 1 if len(more) else BYTES
            if len(more):
                break
        yield raw[at : at + size]
        at += size
    yield raw[at:]


def _edges(raw: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _INSIDE[raw]
    return np.flatnonzero(inside[1:] != inside[:-1])


def _joined(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts, or parts of a long one: place of the first text, bytes, end of each text in them."""
    some: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        if some and size + len(text) > BYTES:
            yield first, np.frombuffer(b" ".join(some), np.uint8), np.cumsum([len(s) + 1 for s in some])
            some, size = [], 0
        if len(text) > BYTES:
            for part in _parts(text):
                yield i, part, np.array([len(part) + 1])
            continue
        first = first if some else i
        some.append(text)
        size += len(text) + 1
    if some:
        yield first, np.frombuffer(b" ".join(some), np.uint8), np.cumsum([len(s) + 1 for s in some])


def term_counts(texts: list[bytes]) -> np.ndarray:
    """The number of terms of each text."""
    out = np.zeros(len(texts), np.int64)
    for first, raw, ends in _joined(texts):
        starts = _edges(raw)[::2]
        out[first : first + len(ends)] += np.diff(np.searchsorted(starts, ends), prepend=0)
    return out


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of all texts, one after the other, and the place of its text."""
    hashes, owners = [], []
    for first, raw, ends in _joined(texts):
        raw = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
        edges = _edges(raw)
        start, end = edges[::2], edges[1::2]
        up, down = _BYTES.upto(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * down[start]))
        owners.append(first + np.searchsorted(ends, start, "right"))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _widths(largest: np.ndarray) -> np.ndarray:
    """Bytes that hold a block's largest number: 1, 2 or 4."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.uint8)


def _scatter(data: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for byte in range(4):
        here = width > byte
        data[at[here] + byte] = (values[here] >> (8 * byte)).astype(np.uint8)


def _cells(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def _posting_rows(shard: int, terms: np.ndarray, places: np.ndarray, m: np.ndarray, block: int) -> pa.RecordBatch:
    """The lists of a shard: one row a term. places: of the terms' documents; m: of each document."""
    order = np.lexsort((places, terms))
    terms, places = terms[order], places[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (places[1:] != places[:-1])
    first = np.flatnonzero(new)
    terms, places, tf = terms[first], places[first], np.diff(np.append(first, len(new)))
    heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    sizes = np.diff(np.append(heads, len(terms)))
    nth = np.arange(len(terms)) - np.repeat(heads, sizes)
    starts = np.flatnonzero(nth % block == 0)
    length = np.diff(np.append(starts, len(terms)))
    blocks = -(-sizes // block)
    gaps = places - np.concatenate([[0], places[:-1]])
    gaps[starts] = places[starts]
    of = np.repeat(np.arange(len(starts)), length)
    wide, tall = _widths(np.maximum.reduceat(gaps, starts)), _widths(np.maximum.reduceat(tf, starts))
    bytes_ = length * (wide.astype(np.int64) + tall)
    ends = np.cumsum(bytes_)
    begin = ends - bytes_
    data = np.zeros(int(ends[-1]), np.uint8)
    inner = np.arange(len(terms)) - np.repeat(starts, length)
    _scatter(data, begin[of] + inner * wide[of], gaps, wide[of])
    _scatter(data, begin[of] + (length * wide.astype(np.int64))[of] + inner * tall[of], tf, tall[of])
    upto = np.concatenate([[0], np.cumsum(blocks)])
    origin = begin[upto[:-1]]
    best = np.maximum.reduceat(impacts(tf, m[places]), starts)
    last = places[starts + length - 1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(heads), shard)), pa.array(terms[heads].view(np.int64)), pa.array(sizes.astype(np.int32)),
            _cells(last.astype("<u4").view(np.uint8), upto * 4), _cells(best.astype("<u4").view(np.uint8), upto * 4),
            _cells((begin - np.repeat(origin, blocks)).astype("<u4").view(np.uint8), upto * 4),
            _cells(np.stack([wide, tall], axis=1).ravel(), upto * 2), _cells(data, np.append(origin, ends[-1])),
        ],
        ["shard", "term", "postings", "lasts", "maxima", "starts", "widths", "payload"],
    )


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in slices(batches):
            counts = term_counts([(t or "").encode() for t in batch.column(0).to_pylist()])
            n, terms = n + int((counts > 0).sum()), terms + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], ["n", "terms"])

    found = docs.select(docs[text].alias("text")).mapInArrow(run, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return found["n"] or 0, found["terms"] or 0


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """(index, N, L). index, written as Parquet: INDEX, a row for each shard and term, and one for its documents.

    The documents' row has no term: `lasts` holds doc_ids (as int64, ascending; `starts` one byte each, 1 for null),
    `maxima` each document's m. doc_id is a whole number; null ids come last. A null text has no terms, documents
    without terms are in no list, rows that repeat a doc_id are documents of their own, other columns play no part.
    """
    n, total = corpus_size(docs, text)
    index = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_index(n, total, block, shard), INDEX)
    return scratch_table(index, "lexical-index"), n, total


def _index(n_docs: int, total: int, block: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, terms, owners, held, docs = [], [], [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal ids, terms, owners, held, docs, made
            own, t, at = pa.chunked_array(ids).combine_chunks(), np.concatenate(terms), np.concatenate(owners)
            null = own.is_null().to_numpy(zero_copy_only=False)
            key = own.fill_null(0).to_numpy()
            order = np.lexsort((key, null))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lengths = np.bincount(at, minlength=len(order))[order]
            m = 25 + (75 * lengths * n_docs) // max(total, 1)
            shard = (part << 32) + made
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard]), pa.array([None], pa.int64()), pa.array([len(order)], pa.int32()), pa.array([key[order].astype("<i8").tobytes()], pa.binary()),
                    pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([null[order].astype(np.uint8).tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()),
                ],
                ["shard", "term", "postings", "lasts", "maxima", "starts", "widths", "payload"],
            )
            if len(t):
                whole = _posting_rows(shard, t, place[at], m, block)
                for i in range(0, whole.num_rows, 1 << 15):
                    yield whole.slice(i, 1 << 15)
            ids, terms, owners, held, docs, made = [], [], [], 0, 0, made + 1

        for batch in slices(batches, 64):
            hashes, owner = term_hashes([(t or "").encode() for t in batch.column(1).to_pylist()])
            ids.append(batch.column(0))
            terms.append(hashes)
            owners.append(owner + docs)
            held, docs = held + len(hashes), docs + batch.num_rows
            if held >= size or docs >= size:
                yield from rows()
        if docs:
            yield from rows()

    return run


class Shard:
    """A shard's lists for the terms of some queries; blocks are decompressed once, when a query needs them."""

    def __init__(self, rows: pa.Table) -> None:
        self.lists = {}
        for row in zip(*(rows.column(c).to_pylist() for c in ("term", "postings", "lasts", "maxima", "starts", "widths", "payload"))):
            term, n, lasts, maxima, starts, widths, payload = row
            if term is None:
                self.ids, self.m, self.null = np.frombuffer(lasts, "<i8"), np.frombuffer(maxima, "<i8"), np.frombuffer(starts, np.uint8).astype(bool)
                continue
            self.lists[term] = (n, np.frombuffer(lasts, "<u4").astype(np.int64), np.frombuffer(maxima, "<u4").astype(np.int64), np.frombuffer(starts, "<u4"), widths, payload)
        self.places: dict[tuple[int, int], np.ndarray] = {}
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, term: int, b: int) -> tuple[int, int, int]:
        """Number of postings, first byte, width of a gap."""
        n, lasts, _, starts, widths, payload = self.lists[term]
        end = int(starts[b + 1]) if b + 1 < len(starts) else len(payload)
        return (end - int(starts[b])) // (widths[2 * b] + widths[2 * b + 1]), int(starts[b]), widths[2 * b]

    def docs(self, term: int, b: int) -> np.ndarray:
        got = self.places.get((term, b))
        if got is None:
            count, at, wide = self._block(term, b)
            got = self.places[term, b] = np.cumsum(np.frombuffer(self.lists[term][5], f"<u{wide}", count, at), dtype=np.int64)
        return got

    def impacts(self, term: int, b: int) -> np.ndarray:
        got = self.found.get((term, b))
        if got is None:
            count, at, wide = self._block(term, b)
            tf = np.frombuffer(self.lists[term][5], f"<u{self.lists[term][4][2 * b + 1]}", count, at + count * wide).astype(np.int64)
            got = self.found[term, b] = impacts(tf, self.m[self.docs(term, b)])
        return got

    def search(self, query: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the `top` best documents with a score above 0, best first, ties by place.

        query: terms with their weights, repeats multiplied in.
        """
        lists = [(t, w, self.lists[t][1], w * self.lists[t][2]) for t, w in query if w > 0 and t in self.lists]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return places, scores
        ends = np.unique(np.concatenate([lasts for _, _, lasts, _ in lists]))
        bound, touched = np.zeros(len(ends), np.int64), []
        for _, _, lasts, maxima in lists:
            b = np.searchsorted(lasts, ends)
            touched.append(b)
            bound[: len(b)] += np.append(maxima, 0)[b]
        at, step, threshold = 0, 1, 0
        while at < len(ends):
            ahead = np.flatnonzero(bound[at:] > threshold)[:step]  # the shallow move
            if not len(ahead):
                break
            chosen, at, step = ahead + at, int(ahead[-1]) + at + 1, min(2 * step, 64)
            low = np.concatenate([[-1], ends])[chosen]
            first, last = int(low[0]) + 1, int(ends[chosen[-1]])
            wanted = np.zeros(last - first + 1, bool)
            for a, z in zip(low, ends[chosen]):
                wanted[a + 1 - first : z + 1 - first] = True
            reach, parts = np.zeros(len(wanted), np.int64), []
            for (term, weight, lasts, maxima), b in zip(lists, touched):
                for i in np.unique(b[chosen]):
                    if i < len(lasts):
                        docs = self.docs(term, int(i)) - first
                        inside = (docs >= 0) & (docs < len(wanted))
                        reach[docs[inside]] += maxima[i]
                        parts.append((term, weight, int(i), docs, inside))
            pivots = wanted & (reach > threshold)
            score = np.zeros(len(wanted), np.int64)
            for term, weight, i, docs, inside in parts:
                here = inside.copy()
                here[inside] = pivots[docs[inside]]
                if here.any():
                    score[docs[here]] += weight * self.impacts(term, i)[here]
            better = np.flatnonzero(pivots & (score > threshold))
            places, scores = np.concatenate([places, better + first]), np.concatenate([scores, score[better]])
            if len(places) > top:
                best = np.lexsort((places, -scores))[:top]
                places, scores = places[best], scores[best]
            if len(places) == top:
                threshold = int(scores.min())
        best = np.lexsort((places, -scores))
        return places[best], scores[best]


def _search(shared, top: int):
    """Rows (item, doc_id, score): each item's best documents of a shard."""

    def run(rows: pa.Table) -> pa.Table:
        shard, items, places, scores = Shard(rows), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, query in shared.value:
            found, score = shard.search(query, top)
            items.append(np.full(len(found), item))
            places.append(found)
            scores.append(score)
        place = np.concatenate(places)
        ids = pa.array(shard.ids[place], mask=shard.null[place])
        return pa.table([pa.array(np.concatenate(items)), ids, pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])

    return run


def query_terms(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each item and term: item (its id), term, times. Items that share an id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, owner = term_hashes([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["item", "term"])

    rows = items.select(items[item_id].alias("item"), items[text].alias("text"))
    return rows.mapInArrow(run, f"item {rows.dtypes[0][1]}, term long").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def search(index: DataFrame, n_docs: int, terms: DataFrame, top: int = TOP, query_rows: int = QUERY_TERMS) -> DataFrame:
    """The `top` documents of each item: item_id, rank, doc_id, score.

    terms: as from `query_terms`. Queries are brought to the shards in blocks of about `query_rows` terms, whole items.
    """
    spark = index.sparkSession
    terms = cut(terms)
    wanted = small(cut(terms.select("term").distinct()))
    df = index.select("term", "postings").join(wanted, "term").groupBy("term").agg(F.sum("postings").alias("df"))
    numbered = cut(terms.select("item").distinct().select(F.col("item").alias("item_id"), F.monotonically_increasing_id().alias("number")))
    known = cut(terms.join(df, "term").join(numbered, F.col("item").eqNullSafe(F.col("item_id"))).select("number", "term", "times", "df"))
    blocks = known.count() // query_rows + 1
    known = known.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    heads = index.filter("term is null")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * heads.count())  # a shard's work is far more than its bytes
    lists = index.join(wanted, "term", "left_semi").unionByName(heads).repartition(tasks, "shard")
    out = None
    for block in range(blocks):
        queries: dict[int, list[tuple[int, int]]] = {}
        for r in known.filter(F.col("block") == block).orderBy("number", "term").collect():  # about `query_rows` rows
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
            queries.setdefault(r["number"], []).append((r["term"], weight * r["times"]))
        shared = spark.sparkContext.broadcast(list(queries.items()))
        found = lists.groupBy("shard").applyInArrow(_search(shared, top), "item long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(small(numbered), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", top: int = TOP, block: int = BLOCK, shard: int = SHARD,
    query_rows: int = QUERY_TERMS,
) -> DataFrame:
    """The `top` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score above 0.

    All of `docs` is indexed and ranked. Equal scores go by doc_id, null ids last (doc_id is a whole number). Null and
    empty texts have no terms: such documents are never found, such items find nothing. Rows that repeat a doc_id are
    documents of their own, so an id may be found twice; items that share an id, null among them, are one query with
    the terms of all. An empty table gives no rows; other columns play no part.
    """
    index, n, _ = build_index(docs, text, doc_id, block, shard)
    return search(index, n, query_terms(items, item_text, item_id), top, query_rows)


SQL = r"""
WITH t AS (
  SELECT rowid_ AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents)
), d AS (
  SELECT row, doc_id, ts, len(ts)::HUGEINT AS n FROM t WHERE len(ts) > 0
), c AS (
  SELECT count(*)::HUGEINT AS docs, sum(n) AS terms FROM d
), p AS (
  SELECT row, term, count(*)::HUGEINT AS tf FROM (SELECT row, unnest(ts) AS term FROM d) GROUP BY row, term
), q AS (
  SELECT item_id, term, count(*)::HUGEINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM p, c GROUP BY term, docs
), s AS (
  SELECT q.item_id, d.doc_id, d.row, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * d.n * c.docs) // c.terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.row = p.row, c GROUP BY q.item_id, d.doc_id, d.row
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
