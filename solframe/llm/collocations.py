"""Phrase collocations by suffix-sigma: every phrase's occurrences from one shuffle of truncated suffixes.

1. Words are counted for each language, and a few suffixes of each chunk of words are noted as a sample.
2. Pieces are split at words that are too rare for any wanted phrase. Each remaining word starts a suffix of at most
   `max_n` words; equal suffixes of a chunk become one row with a count. Suffixes are dealt out by language and first
   word, and where one first word has too many, by the words after it: the sample gives the bounds, so a hot word, or a
   hot pair of words, is spread over as many partitions as it needs.
3. Spark sorts each partition in reverse lexicographic order, and one stack with a counter for each length runs over it.
   A phrase is counted when it leaves the stack. Only the phrases open at a partition's first and last row can go on in
   another one: their counts are emitted whatever they are, and added up.
4. The counts of a phrase's parts are joined to it.

Words are numbered by frequency, three bytes each. A vocabulary of more than `numbered` frequent words isn't brought
to the tasks: words then stand as 64-bit hashes, and pieces are not split at rare ones. The results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, small
from .words import BLOCK, Powers, mix

MAX_N, AT_LEAST, PERCENT, FIRST = 5, 100, 100, 2000
#: The most words that are numbered (21 bits); words in a chunk; suffixes that a chunk gives to the sample.
NUMBERED, CHUNK, SAMPLES = (1 << 21) - 1, 1 << 20, 32
#: Suffixes in a partition, about; the most partitions (Spark's sort spills where they are larger); the sample's size.
ROWS, PARTITIONS, SAMPLE = 1 << 20, 1 << 15, 1 << 17
#: Phrases are ranked in so many parts of a language first.
PARTS = 64

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP[list(BREAKS + b" \t")] = True
_BYTES = Powers(0x9E3779B97F4A7C15)


def _blocks(data: bytes) -> Iterator[bytes]:
    """The text in blocks of about BLOCK bytes, cut behind a byte that no word holds."""
    ends = BREAKS + b" \t"
    while len(data) > BLOCK:
        at = max(data.rfind(b, 0, BLOCK) for b in ends)
        if at < 0:
            at = min((x for b in ends if (x := data.find(b, BLOCK)) >= 0), default=len(data) - 1)
        yield data[: at + 1]
        data = data[at + 1 :]
    yield data


def _joined(texts: Sequence[bytes]) -> Iterator[bytes]:
    """Whole texts as one block after the other, a break between two texts."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        if size + len(text) > BLOCK and some:
            yield b"\n".join(some) + b"\n"
            some, size = [], 0
        if len(text) > BLOCK:
            yield from _blocks(text)
            yield b"\n"
            continue
        some.append(text)
        size += len(text) + 1
    if some:
        yield b"\n".join(some) + b"\n"


@dataclass
class Chunk:
    """Words of one language, one after the other: hash, number of the piece, and where the bytes are."""

    lang: str
    keys: list[np.ndarray] = field(default_factory=list)
    pieces: list[np.ndarray] = field(default_factory=list)
    spans: list[tuple[bytes, np.ndarray, np.ndarray]] = field(default_factory=list)
    size: int = 0
    at: int = 0
    left: int = 0

    def leave(self, n: int) -> Chunk:
        """A next chunk that begins with this one's last n words, which are no longer counted here."""
        keys, pieces = np.concatenate(self.keys)[-n:], np.concatenate(self.pieces)[-n:]
        self.left, out = len(keys), Chunk(self.lang, [keys], [pieces], [], 0, self.at)
        need = len(keys)
        for data, start, end in reversed(self.spans):
            out.spans.insert(0, (data, start[-need:], end[-need:]))
            need -= len(out.spans[0][1])
            if need <= 0:
                break
        return out

    @property
    def own(self) -> int:
        return sum(map(len, self.keys)) - self.left

    def add(self, data: bytes, seed: np.uint64, spans: bool) -> None:
        data = data.translate(_LOWER)
        raw = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_GAP[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        passed = np.cumsum(_BREAK[raw])
        if len(start):
            up, down = _BYTES.upto(len(raw) + 1)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            self.keys.append(mix(mix((sums[end] - sums[start]) * down[start]) ^ seed))
            self.pieces.append(self.at + passed[start])
            if spans:
                self.spans.append((data, start, end))
            self.size += len(start)
        self.at += int(passed[-1]) if len(passed) else 0


def _seed(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
    return mix(np.array([(data * _BYTES.upto(len(data))[0]).sum()], np.uint64))[0]


def _chunks(batches: Iterator[pa.RecordBatch], size: int, max_n: int, spans: bool) -> Iterator[Chunk]:
    """Chunks of about `size` words of rows (lang, text), whatever the number of languages and the length of a text.

    A chunk that ends within a text leaves its last words to the next one of the language, so no phrase is parted.
    """
    open_: dict[str, Chunk] = {}
    held = 0
    for batch in slices(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text.encode())
        for lang, some in texts.items():
            seed = _seed(lang)
            for block in _joined(some):
                chunk = open_.setdefault(lang, Chunk(lang))
                held -= chunk.size
                chunk.add(block, seed, spans)
                held += chunk.size
                while held >= size:
                    full = max(open_.values(), key=lambda c: c.size)
                    del open_[full.lang]
                    held -= full.size
                    if full is chunk and block != b"\n":
                        chunk = full.leave(max_n - 1)
                        open_[lang] = chunk
                    yield full
    yield from (c for c in open_.values() if c.keys)


def _following(keys: np.ndarray, pieces: np.ndarray, usable: np.ndarray, max_n: int) -> np.ndarray:
    """How many words the suffix at each place has: usable ones of the same piece, max_n at most."""
    n = np.zeros(len(keys), np.int64)
    alive = usable.copy()
    n += alive
    for k in range(1, max_n):
        m = max(len(keys) - k, 0)
        alive[:m] &= usable[k:] & (pieces[k:] == pieces[:m])
        alive[m:] = False
        n += alive
    return n


def _count_words(size: int, samples: int, max_n: int):
    """Rows (lang, key, word, sample, n): words of a chunk with their number; then sampled suffixes; then all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size, max_n, True):
            keys, pieces = np.concatenate(chunk.keys), np.concatenate(chunk.pieces)
            n = _following(keys, pieces, np.ones(len(keys), bool), max_n)
            every, keys = keys, keys[: chunk.own]
            found, first, counts = np.unique(keys, return_index=True, return_counts=True)
            edges = np.cumsum([0] + [len(s) for _, s, _ in chunk.spans])
            part = np.searchsorted(edges, first, "right") - 1
            words = []
            for i in range(len(found)):
                data, start, end = chunk.spans[part[i]]
                j = first[i] - edges[part[i]]
                words.append(data[start[j] : end[j]])
            at = np.unique(np.linspace(0, len(keys) - 1, samples + 2).astype(np.int64)[1:-1])
            suffixes = [every[i : i + n[i]].astype(">u8").tobytes() for i in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk.lang] * (len(found) + len(at) + 1)),
                    pa.array(np.concatenate([found, np.zeros(len(at) + 1, np.uint64)]).view(np.int64)),
                    pa.array(words + [None] * (len(at) + 1), pa.binary()),
                    pa.array([None] * len(found) + suffixes + [None], pa.binary()),
                    pa.array(np.concatenate([counts, np.ones(len(at), np.int64), [len(keys)]])),
                ],
                ["lang", "key", "word", "sample", "n"],
            )

    return run


@dataclass
class Numbers:
    """Word numbers of 1 to NUMBERED by falling frequency; without keys, words stand as their hashes."""

    keys: np.ndarray | None
    codes: np.ndarray | None

    @property
    def width(self) -> int:
        return 8 if self.keys is None else 3

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word; 0 for words too rare to have one."""
        if self.keys is None:
            return np.maximum(keys, np.uint64(1))
        if not len(self.keys):
            return np.zeros(len(keys), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.codes[at], 0).astype(np.uint64)

    def spell(self, matrix: np.ndarray) -> np.ndarray:
        """Rows of word numbers as fixed-length bytes, zeros behind the last word."""
        n, words = matrix.shape
        raw = np.ascontiguousarray(matrix.astype(">u8")).view(np.uint8).reshape(n, words, 8)[:, :, 8 - self.width :]
        return np.ascontiguousarray(raw).reshape(n, words * self.width)


def _sorted_rows(matrix: np.ndarray, width: int) -> np.ndarray:
    """The order of the rows, by their words one after the other."""
    if width == 8:
        return np.lexsort(tuple(matrix[:, k] for k in reversed(range(matrix.shape[1]))))
    packed = []
    for at in range(0, matrix.shape[1], 3):
        key = np.zeros(len(matrix), np.uint64)
        for k in range(at, at + 3):
            key = (key << np.uint64(21)) | (matrix[:, k] if k < matrix.shape[1] else np.uint64(0))
        packed.append(key)
    return np.lexsort(tuple(reversed(packed)))


def _suffixes(shared, size: int, max_n: int):
    """Rows (part, suffix, n): each chunk's suffixes of two words and more, equal ones as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bounds = shared.value
        for chunk in _chunks(batches, size, max_n, False):
            keys, pieces = np.concatenate(chunk.keys), np.concatenate(chunk.pieces)
            codes = numbers.of(keys)
            n = _following(codes, pieces, codes > 0, max_n)
            at = np.flatnonzero(n[: chunk.own] > 1)
            if not len(at):
                continue
            matrix = np.zeros((len(at), max_n), np.uint64)
            for k in range(max_n):
                here = n[at] > k
                matrix[here, k] = codes[at[here] + k]
            matrix = matrix[_sorted_rows(matrix, numbers.width)]
            new = np.ones(len(at), bool)
            new[1:] = (matrix[1:] != matrix[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            matrix, counts = matrix[first], np.diff(np.append(first, len(at)))
            raw = numbers.spell(matrix)
            lengths = (matrix > 0).sum(axis=1) * numbers.width
            part = np.searchsorted(bounds, raw.view(f"S{raw.shape[1]}").ravel(), "right") if len(bounds) else np.zeros(len(raw), np.int64)
            data = raw[np.arange(raw.shape[1]) < lengths[:, None]]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            suffix = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
            whole = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), suffix, pa.array(counts.astype(np.int64))], ["part", "suffix", "n"])
            for i in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(i, 1 << 16)

    return run


class Stack:
    """Counters of the phrases that the present suffix begins with, one for each length, over sorted suffixes.

    A batch's pushes and pops are done for all its rows at once; what is open at its end waits for the next batch.
    """

    def __init__(self, max_n: int, width: int, at_least: int) -> None:
        self.max_n, self.width, self.at_least = max_n, width, at_least
        self.last = np.zeros((1, max_n * width), np.uint8)
        self.open, self.counts, self.first = [b""] * (max_n + 1), [0] * (max_n + 1), [False] * (max_n + 1)
        self.begun = False

    def _rows(self, suffix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes as fixed-length bytes, and their numbers of words."""
        offsets = np.frombuffer(suffix.buffers()[1], np.int32)[suffix.offset : suffix.offset + len(suffix) + 1]
        lengths = np.diff(offsets)
        raw = np.zeros((len(suffix), self.max_n * self.width), np.uint8)
        raw[np.arange(raw.shape[1]) < lengths[:, None]] = np.frombuffer(suffix.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return raw, lengths // self.width

    def push(self, suffix: pa.Array, n: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """The phrases that left the stack and are frequent, or may go on in another partition; and their counts."""
        raw, words = self._rows(suffix)
        before = np.concatenate([self.last, raw[:-1]])
        same = np.ones(len(raw), bool)
        for k in range(1, self.max_n + 1):
            span = slice((k - 1) * self.width, k * self.width)
            same &= (raw[:, span] == before[:, span]).all(axis=1)
            if k < 2:
                continue
            here = words >= k
            sums = np.concatenate([[0], np.cumsum(np.where(here, n, 0))])
            starts = np.flatnonzero(here & ~same)
            if not len(starts):
                self.counts[k] += int(sums[-1])
                continue
            totals = np.diff(sums[np.append(starts, len(raw))])
            closed, count = [], []
            done = self.counts[k] + int(sums[starts[0]])
            if done and (self.first[k] or done >= self.at_least):
                closed.append(self.open[k])
                count.append(done)
            touches = not self.begun and starts[0] == 0
            keep = totals[:-1] >= self.at_least
            keep[:1] |= touches
            closed += [raw[i, : k * self.width].tobytes() for i in starts[:-1][keep]]
            count += totals[:-1][keep].tolist()
            self.open[k], self.counts[k], self.first[k] = raw[starts[-1], : k * self.width].tobytes(), int(totals[-1]), touches and len(starts) == 1
            if closed:
                yield closed, np.array(count, np.int64)
        self.last, self.begun = raw[-1:], True

    def rest(self) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """The phrases that are open at the partition's end, whatever their counts."""
        for k in range(2, self.max_n + 1):
            if self.counts[k]:
                yield [self.open[k]], np.array([self.counts[k]], np.int64)


def _count_prefixes(max_n: int, width: int, at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, width, at_least)
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1])], ["phrase", "n"])
        for batch in batches:
            if batch.num_rows:
                yield from map(out, stack.push(batch.column(0), batch.column(1).to_numpy()))
        yield from map(out, stack.rest())

    return run


def _bounds(samples: list[bytes], numbers: Numbers, parts: int, max_n: int) -> np.ndarray:
    """Suffixes that part the sampled ones into `parts` equal runs."""
    rows = []
    for s in samples:
        codes = numbers.of(np.frombuffer(s, ">u8").astype(np.uint64))
        n = len(codes) if codes.all() else int(np.argmin(codes))
        if n > 1:
            rows.append(np.concatenate([codes[:n], np.zeros(max_n - n, np.uint64)]))
    if not rows:
        return np.zeros(0, f"S{max_n * numbers.width}")
    raw = numbers.spell(np.stack(rows))
    order = np.sort(raw.view(f"S{raw.shape[1]}").ravel())
    return np.unique(order[(np.arange(1, parts) * len(order)) // parts])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, at_least: int = AT_LEAST, numbered: int = NUMBERED, chunk: int = CHUNK, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(phrases, words, totals, width): every phrase of 2 to max_n words with `at_least` occurrences, as (phrase, n).

    A phrase is its words' numbers, `width` bytes each. words: code (such a number), lang, word, n. totals: lang, n.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    counted = source.mapInArrow(_count_words(chunk, SAMPLES, max_n), "lang string, key long, word binary, sample binary, n long")
    counted = cut(counted.groupBy("lang", "key", "word", "sample").agg(F.sum("n").alias("n")).filter((F.col("n") >= at_least) | F.col("word").isNull()))
    totals = counted.filter("word is null and sample is null").select("lang", "n")
    frequent = counted.filter(F.col("word").isNotNull())
    known = frequent.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    numbers = Numbers(None, None)
    if known["words"] <= numbered:
        held = frequent.select("key", "n").toArrow()  # at most `numbered` rows of 16 bytes
        keys, n = held.column(0).to_numpy().view(np.uint64), held.column(1).to_numpy()
        by_number = np.lexsort((keys, -n))
        codes = np.empty(len(keys), np.uint32)
        codes[by_number] = np.arange(1, len(keys) + 1, dtype=np.uint32)
        by_key = np.argsort(keys)
        numbers = Numbers(keys[by_key], codes[by_key])
    taken = counted.filter("sample is not null").select("sample").orderBy(F.xxhash64("sample"), "sample").limit(SAMPLE)
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), known["n"] // rows + 1), PARTITIONS)
    bounds = _bounds([bytes(r["sample"]) for r in taken.collect()], numbers, parts, max_n)
    shared = spark.sparkContext.broadcast((numbers, bounds))
    suffixes = source.mapInArrow(_suffixes(shared, chunk, max_n), "part int, suffix binary, n long")
    dealt = suffixes.repartitionById(parts, "part").select("suffix", "n").sortWithinPartitions(F.col("suffix").desc())
    found = dealt.mapInArrow(_count_prefixes(max_n, numbers.width, at_least), "phrase binary, n long")
    phrases = cut(found.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        for batch in batches:
            codes = own.spell(own.of(batch.column(1).to_numpy().view(np.uint64))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(0), batch.column(2), batch.column(3)], ["code", "lang", "word", "n"])

    words = frequent.select("lang", "key", "word", "n").mapInArrow(coded, "code binary, lang string, word binary, n long")
    return phrases, cut(words.withColumn("word", F.col("word").cast("string"))), totals, numbers.width


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, at_least: int = AT_LEAST, percent: int = PERCENT, first: int = FIRST, **sizes: int
) -> DataFrame:
    """Each language's `first` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Candidates are phrases of 2 to max_n words with a >= at_least occurrences within pieces. The cut with the lowest
    floor(1000 * a * n / (l * r)), the shortest first part among equal ones, gives score, l and r. Candidates inside a
    longer one with at least `percent` of their occurrences go; one word more is enough to look at, as a phrase between
    the two is at least as frequent as the longer one. A null lang counts as `und`; null and empty texts have no words;
    repeated rows count each; texts are read whole; an empty table gives no rows; other columns play no part.
    """
    phrases, words, totals, width = phrase_counts(docs, text, lang, max_n, at_least, **sizes)
    size = F.octet_length("phrase") / width
    known = phrases.unionByName(words.select(F.col("code").alias("phrase"), "n"))
    known = small(cut(known))
    left, right = (known.select(F.col("phrase").alias(part), F.col("n").alias(n)) for part, n in (("head", "l"), ("tail", "r")))
    facts = words.select(F.col("code").alias("first"), "lang").join(small(totals.select(F.col("lang").alias("of"), F.col("n").alias("total"))), F.col("lang") == F.col("of")).drop("of")
    of = phrases.select("phrase", F.col("n").alias("a"), F.expr(f"substring(phrase, 1, {width})").alias("first")).join(small(facts), "first").drop("first")
    cuts = of.withColumn("k", F.explode(F.sequence(F.lit(1), (size - 1).cast("int"))))
    cuts = cuts.withColumn("head", F.expr(f"substring(phrase, 1, k * {width})")).withColumn("tail", F.expr(f"substring(phrase, k * {width} + 1)"))
    cuts = cuts.join(left, "head").join(right, "tail")
    score = F.expr("cast((cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(total as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("phrase", "a", "lang", "total").agg(lowest).select("phrase", "a", "lang", F.col("total").alias("n"), "best.score", "best.l", "best.r")
    longer = phrases.filter(size > 2).select(
        F.explode(F.array(F.expr(f"substring(phrase, 1, octet_length(phrase) - {width})"), F.expr(f"substring(phrase, {width} + 1)"))).alias("inner"), F.col("n").alias("outer_n")
    )
    inside = longer.groupBy("inner").agg(F.max("outer_n").alias("outer_n"))
    kept = scored.join(inside, (F.col("phrase") == F.col("inner")) & (100 * F.col("outer_n") >= percent * F.col("a")), "left_anti")
    kept = cut(kept)
    spelt = kept.select("phrase", F.posexplode(F.sequence(F.lit(1), F.octet_length("phrase"), F.lit(width))).alias("at", "byte"))
    spelt = spelt.withColumn("code", F.expr(f"substring(phrase, byte, {width})")).join(small(words.select("code", "word")), "code")
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("words"))  # max_n entries
    named = kept.join(spelt, "phrase").select("lang", F.col("words").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = named.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    return (
        best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(i)
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase
), total AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 100
), parts AS (
  SELECT c.lang, c.phrase, c.a, j, total.n, x.n AS l, y.n AS r, (1000::HUGEINT * a * total.n) // (x.n::HUGEINT * y.n) AS score
  FROM c JOIN total USING (lang), unnest(range(1, c.k)) AS u(j), f x, f y
  WHERE x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ') AND y.phrase = array_to_string(ws[j + 1:], ' ')
), best AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT c.lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(c.a) AS a
  FROM c, unnest(range(2, c.k)) AS u(m), unnest(range(1, c.k - m + 2)) AS v(i) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100 * i.a < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
