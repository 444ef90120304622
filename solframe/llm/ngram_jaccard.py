"""N-gram Jaccard join by a token-group matrix.

Documents that could be similar are partitioned into groups; each group stores the union of its members' tokens; a
query's overlap with the union bounds its similarity to every member, so only groups whose bound reaches the threshold
are opened and their members compared exactly.

1. Documents with equal shingle sets are one class, and one of them stands for it.
2. Sieve: in the order of their hashes, the first shingles of two similar sets overlap in a number that the threshold
   gives (a prefix filter that asks for several common shingles). A set whose first shingles are shared by others less
   often than that is similar to none. What is left is a small part of most corpora, and only its sets travel on.
3. Neighbourhoods: the hash space is cut into more segments than two similar sets can differ in, so they agree on a
   whole segment. Connected sets are a neighbourhood, and no similar pair lies outside one.
4. A neighbourhood is partitioned by size and least token into groups of about GROUP members. Members of a group are
   compared with each other, and its union is stored as a row of token columns (a column that is empty in the union is
   a token that no member has).
5. Large components of the groups send REPS members each into further rounds of groups, so that the copies of one text
   are connected by a few comparisons each, however many they are.
6. Members outside the largest component of their neighbourhood are its queries. In an order that puts tokens first
   that are rare in the neighbourhood, the first tokens of similar sets have one in common: a query meets the unions of
   those groups of which some member shares such a token, unless it has too many tokens of its own, and qualifying
   groups are opened. A pair that lies within one component needs no comparison.

No step brings all pairs or all unions of a neighbourhood together: groups and blocks of queries are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bucket, cut, fresh, scratch_table, slices, small
from .components import components
from .packs import deal, pack_owners, planes, runs, unpack_owners, unplanes
from .words import mix, spans, windows, word_hashes

#: Members of a group and tokens of a group or of a block of queries, about; queries in a block of an opened group.
GROUP, TOKENS, OPEN_BLOCK = 64, 1 << 20, 256
#: Members that stand for a large component in the next round, and the size that makes it one.
REPS, LARGE = 4, 8
#: Words in a chunk of a map task; entries in a bucket, about; growth of the size classes.
CHUNK, BUCKET, GROWTH = 1 << 19, 1 << 20, 1.35
#: Tokens of a neighbourhood's sample, about, and those of them that are known as common at most.
SAMPLED, COMMON = 1 << 20, 1 << 15
#: Common first shingles that the sieve asks for, as a share of the set in percent.
SPARE = 10
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def size_classes(upto: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size classes."""
    bounds = [1]
    while bounds[-1] < upto:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * GROWTH)))
    return np.array(bounds)


_CLASSES = size_classes()


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lowered; a text with fewer words is one shingle."""
    words, counts = word_hashes([t.translate(_LOWER) for t in texts])
    for a, b in spans(counts):
        yield np.unique(windows(words[a:b], min(width, b - a))) if b > a else words[:0]


def spare(n: int, percent: int) -> int:
    """Common first shingles that two similar sets have, if n is the size of the smaller one."""
    return min(-(-percent * n // 100), 1 + SPARE * n // 100)


def first_shingles(tokens: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's first shingles that two similar sets of n and m have min(spare(n), spare(m)) in common.

    They have c = percent * n / 100 in common at least, and all but c - spare(n) of the smaller of the two ends of
    these first shingles come before that end in both sets.
    """
    n = len(tokens)
    return tokens[: n - -(-percent * n // 100) + spare(n, percent)]


def needed(n: Column, percent: int) -> Column:
    """`spare` of the smallest set that is similar to one of size n."""
    least = F.floor((F.lit(percent) * n + 99) / 100)
    return F.least(F.floor((F.lit(percent) * least + 99) / 100), F.floor(1 + F.lit(SPARE) * least / 100))


def _parts(tokens: np.ndarray, parts: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the segments that have tokens, and the numbers of those that have none."""
    m = np.sort(mix(tokens + np.uint64(tag)))
    counts = np.bincount(((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), minlength=parts)
    full, empty = np.flatnonzero(counts), np.flatnonzero(counts == 0)
    sums = np.add.reduceat(m, np.cumsum(counts)[full] - counts[full]) if len(full) else m
    return mix(sums + mix((full + (tag << 32)).astype(np.uint64))), empty


def segments(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of a set's segments: two sets of the given similarity share one at least."""
    n, out = len(tokens), []
    c = int(np.searchsorted(_CLASSES, n, side="right")) - 1
    last = max(c, int(np.searchsorted(_CLASSES, 100 * n // percent, side="right")) - 1)  # class of the largest similar set
    for k in range(c, last + 1):
        differ = 2 * (int(_CLASSES[k + 1]) - 1) * (100 - percent) // (100 + percent)
        if not differ:
            continue  # only equal sets are similar at this size
        over = 8 + differ // 5  # differ + 1 + over segments: over + 1 agree at least
        found, empty = _parts(tokens, differ + 1 + over, k)
        out.append(found)
        if len(empty) > over:  # they may agree on empty ones only, if both sets are such
            out.append(mix(mix((empty + (k << 32)).astype(np.uint64))))
    return np.concatenate(out) if out else tokens[:0]


def bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Token columns of sets that are compared with each other, as 64-bit words: about eight for each token."""
    columns = 1 << max(9, int(8 * max(map(len, sets))).bit_length())
    out = np.zeros((len(sets), columns // 8), np.uint8)
    row = np.zeros(columns, np.uint8)
    for i, s in enumerate(sets):
        at = s & np.uint64(columns - 1)
        row[at] = 1
        out[i] = np.packbits(row, bitorder="little")
        row[at] = 0
    return out.view(np.uint64)


def union_row(sets: list[np.ndarray]) -> bytes:
    """Token columns of a group, as bytes: four or more for each token."""
    columns = 1 << max(9, int(4 * sum(map(len, sets))).bit_length())
    row = np.zeros(columns, np.uint8)
    for s in sets:
        row[s & np.uint64(columns - 1)] = 1
    return np.packbits(row, bitorder="little").tobytes()


def overlaps(union: bytes, tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Tokens of each query that the union may hold. tokens: those of all queries, none empty; start: of each."""
    row = np.frombuffer(union, np.uint8)
    at = tokens & np.uint64(8 * len(row) - 1)
    return np.add.reduceat((row[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, start, dtype=np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= 6 * CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _signature(tokens: np.ndarray) -> bytes | None:
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _owner(signature: bytes) -> int:
    return int.from_bytes(signature[:8], "little", signed=True)


def _classify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):  # doc_id, h, text
            sets = list(shingle_sets(batch.column(2).to_pylist(), width))
            signs = [_signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary()), pa.array([s and _owner(s) for s in signs], pa.int64())],
                ["doc_id", "h", "n", "sig", "owner"],
            )

    return run


ENTRIES = "bucket long, owners binary, counts binary, hashes binary, known binary"


def _entry_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 512):
        cols = list(zip(*rows[i : i + 512]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "owners", "counts", "hashes", "known"])


def _sieve(width: int, percent: int, buckets: int):
    """First shingles of each class of a chunk, dealt to buckets; those that a chunk's classes share go once, as known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for _, texts in _chunks(batches):
            classes = {_owner(_signature(s)): first_shingles(s, percent) for s in shingle_sets(texts, width) if len(s)}
            if not classes:
                continue
            ids = np.array(sorted(classes), np.int64)
            each = [classes[i] for i in ids.tolist()]
            hashes = mix(np.concatenate(each) + np.uint64(1))
            owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
            order = np.argsort(hashes, kind="stable")
            start, run_of = runs(hashes[order])
            shared = np.zeros(len(hashes), bool)
            shared[order] = (np.diff(np.append(start, len(hashes))) > 1)[run_of]
            here = np.bincount(owner[shared], minlength=len(each))
            out = [(-1 - task, planes(ids[here > 0], "<i8"), planes(here[here > 0], "<u4"), b"", b"")] if here.any() else []
            send = np.sort(order[start])
            for b, x in deal(hashes[send], buckets):
                x = send[x]
                out.append((b, *pack_owners(owner[x], ids), planes(hashes[x] & np.uint64(0xFFFFFFFF), "<u4"), np.packbits(shared[x]).tobytes()))
            yield from _entry_batches(out)

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """How many of its first shingles each class shares with others, as far as this bucket shows."""
    if rows["bucket"].iloc[0] < 0:
        ids, n = (np.concatenate([unplanes(x, k) for x in rows[c]]) for c, k in (("owners", "<i8"), ("counts", "<u4")))
        return pd.DataFrame({"owner": ids, "shared": n.astype(np.int64)})
    ids = np.concatenate([unpack_owners(a, b) for a, b in zip(rows["owners"], rows["counts"])])
    hashes = np.concatenate([unplanes(x, "<u4") for x in rows["hashes"]])
    known = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8), count=len(x) // 4).astype(bool) for k, x in zip(rows["known"], rows["hashes"])])
    order = np.argsort(hashes, kind="stable")
    start, run_of = runs(hashes[order])
    ids, known = ids[order], known[order]
    several = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)) | np.maximum.reduceat(known, start)
    owner, n = np.unique(ids[several[run_of] & ~known], return_counts=True)  # known ones were counted in their chunk
    return pd.DataFrame({"owner": owner, "shared": n})


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text").to_pylist(), width))
            place = [float(mix(s).min()) / 2.0**64 for s in sets]
            size = np.searchsorted(_CLASSES, [len(s) for s in sets], side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(size, pa.int64()), pa.array(place, pa.float64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "n", "size", "place", "tokens"],
            )

    return run


def _scatter(percent: int, buckets: int):
    """Segments of the sets, dealt to buckets; within a slice of rows each goes once, and its other owners link to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for keys, tokens in _chunks(batches):
            ids = np.array(keys, np.int64)
            each = [segments(np.frombuffer(t, np.uint64), percent) for t in tokens]
            hashes = np.concatenate(each)
            owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
            order = np.argsort(hashes, kind="stable")
            start, run_of = runs(hashes[order])
            lead = np.zeros(len(hashes), np.int64)
            lead[order] = owner[order[start]][run_of]
            pairs = np.unique(np.stack([owner, lead])[:, owner != lead], axis=1)
            out = [(-1 - task, planes(ids[pairs[0]], "<i8"), b"", planes(ids[pairs[1]], "<i8"), b"")] if pairs.size else []
            send = np.sort(order[start])
            for b, x in deal(hashes[send], buckets):
                x = send[x]
                out.append((b, *pack_owners(owner[x], ids), planes(hashes[x], "<u8")[: 6 * len(x)], b""))  # 48 bits of each
            yield from _entry_batches(out)

    return run


def _link(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a bucket that share a segment, each with the least of them."""
    if rows["bucket"].iloc[0] < 0:
        a, b = (np.concatenate([unplanes(x, "<i8") for x in rows[c]]) for c in ("owners", "hashes"))
    else:
        ids = np.concatenate([unpack_owners(a, b) for a, b in zip(rows["owners"], rows["counts"])])
        h = np.concatenate([unplanes(x + bytes(len(x) // 3), "<u8") for x in rows["hashes"]])
        order = np.lexsort((ids, h))
        start, run_of = runs(h[order])
        a, b = ids[order], ids[order[start]][run_of]
    pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


class _Forest:
    """Union-find over the rows of a group; rows that share a label start connected."""

    def __init__(self, labels: np.ndarray) -> None:
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of].tolist()

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def _compare(sets: list[np.ndarray], percent: int, forest: _Forest, pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Similar pairs that connect what is not connected yet. pairs: a row and the rows to compare it with."""
    n, bits = np.array([len(s) for s in sets]), bit_rows(sets)
    for i, others in pairs:
        others = others[[forest.top(j) != forest.top(i) for j in others.tolist()]] if len(others) else others
        if not len(others):
            continue
        need = -(-percent * (n[i] + n[others]) // (100 + percent))
        others, need = (x[np.minimum(n[i], n[others]) >= need] for x in (others, need))
        fit = n[i] - np.bitwise_count(bits[i] & ~bits[others]).sum(axis=1) >= need
        for j, least in zip(others[fit].tolist(), need[fit].tolist()):
            if forest.top(i) != forest.top(j) and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least:
                forest.join(i, j)
                yield i, j


#: 0: edge (a, b). 1: union of a group (a: hood, b: group, low and high sizes, tokens, bits). 2: member that stands for a
#: component of its group (a: node, b: component, low: hood, place).
FOUND = "kind int, a long, b long, low long, high long, tokens long, place double, bits binary"


def _inside(percent: int, first: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A group: edges, its union (in the first round), and members that stand for its (large) components."""
        rows = rows.sort_values("node")
        nodes, place, hood = rows["node"].to_numpy(), rows["place"].to_numpy(), rows["hood"].iloc[0]
        sets = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        forest, everyone = _Forest(rows["label"].to_numpy()), np.arange(len(rows))
        pairs = ((i, everyone[i + 1 :]) for i in range(len(rows)))
        out = [(0, nodes[i], nodes[j], 0, 0, 0, 0.0, None) for i, j in _compare(sets, percent, forest, pairs)]
        top = np.array([forest.top(i) for i in range(len(rows))])
        if first:
            n = [len(s) for s in sets]
            out.append((1, hood, rows["group"].iloc[0], min(n), max(n), sum(n), 0.0, union_row(sets)))
        for t in np.unique(top):
            own = np.flatnonzero(top == t)
            if len(own) >= LARGE or not first:
                out += [(2, nodes[i], nodes[own[0]], hood, 0, 0, place[own].min(), None) for i in own[np.linspace(0, len(own) - 1, min(len(own), REPS)).astype(int)]]
        return pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _common(rows: pd.DataFrame) -> pd.DataFrame:
    """Tokens that several of a neighbourhood's sampled members have, the rarest first."""
    tokens, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["tokens"]]), return_counts=True)
    tokens, counts = tokens[counts > 1], counts[counts > 1]
    order = np.lexsort((tokens, counts))[-COMMON:]
    return pd.DataFrame({"hood": [rows["hood"].iloc[0]], "common": [tokens[order].tobytes()]})


def rare_first(tokens: np.ndarray, percent: int, common: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """So many of a set's tokens that two similar sets have one in common, those not known as common first; and how many
    of these there are.

    common: sorted tokens; place: that of each in the order of the common ones.
    """
    upto = len(tokens) - -(-percent * len(tokens) // 100) + 1
    rank = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, place[at] + 1, 0)
    return tokens[np.argsort(rank, kind="stable")[:upto]], min(int((rank == 0).sum()), upto)  # tokens are sorted


def _first_tokens(percent: int):
    def run(members: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """First tokens of a block of members: hood, token, node, group; rare: the token isn't known as common; ended: the
        member has a common token among them, so all of its others are here.
        """
        if not len(members):
            return pd.DataFrame({"hood": [], "token": [], "node": [], "group": [], "rare": [], "ended": []})
        common = np.frombuffer(known["common"].iloc[0], np.uint64) if len(known) else np.zeros(0, np.uint64)
        order = np.argsort(common)
        found = [rare_first(np.frombuffer(x, np.uint64), percent, common[order], order) for x in members["tokens"]]
        n, rare = np.array([len(x) for x, _ in found]), np.array([r for _, r in found])
        spread = lambda c: np.repeat(members[c].to_numpy(), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({"hood": spread("hood"), "token": np.concatenate([x for x, _ in found]).view(np.int64), "node": spread("node"), "group": spread("group"), "rare": nth < np.repeat(rare, n), "ended": np.repeat(rare < n, n)})

    return run


def _bound(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Those of a block of queries whose bound by the group's union qualifies."""
        union, queries = rows[rows["bits"].notna()], rows[rows["bits"].isna()]
        if not len(queries):
            return pd.DataFrame({"node": [], "group": []}, dtype="int64")
        n = queries["n"].to_numpy()
        found = overlaps(union["bits"].iloc[0], np.concatenate([np.frombuffer(x, np.uint64) for x in queries["tokens"]]), np.cumsum(n) - n)
        return queries.loc[100 * found >= percent * n, ["node", "group"]]

    return run


def _open(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Edges that connect queries with members of an opened group."""
        nodes, query = rows["node"].to_numpy(), rows["query"].to_numpy()
        members = np.flatnonzero(~query)
        pairs = ((i, members) for i in np.flatnonzero(query).tolist())
        found = _compare([np.frombuffer(x, np.uint64) for x in rows["tokens"]], percent, _Forest(rows["label"].to_numpy()), pairs)
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    return run


def _parts_of(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _survivors(rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Classes that the sieve lets through. rows: text; classes: owner, n and more."""
    size = classes.agg(F.sum("n")).first()[0] or 0
    first = size * (100 - percent + SPARE) // 100
    buckets = max(first // BUCKET, min(_parts_of(rows), 1024)) + 1
    dealt = rows.select("h", "text").mapInArrow(_sieve(width, percent, buckets), ENTRIES)
    shared = by_bucket(dealt, buckets).applyInPandas(_shared, "owner long, shared long").groupBy("owner").agg(F.sum("shared").alias("shared"))
    return classes.join(shared, "owner").filter(F.col("shared") >= needed(F.col("n"), percent)).drop("shared")


def _grouped(members: DataFrame, *salt: str) -> DataFrame:
    """Add group. members: hood, size, place, n and `salt`, whose rows stay together in a cell that is cut up."""
    totals = members.groupBy("hood", "size").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / TOKENS)).alias("cells"))
    celled = members.join(totals, ["hood", "size"]).withColumn("cell", F.floor(F.col("place") * F.col("cells")))
    full = celled.groupBy("hood", "size", "cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / (2 * GROUP), F.sum("n") / (2 * TOKENS))).alias("cuts"))
    cut_up = celled.join(full, ["hood", "size", "cell"]).withColumn("group", F.xxhash64("hood", "size", "cell", F.pmod(F.xxhash64(*salt), F.col("cuts"))))
    return cut_up.drop("cells", "cell", "cuts")


def _tournament(sets: DataFrame, inside: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of all members, their unions, and the edges of all rounds."""
    spark = sets.sparkSession
    tokens = sets.select("node", "tokens")
    groups = cut(_grouped(inside, "node"))
    dealt = small(groups.withColumn("label", F.col("node"))).join(tokens, "node")
    found = scratch_table(dealt.groupBy("group").applyInPandas(_inside(percent, True), FOUND), "jaccard-groups")
    unions = found.filter("kind = 1").select(F.col("a").alias("hood"), F.col("b").alias("group"), "low", "high", "bits")
    edges, last = found.filter("kind = 0").select("a", "b"), None
    several = cut(unions.groupBy("hood").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("hood"))
    while True:
        reps = found.filter("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("label"), F.col("low").alias("hood"), "place")
        open_hoods = reps.groupBy("hood").agg(F.countDistinct("label").alias("labels")).filter("labels > 1").select("hood")
        reps = cut(reps.join(several, "hood").join(open_hoods, "hood").join(sets.select("node", "n"), "node"))
        many = reps.select("label").distinct().count()
        if not many or last is not None and 5 * many > 4 * last:
            return groups, unions, edges
        last = many
        again = _grouped(reps.withColumn("size", F.lit(0).cast("long")), "label").select("node", "label", "hood", "place", "n", "group")
        found = scratch_table(small(cut(again)).join(tokens, "node").groupBy("group").applyInPandas(_inside(percent, False), FOUND), "jaccard-rounds")
        edges = edges.unionByName(found.filter("kind = 0").select("a", "b"))


def _candidates(sets: DataFrame, held: DataFrame, unions: DataFrame, asking: DataFrame, percent: int) -> DataFrame:
    """Queries with the groups of which some member shares a rare first token: node, met.

    Of two queries in different groups, that of the higher number meets the other's group; the largest component's
    members are no queries, so groups that hold some of them are met by all. Groups of one component are not met by its
    own members, nor any by sets too large or small for them. A rare first token that no other first tokens hold is in no
    member all of whose rare tokens are first ones: a query with too many such tokens is similar to none of these.
    """
    totals = held.groupBy("hood").agg(F.sum("n").alias("all"))
    sized = cut(held.join(totals, "hood").withColumn("parts", F.ceil(F.col("all") / TOKENS)).withColumn("one_in", F.ceil(F.col("all") / SAMPLED)))
    tokens = sets.select("node", "tokens")
    sampled = small(cut(sized.filter(F.pmod(F.xxhash64("node"), F.col("one_in")) == 0).select("hood", "node"))).join(tokens, "node")
    common = scratch_table(sampled.groupBy("hood").applyInPandas(_common, "hood long, common binary"), "jaccard-common")
    members = small(cut(sized.select("hood", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("part"), "node", "group"))).join(tokens, "node")
    blocks = sized.select("hood", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).distinct()
    known = common.join(blocks, "hood")
    first = members.groupBy("hood", "part").cogroup(known.groupBy("hood", "part")).applyInPandas(_first_tokens(percent), "hood long, token long, node long, group long, rare boolean, ended boolean")
    first = scratch_table(first, "jaccard-first")
    of_group = held.groupBy("hood", "group").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("dominant").alias("dominant"))
    only = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(-1)).alias("only")
    facts = cut(unions.select("hood", "group", "low", "high").join(of_group, ["hood", "group"]).select(F.col("group").alias("met"), "low", "high", only, "dominant"))
    alone = first.filter("rare").groupBy("hood", "token").agg(F.min("node").alias("node"), F.max("node").alias("z")).filter("node = z").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    alone = small(cut(alone))
    asks = small(cut(asking.join(alone, "node", "left").withColumn("reach", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")))
    own = first.join(alone, "node", "left").groupBy("hood", "token", F.col("group").alias("met"))
    met = own.agg(F.min("ended").alias("all_end"), F.min(F.coalesce("alone", F.lit(0))).alias("own")).join(small(facts), "met")
    fit = (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))
    fit = fit & (F.col("group") != F.col("met")) & (F.col("dominant") | (F.col("group") > F.col("met"))) & (F.col("label") != F.col("only"))
    least = F.greatest(F.col("low"), F.ceil(percent * F.col("n") / 100))
    most = ((100 + percent) * F.col("reach") >= percent * (F.col("n") + least)) & (100 * F.col("reach") >= percent * (F.col("n") + F.when(F.col("ended"), F.col("own")).otherwise(0)))
    near = ~F.col("all_end") | most
    return first.drop("rare").join(asks, "node").join(met, ["hood", "token"]).filter(fit & near).select("node", "met").distinct()


def _qualifying(sets: DataFrame, held: DataFrame, unions: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Candidates whose bound by the group's union reaches the threshold."""
    pairs = cut(pairs)
    blocks = small(cut(pairs.groupBy(F.col("met").alias("group")).agg(F.ceil(F.count(F.lit(1)) / OPEN_BLOCK).alias("blocks"))))
    asked = small(cut(pairs.withColumnRenamed("met", "group").join(blocks, "group").select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node")))
    queries = asked.join(sets.select("node", "n", "tokens"), "node").select("group", "block", "node", "n", "tokens", F.lit(None).cast("binary").alias("bits"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("binary")
    sides = unions.join(blocks, "group").select("group", every, "bits").select("group", "block", zero.alias("node"), zero.alias("n"), nothing.alias("tokens"), "bits")
    return queries.unionByName(sides).groupBy("group", "block").applyInPandas(_bound(percent), "node long, group long")


def _across(sets: DataFrame, groups: DataFrame, unions: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Edges between components of the same neighbourhood."""
    several = cut(unions.groupBy("hood").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("hood"))
    known = components(edges)
    held = groups.join(several, "hood").join(known, "node", "left").select("node", "hood", "group", "n", F.coalesce("component", "node").alias("label"))
    held = cut(held)
    sizes = held.groupBy("hood", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("hood").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("hood", "largest")
    held = cut(held.join(largest, "hood").withColumn("dominant", F.col("label") == F.col("largest")).drop("largest"))
    asking = cut(held.filter("not dominant").select("node", "label", "n"))
    opened = cut(_qualifying(sets, held, unions, _candidates(sets, held, unions, asking, percent), percent))
    blocks = small(cut(opened.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / OPEN_BLOCK).alias("blocks"))))
    members = held.join(blocks, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node", "label", F.lit(False).alias("query"))
    asked = opened.join(blocks, "group").join(held.select("node", "label"), "node").select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node", "label", F.lit(True).alias("query"))
    wanted = small(cut(members.unionByName(asked))).join(sets.select("node", "tokens"), "node")
    return wanted.groupBy("group", "block").applyInPandas(_open(percent), "a long, b long")


def _links(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges that connect similar classes. nodes: node, text."""
    sets = scratch_table(nodes.select("node", "text").mapInArrow(_describe(width), "node long, n long, size long, place double, tokens binary"), "jaccard-sets")
    size = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(size // BUCKET, min(_parts_of(sets), 1024)) + 1
    dealt = sets.select("node", "tokens").mapInArrow(_scatter(percent, buckets), ENTRIES)
    hoods = components(by_bucket(dealt, buckets).applyInPandas(_link, "a long, b long"))
    hoods = hoods.unionByName(hoods.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "hood")
    inside = cut(hoods.join(sets.select("node", "n", "size", "place"), "node"))
    groups, unions, edges = _tournament(sets, inside, percent)
    return edges.unionByName(_across(sets, groups, unions, edges, percent))


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _order(doc_id: str, h: str) -> Column:
    """Rows by doc_id, nulls last, then by the hash of their text."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(h).alias("h"))


def _judge(docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, h, n, sig) and the classes of equal sets (sig, head: its first row, least: the component's).

    h is a hash of the text: doc_id and h name a row, as doc_ids may be null or shared.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(_bytes(docs[text])).alias("h"), _bytes(docs[text]).alias("text"))
    kind = rows.dtypes[0][1]
    base = cut(rows.mapInArrow(_classify(width), f"doc_id {kind}, h long, n long, sig binary, owner long"))
    full = base.filter("n > 0").groupBy("sig", "owner").agg(F.min(_order("doc_id", "h")).alias("head"), F.first("n").alias("n"))
    classes = cut(full.withColumn("node", F.monotonically_increasing_id()))
    left = cut(_survivors(rows, classes, width, percent).select("node", F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h")))
    here = rows["doc_id"].eqNullSafe(F.col("head_id")) & (rows["h"] == F.col("head_h"))
    nodes = rows.join(small(left), here).select("node", "text")
    if not base.filter("n > 0").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        nodes = nodes.dropDuplicates(["node"])  # rows that repeat doc_id and text
    found = components(_links(nodes, width, percent))
    linked = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("head").alias("least"))
    return base, linked.select("sig", "head", "component").join(least, "component").select("sig", "head", "least")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, class_id.

    Sets are distinct shingles of `width` words (A-Z lowered); a text with fewer words is one shingle; without words, a
    null or empty text has no shingle and is linked with nothing. Two documents link when 100 * intersection >=
    percent * union; component_id is the least doc_id reachable by links, class_id the least with an equal set.
    doc_id may have any type that can be ordered. Rows are linked by their own texts, whether or not their doc_id is
    null or shared. Repeated rows are equal sets; a null doc_id comes after all others; an empty table gives no rows;
    other columns play no part. Shingles are compared by 64-bit hashes.
    """
    base, named = _judge(docs, width, percent, text, doc_id)
    own = lambda c: F.when(F.col(c).isNull(), F.col("doc_id")).otherwise(F.col(f"{c}.doc_id"))
    return base.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), own("least").alias("component_id"), own("head").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs`, all columns, with one row of each group of linked ones: that with the least doc_id.

    Rows are found by their doc_id and a 64-bit hash of their text, which also decides among equal doc_ids; of rows that
    repeat both, one stays (any). Texts without words are linked with nothing, so all stay. Columns keep their names,
    whatever these are. Other cases as in `similar_documents`.
    """
    base, named = _judge(docs, width, percent, text, doc_id)
    rows = base.filter("n > 0").groupBy("sig", "doc_id", "h").agg(F.count(F.lit(1)).alias("c"))
    judged = rows.join(named, "sig").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h")))
    lost_id, lost_h, nth = fresh(docs, 3)
    away = lambda df: cut(df.select(F.col("doc_id").alias(lost_id), F.col("h").alias(lost_h)))
    lost, twice = away(judged.filter("not stays")), away(judged.filter("stays and c > 1"))
    h = F.xxhash64(_bytes(docs[text]))
    here = docs[doc_id].eqNullSafe(F.col(lost_id)) & (h == F.col(lost_h))
    if twice.isEmpty():
        return docs.join(small(lost), here, "left_anti")
    once = docs.join(small(lost.unionByName(twice)), here, "left_anti")
    again = docs.join(small(twice), here, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(docs[doc_id], h).orderBy(docs[doc_id])))
    return once.unionByName(again.filter(F.col(nth) == 1).drop(nth))
