"""BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token at every place of a piece. The encoder takes the
longest token that is compatible with the one before it, falls back to the next shorter token, and steps back where none
fits; a place that failed once is never tried again, so the work is linear in the piece. Two tokens are compatible when
merging their joint string leaves exactly these two, which a table of pairs remembers. The result equals the merges
applied one by one in order of rank.

Decoding gathers the tokens' strings out of one byte table by their offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pieces import PieceEncoder, load_spec

#: Entries of the table of pairs; it is emptied when full.
PAIRS = 1_000_000
#: Entries of each half of a worker's memo: the automaton needs memory, too.
ENTRIES = 120_000
#: Stands for the end of a word; bytes are the characters below it.
END = "Ā"


def byte_characters() -> dict[str, str]:
    """The printable stand-ins of byte-level vocabularies, and the byte of each as a character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class Backtracking:
    def __init__(self, spec: dict) -> None:
        model, suffix, plain = spec["model"], spec["model"]["end_of_word_suffix"], byte_characters()

        def string(token: str) -> str:
            body, end = (token[: -len(suffix)], END) if token.endswith(suffix) and token != suffix else (token, "")
            return "".join(plain[c] for c in body) + end

        vocabulary = model["vocab"]
        self.strings = {i: string(t) for t, i in vocabulary.items()}
        # rank of the merge that makes a token, -1 for single symbols; its two parts; the token that a pair makes
        self.rank = dict.fromkeys(self.strings, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = (vocabulary[left], vocabulary[right])
            token = vocabulary[left + right]
            self.rank[token], self.parts[token], self.made[pair] = rank, pair, token
        self.pairs: dict[tuple[int, int], bool] = {}
        sound: dict[str, int] = {}
        for token in sorted(self.strings, key=self.rank.get):  # a token that its own string doesn't give is never used
            if token not in self.parts or self._meet(*self.parts[token], below=self.rank[token]):
                sound[self.strings[token]] = token
        self.length = {token: len(s) for s, token in sound.items()}
        self.shorter = {}
        for s, token in sound.items():
            self.shorter[token] = next((sound[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in sound), None)
        self.automaton = ahocorasick.Automaton()
        for s, token in sound.items():
            self.automaton.add_word(s, token)
        self.automaton.make_automaton()
        self.whole = {s[:-1]: token.to_bytes(4, "little") for s, token in sound.items() if s.endswith(END)}

    def _meet(self, left: int, right: int, below: int) -> bool:
        """Whether no merge of a rank under `below` joins symbols across the border of two tokens.

        The merges are undone from the last one backwards: the side whose token was made later is taken apart, which
        shows the two symbols at the border at each moment. A pair at the border would have been merged if its rank is
        lower than that of the merge which used one of the two up (or if equal, being on the left).
        """
        parts, rank, made = self.parts, self.rank, self.made
        until, ours = below, False  # the moment until which this border pair stood; ours: a tie goes to the border pair
        while True:
            joint = made.get((left, right))
            if joint is not None and (rank[joint] < until or ours and rank[joint] == until):
                return False
            if rank[left] > rank[right]:
                until, left, ours = rank[left], parts[left][1], False
            elif right in parts:  # equal merges run from left to right, so the right one is undone first
                until, right, ours = rank[right], parts[right][0], True
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._meet(left, right, 1 << 60)
        return known

    def encode(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1")
        if (known := self.whole.get(symbols)) is not None:
            return known
        symbols += END
        longest: list[int | None] = [None] * (len(symbols) + 1)
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, token in self.automaton.iter(symbols):
            longest[end + 1 - length[token]] = token  # ends only grow, so the longest comes last
        tokens: list[int] = []
        failed, place, token = set(), 0, longest[0]
        while place < len(symbols):
            while token is not None and (place + length[token] in failed or tokens and not fits(tokens[-1], token)):
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                place += length[token]
                token = longest[place]
            else:
                failed.add(place)
                token = tokens.pop()  # its end has failed: the next turn takes a shorter one
                place -= length[token]
        return np.array(tokens, "<u4").tobytes()


class OffsetTable:
    """Strings of all tokens in one byte array; a document's text is gathered by offsets."""

    def __init__(self, spec: dict) -> None:
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        each = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(each), np.uint8)
        self.length = np.array([len(x) for x in each])
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings, one space between them."""
        if not ids:
            return b""
        out = []
        tokens = np.frombuffer(ids, "<u4")
        for at in range(0, len(tokens), 1 << 18):  # in blocks, for very long texts
            t = tokens[at : at + (1 << 18)]
            n = self.length[t]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.start[t] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


_READY: dict[int, tuple[PieceEncoder, OffsetTable]] = {}


def tools(content: bytes) -> tuple[PieceEncoder, OffsetTable]:
    """Encoder and decoder for a tokenizer file's content, made once in each worker process."""
    key = hash(content)
    if key not in _READY:
        spec = load_spec(content)
        _READY.clear()
        encode = Backtracking(spec).encode
        _READY[key] = PieceEncoder(spec, lambda chunks, find: [b"".join(map(encode, find(c))) for c in chunks], ENTRIES), OffsetTable(spec)
    return _READY[key]


def _columns(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, str]:
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows, rows.dtypes[0][1]


def _file(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB whatever the input


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, ids (little-endian unsigned 32-bit).

    tokenizer: path of a word-level BPE file in the tokenizers library's format, on the driver. A null or empty text,
    or one of white space only, has no ids. The strings of special tokens in a text give their ids. Repeated rows are
    encoded alike; an empty table gives no rows; other columns play no part.
    """
    rows, kind = _columns(docs, text, doc_id)
    file = _file(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tools(file.value)[0]
        for batch in slices(batches, 1024):
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        encoder.forget()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Text of each row of `encode_documents`: doc_id, n_tokens, text. A null ids column counts as no ids."""
    file, kind = _file(encoded, tokenizer), dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tools(file.value)[1].decode
        for batch in slices(batches, 1024):
            texts = [decode(x.as_py() or b"").decode() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, text string")


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digests of both directions in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256. Cases as in `encode_documents`."""
    rows, kind = _columns(docs, text, doc_id)
    file = _file(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = tools(file.value)
        for batch in slices(batches, 1024):
            found = []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                found.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(table.decode(ids)).hexdigest()))
            n, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
