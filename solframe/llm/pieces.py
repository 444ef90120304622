"""Cutting a text into the pieces that a word-level BPE encodes one by one.

Pieces never span white space and do not depend on each other, so a bounded memo of chunks serves a whole worker. The
normaliser composes (NFC), lower-cases and drops white space, as the tokenizer file states.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex
from tokenizers import Regex, normalizers, pre_tokenizers

#: White space of the tokenizer's patterns; Python's own also counts U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
ODD = regex.compile("[\x1c-\x1f]")
#: Entries of the memo's younger half. When it is full, the older half goes, so a worker's memory stays bounded.
MEMO = 300_000
#: Characters of texts that are taken together.
BLOCK = 1 << 20
#: What the file's pattern takes for a mark: neither white space nor letter nor number.
MARK = rf"[^{SPACE}\p{{L}}\p{{N}}]"
#: A full stop or comma that touches another mark: elsewhere the two are pieces of their own.
TOUCH = regex.compile(f"[.,]{MARK}|{MARK}[.,]")


@lru_cache(1 << 16)
def _plain(c: str) -> bool:
    """A letter, number or white space, once composed and lowered, or a full stop or comma."""
    return c in ".," or all(x.isalnum() for x in unicodedata.normalize("NFC", c).lower()) or c.isspace() and not "\x1c" <= c <= "\x1f"


#: Plain characters met so far, which need no second look.
_MET: set[str] = set()


def _odd(text: str) -> set[str]:
    """The characters of a text that are not plain."""
    rest = set(text) - _MET
    found = {c for c in rest if not _plain(c) or _new(c)}
    _MET.update(rest - found)
    return found


def unassigned(text: str) -> bool:
    """Whether a text has characters that Python's Unicode tables lack."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


@lru_cache(1 << 16)
def _new(c: str) -> bool:
    """Whether other Unicode tables may compose or lower a character otherwise: it came after Unicode 3.2 and combines."""
    kind = unicodedata.category(c)
    return kind == "Cn" or (kind[0] == "M" or bool(unicodedata.decomposition(c))) and unicodedata.ucd_3_2_0.category(c) == "Cn"


class PieceEncoder:
    """Encodes texts. encode_chunks gives the ids of chunks without white space, little-endian unsigned 32-bit bytes.

    `find` of this object cuts a chunk into its pieces.
    """

    def __init__(self, spec: dict, encode_chunks: Callable[[list[str], Callable[[str], list[str]]], list[bytes]], entries: int = MEMO) -> None:
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.encode_chunks, self.entries = encode_chunks, entries
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the memo's memory back, for workers that go on to other work."""
        self.memo, self.older = {}, {}

    def find(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        return [x for x, _ in self.split.pre_tokenize_str(chunk)] if unassigned(chunk) else self.pattern.findall(chunk)

    def _chunks(self, text: str) -> list[str]:
        odd = _odd(text)
        if any(map(_new, odd)):  # as the library's own tables have it
            return [c for c in regex.split(f"[{SPACE}]+", self.normal.normalize_str(text)) if c]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma is lowered without regard to its place
        text = text.lower()
        if not (TOUCH.search(text) if odd else any(pair in text for pair in (".,", ",.", "..", ",,"))):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split() if not odd or not ODD.search(text) else [c for c in regex.split(f"[{SPACE}]+", text) if c]

    def _learn(self, chunks: set[str]) -> None:
        """Put the ids of all chunks into the memo."""
        need = chunks - self.memo.keys()
        if len(self.memo) + len(need) > self.entries:
            self.memo, self.older, need = {}, self.memo, chunks
        fresh = []
        for c in need:
            if (known := self.older.pop(c, None)) is None:
                fresh.append(c)
            else:
                self.memo[c] = known
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            self.memo.update(zip(some, self.encode_chunks(some, self.find)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none. Texts are taken in blocks of about BLOCK characters."""
        out: list[bytes] = []
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK:
                out += self._encode(block)
                block, size = [], 0
        return out + self._encode(block)

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [[t] if self.cut is None or not any(s in t for s in self.special) else self.cut(t) for t in texts]
        cut = [[self.special.get(p) or self._chunks(p) for p in ps] for ps in parts]
        self._learn({c for ps in cut for p in ps if isinstance(p, list) for c in p})
        get = self.memo.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in ps) for ps in cut]


def load_spec(content: bytes) -> dict:
    spec = json.loads(content)
    if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix"):
        raise ValueError("a word-level BPE file is needed")
    return spec
