"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

A text is parted at added tokens, then by the pre-tokenizer's pattern into pieces.  Of
each piece one Aho-Corasick pass gives the longest token that starts at each byte.  The
encoder walks forward with these; a token may follow another only if the merges would
leave a border between the two, which the pair table tells: undo the later merge of
the two sides again and again, and no earlier merge may reach over the border.  Where
a token may not follow, its next shorter prefix is tried, and where none is left the
token before is taken back; a bit for each byte remembers the dead ends, so a piece
costs time linear in its bytes.  The result is that of merging by rank.

Decoding gathers the tokens' bytes from one blob by an offset table and decodes them
as UTF-8, with U+FFFD for what is no character.

Each text is read once and never shuffled.  What is broadcast is the vocabulary's
merges, whose number the file fixes.  A worker remembers the ids of at most 2 * `memo`
pieces of 64 bytes at most, those met lately.

Null is the empty text: no ids.  A text of any length is encoded whole; a piece of any
length too, without being remembered.  Rows that repeat are encoded alike.  The added
tokens' strings within a text are the added tokens.  An empty table gives an empty
result.  Only the id and the text are read, whatever other columns are called.
Letters are those of the Unicode version that the interpreter knows; later ones count as
signs, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """tokens[r] is the bytes of rank r: 256 single bytes, then the merges; ids[r] is its id."""

    tokens: tuple[bytes, ...]
    merges: np.ndarray  #: (n, 2) ranks; row k makes rank 256 + k
    ids: np.ndarray
    added: tuple[tuple[str, int], ...]  #: strings that are tokens of their own

    @staticmethod
    def from_json(path: str) -> Vocabulary:
        """A byte-level BPE file of the tokenizers library; refuses what this encoder does not do."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: no plain byte-level BPE")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path}: a BPE option that is not supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: an added token that is more than its string")
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab, back = model["vocab"], {b: c for c, b in letters.items()}
        tokens, ids = [bytes([b]) for b in range(256)], [vocab[back[b]] for b in range(256)]
        rank, merges = {t: r for r, t in enumerate(tokens)}, []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((rank[raw(a)], rank[raw(b)]))
            if rank.setdefault(t := raw(a + b), len(tokens)) != len(tokens):
                raise ValueError(f"{path}: two merges make {t!r}")
            tokens.append(t)
            ids.append(vocab[a + b])
        added = tuple((t["content"], t["id"]) for t in spec["added_tokens"])
        return Vocabulary(tuple(tokens), np.array(merges, np.int32).reshape(-1, 2), np.array(ids, np.int32), added)


class Pieces(dict):
    """Packed ids of pieces; when full, the pieces not met since the last time go."""

    def __init__(self, encoder: Encoder, memo: int):
        super().__init__()
        self.encoder, self.memo, self.before = encoder, memo, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = b"".join(map(self.encoder.packed.__getitem__, self.encoder.ranks(raw)))
            if len(raw) > 64:
                return ids
        if len(self) >= self.memo:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes texts; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary, memo: int = 200_000):
        v = self.vocabulary = vocabulary
        n = len(v.tokens)
        self.left, self.right = list(range(n)), list(range(n))
        for k, (a, b) in enumerate(v.merges.tolist()):
            self.left[256 + k], self.right[256 + k] = a, b
        self.pairs = {(a, b): 256 + k for k, (a, b) in enumerate(v.merges.tolist())}
        self.lengths = [len(t) for t in v.tokens]
        #: Tokens that merging makes of their own bytes; a file may hold others, which never come up.
        made = [True] * n
        for r in range(256, n):
            a, b = self.left[r], self.right[r]
            made[r] = made[a] and made[b] and self.compatible(a, b, r)
        rank = self.rank = {t: r for r, t in enumerate(v.tokens) if made[r]}
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        #: The longest token that a token properly begins with.
        self.shorter = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in v.tokens]
        self.packed = [np.int32(i).tobytes() for i in v.ids]
        self.known, self.fits = Pieces(self, memo), {}
        self.pattern = regex.compile(PATTERN)
        self.added = regex.compile("(" + "|".join(regex.escape(s) for s, _ in sorted(v.added, key=lambda x: -len(x[0]))) + ")") if v.added else None
        self.special = dict(v.added)
        newer = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(c) == "Cn"]
        #: Letters of later Unicode versions are signs.
        self.newer, self.as_sign = set(newer), str.maketrans(dict.fromkeys(newer, "☃"))
        # the offset table: a token's bytes are blob[start : start + size], by id
        strings = {int(i): t for i, t in zip(v.ids, v.tokens, strict=True)} | {i: s.encode() for s, i in v.added}
        most = max(strings) + 1
        self.size = np.array([len(strings.get(i, b"")) for i in range(most)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(strings.get(i, b"") for i in range(most)), np.uint8)
        # and the same for the ids as decimals with a comma behind
        decimals = [f"{i},".encode() for i in range(most)]
        self.dec_size = np.array([len(d) for d in decimals], np.int64)
        self.dec_start = np.cumsum(self.dec_size) - self.dec_size
        self.dec_blob = np.frombuffer(b"".join(decimals), np.uint8)

    def compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Do the merges (those below limit) leave a border between the tokens a and b, side by side?"""
        pairs, left, right = self.pairs, self.left, self.right
        limit = len(left) if limit is None else limit
        while True:
            if pairs.get((a, b), limit) < limit:
                return False  # this pair would have merged before what holds its sides apart
            if a > b:  # undo the later merge
                limit, inner = a, right[a]
                if inner != a:
                    a = inner
                    continue
                inner = left[b]
                if inner == b:
                    return True
                limit, b = b + 1, inner
            else:
                limit, inner = b + 1, left[b]
                if inner != b:
                    b = inner
                    continue
                inner = right[a]
                if inner == a:
                    return True
                limit, a = a, inner

    def ranks(self, piece: bytes) -> list[int]:
        """The tokens of one piece, by backtracking."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n, lengths, shorter, fits = len(piece), self.lengths, self.shorter, self.fits
        longest = list(piece)
        for end, r in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[r]] = r  # ends grow, so the last is the longest
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, last, token = 0, -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if alive[end]:
                    if last < 0:
                        break
                    fit = fits.get((last, token))
                    if fit is None:
                        if len(fits) >= 500_000:
                            fits.clear()
                        fit = fits[last, token] = self.compatible(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:  # a dead end: take the token before back and try its next shorter one
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def pieces(self, text: str) -> list[str]:
        if not text.isascii() and not self.newer.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.as_sign))]
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        out, get = [], self.known.__getitem__
        parts = self.added.split(text or "") if self.added else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.int32(self.special[part]).tobytes())
            elif part:
                out.extend(map(get, self.pieces(part)))
        return np.frombuffer(b"".join(out), np.int32)

    @staticmethod
    def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, blob: np.ndarray) -> bytes:
        """The ids' entries of a blob, one behind the other, in parts of bounded memory."""
        out = []
        for k in range(0, len(ids), 100_000):
            own = ids[k : k + 100_000]
            n = size[own]
            ends = np.cumsum(n)
            out.append(blob[np.repeat(start[own] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.gather(ids, self.start, self.size, self.blob).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by commas."""
        return self.gather(ids, self.dec_start, self.dec_size, self.dec_blob)[:-1]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each Python worker."""
    key = hashlib.sha256(b"".join((vocabulary.merges.tobytes(), vocabulary.ids.tobytes(), repr(vocabulary.added).encode()))).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _mapped(rows: DataFrame, vocabulary: Vocabulary, names: str, kinds: list[pa.DataType], each) -> DataFrame:
    """each(encoder, value) of a second column, beside the first."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    cols = [n.split(" ")[0] for n in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(shared.value)
            got = [each(encoder, x) for x in batch.column(1).to_pylist()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)] or [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *cols])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, {names}")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _mapped(rows, vocabulary, "ids array<int>", [pa.list_(pa.int32())], lambda e, text: (e.encode(text),))


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for each row of encoded; null ids are none."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return _mapped(rows, vocabulary, "text string", [pa.string()], lambda e, ids: (e.decode(np.array(ids or [], np.int32)),))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded from the ids, in one pass."""

    def each(e: Encoder, text: str | None) -> tuple[int, str, str]:
        ids = e.encode(text)
        return len(ids), hashlib.sha256(e.decimals(ids)).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _mapped(rows, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], each)
