"""Byte-level BPE by backtracking, with exact merges in time linear in the text.

The encoder looks for the longest token at the current place with an Aho-Corasick
automaton and keeps it if the pair with the previous token is *compatible*: merging the two
tokens' bytes would give these same two tokens. If not, it tries the next shorter token
that is a prefix, and if none is left it takes back the previous token. Whether a pair is
compatible is worked out from the merge table once and kept. Decoding reads the bytes of
all ids through one table of offsets.

A text is first split as the vocabulary's pre-tokenizer does; each distinct piece is
encoded once per worker.
"""

from __future__ import annotations

import hashlib
import json
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, texts, worker_cache

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank before white space, or at the end: such texts are split by the full pattern.
_ODD_BLANKS = regex.compile(r" (?=\s|$)|^\s")
_CACHE_LIMIT = 700_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of = raw
        self.id_of = {b: i for i, b in raw.items()}
        by_text = {t: i for t, i in vocab.items()}
        # rank of a merge = its line; a token made by no merge is a single byte
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = by_text[left], by_text[right], by_text[left + right]
            self.merge[a, b] = (rank, c)
            if c not in self.parts:
                self.parts[c] = (a, b)
                self.rank[c] = rank
        latin = {i: b.decode("latin-1") for i, b in raw.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in latin.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: the longest token that is a proper prefix of each token
        self.shorter: dict[int, int] = {}
        for i, b in raw.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := self.id_of.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.size = {i: len(b) for i, b in raw.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, str] = {}
        top = max([*raw, *self.special.values()]) + 1
        blobs = [raw.get(i, b"") for i in range(top)]
        for t, i in self.special.items():
            blobs[i] = t.encode()
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64)
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    # -- encoding ---------------------------------------------------------------

    def fits(self, a: int, b: int) -> bool:
        """Whether token a followed by token b survives merging: an entry of the pair table."""
        found = self.compatible.get((a, b))
        if found is None:
            found = self.compatible[a, b] = self._fits(a, b)
            if len(self.compatible) > _CACHE_LIMIT:
                self.compatible = {}
        return found

    def _fits(self, a: int, b: int) -> bool:
        # Undo merges latest first on the two sides of the border. At each moment the border
        # pair must not have had a merge that would have come before the one undone last.
        undone = 1 << 60
        while True:
            m = self.merge.get((a, b))
            if m is not None and m[0] < undone:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Of equal merges the one further left comes first: a right one is undone first,
            # and a border merge of its rank would have come before it.
            if ra > rb:
                undone, a = ra, self.parts[a][1]
            else:
                undone, b = rb + 1, self.parts[b][0]

    def longest_at(self, latin: str) -> list[int]:
        """The longest token that begins at each place."""
        best: list[int] = [-1] * len(latin)
        for end, i in self.automaton.iter(latin):
            begin = end - self.size[i] + 1
            best[begin] = i  # ends grow, so the last one seen is the longest
        return best

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.id_of.get(piece)
        if whole is not None and len(piece) == 1:
            return [whole]
        best = self.longest_at(piece.decode("latin-1"))
        n = len(piece)
        open_at = [True] * (n + 1)
        out: list[int] = []
        pos = 0
        token: int | None = best[0]
        while pos < n:
            last = out[-1] if out else None
            while token is not None:
                end = pos + self.size[token]
                if open_at[end] and (last is None or self.fits(last, token)):
                    break
                token = self.shorter.get(token)
            if token is not None:
                out.append(token)
                pos = end
                token = best[pos] if pos < n else None
            else:
                open_at[pos] = False
                token = out.pop()
                pos -= self.size[token]
        return out

    def _known(self, piece: str) -> str:
        """Decimal ids of a piece joined by commas, from the worker's table."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= _CACHE_LIMIT:
                for key in list(islice(self.pieces, _CACHE_LIMIT // 2)):
                    del self.pieces[key]
            parts = _PIECES.findall(piece)
            if len(parts) == 1:
                found = ",".join(map(str, self.encode_piece(piece.encode())))
            else:
                found = ",".join(map(self._known, parts))
            self.pieces[piece] = found
        return found

    def encode_joined(self, text: str) -> str:
        """The ids of a whole text as decimals joined by commas."""
        if self.split_special is None or not any(t in text for t in self.special):
            return self._plain(text)
        parts = []
        for part in self.split_special.split(text):
            if part:
                parts.append(str(self.special[part]) if part in self.special else self._plain(part))
        return ",".join(parts)

    def _plain(self, text: str) -> str:
        # A blank before a character that is no white space always begins a piece, so a text
        # without other blanks falls apart there; the rest goes to the full pattern.
        known = self._known
        if _ODD_BLANKS.search(text):
            return ",".join(map(known, _PIECES.findall(text)))
        first, *rest = text.split(" ")
        table = self.pieces
        out = [known(first)] if first else []
        for r in rest:
            r = " " + r
            found = table.get(r)
            out.append(known(r) if found is None else found)
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered through the table of offsets."""
        ids = np.asarray(ids, np.int64)
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.blob[at].tobytes()


_loaded: dict[str, ByteBpe] = {}


def _clear() -> bool:
    held = any(b.pieces for b in _loaded.values())
    _loaded.clear()
    return held


worker_cache("bpe", _clear)


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def resolve(name: str) -> str:
    """A vocabulary's place on this machine: a path, or the name of a public vocabulary."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids array of every row (null text: no ids)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(resolve(vocabulary))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t or "") for t in texts(batch.column(1))], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, ids array<int>", run, keep="bpe")


def decode_documents(ids: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids give a null text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(resolve(vocabulary))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else bpe.decode(np.array(x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(ids.select("doc_id", "ids"), "doc_id long, text string", run, keep="bpe")


def round_trip_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (null text: empty).

    Each text is encoded, and the ids decoded again, in one pass; nothing is shuffled.
    Repeated rows and ids give one result each; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(resolve(vocabulary))
        counts, ids_sha, text_sha = [], [], []
        for t in texts(batch.column(1)):
            joined = bpe.encode_joined(t or "")
            ids = np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded = bpe.decode(ids)
            try:
                decoded.decode()
            except UnicodeDecodeError:
                decoded = decoded.decode("utf-8", "replace").encode()
            text_sha.append(hashlib.sha256(decoded).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run, keep="bpe")
