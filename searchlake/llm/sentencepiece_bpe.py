"""SentencePiece BPE encoding and decoding by a prefix table.

Method. For every prefix of a text, BPE leaves exactly one last token. A sequence of
tokens is what BPE yields if and only if each token alone, and each adjacent pair, is
what BPE yields for its own string. So the last token of a prefix is the one token that
ends there and is compatible with the last token of the prefix before it. The table of
last tokens is filled from left to right and the ids are then read backwards from its
end. Token matches come from an automaton (a trie walked from all positions at once);
compatibility of a pair is found once by running the merges on that pair's string and is
kept in a hash table.

Where two adjacent characters are adjacent in no piece of the vocabulary, no merge can ever
cross, so a text is cut there; equal segments are encoded once per batch (a bounded cache
keeps them for later batches). The automaton and the table work on all new segments of a
batch at once, as numpy arrays.

Cases: null or empty text: only the end id, decoded as the empty text. Characters outside
the vocabulary become byte ids. A text may hold the space mark itself: it decodes as a
space, as in the library. Repeated rows and ties are encoded independently; other columns
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import text_bytes

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Segments kept by a worker, and characters of new segments that are encoded at once.
CACHE_SEGMENTS, CHUNK_CHARS = 300_000, 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a serialised protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0], at + size
        yield key >> 3, value


class _Table:
    """A hash table of int64 keys and int32 values, looked up and filled by arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; -1 where there is none."""
        last = len(self.keys) - 1
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero(~hit & (there >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & last
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            open_, slot = open_[more], slot[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't in the table."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            self.__init__(max(self.bits + 1, (2 * len(keys)).bit_length() + 1))
        self.n += len(keys)
        slot, last = self._slot(keys), len(self.keys) - 1
        while len(keys):  # one key takes a free slot, the others move on
            take = np.zeros(len(keys), bool)
            take[np.unique(slot, return_index=True)[1]] = True
            take &= self.keys[slot] < 0
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            keys, values, slot = keys[~take], values[~take], (slot[~take] + 1) & last


class PieceModel:
    """Encoder and decoder for one SentencePiece BPE model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, model_type, charsmap, extra, escape, byte_fallback = True, 1, b"", True, True, False
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece[2])
                self.kinds.append(piece[3])
            elif number == 2:
                spec = dict(_fields(value))
                model_type, byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
                extra, escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if model_type != 2 or charsmap or extra or not escape or not byte_fallback or set(self.kinds) - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.score = scores
        self.end = self.pieces.index("</s>")
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.longest = max(map(len, self.ids))
        self.names = [str(i) for i in range(len(self.pieces))]
        self.lengths = [len(p) for p in self.pieces]
        self._trie()
        # tokens are vocabulary ids; V stands for the start, above it are characters without a piece
        self.V = len(self.pieces)
        self.pairs = _Table(18)
        self.cache: dict[str, tuple[int, str, str]] = {}

    def _trie(self) -> None:
        chars = sorted({c for p in self.ids for c in p})
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        self.codes = np.zeros(0x110000, np.int32)
        for c, i in self.code.items():
            self.codes[ord(c)] = i
        self.width = len(chars) + 1
        self.joined = np.zeros((self.width, self.width), bool)  # adjacent in some piece
        for piece in self.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                self.joined[self.code[a], self.code[b]] = True
        edges: dict[int, int] = {}
        terminal = [-1]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                key = state * self.width + self.code[c]
                if key not in edges:
                    edges[key] = len(terminal)
                    terminal.append(-1)
                state = edges[key]
            terminal[state] = i
        self.terminal = np.array(terminal, np.int32)
        self.edges = _Table(4)
        self.edges.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))

    def merge(self, text: str) -> list[str]:
        """Plain BPE on a short string: the best pair first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best[0]):
                    best = (self.score[found], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        found = self.pairs.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            values = np.zeros(len(new), np.int32)
            for at, key in enumerate(new.tolist()):
                before, token = divmod(key, self.V + 1)
                own = self.pieces[token]
                left = self.pieces[before] if before < self.V else ""
                values[at] = self.merge(left + own) == ([left, own] if left else [own])
            self.pairs.put(new, values)
            found = self.pairs.get(keys)
        return found > 0

    def _encode_new(self, segments: list[str]) -> None:
        """Encode distinct segments, together at most about CHUNK_CHARS characters, into the cache."""
        segments.sort(key=len, reverse=True)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[points].astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
        # matches[l - 1, e]: the piece of length l that ends before position e
        matches = np.full((self.longest, len(codes) + 1), -1, np.int32)
        where, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for depth in range(self.longest):
            inside = left[where] > depth
            where, state = where[inside], state[inside]
            state = self.edges.get(state * self.width + codes[where + depth]).astype(np.int64)
            alive = state >= 0
            where, state = where[alive], state[alive]
            if not len(where):
                break
            matches[depth, where + depth + 1] = self.terminal[state]
        last = np.full(len(codes) + 1, -1, np.int32)  # of the prefix that ends before e
        V1 = self.V + 1
        active = len(segments)
        for p in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            while sizes[active - 1] < p:
                active -= 1
            at = starts[:active] + p
            unknown = codes[at - 1] == 0
            last[at[unknown]] = V1
            size, who = np.nonzero(matches[: min(p, self.longest), at] >= 0)
            if not len(who):
                continue
            end = at[who]
            token = matches[size, end]
            size += 1
            before = last[end - size].astype(np.int64)
            before[(size == p) | (before == V1)] = self.V
            ok = self._compatible(before * V1 + token)
            last[end[ok]] = token[ok]
        table = last.tolist()
        pieces, names, lengths, byte_ids = self.pieces, self.names, self.lengths, self.byte_ids
        for text, start, size in zip(segments, starts.tolist(), sizes.tolist(), strict=True):
            end, ids, plain = start + size, [], True
            while end > start:
                token = table[end]
                if token == V1:
                    end -= 1
                    plain = False
                    ids += [byte_ids[b] for b in reversed(text[end - start].encode("utf-8", "replace"))]
                else:
                    ids.append(token)
                    end -= lengths[token]
            ids.reverse()
            decoded = "".join([pieces[i] for i in ids]) if plain else self.decode_ids(ids)
            if decoded == text:
                decoded = text  # one object in memory
            self.cache[text] = (len(ids), " ".join([names[i] for i in ids]), decoded)

    def decode_ids(self, ids: list[int]) -> str:
        """The marked text of ids, before the prefix mark is taken off; controls give nothing."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def unmark(self, marked: str) -> str:
        if self.dummy_prefix and marked.startswith(SPACE):
            marked = marked[1:]
        return marked.replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self.unmark(self.decode_ids(ids))

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def prepare(self, parts: list[list[str]]) -> None:
        """Put all segments of a batch of texts into the cache."""
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache.clear()
        new: set[str] = set()
        for own in parts:
            new.update(own)
        new.difference_update(self.cache)
        chunk, chars = [], 0
        for segment in new:
            chunk.append(segment)
            chars += len(segment)
            if chars > CHUNK_CHARS:
                self._encode_new(chunk)
                chunk, chars = [], 0
        if chunk:
            self._encode_new(chunk)

    def encode(self, text: str) -> list[int]:
        parts = self._parts(text)
        self.prepare([parts])
        return [int(i) for p in parts for i in self.cache[p][1].split()] + [self.end]

    def digests(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, joined ids, decoded text), with the end id, for each text."""
        at = 0
        while at < len(texts):  # some hundred texts at once: bounded memory for their segments
            parts, chars = [], 0
            while at < len(texts) and chars < 2_000_000:
                text = texts[at].decode("utf-8", "replace")
                parts.append(self._parts(text))
                chars += len(text)
                at += 1
            self.prepare(parts)
            get = self.cache.__getitem__
            for own in parts:
                found = list(map(get, own))
                n = sum([f[0] for f in found]) + 1
                joined = " ".join([f[1] for f in found] + [str(self.end)])
                yield n, joined, self.unmark("".join([f[2] for f in found]))


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, loaded once per process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids and of the decoded text; with_ids adds ids (array) and decoded."""

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            n, ids, decoded, lists, texts = [], [], [], [], []
            for count, joined, text in m.digests(batch.column(1).to_pylist()):
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    lists.append([int(x) for x in joined.split()])
                    texts.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), text_bytes(text_col).alias("__text")).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
