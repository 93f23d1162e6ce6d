"""Byte-level BPE encoding and decoding on numpy matrices.

A slice of text is split into pre-tokens without a regular-expression engine: the pattern only
asks for the class of each code point (letter, number, white space, other), so its matches follow
from the borders of runs. Distinct pre-tokens are put into matrices by length; in each round every
row merges its leftmost pair of lowest rank, pairs are looked up in an open-addressing hash table,
rows close the gap, and finished rows leave. A bounded cache, keyed by the bytes themselves, keeps the
ids of pre-tokens seen.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.llm import textcore

_U = np.uint64
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Code points with the Unicode property White_Space.
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pre-tokens of more bytes are merged with a heap: rounds over a matrix would take quadratic time.
LONG = 128
SLICE = 1 << 20
CACHE = 400_000
_TABLES: dict[str, np.ndarray] = {}
_READY: dict[int, "Bpe"] = {}


def classes() -> np.ndarray:
    """The class of every code point."""
    if "class" not in _TABLES:
        out = np.zeros(0x110000, dtype=np.uint8)
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                a, b = ord(text[m.start()]), ord(text[m.end() - 1]) + 1
                out[a:b] = kind
        out[0xD800:0xE000] = OTHER
        out[list(_SPACES)] = SPACE
        _TABLES["class"] = out
    return _TABLES["class"]


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start; they cover everything and never cross a row's border.

    The same as matching ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    over each row.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # each code point's first byte
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(cp)
    kind = classes()[cp]
    border = np.zeros(n + 1, dtype=bool)
    border[np.searchsorted(at, offs)] = True
    border[n] = True
    new_run = border[:-1].copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    new_run[0] = True
    blank = kind == SPACE
    joins = np.zeros(n, dtype=bool)  # the space just before a run, which belongs to it
    joins[:-1] = (cp[:-1] == 0x20) & ~blank[1:] & ~border[1:-1]
    begin = new_run.copy()
    begin[1:] &= ~joins[:-1] | blank[1:]
    begin |= joins
    # White space before a non-space: its last character stands alone, whatever it is.
    last = np.zeros(n, dtype=bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~border[1:-1]
    begin |= last
    quotes = np.flatnonzero((cp == 0x27) & begin)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~border[quotes + 1] & (kind[quotes + 1] == LETTER)]
    if len(quotes):
        one, two = cp[quotes + 1], cp[np.minimum(quotes + 2, n - 1)]
        two = np.where((quotes + 2 < n) & ~border[np.minimum(quotes + 2, n)], two, 0)
        size = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, 0)
        size = np.where(((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C), 2, size)
        quotes, size = quotes[size > 0], size[size > 0]
        begin[quotes + 1] = False
        rest = quotes + 1 + size
        begin[rest[rest < n]] = True
    return at[begin]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span for each distinct byte string, and for every span the place of its own in that list.

    Hashes group the spans, and the bytes of each are compared with those of its group's first.
    """
    _, first, back = np.unique(textcore.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[back]
    same = size == size[like]
    some = np.flatnonzero(same)
    cum = np.cumsum(size[some])
    inside = np.arange(cum[-1] if len(cum) else 0) - np.repeat(cum - size[some], size[some])
    differ = data[inside + np.repeat(starts[some], size[some])] != data[inside + np.repeat(starts[like[some]], size[some])]
    same[np.repeat(some, size[some])[differ]] = False
    if not same.all():  # two strings with one hash: those that differ from the first go by their bytes
        own: dict[bytes, int] = {}
        for i in np.flatnonzero(~same):
            back[i] = own.setdefault(data[starts[i] : ends[i]].tobytes(), len(first))
            if back[i] == len(first):
                first = np.append(first, i)
    return first, back


class Bpe:
    """A vocabulary of ranks and the tables to encode and decode with it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.count = max(ranks.values(), default=-1) + 1
        by_id = [b""] * self.count
        for token, rank in ranks.items():
            by_id[rank] = token
        self.sizes = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.pool = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.count + b)
                    values.append(rank)
        self._build(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))
        self.known: dict[bytes, int] = {}
        self.known_at, self.known_size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.known_ids, self.used = np.zeros(1 << 14, dtype=np.int32), 0

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = (1 << max(8, int(len(keys) * 2).bit_length())) - 1
        self.slot_key = np.full(self.mask + 1, -1, dtype=np.int64)
        self.slot_rank = np.full(self.mask + 1, 1 << 40, dtype=np.int64)
        spot = self._spot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[spot[left]] < 0]
            _, first = np.unique(spot[free], return_index=True)
            put = free[first]
            self.slot_key[spot[put]], self.slot_rank[spot[put]] = keys[put], values[put]
            left = left[self.slot_key[spot[left]] != keys[left]]
            spot[left] = (spot[left] + 1) & self.mask

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (textcore.mix(keys.view(_U)) & _U(self.mask)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above all ranks."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a * self.count + b).ravel()
        out = np.full(len(keys), 1 << 40, dtype=np.int64)
        spot, left = self._spot(keys), np.flatnonzero(keys >= 0)
        while len(left):
            have = self.slot_key[spot[left]]
            hit = have == keys[left]
            out[left[hit]] = self.slot_rank[spot[left[hit]]]
            left = left[~hit & (have >= 0)]
            spot[left] = (spot[left] + 1) & self.mask
        return out.reshape(a.shape)

    def merge_rows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of equally long byte rows: each round merges every row's leftmost pair of lowest rank."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(rows)
        ids, who = self.byte_ids[rows], np.arange(len(rows))
        size = np.full(len(rows), rows.shape[1])
        pairs = self.rank(ids[:, :-1], ids[:, 1:])
        while len(who):
            width = ids.shape[1]
            best = np.argmin(pairs, axis=1) if width > 1 else np.zeros(len(who), dtype=np.int64)
            every = np.arange(len(who))
            done = pairs[every, best] >= 1 << 40 if width > 1 else np.ones(len(who), dtype=bool)
            for i in np.flatnonzero(done):
                out[who[i]] = ids[i, : size[i]]
            ids, pairs, who, size, best = ids[~done], pairs[~done], who[~done], size[~done] - 1, best[~done]
            if not len(who):
                break
            every, cols = np.arange(len(who)), np.arange(width - 1)
            merged = pairs[every, best]
            take = cols + (cols > best[:, None])
            ids = ids[every[:, None], take]
            ids[every, best] = merged
            ids[cols >= size[:, None]] = -1
            cut = int(size.max())
            ids = ids[:, :cut]
            if cut > 1:
                take = np.minimum(cols[: cut - 1] + (cols[: cut - 1] > best[:, None] - 0), pairs.shape[1] - 1)
                pairs = pairs[every[:, None], take]
                for col in (best - 1, best):
                    ok = (col >= 0) & (col < cut - 1)
                    r, c = every[ok], col[ok]
                    pairs[r, c] = self.rank(ids[r, c], ids[r, c + 1])
                pairs[cols[: cut - 1] >= size[:, None] - 1] = 1 << 40
            else:
                pairs = np.zeros((len(who), 0), dtype=np.int64)
        return out

    def merge_long(self, row: np.ndarray) -> np.ndarray:
        """The same for one long row, with a heap of pairs."""
        ids = self.byte_ids[row].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank = lambda a, b: int(self.rank(np.array([a]), np.array([b]))[0])
        pairs = self.rank(self.byte_ids[row[:-1]], self.byte_ids[row[1:]]).tolist()
        memo: dict[tuple[int, int], int] = {}
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(pairs) if r < 1 << 40]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    key = (ids[x], ids[y])
                    if key not in memo:
                        memo[key] = rank(*key)
                    if memo[key] < 1 << 40:
                        heapq.heappush(heap, (memo[key], x, *key))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: list[bytes]) -> None:
        """Encode new distinct pre-tokens, by length, and keep them under their bytes."""
        size = ends - starts
        got: list[np.ndarray | None] = [None] * len(starts)
        for length in np.unique(size):
            some = np.flatnonzero(size == length)
            if length > LONG:
                for i in some:
                    got[i] = self.merge_long(data[starts[i] : ends[i]])
                continue
            step = max(1, (1 << 20) // int(length))
            for a in range(0, len(some), step):
                part = some[a : a + step]
                for i, ids in zip(part, self.merge_rows(data[starts[part][:, None] + np.arange(length)]), strict=True):
                    got[i] = ids
        total = sum(map(len, got))
        while self.used + total > len(self.known_ids):
            self.known_ids = np.concatenate([self.known_ids, np.zeros_like(self.known_ids)])
        while len(self.known) + len(got) > len(self.known_at):
            self.known_at = np.concatenate([self.known_at, np.zeros_like(self.known_at)])
            self.known_size = np.concatenate([self.known_size, np.zeros_like(self.known_size)])
        for key, ids in zip(keys, got, strict=True):
            k = len(self.known)
            self.known[key], self.known_at[k], self.known_size[k] = k, self.used, len(ids)
            self.known_ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a slice, one after another, and each row's first."""
        starts = pre_tokens(data, offs)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offs), dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        first, back = distinct_spans(data, starts, ends)
        if len(self.known) + len(first) > CACHE and self.known:
            self.known, self.used = {}, 0
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        spot = np.array([self.known.get(k, -1) for k in keys], dtype=np.int64)
        new = np.flatnonzero(spot < 0)
        if len(new):
            base = len(self.known)
            self._learn(data, starts[first[new]], ends[first[new]], [keys[i] for i in new])
            spot[new] = np.arange(base, base + len(new))
        spot = spot[back]
        size = self.known_size[spot]
        cum = np.concatenate([[0], np.cumsum(size)])
        ids = self.known_ids[np.repeat(self.known_at[spot] - cum[:-1], size) + np.arange(cum[-1])]
        return ids, cum[np.searchsorted(starts, offs)]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after another, and the end of each; an id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError(f"not an id of this vocabulary: {int(ids.min() if ids.min() < 0 else ids.max())}")
        size = self.sizes[ids]
        cum = np.cumsum(size)
        return self.pool[np.repeat(self.starts[ids] - cum + size, size) + np.arange(cum[-1] if len(cum) else 0)], cum


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: base64, blank, rank on each line. Read on the driver and broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ready(sent) -> Bpe:
    """One Bpe for each worker process and vocabulary; its tables are built once."""
    if sent.id not in _READY:
        _READY[sent.id] = Bpe(sent.value)
    return _READY[sent.id]


class _Sent:
    """A broadcast vocabulary (at most some MB: its file's size is checked)."""

    def __init__(self, df: DataFrame, path: str, limit: int = 64 << 20) -> None:
        ranks = read_ranks(path)
        if sum(map(len, ranks)) > limit:
            raise ValueError("the vocabulary is too large to broadcast")
        self.held = df.sparkSession.sparkContext.broadcast(ranks)
        self.id = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    @property
    def value(self) -> dict[bytes, int]:
        return self.held.value


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All columns, and the ids of the whole text as ``array<int>`` (null and empty: no ids).

    A column of that name is replaced. Runs inside the scan; no shuffle.
    """
    sent = _Sent(docs, vocabulary)
    kept = [c for c in docs.columns if c != out_col]
    base = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(sent)
        for batch in batches:
            for lo, hi, data, offs in textcore.slices(batch.column(at), SLICE):
                ids, first = bpe.encode_slice(data, offs)
                column = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, column], names=[*kept, out_col])

    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return base.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All columns, and the bytes of the ids as ``binary`` (null ids: no bytes). An id that the vocabulary lacks, or a null one, is an error."""
    sent = _Sent(rows, vocabulary)
    kept = [c for c in rows.columns if c != out_col]
    base = rows.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(sent)
        for batch in batches:
            out = [bpe.decode_flat(np.asarray(x or [], dtype=np.int64))[0].tobytes() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.binary())], names=[*kept, out_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both digested.

    Ids and bytes stay inside the task, so a petabyte of ids is never moved to be digested.
    """
    sent = _Sent(docs, vocabulary)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(sent)
        for batch in batches:
            for lo, hi, data, offs in textcore.slices(batch.column(1), SLICE):
                ids, first = bpe.encode_slice(data, offs)
                raw, ends = bpe.decode_flat(ids)
                cuts = np.concatenate([[0], ends])[first]
                wide, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
                sha = [hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                back = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(sha), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
