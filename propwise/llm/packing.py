"""Packing: cost-balanced sequences from tokenised documents.

Cost of a piece of ``n`` tokens is ``linear * n + quadratic * n ** 2`` (dense layers and
attention inside the piece).  Documents are dealt in input order into groups of about
``group_tokens`` tokens inside a task.  A group opens exactly the sequences its tokens need;
whole windows of long documents fill sequences of their own, and the other pieces go in
descending length to the sequence of lowest cost that still has room for them.  When none
has, the piece is cut at the room of the emptiest sequence and the rest is dealt again, so a
group leaves less than one sequence of padding.  Ids never leave the task that made them:
no shuffle, and a lost executor repeats its own tasks only.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_TOKENS = 1 << 20
#: Bytes of text tokenised at once (a longer text alone).
BATCH_BYTES = 8 << 20
#: Estimated cost of a token in the dense layers, and of a pair of tokens in attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
END_ID = 1
#: A worker forgets its cached words beyond this many.
MAX_CACHED = 600_000

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, sequence_cost double")

#: ASCII marks but the apostrophe: after an ASCII letter the pre-tokenizer always parts them.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class ChunkTokenizer:
    """Ids of whole texts from ids of their chunks between ASCII white space.

    Exact for lower-casing tokenizers that drop white space, never join across it and end each
    word in a token of its own kind (``</w>``); checked against whole texts in the tests.  Each
    distinct chunk of a batch is looked up once, each distinct word encoded once per worker.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        vocab = self.encode.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}  # word -> its place in begin and size
        self.pool, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        # words of Latin letters are one pre-token each: encode many at once, cut after each word end
        plain, other = [], []
        for c in words:
            t = c.decode("utf-8")
            (plain if t.isalpha() and max(t) < "\u0100" else other).append((c, t))
        for i in range(0, len(plain), 512):
            part = plain[i:i + 512]
            ids = np.array(self.encode.encode(" ".join([t for _, t in part]), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                other += part
                continue
            self.known.update(zip([c for c, _ in part], range(len(self.known), len(self.known) + len(part))))
            found.append(ids)
            sizes.append(np.diff(cut, prepend=0))
        for i in range(0, len(other), 512):
            part = other[i:i + 512]
            for (c, _), e in zip(part, self.encode.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                self.known[c] = len(self.known)
                found.append(np.array(e.ids, "<u4"))
                sizes.append(np.array([len(e.ids)]))
        self.pool = np.concatenate([self.pool, *found])
        self.size = np.concatenate([self.size, *sizes])
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        if len(self.known) > MAX_CACHED:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        trimmed = pc.ascii_rtrim(chunks, MARKS)
        full, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (chunks, trimmed))
        last, first = _ends(chunks, kept)
        parted = (kept > 0) & (kept < full) & (((last | 32) >= 97) & ((last | 32) <= 122))
        special = pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        parted &= ~special
        heads = pc.if_else(pa.array(parted), trimmed, chunks)
        heads = pc.if_else(pa.array(special), heads, pc.ascii_lower(heads)).dictionary_encode()
        at = np.flatnonzero(parted)
        body = first[1]
        tails = [body[i:j] for i, j in zip((first[0][at] + kept[at]).tolist(), first[0][at + 1].tolist())]
        names = _strings(heads.dictionary)
        known = self.known
        self._learn(list(dict.fromkeys(x for x in (*names, *set(tails)) if x not in known)))
        head = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[heads.indices.to_numpy()]
        tail = np.zeros(len(head), np.int64)
        tail[at] = np.fromiter(map(known.__getitem__, tails), np.int64, len(tails))
        # each chunk's ids side by side, then each text's chunks
        ids = _gather(self.pool, self.begin, self.size, np.column_stack([head, tail]).ravel())
        size = self.size[head] + self.size[tail]
        code = coded.indices.to_numpy()
        flat = _gather(ids, np.cumsum(size) - size, size, code)
        edge = np.concatenate([[0], np.cumsum(size[code])])[split.offsets.to_numpy()]
        return [flat[i:j] for i, j in zip(edge[:-1], edge[1:])]


def _strings(a: pa.Array) -> list[bytes]:
    offsets, body = _buffers(a)
    edge = offsets.tolist()
    return [body[i:j] for i, j in zip(edge[:-1], edge[1:])]


def _buffers(a: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets and bytes of a large string array."""
    _, offsets, body = a.cast(pa.large_string()).buffers()
    return (np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1],
            body.to_pybytes() if body is not None else b"") if len(a) else (np.zeros(1, np.int64), b"")


def _ends(chunks: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, bytes]]:
    """The last byte of the first ``kept`` bytes of each chunk; the chunks' buffers."""
    offsets, body = _buffers(chunks)
    at = np.frombuffer(body or b"\0", np.uint8)
    return at[np.maximum(offsets[:-1] + kept - 1, 0)], (offsets, body)


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Concatenate the slices ``pick`` of ``pool``."""
    n = size[pick]
    edge = np.cumsum(n)
    place = np.repeat(begin[pick] - (edge - n), n)
    place += np.arange(len(place))
    return pool[place]


def _slices(b: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows of at most ``most`` bytes of text, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield b.slice(i, j - i)
        i = j


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Pieces ``(document, start, length, sequence)`` of one group and each sequence's cost.

    Sequences number ``ceil(sum / capacity)``.  Documents of equal length keep their order.
    """
    pieces: list[tuple[int, int, int, int]] = []
    n = -(-sum(lengths) // capacity)
    room, cost, at = np.full(n, capacity, np.int64), np.zeros(n), 0
    price = lambda k: linear * k + quadratic * k * k
    heap: list[tuple[int, int, int]] = []
    for d, k in enumerate(lengths):
        for i in range(k // capacity):
            pieces.append((d, i * capacity, capacity, at))
            room[at], cost[at], at = 0, price(capacity), at + 1
        if k % capacity:
            heap.append((-(k % capacity), d, k - k % capacity))
    heapq.heapify(heap)
    while heap:
        k, d, start = heapq.heappop(heap)
        k = -k
        fits = np.flatnonzero(room >= k)
        s = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
        take = min(k, int(room[s]))
        pieces.append((d, start, take, s))
        room[s] -= take
        cost[s] += price(take)
        if take < k:
            heapq.heappush(heap, (take - k, d, start + take))
    return pieces, cost


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id",
         capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID,
         linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; ``with_ids`` adds the ids themselves.

    Every row of ``docs`` gives its ids and ``end_id``, cut into pieces that lie in one sequence
    each; a sequence's pieces fill it gaplessly from offset 0.  Null and empty texts give the
    end id alone.  Rows repeated whole are packed as often as they occur.  Null ids stay null.
    Columns other than the two named play no part.  An empty table gives an empty result.
    ``sequence_id`` is unique; it is not gapless.  A document longer than a group makes a group
    of its own.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    kinds = [pa.int64()] * 7 + [pa.float64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        first = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, total
            pieces, cost = assign([len(ids) for _, ids in held], capacity, linear, quadratic)
            pieces.sort(key=lambda p: (p[3], p[0], p[1]))
            rows, offset, last = [], 0, -1
            for d, start, length, s in pieces:
                offset = offset if s == last else 0
                part = held[d][1][start:start + length]
                row = (held[d][0], start, length, zlib.crc32(part.tobytes()), len(held[d][1]), first + s, offset,
                       float(cost[s]))
                rows.append((*row, part.astype(np.int32)) if with_ids else row)
                offset, last = offset + length, s
            first += len(cost)
            total = 0
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            for part in _slices(b):
                for d, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                    ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4")
                    held.append((d, ids))
                    total += len(ids)
                    if total >= group_tokens:
                        yield flush()
        if held:
            yield flush()

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, schema)
