"""Token counts by a whole-token shortcut.

Offline, ``prove_whole`` asks the library's own model which strings of the vocabulary come out
as that one token when they stand alone; there are at most as many as the vocabulary has
entries, and they are broadcast.  A task then cuts texts into pre-tokens: one that is in the
proven set counts 1, all others are merged by the library's model.  No ids are made for the
first kind, and each distinct chunk of a batch is looked up once.  No shuffle: a lost executor
repeats its own tasks only.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Bytes of text cut at once (a longer text alone).
BATCH_BYTES = 8 << 20
#: A worker remembers this many chunks, none longer than ``MAX_KEPT_BYTES``.
MAX_KEPT, MAX_KEPT_BYTES = 400_000, 48

RESULT = "n_bytes bigint, n_tokens bigint, over_limit boolean, n_shortcut bigint"


def _library(path: str):
    if not path.endswith(".json"):
        raise ValueError(f"{path}: only tokenizer files of the tokenizers library are read")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prove_whole(path: str) -> frozenset[str]:
    """Pre-tokens, as the model gets them, that it encodes as one token: the entry they spell."""
    lib = _library(path)
    suffix = getattr(lib.model, "end_of_word_suffix", None) or ""
    proven = set()
    for entry, i in lib.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(suffix) or entry == suffix:
            continue
        word = entry[:len(entry) - len(suffix)]
        got = lib.model.tokenize(word)
        if len(got) == 1 and got[0].id == i:
            proven.add(word)
    return frozenset(proven)


class Counter:
    """Counts tokens of texts as the library does, special strings inside texts being special."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.lib, self.whole = _library(path), whole
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        if any(a.get("normalized") or a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in added):
            raise ValueError(f"{path}: added tokens that match loosely are not supported")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.marks = "".join({n[0] for n in names})
        # white space parts pre-tokens and is dropped: a text is the sum of its chunks
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = (steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", "Removed", True)
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        # printable ASCII: only the lower case changes, and the byte alphabet is ASCII itself
        self.plain = None
        if (self.by_chunk and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and "Regex" in steps[0]["pattern"]
                and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and norms == ["NFC", "Replace", "Lowercase"]):
            self.plain = regex.compile(steps[0]["pattern"]["Regex"])
        self.kept: dict[str, tuple[int, int]] = {}

    def _words(self, text: str) -> Iterable[str]:
        if self.plain and text.isascii() and text.isprintable():
            return self.plain.findall(text.lower())
        if self.lib.normalizer is not None:
            text = self.lib.normalizer.normalize_str(text)
        return [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of ``text`` and how many of them the shortcut gave."""
        parts, tokens, short = [text], 0, 0
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            tokens = len(parts) - 1
        for part in parts:
            for w in self._words(part) if part else ():
                if w in self.whole:
                    short += 1
                else:
                    tokens += len(self.lib.model.tokenize(w))
        return tokens + short, short

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``count`` of each text; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_chunk:
            both = np.array([self.count(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
            return both[:, 0], both[:, 1]
        if len(self.kept) > MAX_KEPT:
            self.kept.clear()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        both, kept = np.zeros((len(coded.dictionary), 2), np.int64), self.kept
        for i, chunk in enumerate(coded.dictionary.to_pylist()):
            got = kept.get(chunk)
            if got is None:
                got = self.count(chunk)
                if len(chunk) <= MAX_KEPT_BYTES:
                    kept[chunk] = got
            both[i] = got
        upto = np.zeros((len(coded) + 1, 2), np.int64)
        np.cumsum(both[coded.indices.to_numpy()], axis=0, out=upto[1:])
        edge = split.offsets.to_numpy()
        total = upto[edge[1:]] - upto[edge[:-1]]
        return total[:, 0], total[:, 1]


_COUNTERS: dict[str, Counter] = {}


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows of at most ``BATCH_BYTES`` of text, one row at least."""
    upto = np.cumsum(pc.fill_null(b.column("n_bytes"), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield b.slice(i, j - i)
        i = j


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", carry: Iterable[str] = ("doc_id",),
                 limit: int = LIMIT) -> DataFrame:
    """The columns ``carry`` of every row with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``n_shortcut``.

    ``n_tokens`` is what the library gives for the whole text without begin, end or added special
    tokens; ``n_shortcut`` of them came from the proven set.  Null and empty texts have 0 bytes and 0
    tokens.  Repeated rows are counted one by one, null ids stay null.  Columns not in ``carry`` play no
    part, and a carried column may have the name of a result: the result wins.  An empty table
    gives an empty result.  ``tokenizer_path`` must be readable on all machines.
    """
    spark = docs.sparkSession
    names = [r.split()[0] for r in RESULT.split(", ")]
    carry = [c for c in carry if c not in names]
    rows = docs.select(*[F.col(c) for c in carry], F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint")
                       .alias("n_bytes"), F.col(text).cast("string").alias("__text"))
    whole = spark.sparkContext.broadcast(prove_whole(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = Counter(tokenizer_path, whole.value)
        counter = _COUNTERS[tokenizer_path]
        for b in batches:
            for part in _slices(b):
                tokens, short = counter(part.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), part.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit),
                     pa.array(short)], [*carry, *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), RESULT]))
