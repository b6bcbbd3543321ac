"""Language ID by hierarchical discrimination.

First a language family, by one linear classifier for each family; then, among the languages
of that family, one-versus-one linear support vector machines that vote.  Features are hashed
byte trigrams of the whole lower-cased text with all marks and digits read as spaces (square
roots of counts, unit length).  All machines minimise the squared hinge loss and are fitted
on a bounded sample of labelled rows, each in a task of its own, on the sample's dot products; their
weights (machines x buckets) are broadcast.  A language code that no family names joins the
family of the language whose mean features are most like its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest, stage

BUCKETS = 4096
#: Labelled rows used of each language, and of all together; and languages learned, those with the most
#: texts: the bounds of the training sample.
SAMPLE_PER_LANG, MAX_SAMPLE, MAX_LANGS = 400, 4_000, 200
#: Cosine of mean features from which a code without a family joins another's.
ALIKE = 0.5
UNKNOWN = "und"
RESULT = ["held_out", "lang_pred", "score"]

#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# ASCII bytes that are no letter read as spaces
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _bucket(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint32)
    h = a[:-2] * _MIX[0] ^ a[1:-1] * _MIX[1] ^ a[2:] * _MIX[2]
    return (h ^ (h >> np.uint32(15))) * _MIX[1] >> np.uint32(20)


_BLANK = int(_bucket(np.frombuffer(b"   ", np.uint8))[0])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(texts: list[str | None]) -> np.ndarray:
    """One unit row of ``BUCKETS`` numbers for each whole text; a row of zeros without a trigram."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        body = b" " + (t or "").lower().encode("utf-8").translate(_TABLE) + b" "
        a = np.frombuffer(body, np.uint8)
        if len(a) >= 3:
            out[i] = np.bincount(_bucket(a), minlength=BUCKETS)
    out[:, _BLANK] = 0
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def fit_svm(dots: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, classes weighted alike) on the rows' dot products; ``y`` is +1 or -1.

    Every gradient step adds multiples of the rows to the weights, so it is taken on the multiples: the
    result is the rows' coefficients, and the bias.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, v, t = np.zeros((2, len(y)), np.float32), np.zeros((2, len(y)), np.float32), 1.0  # coefficients; the bias in w[1, 0]
    rate = 1.0 / (1.0 + 2 * c * float(share @ (np.diag(dots) + 1)))  # above the curvature
    for _ in range(steps):  # accelerated gradient steps
        pull = share * np.maximum(0, 1 - y * (dots @ v[0] + v[1, 0])) * y
        step = np.stack([pull, np.zeros_like(pull)])
        step[1, 0] = pull.sum()
        new = v - rate * (v - 2 * c * step)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + np.float32((old - 1) / t) * (new - w)
        w = new
    return w[0], float(w[1, 0])


def fit_machine(x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of the machine that tells rows of side 1 from those of -1; others are left out."""
    rows = x[side != 0].astype(np.float32)
    part, bias = fit_svm(rows @ rows.T, side[side != 0].astype(np.float32))
    return np.append(rows.T @ part, np.float32(bias)).astype(np.float32)


def families_of(means: np.ndarray, langs: list[str]) -> dict[str, str]:
    """The family of each language: its own code's, else that of the language most like it, else none but its own."""
    found = {v: FAMILY_OF[v] for v in langs if v in FAMILY_OF}
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    like = unit @ unit.T
    np.fill_diagonal(like, -1)
    order = sorted((-like[i, j], i, j) for i in range(len(langs)) if langs[i] not in found for j in range(len(langs)))
    for gap, i, j in order:  # closest first
        if -gap >= ALIKE and langs[i] not in found:
            found[langs[i]] = found.setdefault(langs[j], langs[j])
    return {v: found.get(v, v) for v in langs}


#: Machines are named by the sides they part: ("family", f) or ("pair", language, language).
Machine = tuple[str, ...]


def sides(machine: Machine, lang: np.ndarray, family: np.ndarray) -> np.ndarray:
    """1, -1 or 0 (left out) for each row of the sample."""
    if machine[0] == "family":
        return np.where(family == machine[1], 1, -1)
    return (lang == machine[1]).astype(int) - (lang == machine[2])


def fit_here(x: np.ndarray, lang: np.ndarray, family: np.ndarray, machines: list[Machine]) -> list[np.ndarray]:
    return [fit_machine(x, sides(m, lang, family)) for m in machines]


def fit_in_tasks(spark) -> Callable[..., list[np.ndarray]]:
    """Like ``fit_here`` with a task for each machine; the bounded sample is broadcast."""
    def run_all(x: np.ndarray, lang: np.ndarray, family: np.ndarray, machines: list[Machine]) -> list[np.ndarray]:
        if not machines:
            return []
        sent = spark.sparkContext.broadcast((x.astype(np.float16), lang, family, machines))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, lang, family, machines = sent.value
            for b in batches:
                for i in b.column("id").to_pylist():
                    w = fit_machine(x, sides(machines[i], lang, family))
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w.tobytes()], pa.binary())], ["id", "w"])

        rows = spark.range(0, len(machines), 1, len(machines)).mapInArrow(run, "id bigint, w binary").collect()
        return [np.frombuffer(r["w"], np.float32) for r in sorted(rows, key=lambda r: r["id"])]

    return run_all


class LanguageModel:
    """Fitted machines: ``families`` by one against the rest, ``pairs`` by family."""

    def __init__(self, x: np.ndarray, langs: list[str], fit_all: Callable[..., list[np.ndarray]] = fit_here):
        self.langs = sorted(set(langs))
        lang = np.array(langs)
        of = families_of(np.stack([x[lang == v].mean(axis=0) for v in self.langs]), self.langs)
        family = np.array([of[v] for v in langs])
        self.families = sorted(set(of.values()))
        own = {f: [v for v in self.langs if of[v] == f] for f in self.families}
        machines: list[Machine] = [("family", f) for f in self.families] if len(self.families) > 1 else []
        machines += [("pair", *p) for f in self.families for p in combinations(own[f], 2)]
        fitted = dict(zip(machines, fit_all(x, lang, family, machines)))
        self.top = np.column_stack([fitted["family", f] for f in self.families]) if len(self.families) > 1 else None
        self.pairs: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray | None]] = {}
        for f in self.families:
            duels = list(combinations(range(len(own[f])), 2))
            w = [fitted["pair", own[f][a], own[f][b]] for a, b in duels]
            self.pairs[f] = (own[f], duels, np.column_stack(w) if w else None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and a score from 0 to 1: how clear the family and the closest duel were."""
        x = features(texts)
        squash = lambda m: 1 / (1 + np.exp(-2.0 * m.astype(np.float64)))
        if self.top is None:
            pick, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            margin = x @ self.top[:-1] + self.top[-1]
            pick, score = margin.argmax(axis=1), squash(margin.max(axis=1))
        names = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(pick == k)
            own, duels, w = self.pairs[f]
            if w is None or not len(rows):
                names[rows] = own[0]
                continue
            margin = x[rows] @ w[:-1] + w[-1]
            votes = np.zeros((len(rows), len(own)))
            for j, (a, b) in enumerate(duels):
                # a vote each; the margins, squashed below one vote, settle ties
                soft = np.tanh(margin[:, j]) * 0.4 / len(own)
                votes[:, a] += (margin[:, j] >= 0) + soft
                votes[:, b] += (margin[:, j] < 0) - soft
            best = votes.argmax(axis=1)
            names[rows] = np.array(own, object)[best]
            worst = np.full(len(rows), np.inf)
            for j, (a, b) in enumerate(duels):
                worst = np.where(best == a, np.minimum(worst, margin[:, j]),
                                 np.where(best == b, np.minimum(worst, -margin[:, j]), worst))
            score[rows] *= squash(worst)
        ok = np.fromiter(map(has_letter, texts), bool, len(texts))
        return [str(n) if k else UNKNOWN for n, k in zip(names, ok)], np.where(ok, score, 0.0)


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG,
        held: int = 1, folds: int = 3, max_sample: int = MAX_SAMPLE, max_langs: int = MAX_LANGS) -> LanguageModel | None:
    """Fit on a bounded sample of distinct texts whose rows' folds are not ``held``.

    At most ``per_lang`` texts of each language and about ``max_sample`` in all, of the ``max_langs``
    languages with the most texts; those with the smallest digests.  Their digests are found first, in narrow
    rows, and broadcast; features are then made in tasks from whole texts, and only their numbers
    travel.  None if no row has a language and a letter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h")).where(
        (remainder(F.col(doc_id), folds) != held) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    narrow = stage(rows.select("lang", "h").distinct(), "language-digests")
    learned = [r["lang"] for r in narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
               .limit(max_langs).collect()]
    quota = max(1, min(per_lang, max_sample // max(len(learned), 1)))
    picked = smallest(narrow.where(F.col("lang").isin(learned)), "lang", ["h"], quota)
    rows = rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = features(part.column("text").to_pylist())
                keep = pa.array(x.any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("h"),
                     pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "h", "x"]).filter(keep)

    got = rows.mapInArrow(run, "lang string, h bigint, x binary").dropDuplicates(["lang", "h"]).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("h", "ascending")])  # the same sums on every run
    x = np.empty((got.num_rows, BUCKETS), np.float16)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    return LanguageModel(x, got.column("lang").to_pylist(), fit_in_tasks(spark))


def identify(docs: DataFrame, model: LanguageModel | None = None, text: str = "text", doc_id: str = "doc_id",
             lang: str = "lang", carry: list[str] | None = None, held: int = 1, folds: int = 3) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with ``RESULT`` appended.

    Only the text decides.  A null text, one without a letter and, if nothing could be learned,
    any text is ``und`` with score 0.  A null id is not held out and teaches nothing.  Rows alike
    get alike results.  Columns of the input that carry a result's name are replaced.
    """
    model = model or fit(docs, text, doc_id, lang, held=held, folds=folds)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(*carry, F.coalesce(remainder(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"),
                       F.col(text).cast("string").alias("__text"))
    kept = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                names, score = sent.value.predict(texts) if sent.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    [*part.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that have no language (``und``), columns as they were."""
    boxed = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__body"), F.col(lang).alias("__lang"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    return identify(boxed, None, "__body", "__doc", "__lang", carry=["__row"]).where(
        F.col("lang_pred") != UNKNOWN).select("__row.*")
