"""Language identification in two levels: a language family first, then one-versus-one linear support vector machines
between the languages of the family.

A text's features are the hashed 1-, 2- and 3-grams of its lower-cased letters (other characters are word breaks), as
square roots of counts on the unit sphere; whole texts count. The models are fitted on the driver from a bounded sample:
at most TRAIN_ROWS labelled documents in all, the same number for each language, each once as a whole and once as one of
its lines. Prediction is map-only.

Defined cases: a null text or one without a letter is `und` with score 0; without any labelled text everything is
`und`; languages that the family table lacks are families of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import add_columns

DIMENSIONS = 4096
TRAIN_ROWS = 1600
#: Documents of each language that the sample has room for at least.
LEAST = 4
UNKNOWN = "und"
#: Code points looked at together, which bounds a task's memory for very long texts.
BLOCK = 1 << 20
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """The unit vector of a text, None if it has no letter."""
    counts = np.zeros(DIMENSIONS)
    held, letters = np.zeros(0, np.uint64), _letters()
    text = text or ""
    any_letter = False
    for a in range(0, len(text), BLOCK):
        points = np.frombuffer(text[a : a + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[points]
        any_letter = any_letter or bool(is_letter.any())
        points = np.where(is_letter, points, 32).astype(np.uint64)
        breaks = points == 32
        points = points[~(breaks & np.concatenate([[a == 0 or held[-1:].tolist() == [32]], breaks[:-1]]))]  # one break for a run of them
        line = np.concatenate([held, points])
        skip = len(held)
        for n in (1, 2, 3):
            if len(line) < n:
                continue
            h = np.zeros(len(line) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + line[k : len(line) - n + 1 + k] + np.uint64(n)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h[max(0, skip - n + 1) :] >> np.uint64(52)
            counts += np.bincount(h.astype(np.int64), minlength=DIMENSIONS)
        held = line[-2:]
    if not any_letter:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def _fit(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """A linear SVM with squared hinge loss by accelerated gradient; classes weigh the same. y: +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = previous = np.zeros(x.shape[1], x.dtype)
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    step = np.float32(1 / 2.5)
    for k in range(rounds):
        v = w + np.float32(k / (k + 3)) * (w - previous)
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = np.float32(strength) * v - 2 * ((weight * slack * y) @ x)
        previous, w = w, v - step * gradient
    return w.astype(np.float64)


class Model:
    """Families against each other, then pairs of languages inside a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        """x: a row of features and a one for each sample."""
        families = [_FAMILY.get(lang, lang) for lang in langs]
        self.families = sorted(set(families))
        self.members = {f: sorted({lang for lang, g in zip(langs, families, strict=True) if g == f}) for f in self.families}
        of = np.array(families)
        by = np.array(langs)
        columns, self.first, self.pairs = [], {}, {}
        if len(self.families) > 1:
            for f in self.families:
                self.first[f] = len(columns)
                columns.append(_fit(x, np.where(of == f, 1.0, -1.0)))
        for members in self.members.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    own = (by == a) | (by == b)
                    self.pairs[a, b] = len(columns)
                    columns.append(_fit(x[own], np.where(by[own] == a, 1.0, -1.0)))
        self.weights = np.array(columns).T if columns else np.zeros((x.shape[1], 0))

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        margins = vector @ self.weights[:-1] + self.weights[-1]
        sure = lambda m: float(1 / (1 + np.exp(-np.clip(3 * m, -30, 30))))
        family, score = self.families[0], 1.0
        if self.first:
            family = max(self.families, key=lambda f: margins[self.first[f]])
            score = sure(margins[self.first[family]])
        members = self.members[family]
        votes = dict.fromkeys(members, 0.0)
        backing = {m: [1.0] for m in members}
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                margin = margins[self.pairs[a, b]]
                votes[a if margin > 0 else b] += 1 + min(abs(margin), 10) * 1e-3
                backing[a].append(sure(margin))
                backing[b].append(sure(-margin))
        lang = max(members, key=lambda m: votes[m])
        return lang, score * min(backing[lang])


def held_out(key: Column) -> Column:
    """One document in five by the checksum of its id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    """A model of a bounded sample of labelled documents: about `rows` documents, as many of each language, LEAST or more
    of every one. More languages than that allows are an error, not left out."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("__lang")).count().limit(rows // LEAST + 1).collect()
    if not sizes:
        return None
    if len(sizes) > rows // LEAST:
        raise ValueError(f"more than {rows // LEAST} languages: a sample of {rows} documents is too small for them")
    each = rows // len(sizes)
    # a language of few documents is taken whole; at most rows / LEAST rows to broadcast
    chances = [(r["__lang"], int(min(1.0, each * (2 if each < 20 else 1) / r["count"]) * (1 << 30))) for r in sizes]
    chances = labelled.sparkSession.createDataFrame(chances, "__lang string, __chance long")
    met = labelled.join(F.broadcast(chances), F.col(lang) == F.col("__lang"))
    drawn = met.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)) < F.col("__chance"))
    split = F.filter(F.split(text, "\n"), lambda s: F.char_length(s) > 0)
    pick = F.when(F.size(split) > 0, F.get(split, F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.size(split)).cast("int")))
    samples = drawn.select(F.col(lang).alias("lang"), F.explode(F.array(F.col(text), pick)).alias("sample"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang_, v) for lang_, s in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (v := features(s)) is not None]
            values = [v.astype(np.float32).tobytes() for _, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array(values, pa.binary())], names=["lang", "vector"])

    got = sorted((r.lang, bytes(r.vector)) for r in samples.mapInArrow(measure, "lang string, vector binary").collect())
    if not got:
        return None
    # single precision, and a last column of ones for the offset: the sample is held once
    x = np.ones((len(got), DIMENSIONS + 1), np.float32)
    for i, (_, vector) in enumerate(got):
        x[i, :-1] = np.frombuffer(vector, np.float32)
    names = [name for name, _ in got]
    del got
    return Model(x, names)


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, `lang_pred` and `score`."""

    def work():
        def predict(texts: list) -> tuple[list, list]:
            names, scores = [], []
            for t in texts:
                vector = features(t) if model is not None else None
                name, score = (UNKNOWN, 0.0) if vector is None else model.predict(vector)
                names.append(name)
                scores.append(score)
            return names, scores

        return predict

    return add_columns(docs, text, {"lang_pred": "string", "score": "double"}, work, keep)
