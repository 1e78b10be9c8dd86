"""Toxicity scores of deobfuscated text.

Spans that may hide a word (letters mixed with look-alike digits and signs, letters spaced out,
letters repeated) become lattices of characters. A character trigram model, counted over all
documents, scores the paths, Viterbi decoding takes the best one, and restored words count beside
the words as written. A lexicon of words and word starts that mark toxic text, and the two numbers
that turn a document's lexicon weights into a probability, are fitted on a bounded sample of
labelled rows.

A null text is empty; an empty text gets the score of a text without lexicon words. Repeated rows
get equal scores. Without labels every score is the same. Ties in decoding go to the first path.
An empty table gives an empty result. Only the id and the text of documents are used, and the id
only to join labels.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.llm.common import crc_mod, documents, prepare, text_passes, tidy

#: Labelled rows that the classifier is fitted on at most, and lexicon entries that it keeps at most.
TRAINING_ROWS = 8000
LEXICON_ENTRIES = 20_000
#: A lexicon entry stands in so many toxic training texts at least, and is so many times likelier there.
LEAST_TOXIC, LEAST_RATIO = 4, 15.0
MEMO_WORDS = 150_000

# Characters that stand for letters in disguised words.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}

_LETTER = "a-zß-öø-ÿœ"
_SIGN = re.escape("".join(LOOK_ALIKES))
#: Letters with look-alikes among them, letters three times or more, and single characters spaced out.
SUSPECT = re.compile(rf"(?<![{_LETTER}{_SIGN}])(?=[{_SIGN}]*[{_LETTER}])(?=[{_LETTER}]*[{_SIGN}]+[{_LETTER}{_SIGN}]*)[{_LETTER}{_SIGN}]+|[{_LETTER}]*([{_LETTER}])\1\1[{_LETTER}]*|(?<![{_LETTER}{_SIGN}])[{_LETTER}{_SIGN}](?:[ .*_-][{_LETTER}{_SIGN}]){{2,}}(?![{_LETTER}{_SIGN}])")
QUICK = re.compile(rf"[{_LETTER}][{_SIGN}][{_LETTER}]|[{_SIGN}][{_LETTER}]|[{_LETTER}][{_SIGN}](?![{_LETTER}])|([{_LETTER}])\1\1|(?<![{_LETTER}{_SIGN}])[{_LETTER}{_SIGN}][ .*_-][{_LETTER}{_SIGN}][ .*_-][{_LETTER}{_SIGN}](?![{_LETTER}{_SIGN}])")
SEPARATOR = re.compile(r"[ .*_-]")

CLASSES = 62
_CLASS = np.full(256, 60, dtype=np.int64)
_CLASS[np.r_[0:33, 0x7F:0xA1]] = 0
_CLASS[0x30:0x3A] = 59
for _i in range(26):
    _CLASS[[0x41 + _i, 0x61 + _i]] = 1 + _i
_CLASS[0xC0:0xE0] = _CLASS[0xE0:0x100] = 27 + np.arange(32)


def character_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 256, _CLASS[np.minimum(points, 255)], 61)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character-class trigrams over all texts: a table of CLASSES ** 3 numbers."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in text_passes(batch):
                c = character_classes(" ".join(filter(None, part.column("text").to_pylist())))
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3)
    for gram, n in counted.collect():  # CLASSES ** 3 rows at most
        out[gram] = n
    return out


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed by the class's own share."""
    cube = counts.reshape(CLASSES, CLASSES, CLASSES)
    one = cube.sum((0, 1)) + 1.0
    one /= one.sum()
    two = cube.sum(0) + 20 * one
    two /= two.sum(-1, keepdims=True)
    three = cube + 20 * two[None]
    return np.log(three / three.sum(-1, keepdims=True)).astype(np.float32)


def _class(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < 256 else 61


def lattice(span: str) -> list[list[str]]:
    """What each place of a suspect span may stand for: a string of no, one or two characters."""
    spaced = len(span) > 2 and all(SEPARATOR.fullmatch(c) for c in span[1::2])
    places = span[::2] if spaced else span
    out: list[list[str]] = []
    for m in re.finditer(r"(.)\1*", places, re.DOTALL):
        c, n = m[1], len(m[0])
        options = [*LOOK_ALIKES.get(c, ""), c]
        out += [[*options, *(2 * o for o in options)]] if n >= 3 else [options] * n
    return out


def viterbi(places: list[list[str]], model: np.ndarray) -> str:
    """The likeliest word through a lattice, between spaces."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in [*places, [" "]]:
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for o in options:
                p, q, s = a, b, score
                for c in o:
                    k = _class(c)
                    s += float(model[p, q, k])
                    p, q = q, k
                if (old := reached.get((p, q))) is None or s > old[0]:
                    reached[p, q] = (s, (path, o))
        best = reached
    path, out = max(best.values(), key=lambda x: x[0])[1], []
    while path:
        path, o = path
        out.append(o)
    return "".join(reversed(out)).strip()


def restored(text: str, model: np.ndarray) -> list[str]:
    """The decoded words of a lower-cased text's suspect spans."""
    if not QUICK.search(text):
        return []
    return [viterbi(lattice(m[0]), model) for m in SUSPECT.finditer(text)]


_EDGE = " \t\n.,;:!?\"'()[]{}<>|*#&%-_=+/\\~`"


def features(word: str) -> list[int]:
    """Hashes of a word and of its first four and five letters."""
    w = word.lower().strip(_EDGE)
    if len(w) < 3:
        return []
    return [xxhash.xxh64_intdigest(f) >> 1 for f in dict.fromkeys((f"={w}", f"4{w[:4]}" if len(w) > 4 else f"={w}", f"5{w[:5]}" if len(w) > 5 else f"={w}"))]


@dataclass
class ToxicityModel:
    trigrams: np.ndarray
    lexicon: dict[int, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            found = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            if len(word) <= 64:
                self.memo[word] = found
        return found

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The greatest weight of the text's words, and the log of one plus their sum."""
        text = text or ""
        words = {*text.split()}
        weights = [*map(self.weight, words), *map(self.weight, {*restored(text.lower(), self.trigrams)} - words)]
        return max(weights, default=0.0), math.log1p(sum(weights))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        top, total = self.evidence(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * top + c * total))))


def feature_counts(rows: DataFrame, trigrams: np.ndarray) -> DataFrame:
    """(feature, toxic, clean): in how many distinct training texts (columns text, toxic) a feature stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {*text.split(), *restored(text.lower(), trigrams)}
                counts[toxic].update({f for w in words for f in features(w)})
        keys = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([counts[1][k] for k in some], pa.int64()), pa.array([counts[0][k] for k in some], pa.int64())], names=["feature", "toxic", "clean"])

    each = rows.mapInArrow(tidy(run), "feature long, toxic long, clean long")
    return each.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a little shrinkage, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, shrink = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - shrink @ beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + shrink + 1e-6 * np.eye(3), grad)
        beta = beta + np.clip(step, -3, 3)
    return tuple(map(float, beta))


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fit to all of ``docs`` (characters) and to at most ``training_rows`` of ``labels`` (doc_id, toxic)."""
    model = ToxicityModel(trigram_model(trigram_counts(docs)))
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # copies count once, and always on the same side of the split
    rows = rows.groupBy(F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("fold", F.expr("conv(substr(m, 1, 4), 16, 10) % 4"))
    to_count = rows.where("fold <> 0").select("text", "toxic")
    n = dict(to_count.groupBy("toxic").count().collect())
    toxic_texts, clean_texts = n.get(1, 0), n.get(0, 0)
    ratio = ((F.col("toxic") + 0.1) / (toxic_texts + 1)) / ((F.col("clean") + 0.3) / (clean_texts + 1))
    marked = feature_counts(to_count, model.trigrams).withColumn("ratio", ratio).where((F.col("toxic") >= LEAST_TOXIC) & (F.col("ratio") >= LEAST_RATIO))
    model.lexicon = {r.feature: math.log(r.ratio) for r in marked.orderBy(F.desc(F.col("toxic") * F.ln("ratio")), "feature").limit(LEXICON_ENTRIES).collect()}

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])
        model.memo.clear()

    held = rows.where("fold = 0").select("text", "toxic").mapInArrow(tidy(seen), "a double, b double, toxic int").collect()  # a quarter of training_rows at most
    if held:
        model.curve = _fit_curve(np.array([(r.a, r.b) for r in held]), np.array([float(r.toxic) for r in held]))
    return model


def scored(model: ToxicityModel, text: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with a score column. The worker keeps the model until its next task, so its memo ends here."""
    for batch in batches:
        for part in text_passes(batch, text):
            scores = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, "score"])
    model.memo.clear()


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) to the documents."""
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(tidy(functools.partial(scored, model, text)), schema)


def train_for(spark: SparkSession, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    """The model of the query and the pipeline: labels of rows whose crc32 of the id modulo 5 is not 0."""
    labels = documents(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", "toxic")
    return fit(docs.select("doc_id", "text"), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train_for(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
