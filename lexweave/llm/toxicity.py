"""Toxicity of texts that may be disguised: Viterbi decoding under a character model, then scoring of what was meant."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, partitions_for, release, text_slices

#: Letters of the character model; everything else is a word boundary. Fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
#: What a disguise may stand for. Fixed values.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'"
#: Channel costs in nats: a lookalike, a letter doubled or drawn out, a separator dropped.
COST_LOOKALIKE, COST_DOUBLED, COST_DRAWN, COST_SEPARATOR = 1.0, 6.0, 0.5, 0.2
#: Labelled rows that the classifier is fitted on, at most; chosen by hash of their id.
MAX_LABELLED = 20_000
#: Defaults of ``train``: a feature must stand in so many toxic texts of the sample; the model keeps so many features at most.
MIN_SUPPORT, MAX_FEATURES = 5, 8192
PREFIXES = (4, 5, 6, 7)
REMEMBERED = 300_000
HELD_OUT_FOLD = 5

_SIZE = len(LETTERS) + 1
_CODE = np.zeros(0x180, np.int32)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_PLAIN = re.compile(f"[{LETTERS}]+").fullmatch
_RUN = re.compile(r"(.)\1*", re.S)
_DOUBLED = re.compile(r"(.)\1").search
_GAP = re.compile(r"[ .\-_*~]+")
#: Three or more single marks with gaps between. A mark is never a gap and no quantifier gives back, so a search reads each
#: character a fixed number of times.
_SPACED = re.compile(r"(?<![^\s.\-_*~])[^\s.\-_*~](?:[ .\-_*~]++[^\s.\-_*~](?![^\s.\-_*~])){2,}+")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of every text of ``docs(id, text)``; summed in tasks, then by trigram. The table has fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                joined = "\n\n".join(t for t in part.column("text").to_pylist() if t).lower()
                points = np.frombuffer(f"\n\n{joined}\n\n".encode("utf-32-le"), np.uint32)
                codes = _CODE[np.where(points < len(_CODE), points, 0)]
                counts += np.bincount((codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])

    rows = docs.select("id", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_SIZE**3, np.int64)
    for r in rows:
        counts[r.gram] = r.n
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others: trigram, bigram and letter frequencies interpolated."""
    tri = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    one = (uni + 1) / (uni.sum() + _SIZE)
    two = (bi + 2 * one) / (bi.sum(1, keepdims=True) + 2)
    three = (tri + 2 * two[None]) / (tri.sum(2, keepdims=True) + 2)
    return np.log(three).astype(np.float32)


class Decoder:
    """Restores disguised words: the most probable letters given what was written."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def options(self, mark: str, times: int) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with costs."""
        if mark in _INDEX:
            if times == 1:
                return [(mark, 0.0)]
            return [(mark, COST_DOUBLED if times == 2 else COST_DRAWN), (mark * 2, 0.0 if times == 2 else COST_DRAWN)]
        if mark in LOOKALIKES:
            out = [(letter, COST_LOOKALIKE) for letter in LOOKALIKES[mark]]
            return out if times == 1 else out + [(letter * 2, COST_LOOKALIKE) for letter in LOOKALIKES[mark]]
        return [("", COST_SEPARATOR)]

    def viterbi(self, word: str, breaks: bool = False) -> str:
        """Best path through the lattice of a word; a state is the last two letters. ``breaks``: words may end anywhere in it.

        A path is a chain of its steps, so that the work is linear in the length.
        """
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for run in _RUN.finditer(word):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self.options(run[1], len(run[0]))
            if breaks:
                options = [*options, *((f"{o[0]} {o[1]}", cost) for o, cost in options if len(o) == 2)]
                options += [(f" {o}", cost) for o, cost in options if o]
            for (a, b), (score, chain) in paths.items():
                for letters, cost in options:
                    if not b and letters[:1] == " ":
                        continue
                    x, y, total = a, b, score - cost
                    for letter in letters:
                        z = _INDEX.get(letter, 0)
                        total += self.model[x][y][z]
                        x, y = y, z
                    if (old := step.get((x, y))) is None or total > old[0]:
                        step[x, y] = (total, (chain, letters))
            paths = step
        ends = [(score + self.model[a][b][0], self._spelled(chain)) for (a, b), (score, chain) in paths.items()]
        return max(ends)[1]

    @staticmethod
    def _spelled(chain: tuple | None) -> str:
        out = []
        while chain is not None:
            chain, letters = chain
            out.append(letters)
        return "".join(reversed(out))

    def restore(self, word: str) -> str:
        """A word without the marks around it; decoded if it still holds marks or drawn-out letters besides two letters."""
        core = word.rstrip(".,;:!?\"'()[]{}<>*#%&|~-_$+").lstrip(".,;:?\"'()[]{}<>*#%&~-_")
        if not core or (_PLAIN(core) and not any(len(m[0]) > 2 for m in _RUN.finditer(core))):
            return core
        return self.viterbi(core) if sum(c in _INDEX for c in core) > 1 else core

    def forms(self, word: str) -> set[str]:
        """What a word of any length may mean: without the marks around it as written, and decoded where it holds marks
        (also ones at its end that may be lookalikes) or a letter twice in a row."""
        wide = word.rstrip(".,;:?\"'()[]{}<>*#%&~-_").lstrip(".,;:?\"'()[]{}<>*#%&~-_")
        core = wide.rstrip("!|$+")
        out = {self.viterbi(form) for form in {wide, core} if form and (not _PLAIN(form) or _DOUBLED(form))}
        if _PLAIN(core) or sum(c in _INDEX for c in core) < 2:
            out.add(core)
        return out

    def features(self, word: str) -> set[str]:
        return {f for form in self.forms(word) for f in word_features(form)}

    def words(self, text: str) -> list[str]:
        """Lower-case words; letters spaced apart are put together first. Linear in the length of the text."""
        text = text.lower()
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self._spaced(m[0], text, m.start(), m.end()), text)
        return text.split()

    def _spaced(self, run: str, text: str, start: int, end: int) -> str:
        """A run of single marks, of which those glued to a word on either side stay as they are."""
        first, last = 0, len(run)
        if start and not text[start - 1].isspace():
            first = next((m.end() for m in _GAP.finditer(run) if m[0][-1] == " "), last)
        if end < len(text) and not text[end].isspace():
            last = max((m.start() for m in _GAP.finditer(run) if m[0][0] == " "), default=0)
        if last - first < 5:  # fewer than three marks
            return run
        return run[:first] + self.joined(run[first:last]) + run[last:]

    def joined(self, spaced: str) -> str:
        """The run as written, as one word, and as words: gaps wider than the narrowest end a word, and the lattice ends others."""
        letters = "".join(c for c in spaced if c not in SEPARATORS)
        if len(letters) < 3:
            return spaced
        gaps = _GAP.findall(spaced)
        narrow = min(map(len, gaps), default=0)
        parts = _GAP.sub(lambda m: "\n" if len(m[0]) > narrow else "", spaced).split("\n")
        found = [spaced, self.viterbi(letters)]
        if len(parts) > 1:
            found += [self.viterbi(p) for p in parts if len(p) > 1]
        found += [self.viterbi(p, True) for p in parts if len(p) > 2]
        return " ".join(found)


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)] if len(word) > 1 else []


@dataclass(frozen=True)
class ToxicityModel:
    language: np.ndarray
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


class _Forms(dict):
    """Features of a word."""

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, word: str) -> set[str]:
        if len(self) >= REMEMBERED // 8:
            self.clear()
        found = self.decoder.features(word)
        if len(word) <= 64:  # what is remembered is bounded; longer words are decoded each time
            self[word] = found
        return found


class _Found(dict):
    """Numbers of the model's features in a word."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.decoder, self.features = Decoder(model.language), model.features

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(i for f in sorted(self.decoder.features(word)) if (i := self.features.get(f)) is not None)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for found in set(map(self.__getitem__, self.decoder.words(text))):
            out.update(found)
        return out


def _lifted(sample: DataFrame, language: np.ndarray, max_features: int, min_support: int) -> list[str]:
    """The features that part the labels best: those of at least ``min_support`` toxic texts, by how far their number of
    toxic texts is from what the feature's frequency makes likely. Counted over the whole sample in one job."""
    shared = sample.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Forms(Decoder(shared.value))
        every, toxic = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], names=["feature", "n", "bad"])
            every.clear(), toxic.clear()
            return rows

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                found = set().union(*map(known.__getitem__, set(known.decoder.words(text or ""))))
                every.update(found)
                if label:
                    toxic.update(found)
                if len(every) >= REMEMBERED:
                    yield counted()
        yield counted()

    totals = sample.agg(F.count("*"), F.sum("label")).first()
    share = (totals[1] or 0) / max(1, totals[0])
    counts = sample.select("label", "text").mapInArrow(run, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    lift = F.abs(F.col("bad") - F.col("n") * F.lit(share)) / F.sqrt(F.col("n") * F.lit(share) + 1)
    best = counts.where(F.col("bad") >= min_support).withColumn("lift", lift).where("lift >= 3").orderBy(F.desc("lift"), "feature").limit(max_features)
    return [r.feature for r in best.collect()]


def _presence(sample: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label and number of features of each sampled text, and the features of one after the other; bounded by the sample.

    One job; what it brings are packed arrays, a row per task.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(shared.value)
        labels, sets = [], []
        for batch in batches:
            sets += [np.array(sorted(found.of(t or "")), np.int32) for t in batch.column("text").to_pylist()]
            labels.append(batch.column("label").to_numpy().astype(np.int8))
        if sets:
            packed = np.concatenate(labels), np.array([len(s) for s in sets], np.int32), np.concatenate(sets)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=["labels", "sizes", "found"])

    rows = sample.select("label", "text").mapInArrow(run, "labels binary, sizes binary, found binary").collect()
    return tuple(np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind) for c, kind in (("labels", np.int8), ("sizes", np.int32), ("found", np.int32)))


def _fit(labels: np.ndarray, sizes: np.ndarray, found: np.ndarray, n: int, penalty: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on feature presence with an L2 penalty: steps per weight, shortened by the gradients seen so far."""
    y = labels.astype(np.float64)
    owner, column = np.repeat(np.arange(len(y)), sizes), found.astype(np.int64)
    w, bias = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    g2, gb2 = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, w[column], len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad, grad_b = np.bincount(column, error[owner], n) + penalty * w, error.sum()
        g2, gb2 = g2 + grad**2, gb2 + grad_b**2
        w, bias = w - 0.5 * grad / np.sqrt(g2), bias - 0.5 * grad_b / np.sqrt(gb2)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, min_support: int = MIN_SUPPORT) -> ToxicityModel:
    """Model from ``docs(id, text)`` and ``labels(id, label)``.

    The character model counts every text. The classifier is fitted on at most ``max_labelled`` labelled rows, chosen by
    hash of their id, and has at most ``max_features`` features, those that part their labels best, each of at least
    ``min_support`` toxic texts: parameters that bound the model, not the texts it scores.
    """
    language = language_model(trigram_counts(docs))
    chosen = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    chosen = materialize(chosen.withColumnRenamed("id", "l_id"), "toxicity-labels")
    sample = docs.join(F.broadcast(chosen), docs["id"] == chosen["l_id"]).select("label", "text")  # bounded by max_labelled
    sample = materialize(sample.repartition(partitions_for(docs.sparkSession)), "toxicity-sample")
    names = _lifted(sample, language, max_features, min_support)
    model = ToxicityModel(language, {f: i for i, f in enumerate(names)})
    weights, bias = _fit(*_presence(sample, model), len(names))
    release(sample), release(chosen)
    return ToxicityModel(language, model.features, weights, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(id, score)`` for every row of ``docs(id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(shared.value)
        weights, bias = shared.value.weights, shared.value.bias
        for batch in batches:
            for part in text_slices(batch, "text"):
                logits = np.array([bias + weights[sorted(found.of(t or ""))].sum() for t in part.column("text").to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.round(1 / (1 + np.exp(-np.clip(logits, -30, 30))), 6))], names=["id", "score"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(id, held_out, score, predicted)`` per row of ``docs``.

    Labels are learnt only from rows whose CRC-32 of the id as text is not a multiple of five; the score reads the
    text alone. Null and empty texts get the score of a text without features. A row with a null id is scored and
    not held out; a label counts once per id (the larger of several) and null labels do not count; repeated rows get
    equal scores; an empty table gives an empty result; other columns are not read. Texts are read whole and in time linear
    in their length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(HELD_OUT_FOLD))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(fold != 0)
    scored = score(rows, train(rows, marks, max_labelled))
    return scored.select("id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
