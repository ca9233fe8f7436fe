"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word is read as overlapping
n-grams of its spelling with marked ends: four characters where the model knows them, otherwise three, two, one. A text
gets the language with the largest sum over its words.

The model is fitted on a bounded sample: about ``per_language`` documents of each of the ``LANGUAGES`` most frequent
values of the language column, and keeps the ``words`` and ``grams`` most frequent entries (four numbers each here), so
it has a proven size when it is broadcast. Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LETTERS, Scores, batch, drawn, slices, stage, text_batches

PER_LANGUAGE = 4000  # documents, about
LANGUAGES = 500
WORDS = 100_000
GRAMS = 100_000
LONGEST = 4
ROOM = 1 << 17  # words whose rows a worker remembers
RUN, PIECE = 200, 20  # letters above which a run is cut, and of its pieces
UNKNOWN = "und"
SHARED = 0.05  # weight of an entry's mean frequency over all languages
COUNTED = {"lang": pa.string(), "word": pa.string(), "n": pa.int64()}
SURE = 10  # words that a long text's evidence counts for in its score


def grams(word: str, size: int) -> list[str]:
    marked = f"<{word}>" if size > 1 else word
    return [marked[i : i + size] for i in range(max(1, len(marked) - size + 1))]


def cut(words: list[str]) -> list[str]:
    """``words`` with runs of more than ``RUN`` letters, such as texts without spaces, as overlapping pieces.

    The pieces of a run hold all its n-grams, and each counts as a word, so a run weighs by its length.
    """
    if not any(len(word) > RUN for word in words):
        return words
    step = PIECE + 1 - LONGEST
    return [
        piece for word in words for piece in ([word] if len(word) <= RUN else [word[i : i + PIECE] for i in range(0, len(word) - LONGEST + 1, step)])
    ]


def words_of(text: str) -> list[str]:
    """Words in lower case; none if what looks like words are numbers such as fractions and no letter is among them."""
    words = LETTERS.findall(text.lower())
    return cut(words) if any(map(str.isalpha, words)) or any(map(str.isalpha, text)) else []


class Rates(Mapping):
    """Log frequencies per language of entries, as rows of one matrix: a worker's copy needs no array for each entry."""

    def __init__(self, entries: Iterable[str], logs: np.ndarray):
        self.places, self.logs = {entry: at for at, entry in enumerate(entries)}, logs

    def get(self, entry: str, default: np.ndarray | None = None) -> np.ndarray | None:
        at = self.places.get(entry)
        return default if at is None else self.logs[at]

    def __getitem__(self, entry: str) -> np.ndarray:
        return self.logs[self.places[entry]]

    def __iter__(self) -> Iterator[str]:
        return iter(self.places)

    def __len__(self) -> int:
        return len(self.places)


class Model:
    """Log frequencies per language of words and of n-grams by size."""

    def __init__(self, languages: list[str], words: Rates, pieces: list[Rates]):
        self.languages, self.words, self.pieces = languages, words, pieces

    def piece(self, gram: str) -> np.ndarray:
        """Log frequency of an n-gram, or the mean of its two shorter ones where it is unknown."""
        found = self.pieces[len(gram) - 1].get(gram)
        if found is not None:
            return found
        if len(gram) == 1:
            return np.zeros(len(self.languages))
        return (self.piece(gram[:-1]) + self.piece(gram[1:])) / 2

    def word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return found
        return np.mean([self.piece(g) for g in grams(word, LONGEST)], axis=0)

    def scorer(self) -> Scores:
        if not hasattr(self, "kept"):
            self.kept = Scores(len(self.languages), self.word, ROOM)
        return self.kept

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text. No letter: ``und`` and 0. Equal sums: the language that sorts first."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(words) for words in split])
        if not self.languages or not sizes.sum():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = self.scorer().of(list(chain.from_iterable(split)))
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        mean = np.add.reduceat(rows, starts, axis=0) / sizes[some][:, None]
        best = mean.argmax(axis=1)
        evidence = (mean - mean.max(axis=1, keepdims=True)) * np.minimum(sizes[some], SURE)[:, None]
        sure = 1 / np.exp(evidence).sum(axis=1)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for at, which, score in zip(some.tolist(), best.tolist(), sure.tolist()):
            names[at], scores[at] = self.languages[which], score
        return names, scores


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled texts (lang, text), counted batch by batch."""
    for rows in batches:
        found: Counter = Counter()
        langs = rows.column(0).to_pylist()
        at = 0
        for part in slices(rows.column(1)):
            for text in part:
                lang, at = langs[at], at + 1
                for word, n in Counter(cut(LETTERS.findall(text.lower()))).items():
                    found[lang, word] += n
        yield batch(COUNTED, ([lang for lang, _ in found], [entry for _, entry in found], list(found.values())))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of counted words (lang, word, n)."""
    for rows in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(rows.column(i).to_pylist() for i in range(3))):
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    found[lang, gram] += n
        yield batch(COUNTED, ([lang for lang, _ in found], [entry for _, entry in found], list(found.values())))


def smoothed(rows, languages: list[str]) -> Rates:
    """Log frequency per language of every counted entry, mixed with a little of its mean over all languages.

    So what a language never showed is as unlikely in a small sample as in a large one.
    """
    places = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(rows), len(languages)))
    for at, (_, by_lang) in enumerate(rows):
        for lang, n in by_lang.items():
            counts[at, places[lang]] = n
    rates = counts / np.maximum(counts.sum(axis=0), 1)
    logs = np.log((1 - SHARED) * rates + SHARED * rates.mean(axis=1, keepdims=True))
    return Rates((entry for entry, _ in rows), logs)


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    words: int = WORDS,
    grams: int = GRAMS,
) -> Model:
    """A model from the rows of ``labelled`` with a language; none or an empty table gives a model that knows nothing."""
    read = labelled.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")
    ).where("lang is not null")
    text_batches(labelled.sparkSession)
    sizes = read.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        nothing = Rates([], np.zeros((0, 0)))
        return Model([], nothing, [nothing] * LONGEST)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))))
    # Rows without an id are drawn by their text.
    key = F.coalesce(F.col("id").cast("string"), F.col("text"))
    sample = read.where(drawn(key, F.coalesce(share[F.col("lang")], F.lit(0.0)))).select("lang", "text")
    counted = sample.mapInArrow(counts_of, "lang string, word string, n long")
    counted = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")

    def top(rows: DataFrame, most: int):
        by = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
        by_entry = rows.groupBy("word").agg(F.sum("n").alias("n"), by)
        return [(r["word"], r["by"]) for r in by_entry.orderBy(F.desc("n"), "word").limit(most).toLocalIterator()]

    pieces = counted.mapInArrow(gram_counts, counted.schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kept = top(pieces, grams)
    by_size = [smoothed([r for r in kept if len(r[0]) == size], languages) for size in range(1, LONGEST + 1)]
    return Model(languages, smoothed(top(counted, words), languages), by_size)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column (lang string, score double) for ``docs``; see ``Model.predict``. A null text is ``und``."""
    shared = text_batches(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in slices(texts):
            found = shared.value.predict(part)
            langs += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predicted(F.col(text_col))
