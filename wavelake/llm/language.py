"""Language identification: known words first, then ever shorter character n-grams.

A word that the model knows scores the log of its smoothed relative frequency in each language.  Any other word, between marks
for its start and end, is scored by the mean over its 5-grams that the model knows; if it knows none, by its 4-grams, and so on
down to single characters; a word of unknown characters scores nothing.  A document is given to the language with the largest
mean over its words; the score is the softmax of the means times the square root of the number of words scored (64 at most).

The model is learned from a sample of labelled rows whose different texts have MOST_BYTES bytes together at most, with a part for each
language (chosen by hashes of id and text, so it doesn't depend on files), and keeps every word and n-gram of it; this bound makes it
safe to collect and broadcast.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be learned; a
null id is not held out and not learned from; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

MOST_BYTES = 16_000_000
LONGEST = 5
SMOOTH = 0.5
UNDECIDED = "und"
#: Word scores that a Python worker keeps, and words that it looks up at once.
CACHE = 200_000
#: Letters of the longest word that is kept.
KEPT_LENGTH = 64
STEP = 1 << 16
_PATTERN = re.compile(r"[^\W\d_]+")
_WORD, _WORDS = _PATTERN.findall, _PATTERN.finditer


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Log frequencies, one column for each language: a matrix whose rows are words and n-grams, and the row of each.

    ``words`` and ``grams`` (single characters first) give the counts of each by language: as a dictionary, or names and a matrix.
    """

    def __init__(self, langs: list[str], words, grams: list):
        self.langs = langs
        self._scorer = None
        tables, at = [], 0
        self.index: list[dict[str, int]] = []  # [0]: words, [n]: n-grams
        for table in (words, *grams):
            names, counts = table if isinstance(table, tuple) else (list(table), np.array(list(table.values()), float).reshape(-1, len(langs)))
            self.index.append({k: at + i for i, k in enumerate(names)})
            tables.append(np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (len(counts) + 1))))
            at += len(names)
        self.logs = np.concatenate(tables) if langs else np.zeros((0, 0))

    def rows(self, word: str) -> list[int]:
        """Rows whose mean is the score of a lower-case word: its own, or those of its longest known n-grams; none if it says nothing."""
        at = self.index[0].get(word)
        if at is not None:
            return [at]
        marked = f"\x02{word}\x03"
        for n in range(min(LONGEST, len(marked)), 1, -1):
            get = self.index[n].get
            known = [at for i in range(len(marked) - n + 1) if (at := get(marked[i : i + n])) is not None]
            if known:
                return known
        get = self.index[1].get
        return [at for c in word if (at := get(c)) is not None]

    def scorer(self) -> Scorer:
        """A scorer that keeps its words from task to task, and goes when the worker drops the model."""
        self._scorer = self._scorer or Scorer(self)
        return self._scorer

    def score(self, word: str) -> np.ndarray | None:
        rows = self.rows(word)
        return self.logs[rows].mean(axis=0) if rows else None


class Scorer:
    """Applies a model to texts; keeps the scores of at most about CACHE words, whether they say something or not."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.cache, self.long = model, cache, []
        self._empty()

    def _empty(self) -> None:
        # row 0: not a word (no letter); row 1: a word that says nothing
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))
        self.n = 2

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        self.long = [w for w in new if len(w) > KEPT_LENGTH]
        if len(self.index) + len(new) > self.cache:
            self._empty()
            new = words
        rows, size, heard = [], [], []
        for w in new:
            known = self.model.rows(w) if any(map(str.isalpha, w)) else None
            if known:
                rows += known
                size.append(len(known))
                heard.append(w)
            else:
                self.index[w] = 0 if known is None else 1
        if not heard:
            return
        at = np.cumsum(size) - size
        scores = np.add.reduceat(self.model.logs[rows], at, axis=0) / np.array(size)[:, None]
        while self.n + len(heard) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n : self.n + len(heard)] = scores
        self.index.update(zip(heard, range(self.n, self.n + len(heard)), strict=True))
        self.n += len(heard)

    def _forget(self) -> None:
        for w in self.long:
            self.index.pop(w, None)
        self.long = []

    def sums(self, text: str) -> tuple[bool, int, np.ndarray]:
        """Whether a text has a letter, how many of its words say something, and the sum of their scores."""
        some, used, total = False, 0, np.zeros(len(self.model.langs))
        text = text.lower()
        found = iter(_WORD(text)) if len(text) < 1 << 20 else (m.group() for m in _WORDS(text))
        while words := list(islice(found, STEP)):
            self._learn(set(words))
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            self._forget()
            some = some or bool((at > 0).any())
            used += int((at > 1).sum())
            total += self.table[at].sum(axis=0)
        return some, used, total

    def __call__(self, texts: list) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            some, used, total = self.sums(t) if t and self.model.langs else (False, 0, None)
            if not some:
                langs.append(UNDECIDED)
                scores.append(0.0)
                continue
            mean = total / max(used, 1)
            e = np.exp((mean - mean.max()) * np.sqrt(min(max(used, 1), 64)))
            best = int(np.argmax(mean))
            langs.append(self.model.langs[best])
            scores.append(float(e[best] / e.sum()))
        return langs, scores


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Bytes of each language: all it has if that is less than an equal part of what is left, else that part."""
    out, left = {}, most
    for k, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(size, left // (len(sizes) - k))
        left -= out[lang]
    return out


def bounded_sample(rows: DataFrame, most_bytes: int) -> DataFrame:
    """(lang, text, copies) of rows (lang, id, text): different rows whose texts have ``most_bytes`` bytes together at most, dealt to the
    languages by ``shares``; in each language those of the least hashes of id and text.

    A row that repeats counts as one, with its copies beside it, so no id or text can fill the sample; a text longer than its
    language's equal part is passed over.  Ids, hashes and sizes are staged, texts are read again for the sample alone.
    """
    rows = rows.withColumn("h", F.xxhash64(F.col("id"), F.col("text").isNull(), F.col("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keys = C.stage(rows.groupBy("lang", "h").agg(F.max(size).alias("b"), F.count(F.lit(1)).alias("copies")), "lang-keys")
    langs = keys.select("lang").distinct().count()
    keys = keys.where(F.col("b") <= most_bytes // max(langs, 1))
    sizes = {r.lang: r.b for r in keys.groupBy("lang").agg(F.sum("b").alias("b")).collect()}  # a row for each language
    # twice the share at most is looked at in order; hashes are even over their range
    part = [(lang, share, int(min(1.0, 2 * share / sizes[lang] if sizes[lang] else 1.0) * (1 << 63))) for lang, share in shares(sizes, most_bytes).items()]
    part = F.broadcast(keys.sparkSession.createDataFrame([(a, b, min(c, (1 << 63) - 1)) for a, b, c in part], "lang string, share long, top long"))
    low = F.col("h").bitwiseAND((1 << 63) - 1) <= F.col("top")
    run = W.partitionBy("lang").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    picked = keys.join(part, "lang").where(low).withColumn("run", F.sum("b").over(run)).where("run <= share").select("lang", "h", "copies")
    near = rows.join(part, "lang").where(low).select("lang", "h", "text")
    return near.join(C.stage(picked, "lang-picked"), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"), F.first("copies").alias("copies")).select("lang", "text", "copies")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bytes: int = MOST_BYTES) -> Model:
    """Counts words and n-grams of the sampled labelled rows that are not held out; every one that occurs is in the model."""
    import pandas as pd
    import pyarrow as pa

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = bounded_sample(rows, most_bytes)

    def count(batches):
        for batch in C.sliced(batches, 4096):
            by: dict[str, Counter] = {}
            for lang, text, copies in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                c = by.setdefault(lang, Counter())
                for word, n in Counter(_WORD(text.lower()) if text else []).items():
                    c[word] += n * copies
            for lang, c in by.items():
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = C.stage(counts, "lang-words")
    # n-grams weigh by word types, a word of n occurrences 1 + ln n, in whole millionths: sums do not depend on their order
    marked = F.concat(F.lit("\x02"), F.col("word"), F.lit("\x03"))
    weight = F.round((1 + F.ln("n")) * 1e6).cast("long")
    cut = lambda word, k: f"transform(sequence(1, greatest(char_length({word}) - {k - 1}, 1)), i -> struct({k} AS k, substring({word}, i, {k}) AS word))"
    pieces = F.expr(f"filter(concat({cut('word', 1)}, {', '.join(cut('m', k) for k in range(2, LONGEST + 1))}), g -> char_length(g.word) = g.k)")
    grams = counts.select("lang", marked.alias("m"), "word", weight.alias("n")).select("lang", "n", F.explode(pieces).alias("g"))
    grams = grams.groupBy("lang", "g").agg(F.sum("n").alias("n")).select("lang", F.col("g.k").alias("k"), F.col("g.word").alias("word"), "n")
    # no more than a bounded sample holds
    held = counts.select("lang", F.lit(0).alias("k"), "word", "n").union(grams).toArrow().to_pandas()
    column, langs = pd.factorize(held["lang"], sort=True)
    tables = []
    for k in range(LONGEST + 1):
        of = (held["k"] == k).to_numpy()
        row, names = pd.factorize(held["word"][of], sort=True)
        m = np.zeros((len(names), len(langs)))
        m[row, column[of]] = held["n"][of] / (1e6 if k else 1)
        tables.append((list(names), m))
    return Model(list(langs), tables[0], tables[1:])


def identify(df: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``df`` with the language and the score, called ``names`` (in place of columns so called); reads nothing but the text."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructType

    C.text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    held = [c for c in df.columns if c not in names]
    schema = StructType([df.schema[c] for c in held]).add(names[0], StringType()).add(names[1], DoubleType())

    def op(batches):
        scorer = shared.value.scorer()
        for batch in C.sliced(batches):
            langs, scores = scorer(batch.column(batch.num_columns - 1).to_pylist())
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*held, *names])

    return df.select(*held, F.col(text_col).cast("string").alias("__wl_in")).mapInArrow(op, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """Rows (all columns) whose text has a language; rejected: no text, no letter, or a score below ``least_score``."""
    found = identify(docs, learn(docs), names=("__wl_lang", "__wl_score"))
    return found.where((F.col("__wl_lang") != UNDECIDED) & (F.col("__wl_score") >= least_score)).select(*docs.columns)
