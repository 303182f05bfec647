"""Language identification: script ranges, per-word scores and Viterbi spans.

A word's script (from the range of its first letter) leaves only the languages that were seen to write it. Every candidate scores the
word by its hashed character n-grams under a smoothed model. Viterbi with a penalty for switching then labels the words of a text, so that a
text in several languages becomes spans. The document's language is the one with the most letters in its spans.

The model: letters and n-gram counts of at most about ``docs_per_lang`` documents per language, chosen by a hash of the id
among documents that are labelled and not held out. It has ``buckets`` x languages numbers, which bounds what is shipped to tasks.

Defined results. Null text, or text without letters: ``und``, score 0, no spans. A script that no learned language writes leaves all languages as
candidates. Ties go to the language first in alphabetical order. Without any labelled document everything is ``und``. Repeated rows are labelled
alike; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First code points of the letter ranges of scripts (Unicode blocks), in order.
SCRIPT_STARTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "african"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
HELD_FOLDS = 5
CHARS_AT_ONCE = 4_000_000
SCORES_AT_ONCE = 4_000_000
WORDS_AT_ONCE = 20_000
ROWS_AT_ONCE = 1_000


STARTS = np.array([start for start, _ in SCRIPT_STARTS])
SCRIPT_NUMBER = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script number of each code point."""
    return SCRIPT_NUMBER[np.maximum(np.searchsorted(STARTS, points, side="right") - 1, 0)]


def gram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int):
    """Per n-gram size: the hash bucket of every n-gram of the marked words, and how many each word has; also first letters."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    value = codes.astype(np.uint64)
    rolled = np.zeros(len(codes) + 1, np.uint64)
    out = []
    for n in range(1, max(sizes) + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3) + value[n - 1 :]
        if n not in sizes or not len(rolled):
            continue
        own = rolled[word[: len(rolled)] == word[n - 1 :]] + np.uint64(n)
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(((own >> np.uint64(20)) & np.uint64(buckets - 1), np.maximum(length - n + 1, 0)))
    return out, codes[start + 1]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text leaves no rest on division by HELD_FOLDS."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % HELD_FOLDS == 0


class _Numbers(dict):
    """word -> number; an unknown word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    writes: np.ndarray  # scripts x languages: bool
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    penalty: float = 8.0
    _cache: _Numbers = field(default_factory=_Numbers, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": _Numbers(), "_rows": None}

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood per word and language against the word's best one; languages of other scripts are out."""
        total = np.zeros((len(words), len(self.langs)))
        if not words:
            return total.astype(np.float32)
        grams, firsts = gram_buckets(words, self.sizes, len(self.logp))
        for bucket, count in grams:
            running = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self.logp[bucket.astype(np.int64)], axis=0, dtype=np.float64)])
            ends = np.cumsum(count)
            total += running[ends] - running[ends - count]
        writes = self.writes[scripts_of(firsts)]
        total = np.where(writes | ~writes.any(axis=1, keepdims=True), total, total.min(axis=1, keepdims=True) - 50.0)
        return np.maximum(total - total.max(axis=1, keepdims=True), -30.0).astype(np.float32)

    def indices(self, words: list[str]) -> np.ndarray:
        """Row of every word in ``_rows``; new words get the next numbers and are scored by ``table``."""
        return np.fromiter(map(self._cache.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        """Scores of all words seen so far."""
        done = 0 if self._rows is None else len(self._rows)
        if done < len(self._cache) or self._rows is None:
            new = iter(islice(self._cache, done, None))
            parts = [] if self._rows is None else [self._rows]
            while words := list(islice(new, WORDS_AT_ONCE)):
                parts.append(self.score_words(words))
            self._rows = np.concatenate(parts) if parts else self.score_words([])
        return self._rows

    def forget(self, above: int = 200_000) -> None:
        if len(self._cache) > above:
            self._cache, self._rows = _Numbers(), None

    def _settled(self, at: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Per text the language that no stretch in another one beats by more than half the penalty, or -1.

        A path of k > 1 stretches pays the penalty at least k - 1 times, at least half of it per stretch, so staying is best.
        """
        length = np.fromiter(map(len, at), np.int64, len(at))
        text = np.repeat(np.arange(len(at)), length)
        score = table[np.concatenate(at)].astype(np.float64)
        ends = np.cumsum(length)
        main = np.add.reduceat(score, ends - length, axis=0).argmax(axis=1)
        settled = np.ones(len(at), bool)
        own = score[np.arange(len(score)), main[text]]
        for lang in range(len(self.langs)):
            gain = np.cumsum(score[:, lang] - own)
            before = np.concatenate([[0.0], gain[:-1]])
            drop = 2 * (np.abs(gain).max() + 1.0)  # texts one below the other: the running minimum starts anew in each
            least = np.minimum.accumulate(before - text * drop) + text * drop
            settled &= np.maximum.reduceat(gain - least, ends - length) <= self.penalty / 2
        return np.where(settled, main, -1)

    def label(self, at: list[np.ndarray]) -> list[np.ndarray]:
        """Language number of every word of every text, given the words' rows (at least one each)."""
        table = self.table()
        settled = self._settled(at, table).tolist()
        out = [np.full(len(row), lang) for row, lang in zip(at, settled)]
        order = sorted((i for i in range(len(at)) if settled[i] < 0), key=lambda i: len(at[i]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end - begin) < 512 and (end - begin + 1) * len(at[order[end]]) * len(self.langs) <= SCORES_AT_ONCE:
                end += 1
            group = order[begin:end]
            for i, path in zip(group, self._viterbi([at[i] for i in group], table)):
                out[i] = path
            begin = end
        return out

    def _viterbi(self, at: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
        n, steps, langs = len(at), max(map(len, at)), table.shape[1]
        index = np.full((steps, n), len(table))
        for j, row in enumerate(at):
            index[: len(row), j] = row
        table = np.vstack([table, np.zeros((1, langs), np.float32)])  # padding decides nothing
        gain = np.ascontiguousarray(table[index].transpose(0, 2, 1))
        value, top = np.empty_like(gain), np.empty(n, gain.dtype)
        value[0] = gain[0]
        for t in range(1, steps):
            np.maximum.reduce(value[t - 1], axis=0, out=top)
            top -= self.penalty
            np.maximum(value[t - 1], top, out=value[t])
            value[t] += gain[t]
        best = value.argmax(axis=1)
        stays = value >= value.max(axis=1, keepdims=True) - self.penalty
        path = np.empty((steps, n), np.int64)
        each = np.arange(n)
        now = path[-1] = best[-1]
        for t in range(steps - 1, 0, -1):
            now = path[t - 1] = np.where(stays[t - 1, now, each], now, best[t - 1])
        return [path[: len(row), j] for j, row in enumerate(at)]

    def predict(self, texts: list[str | None], with_spans: bool = False) -> pd.DataFrame:
        """Results for many texts, about CHARS_AT_ONCE characters at a time."""
        size = np.cumsum([len(t) if t else 0 for t in texts]) // CHARS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        parts = [self._predict(texts[a:b], with_spans) for a, b in zip(cuts, cuts[1:]) if b > a]
        return pd.concat(parts, ignore_index=True) if parts else self._predict([], with_spans)

    def _predict(self, texts: list[str | None], with_spans: bool) -> pd.DataFrame:
        self.forget()
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        some = [i for i, words in enumerate(found) if words and self.langs]
        rows = [self.indices(found[i]) for i in some]
        paths = self.label(rows) if some else []
        table = self.table()
        lang, score, spans = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        pieces: list[list[dict]] = [[] for _ in texts]
        for i, row, path in zip(some, rows, paths):
            words = found[i]
            letters = np.fromiter(map(len, words), np.float64, len(words))
            share = np.bincount(path, letters, len(self.langs)) / letters.sum()
            top = int(share.argmax())
            mean = table[row[path == top]].mean(axis=0)
            lead = mean[top] - max(np.delete(mean, top), default=mean[top] - 30.0)
            lang[i] = self.langs[top]
            score[i] = share[top] * (1 - np.exp(-max(float(lead), 0.0)))
            turns = np.flatnonzero(path[1:] != path[:-1]) + 1
            spans[i] = len(turns) + 1
            if with_spans:
                at = [m.span() for m in WORD.finditer(texts[i].lower())]
                for a, b in zip(np.r_[0, turns], np.r_[turns, len(path)]):
                    pieces[i].append({"start": at[a][0], "end": at[b - 1][1], "lang": self.langs[path[a]]})
        out = pd.DataFrame({"lang_pred": lang, "score": score, "n_spans": spans})
        if with_spans:
            out["spans"] = pieces
        return out


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 2000, buckets: int = 1 << 16,
    sizes: tuple[int, ...] = (1, 2, 3, 4), smoothing: float = 0.5, penalty: float = 8.0,
) -> Model:
    """Learn from labelled documents that are not held out."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # one row per language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), sizes, penalty)
    draw = F.xxhash64(F.lit("langid"), F.col(id_col)).bitwiseAND((1 << 30) - 1) / float(1 << 30)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, docs_per_lang / counts[lang]))).otherwise(share)
    words = labelled.where(draw < share).select(
        F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}[\p{L}\p{M}]*)"), 1)).alias("word"),
    )
    words = words.groupBy("lang", "word").count()
    number = {lang: i for i, lang in enumerate(langs)}
    n_langs, n_scripts = len(langs), len(SCRIPTS)

    def count(batches):
        """n-gram and first-letter counts of this task, keyed by place in the two tables."""
        seen = np.zeros(buckets * n_langs + n_scripts * n_langs)
        for frame in batches:
            for lang, part in frame.groupby("lang"):
                grams, firsts = gram_buckets(part["word"].tolist(), sizes, buckets)
                weight, at = part["count"].to_numpy(np.float64), number[lang]
                for bucket, n in grams:
                    seen[: buckets * n_langs] += np.bincount(bucket.astype(np.int64) * n_langs + at, np.repeat(weight, n), buckets * n_langs)
                seen[buckets * n_langs :] += np.bincount(scripts_of(firsts) * n_langs + at, weight, n_scripts * n_langs)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"place": some, "n": seen[some]})

    totals = words.mapInPandas(count, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # (buckets + scripts) x languages
    seen = np.zeros((buckets + n_scripts, n_langs))
    seen.reshape(-1)[totals["place"].to_numpy(np.int64)] = totals["n"].to_numpy(np.float64)
    letters, grams = seen[buckets:], seen[:buckets] + smoothing
    writes = letters / np.maximum(letters.sum(axis=0), 1) > 0.001
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), writes, sizes, penalty)


def identify(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = False, out: str = "language") -> DataFrame:
    """Adds struct column ``out``: lang_pred, score, n_spans and, if asked for, spans (character ranges of the lower-cased text)."""
    shape = "lang_pred string, score double, n_spans int"
    if with_spans:
        shape += ", spans array<struct<start:int,end:int,lang:string>>"

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts.tolist(), with_spans)

    return docs.withColumn(out, run(F.col(text_col)))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language could be told; those without a label get the predicted one."""
    at, label = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lang = pa.array(model.predict(part.column(at).to_pylist())["lang_pred"], pa.string())
                columns = part.columns
                columns[label] = pc.coalesce(columns[label], lang.cast(columns[label].type))
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pc.not_equal(lang, "und"))

    return docs.mapInArrow(run, docs.schema)
