"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector of ``DIM`` components, drawn from its
code point alone. A trigram is the bind (componentwise product) of its letters'
vectors, permuted by two, one and no places; a document is the bundle (sum) of
its trigrams, and a language the bundle of its documents, each of length one.
A document gets the language of the largest cosine; ties go to the smaller name.

Letters are lower-cased; marks that combine with letters go with them. Whatever
else is a boundary, which takes part in a trigram at its first or last place only.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text where nothing could be learned. A null doc_id counts as the empty
text in the fold rule, so it is held out. Repeated rows are learned as often as
they occur. Of more than ``MOST_LANGUAGES`` names in ``lang`` the most frequent are
learned, the smaller in a tie. Very long texts are bundled in blocks of whole texts,
their vectors 2048 trigrams at a time. Extra columns are ignored, and kept by
:func:`keep`. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1024
FOLDS = 5
#: Documents below this cosine are in no known language. On sf0.1 it lies between
#: the scores of documents of ten words or more with their own language
#: (99.8 % are above) and those with the best of the other languages (97.4 to 99.6 %
#: are below).
LEAST_SCORE = 0.3
#: Languages that may be learned; their profiles are sent to the executors.
MOST_LANGUAGES = 10_000
_SCALE = 1 << 20
#: Trigram vectors that a worker keeps, and that it multiplies at once.
_KEPT, WIDE = 30_000, 2048


class Bundler:
    """Bundles of texts; keeps the vectors of letters and trigrams it has met."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters = dim, {}
        self.alpha = np.zeros(0x110000, np.int8)  # 1 for letters, 2 for marks
        self.known = np.zeros(0x110000, bool)
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((_KEPT + WIDE, self.dim), np.int8)  # memory comes as rows are used

    def letter(self, cp: int) -> np.ndarray:
        v = self.letters.get(cp)
        if v is None:
            bits = np.random.Generator(np.random.Philox(key=cp)).integers(0, 2, self.dim, np.int8)
            v = self.letters[cp] = 2 * bits - 1
        return v

    def trigram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(keys) > _KEPT:
            self._reset()
        at = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                self.table[row] = self.trigram(key)
            at[i] = row
        return self.table[at]

    def _letters(self, cp: np.ndarray) -> np.ndarray:
        new = np.unique(cp[~self.known[cp]])
        for x in new.tolist():
            self.alpha[x] = 1 if chr(x).isalpha() else 2 if unicodedata.category(chr(x))[0] == "M" else 0
        self.known[new] = True
        return np.where(self.alpha[cp] > 0, cp, 0).astype(np.int64)

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the text and the key of every trigram."""
        low = [t.lower() for t in texts]
        cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
        text = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        code = self._letters(cp)
        text = np.concatenate([[0], text])
        if (self.alpha[cp] == 2).any():  # marks alone make no text
            spoken = np.bincount(text[self.alpha[cp] == 1], minlength=len(low)) > 0
            code = np.where(spoken[np.minimum(text, len(low) - 1)], code, 0)
        stays = np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])
        code, text = code[stays], text[stays]
        if len(code) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        middle = code[1:-1] != 0
        keys = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[middle]
        return text[1:-1][middle], keys

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One bundle for each text."""
        of, keys = self.trigrams(texts)
        out = np.zeros((len(texts), self.dim), np.float32)
        if len(keys):
            grams, at = _distinct(keys)
            for a in range(0, len(grams), WIDE):
                part = (at >= a) & (at < a + WIDE) if len(grams) > WIDE else slice(None)
                wide = min(WIDE, len(grams) - a)
                counts = np.bincount(of[part] * wide + at[part] - a, minlength=len(texts) * wide).astype(np.float32)
                out += counts.reshape(len(texts), wide) @ self.vectors(grams[a : a + wide]).astype(np.float32)
        return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse; by counting where the alphabet is small."""
    seen, low = np.zeros(1 << 21, bool), (1 << 21) - 1
    seen[keys >> 42] = seen[keys >> 21 & low] = seen[keys & low] = True
    letters = np.flatnonzero(seen)
    n = len(letters)
    if n > 160:
        return np.unique(keys, return_inverse=True)
    place = np.zeros(1 << 21, np.int32)
    place[letters] = np.arange(n, dtype=np.int32)
    ids = place[keys >> 42]
    for part in (keys >> 21 & low, keys & low):
        ids *= n
        ids += place[part]
    met = np.zeros(n**3, bool)
    met[ids] = True
    there = np.flatnonzero(met)
    back = np.zeros(n**3, np.int32)
    back[there] = np.arange(len(there), dtype=np.int32)
    return letters[there // (n * n)] << 42 | letters[there // n % n] << 21 | letters[there % n], back[ids]


_own: dict[int, Bundler] = {}
common.keeps(__name__, _own.clear)


def bundler(dim: int = DIM) -> Bundler:
    return _own.setdefault(dim, Bundler(dim))


def bundles(texts: list[str], dim: int = DIM) -> np.ndarray:
    tool, out = bundler(dim), np.empty((len(texts), dim), np.float32)
    for a, b in common.blocks([len(t) for t in texts], 1 << 18):
        out[a:b] = tool.bundle(texts[a:b])
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def learn(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """The names and the profiles of the languages of the learning folds."""
    common.bound_batches(docs.sparkSession)

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            d = bundles(common.texts_of(batch), dim).astype(np.float64)
            size = np.linalg.norm(d, axis=1, keepdims=True)
            d = np.rint(d / np.maximum(size, 1) * _SCALE).astype(np.int64)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + d[langs == lang].sum(0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], names=["lang", "place", "total"])

    taught = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    if taught.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        most = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
        taught = taught.join(most.select("lang"), "lang", "left_semi").select("text", "lang")
    cells = taught.mapInArrow(common.lean(bundled), "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    # a row of ``dim`` floats for each language
    whole = F.transform(F.sort_array(F.collect_list(F.struct("place", "total"))), lambda c: c["total"].cast("float"))
    got = cells.groupBy("lang").agg(whole.alias("profile")).toArrow()
    names = got.column("lang").to_pylist()
    profiles = got.column("profile").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(names), dim)
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], profiles[order]


def predict(texts: list[str], names: list[str], profiles: np.ndarray) -> tuple[list[str], np.ndarray]:
    d = bundles(texts, profiles.shape[1]).astype(np.float64)
    size = np.linalg.norm(d, axis=1)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    near = d @ (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-30)).T / np.maximum(size, 1e-300)[:, None]
    best = near.argmax(1)
    found = size > 0
    score = np.where(found, np.clip(near[np.arange(len(texts)), best], 0, 1), 0.0)
    return [names[i] if ok else "und" for i, ok in zip(best.tolist(), found.tolist())], score


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) by document."""
    names, profiles = learn(docs)
    sent = docs.sparkSession.sparkContext.broadcast((names, profiles))

    def found(batches):
        for batch in batches:
            lang, score = predict(common.texts_of(batch), *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return chosen.mapInArrow(common.lean(found), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language, with their own columns; all
    rows where no language could be learned."""
    names, profiles = learn(docs)
    if not names:
        return docs
    sent, text = docs.sparkSession.sparkContext.broadcast((names, profiles)), docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            lang, score = predict([t or "" for t in batch.column(text).to_pylist()], *sent.value)
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist())], pa.bool_()))

    return docs.mapInArrow(common.lean(kept), docs.schema)
