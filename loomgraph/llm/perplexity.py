"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

The model is over characters (UTF-16 units, so every character counts exactly),
of order 5, one for each language and half of the texts. Spark counts every
5-gram of every text that is fit to teach (:func:`teaches`; equal texts once);
lower orders use Kneser-Ney continuation counts, which follow from the distinct
grams of the next order, and every model has discounts of its own. A text is
scored by the model of the half that it is not in, so neither it nor its exact
copies foretell it.

The model is a table of sorted hash arrays and grows with the corpus: grams and
contexts are kept by 64-bit hashes, none is folded into a smaller space or left
out. The table is dealt into parts by the last two characters of the context, so
that all orders above two of an event are in one part; orders one and two are in
each. Parts hold about :data:`PART` entries (20 bytes each) whatever the size of
the corpus; they reach the driver and the executors one by one, and a task
scores its texts under part after part and adds up. Searches are binary, once
for each distinct gram of a block of texts.

A document is rejected if the logarithm of its perplexity is below the lower or
above the upper bound of its language. Bounds are the median of the texts that
teach less and plus :data:`LOWER` and :data:`UPPER` robust deviations, from an
exact histogram in which copies count once. Short texts vary more, so deviations
are measured, and bounds widened, by the square root of ``1 + SHORT / n_chars``.
Fewer than ``FEW`` such texts give no bounds; of texts that all score alike the
deviation counts as ``LEAST_SPREAD``.

Defined cases: a null text is empty, has no words and fails the base rules. A
null or malformed language is ``und`` and has a model and bounds of its own. A
language without bounds rejects nothing. Repeated rows each get a row; ties of
score are judged alike. Of texts of equal content that with the smallest doc_id
teaches. Very long texts are scored in blocks of whole texts, in memory in
proportion to one text. Extra columns, whatever their names, are ignored by
:func:`judge` and returned by :func:`keep`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Robust deviations below and above the median that a text may have. On sf0.1 98 %
#: of the texts of low quality that pass the base rules are more than 25 above, and
#: 99.7 % of those of good quality less than 16.
LOWER, UPPER = 12.0, 16.0
#: Texts that bounds need, and the deviation of texts that all score alike.
FEW, LEAST_SPREAD = 20, 0.05
#: Characters under which the bounds of a text are widened.
SHORT = 400
#: Bins of the histogram of log-perplexities, for each unit.
BINS = 4096
#: Entries of a part of the model, parts that a worker keeps, characters that it
#: scores under part after part.
PART, KEPT, HELD = 1 << 19, 1, 1 << 20
#: Unicode's noncharacters, which stand for the begin and the end of a text.
BEGIN, END = "\uffff", "\ufffe"
_AGAIN = str.maketrans({BEGIN: "\ufffd", END: "\ufffd"})
#: Bytes of UTF-8 that count as letters: A-Z first, then a-z and all beyond ASCII.
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_MIX, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_CONTEXT = np.uint64(0x1FFFF)
_GRAMS = "lang string, half int, context long, w int, n long"
_ENTRIES = "part int, kind int, key long, a float, b float"


# -- base rules ---------------------------------------------------------------


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()  # on the six ASCII white-space bytes, and no others
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>")) if n else 0
    lines = raw.split(b"\n")
    repeated_lines = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                repeated_lines += bool(line.split())
            else:
                seen.add(line)
    return n, chars, symbols, repeated_lines, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five which the text has twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    ids: dict[tuple, int] = {}
    of = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n)
    hit = np.bincount(of)[of] > 1
    covered = np.zeros(n + 4, bool)
    for k in range(5):
        covered[k : k + n] |= hit
    return int(covered.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def teaches(text: str, counts: tuple[int, int, int, int, int]) -> bool:
    """Whether a text is fit for the model to learn from: it passes the base rules
    and common rules for prose (few symbols, words that have letters, no text all
    in capitals, few repeated lines)."""
    n, chars, symbols, repeated_lines, repeated = counts
    if base_failed(n, repeated) or 10 * symbols > n or 3 * repeated_lines > text.count("\n") + 1:
        return False
    raw = text.encode()
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(raw) - len(raw.translate(None, _LETTERS[:26]))
    return 10 * letters >= 7 * len(raw.translate(None, b" \t\n\v\f\r")) and 10 * capitals <= 3 * letters


# -- grams --------------------------------------------------------------------


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-16 units of all texts, each after four BEGIN and before one END; the
    places of those to be foretold; and where those of each text begin."""
    pad = BEGIN * (ORDER - 1)
    plain = [t.translate(_AGAIN) if not t.isascii() and (BEGIN in t or END in t) else t for t in texts]
    unit = np.frombuffer("".join([f"{pad}{t}{END}" for t in plain]).encode("utf-16-le"), np.uint16)
    sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-16-le")) // 2 for t in plain), np.int64, len(plain)) + ORDER
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    wanted = np.ones(len(unit), bool)
    for k in range(ORDER - 1):
        wanted[starts + k] = False
    return unit, wanted, np.concatenate([[0], np.cumsum(sizes - (ORDER - 1))[:-1]]).astype(np.int64)


def events(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every character of every text and its end, as (context, w) of four units
    and one, and where those of each text begin."""
    unit, wanted, starts = units(texts)
    unit = unit.astype(np.uint64)
    context = np.zeros(len(unit), np.uint64)
    for k in range(1, ORDER):
        context[k:] |= unit[:-k] << np.uint64(16 * (k - 1))
    return context[wanted], unit[wanted], starts


def seed_of(lang: str, half: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{lang}/{half}".encode(), digest_size=8).digest(), "little"))


def hashed(context: np.ndarray, w, seed, order) -> np.ndarray:
    """64-bit hashes of grams; of contexts where w is ``_CONTEXT``."""
    with np.errstate(over="ignore"):
        h = (context ^ seed) * _MIX
        h = ((h ^ (h >> np.uint64(29))) + w * _MIX2 + np.uint64(order)) * _MIX3
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(31))


def suffix(context: np.ndarray, order: int) -> np.ndarray:
    """What a gram of ``order`` keeps of the context of a longer one."""
    return context & np.uint64((1 << 16 * (order - 1)) - 1)


def part_of(context: np.ndarray, seed, parts: int) -> np.ndarray:
    """The part of the model that has the orders above two."""
    return (hashed(suffix(context, 3), _CONTEXT, seed, 99) % np.uint64(parts)).astype(np.int64)


def half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


class Counter:
    """Counts of 5-grams. Up to 4096 different units have numbers of 12 bits, so that
    a 5-gram is one number, which sorting counts; blocks with more units than that
    are counted by hashes."""

    def __init__(self):
        self.number = np.full(1 << 16, -1, np.int64)
        self.unit: list[int] = []
        self.held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows = 0

    def add(self, key: tuple[str, int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        unit, wanted, _ = units(texts)
        here = np.flatnonzero(np.bincount(unit, minlength=1 << 16))
        new = here[self.number[here] < 0]
        if len(here) > 4096:
            context, w, _ = events(texts)
            h = hashed(context, w, np.uint64(0), ORDER)
            order = np.argsort(h)
            first, n = _runs(h[order])
            yield from _rows(key, context[order[first]], w[order[first]], n)
            return
        if len(self.unit) + len(new) > 4096:
            yield from self.rest()
            new = here
        self.number[new] = np.arange(len(self.unit), len(self.unit) + len(new))
        self.unit += new.tolist()
        code = self.number[unit]
        keys = code.copy()
        for k in range(1, ORDER):
            keys[k:] |= code[:-k] << (12 * k)
        keys = np.sort(keys[wanted])
        first, n = _runs(keys)
        parts = self.held.setdefault(key, [])
        parts.append((keys[first], n))
        self.rows += len(first)
        if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > max(1 << 20, len(parts[0][0])):
            self.rows -= sum(len(p[0]) for p in parts)
            self.held[key] = [self._merged(parts)]
            self.rows += len(self.held[key][0][0])
        if self.rows > 1 << 21:  # bounded, whatever the alphabet
            yield from self.rest()

    @staticmethod
    def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys = keys[order]
        first, _ = _runs(keys)
        return keys[first], np.add.reduceat(n[order], first) if len(first) else n

    def rest(self) -> Iterator[pa.RecordBatch]:
        unit = np.array(self.unit, np.uint64)
        for key, parts in self.held.items():
            keys, n = self._merged(parts)
            context = np.zeros(len(keys), np.uint64)
            for k in range(1, ORDER):
                context |= unit[keys >> (12 * k) & 4095] << np.uint64(16 * (k - 1))
            yield from _rows(key, context, unit[keys & 4095], n)
        self.number[:] = -1
        self.unit, self.held, self.rows = [], {}, 0


def _rows(key: tuple[str, int], context: np.ndarray, w: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(n), 1 << 18):
        c = context[a : a + (1 << 18)].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(c)), pa.array(np.full(len(c), key[1], np.int32)), pa.array(c), pa.array(w[a : a + (1 << 18)].astype(np.int32)), pa.array(n[a : a + (1 << 18)].astype(np.int64))],
            names=["lang", "half", "context", "w", "n"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        of: dict[tuple[str, int], list[str]] = {}
        for t, lang, h in zip(common.texts_of(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if teaches(t, base_counts(t)):
                of.setdefault((lang, h), []).append(t)
        for key, own in of.items():
            for a, b in common.blocks([len(t) for t in own], 1 << 20):
                yield from counter.add(key, own[a:b])
    yield from counter.rest()


# -- the model ----------------------------------------------------------------


@dataclass
class Part:
    """Sorted hash arrays: of grams the discounted counts, of contexts the total
    count and the weight of the next lower order."""

    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray, np.ndarray]

    def log_prob(self, context: np.ndarray, w: np.ndarray, seed, symbols: int) -> np.ndarray:
        p = np.full(len(w), 1.0 / symbols)
        keys, d = self.grams
        c_keys, total, weight = self.contexts
        for o in range(1, ORDER + 1):
            c = suffix(context, o)
            i, there = _search(c_keys, hashed(c, _CONTEXT, seed, o))
            if not there.any():
                continue
            j, seen = _search(keys, hashed(c[there], w[there], seed, o))
            lower = np.where(there, weight[i], 1.0) * p
            lower[there] += np.where(seen, d[j], 0.0) / total[i[there]]
            p = lower
        return np.log(np.maximum(p, 1e-12))


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


@dataclass
class Model:
    """Parts as broadcasts, and the number of symbols of each (language, half)."""

    parts: list
    symbols: dict[tuple[str, int], int]

    def log_prob(self, context: np.ndarray, w: np.ndarray, lang: str, half_: int) -> np.ndarray:
        return _scored([(context, w, lang, half_)], self)[0]


def _scored(asked: list[tuple], model: Model) -> list[np.ndarray]:
    """Log-probabilities of several lots of events (context, w, lang, half) under
    the models named: each part of the model is read once."""
    out = [np.zeros(len(w)) for _, w, _, _ in asked]
    which = [part_of(c, seed_of(lang, h), len(model.parts)) for c, _, lang, h in asked]
    for k, sent in enumerate(model.parts):
        mine = [np.flatnonzero(at == k) for at in which]
        if not any(map(len, mine)):
            continue
        part = sent.value
        for (context, w, lang, h), lp, at in zip(asked, out, mine):
            lp[at] = part.log_prob(context[at], w[at], seed_of(lang, h), model.symbols.get((lang, h), 0) + 1)
        if len(model.parts) > KEPT and hasattr(sent, "_value") and hasattr(sent, "_path"):
            del part, sent._value  # read again from the executor's disk for the next texts
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, half, context, w, n) over the whole texts that teach, equal ones once."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select("text", common.language(F.col("lang")).alias("lang"), F.xxhash64("text").alias("of"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"))
    copies = common.stash(rows.groupBy("of").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1").select("of", "first"))
    once = rows.join(copies, "of", "left").filter("first is null or first = doc_id")
    found = once.select("text", "lang", F.pmod("of", F.lit(2)).cast("int").alias("half")).mapInArrow(common.lean(_count), _GRAMS)
    return found.groupBy("lang", "half", "context", "w").agg(F.sum("n").alias("n"))


def levels(docs: DataFrame) -> DataFrame:
    """(o, lang, half, context, w, n): the counts of all orders."""
    level = common.cut(gram_counts(docs))
    every = level.select(F.lit(ORDER).alias("o"), "*")
    for o in range(ORDER - 1, 0, -1):
        mask = (1 << 16 * (o - 1)) - 1
        level = level.groupBy("lang", "half", F.col("context").bitwiseAND(F.lit(mask)).alias("context"), "w").agg(F.count(F.lit(1)).alias("n"))
        every = every.unionByName(level.select(F.lit(o).alias("o"), "*"))
    return every


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, each kept within (0, count)."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.9), min(max(d3, 0.05), 2.9)


def fit(docs: DataFrame) -> Model:
    """Count all documents, and build and send the parts of the model."""
    spark = docs.sparkSession
    every = common.cut(levels(docs))
    # at most 18253 languages (common.language), two halves and five orders
    told = every.groupBy("lang", "half", "o").agg(F.count(F.lit(1)).alias("grams"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
    parts = max(1, -(-13 * sum(r["grams"] for r in told) // (10 * PART)))  # three contexts to ten grams
    cut_of = {(r["lang"], r["half"], r["o"]): discounts(*(r[f"n{k}"] for k in (1, 2, 3, 4))) for r in told}
    rows = [(*key, *d) for key, d in cut_of.items()]
    minus = spark.createDataFrame(rows, "lang string, half int, o int, d1 double, d2 double, d3 double")
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = every.join(F.broadcast(minus), ["lang", "half", "o"]).withColumn("taken", taken)
    key = ["o", "lang", "half", "context"]
    of_grams = grams.select(*key, F.lit(0).alias("kind"), "w", (F.col("n") - F.col("taken")).alias("a"), F.lit(0.0).alias("b"))
    of_contexts = grams.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.col("taken").cast("decimal(28,9)")).alias("taken"))
    of_contexts = of_contexts.select(*key, F.lit(1).alias("kind"), F.lit(0).alias("w"), F.col("n").cast("double").alias("a"), (F.col("taken") / F.col("n")).cast("double").alias("b"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, h, context, kind, w, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4, 5, 6, 7))
            langs = np.array(batch.column(1).to_pylist(), object)
            context, w = context.astype(np.int64).view(np.uint64), np.where(kind == 1, _CONTEXT, w.astype(np.uint64))
            for order, lang, half_ in {(int(x), y, int(z)) for x, y, z in zip(o, langs, h)}:
                mine = np.flatnonzero((o == order) & (langs == lang) & (h == half_))
                seed = seed_of(lang, half_)
                keys = hashed(context[mine], w[mine], seed, order)
                where = [part_of(context[mine], seed, parts)] if order > 2 else [np.full(len(mine), k) for k in range(parts)]
                for at in where:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at.astype(np.int32)), pa.array(kind[mine].astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(a[mine].astype(np.float32)), pa.array(b[mine].astype(np.float32))],
                        names=["part", "kind", "key", "a", "b"],
                    )

    def packed(key_, rows):
        kind, keys, a, b = (rows.column(c).to_numpy() for c in ("kind", "key", "a", "b"))
        keys = keys.view(np.uint64)
        out = {"part": pa.array([key_[0].as_py()], pa.int32())}
        for k, names in ((0, ("g", "d")), (1, ("c", "total", "weight"))):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(keys[mine])]
            for name, values in zip(names, (keys, a, b)):
                out[name] = pa.array([values[mine].tobytes()], pa.binary())
        return pa.table(out)

    dealt = of_grams.unionByName(of_contexts).mapInArrow(common.lean(entries), _ENTRIES).repartition(parts, "part")
    table = common.cut(dealt.groupBy("part").applyInArrow(packed, "part int, g binary, d binary, c binary, total binary, weight binary"))
    sent = [None] * parts
    for r in table.toLocalIterator():  # one part at a time
        part = Part((np.frombuffer(r["g"], np.uint64), np.frombuffer(r["d"], np.float32)), (np.frombuffer(r["c"], np.uint64), np.frombuffer(r["total"], np.float32), np.frombuffer(r["weight"], np.float32)))
        sent[r["part"]] = spark.sparkContext.broadcast(part)
    none = Part((np.empty(0, np.uint64), np.empty(0, np.float32)), (np.empty(0, np.uint64), *[np.empty(0, np.float32)] * 2))
    sent = [x or spark.sparkContext.broadcast(none) for x in sent]
    return Model(sent, {(r["lang"], r["half"]): r["grams"] for r in told if r["o"] == 1})


class Known:
    """Log-probabilities that a worker has computed, in a fixed table by the hash of
    (model, gram): what is not or no longer there is computed again."""

    def __init__(self, bits: int = 21):
        self.model, self.mask = lambda: None, np.uint64((1 << bits) - 1)
        self.keys, self.lp = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)

    def of(self, model) -> "Known":
        if self.model() is not model:  # held weakly, so that a worker lets go of old models
            self.model = weakref.ref(model)
            self.keys[:] = 0
        return self


_own: dict[str, Known] = {}
common.keeps(__name__, _own.clear)


def log_perplexities(texts: list[str], langs: list[str], halves: list[int], model: Model) -> np.ndarray:
    """Mean negative log-probability of a character, for each text, under the model
    of the half that the text is not in."""
    known = (_own.get("known") or _own.setdefault("known", Known())).of(model.parts[0])
    out = np.zeros(len(texts))
    for first, last in common.blocks([len(t) for t in texts], HELD):
        lots, places = [], []
        here = range(first, last)
        for lang, h in sorted({(langs[i], halves[i]) for i in here}):
            own = [i for i in here if langs[i] == lang and halves[i] == h]
            for a, b in common.blocks([len(texts[i]) for i in own], 1 << 18):
                context, w, starts = events([texts[i] for i in own[a:b]])
                keys = hashed(context, w, seed_of(lang, 1 - h), ORDER)
                slot = keys & known.mask
                lp = known.lp[slot]
                new = np.flatnonzero(known.keys[slot] != keys)
                keys = keys[new]
                order = np.argsort(keys)
                start, n = _runs(keys[order])
                at = new[order[start]]
                lots.append((context[at], w[at], lang, 1 - h))
                places.append((own[a:b], starts, lp, keys[order[start]], new[order], n))
        for found, (rows, starts, lp, keys, new, n) in zip(_scored(lots, model), places):
            found = found.astype(np.float32)
            lp[new] = np.repeat(found, n)
            slot = keys & known.mask
            known.keys[slot], known.lp[slot] = keys, found
            ends = np.append(starts[1:], len(lp))
            out[rows] = -np.add.reduceat(lp, starts, dtype=np.float64) / (ends - starts)
    return out


# -- verdicts -----------------------------------------------------------------

_SCORES = {"n_chars": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "teaches": pa.bool_(), "log_ppl": pa.float64()}
_SCORE_TYPES = "n_chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, teaches boolean, log_ppl double"


def scores(texts: list[str], langs: list[str], halves: list[int], model: Model) -> list[pa.Array]:
    base = [base_counts(t) for t in texts]
    failed = [base_failed(b[0], b[4]) for b in base]
    good = [teaches(t, b) for t, b in zip(texts, base)]
    lp = log_perplexities(texts, langs, halves, model)
    cols = [[len(t) for t in texts], *(zip(*base) if base else [[]] * 5), failed, good, lp]
    return [pa.array(list(c), kind) for c, kind in zip(cols, _SCORES.values())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, of, n_chars, the base counts, base_failed, teaches, log_ppl) by
    document; ``of`` is the text's hash."""
    common.bound_batches(docs.sparkSession)

    def scored(batches):
        for batch in batches:
            found = scores(common.texts_of(batch), batch.column(2).to_pylist(), batch.column(4).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *found], names=["doc_id", "lang", "of", *_SCORES])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.language(F.col("lang")).alias("lang"), F.xxhash64("text").alias("of"), half(F.col("text")).alias("half"))
    return chosen.mapInArrow(common.lean(scored), f"doc_id long, lang string, of long, {_SCORE_TYPES}")


def breadth(n_chars: Column) -> Column:
    return F.sqrt(1 + F.lit(float(SHORT)) / F.greatest(n_chars, F.lit(1)))


def bands(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """Centre and robust deviation of the log-perplexities of each language's texts
    that teach; (lang, of, n_chars, teaches, log_ppl) is read twice."""
    apart = scored.filter("teaches").select("lang", "of", F.col("log_ppl"), breadth(F.col("n_chars")).alias("_wide")).dropDuplicates(["lang", "of"])
    apart = common.cut(apart)
    centres = _medians(apart.select("lang", F.col("log_ppl").alias("x")))
    few = [(k, c) for k, (c, n) in centres.items() if n >= FEW]
    known = scored.sparkSession.createDataFrame(few, "lang string, centre double")
    off = _medians(apart.join(F.broadcast(known), "lang").select("lang", (F.abs(F.col("log_ppl") - F.col("centre")) / F.col("_wide")).alias("x")))
    return {k: (c, 1.4826 * off[k][0] if off[k][0] > 1e-3 else LEAST_SPREAD) for k, c in few}


def _medians(values: DataFrame) -> dict[str, tuple[float, int]]:
    """Median and number of x by language, from an exact histogram."""
    rows = values.groupBy("lang", F.floor(F.col("x") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    out = {}
    for lang, cells in by.items():
        at, n = np.array(sorted(cells)).T
        out[lang] = (float(at[np.searchsorted(np.cumsum(n), math.ceil(n.sum() / 2))] + 0.5) / BINS, int(n.sum()))
    return out


def _bounds(spark: SparkSession, found: dict[str, tuple[float, float]]) -> DataFrame:
    """At most 18253 rows, see common.language."""
    return spark.createDataFrame([(k, c, s) for k, (c, s) in found.items()], "_lang string, _centre double, _spread double")


def _limit(side: float, n_chars: Column) -> Column:
    return F.col("_centre") + side * F.col("_spread") * breadth(n_chars)


def judge(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """:func:`score` with the bounds of the language and ``kept``."""
    scored = common.cut(score(docs, fit(docs)))
    sides = _bounds(docs.sparkSession, bands(scored))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower_log_ppl"), F.col("upper_log_ppl")), F.lit(True))
    return (
        scored.join(F.broadcast(sides), scored["lang"] == sides["_lang"], "left")
        .withColumn("lower_log_ppl", _limit(-lower, F.col("n_chars")))
        .withColumn("upper_log_ppl", _limit(upper, F.col("n_chars")))
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("_lang", "_centre", "_spread", "of")
    )


def keep(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only. Each is
    scored once; rows and scores are written together in the shared folder."""
    spark = docs.sparkSession
    model = fit(docs)
    common.bound_batches(spark)
    own = common.free_name(docs, "_ppl")
    work = {c: f"{own}_{c}" for c in ("lang", "of", "half")}
    types = ", ".join(f"{own}_{c}" for c in _SCORE_TYPES.split(", "))
    text = docs.columns.index("text")
    ready = docs.withColumns({work["lang"]: common.language(F.col("lang")), work["of"]: F.xxhash64("text"), work["half"]: half(F.col("text"))})
    at = len(docs.columns)

    def scored(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = scores(texts, batch.column(at).to_pylist(), batch.column(at + 2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *(f"{own}_{c}" for c in _SCORES)])

    made = ready.mapInArrow(common.lean(scored), common.ddl(ready.schema, types))
    rows = common.stash(made)
    of = rows.select(*(F.col(f"{own}_{c}").alias(c) for c in ("lang", "of", "n_chars", "teaches", "log_ppl")))
    sides = _bounds(spark, bands(of))
    n_chars, lp = F.col(f"{own}_n_chars"), F.col(f"{own}_log_ppl")
    both = rows.join(F.broadcast(sides), F.col(f"{own}_lang") == F.col("_lang"), "left")
    inside = F.coalesce(lp.between(_limit(-lower, n_chars), _limit(upper, n_chars)), F.lit(True))
    return both.filter(~F.col(f"{own}_base_failed") & inside).select(*(rows[c] for c in docs.columns))


def _code(lang: str | None) -> str:
    low = (lang or "").lower()
    return low if 2 <= len(low) <= 3 and low.isascii() and low.isalpha() else "und"
