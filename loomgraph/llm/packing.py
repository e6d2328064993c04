"""Bounded-space online packing of documents into sequences of fixed capacity.

Each partition keeps at most ``OPEN`` windows. A piece goes to the open window
with the least room that still holds it; where none does and ``OPEN`` windows
are open, the fullest is emitted and a new one opened. What is still open at a
partition's end is merged: the leftovers of ``MERGE`` partitions at a time (a
bounded number of windows) are placed best-fit, the largest first; the ``OPEN``
emptiest of each group that are less than ``FULL`` full are then merged with those
of other groups, ``MERGE`` at a time, until one group is left. So padding does not
grow with the number of partitions, and no group is larger than another.

A document longer than a window is cut into whole windows, which need no open one,
and a rest; shorter documents are never cut. Sequence ids are unique and need not be
consecutive.

Token ids come from a word-level table: the tokenizer drops white space and
works on each run of other characters alone, so a run is encoded once and its
ids are kept, as little-endian bytes, while the table has room. Arrow numbers the
distinct runs of a block, each is looked up once, and the texts' ids are gathered
by those numbers.

Defined cases: a null or empty text is the end token alone. Repeated rows are
packed as often as they occur. A very long text is held once, as its ids. Windows of
equal room are taken in the order they were opened. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import codecs
import itertools
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import vocabulary

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 2, 4096
OPEN, MERGE, FULL = 64, 32, 0.95
#: Entries of a worker's table of encoded words.
TABLE = 400_000
#: Words whose ids are gathered at once: a block's, or a part of a very long text's.
WORDS = 1 << 19
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, part int"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class Words:
    """Ids of the words of a text, as bytes.

    The tokenizer takes letters and signs apart, drops white space and
    lower-cases. So a text is lower-cased first, a sign after a word is set apart,
    and what white space separates is looked up whole, each distinct word of a
    block once. Letters that were not met before, and signs behind them, go to the
    model alone; anything else goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table: dict[bytes, bytes] = {}

    def _whole(self, runs: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(runs), 2048):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(runs[a : a + 2048], add_special_tokens=False)]
        return out

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of words that are not in the table."""
        out, other, model = [], [], self.model.tokenize
        for run in new:
            low = run.decode()
            stem = low.rstrip(_SIGNS)
            if stem and not stem.isalpha() or low != low.lower() or not unicodedata.is_normalized("NFC", low):
                other.append(len(out))
                out.append(low)
                continue
            tail = low[len(stem) :]
            if not stem.isascii():
                stem = codecs.charmap_decode(run[: len(run) - len(tail)], "strict", _BYTES)[0]
            ids = [t.id for t in model(stem)]
            if tail:
                ids += [t.id for t in model(tail)]
            out.append(array("I", ids).tobytes())
        for i, ids in zip(other, self._whole([out[i] for i in other])):
            out[i] = ids
        return out

    def _known(self, met: list[bytes]) -> list[bytes]:
        """Ids of distinct words, which the table then holds."""
        known = list(map(self.table.get, met))
        missing = [i for i, ids in enumerate(known) if ids is None]
        if missing:
            for i, ids in zip(missing, self._learn([met[i] for i in missing])):
                known[i] = ids
            if len(self.table) + len(missing) > TABLE:  # begun anew with the words at hand and the first of those before
                older = dict(itertools.islice(self.table.items(), max(0, TABLE // 2 - len(met))))
                self.table.clear()
                self.table.update(zip(met, known))
                self.table.update(older)
            else:
                self.table.update((met[i], known[i]) for i in missing)
        return known

    def _block(self, texts: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all texts, and where each text's begin and end."""
        split = pc.ascii_split_whitespace(pa.array([_clean(t) for t in texts], pa.large_string()))
        stops, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        known = self._known(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        words, ids = coded.indices.to_numpy(), np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, raw = np.cumsum(size) - size, []
        for a in range(0, len(words), WORDS):
            w = words[a : a + WORDS]
            n = size[w]
            at = np.repeat(first[w] - np.cumsum(n) + n, n)
            at += np.arange(len(at))
            raw.append(ids[at].tobytes())
        ends = np.concatenate(([0], np.cumsum(size[words])))[stops - stops[0]]
        return b"".join(raw), (4 * ends).tolist()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in common.blocks([len(t) for t in texts], 1 << 20):
            ids, ends = self._block(texts[a:b])
            for x, y in zip(ends, ends[1:]):
                yield ids[x:y]


#: Signs of which a run is one token or more by itself; those of a special string
#: have letters between them.
_SIGNS = string.punctuation
#: A sign between a letter or digit and white space, which is a token of its own.
_SIGN = re.compile(r"([.,;:!?])(?<=[^\W_].)(?=[ \n])")
_SIGN_BYTES = re.compile(rb"([.,;:!?])(?<=[a-z0-9].)(?=[ \n])")
#: The character by which a byte-level tokenizer writes each byte.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = "".join(chr(b if b in _PLAIN else 256 + sum(o not in _PLAIN for o in range(b))) for b in range(256))


def _clean(text: str) -> bytes:
    """A text lower-cased and with such signs apart, where this leaves the tokens as
    they are: special strings are so in their own case only, a capital sigma depends
    on its place, and composition comes before lower case."""
    if "<|" in text:
        return text.encode()
    if text.isascii():
        return _SIGN_BYTES.sub(rb" \1", text.encode().lower())
    if "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
        return text.encode()
    return _SIGN.sub(r" \1", text.lower()).encode()


_own: dict[str, Words] = {}
common.keeps(__name__, _own.clear)


def words(path: str) -> Words:
    if path not in _own:
        _own[path] = Words(path)
    return _own[path]


class Packer:
    """Open windows, ordered by room. ``add`` gives the windows that it emits,
    each a list of (payload, length)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, payload, length: int) -> list[tuple[int, list]]:
        out = []
        if length == self.capacity:
            self.made += 1
            return [(self.made - 1, [(payload, length)])]
        at = bisect.bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) == self.most:
                _, fullest = self.open.pop(0)
                out.append((fullest, self.held.pop(fullest)))
            room, number = self.capacity, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append((payload, length))
        if room == length:
            out.append((number, self.held.pop(number)))
        else:
            bisect.insort(self.open, (room - length, number))
        return out

    def rest(self) -> list[tuple[int, list]]:
        return [(number, self.held[number]) for _, number in self.open]


def _rows(windows: list[tuple[int, int, list]]) -> pa.RecordBatch:
    """windows: (sequence_id, part or -1 when closed, pieces)."""
    cols: list[list] = [[] for _ in _NAMES]
    for sequence, part, pieces in windows:
        offset = 0
        for (doc_id, start, total, ids), length in pieces:
            for col, v in zip(cols, (doc_id, start, length, total, ids, sequence, offset, part)):
                col.append(v)
            offset += length
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)


def open_windows(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """Pieces with their ids: part is -1 in an emitted window, else the number of
    the partition that left the window open."""
    common.bound_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, pack, part = words(vocabulary(tokenizer)), Packer(capacity, most), TaskContext.get().partitionId()
        end, done, waiting = np.array([end_id], "<u4").tobytes(), [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tool.encode(common.texts_of(batch))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    done += [(part << 32 | n, -1, w) for n, w in pack.add((doc_id, start, total, piece), len(piece) // 4)]
                if len(done) > 256:
                    yield _rows(done)
                    done = []
        yield _rows(done + [(part << 32 | n, part, w) for n, w in pack.rest()])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(common.lean(packed), _PIECES)


def _placed(capacity: int):
    """Windows of one group, the fullest first, into new ones, best-fit."""

    def placed(key, rows):
        rows = rows.sort_by([("used", "descending"), ("sequence_id", "ascending")])
        room: list[tuple[int, int]] = []
        to, shift = [], []
        for used in rows.column("used").to_pylist():
            at = bisect.bisect_left(room, (used, -1))
            free, number = room.pop(at) if at < len(room) else (capacity, len(room))
            to.append(number)
            shift.append(capacity - free)
            bisect.insort(room, (free - used, number))
        level, block = key[0].as_py(), key[1].as_py()
        names = pa.array([1 << 62 | level << 56 | block << 32 | n for n in to], pa.int64())
        return pa.table({"sequence_id": rows.column("sequence_id"), "to": names, "shift": pa.array(shift, pa.int64())})

    return placed


def merge_leftovers(pieces: DataFrame, capacity: int = CAPACITY, merge: int = MERGE) -> DataFrame:
    """The pieces of :func:`open_windows`, other columns included, with leftover
    windows placed in common ones. ``pieces`` is read more than once: cut it before."""
    columns = [c for c in pieces.columns if c != "part"]
    left = pieces.filter("part >= 0")
    windows = common.cut(left.groupBy("part", "sequence_id").agg(F.sum("length").alias("used")))
    blocks = windows.agg(F.max("part")).first()[0]
    # where each leftover window is now: in ``to``, behind ``shift`` tokens
    now = windows.select("sequence_id", F.col("sequence_id").alias("to"), F.lit(0).cast("long").alias("shift"), "used", F.col("part").alias("block"))
    level = 0
    while blocks:  # the last group is number 0
        blocks //= merge
        of = now.groupBy("to").agg(F.sum("used").alias("used"), F.first("block").alias("from"))
        if level:
            nth = F.row_number().over(Window.partitionBy("from").orderBy("used", "to"))
            of = of.withColumn("nth", nth).filter((F.col("nth") <= OPEN) & (F.col("used") < FULL * capacity))
        again = of.select(F.lit(level).alias("level"), (F.col("from") / merge).cast("int").alias("block"), F.col("to").alias("sequence_id"), "used")
        moves = again.groupBy("level", "block").applyInArrow(_placed(capacity), "sequence_id long, to long, shift long")
        moves = moves.select(F.col("sequence_id").alias("to"), F.col("to").alias("then"), F.col("shift").alias("more"))
        now = common.cut(now.join(moves, "to", "left").select("sequence_id", F.coalesce("then", "to").alias("to"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), "used", (F.col("block") / merge).cast("int").alias("block")))
        level += 1
    merged = left.drop("part").join(now.select("sequence_id", "to", "shift"), "sequence_id").withColumn("offset", F.col("offset") + F.col("shift"))
    merged = merged.drop("sequence_id", "shift").withColumnRenamed("to", "sequence_id").select(*columns)
    return pieces.filter("part < 0").select(*columns).unionByName(merged)


def pack(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) by piece;
    ids are little-endian unsigned 32-bit."""
    return merge_leftovers(common.stash(open_windows(docs, **options)), options.get("capacity", CAPACITY))


def digest(docs: DataFrame) -> DataFrame:
    """As :func:`pack`, with the ids' CRC-32 in place of the ids."""
    pieces = open_windows(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return merge_leftovers(common.stash(pieces))
