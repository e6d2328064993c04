"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that were not met before are joined into one text, whose
suffixes are sorted (as far as the longest piece). Every piece is found by binary
search as a range of suffixes; each occurrence is an edge from its start to its
end. Edges are sorted by position in their word and relaxed from left to right.

The model is BPE, so an edge is relaxed not by a sum of scores but by whether BPE
would have kept it: a token may follow the token that ends where it starts if and
only if BPE of both together gives just these two. One token at most then ends at
each position, and the path back from a word's end is the encoding. Pieces that
BPE never forms are left out. Words are cut where no piece goes across: before a
space mark that follows another character, and around characters that no piece
has, which become byte pieces.

A run longer than ``INDEXED`` characters is indexed window by window: what is
relaxed at a position depends on the positions before it alone, so windows that
overlap by the longest piece give the same path in bounded memory.

Defined cases: a null text is empty and has no tokens. Very long texts and texts
without a space are encoded whole, in memory in proportion to their tokens. Of pieces
of equal score the one of smaller id is preferred, as the library does. Repeated rows
give repeated rows; extra columns are ignored by :func:`encode` and kept by
:func:`decode`. An empty table gives an empty result. Special strings in a text are
text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import vocabulary

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of texts that are cut at once, and of new words that are indexed
#: together; entries of a worker's tables.
BLOCK, INDEXED, WORDS, PAIRS = 1 << 21, 1 << 18, 400_000, 400_000
#: Characters of the longest word that the table keeps.
LONG = 256
_NEVER = 1 << 40


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in ids}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        # by rank: characters, then pieces in the order in which BPE prefers them
        ids.sort(key=lambda i: (len(text[i]) > 1, -sp.get_score(i), i))
        self.text = [text[i] for i in ids]
        self.ids = np.array(ids, np.uint32)
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.left, self.right = list(range(len(ids))), list(range(len(ids)))
        self.formed = [len(t) == 1 for t in self.text]
        for r, t in enumerate(self.text):
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k], _NEVER), self.rank.get(t[k:], _NEVER)
                if a < r and b < r and self.formed[a] and self.formed[b] and self.together(a, b, r):
                    self.left[r], self.right[r], self.formed[r] = a, b, True
                    break
        self.letters = frozenset(t for t in self.text if len(t) == 1)
        self.longest = wide = max(map(len, self.text))
        # the numbers of characters, and of pieces the least and greatest suffixes
        # that begin with them; big-endian, as their bytes then sort as they do
        code = {c: i + 1 for i, c in enumerate(sorted(self.letters))}
        self.code = np.zeros(0x110000, ">u2")
        self.code[[ord(c) for c in code]] = list(code.values())
        self.whole = np.array([r for r in range(len(ids)) if self.formed[r]], np.int64)
        low = np.zeros((len(self.whole), wide), ">u2")
        high = np.full((len(self.whole), wide), 0xFFFF, ">u2")
        for i, r in enumerate(self.whole.tolist()):
            own = [code[c] for c in self.text[r]]
            low[i, : len(own)] = high[i, : len(own)] = own
        self.low, self.high = low.view(f"S{2 * wide}").ravel(), high.view(f"S{2 * wide}").ravel()
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        inner = any(SPACE in t.lstrip(SPACE) for t in self.text)
        own = "\n" if all("\n" not in t for t in self.text) else ""
        self.cut = None if inner else re.compile(f"{SPACE}*[^{SPACE}{own}]+|{SPACE}+" + (f"|{own}" if own else ""))
        self.foreign = re.compile(r"[^" + re.escape("".join(sorted(self.letters))) + "]")
        self.table: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def together(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether BPE of the two tokens' text, by pieces that it prefers to
        ``limit``, gives these two: undo their merges from the last one back and see
        that nothing would have joined across."""
        rank, text, left, right = self.rank, self.text, self.left, self.right
        while True:
            if rank.get(text[a] + text[b], _NEVER) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        many, at = np.unique(keys, return_inverse=True)
        n, known, out = len(self.text), self.pairs, np.empty(len(many), bool)
        if len(known) > PAIRS:
            known.clear()
        for i, key in enumerate(many.tolist()):
            ok = known.get(key)
            if ok is None:
                ok = known[key] = self.together(key // n, key % n)
            out[i] = ok
        return out[at]

    def edges(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and rank of every occurrence of every piece that BPE forms."""
        wide = self.longest
        padded = np.zeros(len(cp) + wide, ">u2")
        padded[: len(cp)] = self.code[cp]
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, wide)[: len(cp)]).view(f"S{2 * wide}").ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.searchsorted(keys, self.low, "left")
        count = np.searchsorted(keys, self.high, "right") - first
        at = np.arange(count.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return order[at], np.repeat(self.whole, count)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian bytes, of words of known characters."""
        if not words:
            return []
        text = "\x00".join(words) + "\x00"
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        of = np.repeat(begin, size + 1)
        start, rank = self.edges(cp)  # the separator is in no piece
        end = start + self.lengths[rank]
        place = end - of[start]
        by = np.argsort(place, kind="stable")
        start, rank, end, place = start[by], rank[by], end[by], place[by]
        ended = np.full(len(cp) + 1, -1, np.int64)
        n = len(self.text)
        steps = np.searchsorted(place, np.arange(1, place[-1] + 2 if len(place) else 1))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            s, r = start[a:b], rank[a:b]
            fresh = s == of[s]
            before = ended[s]
            ok = fresh.copy()
            rest = np.flatnonzero(~fresh & (before >= 0))
            ok[rest] = self._compatible(before[rest] * n + r[rest])
            ended[end[a:b][ok]] = r[ok]
        # the paths back, all words at once
        word, at = np.arange(len(words)), begin + size
        found_word, found_rank = [], []
        while len(word):
            r = ended[at]
            if (r < 0).any():
                raise AssertionError(f"no path: {words[word[np.argmin(r)]]!r}")
            found_word.append(word)
            found_rank.append(r)
            at = at - self.lengths[r]
            on = at > begin[word]
            word, at = word[on], at[on]
        w, r = np.concatenate(found_word[::-1]), np.concatenate(found_rank[::-1])
        by = np.argsort(w, kind="stable")
        raw = self.ids[r[by]].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(w, minlength=len(words)))).tolist()
        return [raw[x:y] for x, y in zip([0, *stops], stops)]

    def encode_long(self, run: str) -> bytes:
        """As :func:`encode_words` for one run of known characters, by windows."""
        ended, n, lengths = array("i", [-1]) * (len(run) + 1), len(self.text), self.lengths.tolist()
        known = self.pairs
        for a in range(0, len(run), INDEXED):
            window = run[a : a + INDEXED + self.longest]
            start, rank = self.edges(np.frombuffer(window.encode("utf-32-le"), np.uint32))
            mine = start < INDEXED
            start, rank = start[mine], rank[mine]
            by = np.argsort(start + self.lengths[rank], kind="stable")
            if len(known) > PAIRS:
                known.clear()
            for s, r in zip((start[by] + a).tolist(), rank[by].tolist()):
                ok = not s
                if s and (before := ended[s]) >= 0:
                    ok = known.get(before * n + r)
                    if ok is None:
                        ok = known[before * n + r] = self.together(before, r)
                if ok:
                    ended[s + lengths[r]] = r
        found, at = array("i"), len(run)
        while at:
            if ended[at] < 0:
                raise AssertionError(f"no path to {at} of {run[:40]!r}")
            found.append(ended[at])
            at -= lengths[ended[at]]
        return self.ids[np.frombuffer(found, np.int32)[::-1]].astype("<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        parts: dict[str, list[str]] = {}
        runs: set[str] = set()
        for w in new:
            if self.foreign.search(w):
                own = re.split(f"({self.foreign.pattern})", w)
                parts[w] = own
                runs.update(x for x in own[::2] if x)
            else:
                runs.add(w)
        runs = list(runs)
        made: dict[str, bytes] = {}
        made.update((r, self.encode_long(r)) for r in runs if len(r) > INDEXED)
        runs = [r for r in runs if len(r) <= INDEXED]
        for a, b in common.blocks([len(r) + 1 for r in runs], INDEXED):
            made.update(zip(runs[a:b], self.encode_words(runs[a:b])))
        for w in new:
            if w in parts:
                own = parts[w]
                self.table[w] = b"".join(made.get(x, b"") if i % 2 == 0 else array("I", [self.bytes[b] for b in x.encode()]).tobytes() for i, x in enumerate(own))
            else:
                self.table[w] = made[w]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.cut.findall(marked) if self.cut else [marked]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in common.blocks([len(t) for t in texts], BLOCK):
            cut = [self.words(t) for t in texts[a:b]]
            met = set().union(*cut)
            new = met.difference(self.table)
            if len(self.table) + len(new) > WORDS:
                self.table.clear()
                new = met
            self._learn(list(new))
            get = self.table.__getitem__
            for words in cut:
                yield b"".join(map(get, words))
            for w in new:
                if len(w) > LONG:  # not worth their memory
                    del self.table[w]

    def decode(self, raw: bytes) -> str:
        """The text of ids: byte pieces as UTF-8, space marks as spaces, without the
        space that encoding puts first."""
        if not hasattr(self, "pieces"):
            of = {i: b for b, i in self.bytes.items()}
            self.pieces = [bytes([of[i]]) if i in of else b"" if self.sp.is_control(i) else self.sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.sp.get_piece_size())]
        text = b"".join(map(self.pieces.__getitem__, memoryview(raw).cast("I"))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_own: dict[str, Pieces] = {}
common.keeps(__name__, _own.clear)


def pieces(path: str) -> Pieces:
    if path not in _own:
        _own[path] = Pieces(path)
    return _own[path]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, ids): ids as little-endian unsigned 32-bit."""
    common.bound_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces(vocabulary(model))
        for batch in batches:
            ids = pa.array(list(tool.encode(common.texts_of(batch))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids], names=["doc_id", "n_bytes", "ids"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size).mapInArrow(common.lean(made), "doc_id long, n_bytes long, ids binary")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded``, which has ``ids``, with the ``text`` of each row."""
    common.bound_batches(encoded.sparkSession)
    at = encoded.columns.index("ids")
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", text string"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces(vocabulary(model))
        for batch in batches:
            text = pa.array([tool.decode(raw) for raw in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(common.lean(made), schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_crc32, text_crc32): the last of the decoded
    text, which is that of the text itself."""
    both = decode(encode(docs))
    return both.select("doc_id", "n_bytes", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
