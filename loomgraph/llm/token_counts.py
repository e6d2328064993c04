"""Token counts by pre-token.

A byte-level tokenizer cuts a text into pre-tokens and encodes each on its own,
so the number of a text's tokens is the sum, over its distinct pre-tokens, of
frequency times pieces. Each worker holds the table (pre-token, pieces), counts
the pieces of a pre-token when it first meets it, joins a document's pre-token
frequencies to that table and adds up; token ids are never kept. The table is
bounded by characters; when full it is begun anew, which costs time, not results.

A join of all (document, pre-token) pairs through a shuffle would move more
bytes than the input has: 317 distinct pre-tokens a document on the check data, 81
million pairs of some 16 bytes, 1.3 GB for 0.51 GB. So the join is made where the
documents are.

Defined cases: a null text is empty and has no tokens. Special strings inside a
text are special tokens, the library's default. Very long texts are counted whole, in
blocks of whole texts. Ties do not arise. Repeated rows give repeated rows; extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters that a worker's table of pre-tokens may hold.
TABLE_CHARS = 6 << 20
#: The pre-tokens of the byte-level tokenizer (a fixed value of its vocabulary).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that another Unicode version may class otherwise.
UNSURE = regex.compile(r"\p{Cn}")


class Pieces:
    """How many tokens each pre-token has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.table: dict[str, int] = {}
        self.held = 0

    def encode_lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The pre-tokens of a text and the number of special tokens in it."""
        if self.cut and any(s in text for s in self.special):
            found, parts = Counter(), self.cut.split(text)
            for part in parts:
                found.update(PATTERN.findall(part))
            return found, len(parts) - 1
        return Counter(PATTERN.findall(text)), 0

    def learn(self, new: list[str]) -> None:
        # as a special string never is a pre-token, the library cuts nothing here
        size = sum(map(len, new))
        if self.table and self.held + size > TABLE_CHARS:
            self.table.clear()
            self.held = 0
            return
        self.held += size
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        other = new if not words else [p for p in new if p[0] != " " or not p[1:].isalpha()]
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            self.table.update(zip(part, self._lengths_of_words(part)))
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            self.table.update(zip(part, self.encode_lengths(part)))

    def _lengths_of_words(self, part: list[str]) -> list[int]:
        """Of pre-tokens that are a space and letters: joined they are cut again at
        the spaces, and only the first token of each has the space's sign."""
        ids = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
        firsts = np.flatnonzero(self.spaced[ids])
        return np.diff(np.append(firsts, len(ids))).tolist() if len(firsts) == len(part) else self.encode_lengths(part)

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for a, b in common.blocks([len(t) for t in texts], 1 << 20):
            found = [None if not t.isascii() and UNSURE.search(t) else self.frequencies(t) for t in texts[a:b]]
            met: set[str] = set()
            for f in found:
                if f:
                    met.update(f[0])
            while missing := met.difference(self.table):  # twice where it is begun anew
                self.learn(list(missing))
            get = self.table.__getitem__
            for t, f in zip(texts[a:b], found):
                out.append(sum(n * p for n, p in zip(f[0].values(), map(get, f[0]))) + f[1] if f else self.encode_lengths([t])[0])
        return out


_own: dict[str, Pieces] = {}
common.keeps(__name__, _own.clear)


def pieces(path: str) -> Pieces:
    if path not in _own:
        _own[path] = Pieces(path)
    return _own[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by document. ``tokenizer`` names a
    byte-level file, found where the task runs."""
    common.bound_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces(vocabulary(tokenizer))
        for batch in batches:
            n = pa.array(tool.count(common.texts_of(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size).mapInArrow(common.lean(counted), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
