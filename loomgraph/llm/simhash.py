"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint has 64 bits, the majority of the XXH64 hashes of a text's word
shingles. Two fingerprints that differ in at most three bits have at least
``MATCHES`` = 5 of their 8 positional bytes in common. Posting single bytes
would give 2048 lists whose pairs grow with the square of the table, so the
index posts the four bytes of each block of the Steiner system S(3, 4, 8): any
three positions are disjoint from at least one of its 14 blocks, so each pair
within three bits meets in at least one list, and lists of 32-bit keys stay
short. Within a list the shared positional bytes of each pair are tallied, pairs
below the guaranteed minimum are dropped, and the rest are verified by Hamming
distance. A list passes on a spanning forest of its links (at most one link a
member, each between two near members), never its pairs.

A list of more than ``HOT`` members is not compared in one task: its members are
posted again, under their other 32 bits with each choice of at most two flipped.
Members within three bits share such a key, and a key has at most 529 members,
so a hot group costs work in proportion to its size and is spread over tasks.

The index works on distinct fingerprints: copies share one, and take part as one.

:func:`keep_one`, the pipeline's stage, takes five words and a similarity of 0.8.
Texts as near as that differ by some ten bits of a print over five words, which
no tally of eight bytes can guarantee; but by about three of a print over their
single words. So candidates are pairs within three bits by any of ``SEEDS`` such
prints, found by the index above, and each is verified by the similarity that a
print of ``CHECK`` bits over five-word shingles tells (``LEAST``, below 0.8 by
the error of that print).

Defined cases: a null text is empty; a text without words has fingerprint zero
and links like any other. Null doc_ids take part in linking and are ignored by
the smallest id; a component of nothing else has a null component_id. Repeated
rows give repeated rows, of which :func:`keep_one` keeps one. Very long texts are
hashed in blocks of shingles. Extra columns are ignored, and returned by
:func:`keep_one` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS, SEED, BITS = 3, 42, 3
MATCHES = 8 - BITS
#: Members of a list that are compared at once with all others of the list, and
#: those above which a list is dealt out.
ROWS, HOT = 512, 16384
#: The stage's word prints, and the bits and shingle of the print that verifies.
SEEDS, CHECK, CHECK_WORDS = 3, 256, 5
#: Least estimated similarity: 0.8 less about twice the error of CHECK bits.
LEAST = 0.7
_POSTED = "list int, key long, id long, fp long"


def _blocks() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3, 4, 8): the supports of the extended Hamming code,
    which are the 4-sets of points of a 3-space whose sum is zero."""
    return [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]


BLOCKS = _blocks()


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Space-joined shingles of the text's words, in A-Z lower case."""
    w = text.encode().lower().split()  # bytes.lower() changes A-Z only
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[k:] for k in range(words)))))


def fingerprint(text: str, words: int = WORDS) -> int:
    found = shingles(text, words)
    if not found:
        return 0
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for a in range(0, len(found), 1 << 15):
        raw = b"".join([digest(s, SEED) for s in found[a : a + (1 << 15)]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    common.bound_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in common.texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.lean(made), "doc_id long, fp long")


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """A further hash of 64-bit hashes, for each turn."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(found) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in found), np.uint64)


def majority(h: np.ndarray, prints: int) -> np.ndarray:
    """``prints`` words of 64 bits, each the majority of a further hash of ``h``."""
    ones = np.zeros((prints, 64), np.int64)
    for a in range(0, len(h), 1 << 13):
        for k in range(prints):
            bits = np.unpackbits(mixed(h[a : a + (1 << 13)], k).view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1).view(np.uint64).ravel()


def stage_prints(text: str) -> np.ndarray:
    """SEEDS prints over the distinct words of a text, then the print that verifies
    over its distinct five-word shingles."""
    words = text.encode().lower().split()
    return np.concatenate([majority(_hashes(set(words)), SEEDS), majority(_hashes(set(shingles(text, CHECK_WORDS))), CHECK // 64)])


def bits_at(similarity: float, bits: int = CHECK) -> int:
    """The bits by which prints of texts of this Jaccard similarity differ."""
    cosine = 2 * similarity / (1 + similarity)
    return int(np.floor(np.arccos(cosine) / np.pi * bits))


def postings(prints: DataFrame) -> DataFrame:
    """(list, key, id, fp, ...): the four bytes of each block of each print; prints
    are rows (id, seed, fp, ...), and each seed has lists of its own."""
    fp = F.col("fp")

    def byte(k: int):
        return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))

    def key(block):
        bits = F.lit(0).cast("long")
        for place, k in enumerate(block):
            bits = bits.bitwiseOR(F.shiftleft(byte(k), 8 * place))
        return bits

    lists = F.array(*(F.struct((F.col("seed") * len(BLOCKS) + i).cast("int").alias("list"), key(b).alias("key")) for i, b in enumerate(BLOCKS)))
    return prints.select("id", "fp", *[c for c in prints.columns if c not in ("id", "seed", "fp")], F.inline(lists)).select("list", "key", "id", "fp", *[c for c in prints.columns if c not in ("id", "seed", "fp")])


def flips(block: tuple[int, ...]) -> list[int]:
    """Masks of at most two bits outside a block's bytes."""
    free = [8 * k + i for k in range(8) if k not in block for i in range(8)]
    masks = [0] + [1 << i for i in free] + [1 << i | 1 << j for i, j in combinations(free, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def dealt(hot: DataFrame) -> DataFrame:
    """The postings of hot lists under all keys within two flips."""
    masks = [(n, m) for n, b in enumerate(BLOCKS) for m in flips(b)]
    table = hot.sparkSession.createDataFrame(masks, "block int, mask long")  # 14 times 529 rows
    more = [c for c in hot.columns if c not in ("list", "key", "id", "fp")]
    return hot.withColumn("block", F.col("list") % len(BLOCKS)).join(F.broadcast(table), "block").select("list", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "id", "fp", *more)


def forest(fp: np.ndarray, bits: int = BITS, check: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs within ``bits`` bits, and within ``most`` by ``check``
    where that is given, that connect all such pairs: a spanning forest."""
    n = len(fp)
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, ROWS):
        for b in range(a, n, ROWS):
            near = np.bitwise_count(fp[a : a + ROWS, None] ^ fp[None, b : b + ROWS]) <= bits
            if b == a:
                near &= np.tri(len(near), k=-1, dtype=bool).T
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            if check is not None and len(i):
                ok = np.concatenate([np.bitwise_count(check[i[k : k + (1 << 18)]] ^ check[j[k : k + (1 << 18)]]).sum(1, dtype=np.int64) <= most for k in range(0, len(i), 1 << 18)])
                i, j = i[ok], j[ok]
            while len(i):  # one link of each open column in each turn
                ends, at = np.unique(j, return_index=True)
                for x, y in zip(i[at].tolist(), ends.tolist()):
                    p, q = top(x), top(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(x)
                        right.append(y)
                now = np.arange(n)
                for k in np.unique(np.concatenate([i, j])).tolist():
                    now[k] = top(k)
                still = now[i] != now[j]
                i, j = i[still], j[still]
    return np.array(left, np.int64), np.array(right, np.int64)


def _small_runs(fp: np.ndarray, check: np.ndarray | None, starts: np.ndarray, sizes: np.ndarray, bits: int, limit: int, most: int):
    """Places of the links of all lists of at most ``most`` members, by offset."""
    for k in range(1, most):
        own = (sizes > k) & (sizes <= most)
        if not own.any():
            return
        left = np.repeat(starts[own], sizes[own] - k)
        step = np.arange(len(left)) - np.repeat(np.cumsum(sizes[own] - k) - (sizes[own] - k), sizes[own] - k)
        i = left + step
        off = fp[i] ^ fp[i + k]
        # tally of the shared positional bytes, then the verification
        shared = (off[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(1)
        ok = np.flatnonzero(shared >= 8 - bits)
        ok = ok[np.bitwise_count(off[ok]) <= bits]
        if check is not None:
            ok = ok[np.bitwise_count(check[i[ok]] ^ check[i[ok] + k]).sum(1, dtype=np.int64) <= limit]
        if len(ok):
            yield i[ok], i[ok] + k


def _listed(posted: DataFrame, bits: int, limit: int, hot: int) -> DataFrame:
    """(list, a, b, ...): links as list -1 and ids a and b; members of lists of more
    than ``hot`` members as they were posted, with id as a and fp as b."""
    small, more = 16, [c for c in posted.columns if c not in ("list", "key", "id", "fp")]
    names = ["list", "key", "a", "b", *more]

    def of(cols: list[np.ndarray]):
        numbers, keys, ids, fp = cols[:4]
        fp = fp.view(np.uint64)
        check = np.stack(cols[4:], axis=1).view(np.uint64) if more else None
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])])) if len(fp) else np.empty(0, int)
        sizes = np.diff(np.append(starts, len(fp)))
        for i, j in _small_runs(fp, check, starts, sizes, bits, limit, small):
            yield ids[i], ids[j]
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
            i, j = forest(fp[s : s + n], bits, None if check is None else check[s : s + n], limit)
            yield ids[s + i], ids[s + j]

    def written(pairs) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            if len(a):
                none = pa.array(np.zeros(len(a), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1, np.int32)), none, pa.array(a), pa.array(b), *[none] * len(more)], names=names)

    def joined(held):
        return [np.concatenate(x) for x in zip(*held)]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last list, which may go on
        size, given = 0, None  # its members so far; the list that is given back as hot
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if given is not None:
                other = np.flatnonzero((cols[0] != given[0]) | (cols[1] != given[1]))
                end = int(other[0]) if len(other) else batch.num_rows
                if end:
                    yield pa.RecordBatch.from_arrays(batch.slice(0, end).columns, names=names)
                if end == batch.num_rows:
                    continue
                given, cols = None, [c[end:] for c in cols]
            turn = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            if held and (held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0]):
                yield from written(of(joined(held)))
                held, size = [], 0
            if len(turn):
                cut = int(turn[-1]) + 1
                held.append([c[:cut] for c in cols])
                yield from written(of(joined(held)))
                held, size, cols = [], 0, [c[cut:] for c in cols]
            held.append(cols)
            size += len(cols[0])
            if size > hot:
                given, back = (cols[0][-1], cols[1][-1]), joined(held)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in back], names=names)
                held, size = [], 0
        if held:
            yield from written(of(joined(held)))

    lists = posted.repartition("list", "key").sortWithinPartitions("list", "key")
    return lists.mapInArrow(common.lean(found), "list int, key long, a long, b long" + "".join(f", {c} long" for c in more))


def links(prints: DataFrame, bits: int = BITS, limit: int = 0, hot: int = HOT) -> DataFrame:
    """(a, b): links between ids that connect all pairs within ``bits`` bits of a
    print of the same seed; prints are (id, seed, fp) and, where the pair must be
    within ``limit`` bits by these too, further 64-bit columns."""
    made = common.cut(_listed(postings(prints), bits, limit, hot))
    more = [c for c in prints.columns if c not in ("id", "seed", "fp")]
    crowded = made.filter("list >= 0").select("list", "key", F.col("a").alias("id"), F.col("b").alias("fp"), *more)
    found = made.filter("list < 0").select("a", "b")
    if crowded.isEmpty():
        return found
    # a key has at most 529 members here, so no list is hot again
    again = _listed(dealt(crowded), bits, limit, 1 << 62)
    return found.unionByName(common.cut(again.select("a", "b").distinct()))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root): connected components of the edges (a, b), by alternating
    large-star and small-star steps; each round is cut and compared with the last.
    Raises if they are not settled after ``rounds``."""
    e = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.cut(down.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def clusters(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) by document."""
    prints = common.cut(fingerprints(docs, words))
    nodes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select(F.col("fp").alias("id"), F.lit(0).alias("seed"), "fp"), bits))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_texts(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, root): components of the texts of ``rows`` (id, text); equal ids mean
    equal texts, and texts linked to no other have no row."""
    common.bound_batches(rows.sparkSession)
    checks = [f"c{k}" for k in range(CHECK // 64)]
    names = [f"w{k}" for k in range(SEEDS)] + checks

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([stage_prints(t) for t in common.texts_of(batch)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names)))], names=["id", *names])

    prints = rows.mapInArrow(common.lean(made), "id long" + "".join(f", {n} long" for n in names)).groupBy("id").agg(*(F.first(n).alias(n) for n in names))
    prints = common.cut(prints)
    seeds = F.posexplode(F.array(*names[:SEEDS])).alias("seed", "fp")
    found = components(links(prints.select("id", seeds, *checks), BITS, bits_at(least)))
    return found.select(F.col("node").alias("id"), "root")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each group of near texts: that of the smallest doc_id, a null one
    last; then the first by the text's hash, then by the text. Each row is judged by
    itself, so one that repeats an id with another text is not lost with it."""
    own = common.free_name(docs, "_near")
    of, root, place = f"{own}_of", f"{own}_root", f"{own}_place"
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.withColumn(of, F.xxhash64(F.coalesce("text", F.lit(""))))
    near = common.cut(near_texts(rows.select(F.col(of).alias("id"), "text"), least))
    # texts that have a copy or a near one; for others there is nothing to decide
    texts = rows.groupBy(F.col(of).alias("id")).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")).join(near, "id", "left").withColumn("root", F.coalesce("root", "id"))
    texts = common.cut(texts)
    first = texts.groupBy("root").agg(F.min(F.struct("least", "id")).alias("first"), F.sum("n").alias("all")).filter("all > 1")
    crowded = common.stash(texts.join(first, "root").select(F.col("id").alias(of), F.lit(True).alias(root), F.when(F.col("first.id") == F.col("id"), F.col("first.least")).alias(place)))
    both = rows.join(crowded, of, "left")
    alone = both.filter(F.col(root).isNull()).select(*(rows[c] for c in docs.columns))
    chosen = both.filter(F.col(root) & (F.col(place) == key))
    nth = F.row_number().over(Window.partitionBy(of, place).orderBy("text"))
    return alone.unionByName(chosen.withColumn(root, nth == 1).filter(F.col(root)).select(*(F.col(f"`{c}`") for c in docs.columns)))
