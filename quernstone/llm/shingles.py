"""Word sequences of texts as hashed sets, a batch of texts at a time in NumPy, and exact Jaccard similarity of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.delivery import BLOCK_BYTES, BLOCK_ROWS

#: Near-duplicates share this many words in a row, and this share of all such sequences, unless a query states others.
WORDS, SIMILARITY = 5, 0.8
#: Bits that tell sequences apart, among them those of the middle word, and texts and characters that are worked on at once.
HASH_BITS, ANCHOR_BITS = 51, 16
_DOCS, _CHARS = 1 << (64 - HASH_BITS), 1 << 20
#: Texts that are sampled at once: as many as the processor's caches hold.
_CHUNK = 1024
#: Bytes of a filter of identifiers that may be broadcast.
FILTER_BYTES = 16 << 20

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Sets:
    """Distinct sequences of each text: ``hashes``, the same before mixing and ascending within a text (``raw``), ``anchors`` (hash
    of the middle word), ``doc`` (number of the text) and ``sizes`` (how many each text has)."""

    hashes: np.ndarray
    raw: np.ndarray
    anchors: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def taken(self, docs: np.ndarray) -> Sets:
        """The sets of these texts, in this order, repeated where they are."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[:-1][docs] - (ends - sizes), sizes)
        return Sets(self.hashes[at], self.raw[at], self.anchors[at], np.repeat(np.arange(len(docs)), sizes), sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over each text's sequences."""
        out = np.zeros(len(self.sizes), values.dtype)
        some = self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.starts[:-1][some])
        return out

    def fingerprints(self, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
        """One number per text that equal sets share; order and repeats of sequences play no part. Another ``salt``, another number."""
        return mix(self.sums(mix(self.hashes ^ np.uint64(salt))) + self.sizes.astype(np.uint64))

    def samples(self, cells: int, salt: int = 1) -> np.ndarray:
        """``cells`` (a power of two) numbers per text; each is equal in two texts with a chance of their similarity, at any size.

        Round r throws every sequence into one cell by a hash of its own; a cell keeps the least sequence of the first round that
        reaches it. So it holds the least of all (round, hash) over the set, a minwise sample, for about as much work as the set is
        large. Cells still empty after as many rounds as cells are filled one by one. Zeros for empty sets.
        """
        out = np.zeros((len(self.sizes), cells), np.uint64)
        for begin in range(0, len(self.sizes), _CHUNK):
            end = min(begin + _CHUNK, len(self.sizes))
            x, y = self.starts[begin], self.starts[end]
            out[begin:end] = _sampled(self.hashes[x:y], self.doc[x:y] - begin, end - begin, cells, salt)
        return out

    def sketches(self, salt: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Two times 64 bits per text, one of each of 128 samples; see ``sketch_distance``."""
        bits = mix(self.samples(128, salt)) >> np.uint64(63)
        return tuple((bits[:, i : i + 64] << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for i in (0, 64))

    def parities(self) -> pa.ListArray:
        """For each text a field of bits, of which each sequence turns one; at least 1.5 bits a sequence, in words of 64.

        Two texts differ in at least as many sequences as their fields differ in bits; see ``may_reach``.
        """
        words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(1.5 * self.sizes / 64, 1))).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(words)])
        at = offsets[self.doc] * 64 + ((self.hashes >> np.uint64(13)) & (words[self.doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(at, minlength=int(offsets[-1]) * 64) & 1).astype(np.uint8)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def _sampled(hashes: np.ndarray, doc: np.ndarray, n: int, cells: int, salt: int) -> np.ndarray:
    out, empty = np.zeros(n * cells, np.uint64), np.ones(n * cells, bool)
    width = cells.bit_length() - 1
    place_bits = _CHUNK.bit_length() - 1 + width  # the same for few texts as for many, or samples would not agree
    rng = np.random.default_rng(salt)
    for turn in range(2 * cells):
        if not len(hashes):
            break
        odd, shift = rng.integers(0, 2**63, 2, dtype=np.uint64)
        thrown = (hashes ^ shift) * (odd | np.uint64(1))
        place = doc * cells + ((thrown >> np.uint64(64 - width)).astype(np.int64) if turn < cells else turn - cells)
        new = empty[place]
        # one number to sort by: cell, then hash
        packed = np.sort(place[new].astype(np.uint64) << np.uint64(64 - place_bits) | (thrown[new] << np.uint64(width)) >> np.uint64(place_bits))
        place = (packed >> np.uint64(64 - place_bits)).astype(np.int64)
        first = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
        out[place[first]] = (packed[first] << np.uint64(place_bits)) + np.uint64(turn + 1)
        empty[place[first]] = False
        left = empty.reshape(n, cells).any(axis=1)[doc]
        if not left.all():
            hashes, doc = hashes[left], doc[left]
    return out.reshape(n, cells)


def sketch_distance(similarity: float, deviations: float = 4.5) -> int:
    """Bits in which the sketches of two texts of this similarity may differ, but for so many standard deviations (4.5: one pair in 300,000)."""
    differ = (1 - similarity) / 2
    return int(128 * differ + deviations * (128 * differ * (1 - differ)) ** 0.5 + 1)


def may_reach(x: str, y: str, similarity: float) -> Column:
    """False only where the sizes ``n_{x,y}`` and the bits ``odd_{x,y}`` rule out that two texts reach ``similarity``."""
    a, b = F.col(f"odd_{x}"), F.col(f"odd_{y}")
    a, b = F.when(F.size(a) < F.size(b), b).otherwise(a), F.when(F.size(a) < F.size(b), a).otherwise(b)
    half = F.size(b)
    folded = F.when(F.size(a) == half, a).otherwise(F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda v, w: v.bitwiseXOR(w)))
    apart = F.aggregate(F.zip_with(folded, b, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, v: s + v)
    total = F.col(f"n_{x}") + F.col(f"n_{y}")
    sizes = F.least(f"n_{x}", f"n_{y}") >= similarity * F.greatest(f"n_{x}", f"n_{y}") - 1e-9
    # fields more than twice as long are of texts too far apart in size, or the similarity asked for is very low
    return sizes & ((F.size(a) > 2 * half) | (apart <= total * ((1 - similarity) / (1 + similarity)) + 1e-9))


def _alphanumeric() -> np.ndarray:
    """For every code point, whether it is a letter or digit."""
    global _table
    if _table is None:
        _table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _table


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, the longest runs of letters and digits of the lower-cased texts, and how many each text has.

    A word's hash is a polynomial in its code points, had from one running sum over all texts.
    """
    lowered = [t.lower() if t else "" for t in texts]
    code = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _alphanumeric()[code]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _powers(n + 1)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((code + np.uint32(1)) * up[:n], out=running[1:])
    hashes = mix((running[last] - running[first]) * down[first] + (last - first).astype(np.uint64))
    ends = np.cumsum(np.array([len(t) + 1 for t in lowered]))
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(first, ends)]))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _up, _down
    if len(_up) < n:
        _up, _down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)])) for base in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))))
    return _up, _down


_ODD = 0x9E3779B97F4A7C15
_table: np.ndarray | None = None
_up = _down = np.empty(0, np.uint64)


def sequence_sets(texts: list[str | None], words: int) -> Sets:
    """Sets of all sequences of ``words`` words. Null texts and texts with fewer words have empty sets."""
    parts, chars, begin = [], 0, 0
    for i, t in enumerate(texts):
        if i - begin >= _DOCS or chars > _CHARS:
            parts.append((begin, i))
            begin, chars = i, 0
        chars += len(t or "")
    parts.append((begin, len(texts)))
    done = [_sets(texts[x:y], words) for x, y in parts]
    if len(done) == 1:
        return done[0]
    return Sets(*(np.concatenate([getattr(d, c) + (x if c == "doc" else 0) for d, (x, _) in zip(done, parts)]) for c in ("hashes", "raw", "anchors", "doc", "sizes")))


def _sets(texts: list[str | None], words: int) -> Sets:
    w, counts = word_hashes(texts)
    n = len(w) - words + 1
    if n <= 0:
        return Sets(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64))
    doc_of_word = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    h = w[:n].copy()
    for j in range(1, words):
        h = mix(h + np.uint64(_ODD)) ^ w[j : j + n]
    h = mix(h)
    doc = doc_of_word[:n]
    middle = words // 2
    # one number to sort by: text, sequence, middle word
    key = doc << np.uint64(HASH_BITS) | (h >> np.uint64(64 - HASH_BITS + ANCHOR_BITS)) << np.uint64(ANCHOR_BITS) | w[middle : middle + n] >> np.uint64(64 - ANCHOR_BITS)
    key = np.sort(key[doc == doc_of_word[words - 1 :]])
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    own = key & np.uint64((1 << HASH_BITS) - 1)
    return Sets(mix(own), own, own & np.uint64((1 << ANCHOR_BITS) - 1), doc, np.bincount(doc, minlength=len(texts)).astype(np.int64))


def jaccard(left: Sets, right: Sets) -> np.ndarray:
    """Similarity of the i-th text on either side; 0 where both are empty."""
    doc = np.concatenate([left.doc, right.doc])
    h = np.concatenate([left.hashes, right.hashes])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    both = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    shared = np.bincount(doc[both], minlength=len(left.sizes))
    union = left.sizes + right.sizes - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def keep_listed(df: DataFrame, key: str, listed: DataFrame, column: str) -> DataFrame:
    """``df`` without most rows whose ``key`` isn't in ``listed[column]``; drops none that is.

    A filter of one hash with 16 bits an identifier, broadcast in blocks. Beyond ``FILTER_BYTES`` ``df`` comes back as it is;
    the join that follows decides either way.
    """
    n = listed.count()
    bits = max(1, n) * 16
    if bits // 8 > FILTER_BYTES:
        return df
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    blocks = listed.groupBy(F.bitmap_bucket_number(place(F.col(column))).alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col(column)))).alias("__bits"))
    assert BLOCK_BYTES * 8 == BLOCK_ROWS
    marked = df.withColumn("__place", place(F.col(key))).withColumn("__block", F.bitmap_bucket_number("__place"))
    marked = marked.join(F.broadcast(blocks), "__block")
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(df.columns)


def _named_sets(batch: pa.RecordBatch, side: str, words: int) -> Sets:
    """Sets of the texts of one side; a text that stands in several pairs of the batch is cut into words once."""
    ids = batch.column(side).dictionary_encode().indices.to_numpy()
    _, first, which = np.unique(ids, return_index=True, return_inverse=True)
    return sequence_sets(batch.column(f"text_{side}").take(pa.array(first)).to_pylist(), words).taken(which)


def verified(pairs: DataFrame, texts: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose texts reach ``similarity``, with ``jaccard``. ``texts`` has one row for each key that ``pairs`` names.

    Only texts that some pair names are moved, then pairs with both texts; the sets are built anew and compared exactly.
    """
    named = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = keep_listed(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", named, "key")
    one = pairs.join(wanted.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(wanted.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (_named_sets(batch, c, words) for c in "ab")
            score = jaccard(left, right)
            keep = pa.array(score >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)], names=["a", "b", "jaccard"]).filter(keep)

    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, jaccard double")
