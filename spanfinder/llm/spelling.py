"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

Of two near words of different lengths the longer becomes the shorter by one deletion, and of two of the same length the one with
the smaller letter becomes the other by one replacement, so deletions and replacements by greater letters reach every pair
once. An edit's hash follows from the word's hash without building the edit. It is probed in blocked Bloom filters (one 64-bit block
a probe), one for each length of word; only edits that may be words are built and shuffled to an exact join with the
vocabulary, which removes the false positives. Words chain to their forms, and roots are found by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix
from .tables import keep, small_batches

U = np.uint64
HELD = 1 << 18  # distinct words a task counts before it sends them on
KEYS_PER_BLOCK = 4
BITS = 5
WORDS_A_PASS = 1 << 24  # words of one set of filters: 32 MB
LONGEST_SHARD = 48  # longer words share one filter
AT_ONCE = 1 << 19  # edits held at once
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # U+00C0 to U+00FF are the bytes C3 80 to C3 BF
_BASE = 0x9E3779B97F4A7C15
_LETTER = mix(np.arange(1, 257, dtype=np.uint64))  # all letters are below U+0100


def written(run: bytes, key: int, every: int) -> bytes:
    """The run, less code point key % length if `every` divides the key."""
    if key % every:
        return run
    letters = run.decode()
    at = key % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def vocabulary(docs: DataFrame, id_col: str, text_col: str, every: int, least_letters: int, least_count: int) -> DataFrame:
    """(word, n) of the words of all texts, counted in the tasks before they are shuffled."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(m.group() for m in _RUN.finditer(text.as_buffer().to_pybytes().lower())).items():
                    word = written(run, zlib.crc32(run, start), every)
                    if len(word) - word.count(b"\xc3") >= least_letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield send()
        yield send()

    texts = docs.select(name, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length as a matrix."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(n)], np.uint64)


def word_hashes(m: np.ndarray) -> np.ndarray:
    return mix((_LETTER[m] * _powers(m.shape[1])).sum(axis=1, dtype=np.uint64))


def deletions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the words without one letter; of a run of equal letters only the first goes."""
    n, size = m.shape
    power = _powers(size)
    run = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_LETTER[m] * power, axis=1, out=run[:, 1:])
    left_out = np.ones(m.shape, bool)
    left_out[:, 1:] = m[:, 1:] != m[:, :-1]
    row, at = np.nonzero(left_out)
    rest = (run[row, size] - run[row, at + 1]) * U(pow(_BASE, -1, 1 << 64))  # one place to the left
    return row, at, mix(run[row, at] + rest)


def replacements(m: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter, hash) of the words with one letter replaced by a greater one, some places at a time."""
    size, power = m.shape[1], _powers(m.shape[1])
    whole = (_LETTER[m] * power).sum(axis=1, dtype=np.uint64)
    flat = m.ravel()
    step = max(1, AT_ONCE // max(1, len(alphabet)))
    for lo in range(0, len(flat), step):
        old = flat[lo : lo + step]
        place, letter = np.nonzero(alphabet > old[:, None])
        row, at = np.divmod(place + lo, size)
        new = alphabet[letter]
        yield row, at, new, mix(whole[row] + (_LETTER[new] - _LETTER[old[place]]) * power[at])


class Filters:
    """Blocked Bloom filters of a vocabulary, one for each length of word, in one array of 64-bit blocks."""

    def __init__(self, counts: dict[int, int]):
        """counts: words by shard. The array has a block for KEYS_PER_BLOCK words, whatever the words are."""
        self.longest, at = LONGEST_SHARD, 0
        self.first, self.size = np.zeros(self.longest + 1, np.int64), np.zeros(self.longest + 1, np.int64)
        for shard, n in sorted(counts.items()):
            self.first[shard], self.size[shard] = at, -(-n // KEYS_PER_BLOCK)
            at += int(self.size[shard])
        self.n_blocks, self.blocks = at, None  # None until `fill`, so that tasks which set bits get the sizes alone

    def fill(self, block: np.ndarray, bits: np.ndarray) -> None:
        self.blocks = np.zeros(self.n_blocks, np.uint64)
        self.blocks[block] = bits

    def places(self, shard: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of every hash, and the bits it sets there."""
        block = self.first[shard] + (((h >> U(32)) * U(self.size[shard])) >> U(32)).astype(np.int64)
        bits = np.zeros(len(h), np.uint64)
        for i in range(BITS):
            bits |= U(1) << ((h >> U(6 * i)) & U(63))
        return block, bits

    def among(self, letters: int, h: np.ndarray) -> np.ndarray:
        """Which hashes may be of words of so many letters in the vocabulary; none of these is missed."""
        shard = min(letters, self.longest)
        if not self.size[shard]:
            return np.zeros(len(h), bool)
        block, bits = self.places(shard, h)
        return self.blocks[block] & bits == bits


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, words) of one length at a time, in portions of bounded size."""
    words = column.to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, AT_ONCE // int(n))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield part, [words[i] for i in part]


def filters_of(words: DataFrame, turn: int, turns: int) -> Filters:
    """Filters of the words whose hash falls to this turn. Blocks are set in the tasks and joined by bits; the driver gets them
    once, at most WORDS_A_PASS / KEYS_PER_BLOCK rows or little more."""
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    mine = words.where(F.pmod(F.col("h"), F.lit(turns)) == turn)
    out = Filters({r["shard"]: r["count"] for r in mine.groupBy(shard.alias("shard")).count().collect()})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, kind = batch.column("h").to_numpy().view(np.uint64), batch.column("shard").to_numpy()
            for s in np.unique(kind):
                block, bits = out.places(int(s), h[kind == s])
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    set_bits = mine.select("h", shard.alias("shard")).mapInArrow(places, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.fill(set_bits["block"].to_numpy(), set_bits["bits"].to_numpy().view(np.uint64))
    return out


def hashed(words: DataFrame) -> DataFrame:
    """Add the hash `h` to words(word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, np.uint64)
            for rows, part in _by_length(batch.column("word")):
                h[rows] = word_hashes(letters_of(part))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "h"])

    return words.mapInArrow(run, "word string, n long, h long")


def candidates(words: DataFrame, filters: Filters, alphabet: np.ndarray, turn: int, turns: int) -> DataFrame:
    """(word, n, near): edits of the words that the filters let through."""
    shared = words.sparkSession.sparkContext.broadcast((filters, alphabet))

    def passed(filters: Filters, size: int, h: np.ndarray) -> np.ndarray:
        mine = np.mod(h.view(np.int64), turns) == turn if turns > 1 else np.ones(len(h), bool)
        mine[mine] = filters.among(size, h[mine])
        return np.flatnonzero(mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, alphabet = shared.value

        def send(batch: pa.RecordBatch, rows: np.ndarray, edited: np.ndarray) -> pa.RecordBatch:
            size = edited.shape[1]
            letters = edited.tobytes().decode("latin-1")
            near = [letters[i : i + size] for i in range(0, len(letters), max(1, size))]
            at = pa.array(rows)
            return pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array(near, pa.string())], ["word", "n", "near"])

        for batch in batches:
            for rows, part in _by_length(batch.column("word")):
                m = letters_of(part)
                row, at, h = deletions(m)
                hit = passed(filters, m.shape[1] - 1, h)
                others = np.arange(m.shape[1]) != at[hit, None]
                yield send(batch, rows[row[hit]], m[row[hit]][others].reshape(len(hit), m.shape[1] - 1))
                for row, at, new, h in replacements(m, alphabet):
                    hit = passed(filters, m.shape[1], h)
                    edited = m[row[hit]]
                    edited[np.arange(len(hit)), at[hit]] = new[hit]
                    yield send(batch, rows[row[hit]], edited)

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of forms(word, form): the last word that forms lead to, by pointer doubling.

    A form occurs at least twice as often as its word, so chains have no loops; their lengths halve in every round.
    """
    at = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = keep(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("more")), "roots")
        at = moved.select("word", "root")
        if not moved.where("more").limit(1).count():
            return at


def group(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    every: int = 97,
    least_letters: int = 5,
    least_count: int = 3,
    ratio: int = 2,
    words_a_pass: int = WORDS_A_PASS,
) -> DataFrame:
    """The vocabulary of all texts with each word's form and root -> (word, form, root, n, n_near, form_n).

    Words are runs of Latin letters (A to Z lower-cased); where `every` divides the checksum of `<id>:<run>` a letter is left
    out, as a slip of the pen would. Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, ties to the smallest, if that n is `ratio` times its own or more. Null texts have no words, a null id counts as empty, repeated rows count
    each time. An empty table gives no rows; other columns of docs are not used.
    """
    small_batches(docs.sparkSession)
    words = keep(hashed(vocabulary(docs, id_col, text_col, every, least_letters, least_count)), "vocabulary")
    turns = max(1, -(-words.count() // words_a_pass))
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().where("letter <> ''")
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters.collect()), np.uint8)  # at most 90
    pairs = None
    for turn in range(turns):
        found = candidates(words, filters_of(words, turn, turns), alphabet, turn, turns)
        real = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        pairs = real if pairs is None else pairs.unionByName(real)
    pairs = keep(pairs.select("word", "n", "near", "near_n"), "near")
    both = pairs.select("word", "near", "near_n").unionAll(pairs.select("near", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    formed = F.col("near_n") >= ratio * F.col("n")
    out = keep(out.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    last = roots(out.where("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
