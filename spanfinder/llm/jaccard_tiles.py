"""Exact Jaccard join of word n-gram sets in size-banded tiles.

Texts with equal sets form one class. A class is put into tiles by (shingle, size band): by those of its shingles that
come first in one fixed order, as many as a partner within the threshold cannot all miss, and by the bands that a partner's
size may have. The order puts shingles that are known to be shared last, so that texts without a partner meet few others. Within a tile the classes are ordered by size and compared by bitmaps: bit i is the parity of the shingles
that hash to i, so the bits that differ are at most as many as the shingles that do, which bounds the overlap from above.
Pairs that pass are settled by intersecting the exact sorted arrays.

Components need no link between classes that are known to be connected. So each round asks every class in a tile for its
nearest partners in other components only, settles those pairs and merges; the last round leaves none out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .bitmaps import among, bitmap_of
from .components import components
from .tables import keep, small_batches

WORDS, NUM, DEN = 3, 90, 100
HOT_SHARE, HOT_MOST = 1 / 1000, 1 << 16
TILE, STRETCH = 2048, 1.5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer than k words has its whole sequence, an empty one none."""
    data = _LOWER[data]
    start, end, woff = A.words(data, off)
    h = A.word_hash(data, start, end)
    run = A.run_of_words(h)
    full = A.sequence_hash(run, np.arange(max(len(h) - k + 1, 0)), np.arange(k, len(h) + 1)) if len(h) >= k else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(A.sequence_hash(run, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """Hash of a whole set, as a signed number."""
    with np.errstate(over="ignore"):
        x = A.mix(np.array([A.mix(s).sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(A.mix(s + np.uint64(77))) if len(s) else np.uint64(0))], np.uint64) + np.uint64(len(s)))
    return int(x.view(np.int64)[0])


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def _describe(k: int):
    """Two kinds of rows: a text with its set's size and class; a shingle that many texts of this block have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[int, int] = {}
        for batch in batches:
            n, c = [], []
            for _, _, data, off in A.blocks(batch["text"]):
                sets = shingle_sets(data, off, k)
                n += [len(s) for s in sets]
                c += [class_of(s) for s in sets]
                u, m = np.unique(np.concatenate(sets), return_counts=True)
                hot = m >= max(3, HOT_SHARE * len(sets))
                for x, y in zip(A.signed(u[hot]).tolist(), m[hot].tolist(), strict=True):
                    common[x] = common.get(x, 0) + y
                if len(common) > HOT_MOST:
                    low = sorted(common.values())[len(common) // 2]
                    common = {x: y for x, y in common.items() if y > low}
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "n", "c"])
        some = sorted(common.items(), key=lambda kv: (-kv[1], kv[0]))[: HOT_MOST // 8]
        if some:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array([-y for _, y in some], pa.int64()), pa.array([x for x, _ in some], pa.int64())], ["doc_id", "n", "c"])

    return run


class Order:
    """The fixed order of shingles: those not known to be shared, those that are, those of very many texts; then by hash."""

    def __init__(self, hot: np.ndarray, shared: np.ndarray | None = None):
        self.hot, self.shared = hot, shared

    def prefix(self, s: np.ndarray, num: int, den: int, stretch: float = 1.0) -> np.ndarray:
        """The shingles of which a partner must share one, or some more."""
        least = -(-num * len(s) // den)  # of a set of n, a partner shares at least num * n / den
        p = min(len(s), int(np.ceil(stretch * (len(s) - least + 1))))
        late = np.zeros(len(s), np.int8)
        if self.shared is not None:
            late[among(self.shared, s)] = 1
        if len(self.hot):
            late[self.hot[np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)] == s] = 2
        out = s[late == 0][:p]
        return out if len(out) == p else np.r_[out, s[late == 1], s[late == 2]][:p]


def _keys(k: int, num: int, den: int, hot, shared=None, stretch: float = 1.0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in A.blocks(batch["text"]):
                sets = [s for s in shingle_sets(data, off, k) if len(s)]
                order = Order(hot.value, shared.value if shared else None)
                parts = [order.prefix(s, num, den, stretch) for s in sets]
                if parts:
                    c = np.repeat([class_of(s) for s in sets], [len(p) for p in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(A.signed(np.concatenate(parts))), pa.array(c)], ["key", "c"])

    return run


def band_of(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sizes of one band or of neighbouring bands hold all partners of a size."""
    return np.floor(np.log(n) / np.log(den / num * 1.0001)).astype(np.int64)


def bits_of(band: int, num: int, den: int) -> int:
    """Bits of a tile's bitmaps: enough for the sets that differ just too much to differ visibly."""
    top = (den / num * 1.0001) ** (band + 1)
    most = 2 * top * (den - num) / (den + num) + 1
    return int(min(max(256, 1 << int(np.ceil(np.log2(3 * most)))), 1 << 16))


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((s >> np.uint64(13)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def _members(k: int, num: int, den: int, hot, shared, several):
    """A row for each class, tile key and band that may hold a partner; the first of a text's in a band has its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in A.blocks(batch["text"]):
                key, n, c, band, sign = [], [], [], [], []
                order = Order(hot.value, shared.value)
                for s in shingle_sets(data, off, k):
                    if not len(s):
                        continue
                    p = order.prefix(s, num, den)
                    p = p[among(several.value, p)]
                    if not len(p):
                        continue
                    b = int(band_of(np.array([len(s)]), num, den)[0])
                    for at in (b, b + 1):
                        key.append(p), n.append(len(s)), c.append(class_of(s)), band.append(at)
                        sign.append(signature(s, bits_of(at, num, den)).tobytes())
                if key:
                    m = [len(p) for p in key]
                    own = np.repeat(np.arange(len(m)), m)
                    given = ((band, pa.int32()), (c, pa.int64()), (n, pa.int32()))
                    once = pa.array(own, mask=np.r_[False, own[1:] == own[:-1]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(A.signed(np.concatenate(key))), *(pa.array(v, k).take(pa.array(own)) for v, k in given), pa.array(sign, pa.binary()).take(once)],
                        ["key", "band", "c", "n", "sign"],
                    )

    return run


def _allowed(t: np.ndarray, n: np.ndarray, comp: np.ndarray, sign: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """(i, j, bits that differ) of all pairs of a tile's rows, ordered by size, that the bitmaps allow and that are apart."""
    got = [(np.zeros(0, np.int64),) * 3]
    here, step = np.arange(len(t)), 0
    while len(here):
        step += 1
        here = here[here + step < len(t)]
        here = here[(t[here] == t[here + step]) & (den * n[here] >= num * n[here + step])]
        at = here[comp[here] != comp[here + step]]
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            x = np.bitwise_count(sign[i] ^ sign[i + step]).sum(1, dtype=np.int64)
            both = (n[i] + n[i + step] - x) // 2
            ok = den * both >= num * (n[i] + n[i + step] - both)
            got.append((i[ok], i[ok] + step, x[ok]))
    return tuple(np.concatenate(v) for v in zip(*got, strict=True))


def _nearest(own: np.ndarray, group: np.ndarray, x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` nearest of their row and group."""
    order = np.lexsort((c, x, group, own))
    new = np.r_[True, (own[order][1:] != own[order][:-1]) | (group[order][1:] != group[order][:-1])][: len(order)]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(own), bool)
    out[order[rank < most]] = True
    return out


def _partners(num: int, den: int, most: int):
    """Pairs of each tile, and the rows of the tiles that have more.

    A tile with few pairs gives all. Of others, in the first round (most = 0) each row gives its nearest one before it, later
    the `most` nearest in each other component; these tiles' rows go on to the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[dict]):
            key, band, sub, c, n, comp = (np.concatenate([p[k] for p in parts]) for k in ("key", "band", "sub", "c", "n", "comp"))
            sign = [s for p in parts for s in p["sign"]]
            new = np.r_[True, (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (sub[1:] != sub[:-1])]
            tile = np.cumsum(new) - 1
            size = np.array([len(s) for s in sign])
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                m = np.frombuffer(b"".join([sign[i] for i in at]), np.uint64).reshape(len(at), width // 8)
                i, j, x = _allowed(tile[at], n[at], comp[at], m, num, den)
                i, j = at[i], at[j]
                rows, pairs = np.bincount(tile, minlength=tile[-1] + 1), np.bincount(tile[i], minlength=tile[-1] + 1)
                many = pairs > 2 * rows
                take = ~many[tile[i]]
                if most:
                    take |= _nearest(i, comp[j], x, c[j], most) | _nearest(j, comp[i], x, c[i], most)
                else:
                    take |= _nearest(j, np.zeros(len(j), np.int64), x, c[i], 1)
                left = np.bincount(tile[i[~take]], minlength=tile[-1] + 1) > 0
                rest = at[left[tile[at]]]
                a, b = np.minimum(c[i[take]], c[j[take]]), np.maximum(c[i[take]], c[j[take]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[a, c[rest]]),
                        pa.concat_arrays([pa.array(b), pa.nulls(len(rest), pa.int64())]),
                        *(pa.concat_arrays([pa.nulls(len(a), k), pa.array(v[rest], k)]) for v, k in ((key, pa.int64()), (band, pa.int32()), (sub, pa.int32()), (n, pa.int32()))),
                        pa.concat_arrays([pa.nulls(len(a), pa.binary()), pa.array([sign[r] for r in rest], pa.binary())]),
                    ],
                    ["a", "b", "key", "band", "sub", "n", "sign"],
                )

        parts: list[dict] = []
        held = 0
        for batch in batches:
            p = {k: batch[k].to_numpy() for k in ("key", "band", "sub", "c", "n", "comp")} | {"sign": batch["sign"].to_pylist()}
            if not len(p["c"]):
                continue
            p["n"] = p["n"].astype(np.int64)
            # rows of the last tile wait for the next batch
            same = (p["key"] == p["key"][-1]) & (p["band"] == p["band"][-1]) & (p["sub"] == p["sub"][-1])
            last = int(np.argmax(same))
            before = parts[-1] if parts else None
            new = before is not None and any(before[k][-1] != p[k][0] for k in ("key", "band", "sub"))
            if held + last >= 4096 and (last or new):
                yield from flush([*parts, {k: v[:last] for k, v in p.items()}] if last else parts)
                parts, held = [], 0
                p = {k: v[last:] for k, v in p.items()}
            parts.append(p)
            held += len(p["c"])
        if parts:
            yield from flush(parts)

    return run


def _settle(k: int, num: int, den: int):
    def one_set(text: pa.Array) -> list[np.ndarray]:
        return [s for *_, data, off in A.blocks(text) for s in shingle_sets(data, off, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = one_set(batch["text_a"]), one_set(batch["text_b"])
            ok = [linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), num, den) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _own_class(k: int):
    """Texts whose set is still of the class that asked for them (ids may repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [class_of(s) for *_, data, off in A.blocks(batch["text"]) for s in shingle_sets(data, off, k)]
            ok = np.array(c, np.int64) == batch["c"].to_numpy()
            yield batch.filter(pa.array(ok))

    return run


def _text_class(k: int):
    """The class of every text, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [class_of(s) for *_, data, off in A.blocks(batch["text"]) for s in shingle_sets(data, off, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), batch["text"]], ["c", "text"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Components of documents whose sets of `words`-word shingles have a Jaccard similarity of num/den or more.

    A-Z are lower-cased. Returns doc_id, n_shingles, class_id (smallest id with the same set) and component_id (smallest id
    reachable over links, the document's own included), a row for each row of `docs`. Null and empty texts, and those
    without words, have no shingles and link to nothing. Rows with a null id take part; a null never is a component's id
    unless all its ids are null. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = docs.select("text")
    seen = keep(docs.mapInArrow(_describe(words), "doc_id long, n long, c long"), "jaccard-classes")
    own = seen.where("n >= 0")
    top = seen.where("n < 0").groupBy("c").agg(F.sum("n").alias("n")).orderBy("n", "c").limit(HOT_MOST).toArrow()  # orders shingles; decides no result
    hot = spark.sparkContext.broadcast(np.sort(top["c"].to_numpy().astype(np.int64).view(np.uint64)))
    classes = keep(own.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep")), "jaccard-reps")

    def held_by_several(run) -> DataFrame:
        keys = text.mapInArrow(run, "key long, c long")
        return keep(keys.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key"), "jaccard-keys")

    # a first look at somewhat longer prefixes tells most shared shingles; with these put last, few prefixes meet by chance
    shared = bitmap_of(held_by_several(_keys(words, num, den, hot, stretch=STRETCH)), "key")
    groups = held_by_several(_keys(words, num, den, hot, shared))
    several = bitmap_of(groups, "key")
    members = keep(text.mapInArrow(_members(words, num, den, hot, shared, several), "key long, band int, c long, n int, sign binary"), "jaccard-members")
    rows = keep(members.groupBy("key", "band", "c").agg(F.first("n").alias("n")), "jaccard-tiles")
    # tiles of one class are of no use; those of more than TILE are dealt over blocks, each pair of blocks a tile
    parts = rows.groupBy("key", "band").agg(F.count("*").alias("g")).where("g > 1").select("key", "band", F.ceil(F.col("g") / TILE).cast("int").alias("s"))
    block = F.pmod(F.xxhash64("c"), F.col("s")).cast("int")
    sub = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda i: F.least(block, i) * F.col("s") + F.greatest(block, i))
    signs = members.where("sign IS NOT NULL").groupBy("c", "band").agg(F.first("sign").alias("sign"))
    tiles = rows.join(parts, ["key", "band"]).withColumn("sub", F.explode(sub)).drop("s").join(signs, ["c", "band"])

    links = spark.createDataFrame([], "a long, b long")
    comp, most, told = None, 0, "a long, b long, key long, band int, sub int, n int, sign binary"
    while True:
        at = tiles.withColumn("comp", F.col("c")) if comp is None else tiles.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        dealt = at.repartition("key", "band", "sub").sortWithinPartitions("key", "band", "sub", "n", "c")
        out = keep(dealt.select("key", "band", "sub", "c", "n", "comp", "sign").mapInArrow(_partners(num, den, most), told), "jaccard-pairs")
        pairs = out.where("b IS NOT NULL").select("a", "b").distinct()
        tiles = out.where("b IS NULL").select("key", "band", "sub", F.col("a").alias("c"), "n", "sign")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes, "c")
        of_ids = docs.join(asked.withColumnRenamed("rep", "doc_id").where("doc_id IS NOT NULL"), "doc_id").select("c", "text").mapInArrow(_own_class(words), "c long, text string")
        # classes without any id have their texts among the rows without one
        of_nulls = docs.where("doc_id IS NULL").select("text").mapInArrow(_text_class(words), "c long, text string").join(asked.where("rep IS NULL").select("c"), "c", "left_semi")
        texts = keep(of_ids.unionByName(of_nulls).dropDuplicates(["c"]), "jaccard-texts")
        both = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
        found = keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_settle(words, num, den), "a long, b long"), "jaccard-links")
        if found.limit(1).count():
            links = links.unionAll(found)
            comp = components(links)
        if not tiles.limit(1).count():
            break
        most = 256 * most or 64
    if comp is None:
        comp = spark.createDataFrame([], "node long, comp long")
    named = classes.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = keep(named.join(least, "comp").select("c", F.col("rep").alias("class_id"), "component_id"), "jaccard-named")
    out = own.join(named, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
