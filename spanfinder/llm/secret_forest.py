"""Secret scan: wide candidate search, then a random forest that removes false positives.

Candidates are long unbroken runs of key-like characters, and values that follow an assignment. The forest (Spark's own)
judges each by its length, transitions between kinds of characters, how much of it common words cover, the path around it
and the neighbouring words. It is trained on labelled findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import keep, small_batches

LONG = 16
TREES, DEPTH, MOST_LABELLED, SEED = 40, 8, 20_000, 6
SECRET = 0.5
DICTIONARY, COUNTED = 1 << 14, 1 << 18
MASK = "[SECRET]"
FEATURES = ["length", "transitions", "digits", "upper", "entropy", "dictionary", "vowels", "in_path", "assigned", "quoted", "keyword", "prefix", "known_neighbours"]

# Words that name credentials, and prefixes that issuers give them.
KEYWORDS = ("api", "apikey", "auth", "authorization", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "SG.", "eyJ")

_RUN = np.zeros(256, bool)
_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.~", np.uint8)] = True
_ASSIGNED = re.compile(rb"""(?i)\b[a-z_-]*(?:%s)[a-z_-]*["']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}["']?([^\s"',;]{8,})""" % "|".join(KEYWORDS).encode())
_KIND = np.zeros(256, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_WORDS = re.compile(rb"[A-Za-z]{3,24}")


def spans(raw: bytes, data: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of the candidates of one text, without overlaps; assigned ones come first."""
    found = [(m.start(1), m.end(1), True) for m in _ASSIGNED.finditer(raw)] if b"=" in raw or b":" in raw else []
    flags = _RUN[data]
    if len(flags) >= LONG:
        edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        for at in np.flatnonzero(end - start >= LONG):
            s, e = int(start[at]), int(end[at])
            body = raw[s:e].strip(b".=-/_~")
            s += raw[s:e].find(body)
            e = s + len(body)
            kinds = np.unique(_KIND[data[s:e]])
            # one kind of letters alone is a word, however long; other long runs are left to the forest
            if e - s >= LONG and (1 in kinds or 2 in kinds and 3 in kinds) and not any(s < y and x < e for x, y, _ in found):
                found.append((s, e, False))
    return sorted(found)


def features(raw: bytes, data: np.ndarray, start: int, end: int, assigned: bool, common: set[bytes]) -> list[float]:
    own, n = raw[start:end], end - start
    kind = _KIND[data[start:end]]
    counts = np.unique(data[start:end], return_counts=True)[1] / n
    words = [m.group().lower() for m in _WORDS.finditer(own)]
    before, after = raw[max(0, start - 48) : start], raw[end : end + 24]
    near = [w.lower() for w in before.split()[-4:] + after.split()[:2]]
    line = raw[max(0, raw.rfind(b"\n", 0, start)) : start].lower()
    return [
        float(n),
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        float((kind == 1).mean()),
        float((kind == 2).mean()),
        float(-(counts * np.log2(counts)).sum()),
        sum(len(w) for w in words if w in common) / n,
        sum(own.lower().count(c) for c in (b"a", b"e", b"i", b"o", b"u")) / n,
        float(b"/" in own or before[-1:] in (b"/", b"\\") or b"://" in before),
        float(assigned or bool(re.search(rb"[:=][ \t]{0,3}[\"']?$", before))),
        float(before[-1:] in (b'"', b"'", b"`")),
        float(any(k.encode() in line[-48:] for k in KEYWORDS)),
        float(own.decode("utf-8", "replace").startswith(PREFIXES)),
        sum(re.sub(rb"\W", b"", w) in common for w in near) / max(len(near), 1),
    ]


def _scan(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, value, line, x = [], [], [], [], []
            for lo, hi, data, off in A.blocks(batch["text"]):
                raw = data.tobytes()
                for i in range(hi - lo):
                    a, b = int(off[i]), int(off[i + 1])
                    own, bytes_ = raw[a:b], data[a:b]
                    for s, e, assigned in spans(own, bytes_):
                        ids.append(lo + i), at.append((s, e, assigned)), value.append(own[s:e].decode("utf-8", "replace"))
                        line.append(own[max(0, s - 48) : s].decode("utf-8", "replace"))
                        x.append(features(own, bytes_, s, e, assigned, common.value))
            columns = [pa.array([row[k] for row in x], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(ids, pa.int64())), batch["key"].take(pa.array(ids, pa.int64())), pa.array([s for s, _, _ in at], pa.int64()), pa.array([e for _, e, _ in at], pa.int64()), pa.array([f for *_, f in at], pa.bool_()), pa.array(value, pa.string()), pa.array(line, pa.string()), *columns],
                ["doc_id", "key", "start", "end", "by_name", "value", "before", *FEATURES],
            )

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of this task's texts each word is; counts are sent on whole whenever COUNTED words are held."""
    counts: dict[bytes, int] = {}

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for _, _, data, off in A.blocks(batch["text"]):
            raw = data.tobytes()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                for w in {x.strip(b".,;:!?\"'()|").lower() for x in raw[a:b].split()}:
                    if 3 <= len(w) <= 24:
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) >= COUNTED:
                yield send()
    yield send()


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: doc_id, key of the text's row, start and end byte, value, 48 bytes before, FEATURES."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    counts = keep(docs.select("text").mapInArrow(_common, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "secret-words")
    # the count that DICTIONARY words reach tells which rows may be among the first ones, so that few are sent to be ordered
    upto, bar = 0, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(DICTIONARY).collect():
        upto, bar = upto + r["count"], r["n"]
        if upto >= DICTIONARY:
            break
    words = counts.where(F.col("n") >= bar).orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()  # a dictionary of fixed size
    common = spark.sparkContext.broadcast({bytes(r["word"]) for r in words})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_scan(common), f"doc_id {kind}, key long, start long, end long, by_name boolean, value string, before string, " + ", ".join(f"{f} double" for f in FEATURES))


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels for findings where no reviewer gave any: 1 for issued prefixes and for random-looking values that are assigned to a
    credential's name, 0 for values away from such names that have no prefix; others stay unlabelled (null)."""
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("entropy") >= 3)
    named = (F.col("keyword") == 1) & (F.col("assigned") == 1)
    sure = (F.col("prefix") == 1) & mixed | named & mixed & (F.col("length") >= LONG)
    return found.withColumn("label", F.when(sure, 1).when((F.col("keyword") == 0) & (F.col("prefix") == 0), 0).cast("double"))


def judge(found: DataFrame, labelled: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """`found` with score (probability of a true secret) and is_secret; `labelled` has FEATURES and label (0, 1, or null: unused).

    The forest is fitted on about `most_labelled` labelled findings, drawn by hash. Where labels of one kind or none exist,
    there is nothing to learn and the score is 1 for values assigned to a credential's name or with an issued prefix, else 0.
    """
    known = labelled.where("label IS NOT NULL")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    if set(counts) < {0.0, 1.0}:
        plain = (F.col("keyword") * F.col("assigned") > 0) | (F.col("prefix") > 0)
        return found.withColumn("score", plain.cast("double")).withColumn("is_secret", F.col("score") >= SECRET)
    share = {y: min(1.0, most_labelled / 2 / n) for y, n in counts.items()}
    drawn = known.where(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 30)) < F.when(F.col("label") == 1, share[1.0]).otherwise(share[0.0]) * (1 << 30))
    pack = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y")
    model = forest.fit(pack.transform(drawn.select("label", *FEATURES)))
    scored = model.transform(pack.transform(found)).withColumn("score", vector_to_array("_p")[1])
    return scored.drop("_x", "_p", "_r", "_y").withColumn("is_secret", F.col("score") >= SECRET)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates of all whole texts, judged: doc_id, key, start, end (bytes), value, before, FEATURES, score, is_secret.

    `labelled`: findings with FEATURES and label; without it the findings are labelled by `weak_labels`. Null and empty texts
    have no findings; a text is scanned as often as its row occurs. Null ids are kept. Other columns are not read.
    """
    found = keep(candidates(docs, id_col, text_col), "secret-candidates")
    return judge(found, weak_labels(found) if labelled is None else labelled)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("text") if at is None else at
        out = []
        for text, cuts in zip(batch["text"].to_pylist(), batch["_cuts"].to_pylist(), strict=True):
            if cuts:
                raw = text.encode()
                for a, b in sorted({(c["start"], c["end"]) for c in cuts}, reverse=True):
                    raw = raw[:a] + MASK.encode() + raw[b:]
                text = raw.decode("utf-8", "replace")
            out.append(text)
        columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns[:-1], batch.schema.names[:-1])


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and others) with the secrets of `found` replaced by MASK; all rows stay."""
    key = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    cuts = found.where("is_secret").groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("_cuts"))
    joined = docs.withColumn("_key", key).join(cuts.withColumnRenamed("key", "_key"), "_key", "left").select(*docs.columns, "_cuts")
    return joined.mapInArrow(_mask, docs.schema)
