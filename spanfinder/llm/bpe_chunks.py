"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, wherever that lies, even within a word or a character. A
chunk that several texts share is encoded once, in a table that the texts join. Encodings of neighbouring chunks differ from
that of the whole text only around their join: the tokenizer drops white space, so both agree from the last blank before
the join back and from the first blank behind it on. What lies between, over as many chunks as have no blank, is put together
and encoded again. The result is the encoding of the whole text, token by token.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .bitmaps import among, bitmap_of
from .tables import keep, small_batches

LOOK, CHUNK = 24, 1024
MEMO = 150_000
BLANKS = b" \t\n\r\x0b\x0c"
TAIL = b".,;:!?|"
PROBES = [w.encode() for w in ("a", "the", "Thnt", "réeux", "ÉTÉ", "ßen", "Ünd", "ñandoÿ", "ŁÓDŹ", "zzzzxqj")]
SPLIT_PROBES = [w + t for w in (b"World", b"USA", b"a", b"Q", b"Hello", b"iPhone15", b"X9y8Z", "réeux".encode(), "ÉTÉ".encode(), "straße".encode(), b"don't", b"x-y") for t in (b"", b",", b".", b"...", b"?!", b"|", b":;")]
# The characters that stand for bytes in byte-level BPE.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(0x100) if x not in _SHOWN)}

_coders: dict[str, "Coder"] = {}


class Coder:
    """Tokenizer of one vocabulary file with the words that this worker met lately."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(n)]
        self.number = [str(i) for i in range(n)]
        self.kind = np.uint16 if n <= 1 << 16 else np.uint32
        self.said: dict[bytes, tuple[int, str, str]] = {}
        self.old: dict[bytes, tuple[int, str, str]] = {}
        self.blank: set[bytes] = set()
        # words of Latin letters alone may go to the merges at once, if that is what the tokenizer does with them
        self.model = self.tokenizer.model
        alike = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids == [i for p in _parts(w) for i in self.tokenizer.encode(p.decode(), add_special_tokens=False).ids] for w in SPLIT_PROBES]
        self.splits = all(alike)  # a tokenizer that tells cases apart, or words with signs behind them, gets words as they are
        self.direct = all([t.id for t in self.model.tokenize(_plain(w))] == self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in PROBES)

    @classmethod
    def of(cls, spec: str) -> Coder:
        key = str(hash(spec))
        if key not in _coders:
            _coders[key] = cls(spec)
        return _coders[key]

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that are new to this worker, each by itself; words not met for long are forgotten."""
        if len(self.said) > MEMO:
            self.old, self.said = self.said, {}
        said, old, new, need = self.said, self.old, [], set()
        for w in words:
            if w not in said:
                known = old.get(w)
                if known is None:
                    parts = _parts(w) if self.splits else (w,)
                    new.append((w, parts))
                    need.update(parts)
                else:
                    said[w] = known
        need = [w for w in need if w not in said]
        for w in need:
            if w in old:
                said[w] = old[w]
        need = [w for w in need if w not in said]
        number, token = self.number, self.token
        if self.direct:
            hard, tokenize = [], self.model.tokenize
            for w in need:
                # most words are lower-case letters alone
                plain = w.decode() if w.isalpha() and w.islower() else _plain(w)
                if plain is None:
                    hard.append(w)
                    continue
                found = tokenize(plain)
                if len(found) == 1:
                    i = found[0].id
                    said[w] = (1, number[i], token[i])
                else:
                    ids = [t.id for t in found]
                    said[w] = (len(ids), " ".join([number[i] for i in ids]), " ".join([token[i] for i in ids]))
            need = hard
        for lo in range(0, len(need), 4096):
            part = need[lo : lo + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for w, e in zip(part, found, strict=True):
                ids = e.ids
                said[w] = (len(ids), " ".join([number[i] for i in ids]), " ".join([token[i] for i in ids]))
                if not ids:
                    self.blank.add(w)
        for w, parts in new:
            if len(parts) == 1:
                said[w] = said[parts[0]]
            elif w not in said:
                x, y = said[parts[0]], said[parts[1]]
                said[w] = (x[0] + y[0], f"{x[1]} {y[1]}", f"{x[2]} {y[2]}")

    def whole(self, words: list[bytes]) -> tuple[int, str, str]:
        """Number of tokens, ids and decoded text of words that stand apart; all were learnt."""
        said = self.said
        parts = [said[w] for w in words]
        if self.blank and not self.blank.isdisjoint(words):
            parts = [p for p in parts if p[0]]
        if not parts:
            return 0, "", ""
        n, ids, tokens = zip(*parts, strict=True)
        return sum(n), " ".join(ids), " ".join(tokens)

    def ids(self, words: list[bytes]) -> list[int]:
        return [int(i) for w in words for i in self.said[w][1].split()]

    def report(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.number[i] for i in ids]), " ".join([self.token[i] for i in ids])


def _plain(w: bytes) -> str | None:
    """The word as the merges see it, if it has Latin letters alone: composed, lower case, a character for each byte."""
    if w.isalpha():  # ASCII
        return w.lower().decode()
    text = w.decode()
    if text.isalpha() and max(text) < "\u0250" and unicodedata.is_normalized("NFC", text):
        low = "".join([c.lower() for c in text])
        return low.encode().decode("latin-1").translate(_BYTES) if len(low) == len(text) else None
    return None


def _parts(w: bytes) -> tuple[bytes, ...]:
    """Words that are encoded in the place of w, with the same result where SPLIT_PROBES show that the tokenizer takes runs of letters, single digits and
    runs of other signs apart and lower-cases letters: then closing signs behind a letter stand alone, and A is a."""
    core = w.rstrip(TAIL)
    tail = w[len(core) :]
    if core.isalnum():  # ASCII
        core = core.lower()
    elif not tail or not core or not core.decode()[-1].lower()[-1].isalpha():
        return (w,)
    return (core, tail) if tail else (core,)


def chunk_ends(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of about `size` bytes, and offsets of the rows' chunks. Cuts depend on LOOK bytes of content."""
    n = len(data)
    first = A.starts_of(off, LOOK)
    run = A.prefix(data)
    hit = first[(A.span_hash(run, first, first + LOOK) >> np.uint64(20)) % np.uint64(size) == 0] + LOOK if n >= LOOK else first
    ends = np.unique(np.r_[hit, off[1:][np.diff(off) > 0]])
    return ends, np.searchsorted(ends, off, side="right")


def _chunks(data: np.ndarray, off: np.ndarray, size: int):
    ends, coff = chunk_ends(data, off, size)
    starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
    return starts, ends, coff, A.span_hash(A.prefix(data), starts, ends) if len(ends) else np.zeros(0, np.uint64)


def _hashes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in A.blocks(batch["text"]):
                h, n = np.unique(_chunks(data, off, size)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(h)), pa.array(n)], ["h", "n"])

    return run


def _shares(size: int, shared):
    """Row -> whether a chunk of it may be shared, for every block."""

    def of(data: np.ndarray, off: np.ndarray):
        starts, ends, coff, h = _chunks(data, off, size)
        hit = among(shared.value, h)
        return starts, ends, coff, h, hit, np.diff(np.r_[0, np.cumsum(hit)][coff]) > 0

    return of


def _alone(spec, size: int, shared):
    """Texts without shared chunks: encoded where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, of = Coder.of(spec.value), _shares(size, shared)
        for batch in batches:
            for lo, hi, data, off in A.blocks(batch["text"]):
                some = of(data, off)[5]
                raw = data.tobytes()
                rows = np.flatnonzero(~some)
                words = [raw[off[i] : off[i + 1]].split() for i in rows]
                coder.learn({w for ws in words for w in ws})
                out = [coder.whole(ws) for ws in words]
                n, ids, said = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(lo + rows)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _sharing(size: int, shared):
    """Texts with shared chunks, and those chunks' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _shares(size, shared)
        for batch in batches:
            for lo, _, data, off in A.blocks(batch["text"]):
                *_, coff, h, hit, some = of(data, off)
                rows = np.flatnonzero(some)
                own = A.lists(A.signed(h[hit]), np.r_[0, np.cumsum(hit)][coff]).take(pa.array(rows))
                at = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["text"].take(at), own], ["doc_id", "text", "shared"])

    return run


def _texts_of_chunks(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _shares(size, shared)
        for batch in batches:
            for _, _, data, off in A.blocks(batch["text"]):
                starts, ends, _, h, hit, _ = of(data, off)
                _, one = np.unique(h[hit], return_index=True)
                at = np.flatnonzero(hit)[one]
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(h[at])), pa.array([data[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)], pa.binary())], ["h", "chunk"])

    return run


def _encode_chunks(spec):
    """Each shared chunk: the part before its first blank, ids of the words between, the part after its last blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(spec.value)
        for batch in batches:
            split = [_split(c) for c in batch["chunk"].to_pylist()]
            coder.learn({w for _, ws, _ in split if ws for w in ws})
            body = [None if ws is None else np.array(coder.ids(ws), coder.kind).tobytes() for _, ws, _ in split]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array([s[0] for s in split], pa.binary()), pa.array(body, pa.binary()), pa.array([s[2] for s in split], pa.binary())], ["h", "head", "body", "tail"])

    return run


def _split(chunk: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
    """(before the first blank, words between, after the last blank); no words but None where there is no blank."""
    words = chunk.split()
    head = b"" if not words or chunk[0] in BLANKS else words.pop(0)
    if len(head) == len(chunk):
        return head, None, b""
    tail = b"" if not words or chunk[-1] in BLANKS else words.pop()
    return head, words, tail


def _assemble(spec, size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, of = Coder.of(spec.value), _shares(size, shared)
        for batch in batches:
            found = batch["found"].to_pylist()
            out: list[tuple[int, str, str]] = []
            for lo, hi, data, off in A.blocks(batch["text"]):
                starts, ends, coff, h, hit, _ = of(data, off)
                h, raw = A.signed(h), data.tobytes()
                plans = []
                for i in range(hi - lo):
                    table = {f["h"]: f for f in found[lo + i]}
                    parts: list[list[bytes] | bytes] = []  # words to encode, or ids as they are
                    open_word = b""
                    for j in range(coff[i], coff[i + 1]):
                        if hit[j]:
                            f = table[h[j]]
                            head, body, tail = f["head"], f["body"], f["tail"]
                        else:
                            head, body, tail = _split(raw[starts[j] : ends[j]])
                        open_word += head
                        if body is not None:
                            parts += [[open_word], body] if open_word else [body]
                            open_word = tail
                    plans.append([*parts, [open_word]] if open_word else parts)
                coder.learn({w for parts in plans for p in parts if isinstance(p, list) for w in p})
                for parts in plans:
                    ids: list[int] = []
                    for p in parts:
                        ids += coder.ids(p) if isinstance(p, list) else np.frombuffer(p, coder.kind).tolist()
                    out.append(coder.report(ids))
            n, ids, said = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def drops_blanks(spec: str) -> bool:
    """Whether the tokenizer treats words apart, so that white space separates encodings."""
    rule = json.loads(spec).get("pre_tokenizer") or {}
    steps = rule.get("pretokenizers", [rule])
    return any(s.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" for s in steps)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """Encode every whole text with the tokenizer file at path `tokenizer`, and decode the ids again.

    Returns doc_id, n_tokens, ids (decimal, joined by one space) and decoded, a row for each row of `docs`. No special
    tokens are added; truncation and padding are off. Null and empty texts have no tokens. Null and repeated ids are kept.
    The tokenizer must drop white space (ValueError if not). Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = Path(tokenizer).read_text()
    if not drops_blanks(text):
        raise ValueError("chunks can be joined only where the tokenizer drops white space")
    spec = spark.sparkContext.broadcast(text)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {id_type}, n_tokens long, ids string, decoded string"
    several = docs.mapInArrow(_hashes(size), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    shared = bitmap_of(several, "h", 24)
    alone = docs.mapInArrow(_alone(spec, size, shared), rows)
    sharing = docs.mapInArrow(_sharing(size, shared), f"doc_id {id_type}, text string, shared array<long>")
    sharing = keep(sharing.withColumn("at", F.monotonically_increasing_id()), "bpe-sharing")
    chunks = sharing.select("text").mapInArrow(_texts_of_chunks(size, shared), "h long, chunk binary").dropDuplicates(["h"])
    coded = keep(chunks.mapInArrow(_encode_chunks(spec), "h long, head binary, body binary, tail binary"), "bpe-chunks")
    uses = sharing.select("at", F.explode(F.array_distinct("shared")).alias("h")).join(coded, "h")
    found = uses.groupBy("at").agg(F.collect_list(F.struct("h", "head", "body", "tail")).alias("found"))
    joined = sharing.select("at", "doc_id", "text").join(found, "at").drop("at")
    return alone.unionAll(joined.mapInArrow(_assemble(spec, size, shared), rows))
