"""Which keys of which documents occur more than once in a corpus.

Documents yield 64-bit keys. A task sorts the keys of a chunk of documents; a
key that repeats there is settled on the spot, and each distinct key travels
once per chunk, in sorted blocks split by leading bits. A key that a third of
all documents share is therefore sent once by each chunk, however often it
occurs. Keys travel without their two low bytes: a rare collision reports a
repeat too many, never one too few, and callers verify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import store

#: Keys of a chunk, about, and documents turned into Python objects at once.
CHUNK, SLICE = 600_000, 250
#: Documents of an Arrow batch between the JVM and Python: whole texts are held on both sides, outside the heap.
BATCH = 1_000
#: Words whose hashes a Python worker remembers; it starts anew beyond that.
REMEMBERED = 200_000
#: Odd multipliers for combining word hashes, from the golden ratio.
MIX = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(32)]

_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if len(_words) > REMEMBERED:
        _words.clear()
    try:
        return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """Mix the bits of sums of multiplied hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(29))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += finish(w[i : i + n] + np.uint64(MIX[i + 2])) * np.uint64(MIX[i])
    return finish(total)


def planes(a: np.ndarray, skip: int = 0) -> bytes:
    """The bytes of an array, plane by plane, so that Spark's own compression finds the regular ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T[skip:]).tobytes()


def unplanes(raw: bytes, n: int, kind: str, skip: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    out = np.zeros((n, width), dtype=np.uint8)
    out[:, skip:] = np.frombuffer(raw, dtype=np.uint8).reshape(width - skip, n).T
    return out.view(kind).ravel()


@dataclass
class Found:
    """What a document yields: its keys, their places, and what identifies its content (for copies)."""

    n: int
    size: int
    identity: bytes
    keys: np.ndarray
    refs: np.ndarray


SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("identity", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("more", pa.binary()), ("refs", pa.binary())])
GOT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("identity", pa.binary()), ("hits", pa.int64()), ("refs", pa.binary())])
INFO, HIT, BLOCK = 0, 1, 2


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def by_doc(doc: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Hits grouped by document: documents, counts, sorted places."""
    order = np.lexsort((ref, doc))
    doc, ref = doc[order], ref[order]
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(doc)] if len(doc) else starts
    return doc[starts], (ends - starts).tolist(), [ref[a:b].astype("<i4").tobytes() for a, b in zip(starts, ends)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where each run starts, and the length of the run of every key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.r_[starts, len(keys)])
    return starts, np.repeat(lengths, lengths)


def find(docs: DataFrame, column: str, extract: Callable[[object], Found], name: str, with_refs: bool) -> DataFrame:
    """Stored rows about docs (doc_id, ``column``): kind INFO has n, size, identity; kind HIT has hits and refs.

    A document has one HIT row at most; refs are its little-endian 32-bit places. Within a
    chunk a document whose identity has been seen adds no keys: its copies are
    told by identity.
    """
    spark = docs.sparkSession
    n_parts = store.partitions(spark)
    bits = max(4, (8 * n_parts - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.array([d for d, _ in held], dtype=np.int64)
            sizes = [len(f.keys) for _, f in held]
            spread = (ids.astype(np.uint64) * np.uint64(MIX[3]) >> np.uint64(64 - bits)).astype(np.int32)
            yield rows(SENT, kind=[INFO] * len(held), bucket=spread, doc_id=ids, n=[f.n for _, f in held], size=[f.size for _, f in held], identity=[f.identity for _, f in held])
            keys = np.concatenate([f.keys for _, f in held]) if held else np.empty(0, dtype=np.uint64)
            if not len(keys):
                return
            at = np.repeat(np.arange(len(held)), sizes)
            refs = np.concatenate([f.refs for _, f in held]).astype("<i4") if with_refs else np.zeros(len(keys), dtype="<i4")
            keys = keys >> np.uint64(16)
            order = np.argsort(keys, kind="stable")
            keys, at, refs = keys[order], at[order], refs[order]
            starts, length = runs(keys)
            again = length > 1
            if again.any():
                one = int(spread[0])  # any bucket will do: these are settled
                yield rows(SENT, kind=[HIT], bucket=[one], n=[int(again.sum())], docs=[planes(ids[at[again]])], refs=[planes(refs[again]) if with_refs else None])
            keys, at, refs, again = keys[starts], at[starts], refs[starts], again[starts]
            cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(48 - bits))
            cuts = np.r_[cuts, len(keys)]
            blocks = [(b, slice(cuts[b], cuts[b + 1])) for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
            yield rows(
                SENT, kind=[BLOCK] * len(blocks), bucket=[b for b, _ in blocks], n=[s.stop - s.start for _, s in blocks],
                keys=[planes(keys[s]) for _, s in blocks], docs=[planes(ids[at[s]]) for _, s in blocks],
                more=[np.packbits(again[s]).tobytes() for _, s in blocks], refs=[planes(refs[s]) if with_refs else None for _, s in blocks],
            )

        held: list[tuple[int, Found]] = []
        seen: set[bytes] = set()
        total = 0
        empty = np.empty(0, dtype=np.uint64)
        for b in batches:
            for part in (b.slice(i, SLICE) for i in range(0, b.num_rows, SLICE)):
                for d, raw in zip(part.column("doc_id").to_pylist(), part.column(column).cast(pa.binary()).to_pylist()):
                    found = extract(raw)
                    if found.identity in seen:
                        found = Found(found.n, found.size, found.identity, empty, empty)
                    seen.add(found.identity)
                    held.append((d, found))
                    total += len(found.keys)
                    if total > CHUNK:
                        yield from flush()
                        held, seen, total = [], set(), 0
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple] = []
        hit: list[tuple] = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (some := np.flatnonzero(kind == INFO)).size:
                yield b.take(pa.array(some))
            for i in np.flatnonzero(kind != INFO):
                n = b.column("n")[i].as_py()
                raw = {c: b.column(c)[i].as_py() for c in ("keys", "docs", "more", "refs")}
                doc = unplanes(raw["docs"], n, "<i8")
                refs = unplanes(raw["refs"], n, "<i4") if with_refs else np.zeros(n, dtype="<i4")
                if kind[i] == HIT:
                    hit.append((doc, refs))
                else:
                    blocks.append((unplanes(raw["keys"], n, "<u8"), doc, np.unpackbits(np.frombuffer(raw["more"], dtype=np.uint8), count=n).astype(bool), refs))
        if blocks:
            keys, doc, again, refs = (np.concatenate([x[i] for x in blocks]) for i in range(4))
            del blocks
            order = np.argsort(keys, kind="stable")
            keys, doc, again, refs = keys[order], doc[order], again[order], refs[order]
            new = (runs(keys)[1] > 1) & ~again
            hit.append((doc[new], refs[new]))
        if hit:
            doc, refs = (np.concatenate([x[i] for x in hit]) for i in range(2))
            to = (doc.astype(np.uint64) * np.uint64(MIX[3]) >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            doc, refs, to = doc[order], refs[order], to[order]
            starts, _ = runs(to)
            cuts = [slice(x, y) for x, y in zip(starts, np.r_[starts[1:], len(to)])]
            yield rows(SENT, kind=[HIT] * len(cuts), bucket=[int(to[c.start]) for c in cuts], n=[c.stop - c.start for c in cuts], docs=[planes(doc[c]) for c in cuts], refs=[planes(refs[c]) if with_refs else None for c in cuts])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit: list[tuple] = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (some := np.flatnonzero(kind == INFO)).size:
                got = b.take(pa.array(some))
                yield rows(GOT, kind=[INFO] * len(some), **{c: got.column(c) for c in ("doc_id", "n", "size", "identity")})
            for i in np.flatnonzero(kind == HIT):
                n = b.column("n")[i].as_py()
                hit.append((unplanes(b.column("docs")[i].as_py(), n, "<i8"), unplanes(b.column("refs")[i].as_py(), n, "<i4") if with_refs else np.zeros(n, dtype="<i4")))
        if hit:
            doc, hits, places = by_doc(*(np.concatenate([x[i] for x in hit]) for i in range(2)))
            for a in range(0, len(doc), 50_000):
                s = slice(a, a + 50_000)
                yield rows(GOT, kind=[HIT] * len(doc[s]), doc_id=doc[s], hits=hits[s], refs=places[s] if with_refs else [None] * len(doc[s]))

    sent = "kind int, bucket int, doc_id bigint, n bigint, size bigint, identity binary, keys binary, docs binary, more binary, refs binary"
    got = "kind int, doc_id bigint, n bigint, size bigint, identity binary, hits bigint, refs binary"
    moved = docs.where("doc_id is not null").select("doc_id", column).mapInArrow(send, sent).repartition(n_parts, "bucket")
    settled = moved.mapInArrow(settle, sent).repartition(n_parts, "bucket")
    with store.batches_of(spark, BATCH):
        out = store.table(settled.mapInArrow(gather, got), name)
    store.release(spark)
    return out


def info(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == INFO).select("doc_id", "n", "size", "identity")


def hits(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == HIT).select("doc_id", "hits", "refs")
