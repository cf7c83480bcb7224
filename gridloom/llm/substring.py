"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` = 20 consecutive words of one text. A word goes if it lies in a window whose words also start earlier:
in a document of smaller doc_id, or further up in the same one.

1. Index and probe. Every text is cut into non-overlapping blocks of ``BLOCK`` = 10 words; their hashes are the index. Any
   repeated window holds a whole block of its other occurrence, so every rolling run of 10 words probes the index. A probe that
   meets a block other than itself is a hit.
2. Extension. Around each hit, the windows that hold it are hashed (96 bits); for each hash the earliest place wins, and
   consecutive windows that aren't the earliest form the maximal exact repeat, which goes.

A hit only says where to look; what is removed rests on step 2 alone. Copies of a whole text are found first, by a digest of the
text: all but the first go as a whole (if they have a window at all) and take no part in the steps.

What the steps exchange is packed: for each Arrow batch of texts (a chunk) and each range of hashes (a bucket) one compressed
row with hashes and word offsets, some 6 bytes a word. In a chunk equal windows are settled on the spot, so a passage that half
of the corpus repeats reaches its bucket once for each chunk, not once for each copy. Buckets grow with the input in number and, beyond
4 GB, by the square root of its bytes also in size up to a task's memory, so that packed rows keep some 100 words at 1 TB (2 at 100 TB).

Null texts have no words. Null ids sort first. Rows that agree in doc_id and place don't remove each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, textnum
from gridloom.llm.common import bytes_at, checked_join, delete_quietly, materialise, slices, small_arrow_batches, text_bytes

WINDOW, BLOCK = 20, 10
_BUCKET_BYTES, _GROW_FROM, _MOST_BUCKET = 3 << 20, 4 << 30, 48 << 20
_NULL_ID = -(2**63)
_PACKED = "bucket long, chunk long, kind int, payload binary"
_ROWS = "id long, version long, runs binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, each as differences in planes of bytes, compressed together."""
    import zstandard

    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        kind = np.dtype(f"<u{c.dtype.itemsize}")
        d = c.view(kind).copy()
        d[1:] -= c.view(kind)[:-1]
        parts.append(b"%c%d;" % (c.dtype.kind.encode(), c.dtype.itemsize) + b"%d;" % len(c) + d.view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    plain, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(plain):
        a = plain.index(b";", at)
        b = plain.index(b";", a + 1)
        kind, size, n = plain[at : at + 1].decode(), int(plain[at + 1 : a]), int(plain[a + 1 : b])
        planes = np.frombuffer(plain, np.uint8, n * size, b + 1).reshape(size, n)
        d = np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1)
        out.append(np.cumsum(d, dtype=d.dtype).view(f"<{kind}{size}"))
        at = b + 1 + n * size
    return out


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    a = list(zip(*rows)) if rows else [[]] * 4
    return pa.record_batch([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.binary())], ["bucket", "chunk", "kind", "payload"])


def _chunk(nth: int) -> int:
    return TaskContext.get().partitionId() << 32 | nth


def _cut(sorted_buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    begin = np.flatnonzero(np.concatenate(([True], sorted_buckets[1:] != sorted_buckets[:-1]))) if len(sorted_buckets) else []
    for a, b in zip(begin, np.append(begin[1:], len(sorted_buckets)) if len(begin) else []):
        yield int(sorted_buckets[a]), slice(a, b)


def _map_row(nth_bucket: int, chunk: int, batch: pa.RecordBatch, counts: list[np.ndarray], settled: np.ndarray) -> tuple[int, int, int, bytes]:
    """The row of a chunk that says which offsets are whose, with what the chunk has settled itself."""
    ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "version"))
    return nth_bucket, chunk, 1, pack(ids.astype(np.int64), versions.astype(np.int64), np.concatenate(counts).astype(np.uint32), settled.astype(np.uint32))


def _anchors(bits: int) -> Callable:
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            chunk, base, counts, hashes, offsets, aligned = _chunk(nth), 0, [], [], [], []
            texts = text_bytes(batch.column("text"))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                words = textnum.Words(texts[a:b], textnum.SPACE)
                n, text = words.counts, words.text_of()
                g = textnum.windows(words.hashes(), BLOCK)
                at = np.flatnonzero((text[: len(g)] == text[BLOCK - 1 :]) & (n[text[: len(g)]] >= WINDOW)) if len(g) else np.empty(0, np.int64)
                counts.append(n)
                hashes.append(g[at])
                offsets.append((at + base).astype(np.uint32))
                aligned.append((at - words.first[text[at]]) % BLOCK == 0)
                base += len(words)
            h, off, own = np.concatenate(hashes), np.concatenate(offsets), np.concatenate(aligned)
            order = np.argsort(h, kind="stable")
            h, off, own = h[order], off[order], own[order]
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(h)))
            single = times[np.cumsum(new) - 1] == 1 if len(h) else new
            blocks = np.add.reduceat(own.astype(np.int64), begin) if len(h) else np.empty(0, np.int64)
            index, many = h[begin][blocks > 0], blocks[blocks > 0] > 1
            rows = [_map_row(chunk % (1 << bits), chunk, batch, counts, np.sort(off[~single]))]
            probes = dict(_cut((h[single] >> shift).astype(np.int64)))
            indexed = dict(_cut((index >> shift).astype(np.int64)))
            low = lambda x: (x << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
            ph, po, ih = low(h[single]), off[single], low(index)
            for bucket in sorted(probes.keys() | indexed.keys()):
                p, i = probes.get(bucket, slice(0, 0)), indexed.get(bucket, slice(0, 0))
                rows.append((bucket, chunk, 0, pack(ih[i], many[i].astype(np.uint8), ph[p], po[p])))
            yield _rows(rows)

    return run


def _passed(table: pa.Table) -> list[tuple[int, int, int, bytes]]:
    return [(0, c, 1, p) for c, k, p in zip(*(table.column(x).to_pylist() for x in ("chunk", "kind", "payload"))) if k == 1]


def _parts(table: pa.Table) -> list[tuple[int, list[np.ndarray]]]:
    return [(c, unpack(p)) for c, k, p in zip(*(table.column(x).to_pylist() for x in ("chunk", "kind", "payload"))) if k == 0]


def _probe(table: pa.Table) -> pa.Table:
    """Offsets of the probes that meet a block of another place."""
    out, parts = _passed(table), _parts(table)
    if parts:
        index = np.concatenate([p[0] for _, p in parts])
        weight = np.concatenate([p[1].astype(np.int64) + 1 for _, p in parts])
        whose = np.repeat(np.array([c for c, _ in parts]), [len(p[0]) for _, p in parts])
        order = np.argsort(index, kind="stable")
        index, weight, whose = index[order], weight[order], whose[order]
        begin = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1]))) if len(index) else np.empty(0, np.int64)
        keys, weight, whose = index[begin], np.add.reduceat(weight, begin) if len(begin) else weight, whose[begin]
        for chunk, (_, _, probes, offsets) in parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
                hit = (keys[at] == probes) & ((weight[at] > 1) | (whose[at] != chunk))
                if hit.any():
                    out.append((0, chunk, 0, pack(np.sort(offsets[hit]))))
    return pa.Table.from_batches([_rows(out)])


def _candidates(bits: int) -> Callable:
    """Hash the windows that the runs name; settle equal ones of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            chunk, base, counts, parts = _chunk(nth), 0, [], []
            texts, marked = text_bytes(batch.column("text")), batch.column("runs").to_pylist()
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices([len(t) for t in texts], 1 << 20):
                words = textnum.Words(texts[a:b], textnum.SPACE)
                h, flags = words.hashes(), np.zeros(len(words) + 1, dtype=np.int8)
                for i in range(a, b):
                    r = np.frombuffer(marked[i], np.int32) + words.first[i - a]
                    flags[r[0::2]] += 1
                    flags[r[1::2]] -= 1
                at = np.flatnonzero(np.cumsum(flags[:-1], dtype=np.int8))
                text = words.text_of()[at]
                tens = [textnum.windows(h, BLOCK), textnum.windows(words.hashes(1), BLOCK, 1)]
                full, short = (textnum.mix(t[at] * np.uint64(0x9E3779B97F4A7C15) + t[at + BLOCK] * np.uint64(0xD6E8FEB86659FD93)) for t in tens)
                parts.append((full, (short >> np.uint64(32)).astype(np.uint32), ids[a + text], (at - words.first[text]).astype(np.uint32), (at + base).astype(np.uint32)))
                counts.append(words.counts)
                base += len(words)
            full, short, doc, start, off = (np.concatenate(x) for x in zip(*parts))
            later, first = _later(full, short, doc, start)
            rows = [_map_row(chunk % (1 << bits), chunk, batch, counts, np.sort(off[later]))]
            first = np.sort(first)  # back to text order, which packs well
            bucket = (full[first] >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = first[order]
            for b, s in _cut(bucket[order]):
                f = first[s]
                rows.append((b, chunk, 0, pack(full[f], short[f], doc[f], start[f], off[f])))
            yield _rows(rows)

    return run


def _later(full: np.ndarray, short: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of windows that equal one at an earlier place, indices of one earliest window for each hash)."""
    if not len(full):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((start, doc, short, full))
    f, s, d, p = full[order], short[order], doc[order], start[order]
    new = np.concatenate(([True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[(d != d[head]) | (p != p[head])], order[new]


def _settle(table: pa.Table) -> pa.Table:
    out, parts = _passed(table), _parts(table)
    if parts:
        full, short, doc, start, off = (np.concatenate(x) for x in zip(*(p for _, p in parts)))
        whose = np.repeat(np.arange(len(parts)), [len(p[0]) for _, p in parts])
        later, _ = _later(full, short, doc, start)
        for i, (chunk, _) in enumerate(parts):
            mine = later[whose[later] == i]
            if len(mine):
                out.append((0, chunk, 0, pack(np.sort(off[mine]))))
    return pa.Table.from_batches([_rows(out)])


def _spread(before: int, after: int, room: int) -> Callable:
    """Per document, as runs of word indices: every word from before a marked offset to after it, room words off the end at least."""

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        (ids, versions, counts, settled), *more = (unpack(p) for k, p in zip(kinds, payloads) if k == 1)
        if more:
            raise RuntimeError("two chunks of one name")
        marked = np.concatenate([settled, *(unpack(p)[0] for k, p in zip(kinds, payloads) if k == 0)]).astype(np.int64)
        ends = np.cumsum(counts.astype(np.int64))
        begins = ends - counts
        total = int(ends[-1]) if len(ends) else 0
        text = np.searchsorted(ends, marked, side="right")
        steps = np.zeros(total + 1, dtype=np.int64)
        low, high = np.maximum(marked - before, begins[text]), np.minimum(marked + after + 1, ends[text] - room)
        ok = high > low
        np.add.at(steps, low[ok], 1)
        np.add.at(steps, high[ok], -1)
        a, b = textnum.runs(np.cumsum(steps[:-1]) > 0)
        # A run may cross from one text to the next: cut it there.
        cuts = np.setdiff1d(begins, a)
        first, last = np.searchsorted(a, cuts, side="right") - 1, len(a)
        inside = (first >= 0) & (cuts < b[np.maximum(first, 0)]) if last else np.zeros(len(cuts), bool)
        a, b = np.sort(np.concatenate((a, cuts[inside]))), np.sort(np.concatenate((b, cuts[inside])))
        of = np.searchsorted(ends, a, side="right")
        rows = []
        for t, s in _cut(of):
            rows.append((int(ids[t]), int(versions[t]), np.stack((a[s], b[s]), 1).astype(np.int64) - begins[t]))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary())], ["id", "version", "runs"])

    return run


def _exchange(texts: DataFrame, packer: Callable, reducer: Callable, spreader: Callable, tag: str) -> tuple[DataFrame, str]:
    packed = texts.mapInArrow(packer, _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(reducer, _PACKED)
    return materialise(answers.groupBy("chunk").applyInArrow(spreader, _ROWS), tag)


def _attach(left: DataFrame, right: DataFrame, path: str, how: str, on: tuple[str, ...] = ("id", "version")) -> DataFrame:
    """A join with the table at path. Where it shuffles, rows are put in order again: chunks must come out alike if a task runs again."""
    joined = checked_join(left, right, path, list(on), how)
    return joined if 4 * bytes_at(left.sparkSession, path) < common.BROADCAST_LIMIT else joined.sortWithinPartitions("id", "version")


def _named(documents: DataFrame, path_of: list[str]) -> DataFrame:
    """documents with id, version (of the text) and copy: whether an earlier document has the same text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    named = documents.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "version": F.xxhash64(text), "digest": F.unhex(F.md5(text))})
    repeated, path = materialise(named.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first"), "copies")
    path_of.append(path)
    return _attach(named, repeated, path, "left", ("digest",)).withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False))).drop("digest", "first")


def bucket_bits(size: int) -> int:
    """Bits of the hash that name a bucket, for size bytes of text."""
    held = min(_BUCKET_BYTES * max(1.0, size / _GROW_FROM) ** 0.5, _MOST_BUCKET)
    return max(8, int(size / held).bit_length())


def repeats(named: DataFrame) -> tuple[DataFrame, str]:
    """(id, version, runs) of the words to remove from documents that aren't copies."""
    spark = named.sparkSession
    texts = named.filter(~F.col("copy")).select("id", "version", "text")
    # Rows that agree in id and text are one: each would be joined with the runs of all. Put in order, see _attach.
    if not texts.groupBy("id", "version").count().filter("count > 1").limit(1).isEmpty():
        texts = texts.dropDuplicates(["id", "version"]).sortWithinPartitions("id", "version")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = bucket_bits(int(size))
    hits, hits_path = _exchange(texts, _anchors(bits), _probe, _spread(BLOCK, 0, WINDOW - 1), "hits")
    out = _exchange(_attach(texts, hits, hits_path, "inner").select("id", "version", "text", "runs"), _candidates(bits), _settle, _spread(0, WINDOW - 1, 0), "repeats")
    delete_quietly(spark, hits_path)
    return out


def _kept(text: bytes, copy: bool, runs: bytes | None) -> tuple[int, list[bytes]]:
    words = text.split()  # of bytes: at ASCII white space
    n = len(words)
    if copy and n >= WINDOW:
        return n, []
    if runs:
        for a, b in np.frombuffer(runs, np.int32).reshape(-1, 2)[::-1].tolist():
            del words[a:b]
    return n, words


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the kept words joined by one space."""
    small_arrow_batches(documents.sparkSession)
    named = _named(documents.select("doc_id", "text"), [])
    removed, path = repeats(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digests = [], [], []
            for text, copy, runs in zip(text_bytes(batch.column("text")), batch.column("copy").to_pylist(), batch.column("runs").to_pylist()):
                total, words = _kept(text, copy, runs)
                n.append(total)
                gone.append(total - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = checked_join(named, removed, path, ["id", "version"], "left")
    return joined.select(F.col("doc_id").cast("long"), "text", "copy", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents with repeated words cut from their texts, the kept words joined by one space; texts without repeats stay as they are."""
    small_arrow_batches(documents.sparkSession)
    columns, schema = documents.columns, documents.schema
    inner = _named(documents.select(F.struct(*columns).alias("row"), "doc_id", "text"), [])
    removed, path = repeats(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = batch.column("text").to_pylist()
            for i, (copy, runs) in enumerate(zip(batch.column("copy").to_pylist(), batch.column("runs").to_pylist())):
                if (copy or runs) and now[i] is not None:
                    n, words = _kept(now[i].encode(), copy, runs)
                    if len(words) < n:
                        now[i] = b" ".join(words).decode()
            row = batch.column("row")
            fields = [pa.array(now, pa.string()) if c == "text" else row.field(i) for i, c in enumerate(columns)]
            yield pa.record_batch(fields, columns)

    return checked_join(inner, removed, path, ["id", "version"], "left").select("row", "text", "copy", "runs").mapInArrow(run, schema)
