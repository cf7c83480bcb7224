"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

Texts and items are normalised alike: A-Z lower-cased, words are runs of ASCII letters, digits and bytes beyond ASCII.
The automaton holds every substring of every item. A document's words stream through it; after each word the state
stands for the longest run of words up to here that occurs in some item. Where that run is as long as a window (10
words, or a shorter item as a whole), the state and its suffix links name the items.

Before the automaton, a table of hashed word groups of the items skips the runs of a document that can't match: it may
let through too much and never too little, and the automaton then compares real words, so that results are exact.

Items are cut into blocks of at most ``BLOCK_WORDS`` words; each block's automaton is built and broadcast in turn, so
neither driver nor executor holds more than one block however large the benchmark is, unless a single item is larger.

Null texts, of documents or items, and texts without words have no hits; a null item_id is the empty name; items of one name count once.
An empty benchmark hits nothing, an empty table of documents gives an empty result. Repeated documents are each judged. Other columns
of documents, whatever their names, stay with ``cut`` and are left out by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum
from gridloom.llm.common import checked_join, delete_quietly, materialise, slices, small_arrow_batches, text_bytes

WINDOW = 10
BLOCK_WORDS = 200_000
_TABLE_BITS = 22


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; marks[state] lists (length, item) windows that end there."""

    window: int
    next: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    marks: dict[int, set] = field(default_factory=dict)
    marked: list[int] = field(default_factory=list)
    shortest: int = 1 << 30
    table: np.ndarray | None = None
    group: int = 1

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The part of q that holds the strings reached from p: q itself or a copy."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def mark(self, words: list[bytes], item: str) -> None:
        """Register the item's windows; call it when all items have been added."""
        k = min(self.window, len(words))
        for i in range(len(words) - k + 1):
            state = 0
            for word in words[i : i + k]:
                state = self.next[state][word]
            self.marks.setdefault(state, set()).add((k, item))
        self.shortest = min(self.shortest, k)

    def close(self) -> None:
        """Let marked[state] be the longest suffix with windows, the state itself included; call it when all windows are registered."""
        self.marked = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]]

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each word."""
        state = length = 0
        for word in words:
            edges = self.next[state]
            while word not in edges and state:
                state = self.link[state]
                length = self.length[state]
                edges = self.next[state]
            if word in edges:
                state, length = edges[word], length + 1
            yield state, length

    def ending(self, state: int, length: int) -> Iterator[tuple[int, str]]:
        """Windows that end here: a state for each length of window at most, however long the chain of suffixes is."""
        while (state := self.marked[state]) > 0:
            for k, item in self.marks[state]:
                if k <= length:
                    yield k, item
            state = self.link[state]


def build(items: list[tuple[str, bytes]], window: int = WINDOW) -> Automaton | None:
    out = Automaton(window)
    split = [(name, w) for name, text in items if len(w := textnum.Words([text], textnum.NOT_ALNUM, lower=True))]
    if not split:
        return None
    listed = [(name, [w.word(i) for i in range(len(w))]) for name, w in split]
    for _, words in listed:
        out.add(words)
    for name, words in listed:
        out.mark(words, name)
    out.close()
    out.group = min(out.shortest, 3)
    out.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    for _, w in split:
        out.table[textnum.windows(w.hashes(), out.group) >> np.uint64(64 - _TABLE_BITS)] = True
    return out


def match(words: textnum.Words, automaton: Automaton) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """(text, spans of hit words as indices into words, items) for each text with a hit."""
    may = np.zeros(len(words), dtype=bool)
    g = textnum.windows(words.hashes(), automaton.group)
    may[: len(g)] = automaton.table[g >> np.uint64(64 - _TABLE_BITS)]
    at: dict[int, tuple[list, set]] = {}
    begins, ends = textnum.runs(may)
    ends = np.minimum(ends + automaton.group - 1, len(words))
    long = ends - begins >= automaton.shortest
    for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
        first, last = np.searchsorted(words.first, [begin, end - 1], side="right") - 1
        for text in range(first, last + 1):  # a run may reach over the end of a text
            a, b = max(begin, int(words.first[text])), min(end, int(words.first[text + 1]))
            if b - a < automaton.shortest:
                continue
            for i, (state, length) in enumerate(automaton.stream([words.word(j) for j in range(a, b)]), a + 1):
                if length < automaton.shortest:
                    continue
                for k, item in automaton.ending(state, length):
                    spans, items = at.setdefault(text, ([], set()))
                    items.add(item)
                    if spans and spans[-1][1] >= i - k:
                        spans[-1] = (min(spans[-1][0], i - k), i)
                    else:
                        spans.append((i - k, i))
    for text in sorted(at):
        yield text, merged(at[text][0]), at[text][1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """An automaton for each block of items, one after another. Null items and items without words are in none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")).filter(F.col("text").isNotNull())
    words = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-int(words) // (2 * block_words)))  # a word and its separator take two bytes at least
    for block in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block)
        if automaton := build(sorted((r.item, r.text.encode()) for r in part.collect()), window):
            yield automaton


def _found(automaton: Automaton | None, texts: list[bytes]) -> Iterator[tuple[textnum.Words, int, dict]]:
    """For each slice of texts: words, index of its first text, hits by text in it."""
    for a, b in slices([len(t) for t in texts], 1 << 20):
        words = textnum.Words(texts[a:b], textnum.NOT_ALNUM, lower=True)
        yield words, a, {} if automaton is None or not len(words) else {t: (spans, items) for t, spans, items in match(words, automaton)}


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<int>, row_key string"
_REPORT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
    + [("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32())), ("row_key", pa.string())]
)


def _scan(keyed: DataFrame, automaton: Automaton | None) -> DataFrame:
    """One automaton over (doc_id, text, row_key)."""
    shared = keyed.sparkSession.sparkContext.broadcast(automaton)  # of BLOCK_WORDS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts, rows = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), text_bytes(batch.column("text")), []
            for words, a, hits in _found(shared.value, texts):
                base = words.first
                for t, n in enumerate(words.counts.tolist()):
                    spans, items = hits.get(t, ((), set()))
                    flat = [int(x - base[t]) for span in spans for x in span]
                    hit = sum(y - x for x, y in spans)
                    rows.append((ids[a + t], n, hit, len(items), _digest(items), hit > 0, sorted(items), flat, keys[a + t]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_REPORT_ARROW), _REPORT_ARROW)], schema=_REPORT_ARROW)

    return keyed.mapInArrow(run, _REPORT)


def _row_key() -> Column:
    """A digest of id and text: what several blocks found is put together by it."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def _over_blocks(keyed: DataFrame, automata: Iterable[Automaton]) -> tuple[DataFrame, str]:
    """(row_key, items, spans) of rows with hits, as a table and its path; each automaton scans on its own, equal rows count once."""
    spark = keyed.sparkSession
    written = [materialise(_scan(keyed, one).filter("contaminated").dropDuplicates(["row_key"]).select("row_key", "items", "spans"), "leaks") for one in automata]
    found = reduce(DataFrame.unionByName, [frame for frame, _ in written])
    out = materialise(
        found.groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")), "leaks"
    )  # a row has one entry for each block at most
    for _, path in written:
        delete_quietly(spark, path)
    return out


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, items whose windows occur, spans of hit words (begin, end, ...).

    Null and empty texts have no words. Rows with equal doc_id are each judged alone. Without items nothing is hit.
    """
    small_arrow_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    automata = blocks(benchmark, window, block_words)
    first, second = next(automata, None), next(automata, None)
    if second is None:
        return _scan(texts.withColumn("row_key", F.lit(None).cast("string")), first).drop("row_key")
    keyed = texts.withColumn("row_key", _row_key())
    found, path = _over_blocks(keyed, chain((first, second), automata))
    whole = _scan(keyed, None).select("doc_id", "n_words", "row_key")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                spans, items = _pairs(r["spans"] or ()), r["items"] or []
                hit = sum(y - x for x, y in spans)
                rows.append((r["doc_id"], r["n_words"], hit, len(items), _digest(set(items)), hit > 0, sorted(items), [x for span in spans for x in span], r["row_key"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_REPORT_ARROW), _REPORT_ARROW)], schema=_REPORT_ARROW)

    return checked_join(whole, found, path, "row_key", "left").mapInArrow(total, _REPORT).drop("row_key")


def _pairs(flat: Sequence[int]) -> list[tuple[int, int]]:
    return merged(list(zip(flat[0::2], flat[1::2])))


def _without(batch: pa.RecordBatch, found: Iterator[tuple[textnum.Words, int, dict]], min_span: int, max_coverage: float) -> Iterator[pa.RecordBatch]:
    """The batch with its texts cut; found names spans as _found does."""
    columns, texts = batch.schema.names, text_bytes(batch.column("text"))
    keep = np.ones(batch.num_rows, dtype=bool)
    changed: dict[int, str] = {}
    for words, a, hits in found:
        for t, (spans, _) in hits.items():
            spans = [s for s in spans if s[1] - s[0] >= min_span]
            if sum(y - x for x, y in spans) > max_coverage * words.counts[t]:
                keep[a + t] = False
            elif spans:
                text, base, parts, done = texts[a + t], int(words.text_starts[t]), [], 0
                for x, y in spans:
                    parts.append(text[done : int(words.starts[x]) - base].rstrip())
                    done = int(words.ends[y - 1]) - base
                changed[a + t] = b"".join([*parts, text[done:]]).decode("utf-8", "replace")
    table = pa.Table.from_batches([batch])
    if changed:
        now = {"text": changed} | ({"n_chars": {i: len(text) for i, text in changed.items()}} if "n_chars" in columns else {})
        for name, new in now.items():
            values, kind = batch.column(name).to_pylist(), table.schema.field(name)
            for i, value in new.items():
                values[i] = value
            table = table.set_column(columns.index(name), kind, pa.array(values, kind.type))
    yield from table.filter(pa.array(keep)).to_batches()


def cut(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents without the spans that repeat test items.

    A span of min_span hit words or more is cut from its first word's first byte to its last word's last byte, with the
    white space before it. A document of whose words more than max_coverage are hit goes as a whole. All items are looked for
    in the text as it came, in however many blocks. Columns stay as they are; n_chars, where there is one, follows the text.
    Null texts stay null.
    """
    spark, columns, schema = documents.sparkSession, documents.columns, documents.schema
    small_arrow_batches(spark)
    automata = blocks(benchmark, window, block_words)
    first, second = next(automata, None), next(automata, None)
    if first is None:
        return documents
    if second is None:
        shared = spark.sparkContext.broadcast(first)  # of BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _without(batch, _found(shared.value, text_bytes(batch.column("text"))), min_span, max_coverage)

        return documents.mapInArrow(run, schema)
    found, path = _over_blocks(documents.select(F.col("doc_id").cast("long"), "text", _row_key().alias("row_key")), chain((first, second), automata))

    def located(texts: list[bytes], spans: list[list[int] | None]) -> Iterator[tuple[textnum.Words, int, dict]]:
        for words, a, _ in _found(None, texts):
            base = words.first.tolist()
            yield words, a, {t: ([(x + base[t], y + base[t]) for x, y in _pairs(spans[a + t])], ()) for t in range(len(words.counts)) if spans[a + t]}

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column("row"))
            yield from _without(row, located(text_bytes(row.column("text")), batch.column("spans").to_pylist()), min_span, max_coverage)

    inner = documents.select(F.struct(*columns).alias("row"), _row_key().alias("row_key"))
    return checked_join(inner, found, path, "row_key", "left").select("row", "spans").mapInArrow(run_joined, schema)
