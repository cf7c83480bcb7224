"""Token counts with a digest cache.

A text is normalised (runs of blanks, tabs and line ends become one blank; none at the ends), where the tokenizer's rules show that
its count doesn't depend on that (``known_rules``), else left as it is, and keyed by the SHA-256 of the result together with the digest of the tokenizer's file. Keys
that the cache table holds aren't encoded again; of the others each distinct text is encoded once and appended.

Digests meet the cache before any text moves. Texts to encode travel compressed, once per scan task at most, so copies of one text don't meet in one task. Encoding remembers
the counts of words, where the tokenizer encodes these one by one; unknown words, and all texts for tokenizers of other rules, go through
the library: tokenizers for .json, sentencepiece for .model. Null texts count as empty. Rows with equal doc_id each get their count, and
null ids too. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_LIMIT, bytes_at, materialise, packed_texts, slices, small_arrow_batches

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Words in a worker's memory; beyond it they become the older ones, and those before them are forgotten.
PIECES = 150_000
_WHITE = "[ \\t\\n\\r]+"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:  # part of the installation, on every machine
        return hashlib.sha256(f.read()).hexdigest()[:32]


#: Normaliser and first split of a tokenizer for which white space and the words of _CUT are as assumed here.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
}


def known_rules(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    special = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"]) for x in made.get("added_tokens") or [])
    return special and made.get("normalizer") == _RULES["normalizer"] and steps[:1] == [_RULES["split"]] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and made.get("post_processor") is None


def digest(text: Column, fold: bool) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.trim(F.regexp_replace(plain, _WHITE, " ")) if fold else plain, 256))


#: The tokenizer's way to cut a normalised text, for texts of the characters of PLAIN: contractions, words, single digits, other.
_CUT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
#: Characters whose class, case and normal form are beyond doubt: printable ASCII, its usual white space, Latin-1 but for ª º µ and the digits there.
_PLAIN = re.compile("[\x21-\x7e \t\n\r¡-©«-±´¶-¸»¿-ÿ]*").fullmatch


class Counter:
    """Counts a text's tokens as the library does, without special tokens added.

    Plain texts are cut into the tokenizer's words, and the library encodes only words not seen lately; the rest, and texts that
    may hold a special string, go through the library whole.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.by_words = known_rules(path)
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces_of = SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(pieces_of.encode(text))
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.whole = lambda text: len(self.library.encode(text, add_special_tokens=False).ids)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.pieces = pieces

    def _learn(self, new: list[str]) -> None:
        if len(self.known) > self.pieces:
            self.known, self.older = {}, self.known
        ask = []
        for p in new:
            if (n := self.older.get(p)) is None:
                ask.append(p)
            else:
                self.known[p] = n
        for a in range(0, len(ask), 1000):
            part = ask[a : a + 1000]
            word_ids = self.library.encode(" ".join(part), add_special_tokens=False).word_ids
            if word_ids[-1] + 1 == len(part):
                self.known.update(zip(part, np.bincount(word_ids, minlength=len(part)).tolist()))
            else:
                self.known.update((p, self.whole(p)) for p in part)

    def __call__(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not self.by_words or "<|" in text or not _PLAIN(text):
                out.append(self.whole(text))
                continue
            words = _CUT(text.lower())
            try:
                out.append(sum(map(self.known.__getitem__, words)))
            except KeyError:
                self._learn([p for p in set(words) if p not in self.known])
                lookup = lambda p: self.known[p] if p in self.known else self.older[p]  # noqa: E731  _learn may have turned a page
                out.append(sum(map(lookup, words)))
        return out


def encode_misses(documents: DataFrame, cache: DataFrame, tokenizer: str) -> DataFrame:
    """Rows for the cache: each distinct text of documents that it doesn't hold yet."""
    version = tokenizer_version(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, count, seen = zstandard.ZstdDecompressor().decompress, Counter(tokenizer), set()
        for batch in batches:
            keys = batch.column("digest").to_pylist()
            packed = batch.column("packed")
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            raw = [packed[i].as_py() for i in new]
            n = []
            for a, b in slices([zstandard.frame_content_size(x) for x in raw], 4 << 20):
                n += count([unpack(x).decode() for x in raw[a:b]])
            yield pa.record_batch([pa.array([keys[i] for i in new], pa.binary()), pa.array([version] * len(new), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    keyed = documents.select(digest(F.col("text"), known_rules(tokenizer)).alias("digest"), "text")
    known = cache.filter(F.col("tokenizer") == version).select("digest")
    if known.isEmpty():
        return packed_texts(keyed, "digest").repartition("digest").mapInArrow(run, CACHE_SCHEMA)
    # Digests alone meet the cache; then only texts that it lacks are packed or, where these are too many to tell in each task, only packed texts travel.
    missing, path = materialise(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
    if 4 * bytes_at(documents.sparkSession, path) < BROADCAST_LIMIT:
        texts = packed_texts(keyed.join(F.broadcast(missing), "digest", "left_semi"), "digest")
    else:
        texts = packed_texts(keyed, "digest").join(missing, "digest", "left_semi")
    return texts.repartition("digest").mapInArrow(run, CACHE_SCHEMA)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(documents: DataFrame, tokenizer: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document; appends to the cache what it lacked."""
    spark = documents.sparkSession
    small_arrow_batches(spark)
    encode_misses(documents, open_cache(spark, cache_path), tokenizer).write.mode("append").parquet(cache_path)
    # Written first: a join of two plain exchanges is one whose skew Spark can split, and many rows may share a text.
    counts, _ = materialise(open_cache(spark, cache_path).filter(F.col("tokenizer") == tokenizer_version(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    keyed = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(F.col("text"), known_rules(tokenizer)).alias("digest"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
