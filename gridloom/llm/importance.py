"""Resampling by importance: documents that look like a target corpus are likelier to be drawn.

Features are runs of consecutive words (A-Z lower-cased; runs of ASCII letters, digits and bytes beyond ASCII), hashed by CRC-32 into
buckets. A bucket's gain is the logarithm of how much likelier it is in the target corpus than in the documents, in thousandths and
rounded down; a document's weight is the floored mean of its features' gains. Weights get Gumbel noise that a hash of the id decides, so the highest
scores are a sample without repetition, drawn by weight.

Neither corpus is put into vectors by document. A pass over the texts writes inverted postings: for each bucket the documents that hold
it and how often. Both corpora's postings meet by bucket, where sums over them give the gain; each posting becomes a contribution,
count times gain, and contributions are summed by document. Postings of a batch of texts come as one list per bucket, so the exchange by bucket
moves packed lists, and a bucket that every document holds is many rows, whose join Spark splits; the sums by bucket read no lists at all.
The drawn documents are numbered within ranges of their order (``ranking.numbered``). Sent to the driver: two numbers and how many documents can be drawn.

Null texts have no words. Rows stand for themselves: repeated ids and rows each get their features, weight and place; a null id is hashed as an empty name
and comes last among equal scores. Other columns are not read. An empty table of documents gives an empty result, an empty target corpus gives
every bucket the gain of none there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, slices, small_arrow_batches, text_bytes
from gridloom.llm.textnum import NOT_ALNUM, Words
from gridloom.operators.ranking import numbered

BUCKETS = 10_000
RUN = 1
#: Words that a document needs to be drawn; percent of such documents that are drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of text whose postings are listed together.
SLICE = 8 << 20
_SHORT = 24


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _further(crc: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
    """CRC-32 of what crc stands for with word which[i] appended to the i-th; column by column for short words, one by one for others."""
    sizes = (words.ends - words.starts)[which]
    state = ~crc
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")  # the longest first, so that those still at work are a prefix
    at, left = words.starts[which][order], sizes[order]
    some = state[order]
    long = int(np.searchsorted(-left, -_SHORT, "left"))
    for i in range(long):
        some[i] = ~np.uint32(zlib.crc32(words.word(which[order[i]]), int(~some[i])))
    for k in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        part = some[long:n]
        some[long:n] = _CRC[(part ^ words.buf[at[long:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    state[order] = some
    return ~state


def features(words: Words, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC-32) of every run of 1 to run consecutive words of a text, joined by one space."""
    text, every = words.text_of(), np.arange(len(words))
    crc = _further(np.zeros(len(words), np.uint32), words, every)
    yield text, crc
    for k in range(1, run):
        first = every[: max(len(every) - k, 0)]
        first = first[text[first] == text[first + k]]
        state = ~crc[: len(words)][first]
        state = _CRC[(state ^ 0x20) & 0xFF] ^ (state >> np.uint32(8))
        longer = np.zeros(len(words), np.uint32)
        longer[first] = _further(~state, words, first + k)
        crc = longer
        yield text[first], crc[first]


def postings(documents: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Lists of postings: bucket, n (features in it), docs, counts; and rows without bucket that tell of the documents: docs (a number of each), ids, counts (words).

    A document's number is made of its task and place there; it holds for one run of this pass, so write what comes out and read that.
    """
    small_arrow_batches(documents.sparkSession)
    kind = "bucket int, n long, docs array<long>, counts array<long>, ids array<long>"

    def lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int64()))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, ids = text_bytes(batch.column(1)), batch.column(0)
            for a, b in slices(list(map(len, texts)), SLICE):
                words = Words(texts[a:b], NOT_ALNUM, lower=True)
                found = [(crc % np.uint32(buckets)).astype(np.int64) * (b - a) + text for text, crc in features(words, run)]
                held, count = np.unique(np.concatenate(found), return_counts=True)
                bucket, doc = np.divmod(held, b - a)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                first = np.append(edges, len(held))
                sums = np.add.reduceat(count, edges) if len(edges) else np.empty(0, np.int64)
                none = np.zeros(len(edges) + 1, np.int64)
                yield pa.record_batch([pa.array(bucket[edges], pa.int32()), pa.array(sums, pa.int64()), lists(first, base + doc), lists(first, count), pa.ListArray.from_arrays(pa.array(none, pa.int32()), pa.array([], pa.int64()))], ["bucket", "n", "docs", "counts", "ids"])
                one = np.array([0, b - a])
                yield pa.record_batch([pa.array([None], pa.int32()), pa.array([0], pa.int64()), lists(one, base + np.arange(b - a)), lists(one, words.counts), pa.ListArray.from_arrays(pa.array(one, pa.int32()), ids.slice(a, b - a))], ["bucket", "n", "docs", "counts", "ids"])
                base += b - a

    return documents.select(F.col(documents.columns[0]).cast("long"), "text").mapInArrow(run_, kind)


def gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int = BUCKETS) -> Column:
    """Of a bucket with s of all_s features of the documents and t of all_t of the target."""
    d = lambda c: c.cast("double")
    return F.floor(1000 * F.log((d(t) + 1) * (d(all_s) + buckets) / ((d(s) + 1) * (d(all_t) + buckets))))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def floored(total: Column, n: Column) -> Column:
    """total / n, rounded down, of whole numbers; 0 for none."""
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0)).cast("long")


def weights(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc, doc_id, n_words, n_features, weight) of every row of documents; doc tells the rows apart. target: an id and a text, first."""
    lists, _ = materialise(postings(documents.select("doc_id", "text"), buckets, run), "postings")
    wanted = postings(target, buckets, run).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))
    held = lists.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(wanted).filter("bucket is not null")
    sums, _ = materialise(held.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    both = sums.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    gains = sums.select("bucket", gain(F.col("s"), F.col("t"), F.lit(both.s or 0), F.lit(both.t or 0), buckets).alias("gain"))
    each = lists.filter("bucket is not null").select("bucket", "docs", "counts").join(gains.hint("merge"), "bucket").select("gain", F.explode(F.arrays_zip("docs", "counts")).alias("p"))
    given = each.select(F.col("p.docs").alias("doc"), (F.col("p.counts") * F.col("gain")).alias("total"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"))
    known = lists.filter("bucket is null").select(F.explode(F.arrays_zip("docs", "ids", "counts")).alias("p"))
    known = known.select(F.col("p.docs").alias("doc"), F.lit(0).cast("long").alias("total"), F.col("p.ids").alias("doc_id"), F.col("p.counts").alias("n_words"))
    summed = given.unionByName(known).groupBy("doc").agg(F.sum("total").alias("total"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    of_length = [F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(run)]
    return summed.withColumn("n_features", sum(of_length[1:], of_length[0]).cast("long")).select("doc", "doc_id", "n_words", "n_features", floored(F.col("total"), F.col("n_features")).alias("weight"))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank from 1 for those drawn, else null."""
    scored, _ = materialise(weights(documents, target, buckets, run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.agg(F.count_if(able)).first()[0] * percent // 100
    placed = numbered(scored, [], [F.desc(able), F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc"], "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
