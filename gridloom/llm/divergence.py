"""Source divergence audit: how far apart the sources of a language are in their words, and by which words.

Terms are runs of ASCII letters and bytes beyond ASCII, A-Z lower-cased. A language keeps the V terms that at least ``LEAST`` of its
documents hold. A group, which is a source within a language, or a language as a whole, gives each kept term of count c the share
p(c) = 1 + floor(10^9 (c + 2) / (N + 2V)), N its number of kept terms in text. Two shares differ by f(p, q) = floor((p - q)^2 / (p + q)), and
two sources by the sum of f over all kept terms.

Most terms are in few sources, so the sum isn't taken term by term. A pair of groups starts at its baseline, V f(p(0), q(0)), as if no term
were in either. The inverted index, which lists for each term the groups that hold it and how often, then emits corrections only where
something isn't zero: what a term of count c in one group changes against an absent one, once for all terms of equal count there, and for
each term that both hold what that still leaves. Both sides of a pair get what is emitted; sums are exact whole numbers.

Work: one pass over the texts that counts terms per batch, so that a frequent term sends one row for a task; postings are then
one row for each term and source. Corrections grow with the posting lists' pairs, which number at most the square of the sources that share
a term, and with pairs of sources, which the result holds anyway. Groups are joined by checked sizes, nothing else is broadcast.

Null text, lang and source are the empty text and names. A source without terms is a group like any other. Repeated rows count as often as
they come; other columns are not read. An empty table gives an empty result; without kept terms all pairs have value 0 and no terms are ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import checked_join, materialise, small_arrow_batches, text_bytes

LEAST = 10
RANKS = 10
UNIT = 1_000_000_000
#: Terms counted in a worker's memory before they go on.
HELD = 200_000
_PIECE = 1 << 20
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, df long"


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term is in a text; long texts go in pieces that end between terms."""
    folded = text.translate(_FOLD)
    if len(folded) <= _PIECE:
        return Counter(folded.split())
    out: Counter[bytes] = Counter()
    begin = 0
    while begin < len(folded):
        end = folded.find(b" ", begin + _PIECE)
        end = len(folded) if end < 0 else end
        out.update(folded[begin:end].split())
        begin = end
    return out


def counted_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): counts in text and in documents, in parts to be summed; each group has a row of the null term."""
    small_arrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            every = [(*group, term, count, df[term]) for group, (n, df) in held.items() for term, count in n.items()]
            every += [(*group, None, 0, 0) for group in held]
            columns = list(zip(*every)) or [()] * 5
            held.clear()
            return pa.record_batch([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], ["lang", "source", "term", "n", "df"])

        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, text_bytes(batch.column("text"))):
                n, df = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                here = term_counts(text)
                n.update(here)
                df.update(here.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield rows()
        yield rows()

    return documents.select("lang", "source", "text").mapInArrow(run, _COUNTED)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; beyond nine thousand million in decimals, since so many times UNIT doesn't fit a long."""
    wide = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), (total + 2 * kept).cast("decimal(20,0)"))
    return F.when(count < 9_000_000_000, F.call_function("div", F.lit(UNIT).cast("long") * (count + 2), total + 2 * kept)).otherwise(wide) + 1


def _differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(documents: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the language (part pair), and the terms that a source uses more than its language (part term)."""
    counted, _ = materialise(counted_terms(documents).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    terms = counted.filter("term is not null")
    kept, kept_path = materialise(terms.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("df").alias("df")).filter(F.col("df") >= least).drop("df"), "kept")
    postings, _ = materialise(checked_join(terms.drop("df"), kept, kept_path, ["lang", "term"]), "postings")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("everywhere").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    groups, groups_path = materialise(groups, "groups")
    shares = checked_join(postings, groups, groups_path, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "p_lang": _share(F.col("everywhere"), F.col("lang_total"), F.col("v"))})
    shares, _ = materialise(shares.select("lang", "source", "term", "p", "p_lang", "p0"), "shares")
    return _ranked(_pair_values(groups, groups_path, shares), "pair", None).unionByName(
        _ranked(shares.filter("p > p_lang").select("lang", "source", F.col("term").alias("item"), _differ(F.col("p"), F.col("p_lang")).alias("value")), "term", ranks)
    )


def _pair_values(groups: DataFrame, groups_path: str, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    baseline = checked_join(groups, other, groups_path, "lang").filter(apart).select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _differ(F.col("p0"), F.col("q0"))).otherwise(F.lit(0)).alias("value"))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    one = checked_join(alike, other, groups_path, "lang").filter(apart).select("lang", "source", "item", (F.col("terms") * (_differ(F.col("p"), F.col("q0")) - _differ(F.col("p0"), F.col("q0")))).alias("value"))
    there = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    left = _differ(F.col("p"), F.col("q")) - _differ(F.col("p"), F.col("q0")) - _differ(F.col("p0"), F.col("q")) + _differ(F.col("p0"), F.col("q0"))
    both = shares.drop("p_lang").join(there, ["lang", "term"]).filter(F.col("source") < F.col("item")).select("lang", "source", "item", left.alias("value"))
    half = one.unionByName(both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return baseline.unionByName(half).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(values: DataFrame, part: str, ranks: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(order))
    return (out if ranks is None else out.filter(F.col("rank") <= ranks)).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
