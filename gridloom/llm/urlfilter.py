"""URL filters: hand-written rules first, then rules mined from labels by FP-growth.

A URL becomes a set of tokens (labels of its host, segments of its path with digits folded, file ending, names of query
parameters, fragment). Token sets of labelled URLs, with one more token for those labelled bad, go through Spark's FP-growth;
tokens that occur in the same labelled URLs are one item there, so a long URL that comes often is a set of one, not of all
its parts. Association rules that conclude "bad" are kept if their support and confidence suffice, they say more than the share of bad URLs
does (lift above 1, or certain) and no rule on fewer of their tokens is as confident. An inverted index from the rarest token of a rule to the rule finds what matches a URL:
of items that stand for several tokens a URL needs one, as each of these tokens alone would make the same rule.

Null URLs and those without ``://`` have an empty host and path, no tokens, and are allowed unless a rule says otherwise. Repeated
pages are each judged; of hand-written rules of equal length the first in the list wins. Without labelled URLs no rule is mined; an empty
table gives an empty result. Other columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checked_join, delete_quietly, materialise

BAD = "=bad"
#: A rule's support: a share of the labelled URLs, and so many of them at least, since one occurrence says nothing.
MIN_SUPPORT, MIN_COUNT = 0.002, 5
MIN_CONFIDENCE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, sorted."""
    tail = F.coalesce(_rest(url), F.lit(""))
    path = F.regexp_replace(path_of(url), "[0-9]+", "0")
    prefixed = lambda p, parts: F.transform(parts, lambda x: F.concat(F.lit(p), x))
    query = F.regexp_extract(tail, r"\?([^#]*)", 1)
    parts = [
        prefixed("host:", F.split(host_of(url), r"\.")),
        prefixed("path:", F.split(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), "/")),
        F.array(F.concat(F.lit("end:"), F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))),
        prefixed("query:", F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])),
        F.when(F.contains(tail, F.lit("#")), F.array(F.lit("fragment:1"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: ~x.endswith(":"))))


def alike(baskets: DataFrame) -> DataFrame:
    """(token, item, any_of): tokens that are in the same baskets are one item, named by the first of them; any_of lists them.

    Two tokens are in the same baskets if as many distinct ones hold them and two 64-bit sums over these baskets agree.
    """
    distinct = baskets.select(F.array_sort("tokens").alias("tokens")).distinct().select("tokens", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("b"), "tokens").alias("b"))
    where = distinct.select(F.explode("tokens").alias("token"), "a", "b").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    return where.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("any_of")).select(F.explode("any_of").alias("token"), F.col("any_of")[0].alias("item"), "any_of")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from labelled URLs with the columns url and bad: tokens, any_of (for each of these what stands for it, itself too), index_token, confidence, support.

    A rule has one row for each token that stands for the rarest of its tokens, in index_token.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    known = labelled.filter(F.col("url").isNotNull() & F.col("bad").isNotNull())
    baskets, baskets_path = materialise(known.select(F.monotonically_increasing_id().alias("id"), "bad", tokens_of(F.col("url")).alias("tokens")), "baskets")
    n = baskets.count()
    if n < MIN_COUNT:
        return spark.createDataFrame([], "tokens array<string>, any_of array<array<string>>, index_token string, confidence double, support double")
    items, items_path = materialise(alike(baskets), "items")
    as_items = checked_join(baskets.select("id", F.explode("tokens").alias("token")), items.select("token", "item"), items_path, "token").groupBy("id").agg(F.collect_set("item").alias("items"))
    marked = baskets.select("id", "bad").join(as_items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    marked, marked_path = materialise(marked, "marked")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_COUNT / n), minConfidence=min_confidence).fit(marked)
    rules, rules_path = materialise(
        model.associationRules.filter(F.array_contains("consequent", BAD) & ((F.col("lift") > 1 + 1e-9) | (F.col("confidence") == 1)))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"),
        "mined",
    )  # written: mining is not done again for each use
    # A rule goes if one on fewer of its tokens is as confident: those that hold one of its tokens are looked up.
    simpler = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("simpler"))
    redundant = (
        rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
        .join(simpler.withColumn("token", F.col("part")[0]), "token")
        .filter((F.size("part") < F.size("tokens")) & (F.col("simpler") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
        .select("tokens")
        .distinct()
    )
    kept = rules.join(redundant, "tokens", "left_anti")
    freq = marked.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    stands = items.select(F.col("item").alias("token"), "any_of").distinct()
    each = kept.select("*", F.explode("tokens").alias("token")).join(freq, "token").join(stands, "token").groupBy("tokens").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"), F.array_sort(F.collect_list("any_of")).alias("any_of"), F.min(F.struct("freq", "any_of")).alias("rarest"))
    out, _ = materialise(each.select("tokens", "any_of", F.explode("rarest.any_of").alias("index_token"), "confidence", "support"), "rules")
    for path in (baskets_path, items_path, marked_path, rules_path):
        delete_quietly(spark, path)
    return out


def mined_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that a mined rule blocks, with the most confident rule's confidence."""
    index, index_path = materialise(rules.drop("tokens"), "rules")
    listed = urls.select("url").filter(F.col("url").isNotNull()).distinct().select("url", tokens_of(F.col("url")).alias("has"))
    return (
        checked_join(listed.select("url", "has", F.explode("has").alias("index_token")), index, index_path, "index_token")
        .filter(F.forall("any_of", lambda some: F.arrays_overlap(some, F.col("has"))))
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule 'host/path' that fits; null where none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        at, start = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence: the rules' verdict, else block where a mined rule matches, else allow."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    listed = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    listed = listed.withColumns({"rule": rule, "ruled": verdict})
    # Written: broadcast if it is small, else a join of two exchanges, whose skew Spark can split where many pages share a URL.
    blocked, path = materialise(mined_verdict(listed.filter(F.col("ruled").isNull()), mined), "blocked")
    return checked_join(listed, blocked, path, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence"
    )
