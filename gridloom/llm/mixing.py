"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of source, language and topic. Raking multiplies the cells' tokens in turn so that the sums by
source, by language and by topic meet their target shares; what a cell was multiplied with is its documents' weight.
A document's sampling probability is its weight times one scale, 1 at most; the scale is set so that ``KEEP`` of all tokens
stay in expectation. Cells that would need more than they have stay whole, and the others make up for it. A document stays if a
hash of its id falls below its probability.

``every_source`` gives each source that occurs a target of its own: those that a target names keep it, and the target of REST is
dealt over all others, null too, by the power ``TEMPER`` of their tokens. The pipeline mixes by that; the targets as they are, with one
source named, are what the SQL of op9 says.

Categories that a target doesn't name share the target of ``REST``. A target for a category without tokens is dropped and
the others are scaled up. Null sources and languages count as REST, null texts have no tokens; documents of cells without
tokens stay. Rows with equal doc_id share their fate. The table of cells has one row for each combination of named
categories, whatever the input's size; with every source, for each combination of a source with these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "*"
ITERATIONS = 30
KEEP = 0.85
DIMENSIONS = ("source", "lang", "topic")
#: Target shares of tokens.
TARGETS = {
    "source": {"src0": 0.32, REST: 0.68},
    "lang": {"en": 0.62, "de": 0.13, "fr": 0.13, "es": 0.1, REST: 0.02},
    "topic": {"prose": 0.85, "contact": 0.07, "legal": 0.04, "table": 0.04},
}
TEMPER = 0.5
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from a text's form; null texts are prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(F.lower(text), F.lit("license")), "legal").when(F.contains(text, F.lit("@")), "contact").otherwise("prose")


def _named(column: str, targets: dict) -> Column:
    return F.when(F.col(column).isin(*[k for k in targets[column] if k != REST]), F.col(column)).otherwise(REST)


def cells(documents: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """documents with topic, n_tokens, cell_source, cell_lang and cell_topic, instead of columns of those names or probability."""
    out = documents.drop("probability").withColumns({"topic": topic(F.col("text")), "n_tokens": n_tokens(F.col("text"))})
    return out.withColumns({f"cell_{d}": _named(d, targets) for d in DIMENSIONS})


def _counted(documents: DataFrame, targets: dict, source: Column) -> dict[tuple[str | None, str, str], int]:
    """Tokens by source, named language and topic: the one pass that counts words."""
    by = [source.alias("s"), _named("lang", targets).alias("l"), topic(F.col("text")).alias("t")]
    return {(r.s, r.l, r.t): r.n for r in documents.groupBy(*by).agg(F.sum(n_tokens(F.col("text"))).alias("n")).collect()}


def _dealt(counted: dict[tuple[str | None, str, str], int], targets: dict) -> dict:
    """targets with a share for each source that has tokens; see every_source."""
    named = targets["source"]
    others: dict[str, float] = {}
    for (source, _, _), n in counted.items():
        c = REST if source is None else source
        if n and (c == REST or c not in named):
            others[c] = others.get(c, 0.0) + n
    weight = {c: n**TEMPER for c, n in others.items()}
    rest = named.get(REST, 0.0) / sum(weight.values()) if weight else 0.0
    return {**targets, "source": {c: v for c, v in named.items() if c != REST} | {c: v * rest for c, v in weight.items()}}


def every_source(documents: DataFrame, targets: dict = TARGETS) -> dict:
    """targets with a share for each source that has tokens; null sources stay REST. A source of the name REST counts as null."""
    return _dealt(_counted(documents, targets, F.col("source")), targets)


def rake(tokens: dict[tuple[str, ...], float], targets: dict = TARGETS, iterations: int = ITERATIONS) -> dict[tuple[str, ...], float]:
    """The factor of each cell that has tokens."""
    mass = {k: float(v) for k, v in tokens.items() if v}
    total = sum(mass.values())
    for _ in range(iterations):
        for d, name in enumerate(DIMENSIONS):
            sums: dict[str, float] = {}
            for k, v in mass.items():
                sums[k[d]] = sums.get(k[d], 0.0) + v
            share = sum(targets[name].get(c, 0.0) for c in sums)
            mass = {k: v * (total * targets[name].get(k[d], 0.0) / share) / sums[k[d]] if share else v for k, v in mass.items()}
    return {k: v / tokens[k] for k, v in mass.items()}


def calibrate(factors: dict[tuple[str, ...], float], tokens: dict[tuple[str, ...], float], keep: float = KEEP) -> dict[tuple[str, ...], float]:
    """Each cell's probability: its factor times a scale, 1 at most, so that keep of all tokens stay in expectation."""
    order = sorted(factors, key=lambda k: -factors[k])
    budget, rest = keep * sum(tokens.values()), sum(tokens[k] * factors[k] for k in factors)
    scale = float("inf")
    for k in order:  # from the largest factor; cells before this one stay whole
        if rest <= 0 or budget * factors[k] <= rest:
            scale = max(budget, 0.0) / rest if rest > 0 else 0.0
            break
        budget -= tokens[k]
        rest -= tokens[k] * factors[k]
    return {k: min(1.0, f * scale) if f else 0.0 for k, f in factors.items()}


def probabilities(documents: DataFrame, targets: dict | None = None, keep: float = KEEP) -> DataFrame:
    """cells(documents) with each document's sampling probability; by every_source unless targets are given."""
    if targets is None:  # sources as they are, which the same counts give their targets
        counted = _counted(documents, TARGETS, F.col("source"))
        targets = _dealt(counted, TARGETS)
    else:
        counted = _counted(documents, targets, _named("source", targets))
    keys = [f"cell_{d}" for d in DIMENSIONS]
    tokens: dict[tuple[str, ...], int] = {}
    for (source, *other), n in counted.items():
        k = (source if source in targets["source"] else REST, *other)
        tokens[k] = tokens.get(k, 0) + n
    mixed = cells(documents, targets)
    rates = calibrate(rake(tokens, targets), tokens, keep)
    rates = documents.sparkSession.createDataFrame([(*k, v) for k, v in sorted(rates.items())], ", ".join(f"{k} string" for k in keys) + ", probability double")
    return mixed.join(F.broadcast(rates), keys, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that the id decides."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample(documents: DataFrame, targets: dict | None = TARGETS, seed: str = SEED) -> DataFrame:
    """The sampled documents, with the columns that probabilities() adds."""
    return probabilities(documents, targets).filter(chance(F.col("doc_id"), seed) < F.col("probability"))


def mix(documents: DataFrame, targets: dict | None = TARGETS, seed: str = SEED) -> DataFrame:
    """The sampled documents with their own columns only."""
    columns = documents.columns
    inner = documents.select(F.struct(*columns).alias("row"), "doc_id", "text", "source", "lang")
    return sample(inner, targets, seed).select("row.*")
