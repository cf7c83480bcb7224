"""Importance resampling, the divergence audit and byte-level BPE against brute force, over the same tables as the other operators."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bytebpe, divergence, importance, queries, tokencount
from gridloom.llm.textnum import NOT_ALNUM, Words
from tests.llm import data

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("gathered"))


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def alike(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def resampled(documents, items, percent=10, run=1, buckets=10_000):
    """(doc_id, n_features, weight, score) of each row, and the scores that are drawn, in order."""
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    split = [alnum(t) for _, t in documents]
    ours = [Counter(map(bucket, runs(w))) for w in split]
    s, t = sum(ours, Counter()), sum((Counter(map(bucket, runs(alnum(x)))) for x in items), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, able = [], []
    for (doc_id, _), w, counts in zip(documents, split, ours):
        n = sum(counts.values())
        weight = sum(gain(b) * c for b, c in counts.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, n, weight, score))
        if len(w) >= 20:
            able.append((-score, doc_id is None, doc_id or 0))
    return out, sorted(able)[: percent * len(able) // 100]


def held_to(got, want, drawn):
    alike([r[:4] for r in got], want)
    placed = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [p[0] for p in placed] == list(range(1, len(drawn) + 1)) and [p[1:] for p in placed] == drawn


def test_resampling(spark, sf, rows):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held_to(queries.queries()["op11_bucket_postings"](spark, sf).collect(), *resampled([(r.doc_id, r.text) for r in rows], items))


@pytest.mark.parametrize("run", [2, 3])
def test_resampling_by_longer_runs(spark, sf, rows, run):
    documents, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    got = importance.resample(documents, target, percent=50, buckets=97, run=run).collect()
    held_to(got, *resampled([(r.doc_id, r.text) for r in rows], [r.text for r in target.collect()], 50, run, 97))


def test_resampling_with_ties_and_no_target(spark):
    """Equal rows, of which some are drawn and some not, and a target without words."""
    copies = [(i % 3, "a b c " * 10, f"x{i}") for i in range(50)] + [(None, "a b c " * 10, "y")] * 3 + [(1, None, "z"), (2, "", "z")]
    documents = spark.createDataFrame(copies, "doc_id long, text string, bucket string").repartition(5)
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    held_to(importance.resample(documents, target).collect(), *resampled([c[:2] for c in copies], []))
    held_to(importance.resample(documents, target.limit(0), percent=100).collect(), *resampled([c[:2] for c in copies], [], 100))


@given(st.lists(st.text(alphabet="aZé9_ 漢" + "q", max_size=60), max_size=5), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_checksums_of_runs(texts, run):
    words = Words([t.encode() for t in texts], NOT_ALNUM, lower=True)
    got = Counter((int(t), int(c)) for text, crc in importance.features(words, run) for t, c in zip(text, crc))
    want = Counter((i, zlib.crc32(" ".join(w[j : j + k]).encode())) for i, w in enumerate(map(alnum, texts)) for k in range(1, run + 1) for j in range(len(w) - k + 1))
    assert got == want


def audited(rows, least=10, ranks=10):
    terms = [(r.lang or "", r.source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(r.text))) for r in rows]
    df, n, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        groups[lang].add(source)
        df.update({(lang, w) for w in words})
        n[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), c in df.items() if x == lang and c >= least]

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources - {s})
            term = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if n[lang, s][w] and p[s][w] > q[w])[:ranks]
            out += [(lang, s, part, item.decode(), -v, i) for part, some in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(some, 1)]
    return out


def test_audit(spark, sf, rows):
    alike(queries.queries()["op12_baseline_corrections"](spark, sf).collect(), audited(rows))


def test_audit_of_many_sources(spark, monkeypatch):
    """A term that every source holds, sources without terms, ties among terms, counts that go on in parts, texts cut in pieces."""
    monkeypatch.setattr(divergence, "_PIECE", 40)
    monkeypatch.setattr(divergence, "HELD", 5)
    r = random.Random(8)
    texts = [(r.choice(["en", "", None]), f"s{r.randrange(12)}", " ".join(r.choice(["Für", "the", "漢字", "b-c", f"t{r.randrange(9)}", "x9y"]) for _ in range(r.randrange(30)))) for _ in range(400)]
    texts += [("en", "none", None), ("en", "none", " 12 "), ("zz", "alone", "the"), (None, None, "the")]
    df = spark.createDataFrame(texts, "lang string, source string, text string")
    for least in (10, 1, 10_000):
        alike(divergence.audit(df, least=least).collect(), audited(df.collect(), least))


def test_shares_beyond_longs(spark):
    from pyspark.sql import functions as F

    for n, total, v in ((8_999_999_998, 9_000_000_000, 3), (9_000_000_000, 10**13, 7), (10**16, 10**17 + 3, 10**6), (0, 0, 1)):
        got = spark.range(1).select(divergence._share(*(F.lit(x).cast("long") for x in (n, total, v)))).first()[0]
        assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark, sf, rows, library):
    want = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    alike(queries.queries()["op13_transition_scan"](spark, sf).collect(), want)


_LIKELY = "  \n\t'strevmdlSL1²é漢🙂\xa0 !-x\x1c\x85٣\U000105c0\0"


@given(st.lists(st.text(alphabet=_LIKELY, max_size=40) | st.text(max_size=20), max_size=12))
@settings(max_examples=300, deadline=None)
def test_pieces_and_tokens(library, texts):
    bpe = bytebpe.codec(RANKS)
    got = dict(bpe.encode(texts))
    for i, text in enumerate(texts):
        ids, offsets = got[i].ids, got[i].offsets
        assert ids.tolist() == library.encode_ordinary(text) and bpe.decode(ids) == text.encode()
        assert offsets[-1] == len(text.encode()) and all(bpe.decode(ids[k : k + 1]) == text.encode()[offsets[k] : offsets[k + 1]] for k in range(len(ids)))


def test_long_texts_and_pieces(library, monkeypatch):
    """Texts cut into parts, pieces beyond SHORT, and a cache that forgets."""
    monkeypatch.setattr(bytebpe, "SLICE", 500)
    monkeypatch.setattr(bytebpe.cut, "__defaults__", (500,))
    r, bpe = random.Random(4), bytebpe.Codec(RANKS, cache_bytes=2_000)
    texts = [" ".join(r.choice(["it's", "12 ", "\n\n", "q" * 70, "ünd", "漢" * 30, "  ", "'ll"]) for _ in range(400)), "q" * 3_000 + "\n " * 600, " " * 2_000, "ab" * 900 + "'s"]
    for i, text in enumerate(texts):
        parts = [part.ids for _, part in bpe.encode([text])]
        assert np.concatenate(parts).tolist() == library.encode_ordinary(text), i
    assert len(list(bpe.encode(texts[:1]))) > 3


@pytest.mark.parametrize("limit", (tokencount.BROADCAST_LIMIT, 0))
def test_only_what_the_cache_lacks_is_encoded(spark, tmp_path, monkeypatch, limit):
    """Digests meet the cache first, whether the missing ones are few enough to be told to each task or not."""
    monkeypatch.setattr(tokencount, "BROADCAST_LIMIT", limit)
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(i, f"word {i % 9}" if i % 5 else None) for i in range(60)], "doc_id long, text string").repartition(3)
    tokencount.count_tokens(df.filter("doc_id < 4"), path, cache).collect()
    held = {bytes(r.digest) for r in spark.read.parquet(cache).collect()}
    new = tokencount.encode_misses(df, tokencount.open_cache(spark, cache), path)
    digests = [bytes(r.digest) for r in new.collect()]
    assert len(held) == 4 and len(digests) == len(set(digests)) == 6 and not held & set(digests)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path, cache).collect()}
    assert got == {i: 2 if i % 5 else 0 for i in range(60)} and spark.read.parquet(cache).count() == 10
