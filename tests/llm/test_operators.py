"""Each operator against a brute-force version, over tables with nulls, empty and long texts, ties, repeats and clashing names."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import common, decontaminate, mixing, order_minhash, quality, queries, sharding, substring, textnum, tokencount, topk, urlfilter, warc
from tests.llm import data


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("nasty"))


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("nothing"), empty=True)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).collect() == []


def words(text):
    return [w for w in (text or "").encode().split()]


def run(spark, sf, name):
    return queries.queries()[name](spark, sf).collect()


def levenshtein(a, b):
    """Word edit distance, a row of the table at a time."""
    ids = {w: i for i, w in enumerate({*a, *b})}
    x, y = [ids[w] for w in a], np.array([ids[w] for w in b])
    row = at = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def near_classes(rows):
    return _near_classes(tuple(rows))


def near(x, y):
    """Whether two word lists are near-duplicates: by edit distance alone. What shares too few words has too many edits."""
    most = 0.2 * max(len(x), len(y)) + 1e-9
    if max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) > most:
        return False
    return levenshtein(x, y) <= most


@functools.cache
def _near_classes(rows):
    """Smallest id of each row's group, by comparing all pairs."""
    texts = sorted({t or "" for _, t in rows})
    split = [words(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if find(a) != find(b) and near(split[a], split[b]):
                parent[find(a)] = find(b)
    least = {}
    of = {t: find(i) for i, t in enumerate(texts)}
    for i, t in rows:
        if i is not None:
            least[of[t or ""]] = min(i, least.get(of[t or ""], i))
    return {(i, t): least.get(of[t or ""]) for i, t in rows}


def test_near_duplicates(spark, sf, docs):
    got = run(spark, sf, "op1_order_minhash")
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, near_classes(docs)[i, t])) for i, t in docs)


def test_deduplicate_keeps_one_of_each_group(spark, sf, docs):
    kept = order_minhash.deduplicate(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    want = {c for (i, _), c in near_classes(docs).items() if c is not None}
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(want)


def test_crowds_of_near_copies(spark, monkeypatch):
    """Groups far above ALL_PAIRS, with copies on both sides of the threshold, come out as all pairs would have it."""
    import random

    monkeypatch.setattr(order_minhash, "ALL_PAIRS", 4)
    r = random.Random(2)
    base, line = data.prose(r, 200), data.prose(r, 12)
    rows = [(i, data.edited(r, base, r.choice([0, 0.01, 0.02, 0.03, 0.08]))) for i in range(80)]
    rows += [(100 + i, data.prose(r, 8) + " " + line + " " + data.prose(r, 5)) for i in range(40)]
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for (i, _), c in near_classes(rows).items()}
    assert got == want


def test_edit_distance():
    import random

    r = random.Random(1)
    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(30))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(4) for _ in range(r.randrange(4))]
        most = r.randrange(20)
        assert order_minhash.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(levenshtein(a, b), most + 1)


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = run(spark, sf, "op2_warc_index")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    keeper = {}
    for i, p in rows:
        if len(p) >= 1000 and i is not None:
            keeper[p] = max(i, keeper.get(p, i))
    want = []
    for i, p in rows:
        k = keeper.get(p)
        revisit = k is not None and k != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    archive = warc.write_archive(pages, f"file://{tmp_path}/w")
    found = list(warc.lookup(spark, archive, "com,a)/de/x.html"))
    assert len(found) == 2 and all(h["WARC-Target-URI"] == "http://a.com/de/x.html" for h, _ in found)
    assert {h["WARC-Type"] for h, _ in found} == {"response"} and list(warc.lookup(spark, archive, "com,a)/none")) == []
    assert list(warc.lookup(spark, archive, "fr,com,b)")) == []


def removed_words(rows):
    """Per row, the flags of words to remove."""
    places = defaultdict(list)
    split = [words(t) for _, t in rows]
    key = lambda i: (-(2**63) if i is None else i)
    for (i, _), w in zip(rows, split):
        for s in range(len(w) - 19):
            places[tuple(w[s : s + 20])].append((key(i), s))
    first = {k: min(v) for k, v in places.items()}
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (key(i), s):
                gone[s : s + 20] = [True] * 20
        out.append(gone)
    return split, out


def test_substring_dedup(spark, sf, docs):
    split, gone = removed_words(docs)
    want = [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(docs, split, gone)]
    assert sorted(map(repr, map(tuple, run(spark, sf, "op3_fixed_block_anchors")))) == sorted(map(repr, want))
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    cut = substring.without_repeats(whole)
    assert cut.columns == whole.columns
    texts = Counter(r.text for r in cut.select("text").collect())
    assert texts == Counter(t if not any(g) else b" ".join(x for x, y in zip(w, g) if not y).decode() for (_, t), w, g in zip(docs, split, gone))


def test_substring_dedup_where_nothing_is_broadcast(spark, sf, docs, monkeypatch, request):
    """Every join by a shuffle, after which rows are put in order."""
    monkeypatch.setattr(common, "BROADCAST_LIMIT", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before))
    split, gone = removed_words(docs)
    want = [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(docs, split, gone)]
    assert sorted(map(repr, map(tuple, run(spark, sf, "op3_fixed_block_anchors")))) == sorted(map(repr, want))
    plan = substring._named(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), [])._jdf.queryExecution().executedPlan().toString()
    assert "Sort [id" in plan and "BroadcastHashJoin" not in plan


def test_exact_top_k(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries_ = {}
    for i, v in ok:
        if i % 20 == 0:
            queries_[i] = min(v, queries_.get(i, v))
    want = []
    for q, x in queries_.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, run(spark, sf, "op4_pivot_top_k"))) == sorted(want)


@pytest.mark.parametrize("block, numbers", [(5, 4 << 20), (16_384, 40), (16_384, 1)])
def test_top_k_over_many_candidates_and_blocks(spark, monkeypatch, block, numbers):
    monkeypatch.setattr(topk, "QUERY_NUMBERS", numbers)
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    from pyspark.sql import functions as F

    for row in topk.top_k(df.coalesce(1), F.col("vec_id") % 500 == 0, 5, query_block=block).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    z = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 6000, 500):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(6000), -s)) if i != q][:5]
        assert got[q] == [(i, s[i]) for i in order]


def test_top_k_beyond_exact_floats(spark):
    from pyspark.sql import functions as F

    rows = [(i, [3e9 + 64 * i, -1e9]) for i in range(60)] + [(100, [1e20, 1.0]), (101, [1e20, 2.0]), (102, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for row in topk.top_k(df.coalesce(1), F.lit(True), 3).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    z = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    for q, x in z.items():
        order = sorted((-min(max(sum(a * b for a, b in zip(x, y)), 1 - 2**63), 2**63 - 1), i) for i, y in z.items() if i != q)[:3]
        assert got[q] == [(i, -s) for s, i in order]


def test_pivots_eliminate_without_loss():
    r = np.random.default_rng(6)
    centres = r.normal(size=(20, 16)) * 200
    x = np.floor(centres[r.integers(0, 20, 12_000)] + r.normal(size=(12_000, 16)) * 20)
    pivots, ids = topk.choose_pivots(x[:512], topk.PIVOTS), np.arange(12_000)
    best, q = topk.Best(), x[7]
    far, kept = topk._distances(x[7:8], pivots)[0], []
    for a in range(0, 12_000, 4_000):  # later batches meet what earlier ones found
        held = topk.Candidates(ids[a : a + 4_000], x[a : a + 4_000], pivots)
        upper = held.upper(float(q @ q), far)
        assert (upper >= held.x @ q).all()
        kept.append((upper >= best.least(20)).mean())
        topk.improve(best, 7, q, far, held, 20)
    assert kept[0] == 1 and max(kept[1:]) < 0.2
    scores = x @ q
    order = [i for i in np.lexsort((ids, -scores)) if i != 7][:20]
    assert best.ids.tolist() == order and best.scores.tolist() == scores[order].tolist()


def test_token_counts_and_cache(spark, sf, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = run(spark, sf, "op5_token_counts")
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len((t or "").encode()), n(t), n(t) > 2048)) for i, t in docs)
    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "one two"), (2, " one  two\n"), (3, None), (4, "three")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df.limit(2), path, cache).collect()} == {1: 2, 2: 2}
    assert spark.read.parquet(cache).count() == 1
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path, cache).collect()} == {1: 2, 2: 2, 3: 0, 4: 1}
    assert spark.read.parquet(cache).count() == 3


def test_counter_equals_library():
    import random

    import public_tokenizers

    count, r = tokencount.Counter(public_tokenizers.path("word_bpe_49k.json"), pieces=40), random.Random(6)
    letters = "abcxyzABCÀÉßÿñ0189 \t\n\r.,'!-<|>/@×÷½ªµ²́İσΣς漢🙂 ​\x0b\x1c"
    for i in range(3000):
        t = "".join(r.choice(letters) if r.random() < 0.7 else r.choice(["'s", "'ll", "<|endoftext|>", "the ", "IT'S", "and "]) for _ in range(r.randrange(25)))
        t = "".join(c for c in t if ord(c) < 0x7F) if i % 3 else t
        assert count([t])[0] == len(count.library.encode(t, add_special_tokens=False).ids), t


def test_url_rules(spark, sf):
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in run(spark, sf, "op6_url_rules")}
    assert got[1, "www.example.org", "/en/1"] == ("example.org/en/1", "block")
    assert got[2, "", ""] == (None, "allow") and got[3, "", ""] == (None, "allow")
    assert got[4, "a.com", "/de/x.html"] == ("com/de/", "block") and got[None, "b.com:80", ""] == (None, "allow")
    assert got[6, "example.org", "/es/"] == ("example.org/es/", "block") and got[7, "b.fr.com", "/fr/7"] == ("com/fr/", "allow")


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.net/{'ads' if i % 4 == 1 else 'news'}/{i}", i % 4 == 1 or i == 8) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = urlfilter.mine(df)
    assert [(r.tokens, r.confidence) for r in rules.collect()] == [(["path:ads"], 1.0)]
    judged = {r.page_id: r.verdict for r in urlfilter.judge(df, [], rules).collect()}
    assert judged == {i: "block" if i % 4 == 1 else "allow" for i in range(80)}


def test_mined_verdicts_by_brute_force(spark):
    """Verdicts against all combinations of tokens counted one by one."""
    from itertools import combinations

    r = random.Random(21)
    rows = [(i, f"http://{r.choice(['a', 'b'])}.net/{r.choice(['x', 'y', 'z'])}/{r.choice(['p', 'q'])}?{r.choice(['k', 'l'])}=1", None) for i in range(400)]
    rows = [(i, u, ("/x/" in u and "?k" in u) != (r.random() < 0.1)) for i, u, _ in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    has = {x.page_id: frozenset(x.has) for x in df.select("page_id", urlfilter.tokens_of(df.url).alias("has")).collect()}
    times, bads = Counter(), Counter()
    for i, _, bad in rows:
        for k in range(1, len(has[i]) + 1):
            for c in combinations(sorted(has[i]), k):
                times[c] += 1
                bads[c] += bad
    base = sum(b for _, _, b in rows) / len(rows)
    rules = {c for c in bads if bads[c] >= urlfilter.MIN_COUNT and bads[c] / times[c] >= urlfilter.MIN_CONFIDENCE and bads[c] / times[c] > base}
    want = {i: "block" if any(set(c) <= has[i] for c in rules) else "allow" for i, _, _ in rows}
    assert len(set(want.values())) == 2 and {x.page_id: x.verdict for x in urlfilter.judge(df, [], urlfilter.mine(df)).collect()} == want


def test_ftrl_one_number_at_a_time():
    """Weights against the same updates written out for single numbers, and scores against their sums."""
    r, rows = random.Random(3), []
    for _ in range(30):
        index = sorted(r.sample(range(40), 6))
        rows.append((np.array(index, np.uint32), np.array([r.random() * 3 for _ in index], np.float32), r.randrange(2)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.05
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(6):
        for index, value, label in rows:
            x = {**{int(i): float(v) for i, v in zip(index, value)}, "one": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    weights, intercept = quality.ftrl(rows)
    assert abs(intercept - weight("one")) < 1e-9 and all(abs(weights[i] - weight(i)) < 1e-6 for i in range(40)) and not weights[40:].any()
    text = b"Some words here, some words there"
    grams = np.concatenate([g for g, _ in quality._grams(textnum.Words([text], textnum.SPACE))])
    w = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    assert abs(quality.score_texts([text], w, 0.25)[0] - 1 / (1 + math.exp(-(0.25 + quality.SCALE * sum(float(w[i]) for i in grams) / len(grams))))) < 1e-6


def test_training_texts_are_bounded_by_bytes(spark, monkeypatch):
    """Long and repeated training texts: whole ones up to the bound, and one at least."""
    monkeypatch.setattr(quality, "MAX_BYTES", 5000)
    rows = [(i, ("good prose here " if i % 2 else "BAD!! JUNK!! ") * 60) for i in range(40)] + [(1, "good prose here " * 60)] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "ftrl", lambda rows: seen.append(len(rows)) or (np.zeros(1 << quality.BITS, np.float32), 0.0))
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert 1 <= seen[0] <= 7


def test_quality_scores(spark, sf, docs):
    got = run(spark, sf, "op7_quality")
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by_id = {r.doc_id: r for r in got}
    junk = [i for i, t in docs if i is not None and t and "!!" in t]
    held = [i for i in junk if by_id[i].held_out]
    assert held and all(by_id[i].predicted == 0 for i in junk)
    assert all(by_id[i].predicted == 1 for i in range(5, 120))


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.predicted, label[r.doc_id]) for r in run(spark, sf, "op7_quality") if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in rows]) >= 0.97


def test_virtual_slots(spark, sf, docs):
    got = run(spark, sf, "op8_virtual_slots")
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    places, shard_of = defaultdict(list), {}
    for r in got:
        places[r.shard].append(r.slot)
        assert shard_of.setdefault(r.virtual_slot, r.shard) == r.shard and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    # The map: slots from the largest, each to the shard with the fewest bytes so far.
    sizes, loads = Counter(), [0] * 16
    for r in got:
        sizes[r.virtual_slot] += r.size
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        shard = loads.index(min(loads))
        assert shard_of[slot] == shard
        loads[shard] += size


def test_slots_balance_and_move_little(spark, tmp_path):
    r = np.random.default_rng(3)
    sizes = r.integers(50_000, 400_000, sharding.SLOTS).tolist()
    first = sharding.deal(sizes, 16)
    loads = first.loads(sizes)
    assert max(loads) - min(loads) < 0.002 * sum(sizes) / 16
    grown = sharding.rebalance(first, sizes, 17)
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of) if a != b]
    assert {b for _, b in moved} == {16} and len(moved) < 1.2 * sharding.SLOTS / 17 and grown.version == 2
    assert max(grown.loads(sizes)) < 1.02 * sum(sizes) / 17
    shrunk = sharding.rebalance(grown, sizes, 15)
    assert set(shrunk.shard_of) == set(range(15)) and all(a == b for a, b in zip(grown.shard_of, shrunk.shard_of) if a < 15)
    path = f"file://{tmp_path}/map"
    for m in (first, grown):
        sharding.store(spark, m, path)
    assert sharding.load(spark, path) == grown and sharding.load(spark, path, 1) == first


def test_raking():
    r = np.random.default_rng(8)
    tokens = {(s, g, t): float(r.integers(1, 10_000)) for s in ("src0", "*") for g in ("en", "de", "fr", "es", "*") for t in ("prose", "legal", "table", "contact")}
    f = mixing.rake(tokens)
    total = sum(tokens.values())
    for d, name in enumerate(mixing.DIMENSIONS):
        for c, share in mixing.TARGETS[name].items():
            assert abs(sum(f[k] * v for k, v in tokens.items() if k[d] == c) / total - share) < 1e-4
    p = mixing.calibrate(f, tokens)
    assert abs(sum(p[k] * v for k, v in tokens.items()) / total - mixing.KEEP) < 1e-9 and max(p.values()) <= 1
    free = [k for k in p if p[k] < 1]
    assert len({round(p[k] / f[k], 9) for k in free}) == 1


def test_sample(spark, sf, docs):
    got = run(spark, sf, "op9_raked_sample")
    share = sum(r.n_tokens for r in got) / sum(len((t or "").split()) for _, t in docs)
    assert 0 < len(got) <= len(docs) and 0.5 < share <= 1
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    kept = mixing.mix(whole)
    assert kept.columns == whole.columns and kept.count() == len(got)


def leaks(rows, items, window=10):
    split = lambda t: textnum_words(t)
    grams = []
    for name, t in items:
        w = split(t)
        k = min(window, len(w))
        grams += [(name, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k]
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for name, g in grams:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(name)
        yield (i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def textnum_words(text):
    out, word = [], bytearray()
    for b in (text or "").encode() + b" ":
        b += 32 * (0x41 <= b <= 0x5A)
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            word.append(b)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out


def test_long_items_of_equal_words_take_linear_time():
    """An item and a text of n equal words: twice as many take about twice as long, and windows count once."""
    import time

    def seconds(n):
        automaton = decontaminate.build([("i", b"a " * n), ("short", b"a a a")])
        begin = time.perf_counter()
        [(_, spans, items)] = decontaminate.match(textnum.Words([b"a " * n], textnum.NOT_ALNUM, lower=True), automaton)
        assert spans == [(0, n)] and items == {"i", "short"} and sum(map(len, automaton.marks.values())) == 2
        return time.perf_counter() - begin

    seconds(1000)
    assert min(seconds(16_000) for _ in range(3)) < 20 * min(seconds(2000) for _ in range(3)) + 0.05


def test_lookup_in_many_blocks(spark, tmp_path, monkeypatch):
    """A URL whose records reach over many blocks and files, and URLs between them."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, "http://hot.org/a b" if i % 3 == 0 else f"http://h{i % 10}.org/{i}\r\n\u2028", f"page {i}") for i in range(400)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    page = lambda h: int(h["WARC-Record-ID"].split(":")[-1].rstrip(">"))
    assert sorted((page(h), p.decode()) for h, p in warc.lookup(spark, archive, "org,hot)/a b")) == [(i, f"page {i}") for i in range(0, 400, 3)]
    for i in (1, 200, 398):
        [(h, p)] = warc.lookup(spark, archive, f"org,h{i % 10})/{i}\r\n\u2028")
        assert (page(h), p, h["WARC-Target-URI"]) == (i, f"page {i}".encode(), f"http://h{i % 10}.org/{i}%0D%0A\u2028")


def test_other_tokenizers_go_through_the_library(spark, tmp_path):
    import glob
    import os

    import public_tokenizers

    folder = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    others = [p for p in sorted(glob.glob(f"{folder}/*.json") + glob.glob(f"{folder}/*.model")) if not tokencount.known_rules(p)]
    assert tokencount.known_rules(public_tokenizers.path("word_bpe_49k.json")) and others
    texts = ["one  two\n", " one two", "It's 42!\t\tx", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, path in enumerate(others[:4]):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            count = lambda t, m=SentencePieceProcessor(model_file=path): len(m.encode(t))
        else:
            from tokenizers import Tokenizer

            try:
                count = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False).ids)
            except Exception:
                continue  # not a tokenizer's file
        got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path, f"file://{tmp_path}/c{n}").collect()}
        assert got == {i: count(t or "") for i, t in enumerate(texts)}, path


def test_benchmark_leaks(spark, sf, docs):
    items = [("" if r.item_id is None else str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text is not None]
    want = sorted(map(repr, leaks(docs, items)))
    assert sorted(map(repr, map(tuple, run(spark, sf, "op10_suffix_automaton")))) == want
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")]
    parts = decontaminate.report(*tables, block_words=40).drop("items", "spans").collect()
    assert sorted(repr(tuple(r)) for r in parts) == want


def test_benchmark_blocks_agree(spark, sf):
    """However many blocks the items make: rows of one id, without id or repeated, items that overlap across blocks."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(words[8 * i : 8 * i + 14])) for i in range(20)]
    texts = [" ".join(words[a : a + n]) + " " + data.prose(r, 60) for a, n in ((0, 30), (3, 9), (50, 40), (50, 40), (64, 90))]
    rows = [(i if i < 2 else 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[2]), (7, None), (2, texts[2]), (2, texts[2])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "'x' AS spans", "1 AS row_key")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(repr, decontaminate.report(documents, benchmark, block_words=n).collect())) for n in (200_000, 60))
    assert one == many and len(one) == len(rows)
    assert sorted(repr(tuple(x[:6])) for x in decontaminate.report(documents, benchmark, block_words=60).collect()) == sorted(map(repr, leaks(rows, [(str(i), t) for i, t in items])))
    one, many = (sorted(map(repr, decontaminate.cut(documents, benchmark, block_words=n).collect())) for n in (200_000, 60))
    assert one == many and 0 < len(one) < len(rows)


def test_cut_leaves_no_window(spark, sf, docs):
    documents, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    cut = decontaminate.cut(documents, benchmark)
    assert cut.columns == documents.columns
    after = cut.collect()
    before = decontaminate.report(documents, benchmark).collect()
    assert len(after) == sum(r.n_hit <= 0.5 * r.n_words for r in before)
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    assert not decontaminate.report(cut, benchmark).filter("contaminated").count()


def test_word_hashes_tell_words_apart():
    texts = [b"a b a", b"", b"  ", ("é" * 3000 + " x").encode(), b"b" * 5000 + b" " + b"b" * 4999]
    w = textnum.Words(texts, textnum.SPACE)
    h = w.hashes()
    assert w.counts.tolist() == [3, 0, 0, 2, 2] and h[0] == h[2] and len(set(h.tolist())) == 6
    assert [w.word(i) for i in range(3)] == [b"a", b"b", b"a"] and quality.BITS == 20


def classes_of(spark, texts):
    rows = list(enumerate(texts))
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return got, {i: c for (i, _), c in near_classes(rows).items()}


def test_short_near_copies_meet(spark):
    """Texts of few words, alone and in crowds: pairs of 8/9, 11/12 and 12/14 words, and lines that a common one is 0.875 similar to."""
    r = random.Random(4)
    texts = []
    for a, b, crowd in ((8, 9, 0), (11, 12, 0), (12, 14, 0), (8, 9, 30), (11, 12, 30), (12, 14, 30)):
        line = data.prose(r, b).split()
        texts += [" ".join(line[:a]), " ".join(line)] + [" ".join(line[:a]) + f" x{i} y{i}" + (" z" * (i % 5)) for i in range(crowd)]
    line = data.prose(r, 11)
    texts += [f"{line} w{i}" for i in range(40)] + [line]
    got, want = classes_of(spark, texts)
    assert got == want


def test_neighbourhoods_meet_exactly():
    """However few words two near-duplicates of up to SHORT words have, and wherever the edits are, they share a bucket."""
    r, close = random.Random(6), 0
    split = lambda t: textnum.Words([" ".join(t).encode()], textnum.SPACE).hashes()
    for _ in range(2000):
        a = [f"w{r.randrange(12)}" for _ in range(r.randrange(order_minhash.SHORT + 1))]
        b = data.edited(r, " ".join(a), r.choice([0, 0.1, 0.2, 0.3])).split()
        if max(len(a), len(b)) <= order_minhash.SHORT and levenshtein(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            close += 1
            assert set(order_minhash.neighbourhood(split(a)).tolist()) & set(order_minhash.neighbourhood(split(b)).tolist())
    assert close > 500


def test_recall_by_edits(spark):
    """Pairs of a text and its copy with scattered edits, against edit distance alone: nine of ten at least, up to the threshold."""
    r, rows = random.Random(12), []
    kinds = [(200, 0.02), (200, 0.05), (200, 0.1), (200, 0.15), (200, 0.19), (16, 0.06), (25, 0.12), (40, 0.15)]
    for n, rate in kinds:
        for _ in range(60):
            text = data.prose(r, n)
            rows += [(len(rows), text), (len(rows) + 1, data.edited(r, text, rate))]
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, kind in enumerate(kinds):
        pairs = range(120 * k, 120 * k + 120, 2)
        want = [i for i in pairs if near(words(rows[i][1]), words(rows[i + 1][1]))]
        assert len(want) >= 20 and sum(got[i + 1] == i for i in want) >= 0.9 * len(want), kind
        assert all(got[i + 1] == i + 1 for i in pairs if i not in want), kind


@pytest.mark.parametrize("block_words", [order_minhash.BLOCK_WORDS, 300])
def test_what_a_leader_leaves_meets_what_it_matches(spark, monkeypatch, block_words):
    """A text that is similar to a member of its large buckets and not to their leader, in few and in many blocks."""
    monkeypatch.setattr(order_minhash, "ALL_PAIRS", 4)
    monkeypatch.setattr(order_minhash, "BLOCK_WORDS", block_words)
    r = random.Random(3)
    base = data.prose(r, 120).split()
    texts = [" ".join([*base[:at], f"x{i}", *base[at + 1 :]]) for i, at in enumerate([*range(100, 120)] * 2)]
    got, want = classes_of(spark, [" ".join(base[:95]), " ".join(base[:118]), " ".join(base), *texts])
    assert got == want and set(want.values()) == {0}


def test_hot_copies_and_rows_without_id(spark):
    """A text that ten thousand rows repeat, near copies of it, and groups of which some or all rows have no id."""
    r = random.Random(8)
    hot, lost, half = (data.prose(r, 60) for _ in range(3))
    rows = [(i, hot) for i in range(10_000)] + [(20_000 + i, data.edited(r, hot, 0.03)) for i in range(40)]
    rows += [(None, lost), (None, lost), (None, lost + " x"), (None, half), (30_000, half + " y"), (None, data.prose(r, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter((x.doc_id is None, x.class_id) for x in order_minhash.near_duplicates(df).collect())
    assert got == {(False, 0): 10_040, (True, None): 4, (True, 30_000): 1, (False, 30_000): 1}
    kept = sorted(map(repr, ((x.doc_id, x.text) for x in order_minhash.deduplicate(df).collect())))
    assert len(kept) == 4 and repr((0, hot)) in kept and repr((30_000, half + " y")) in kept


def test_every_source_meets_its_target(spark):
    """A source ten times too big and one too small, a null one and the named one: weighted tokens meet each one's target."""
    sizes = {"src0": 200, "src1": 1000, "src2": 10, "src3": 100, None: 50}
    rows = [(i, " ".join(["w"] * n), ("en", "de", "fr", "es")[i % 4], s) for s, n in sizes.items() for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = mixing.every_source(df)
    want = targets["source"]
    assert set(want) == {"src0", "src1", "src2", "src3", mixing.REST} and abs(sum(want.values()) - 1) < 1e-9 and want["src0"] == mixing.TARGETS["source"]["src0"]
    tokens = Counter()
    for r in mixing.cells(df, targets).collect():
        tokens[r.cell_source, r.cell_lang, r.cell_topic] += r.n_tokens
    f = mixing.rake(tokens, targets)
    for c, share in want.items():
        assert abs(sum(f[k] * v for k, v in tokens.items() if k[0] == c) / sum(tokens.values()) - share) < 1e-4
    assert {r.cell_source for r in mixing.probabilities(df).collect()} == set(want)


@pytest.mark.parametrize("copies", (2, 5))
def test_identical_rows_stay_as_many(spark, copies):
    """Equal rows whose passage also occurs in an earlier document come out once each, all cut alike."""
    r = random.Random(11)
    passage = data.prose(r, 30)
    rows = [(1, passage + " " + data.prose(r, 10))] + [(2, data.prose(r, 10) + " " + passage)]
    rows += [rows[1]] * (copies - 1)
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 40, 0)] + [(2, 40, 30)] * copies


def test_url_rules_where_most_are_bad(spark):
    """60 % bad labels, which leave no room for a lift of 2, and a rule that needs four tokens."""
    rows = [(i, f"http://x.net/{'ads' if i % 5 < 3 else 'news'}/{i}", i % 5 < 3) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = urlfilter.mine(df)
    assert [r.tokens for r in rules.collect()] == [["path:ads"]]
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, [], rules).collect()} == {i: "block" if bad else "allow" for i, _, bad in rows}
    parts = ["a", "b", "c", "d"]
    rows = [(i, "http://h/" + "/".join(p for j, p in enumerate(parts) if i % 16 >> j & 1), i % 16 == 15) for i in range(160)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    assert [r.tokens for r in urlfilter.mine(df, min_confidence=0.9).collect()] == [[f"path:{p}" for p in parts]]


def test_buckets_grow_in_number_and_size():
    """Up to 4 GB only in number, then in both; never beyond what a task holds."""
    assert [substring.bucket_bits(n) for n in (0, 500 << 20, 4 << 30)] == [8, 8, 11]
    for gb in (8, 30, 1000, 100_000):
        held = (gb << 30) / (1 << substring.bucket_bits(gb << 30))
        assert held <= substring._MOST_BUCKET and substring.bucket_bits(gb << 30) >= substring.bucket_bits(4 << 30)
