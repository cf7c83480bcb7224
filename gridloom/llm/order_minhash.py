"""Near-duplicate detection by Order MinHash, candidates verified by banded alignment.

Two texts are near-duplicates if banded alignment finds that their words differ by an edit distance of at most 1 - ``SIMILARITY`` of the
longer text's words. Nothing else decides; groups are the connected components of such links.

A text's k-mers are its runs of ``K`` words, each labelled with how often it has occurred before in the text. A sketch draws
a random order of all labelled k-mers, takes the ``L`` smallest and keeps them in the order in which the text has them; its
hash is a bucket, and texts that meet in one are candidates. Of texts in which a share e of the words is edited at random places a share
of (1 - e)^5 of the k-mers stays, hence they meet in a sketch with probability J^2 for J = (1 - e)^5 / (2 - (1 - e)^5), and in one of 48
with 1.00 for e up to 0.12, 0.98 at 0.15 and 0.85 at the threshold of 0.2; groups are found by any chain of such pairs.

Texts of few words need no luck: up to ``SHORT`` words all word sequences that a near-duplicate may share are buckets (deletion
neighbourhoods), so that such a pair always meets. Texts of up to ``BRIEF`` words, of whose k-mers few edits may leave none, also get
sketches of single words, labelled and ordered alike, ``DEEP_L`` to a sketch.

Buckets are compared in two steps. First each member with the bucket's leader, the member whose buckets hold the most others; what
that connects needs no further comparison. Then, in buckets that still hold several components, every pair across components: buckets
of up to ``ALL_PAIRS`` texts in full; the texts of larger ones get ``DEEP_SKETCHES`` sharper sketches of ``DEEP_L`` labelled words, by which two
texts at the threshold still meet with probability 0.99. A bucket that is large even so is compared with a leader again. What the leader
doesn't match is compared with what it does match, unless their distances to it rule that out (bag distance, a lower bound of the
edit distance, is a metric), and forms the bucket's next round among itself, in which buckets up to sixteen times as large are compared
in full. What a leader leaves meets what it matches in blocks of some ``BLOCK`` texts or ``BLOCK_WORDS`` words, each text until it has found one. So every pair of
a bucket is compared, ruled out, or connected already. Nothing is capped.

Equal texts are one node throughout. Null texts count as empty, and empty texts equal each other. White space doesn't tell texts apart.
Rows without doc_id take the class of their group's smallest id; a group without any id has a null class, and one of its rows stays.
Repeated rows all get their class, and one of them stays. An empty table gives an empty result. Columns of any name may come along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum
from gridloom.llm.common import checked_join, delete_quietly, materialise, packed_texts, slices, small_arrow_batches, text_bytes
from gridloom.llm.components import components

K, L, SKETCHES = 5, 2, 48
#: Words in a sketch of single words, and how many of those crowded texts get.
DEEP_L, DEEP_SKETCHES = 8, 128
ALL_PAIRS = 16
#: Groups of scan tasks among which copies of a text are put together first.
PARTS = 64
#: Texts in a block, some, when what leaders leave meets what they match, and words, so that long texts come in smaller blocks.
BLOCK, BLOCK_WORDS = 64, 1 << 17
SIMILARITY = 0.8
#: Bag distance to a leader, as a share of the longer text, beyond which a text isn't similar to what the leader matches: 0.2 of a text
#: 1.25 times as long as the leader, and 0.2 of one 1.25 times as long as that.
FAR = (1 - SIMILARITY) * (1 / SIMILARITY + 1 / SIMILARITY**2)
#: Texts of so many words at most meet by what deletions leave; those of ONLY_SHORT at most have no near-duplicate beyond SHORT, hence no sketch.
SHORT, ONLY_SHORT, BRIEF = 14, 11, 60
_ORDERS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, size=(2, SKETCHES + DEEP_SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MEMBER = "node binary, bucket long, sharp boolean"


def most_edits(words: int) -> int:
    return int((1 - SIMILARITY) * words + 1e-9)


def labelled(h: np.ndarray) -> np.ndarray:
    """h with the number of earlier equal values mixed in."""
    s = np.sort(h)
    repeated = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(repeated):
        return h
    at = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h)
    at = at[np.argsort(h[at], kind="stable")]
    s = h[at]
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    out = h.copy()
    out[at] += nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _sketch_hash(order: np.ndarray, parts: Iterator[np.ndarray], kind: int) -> np.ndarray:
    out = (order.astype(np.uint64) + np.uint64(kind << 20)) * np.uint64(0xD6E8FEB86659FD93)
    for g in parts:
        out = textnum.mix(out * np.uint64(0x9E3779B97F4A7C15) + g)
    return out


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each) of all texts with more than ONLY_SHORT words; text t has the word hashes h[first[t]:first[t + 1]]."""
    n = np.diff(first)
    long = np.flatnonzero(n > ONLY_SHORT)
    if not len(long):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    sizes = n[long] - K + 1
    begin = np.concatenate(([0], np.cumsum(sizes)))
    text = np.repeat(np.arange(len(long)), sizes)
    at = np.arange(begin[-1]) - begin[text] + first[long][text]
    # A label counts within its text, so a text's number goes into what is counted and out again.
    own = textnum.mix(np.arange(1, len(long) + 1, dtype=np.uint64))[text]
    g = textnum.mix((labelled(textnum.windows(h, K)[at] + own) - own).copy())
    low = np.uint64((1 << max(20, len(g).bit_length())) - 1)
    place, rank = np.arange(len(g), dtype=np.uint64), np.empty(len(g), dtype=np.uint64)
    buckets = np.empty((SKETCHES, len(long)), dtype=np.uint64)
    for i in range(SKETCHES):
        np.bitwise_xor(g, _ORDERS[0][i], out=rank)
        np.multiply(rank, _ORDERS[1][i], out=rank)
        np.bitwise_or(rank, low, out=rank)
        np.subtract(rank, place, out=rank)  # the smallest rank tells its place
        smallest = []
        for _ in range(L):
            found = (low - (np.minimum.reduceat(rank, begin[:-1]) & low)).astype(np.int64)
            rank[found] = np.uint64(2**64 - 1)
            smallest.append(found)
        buckets[i] = _sketch_hash(np.array([i]), (g[x] for x in np.sort(smallest, axis=0)), 0)  # text order
    return buckets.T.ravel(), np.repeat(long, SKETCHES)


def word_sketches(h: np.ndarray, orders: slice) -> np.ndarray:
    """Buckets of one text by DEEP_L of its labelled words each."""
    g = textnum.mix(labelled(h).copy())
    ranks = (g[None, :] ^ _ORDERS[0][orders, None]) * _ORDERS[1][orders, None]
    take = min(DEEP_L, len(g))
    if take < len(g):
        at = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)  # text order
    else:
        at = np.broadcast_to(np.arange(take), (len(ranks), take))
    return _sketch_hash(np.arange(orders.start, orders.stop), (g[at[:, j]] for j in range(take)), DEEP_L)


@cache
def _stay(n: int) -> list[np.ndarray]:
    """For each length that a text of n words may share with a near-duplicate: which words stay."""
    lengths = {m - most_edits(m) for m in range(n, int(n / SIMILARITY + 1e-9) + 1)}
    return [np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(comb(n, k), k) for k in sorted(lengths) if k <= n]


def neighbourhood(h: np.ndarray) -> np.ndarray:
    """Buckets of a text of few words: two such texts with few enough edits share one, as their longest common sequence has one."""
    if len(h) > SHORT:
        return np.empty(0, dtype=np.uint64)
    out = [textnum.mix(_sketch_hash(np.full(len(at), at.shape[1]), (h[x] for x in at.T), 99)) for at in _stay(len(h))]
    return np.unique(np.concatenate(out))


def _first_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bucket, sharp) of each distinct text; a text that this task has seen isn't sketched again."""
    seen: set[bytes] = set()
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        new = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]
        if len(seen) > 500_000:
            seen.clear()
        texts = text_bytes(batch.column("text").take(pa.array(new, pa.int64())))
        for a, b in slices([len(t) for t in texts], 1 << 20):
            words = textnum.Words(texts[a:b], textnum.SPACE)
            h, first = words.hashes(), words.first
            buckets, of = sketches(h, first)
            more: list[tuple[np.ndarray, int, bool]] = []
            for i in np.flatnonzero(words.counts <= BRIEF).tolist():
                x = h[first[i] : first[i + 1]]
                if len(x) <= SHORT:
                    more.append((neighbourhood(x), i, True))
                if len(x) > ONLY_SHORT:
                    more.append((word_sketches(x, slice(0, SKETCHES)), i, False))
            n = [len(x) for x, _, _ in more]
            buckets = np.concatenate([buckets, *(x for x, _, _ in more)])
            of = np.concatenate([of, np.repeat(np.array([i for _, i, _ in more], dtype=np.int64), n)])
            sharp = np.concatenate([np.zeros(len(of) - sum(n), dtype=bool), np.repeat(np.array([x for _, _, x in more], dtype=bool), n)])
            yield pa.record_batch([pa.array([nodes[i] for i in new[a:b]], pa.binary()).take(pa.array(of)), pa.array(buckets.view(np.int64)), pa.array(sharp)], ["node", "bucket", "sharp"])


def _deep_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bucket, part) of crowded texts (node, packed, part)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        nodes, packed, parts = (batch.column(c) for c in ("node", "packed", "part"))
        raw = packed.to_pylist()
        for a, b in slices([zstandard.frame_content_size(x) for x in raw], 1 << 20):
            words = textnum.Words([unpack(x) for x in raw[a:b]], textnum.SPACE)
            h, first = words.hashes(), words.first
            buckets = np.concatenate([word_sketches(h[first[i] : first[i + 1]], slice(SKETCHES, SKETCHES + DEEP_SKETCHES)) for i in range(b - a)])
            of = pa.array(np.repeat(np.arange(a, b), DEEP_SKETCHES))
            yield pa.record_batch([nodes.take(of), pa.array(buckets.view(np.int64)), parts.take(of)], ["node", "bucket", "part"])


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of two hash sequences by bit-parallel alignment in a band; most + 1 if it is larger."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return min(len(a), most + 1)
    k = max(8, 2 * (len(a) - len(b)))
    while True:
        d = _banded(a, b, min(k, most, len(a))) if len(a) - len(b) <= min(k, most) else most + 1
        if d <= min(k, most) or k >= most or k >= len(a):
            return min(d, most + 1)
        k *= 4


def _banded(a: list[int], b: list[int], k: int) -> int:
    """Distance within k of the diagonal, after Hyyro: bit r of column j is row j - k + r of a."""
    m, full = len(a), (1 << (2 * k + 1)) - 1
    rows: dict[int, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << (i + k)
    up, down, low = ((1 << (k + 1)) - 1) << k, 0, 1 << (2 * k)
    d = k
    for j, x in enumerate(b):
        same = (rows.get(x, 0) >> j) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right, left = (down | ~(zero | up)) & full, zero & up
        if j < m - k:
            d += not zero & low
        else:
            at = m - j - 1 + k
            d += (right >> at & 1) - (left >> at & 1)
        up, down = (left | ~(zero >> 1 | right)) & full, zero >> 1 & right
    return d


def compare(a: np.ndarray, b: np.ndarray, a_bag: np.ndarray, b_bag: np.ndarray, align: bool = True) -> tuple[int, bool]:
    """(bag distance, near-duplicates) of two texts, as word hashes and labelled word hashes. Bag distance bounds edit distance from below."""
    bag = max(len(a), len(b)) - len(np.intersect1d(a_bag, b_bag, assume_unique=True))
    most = most_edits(max(len(a), len(b)))
    return bag, align and bag <= most and edit_distance(a, b, most) <= most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        a, b, align = (batch.column(c).to_pylist() for c in ("a_packed", "b_packed", "align"))
        bag, near = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
        n = np.zeros((2, batch.num_rows), dtype=np.int64)
        # By size when unpacked: a text that repeats itself may be a thousand times smaller packed.
        for i, j in slices([zstandard.frame_content_size(x) + zstandard.frame_content_size(y) for x, y in zip(a, b)], 1 << 20):
            at: dict[bytes, int] = {}  # one text often comes in many pairs
            places = [(at.setdefault(x, len(at)), at.setdefault(y, len(at))) for x, y in zip(a[i:j], b[i:j])]
            words = textnum.Words([unpack(x) for x in at], textnum.SPACE)
            h, f = words.hashes(), words.first
            texts = [h[f[t] : f[t + 1]] for t in range(len(at))]
            bags = [labelled(x) for x in texts]
            for r, (x, y) in enumerate(places, i):
                n[:, r] = len(texts[x]), len(texts[y])
                bag[r], near[r] = compare(texts[x], texts[y], bags[x], bags[y], align[r])
        columns = [batch.column("a"), batch.column("b"), pa.array(bag), *map(pa.array, n), pa.array(near)]
        out = pa.record_batch(columns, ["a", "b", "bag", "a_n", "b_n", "near"])
        yield out.filter(pa.array(near | (bag <= FAR * n.max(axis=0) + 1e-9)))


def _within_reach(u: dict, m: dict) -> bool:
    """Whether bag distances to their leader leave room for few enough edits between two texts of different parts."""
    few = most_edits(max(u["words"], m["words"]))
    return u["part"] != m["part"] and abs(u["bag"] - m["bag"]) <= few and abs(u["words"] - m["words"]) <= few


def _shared_words(us: list[np.ndarray], ms: list[np.ndarray], wide: int = 1 << 16) -> np.ndarray:
    """How many labelled words each text of us shares with each of ms, by products of slices of their incidence matrices."""
    words, at = np.unique(np.concatenate([*us, *ms]), return_inverse=True)
    of = np.repeat(np.arange(len(us) + len(ms)), [len(x) for x in (*us, *ms)])
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((len(us), len(ms)), dtype=np.float32)
    for a in range(0, len(words), wide):
        i, j = np.searchsorted(at, [a, a + wide])
        held = np.zeros((len(us) + len(ms), min(wide, len(words) - a)), dtype=np.float32)
        held[of[i:j], at[i:j] - a] = 1
        out += held[: len(us)] @ held[len(us) :].T
    return out


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text; a slice of bounded size is unpacked at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    for i, j in slices([zstandard.frame_content_size(x) for x in packed], 1 << 20):
        words = textnum.Words([unpack(x) for x in packed[i:j]], textnum.SPACE)
        h, f = words.hashes(), words.first
        out += [h[f[t] : f[t + 1]] for t in range(j - i)]
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, part): for each text of us the first of ms that it is near to, if any; ms are connected, so one is enough."""
    for batch in batches:
        found = []
        for r in range(batch.num_rows):
            us, ms = batch.column("us")[r].as_py(), batch.column("ms")[r].as_py()
            ms = [m for m in sorted(ms, key=lambda m: m["bag"]) if any(_within_reach(u, m) for u in us)]
            if not ms:
                continue
            texts = _unpacked([x["packed"] for x in (*us, *ms)])
            bags = [labelled(x) for x in texts]
            longer = np.maximum.outer([len(x) for x in texts[: len(us)]], [len(x) for x in texts[len(us) :]])
            apart = longer - _shared_words(bags[: len(us)], bags[len(us) :])
            for i, u in enumerate(us):
                for j in np.flatnonzero(apart[i] <= (1 - SIMILARITY) * longer[i] + 1e-9).tolist():
                    most = most_edits(int(longer[i, j]))
                    if _within_reach(u, ms[j]) and edit_distance(texts[i], texts[len(us) + j], most) <= most:
                        found.append((u["node"], ms[j]["node"], u["leader_part"]))
                        break
        yield pa.record_batch([pa.array(x, pa.binary()) for x in (zip(*found) if found else [[]] * 3)], ["a", "b", "part"])


def _left_and_matched(by_leader: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, part) links between what leaders left and what they matched, in blocks of both; part is the leader's."""
    sizes = by_leader.groupBy("leader", "within").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("words") / BLOCK_WORDS)).alias("blocks"))
    blocks = by_leader.join(sizes, ["leader", "within"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = F.collect_list(F.struct("node", "packed", "words", "part", "bag", "leader_part"))
    blocks, _ = materialise(blocks.join(held, "node").groupBy("leader", "within", "block").agg(rows.alias("texts")), "blocks")
    us, ms = blocks.filter("not within").select("leader", F.col("block").alias("i"), F.col("texts").alias("us")), blocks.filter("within").select("leader", F.col("block").alias("j"), F.col("texts").alias("ms"))
    # Dealt by pair of blocks, in a fixed number: they are few bytes and much work, and one leader may have most of them.
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return us.join(ms, "leader").repartition(tasks, "leader", "i", "j").select("us", "ms").mapInArrow(_block_links, "a binary, b binary, part binary")


def _judged(pairs: DataFrame, held: DataFrame) -> tuple[DataFrame, str]:
    """(a, b, bag, a_n, b_n, near) of pairs (a, b, align) not too far apart; held has (node, packed). Pairs not to be aligned get no near."""
    a, b = held.toDF("a", "a_packed"), held.toDF("b", "b_packed")
    return materialise(pairs.join(a, "a").join(b, "b").mapInArrow(_verify, "a binary, b binary, bag long, a_n long, b_n long, near boolean"), "judged")


def _shared(rows: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Rows (bucket, node, part, ...) of buckets that several components (part) share, repeated ones once, with the bucket's weight: its rows before."""
    buckets, buckets_path = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("weight"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("bucket", "weight"), "buckets")
    out = materialise(rows.drop("weight").join(buckets, "bucket").distinct(), "members")
    for old in (path, buckets_path):
        delete_quietly(rows.sparkSession, old)
    return out


def _met(members: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Members of buckets that several parts share, with the bucket's size n and its leader: the member that is in buckets with the most others, the nearest to what all derive from."""
    degree, degree_path = materialise(members.groupBy("node").agg(F.sum("weight").alias("degree")), "degree")
    ranked = members.join(degree, "node").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.struct("degree", "node", "part")).alias("top"))
    ranked, ranked_path = materialise(ranked.filter("low != high").select("bucket", "n", F.col("top.node").alias("leader"), F.col("top.part").alias("leader_part")), "leaders")
    out = materialise(members.join(ranked, "bucket"), "met")
    for old in (path, degree_path, ranked_path):
        delete_quietly(members.sparkSession, old)
    return out


def _across(met: DataFrame, most: int) -> DataFrame:
    """Every pair across components of each bucket of so many members at most."""
    small = met.filter(F.col("n") <= most)
    a, b = (small.select("bucket", F.col("node").alias(x), F.col("part").alias(f"{x}_part")) for x in "ab")
    return a.join(b, "bucket").filter("a < b and a_part != b_part").select("a", "b").distinct().withColumn("align", F.lit(True))


def _regrouped(parts: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """(node, part) after more links (a, b): components of the graph whose nodes are the parts so far."""
    of = [parts.toDF(x, f"{x}_part") for x in "ab"]
    between = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    between, path = materialise(between.filter("a != b").distinct(), "between")
    joined = components(between).toDF("part", "root")
    moved = parts.join(joined, "part", "left").select("node", F.coalesce("root", "part").alias("part"))
    new = joined.toDF("node", "part").join(parts, "node", "left_anti").select("node", "part")
    out = materialise(moved.unionByName(new), "groups")
    delete_quietly(links.sparkSession, path)
    return out


def near_groups(texts: DataFrame) -> tuple[DataFrame, str]:
    """(node, part) of each node of texts (node, text) that has a near-duplicate, as a table and its path: the group's smallest node."""
    spark = texts.sparkSession
    rows, path = materialise(texts.mapInArrow(_first_members, _MEMBER), "sketches")
    met, met_path = _met(*_shared(rows.withColumn("part", F.col("node")), path))
    met = met.drop("part")
    wanted, wanted_path = materialise(met.select("node").distinct(), "nodes")
    # A text comes once from each scan task that met it: put together in two steps, so that no task gets all of these.
    packed = packed_texts(checked_join(texts, wanted, wanted_path, "node", "left_semi"), "node").withColumn("step", F.spark_partition_id() % PARTS)
    held, held_path = materialise(packed.groupBy("node", "step").agg(F.first("packed").alias("packed")).groupBy("node").agg(F.first("packed").alias("packed")), "texts")
    led = met.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    judged, _ = _judged(led.withColumn("align", F.lit(True)), held)
    part, part_path = materialise(components(judged.filter("near").select("a", "b")).toDF("node", "part"), "parts")
    met, parted_path = materialise(met.join(part, "node", "left").select("bucket", "node", "sharp", "n", F.coalesce("part", "node").alias("part")), "parted")
    met, mixed_path = _shared(met, parted_path)
    crowded, crowded_path = materialise(met.filter((F.col("n") > ALL_PAIRS) & ~F.col("sharp")).select("node", "part").distinct(), "crowded")
    deep = checked_join(held, crowded, crowded_path, "node").select("node", "packed", "part").mapInArrow(_deep_members, "node binary, bucket long, part binary")
    rows, path = materialise(met.filter((F.col("n") <= ALL_PAIRS) | F.col("sharp")).select("node", "bucket", "part").unionByName(deep), "members")
    members, path = _shared(rows, path)
    for old in (met_path, wanted_path, mixed_path, crowded_path):
        delete_quietly(spark, old)
    more: list[DataFrame] = []
    most = ALL_PAIRS
    while True:
        met, met_path = _met(members, path)
        if met.isEmpty():
            break
        led = met.filter((F.col("n") > most) & (F.col("node") != F.col("leader"))).select("bucket", "node", "weight", "part", "leader", "leader_part", (F.col("part") != F.col("leader_part")).alias("align"))
        pairs = _across(met, most).unionByName(led.select(F.col("leader").alias("a"), F.col("node").alias("b"), "align")).distinct()
        pairs, pairs_path = materialise(pairs, "pairs")
        judged, _ = _judged(pairs, held)
        more.append(judged.filter("near").select("a", "b"))
        by_leader = led.select(F.col("leader").alias("a"), F.col("node").alias("b"), "part", "leader_part", "align").distinct().join(judged, ["a", "b"])
        by_leader, led_path = materialise(by_leader.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("b_n").alias("words"), "part", "leader_part", "bag", "near", (F.col("near") | ~F.col("align")).alias("within")), "led")
        # What a leader doesn't match may match what it does, if their distances to the leader differ by few enough edits.
        across, _ = materialise(_left_and_matched(by_leader, held), "across")
        more.append(across.select("a", "b"))
        # And it goes on among itself; what has been connected with a leader takes its part.
        left = led.filter("align").join(by_leader.filter("near").select("leader", "node"), ["leader", "node"], "left_anti")
        now = by_leader.filter("near").select("node", "leader_part").unionByName(across.select(F.col("a").alias("node"), F.col("part").alias("leader_part"))).groupBy("node").agg(F.min("leader_part").alias("now"))
        members, path = materialise(left.join(now, "node", "left").select("node", "bucket", "weight", F.coalesce("now", "part").alias("part")), "members")
        for old in (met_path, pairs_path, led_path):
            delete_quietly(spark, old)
        most *= 16
    for old in (met_path, held_path):
        delete_quietly(spark, old)
    return _regrouped(part, reduce(DataFrame.unionByName, more)) if more else (part, part_path)


def with_node(documents: DataFrame) -> DataFrame:
    return documents.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def classes(documents: DataFrame) -> tuple[DataFrame, str]:
    """(node, class_id, keeper) of each text that is not alone in its group, as a table and its path.

    class_id is the group's smallest doc_id, null if it has none; keeper is the text that stays: the smallest with that id.
    """
    small_arrow_batches(documents.sparkSession)
    named = with_node(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    roots = near_groups(named.select("node", "text"))[0].withColumnRenamed("part", "root")
    per_text = named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined, joined_path = materialise(per_text.join(roots, "node", "left").filter("root is not null or n > 1").select("node", F.coalesce("root", "node").alias("root"), "least"), "grouped")
    firsts, firsts_path = materialise(joined.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "node")).alias("first")).select("root", "first.least", "first.node").toDF("root", "class_id", "keeper"), "firsts")
    out = materialise(joined.join(firsts, "root").select("node", "class_id", "keeper"), "classes")
    for path in (joined_path, firsts_path):
        delete_quietly(documents.sparkSession, path)
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row; documents alone in their group are their own class."""
    table, _ = classes(documents)  # joined by a shuffle: memberships stay off the driver
    return with_node(documents.select("doc_id", "text")).select("doc_id", "node").join(table, "node", "left").select("doc_id", F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each group, with all their columns; of repeated rows one stays."""
    table, path = classes(documents)
    columns = documents.columns
    inner = with_node(documents.select(F.struct(*columns).alias("row"), "doc_id", "text")).select("row", "doc_id", "node")
    keeps = F.col("keeper").isNull() | ((F.col("keeper") == F.col("node")) & F.col("class_id").eqNullSafe(F.col("doc_id")))
    kept = checked_join(inner, table, path, "node", "left").filter(keeps)
    # One text may come several times under the kept doc_id.
    twice = documents.groupBy("doc_id").count().filter("count > 1").limit(1)
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "node"])
    return kept.select("row.*")
