"""MinHash near-deduplication with BagMinHash signatures of word-shingle multisets.

A text is the multiset of its shingles (``SHINGLE`` lower-cased words; fewer words are one shingle). BagMinHash: the weight axis
of a shingle is cut into dyadic intervals [0,1), [1,2), [2,4), ..., each with a Poisson process of its own whose rate is the
interval's length and whose points (time, weight, component) depend on the shingle and interval alone. A point counts if it lies
below the shingle's weight; component k of the signature is the least time of its points. Two texts agree in a component with a
probability equal to their weighted Jaccard similarity. Points are drawn in order of time, and a process stops once it is past the
largest component so far, so long texts need about one point for each shingle.

``classes`` bands the signatures; ``BANDS`` bands of ``ROWS`` components find a pair of similarity 0.8 with probability
0.99996. Copies of a text are one node throughout. Each bucket's members are held against its hub, the member with most
neighbours (a star, not all pairs), by exact multiset similarity. Of two other members x and y that are similar one may be
dissimilar to the hub; such pairs are found by what they share of their differences from it:

- Write |x - y| for the copies of shingles in which x and y differ, d(x) for |x - hub|, and s for (1 - t) / (1 + t). x and y are
  similar if |x - y| <= s (|x| + |y|), and |x - y| = d(x) + d(y) - 2 (changes that both make). So with u(x) = d(x) - s |x| they are
  similar just if they share (u(x) + u(y)) / 2 changes or more, which is above 0 if x is dissimilar to the hub.
- The changes of each text are ordered by how many texts of the group make them, the rarest first. If the first shared change is the i-th
  of x and the j-th of y, no more than min(d(x) - i, d(y) - j) + 1 are shared. So only a prefix of the changes is probed, and what a
  hub's own peculiarities add to everybody's changes comes last and lengthens no prefix.
- Prefixes depend on the partner's u, so texts are dealt into classes by u and each probes the prefix that each class needs. A
  change that no possible partner in that class makes (no text, or no dissimilar one for a text that is similar to the hub) is shared with none of them: it comes first in the order and is not probed.
- Where many texts meet at a change they are first held against one of them; after that only texts that are not yet connected meet.

Meetings are verified by exact similarity. No pair of candidates whose classes would differ without it is lost. Links make connected classes.

Defined results: null and empty texts have no words; all such texts with equal characters are one class and none other joins it. Of a class the least id
stays; null ids lose to others, and between rows with equal or no ids the text's digest decides. Repeated rows (same id and text) are in one class and bear the
same flag, and ``drop_near_duplicates`` keeps one of them. An empty table gives an empty result. Ids may be of any type that casts to text and back.
Further columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, digest, free_names, written

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
#: Classes of u in a hub's size; texts that meet at a change before they are held against one of them. Any values give the same classes.
STEPS, CROWD = 16, 64
BANDS, ROWS = 26, 5
#: Distinct words a task remembers, and the documents and shingles it signs together, at most.
MEMO, DOCS, SHINGLES = 300_000, 2_000, 1_000_000
_A, _B, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes and their multiplicities."""
        words, known = WORD.findall(text.lower()), self.known
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(known) > MEMO:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(h))
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            s = s * _P + h[j: j + len(s)]
        return np.unique(mixed(s), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` times for each bag; infinite for an empty one."""
    least = np.full((len(bags), size), np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    if not len(doc):
        return least
    shingle, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    parts, low, level = [], 0, 0
    while True:  # the dyadic intervals that hold some of the weight
        inside = weight > low
        if not inside.any():
            break
        length = max(low, 1)
        parts.append((doc[inside], mixed(shingle[inside] + np.uint64(level * int(_P) % (1 << 64))), weight[inside].astype(float), np.full(inside.sum(), float(length)), np.full(inside.sum(), float(low))))
        low, level = low + length, level + 1
    doc, state, weight, rate, low = map(np.concatenate, zip(*parts))
    time, flat, limit = np.zeros(len(doc)), least.reshape(-1), np.full(len(bags), np.inf)
    while len(doc):
        state = state + _P
        draw = mixed(state)
        time = time - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / rate
        on = time < limit[doc]
        doc, state, weight, rate, low, time = (x[on] for x in (doc, state, weight, rate, low, time))
        place = mixed(draw[on] ^ _B)
        at = low + (place & np.uint64(0xFFFFFFFF)) * 2.0**-32 * rate
        counts = at < weight
        component = ((place >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, (doc * size + component)[counts], time[counts])
        some = np.unique(doc)
        limit[some] = least[some].max(axis=1)
    return least


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS hashes for each signature."""
    rows = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _P, (len(signature), 1))
    for j in range(ROWS):
        out = mixed(out * _P + rows[:, :, j])
    return out.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for batch in batches:
        texts = batch.pop("text").tolist()
        start = 0
        while start < len(texts):
            bags, held, end = [], 0, start
            while end < len(texts) and len(bags) < DOCS and held < SHINGLES:
                bags.append(shingler(texts[end]))
                held += len(bags[-1][0])
                end += 1
            found = bands(signatures(bags))
            yield batch.iloc[start:end].assign(bands=[list(b) if len(x[0]) else [] for b, x in zip(found, bags)])
            start = end


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for batch in batches:
        found = [shingler(t) for t in batch.pop("text")]
        yield batch.assign(shingles=[s.tobytes() for s, _ in found], counts=[b"" if (c == 1).all() else c.astype("<u4").tobytes() for _, c in found])


def _bag(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(shingles, np.uint64)
    return a, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(a), np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both, total = int(np.minimum(a[1][i], b[1][j]).sum()), int(a[1].sum() + b[1].sum())
    return both / (total - both) if total else 1.0


def difference(hub: tuple[np.ndarray, np.ndarray], bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The multiset ``bag`` as a difference from ``hub``: one hash for each copy of a shingle that is added, then for each that is taken away.
    Two bags share a hash for each copy that both add, or both take away."""
    every = np.union1d(hub[0], bag[0])
    change = np.zeros(len(every), np.int64)
    change[np.searchsorted(every, bag[0])] += bag[1]
    change[np.searchsorted(every, hub[0])] -= hub[1]
    out = []
    for sign in (1, -1):
        on = sign * change > 0
        shingle, n = np.repeat(every[on], sign * change[on]), sign * change[on]
        copy = np.arange(len(shingle)) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.sort(mixed(shingle ^ mixed(copy.astype(np.uint64) * np.uint64(2) + np.uint64(sign > 0)))))
    return np.concatenate(out)


STAR = "a binary, b binary, crowd boolean, sim double, own long, size long, change array<bigint>"


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a hub and a text: exact similarity, both sizes, and the text's changes to the hub if others share a bucket with it."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            hub, bag = _bag(r.a_shingles, r.a_counts), _bag(r.b_shingles, r.b_counts)
            change = difference(hub, bag) if r.crowd else np.empty(0, np.uint64)
            out.append((r.a, r.b, r.crowd, similarity(hub, bag), int(hub[1].sum()), int(bag[1].sum()), change.view(np.int64)))
        yield pd.DataFrame(out, columns=["a", "b", "crowd", "sim", "own", "size", "change"])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sim = [similarity(_bag(r.a_shingles, r.a_counts), _bag(r.b_shingles, r.b_counts)) for r in batch.itertuples(index=False)]
        yield batch[["a", "b"]].assign(sim=sim)


def _with_bags(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of text keys with both multisets. ``reps`` has for each key the id of one document."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(reps, "key").select("key", F.col("rep").alias("__rep"))
    rows = docs.join(wanted, "key").where(F.col("id").eqNullSafe(F.col("__rep"))).select("key", "text")
    bags = written(rows.mapInPandas(_bags, "key binary, shingles binary, counts binary").dropDuplicates(["key"]), "near-bags")
    side = lambda s: bags.select(*[F.col(c).alias(f"{s}_{c}") for c in ("shingles", "counts")], F.col("key").alias(s))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _slack(threshold: float) -> float:
    """Similar texts differ in at most this share of the sum of their sizes. Candidates are verified, so a tolerance costs nothing."""
    return (1 - threshold) / (1 + threshold) + 1e-9


def _probes(stars: DataFrame, threshold: float) -> DataFrame:
    """``a, h, mine, other`` (classes of u), ``key, wide, size, d, u, at``: the changes that each text of a group probes for partners of each class.

    Only groups with a text that is not similar to the hub take part. A prefix ends where the changes left are fewer than a pair must share.
    """
    slack = _slack(threshold)
    odd = stars.where("crowd").groupBy("a").agg(F.min("sim").alias("low")).where(F.col("low") < threshold).select("a")
    d = F.size("change")
    inside = stars.where("crowd").join(odd, "a").select("a", F.col("b").alias("key"), (F.col("sim") < threshold).alias("wide"), "own", "size", d.alias("d"), (d - slack * F.col("size")).alias("u"), "change")
    inside = inside.withColumn("step", F.greatest(F.col("own") / F.lit(float(STEPS)), F.lit(1.0))).withColumn("mine", F.floor(F.col("u") / F.col("step")).cast("int"))
    inside = written(inside, "near-inside")
    # which classes make a change, as bits: with any text, with two or more, with a wide one
    bit = lambda c: F.pmod(F.col(c), F.lit(64))
    made = inside.select("a", bit("mine").alias("bit"), "wide", F.explode("change").alias("h")).groupBy("a", "h", "bit").agg(F.count("*").alias("n"), F.count_if("wide").alias("n_wide"))
    bits = lambda on: F.bit_or(F.when(on, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint")))
    made = made.groupBy("a", "h").agg(F.sum("n").alias("n"), F.sum("n_wide").alias("n_wide"), bits(F.col("n") > 0).alias("any"), bits(F.col("n") > 1).alias("twice"), bits(F.col("n_wide") > 0).alias("far"))
    made = made.where("n > 1 and n_wide > 0").drop("n_wide")
    shared = inside.select("a", "key", F.explode("change").alias("h")).join(made, ["a", "h"]).groupBy("a", "key") \
        .agg(F.array_sort(F.collect_list(F.struct("n", "h", "any", "twice", "far"))).alias("order"))  # at most one entry for each change of a text
    rows = inside.drop("change").join(shared, ["a", "key"])
    classes = rows.groupBy("a", "mine").agg(F.max("wide").alias("any_wide")).select("a", F.col("mine").alias("other"), "any_wide")
    rows = rows.join(classes, "a").where("wide or any_wide")
    # a pair has one wide text at least, so it shares more than (u - slack * own) / 2 changes, or (u + slack * own) / 2 with a wide partner
    least = F.greatest(F.lit(1.0), (F.col("u") + F.greatest(F.col("other") * F.col("step"), F.when(F.col("wide"), -slack * F.col("own")).otherwise(slack * F.col("own")))) / 2)
    mask = lambda e: F.when(~F.col("wide"), e["far"]).when(bit("mine") == bit("other"), e["twice"]).otherwise(e["any"])
    rows = rows.withColumn("order", F.transform(F.filter("order", lambda e: F.getbit(mask(e), bit("other")) == 1), lambda e: e["h"]))
    unique = F.col("d") - F.size("order")
    last = F.floor(F.col("d") - least + 1 + 1e-6).cast("int") - unique
    rows = rows.where(last > 0).select("a", "mine", "other", "key", "wide", "size", "d", "u", unique.alias("unique"), F.posexplode(F.slice("order", F.lit(1), last)).alias("nth", "h"))
    return rows.select("a", "h", "mine", "other", "key", "wide", "size", "d", "u", (F.col("unique") + F.col("nth") + 1).alias("at"))


def _meeting(x: str, y: str, threshold: float) -> Column:
    """Bounds that a similar pair keeps where it first meets: its sizes, and as many changes left as it has to share."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = F.greatest(F.lit(1.0), (c(x, "u") + c(y, "u")) / 2) - 1e-6
    left = F.least(c(x, "d") - c(x, "at"), c(y, "d") - c(y, "at")) + 1
    return (left >= need) & (F.least(c(x, "size"), c(y, "size")) >= (threshold - 1e-9) * F.greatest(c(x, "size"), c(y, "size")))


def _beside(docs: DataFrame, stars: DataFrame, links: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Links between texts beside a hub, one of which is not similar to it; enough of them to connect what is connected."""
    verified = lambda pairs: _with_bags(docs, pairs, reps).mapInPandas(_verified, "a binary, b binary, sim double").where(F.col("sim") >= threshold).select("a", "b")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    probes = written(_probes(stars, threshold), "near-probes")
    place = ["a", "h", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q")]
    crowds = probes.groupBy(*place).agg(F.count("*").alias("n"), F.min(F.struct("d", "key")).alias("best")).where(F.col("n") > CROWD).drop("n")
    near = probes.select(*place, "key").join(crowds, ["a", "h", "p", "q"]).where(F.col("key") != F.col("best.key"))
    near = written(near.select(*pair(F.col("key"), F.col("best.key"))).distinct(), "near-crowds")
    if not near.isEmpty():
        links = written(links.union(verified(near)), "near-links")
    roots = components(links, "near-roots").withColumnRenamed("id", "key")
    probes = probes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    x, y = probes.where("wide").alias("x"), probes.alias("y")
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.mine") == F.col("y.other")) & (F.col("x.other") == F.col("y.mine"))
    met = x.join(y, same & (F.col("x.root") != F.col("y.root")) & _meeting("x", "y", threshold)).select(*pair(F.col("x.key"), F.col("y.key"))).distinct()
    met = written(met, "near-beside")
    return links if met.isEmpty() else written(links.union(verified(met)), "near-links")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, key`` (digest of its text), ``class_id`` (least id of its class), ``class_size``, ``kept``.

    Jobs run while the plan is made: signatures, buckets, links and classes are written to the shared folder.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), digest(text).alias("key"), text.alias("text"))
    # ids pass through Python as text: a nullable number would come back rounded
    signed = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(_signed, "id string, key binary, bands array<bigint>")
    signed = written(signed.withColumn("id", F.col("id").cast(kind)), "near-signatures")
    texts = signed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    shown = written(signed.join(texts, "key").where(F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["key"]), "near-texts")
    members = shown.select("key", F.explode("bands").alias("bucket"))
    crowds = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(crowds, "bucket"), "near-buckets")
    # the hub of a bucket: the member with most neighbours in all of its buckets
    degree = members.groupBy("key").agg(F.sum("n").alias("degree"))
    members = members.join(degree, "key").withColumn("rank", F.struct(F.negative("degree").alias("none"), "key"))
    hubs = members.groupBy("bucket").agg(F.min("rank").alias("hub")).select("bucket", F.col("hub.key").alias("a"))
    pairs = members.join(hubs, "bucket").where("key <> a").groupBy("a", F.col("key").alias("b")).agg(F.max(F.col("n") > 2).alias("crowd"))
    reps = shown.select("key", "rep")
    stars = written(_with_bags(docs, written(pairs, "near-pairs"), reps).mapInPandas(_stars, STAR), "near-stars")
    links = stars.where(F.col("sim") >= threshold).select("a", "b")
    links = _beside(docs, stars, links, reps, threshold)
    roots = components(links, "near-classes")
    joined = texts.join(roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("first")
    whole = joined.groupBy("root").agg(first, F.sum("n").alias("class_size")).where("class_size > 1")
    named = joined.select("key", "root").join(whole, "root").drop("root")
    alone = F.col("class_size").isNull()
    return signed.select("id", "key").join(named, "key", "left") \
        .select("id", "key", F.when(alone, F.col("id")).otherwise(F.col("first.rep")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                (alone | F.col("id").eqNullSafe(F.col("first.rep")) & (F.col("key") == F.col("first.key"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each class."""
    key, name = free_names(docs, "key", "name")
    as_name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    gone = classes(docs, threshold, id_col, text_col).where("not kept").select(F.col("key").alias(key), as_name(F.col("id")).alias(name)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(key, digest(text)).withColumn(name, as_name(F.col(id_col)))
    return rows.join(gone, [key, name], "left_anti").dropDuplicates([key, name]).select(*docs.columns)
