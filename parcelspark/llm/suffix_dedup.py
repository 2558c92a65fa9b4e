"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted by their first words, compared with their neighbours and extended both ways.

Comparing whole neighbours alone loses repeats: the neighbour with the longest match to the right need not be the one with 50 words in all. So a suffix is extended
to the left and right into the windows that it stands for, the sorted neighbours are the equal windows of a gram, and adjacent windows join into spans.

A ``GRAM``-word gram is an anchor if its hash is the least (leftmost on ties) of the grams in some window of ``MIN_WORDS`` words. Which gram that is depends
on the window's words alone, so every window has one anchor, and equal windows have equal anchors at the same place. Then:

1. Grams that occur at one place only are dropped by counting (map-side combined) and a join that adaptive execution may split.
2. Each place of a gram left brings the hashes of the windows that it is the anchor of: one hash for each word of a document at most. Places meet by gram, and
   equal windows among them are found by sorting hashes. The windows of grams with more than ``HOT`` places, such as a passage that a third of all documents
   share, are spread over all tasks instead and meet by their own hash, by counting and a join as in 1.
3. For every window that occurs twice or more the first document with that very window is its keeper.
4. Overlapping windows of a document with one keeper are joined into spans.

All repeated windows are found, whatever other documents share their gram. Spans with different keepers may overlap. ``drop_repeats`` cuts the words that lie
in repeated windows but in none that the document itself is the keeper of, so every repeated window stays whole in its keeper.

Defined results: positions count words ``\\w+`` of the lower-cased text; null and short texts have none. A repeat within one document counts as well; a document keeps all
places of the windows that it is the keeper of. Rows with the same id and text are one document. ``first_doc_id`` is the least id of the documents with the span's windows; a null id
loses to others, and among rows with equal ids one is the keeper. Windows are compared by 64-bit hash, of which 48 bits and the 64 of the gram are used if the gram is not hot.
An empty table gives an empty result; further columns are ignored by ``repeats`` and kept by ``drop_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, row_key, written

WORD = re.compile(r"\w+")
MIN_WORDS, GRAM = 50, 20
#: Places of a gram that one task brings together: about a million window hashes, some 100 MB while they are sorted. Any value gives the same spans.
HOT = 1 << 16
MEMO = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MATCH = "hot boolean, hash long, row long, none boolean, id long, a int, b int, kept boolean"


class Words:
    """64-bit hashes of a text's words, remembered up to a bound."""

    def __init__(self):
        self.known = {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        if len(known) > MEMO:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser positions of a document, the hashes of their grams, and of how many windows each is the anchor; these windows follow one another from the first word on."""
    if len(h) < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    g = np.zeros(len(h) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        g = g * _P + h[j: j + len(g)]
    g = _mixed(g)
    span = MIN_WORDS - GRAM + 1
    picked = []
    for start in range(0, len(g) - span + 1, 1 << 15):  # in stretches, so that a very long text needs little memory
        part = np.lib.stride_tricks.sliding_window_view(g[start: start + (1 << 15) + span - 1], span)
        picked.append(np.arange(len(part)) + part.argmin(axis=1) + start)
    at, n = np.unique(np.concatenate(picked), return_counts=True)
    return at, g[at], n


def windows(h: np.ndarray) -> np.ndarray:
    """Hashes of all windows of a document, from differences of running sums."""
    power = lambda base, n: np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), (h * power(_INVERSE, len(h) - 1)).cumsum(dtype=np.uint64)])
    return _mixed((sums[MIN_WORDS:] - sums[:-MIN_WORDS]) * power(_P, len(h) - MIN_WORDS))


def _anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = Words()
    for batch in batches:
        rows, found = [], []
        for row, text in zip(batch["row"], batch["text"]):
            at, g, n = anchors(words(text))
            if len(at):
                rows.append(row)
                found.append((g.view(np.int64), at, np.cumsum(n) - n, n))
        if rows:
            gram, pos, start, n = (np.concatenate(c) for c in zip(*found))
            yield pd.DataFrame({"gram": gram, "row": np.repeat(np.array(rows, np.int64), [len(f[0]) for f in found]), "start": start.astype(np.int32), "n": n.astype(np.int8)})


def _windowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashes of the windows at each repeated gram: 8 bytes each if the gram is hot, else 6."""
    words = Words()
    for batch in batches:
        out = []
        for row, none, doc, text, found in zip(batch["row"], batch["none"], batch["id"], batch["text"], batch["found"]):
            w = windows(words(text)).astype("<u8")
            short = w.view(np.uint8).reshape(-1, 8)[:, 2:]
            for f in found:
                part = slice(f["start"], f["start"] + f["n"])
                out.append((f["gram"], f["hot"], row, none, doc, f["start"], (w if f["hot"] else short)[part].tobytes()))
        yield pd.DataFrame(out, columns=["gram", "hot", "row", "none", "id", "start", "hashes"])


def _equal(places: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated windows of one keeper, from all places of some grams."""
    row, none, doc, start = (places[c].to_numpy() for c in ("row", "none", "id", "start"))
    order = np.lexsort((row, doc, none))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (none[order][1:] != none[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    holder = order[new]  # a place of each document, in the documents' order
    size = places["hashes"].str.len().to_numpy() // 6
    of = np.repeat(np.arange(len(size)), size)
    h = np.zeros((len(of), 8), np.uint8)
    h[:, 2:] = np.frombuffer(b"".join(places["hashes"]), np.uint8).reshape(-1, 6)
    h = h.view("<u8").ravel() ^ _mixed(places["gram"].to_numpy().view(np.uint64))[of]
    by = np.argsort(h)
    first = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    count = np.diff(np.append(first, len(by)))
    keeper = np.empty(len(by), np.int64)
    keeper[by] = np.repeat(np.where(count > 1, np.minimum.reduceat(rank[of][by], first), -1), count)
    run = np.flatnonzero(np.concatenate([[True], (keeper[1:] != keeper[:-1]) | (of[1:] != of[:-1])]))
    end = np.append(run[1:], len(by))
    end, run = end[keeper[run] >= 0], run[keeper[run] >= 0]
    place, kept = of[run], holder[keeper[run]]
    a = start[place] + run - (np.cumsum(size) - size)[place]
    return pd.DataFrame({"hot": False, "hash": 0, "row": row[place], "none": none[kept], "id": doc[kept], "a": a, "b": a + end - run + MIN_WORDS - 1, "kept": rank[place] == keeper[run]})


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches of the places of a task, which are sorted by gram, with their keepers' ids; windows of hot grams one by one with their own ids."""
    held = []
    for batch in batches:
        hot = batch[batch["hot"]]
        if len(hot):
            size = hot["hashes"].str.len().to_numpy() // 8
            of = np.repeat(np.arange(len(size)), size)
            a = hot["start"].to_numpy()[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]
            own = {c: hot[c].to_numpy()[of] for c in ("row", "none", "id")}
            yield pd.DataFrame({"hot": True, "hash": np.frombuffer(b"".join(hot["hashes"]), np.int64), **own, "a": a, "b": a + MIN_WORDS, "kept": False})
        rest = batch[~batch["hot"]]
        if len(rest):
            same = (rest["gram"] == rest["gram"].iloc[-1]).to_numpy()  # the last gram may go on in the next batch
            if not same.all():
                yield _equal(pd.concat([*held, rest[~same]], ignore_index=True))
                held = []
            elif held and held[-1]["gram"].iloc[-1] != rest["gram"].iloc[0]:
                yield _equal(pd.concat(held, ignore_index=True))
                held = []
            held.append(rest[same])
    if held:
        yield _equal(pd.concat(held, ignore_index=True))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per repeated span and keeper: ``id, key, start, end`` (words, end exclusive), ``first_doc_id``, ``kept`` (this document is the keeper)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(row_key(id_col, text_col)).alias("row"), row_key(id_col, text_col).alias("key"), text.alias("text"))
    found = written(docs.select("row", "text").mapInPandas(_anchored, "gram long, row long, start int, n byte"), "suffix-anchors")
    place = F.xxhash64("row", "start")
    counted = found.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high"), (F.count("*") > hot).alias("hot")).where("low <> high")
    wanted = found.join(counted.select("gram", "hot"), "gram").select("row", F.struct("gram", "hot", "start", "n").alias("f")).distinct() \
        .groupBy("row").agg(F.collect_list("f").alias("found"))  # at most one entry for each word of a document
    places = docs.select("row", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "text").dropDuplicates(["row"]).join(wanted, "row") \
        .mapInPandas(_windowed, "gram long, hot boolean, row long, none boolean, id long, start int, hashes binary")
    spread = F.when(F.col("hot"), F.xxhash64("row", "start")).otherwise(F.col("gram"))
    met = places.withColumn("gram", spread).repartition("gram").sortWithinPartitions("gram")
    matched = written(met.mapInPandas(_met, MATCH), "suffix-matches")
    common = matched.where("hot").groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("none", "id", "row")).alias("first")).where("n > 1")
    common = written(common.select("hash", F.when(~F.col("first.none"), F.col("first.id")).alias("first_id"), F.col("first.row").alias("first_row")), "suffix-common")
    matches = matched.where("hot").select("hash", "row", "a", "b").join(common, "hash").select("row", "a", "b", "first_id", (F.col("row") == F.col("first_row")).alias("kept")) \
        .union(matched.where("not hot").select("row", "a", "b", F.when(~F.col("none"), F.col("id")).alias("first_id"), "kept"))
    w = W.partitionBy("row", "first_id", "kept").orderBy("a")
    start = F.col("a") > F.coalesce(F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    spans = matches.withColumn("nth", F.sum(start.cast("int")).over(w)).groupBy("row", "first_id", "kept", "nth").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    return spans.join(docs.select("row", "id", "key").dropDuplicates(["row"]), "row").select("id", "key", "start", "end", F.col("first_id").alias("first_doc_id"), "kept")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch["text"], batch.pop("spans")):
            at = [m.span() for m in WORD.finditer(text)]
            gone = np.zeros(max(len(at), *(s["end"] for s in spans)) + 2, bool)
            for s in sorted(spans, key=lambda s: s["kept"]):  # kept ones last
                gone[s["start"] + 1: s["end"] + 1] = not s["kept"]
            out, done = [], 0
            for a, b in np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist():
                out.append(text[done: at[a][0]])
                done = at[b - 1][1]
            texts.append("".join([*out, text[done:]]))
        yield batch.assign(text=texts)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated windows, but for each window's keeper, which has it whole; all columns stay."""
    spans = repeats(docs, id_col, text_col).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kept")).alias("spans"), F.bool_and("kept").alias("whole")).where("not whole").drop("whole")
    own, cut = free_names(docs, "key", "cut")
    keyed = docs.withColumn(own, row_key(id_col, text_col))
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row_key(id_col, text_col).alias("key")).dropDuplicates(["key"])
    new = text.join(spans, "key").mapInPandas(_cut, "text string, key binary").select(F.col("key").alias(own), F.col("text").alias(cut))
    return keyed.join(new, own, "left").withColumn(text_col, F.coalesce(cut, F.col(text_col))).select(*docs.columns)
