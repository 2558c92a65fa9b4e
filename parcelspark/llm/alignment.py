"""Two tokenizers' tokens of the same texts aligned by bytes: each distinct text once, pair counts weighted by copies.

Texts are shuffled by their full text and counted; every distinct text is encoded by both tokenizers and its tokens' byte
ranges are laid side by side. A link is a pair of token occurrences whose ranges overlap; ranges of both sides partition the same bytes,
so the links of a text are the intervals between neighbouring ends of either side. A text keeps its distinct id pairs with
their numbers, and a digest of its groups. Pair counts are sums over all texts of links times copies. Measures
that need them come from a join of the texts' pairs with the counts: the most frequent pairs, up to ``BROADCAST_PAIRS``, are broadcast, which
takes the hot keys out; the others are joined by a shuffle. Measures go back to the documents by the text's SHA-256.

Tokens: A is a byte-level vocabulary (a ``tokenizers`` file), B a ``sentencepiece`` model. A is encoded by ``tiktoken`` where the file's merges are
in the order of its ids, as they then are the same thing several times faster, and by ``tokenizers`` otherwise. Neither side's tokens cross a single
space between two other characters (for B, where its pieces show that), so the stretches between are aligned once per task and remembered; see ``Pair``.

Defined results: see ``aligned``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

A_VOCABULARY, B_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies of A's kind split texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs are written as a * SHIFT + b.
SHIFT = 1 << 24
#: So many of the most frequent pairs are broadcast at most (20 bytes each).
BROADCAST_PAIRS = 1_000_000
#: Texts are aligned in runs of about so many characters; a longer text is a run of its own.
RUN = 1 << 18
#: Units, of 16 characters each, that a task remembers before it starts again.
UNITS = 250_000
#: Where a text is cut into units.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
TEXTS = "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bytewise:
    """Tokenizer A: ids of " " + text, and each id's bytes."""

    def __init__(self, file: bytes):
        content = json.loads(file)
        letters, model = byte_letters(), content["model"]
        special = {t["content"] for t in content.get("added_tokens") or () if t.get("special")}
        vocabulary = {piece: i for piece, i in model["vocab"].items() if piece not in special}
        self.pieces = [b""] * (1 + max(model["vocab"].values()))
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        self.file, self.slow, self.fast = file.decode(), None, None
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        before = content.get("pre_tokenizer") or {}
        if made == sorted(made) and not content.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.pieces[i]: i for i in vocabulary.values()}, special_tokens={})

    def ids(self, text: str) -> list[int]:
        text = " " + text
        if self.fast and not LONG_BLANKS.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def same(self, ids: list[int], text: str) -> bool:
        """The tokens' bytes are those of the text with a space before it."""
        return b"".join(map(self.pieces.__getitem__, ids)) == (" " + text).encode()


#: Such runs are more than the regular expressions of ``tiktoken`` go through.
LONG_BLANKS = re.compile(r"\s{10000}")


class Piecewise:
    """Tokenizer B: ids of texts, to each of which it adds a space, and each id's bytes."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.by_word = not any(SPACE in n.lstrip(SPACE) for i, n in enumerate(names) if not self.model.is_byte(i))

    def ids(self, texts: list[str]) -> list[list[int] | None]:
        """None where the tokens' bytes are not those of the text with a space before it."""
        return [ids if b"".join(map(self.pieces.__getitem__, ids)) == (" " + t).encode() else None for ids, t in zip(self.model.encode(texts, num_threads=1), texts)]


class Pair:
    """Both tokenizers, and the units that this task has aligned so far.

    A unit is a stretch of text up to a single space between two other characters. Tokens of neither side cross such a space and do not depend on what is
    beyond it, so a text's tokens, groups and links are those of its units one after the other, and a unit that comes again is looked up.
    """

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = Bytewise(a), Piecewise(b)
        self.size_a, self.size_b = (np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b))
        na, nb = len(self.size_a), len(self.size_b)
        # an id and what follows it: A's within and at the end of a group, B's within, at the end, and at the end of a unit
        self.named = [f"{i}{c}" for n, marks in ((na, ",|"), (nb, (",", ";", ""))) for c in marks for i in range(n)]
        self.base = np.array([0, na, 2 * na, 2 * na + nb, 2 * na + 2 * nb])
        self.split = CUT.split if self.a.fast and self.b.by_word else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.chars, self.groups = 0, []
        self.numbers, self.pairs, self.cut = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        """Align units that are not known; -1 stands for those without tokens."""
        found = [(u, self.a.ids(u), b) for u, b in zip(units, self.b.ids(units)) if b]
        found = [(u, a, b) for u, a, b in found if self.a.same(a, u)]
        self.at.update(dict.fromkeys(units, -1))
        self.chars += sum(map(len, units))
        self.at.update({u: len(self.groups) + i for i, (u, _, _) in enumerate(found)})
        if not found:
            return
        a, b = (np.fromiter(chain.from_iterable(f[k] for f in found), np.int64) for k in (1, 2))
        last_a, last_b = (np.cumsum([len(f[k]) for f in found]) for k in (1, 2))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        mark = np.zeros(end_a[-1] + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        ends = np.flatnonzero(mark)
        kind = mark[ends]
        # a link is an interval between neighbouring ends; each side's token in it has as many ended before it
        at_a, at_b = np.cumsum(kind & 1, dtype=np.int64) - (kind & 1), np.cumsum(kind >> 1, dtype=np.int64) - (kind >> 1)
        both = ends[kind == 3]
        last = end_a[last_a - 1]
        n_links, n_groups = np.diff(np.searchsorted(ends, last, "right"), prepend=0), np.diff(np.searchsorted(both, last, "right"), prepend=0)
        # ids in the order in which the groups name them
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        to_a, to_b = (np.cumsum(np.bincount(g, minlength=len(both))) for g in (group_a, group_b))
        mark_b = np.full(len(b), 2)
        mark_b[to_b - 1] = 3
        mark_b[last_b - 1] = 4
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.where(group_a > 0, to_b[group_a - 1], 0)] = a + self.base[(end_a == both[group_a]).astype(int)]
        order[np.arange(len(b)) + to_a[group_b]] = b + self.base[mark_b]
        named, cuts = list(map(self.named.__getitem__, order.tolist())), [0, *(last_a + last_b).tolist()]
        self.groups += ["".join(named[low:high]) for low, high in zip(cuts, cuts[1:])]
        self.numbers = np.concatenate([self.numbers, np.stack([np.diff(last_a, prepend=0), np.diff(last_b, prepend=0), n_groups, n_links], axis=1)])
        self.cut = np.concatenate([self.cut, self.cut[-1] + np.cumsum(n_links)])
        self.pairs = np.concatenate([self.pairs, a[at_a] * len(self.size_b) + b[at_b]])

    def aligned(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, n_links, digest of the groups, pairs, times) of each text; None where it has no tokens."""
        if len(self.at) > UNITS or self.chars > 16 * UNITS:
            self.forget()
        units = [self.split(t) for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self.at]
        if new:
            self.learn(new)
        where = [[self.at[u] for u in of] for of in units]
        good = [w for w in where if min(w) >= 0]
        if not good:
            return [None] * len(texts)
        flat, starts = np.fromiter(chain.from_iterable(good), np.int64), np.cumsum([0, *(len(w) for w in good)])
        sums = np.add.reduceat(self.numbers[flat], starts[:-1], axis=0).tolist()
        # distinct pairs of each text, with their numbers
        many = self.numbers[flat, 3]
        wide = len(self.size_a) * len(self.size_b)
        place = np.repeat(self.cut[flat] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        keys = np.sort(np.repeat(np.repeat(np.arange(len(good)) * wide, np.diff(starts)), many) + self.pairs[place])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(first, append=len(keys)).astype(np.int32)
        keys = keys[first]
        of = np.searchsorted(keys, np.arange(len(good) + 1) * wide)
        pairs = keys % wide // len(self.size_b) * SHIFT + keys % len(self.size_b)
        each = iter(range(len(good)))
        return [None if min(w) < 0 else (*sums[i := next(each)], hashlib.sha256(";".join(map(self.groups.__getitem__, w)).encode()).hexdigest(), pairs[of[i]: of[i + 1]], times[of[i]: of[i + 1]]) for w in where]


_PAIRS: dict[str, Pair] = {}


def _pair(a: bytes, b: bytes) -> Pair:
    """The tokenizers of this worker."""
    key = hashlib.sha256(a + b).hexdigest()
    if key not in _PAIRS:
        _PAIRS[key] = Pair(a, b)
    return _PAIRS[key]


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, so_far = 0, 0
    for i, n in enumerate(sizes):
        if so_far and so_far + n > RUN:
            yield start, i
            start, so_far = i, 0
        so_far += n
    if sizes:
        yield start, len(sizes)


def distinct_texts(docs: DataFrame, text: str, a_vocabulary: str, b_vocabulary: str) -> DataFrame:
    """One row of ``TEXTS`` for each distinct text that has tokens."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_vocabulary, b_vocabulary)))
    full = F.col(text).cast("string")
    copies = docs.where(full.isNotNull() & (full != "")).select(full.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        for batch in batches:
            for low, high in _runs(pc.utf8_length(batch.column("text")).to_pylist()):
                found = pair.aligned(batch.column("text").slice(low, high - low).to_pylist())
                keep = [i for i, f in enumerate(found) if f is not None]
                rows = [found[i] for i in keep]
                some = batch.slice(low, high - low).take(pa.array(keep, pa.int64()))
                cuts = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, kind), *(r[k] for r in rows)]))) for k, kind in ((5, np.int64), (6, np.int32))]
                yield pa.RecordBatch.from_arrays([some.column("digest"), some.column("copies"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], pa.array([r[4] for r in rows], pa.string()), *lists],
                                                 names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return copies.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "copies").mapInArrow(align, TEXTS)


def links(texts: DataFrame, *keep: str) -> DataFrame:
    """A row ``pair, times`` for each distinct pair of each text."""
    return texts.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(*keep, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each id pair over all documents, and whether no pair with the same B id has more. Tasks sum their own texts first."""
    counts = links(texts, "copies").groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("n")).withColumn("b", F.col("pair") % SHIFT)
    counts = written(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def measures(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``digest, n_best, count_sum``: links of each text whose pair is the best of its B id, and the sum of counts over its links."""
    n, tall = counts.count(), links(texts, "digest")
    if n <= BROADCAST_PAIRS:
        found = tall.join(F.broadcast(counts), "pair")
    else:
        cut = counts.selectExpr(f"percentile_approx(n, {1 - BROADCAST_PAIRS / n}D, 100000) AS c").first()["c"]
        hot = counts.where(F.col("n") > cut).withColumnsRenamed({"n": "hot_n", "best": "hot_best"})
        part = tall.join(F.broadcast(hot), "pair", "left")
        some = part.where("hot_n is not null").select("digest", "times", F.col("hot_n").alias("n"), F.col("hot_best").alias("best"))
        rest = part.where("hot_n is null").select("digest", "pair", "times").join(counts.where(F.col("n") <= cut), "pair").select("digest", "times", "n", "best")
        found = some.unionByName(rest)
    return found.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def aligned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    A text that is null, empty, or whose tokens' bytes are not those of a space and the text has no tokens: zeros, and '' for the digest. Special tokens' strings are plain text.
    Rows with the same text have the same measures, and their links count each; null and repeated ids keep their rows. An empty table gives no rows; further columns are ignored.
    Runs jobs: the texts' pairs and the pair counts are written to the shared folder, and the counts are counted.
    """
    texts = written(distinct_texts(docs, text, a_vocabulary, b_vocabulary), "aligned")
    counts = written(pair_counts(texts), "pairs")
    found = texts.drop("copies", "pairs", "times").join(measures(texts, counts), "digest", "left")
    rows = docs.select(F.col(id_column).alias("id"), F.unhex(F.sha2(F.col(text).cast("string"), 256)).alias("digest"))
    out = rows.join(found, "digest", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
