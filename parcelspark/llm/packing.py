"""Token ids packed into fixed-length sequences: best-fit-decreasing with a segment tree over free capacities.

Every document becomes token ids and an end-of-text id; longer documents are cut into pieces of at most ``seq_len`` ids,
so that the pieces of a document joined in order of ``piece_starts`` are its ids again. Pieces are packed in pools: a
task gathers about ``pool_tokens`` ids at a time, packs them and writes them out, so its memory is bounded by the pool and the
longest text, no row is shuffled, and a lost task only packs its own input split again. A pool holds thousands of
sequences, at which size best-fit-decreasing leaves little room in each. Which documents share a sequence depends on how the input is split; every id is in one
sequence however it is.

Output, one row per packed sequence: ``input_ids`` (the row of the id matrix: ``seq_len`` unsigned little-endian
integers of ``id_bytes`` bytes, padded with the end-of-text id), ``position_ids`` (the same shape, starting again at 0 in
each segment, 0 in the padding), ``cu_seqlens`` (cumulative segment lengths from 0), ``doc_ids`` and ``piece_starts``
(the document of each segment, and where in it the segment starts), ``n_tokens``.

Defined results: a null or empty text is the end-of-text id alone; a null id stays null in ``doc_ids``; repeated rows are
packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that the vocabulary was built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
SCHEMA = "n_tokens int, n_segments int, doc_ids array<bigint>, piece_starts array<bigint>, cu_seqlens array<int>, input_ids binary, position_ids binary"
#: Texts are encoded in runs of about this many characters, so that one call never holds much of a very long text.
RUN = 1 << 20


class CapacityTree:
    """Segment tree over capacities 0..size that holds how many open bins have each; finds the tightest fit in log time."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least capacity of ``need`` or more, as (capacity, bin), taken out; None if there is none."""
        at = need + self.width
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first ancestor with something to its right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        self._add(at - self.width, -1)
        return at - self.width, self.bins[at - self.width].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into ``lengths``. Longest first, ties by index; each goes where least room is left over."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = (capacity, len(bins))
            bins.append([])
        bins[found[1]].append(i)
        if found[0] > lengths[i]:
            tree.put(found[0] - lengths[i], found[1])
    return bins


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's contents."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(text: str, run: int = RUN) -> Iterator[str]:
    """Cut a text where the pattern always starts a new piece (a space before a letter, after a letter)."""
    start = 0
    while len(text) - start > run:
        at = start + run
        while at < len(text) and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1: at + 2].isalpha()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def _packed(pool: list[tuple], seq_len: int, dtype, pad: int) -> pd.DataFrame:
    out = []
    for members in best_fit_decreasing([len(p[2]) for p in pool], seq_len):
        ids, positions = np.full(seq_len, pad, dtype), np.zeros(seq_len, dtype)
        ends = [0]
        for i in members:
            n = len(pool[i][2])
            ids[ends[-1]: ends[-1] + n] = pool[i][2]
            positions[ends[-1]: ends[-1] + n] = np.arange(n, dtype=dtype)
            ends.append(ends[-1] + n)
        out.append((ends[-1], len(members), [pool[i][0] for i in members], [pool[i][1] for i in members], ends, ids.tobytes(), positions.tobytes()))
    return pd.DataFrame(out, columns=["n_tokens", "n_segments", "doc_ids", "piece_starts", "cu_seqlens", "input_ids", "position_ids"])


def pack(docs: DataFrame, seq_len: int = 2048, pool_tokens: int = 1 << 21, vocabulary: str = VOCABULARY, end_of_text: int = END_OF_TEXT,
         id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed sequences of all documents; see the module for the columns."""
    dtype = np.dtype(f"<u{id_bytes}")
    if seq_len > np.iinfo(dtype).max or end_of_text > np.iinfo(dtype).max:
        raise ValueError("ids or positions do not fit id_bytes")

    with open(vocabulary, "rb") as f:  # the driver's file; executors need none
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(shipped.value)
        pool, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                doc_id = None if doc_id is None else int(doc_id)
                parts = [np.asarray(tool.encode_ordinary(part), dtype) for part in runs(text)]
                ids = np.concatenate([*parts, np.array([end_of_text], dtype)])
                for start in range(0, len(ids), seq_len):
                    pool.append((doc_id, start, ids[start: start + seq_len]))
                held += len(ids)
                if held >= pool_tokens:
                    yield _packed(pool, seq_len, dtype, end_of_text)
                    pool, held = [], 0
        if pool:
            yield _packed(pool, seq_len, dtype, end_of_text)

    # ids pass through Python as text: a nullable number would come back rounded
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(tasks, SCHEMA)


def write_binary(packed: DataFrame, path: str, seq_len: int = 2048) -> None:
    """Write the packed sequences as Parquet, sized by rows so that every file holds whole rows of the id matrix."""
    packed.write.option("compression", "zstd").option("maxRecordsPerFile", (1 << 28) // seq_len).parquet(path)


def fill_rate(packed: DataFrame, seq_len: int = 2048) -> DataFrame:
    """One row: ``n_sequences, fill`` (the share of places that hold ids of documents)."""
    return packed.agg(F.count("*").alias("n_sequences"), (F.sum("n_tokens") / (F.count("*") * seq_len)).alias("fill"))
