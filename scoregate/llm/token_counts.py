"""Token counts: how many tokens a byte-level BPE vocabulary gives each text, without producing their ids.

Method: a heap of adjacent pairs by (rank, position) over a doubly linked list of symbols. The lowest pair is popped again
and again; a stale one (an end gone or changed) is passed over; a merge links the symbol out and offers its two new pairs.
The count of a piece is its initial symbols less its merges. A piece of n bytes costs O(n log n), so a text without any
space is no special case. Counts of short pieces are kept in a memo of bounded size.

Defined cases: a null text counts as empty (0 bytes, 0 tokens, within the limit); strings of added tokens inside a text
count as one token each; repeated rows and null ids stay; an empty table gives an empty result; every column of the
input but ``text`` may have any name: the result has exactly the four columns named below."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoregate.llm.bpe_model import Model, load, memo_for
from scoregate.llm.common import ship, text_batches


def piece_counter(model: Model):
    """A function from a piece (or an added token's id) to its number of tokens."""
    symbols = model.symbols
    m, pairs = model.pairs()
    pair = pairs.get

    def count(piece) -> int:
        if type(piece) is int:
            return 1
        held = [symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = left = len(held)
        heap = [(found[0], i, i + 1, found[1], held[i], held[i + 1]) for i in range(n - 1) if (found := pair(held[i] * m + held[i + 1]))]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, j, merged, a, b = heappop(heap)
            if held[i] != a or after[i] != j or held[j] != b:
                continue
            held[i], held[j] = merged, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pair(merged * m + held[k]):
                    heappush(heap, (found[0], i, k, found[1], merged, held[k]))
            h = before[i]
            if h >= 0 and (found := pair(held[h] * m + merged)):
                heappush(heap, (found[0], h, i, found[1], held[h], merged))
        return left

    return count


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row. vocabulary: the path of the tokenizer file."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counts, cut = memo_for("count", model, piece_counter), model.cut()
        for batch, texts in text_batches(batches, owner="count"):
            n = [sum(map(counts.__getitem__, cut(t))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    asked = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string").alias("text"),
    )
    return asked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
