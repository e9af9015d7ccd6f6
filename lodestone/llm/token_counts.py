"""Token counts by a two-tier lookup on the map side.

Frequent pre-tokens come from a broadcast table of fixed size, the others are
encoded once per worker and kept in its cache. To find the frequent ones their
counts are shuffled, added up within each task; what is counted after that is not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, slices, stored
from .pretoken import PieceTable, piece_table, pieces
from .vocab import library_encoder

#: Most pre-tokens in the broadcast table, of at most so many bytes each: 2.6 MB.
MOST_FREQUENT, LONGEST = 65_536, 15
#: Distinct pre-tokens that a task adds up before it hands on their counts.
HELD = 500_000


def frequent(docs: DataFrame, path: str, text_col: str = "text", most: int = MOST_FREQUENT) -> PieceTable:
    """The ``most`` pre-tokens of at most LONGEST bytes that most often come up in all texts, with their numbers of tokens.

    The table only saves time: a count comes out the same whatever it holds.
    """

    def told(count: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["p", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, "t"):
                raw, begin, end, _ = pieces([t or "" for t in part.column("t").to_pylist()])
                some = end - begin <= LONGEST
                count.update(raw[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True))
                if len(count) > HELD:
                    yield told(count)
                    count = Counter()
        yield told(count)

    counted = docs.selectExpr(f"`{text_col}` AS t").mapInArrow(run, "p binary, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    top = stored(counted.orderBy(F.desc("n"), "p").limit(most).select("p", "n"), "frequent")  # each task's own come together in a task, not in the driver
    total = [bytes(r.p) for r in sorted(top.collect(), key=lambda r: (-r.n, bytes(r.p)))]
    dropped(top)
    encoder = library_encoder(path)
    return piece_table({p: len(encoder.piece(p)) for p in total})


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``path`` names a vocabulary file of the library ``tokenizers``. A null text
    counts as empty: no bytes, no tokens. Repeated rows give repeated results,
    an empty table an empty one; other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        tier = table.value
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [t or "" for t in part.column("t").to_pylist()]
                tokens = encoder.counts(texts, tier)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], ["k", "n_bytes", "n_tokens"])

    counted = docs.selectExpr(f"`{id_col}` AS k", f"`{text_col}` AS t").mapInArrow(run, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
