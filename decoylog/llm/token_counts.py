"""Token counts without token ids.

A document is reduced to the frequencies of its pre-tokens.  The pieces of each
distinct pre-token are counted once, by merging it and keeping the number only,
and joined to the frequencies; a document's count is the sum of frequency times
pieces.  No list of ids is ever made.

The join runs inside the task that has read the documents, against the distinct
pre-tokens seen there (a bounded memory): a shuffle of the (document, pre-token)
frequencies would move more bytes than the texts have.

Defined results: a null text is empty and has no tokens; a special token's text
counts as one token; repeated rows each give their row; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog.llm.bpe import Coder, read_vocabulary


def frequencies(coder: Coder, text: str) -> tuple[Counter, int]:
    """Pre-token frequencies of a text, and how many special tokens it holds."""
    seen: Counter = Counter()
    specials = 0
    for part, special in coder.parts(text):
        specials += special is not None
        for block in coder.pieces(part):
            seen.update(block)
    return seen, specials


def pieces_of(coder: Coder, pre_token: str, most: int) -> int:
    """Pieces of a distinct pre-token; counted when first met, forgotten when full."""
    found = coder.counted.get(pre_token)
    if found is None:
        data = pre_token.encode("utf-8", "surrogatepass")
        if len(data) > coder.window:
            return sum(1 for _ in coder.stream(data))
        if len(coder.counted) >= most:
            coder.counted.clear()
        coder.counted[pre_token] = found = len(coder.merged(data))
    return found


def count_tokens(docs: DataFrame, path: str, limit: int = 512, most: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            totals = []
            for text in batch.column(1):
                seen, specials = frequencies(coder, text.as_py() or "")
                totals.append(
                    specials + sum(n * pieces_of(coder, p, most) for p, n in seen.items())
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals, type=pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return (
        docs.select("doc_id", text.alias("text"), size.alias("n_bytes"))
        .mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
