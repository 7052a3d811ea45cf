"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._tokens import encoder

BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 20


def parts(text: str, most: int = SPLIT_CHARS) -> Iterator[str]:
    """Parts of a text of at most about `most` characters, cut only at safe boundaries."""
    if len(text) <= most:
        yield text
        return
    start = 0
    while start < len(text):
        end = start + most
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                end = len(text)
            elif text[end - 1].isspace():
                end += 1
            else:
                break
        yield text[start:end]
        start = end


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, split_chars: int = SPLIT_CHARS, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes, n_tokens, over_limit for every row; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows pass through, one result a row. Texts
    are dealt into encoding batches by their bytes, not by rows. Where a tokenizer cuts at spaces, texts over split_chars are counted part by part,
    cut before a space that follows a character other than white space, where no token can cross; for others they stay whole. An empty
    table gives an empty table. Columns other than these two are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        for batch in batches:
            counts, waiting, size = [0] * batch.num_rows, [], 0  # waiting: (row, part)

            def close() -> None:
                for (row, _), n in zip(waiting, enc.counts([t for _, t in waiting])):
                    counts[row] += n
                waiting.clear()

            for row, (text, n) in enumerate(zip(batch.column("text"), batch.column("n_bytes").to_pylist())):
                text = text.as_py()
                for part in parts(text, split_chars) if enc.cuts else (text,):
                    if part:
                        waiting.append((row, part))
                    size += len(part) if len(text) > split_chars else n
                    if size >= batch_bytes:
                        close()
                        size = 0
            close()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"coalesce(`{text_col}`, '') AS text").selectExpr("id", "text", "cast(octet_length(text) as long) AS n_bytes")
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.selectExpr(f"id AS `{id_col}`", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} AS over_limit")
