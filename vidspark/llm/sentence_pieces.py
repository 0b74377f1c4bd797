"""Encoding and decoding with the pieces of a merge model, per row, without a shuffle.

`prefix_table` does the work on a text; tasks read the model's file and remember stretches within bounds.

Defined results: null and empty texts have the begin and end ids alone and decode to an empty text; bytes
that are no UTF-8 count as U+FFFD; U+2581 in a text is a space to the model and decodes as one; very long
texts take time in proportion to their length; repeated rows are encoded each, null ids stay null, an empty
table gives an empty result and other columns, whatever they are called, are ignored. `decoded` takes
null ids as none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.prefix_table import PrefixTable
from vidspark.llm.text import only

#: Bytes of text a worker encodes before it hands its rows on.
TOGETHER = 4_000_000


def _lists(ids: list[bytes]) -> pa.Array:
    sizes = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))


def _encode(batches: Iterator[pa.RecordBatch], path: str, begin: bool, end: bool, as_bytes: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    table = PrefixTable.of(path)
    names = ["doc_id", "ids", *(["text"] if with_text else [])]

    def rows(keys: list[int]) -> pa.RecordBatch:
        columns = [batch.column("doc_id").take(pa.array(keys, pa.int64())), pa.array(ids, pa.binary()) if as_bytes else _lists(ids)]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(back, pa.string())] if with_text else [])], names=names)

    for batch in batches:
        at, ids, back, size = 0, [], [], 0
        for k, text in enumerate(batch.column("_text")):
            ids.append(table.encode(text.as_py() or "", begin, end))
            if with_text:
                back.append(table.decode(np.frombuffer(ids[-1], dtype="<u4")))
            size += len(ids[-1])
            if size > TOGETHER:
                yield rows(list(range(at, k + 1)))
                at, ids, back, size = k + 1, [], [], 0
        if ids:
            yield rows(list(range(at, batch.num_rows)))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = PrefixTable.of(path)
    for batch in batches:
        texts = [table.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column("_ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encoded(
    docs: DataFrame, model: str, *, begin: bool = True, end: bool = True, as_bytes: bool = False, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, the ids of the whole text (a list, or little-endian 32-bit in one binary value) and, if asked
    for, the text that those ids decode to."""
    rows = only(docs, doc_id=id_col, _text=text_col)
    rows = rows.withColumn("_text", F.make_valid_utf8("_text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids {'binary' if as_bytes else 'array<int>'}" + ", text string" * with_text
    return rows.mapInArrow(partial(_encode, path=model, begin=begin, end=end, as_bytes=as_bytes, with_text=with_text), kind)


def decoded(rows: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of a list of ids."""
    rows = only(rows, doc_id=id_col, _ids=ids_col)
    return rows.mapInArrow(partial(_decode, path=model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
