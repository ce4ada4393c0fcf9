"""Repeated word passages removed, by doubling the length of windows that repeat.

The levels of a window of 50 words are 7, 13, 25 and 50: each level takes only the windows whose
parts of the level before repeat in another document, and asks the same of parts about twice as long
(named by their least hash, see repeats.py), until no candidate survives or the full length is
reached. There, windows are settled as whole runs where all copies agree, and what is still open is
compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlock.llm.flat import flat, pieces, words
from airlock.llm.repeats import by_document, covered, find, keyed, late_windows, lists, word_symbols

WINDOW = 50
#: The shortest part of a window that a level looks at.
SHORTEST = 6


def levels_of(window: int) -> tuple[int, ...]:
    """Lengths of the levels below the window itself, each about twice the one before."""
    out = [(window + 1) // 2]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return tuple(out)



def remove_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept) of every row, without passages that an earlier document has.

    A word goes if a window of `window` words that covers it also starts in a document with a
    smaller id. Windows are judged on the input. `kept` is the remaining words joined by a space.
    A null or empty text has no words. Rows of one id are parts of one document: they remove
    nothing from each other, and each gives a row. A null id removes nothing and loses nothing.
    Other columns are not read, whatever their names.
    """
    base = keyed(docs, id_col, text_col)
    kept = _kept(base, _repeated(base, window), window)
    return kept.withColumnRenamed("_doc", id_col)


def without_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns, the text of each row without the passages of remove_passages.

    A text that loses nothing stays as it is; of others the remaining words are joined by a space.
    No row goes, also not one that loses all its words.
    """
    base = keyed(docs, id_col, text_col, carry=True)
    kept = _kept(base, _repeated(base.drop("_row"), window), window)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"_row.`{text_col}`")).alias(text_col)
    return kept.select(*(text if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def _repeated(base: DataFrame, window: int) -> DataFrame:
    found = find(base, word_symbols, window, levels_of(window), within_rows=False, name="seeds")
    return found.lost.unionByName(late_windows(found.docs, found.open, word_symbols, window, name="word"))


def _kept(base: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    columns = ["_doc", "_t", "_text", *(["_row"] if "_row" in base.columns else [])]
    known = drop_words(base.where(F.col("_doc").isNotNull()).select(*columns), runs, window)
    return known.unionByName(drop_words(base.where(F.col("_doc").isNull()).select(*columns), None, window))


def drop_words(docs: DataFrame, runs: DataFrame | None, window: int) -> DataFrame:
    """(_doc, n_words, n_removed, kept) of every row, and its _row if there is one, without the words
    that the runs' windows cover."""
    carried = ["_row"] if "_row" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, at = lists(batch.column(3))
            counts, _ = lists(batch.column(4))
            total, removed, kept = [], [], []
            for i, j, buf, offs in pieces(*flat(batch.column(2))):
                begins, ends, first = words(buf, offs)
                raw = buf.tobytes()
                for k in range(j - i):
                    b, e = begins[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                    part = slice(at[i + k], at[i + k + 1])
                    if part.stop > part.start:
                        stay = ~covered(b.size, starts[part], counts[part], window)
                        b, e = b[stay], e[stay]
                    total.append(int(first[k + 1] - first[k]))
                    removed.append(total[-1] - b.size)
                    kept.append(b" ".join([raw[x:y] for x, y in zip(b.tolist(), e.tolist(), strict=True)]).decode())
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(batch.column(c) for c in carried)], ["_doc", "n_words", "n_removed", "kept", *carried])

    if runs is None:
        joined = docs.select("_doc", "_t", "_text", *(F.lit(None).cast("array<long>").alias(c) for c in ("starts", "counts")), *carried)
    else:
        joined = docs.join(by_document(runs), ["_doc", "_t"], "left").select("_doc", "_t", "_text", "starts", "counts", *carried)
    schema = docs.select("_doc", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), *carried).schema
    return joined.mapInArrow(run, schema)
