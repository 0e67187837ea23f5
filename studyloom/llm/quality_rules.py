"""Quality rules: how much of a text is repeated, measured with rolling hashes.

Every document is read whole. Rolling hashes of word n-grams and hashes of lines are
computed in numpy for a block of documents at once; equal hashes of one document mark
repeated content, and the verdict weighs the characters that lie in it.

Defined cases: null, empty and blank texts have no words and fail the base rule; rows are
judged one by one, so ties and repeated rows get equal verdicts; other columns, whatever
their names, pass through `filter_quality` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm import words as W
from studyloom.llm.names import free

#: Largest share of word characters in repeated n-grams, by n: from the published Gopher rules.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in lines that repeat an earlier line (Gopher rules).
LINE_SHARE = 0.20
#: Largest number of symbols for each word (Gopher's symbol-to-word ratio).
SYMBOL_RATIO = 0.10
BASE_WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_SHARES)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether an equal one comes earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure(block: W.Block) -> dict[str, np.ndarray]:
    """The figures of SCHEMA for each document of a block."""
    n_docs, n = len(block.first) - 1, len(block.start)
    # continuation bytes don't begin a code point; words hold no white space
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    chars = points[block.end] - points[block.start]
    out = {"n_words": block.n_words, "word_chars": W.group_sums(chars, block.first), "n_symbols": W.group_sums(SYMBOLS[block.data], block.bounds)}

    cuts = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.bounds[:-1], cuts + 1]))
    ends = np.sort(np.concatenate([block.bounds[1:], cuts]))
    lo, hi = np.searchsorted(block.start, starts), np.searchsorted(block.start, ends)
    starts, ends, lo, hi = (x[hi > lo] for x in (starts, ends, lo, hi))
    line_doc = np.searchsorted(block.bounds, starts, side="right") - 1
    salt = W.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    _, later = _repeats(W.mix(W.span_hashes(W.byte_codes()[block.data], starts, ends) + (ends - starts).astype(np.uint64)) ^ salt[line_doc])
    sums = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[later], (sums[hi] - sums[lo])[later], n_docs).astype(np.int64)

    hashes = block.word_hashes()
    for width in sorted({*NGRAM_SHARES, BASE_WINDOW}):
        at = W.window_starts(block, width)
        doc = np.repeat(np.arange(n_docs), np.maximum(block.n_words - width + 1, 0))
        twice, later = _repeats(W.mix(W.span_hashes(hashes, at, at + width)) ^ salt[doc])
        if width == BASE_WINDOW:
            out["n_repeat_words"] = W.group_sums(W.covered(n, at[twice], width), block.first)
        if width in NGRAM_SHARES:
            out[f"dup_chars_{width}"] = W.group_sums(np.where(W.covered(n, at[later], width), chars, 0), block.first)
    return out


def _measured(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for block in W.blocks(batch.column(at)):
                found, rows = measure(block), batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(found[k], pa.int64()) for k in NAMES)], names=[*(f"c{i}" for i in range(len(rows.columns))), *(f"m{i}" for i in range(len(NAMES)))])

    return run


def with_repetition(docs: DataFrame, text: str = "text", name: str = "repetition") -> DataFrame:
    """docs with a struct column holding the figures of SCHEMA; its name must be free."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + [f"m{i} long" for i in range(len(NAMES))]
    out = plain.mapInArrow(_measured(f"c{at}"), ", ".join(fields))
    return out.select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)), F.struct(*(F.col(f"m{i}").alias(x) for i, x in enumerate(NAMES))).alias(name))


def base_failed(r: Column) -> Column:
    return (r["n_words"] < 20) | (100 * r["n_repeat_words"] > 30 * r["n_words"])


def passes(r: Column) -> Column:
    """The verdict: the base rule, the repeated shares and the symbols."""
    total = F.greatest(r["word_chars"], F.lit(1))
    good = ~base_failed(r) & (r["dup_line_chars"] <= LINE_SHARE * total) & (r["n_symbols"] <= SYMBOL_RATIO * r["n_words"])
    for n, share in NGRAM_SHARES.items():
        good &= r[f"dup_chars_{n}"] <= share * total
    return good


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they were."""
    name = free(docs.columns, "repetition")
    return with_repetition(docs, text, name).where(passes(F.col(name))).drop(name)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept for every document."""
    r = F.col("repetition")
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return with_repetition(docs.select("doc_id", "text")).select("doc_id", *(r[x].alias(x) for x in shown), base_failed(r).alias("base_failed"), passes(r).alias("kept"), r["dup_line_chars"].alias("dup_line_chars"), *(r[f"dup_chars_{n}"].alias(f"dup_chars_{n}") for n in NGRAM_SHARES))
