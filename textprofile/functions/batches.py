"""Text kernels over Arrow batches: RE2 replacements, tokens, word counts.

The same definitions as the column expressions of ``functions.text``, run by
Arrow's compiled kernels inside the tasks.  Rows stay where they are: Spark
hands a task's rows over in batches and gets one value a row back, and kernels
that follow one another run in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that a kernel holds as numbers at a time; a longer row is taken alone.
TOKEN_BUDGET = 1_000_000


def replace_all(col: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """The text after each step in turn: ``(pattern, replacement)``, or
    ``("", characters)`` to trim these characters at both ends."""
    todo = list(steps)

    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        for pattern, by in todo:
            a = pc.replace_substring_regex(a, pattern, by) if pattern else pc.utf8_trim(a, by)
        return a
    return run(F.make_valid_utf8(col))


def split_words(a: pa.Array, space: str) -> pa.ListArray:
    """Lists of words between blanks and matches of ``space``, empty ones dropped;
    null texts have null lists."""
    lists = pc.split_pattern(pc.replace_substring_regex(a, space, " "), " ")
    words = lists.values
    keep = np.asarray(pc.not_equal(words, "").to_numpy(zero_copy_only=False), dtype=bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(pa.array(keep)), mask=a.is_null())


def tokens(col: Column, space: str) -> Column:
    """``split_words`` of a column."""
    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        return split_words(a, space)
    return run(F.make_valid_utf8(col))


def row_slices(lengths: np.ndarray, budget: int = TOKEN_BUDGET) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (start, end) of at most ``budget`` elements, or one row."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def offsets_of(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of each row in ``a.values``; null rows have length 0."""
    at = a.offsets.to_numpy().astype(np.int64)
    n = np.diff(at)
    if a.null_count:
        n = np.where(a.is_valid().to_numpy(zero_copy_only=False), n, 0)
    return at[:-1], n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` places, one after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.arange(total) + np.repeat(shift, lengths)


def word_codes(a: pa.ListArray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, numbers) of the rows at these places: each token's place in
    the distinct words (-1: null), in order of first tokens, and their numbers."""
    d = a.values.take(pa.array(ragged(starts, lengths))).dictionary_encode()
    code = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    return code, d.dictionary, np.bincount(code[code >= 0], minlength=len(d.dictionary))


def count_lists(a: pa.ListArray) -> pa.ListArray:
    """Distinct words of each list with their numbers, in order of first codes:
    ``list<struct<word, n>>``; null lists are null, null words don't count."""
    at, n = offsets_of(a)
    words, counts, sizes = [], [], [np.zeros(0, np.int64)]
    for lo, hi in row_slices(n):
        part = a.values.take(pa.array(ragged(at[lo:hi], n[lo:hi])))
        d = part.dictionary_encode()
        code = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(hi - lo), n[lo:hi])
        width = max(len(d.dictionary), 1)
        pair, number = np.unique((row * width + code)[code >= 0], return_counts=True)
        words.append(d.dictionary.take(pa.array(pair % width)))
        counts.append(number)
        sizes.append(np.bincount(pair // width, minlength=hi - lo))
    flat = pa.StructArray.from_arrays([pa.concat_arrays(words) if words else pa.array([], pa.string()),
                                       pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["word", "n"])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=a.is_null())


def word_counts(tokens_col: Column) -> Column:
    """``array<struct<word, n>>``: the distinct words of a token array."""
    @F.arrow_udf("array<struct<word:string,n:bigint>>")
    def run(a: pa.Array) -> pa.Array:
        return count_lists(a)
    return run(tokens_col)
