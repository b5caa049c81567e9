"""Quality rules from the repeated substrings of each document.

The words of a document are the letters of a text whose suffixes are sorted by prefix doubling. Neighbours in that order
give the longest-common-prefix intervals: the deepest interval around a suffix is the longest maximal repeat that begins
with it. The union of these repeats is the covered part, the longest of them the longest repeat; both are limited.
Many documents are worked on at once in numpy arrays; a document is never compared with another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketframe.llm.words import MULTIPLIER, mix, powers, split_words, text_slices, window_codes

SYMBOLS = b"#*$%&|<>"
WHITE_BYTES = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class RepetitionRules:
    """``window`` is the base rule's; a text fails with fewer than ``min_words`` words, with more than
    ``max_window_share`` of its words in repeated windows, with more than ``max_covered`` of them in maximal repeats of
    ``min_repeat`` words or more, or with a repeat longer than ``max_longest`` words."""

    window: int = 8
    min_words: int = 20
    max_window_share: int = 30
    min_repeat: int = 6
    max_covered: float = 0.5
    max_longest: int = 200


def repeated_places(row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries share row and key with another entry."""
    keys = mix(keys + row.astype(np.uint64) * MULTIPLIER)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def longest_repeats(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run that begins there and begins elsewhere in the same row too."""
    n = len(code)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = np.unique(mix(code + row.astype(np.uint64) * MULTIPLIER), return_inverse=True)[1]
    ends = np.searchsorted(row, row, side="right")
    places = np.arange(n)
    step = 1
    while True:
        after = places + step
        inside = after < ends
        key = rank * np.int64(n + 1)
        key[inside] += rank[after[inside]] + 1
        found, rank = np.unique(key, return_inverse=True)
        if len(found) == n:
            break
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = places
    left, right = order[:-1], order[1:]
    # Common prefixes of neighbours by halving steps on prefix hashes.
    power = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    inverse = powers_of(inverse_of(MULTIPLIER), n + 1)
    np.cumsum(mix(code) * power[:n], out=total[1:])
    room = np.where(row[left] == row[right], np.minimum(ends[left] - left, ends[right] - right), 0)
    common = np.zeros(n - 1, dtype=np.int64)
    jump = 1 << max(int(room.max(initial=0)).bit_length() - 1, 0)
    while jump:
        upto = common + jump
        able = np.flatnonzero(upto <= room)
        a, b, size = left[able], right[able], upto[able]
        equal = (total[a + size] - total[a]) * inverse[a] == (total[b + size] - total[b]) * inverse[b]
        common[able[equal]] = size[equal]
        jump >>= 1
    longest = np.zeros(n, dtype=np.int64)
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest


def inverse_of(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 2**64))


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def repetition_figures(texts: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All counts and figures of some texts as one array each."""
    words = split_words(texts)
    n_rows, row, code = words.n_rows, words.row, words.code
    n_words = words.counts()
    codes, at = window_codes(words, rules.window)
    starts = at[repeated_places(row[at], codes)]
    in_window = covered(len(code), starts, np.full(len(starts), rules.window))
    figures = {"n_words": n_words, "n_repeat_words": np.bincount(row[in_window], minlength=n_rows)}

    # Only documents with some run of min_repeat words twice have repeats to find.
    codes, at = window_codes(words, rules.min_repeat)
    doubtful = np.zeros(n_rows, dtype=bool)
    doubtful[row[at[repeated_places(row[at], codes)]]] = True
    used = np.flatnonzero(doubtful[row])
    longest = np.zeros(len(code), dtype=np.int64)
    longest[used] = longest_repeats(row[used], code[used])
    longest[longest < rules.min_repeat] = 0
    starts = np.flatnonzero(longest)
    figures["covered_words"] = np.bincount(row[covered(len(code), starts, longest[starts])], minlength=n_rows)
    figures["longest_repeat"] = np.zeros(n_rows, dtype=np.int64)
    np.maximum.at(figures["longest_repeat"], row[starts], longest[starts])

    plain = [text or "" for text in texts.to_pylist()]
    data = [text.encode() for text in plain]
    figures["word_chars"] = np.array([len(t) - (len(b) - len(b.translate(None, WHITE_BYTES))) for t, b in zip(plain, data, strict=True)], dtype=np.int64)
    figures["n_symbols"] = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in data], dtype=np.int64)
    figures["n_dup_lines"] = np.array([duplicate_lines(b) for b in data], dtype=np.int64)
    return figures


def duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(WHITE_BYTES)]
    return len(lines) - len(set(lines))


def repetition_quality(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """Counts, repeat figures and the verdict of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept``, one row per row. NULL and empty
    texts have no words and fail the base rule. Texts of any length are read whole. Repeated rows and ids are judged
    one by one; an empty table gives an empty one.
    """
    rules = rules or RepetitionRules()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                figures = repetition_figures(texts, rules)
                n = figures["n_words"]
                failed = (n < rules.min_words) | (100 * figures["n_repeat_words"] > rules.max_window_share * n)
                good = ~failed & (figures["covered_words"] <= rules.max_covered * n) & (figures["longest_repeat"] <= rules.max_longest)
                columns = [batch.column(0).slice(first, len(texts)), *(pa.array(figures[c], pa.int64()) for c in counts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(good)], names=["doc_id", *counts, "base_failed", "kept"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{c} long" for c in counts)
    return source.mapInArrow(run, f"doc_id long, {fields}, base_failed boolean, kept boolean")
