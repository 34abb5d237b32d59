"""Quality rules by suffix arrays: repeated passages inside a text.

A text's words are the symbols.  One array sorts all suffixes of a chunk of texts, the text being the first key, by
prefix doubling; the ranks of every doubling step give the longest common prefix (LCP) of neighbours in the array.  A
suffix whose LCP with a neighbour is at least `min_words` begins a repeat of that length, and the longest one at each
place is right-maximal; the union of their spans equals the union of all maximal repeated substrings of that length or
more.  The verdict limits the covered fraction of the words and the longest repeat.

Defined cases: a null or empty text has no words and fails the base rule (too few words); repeated rows each get a row;
ties cannot arise; an empty table stays empty; a very long text is worked on alone.  Other columns of the input are ignored by measure() and kept by keep().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NOT_SPACE, Text, byte_set, covered, map_chunks, span_hashes, windows
from .suffixes import suffix_array

#: Shortest repeat that counts, in words; most of a text that repeats may cover; longest repeat, in words.
MIN_WORDS, MAX_FRACTION, MAX_REPEAT = 8, 0.5, 100
MIN_TEXT_WORDS = 50
#: Bytes of text that a task works on at a time: a word's ranks take 4 bytes for every doubling of the longest repeat.
CHUNK = 1 << 20
_SYMBOL = byte_set(lambda b: chr(b) in "#*$%&|<>")


def longest_repeats(symbols: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each place, the length of the longest substring from there that also begins elsewhere in the same text; 0 below `least`."""
    n = len(symbols)
    out = np.zeros(n, dtype=np.int64)
    if n == 0:
        return out
    order, levels, last = suffix_array(symbols, doc, by_doc=True)
    floor = least.bit_length() - 1  # pairs that agree on 2**floor words are the only ones that can reach `least`
    if floor >= len(levels):
        return out
    pair = np.flatnonzero(levels[floor][order[:-1]] == levels[floor][order[1:]])
    a, b = order[pair], order[pair + 1]
    left, right = a.copy(), b.copy()
    lcp = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a + (1 << k) <= last[left]) & (b + (1 << k) <= last[right])
        same = fits & (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)])
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[lcp < least] = 0
    np.maximum.at(out, left, lcp)
    np.maximum.at(out, right, lcp)
    return out


def measures(texts: pa.Array, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """One value of each measure a text."""
    text = Text(texts)
    words = text.words(NOT_SPACE)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[text.first])
    n_words = np.diff(words.at)
    out = {"n_words": n_words, "word_chars": total(words.inside & ((text.bytes & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[text.bytes])}

    # Lines with a word; a line begins at its text's start or after a line feed.
    ends = np.flatnonzero(text.bytes == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(words.start, begins)
    has_word = np.searchsorted(words.start, ends) > first
    begins, ends = begins[has_word], ends[has_word]
    owner = np.searchsorted(text.first, begins, "right") - 1
    lines = span_hashes(text.bytes, begins, ends)
    order = np.lexsort((lines, owner))
    lines, owner = lines[order], owner[order]
    again = (lines[1:] == lines[:-1]) & (owner[1:] == owner[:-1])
    out["n_dup_lines"] = np.bincount(owner[1:][again], minlength=text.n)

    symbols = words.hashes()
    triple, at = windows(symbols, words.doc, 3)
    order = np.lexsort((triple, words.doc[at]))
    same = (triple[order][1:] == triple[order][:-1]) & (words.doc[at][order][1:] == words.doc[at][order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out["n_repeat_words"] = words.per_doc(covered(at[twice], 3, len(words)))

    repeat = longest_repeats(symbols, words.doc, min_words)
    long = np.flatnonzero(repeat >= min_words)
    out["n_covered_words"] = words.per_doc(covered(long, repeat[long], len(words)))
    out["longest_repeat"] = np.zeros(text.n, dtype=np.int64)
    np.maximum.at(out["longest_repeat"], words.doc, repeat)
    return out


def verdicts(m: dict[str, np.ndarray], max_fraction: float, max_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_TEXT_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = (m["n_covered_words"] > max_fraction * m["n_words"]) | (m["longest_repeat"] > max_repeat)
    return failed, ~failed & ~bad


def measure(docs: DataFrame, text: str = "text", id: str = "doc_id", min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row a document: its measures, base_failed, kept, and covered words and longest repeat behind the verdict."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measures(batch.column(1), min_words)
        failed, kept = verdicts(m, max_fraction, max_repeat)
        return pa.RecordBatch.from_pydict({id: batch.column(0), **{k: pa.array(m[k], pa.int64()) for k in names}, "base_failed": failed, "kept": kept, "n_covered_words": pa.array(m["n_covered_words"], pa.int64()), "longest_repeat": pa.array(m["longest_repeat"], pa.int64())})

    kind = docs.schema[id].dataType.simpleString()
    return map_chunks(docs.select(id, text), text, work, f"`{id}` {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, n_covered_words long, longest_repeat long", CHUNK)


def keep(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents whose verdict is good, with all their columns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(verdicts(measures(batch.column(text), min_words), max_fraction, max_repeat)[1]))

    return map_chunks(docs, text, work, docs.schema, CHUNK)
