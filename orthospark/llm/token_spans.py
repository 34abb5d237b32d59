"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole.  The tokens' byte lengths give every token's span in the text, and an interval
join (a bisection of the sections' sorted bounds) attributes tokens to sections: the lines of a text, each with its line
feed (line_tokens), or fields that callers give as a column of spans (field_tokens).  A token that crosses a bound belongs to the section that holds its
first byte; "last" gives it to the one that holds its last byte and "most" to the one with most of its bytes (the
first of equals).  Each token is counted once, so sections add up to the whole document's count.

Defined cases: a null or empty text has one empty section without tokens; a final line feed does not open a further
section; repeated rows and rows with a null id each get their rows; what no field covers is a section without a name;
where fields overlap, the one that begins first has the overlap; fields are cut to the text; null fields are none; an
empty table stays empty; other columns are not read; a very long text is encoded alone.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_chunks
from .tokens import tokenizer_path

VOCABULARY, RULE = "byte_bpe_50k.tiktoken", "first"
_loaded: dict[str, tuple] = {}


def encoder(path: str):
    """The encoding of a ranks file, and each token's length in bytes."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def attributed(ends: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a bound); ends: where tokens end; bounds: where sections begin."""
    start = ends - sizes
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, start), "right") - 1
    chosen = {"first": first, "last": last}.get(rule, first.copy())
    if rule == "most":
        for t in np.flatnonzero(first != last):
            cuts = np.concatenate([[start[t]], bounds[first[t] + 1 : last[t] + 1], [ends[t]]])
            chosen[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return chosen, first != last


def line_bounds(raw: bytes) -> np.ndarray:
    """Where lines begin, in bytes."""
    feeds = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(raw)]])


def line_tokens(docs: DataFrame, text: str = "text", id: str = "doc_id", rule: str = RULE, path: str | None = None) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing): a row a line; start and end in characters; n_crossing: of its tokens, those that cross a bound."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    path = path or tokenizer_path(VOCABULARY)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, lengths = encoder(path)
        rows, out = [], {k: [] for k in ("section", "start", "end", "n_tokens", "n_crossing")}
        for i, value in enumerate(batch.column(1).to_pylist()):
            value = value or ""
            raw = value.encode()
            sizes = lengths[np.array(encoding.encode_ordinary(value), dtype=np.int64)]
            bounds = line_bounds(raw)
            section, crossing = attributed(np.cumsum(sizes), sizes, bounds, rule)
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
            rows.append(np.full(len(bounds), i))
            out["section"].append(np.arange(len(bounds)))
            out["start"].append(chars[bounds])
            out["end"].append(chars[np.append(bounds[1:], len(raw))])
            out["n_tokens"].append(np.bincount(section, minlength=len(bounds)))
            out["n_crossing"].append(np.bincount(section[crossing], minlength=len(bounds)))
        return pa.RecordBatch.from_pydict({id: batch.column(0).take(pa.array(np.concatenate(rows)))} | {k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()})

    return map_chunks(docs.select(id, text), text, work, f"`{id}` {docs.schema[id].dataType.simpleString()}, section long, start long, end long, n_tokens long, n_crossing long")


def field_bounds(fields: list[dict] | None, size: int) -> tuple[list[int], list[int]]:
    """(where stretches of one owner begin, their owners): the number of the field that has them, or -1."""
    spans = [(max(0, min(size, f["start"] or 0)), max(0, min(size, size if f["end"] is None else f["end"]))) if f else (0, 0) for f in fields or []]
    bounds = sorted({0, *(x for s in spans for x in s)} - {size} or {0})
    owners, order, waiting, active = [], sorted(range(len(spans)), key=lambda k: (spans[k][0], k)), 0, []
    for at in bounds:
        while waiting < len(order) and spans[order[waiting]][0] <= at:
            active.append(order[waiting])
            waiting += 1
        active = [k for k in active if spans[k][1] > at]
        owners.append(active[0] if active else -1)
    return bounds, owners


def field_tokens(docs: DataFrame, fields: str = "fields", text: str = "text", id: str = "doc_id", rule: str = RULE, path: str | None = None) -> DataFrame:
    """(id, field, n_tokens, n_crossing): a row a field, and one for the rest of the text where it has tokens.

    fields is a column of arrays of (name, start, end) in characters.
    """
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    path = path or tokenizer_path(VOCABULARY)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, lengths = encoder(path)
        rows, names, tokens, crossings = [], [], [], []
        for i, (value, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            raw = np.frombuffer((value or "").encode(), dtype=np.uint8)
            sizes = lengths[np.array(encoding.encode_ordinary(value or ""), dtype=np.int64)]
            bounds, owners = field_bounds(own, len(value or ""))
            begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[bounds]
            stretch, crossing = attributed(np.cumsum(sizes), sizes, begins, rule)
            owner = np.array(owners, dtype=np.int64)[stretch] if len(stretch) else stretch
            n = len(own or [])
            count, crossed = np.bincount(owner + 1, minlength=n + 1), np.bincount(owner[crossing] + 1, minlength=n + 1)
            for k in range(-1, n):
                if k >= 0 or count[0] or not n:
                    rows.append(i)
                    names.append(own[k]["name"] if k >= 0 and own[k] else None)
                    tokens.append(int(count[k + 1]))
                    crossings.append(int(crossed[k + 1]))
        return pa.RecordBatch.from_pydict({id: batch.column(0).take(pa.array(rows, pa.int32())), "field": pa.array(names, pa.string()), "n_tokens": pa.array(tokens, pa.int64()), "n_crossing": pa.array(crossings, pa.int64())})

    return map_chunks(docs.select(id, text, fields), text, work, f"`{id}` {docs.schema[id].dataType.simpleString()}, field string, n_tokens long, n_crossing long")
