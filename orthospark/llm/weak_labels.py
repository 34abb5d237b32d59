"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers vote on each document: bad, good or nothing.  They overlap and err, and nobody knows how much.  EM
(the model of Dawid and Skene: votes are independent given the class, each labeller has its own accuracies) estimates
their accuracies for three classes (clean, junk, toxic) and the classes' shares from how often each pattern of votes stands in the corpus.  Patterns
are counted over all documents in Spark; there are at most 3 ** labellers, so EM itself runs on a small table.  Given
labels are one labeller more, present where a row has one; a bounded sample of them (`labelled` toxic rows and as many
others) also tells the word labeller which words mark documents that were labelled toxic.

The posterior of a pattern (junk or toxic) is the soft label of each document that has it.  A logistic scorer over hashed features (the
labellers' votes, words and word beginnings) is fitted to it by gradient descent on a bounded sample of `sample`
documents, picked by a hash of their ids, and of at most `cells` features in all, and decides about every document.  A
document comes to the driver as its distinct features and their weights.

Defined cases: a null or empty text gets the votes of a text without words (too short) and is scored like any other;
repeated rows each get a row, and one of them is enough for a sample; labels whose ids repeat: any bad label wins; rows
without an id have no label; without labels the model rests on the heuristics alone; an empty table gives an empty
result; other columns are not read by score() and kept by keep(); a very long text is worked on alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, NOT_SPACE, Text, byte_set, dropped, map_chunks, mixed, windows, written

SAMPLE, LABELLED, HASH_BITS, STEPS, RATE, DECAY = 6000, 30_000, 18, 100, 0.5, 1e-4
#: Most distinct features, summed over the sample's documents, that the scorer is fitted to.
CELLS = 5_000_000
#: Bytes of text that a task works on at a time: votes and features take some hundred bytes a word for a while.
CHUNK = 1 << 20
#: A word (or word beginning) marks toxic text if at least so many toxic rows have it, and so large a share of its rows are toxic.
TOXIC_ROWS, TOXIC_SHARE = 3, 0.95
BEGINNING = 4
THRESHOLD = 0.4
#: Insults.
INSULTS = "idiot moron stupid trash pathetic disgusting loser worthless clown scum".split()
_UPPER = byte_set(lambda b: 0x41 <= b <= 0x5A)
_END = byte_set(lambda b: chr(b) in ".!?")
_LOWER = byte_set(lambda b: 0x61 <= b <= 0x7A)
_SYMBOL = byte_set(lambda b: chr(b) in "#*$%&|<>!_=~^{}[]\\")
LABELLERS = ("length", "shouting", "symbols", "repeated words", "repeated phrases", "sentences", "insults", "toxic words")
BAD, GOOD, NOTHING = 1, 0, 2
#: Classes; the labellers that speak about toxic text.
CLEAN, JUNK, TOXIC, UNKNOWN = 0, 1, 2, 3
TOXIC_VOTES = [6, 7]


def word_codes(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of the first BEGINNING bytes of longer words (0 for others)."""
    begin = np.zeros(len(words), dtype=np.uint64)
    long = np.flatnonzero(words.end - words.start > BEGINNING)
    for k in range(BEGINNING):
        begin[long] = begin[long] << np.uint64(8) | words.text.bytes[words.start[long] + k]
    begin[long] = mixed(begin[long] + np.uint64(1))
    return words.hashes(), begin


def codes_of(words: list[str]) -> np.ndarray:
    return Text(pa.array(words, pa.string()), lower=True).words(ALNUM).hashes()


class Features:
    """Votes and hashed words of some texts."""

    def __init__(self, texts: pa.Array, marks: np.ndarray):
        text = Text(texts)
        size = np.maximum(np.diff(text.first) - 1, 1)
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[text.first])
        upper, lower, symbols = total(_UPPER[text.bytes]), total(_LOWER[text.bytes]), total(_SYMBOL[text.bytes])
        spaced = text.words(NOT_SPACE)
        n = np.diff(spaced.at)
        ends = spaced.per_doc(_END[text.bytes[spaced.end - 1]]) if len(spaced) else np.zeros(text.n)
        self.words = low = Text(texts, lower=True).words(ALNUM)
        self.code, self.begin = word_codes(low)
        n_low = np.maximum(np.diff(low.at), 1)
        again = np.zeros(len(low), dtype=bool)
        if len(low):
            again[1:] = (self.code[1:] == self.code[:-1]) & (low.doc[1:] == low.doc[:-1])
        triple, at = windows(self.code, low.doc, 3)
        triple = np.sort(mixed(triple + low.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24) | low.doc[at].astype(np.uint64) << np.uint64(40))
        twice = np.bincount((triple[1:][triple[1:] == triple[:-1]] >> np.uint64(40)).astype(np.int64), minlength=text.n)
        insult = low.per_doc(np.isin(self.code, codes_of(INSULTS)))
        toxic = low.per_doc(np.isin(self.code, marks) | np.isin(self.begin, marks))
        symbol_share, repeats, phrases = symbols / size, low.per_doc(again) / n_low, twice / n_low
        shout, per_sentence = upper / np.maximum(upper + lower, 1), n / np.maximum(ends, 1)
        vote = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NOTHING))
        self.votes = np.stack([
            vote(n == 0, n >= 50), vote((shout > 0.3) & (n >= 3), shout < 0.15), vote(symbol_share > 0.02, symbol_share < 0.005), vote(repeats > 0.1, repeats < 0.03), vote(phrases > 0.3, phrases < 0.1),
            vote((per_sentence > 60) & (n >= 60), (ends > 0) & (per_sentence < 30)), vote(insult > 0, insult < 0), vote(toxic > 0, toxic < 0),
        ], axis=1).astype(np.int8)
        self.n, self.n_words = text.n, n_low

    def patterns(self) -> np.ndarray:
        return (self.votes.astype(np.int64) * 3 ** np.arange(self.votes.shape[1])).sum(axis=1)

    def vote_columns(self) -> np.ndarray:
        return np.arange(self.votes.shape[1]) * 3 + self.votes

    def word_columns(self) -> np.ndarray:
        """Two columns a word: the whole word's and its beginning's."""
        return 3 * self.votes.shape[1] + (np.stack([self.code, self.begin], axis=1) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def labelled_sample(given: DataFrame, id: str, size: int) -> DataFrame:
    """At most `size` toxic rows and as many others, picked by a hash of their ids."""
    part = lambda rows: rows.orderBy(F.xxhash64(id)).limit(size)
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return part(given.where(toxic)).union(part(given.where(~toxic))).select(id, toxic.alias("bad"))


def toxic_marks(rows: DataFrame, sample: DataFrame, text: str, id: str) -> np.ndarray:
    """Hashes of all words and word beginnings that mark toxic rows of the sample, which bounds their number.

    Near copies say the same thing many times over, so of the rows with the same least hash of three words one counts.
    A mark must stand in so many rows that chance would not make even one of them in a hundred samples.
    """

    def signature(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = Text(batch.column(1), lower=True).words(ALNUM)
        triple, at = windows(low.hashes(), low.doc, 3)
        least = np.full(batch.num_rows, -1, dtype=np.int64).view(np.uint64)
        np.minimum.at(least, low.doc[at], triple)
        return pa.RecordBatch.from_pydict({id: batch.column(0), "bad": batch.column(2), "least": pa.array(least.view(np.int64)), "hash": batch.column(3)})

    kind = rows.schema[id].dataType.simpleString()
    picked = rows.join(F.broadcast(sample), id).select(id, text, "bad", F.xxhash64(text))  # the sample is bounded
    single = map_chunks(picked, text, signature, f"`{id}` {kind}, bad boolean, least long, hash long", CHUNK).groupBy("least").agg(F.min(F.struct(id, "bad", "hash")).alias("row")).select("row.*")
    single = written(single, "single")
    total, bad = single.agg(F.count("*"), F.count_if("bad")).first()
    if not bad or bad == total:
        return np.empty(0, dtype=np.uint64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = Text(batch.column(0), lower=True).words(ALNUM)
        toxic = np.asarray(batch.column(1)).astype(bool)
        out = []
        for whole, code in enumerate(word_codes(low)):
            keep = code != 0
            order = np.lexsort((low.doc[keep], code[keep]))
            key, doc = code[keep][order], low.doc[keep][order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, first = np.unique(key[new], return_inverse=True)
            out.append((np.full(len(key), whole), key.view(np.int64), np.bincount(first, minlength=len(key)), np.bincount(first, weights=toxic[doc[new]], minlength=len(key))))
        return pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(x).astype(np.int64)) for name, x in zip(("kind", "code", "n", "bad"), zip(*out))})

    # Rows that repeat an id and its text count once: of each only its words travel.
    chosen = rows.withColumn("hash", F.xxhash64(text)).join(F.broadcast(single), [id, "hash"]).dropDuplicates([id, "hash"]).select(text, "bad")
    counts = written(map_chunks(chosen, text, work, "kind long, code long, n long, bad long").groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "marks")
    dropped(single)
    found = []
    for k, size in counts.groupBy("kind").count().collect():
        least = max(TOXIC_ROWS, int(np.ceil(np.log(size / 0.01) / np.log(total / bad))))
        own = counts.where((F.col("kind") == k) & (F.col("bad") >= least) & (F.col("bad") >= TOXIC_SHARE * F.col("n")))
        found.append(own.select("code").toArrow()["code"].to_numpy())
    dropped(counts)
    return np.unique(np.concatenate(found)).view(np.uint64)


def em(votes: np.ndarray, count: np.ndarray, given: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern by class, share of each class, chance of each vote by labeller and class).

    given: a pattern's class where it has a label, else UNKNOWN.  Given labels are held, as the most accurate labeller;
    the start is what the cast votes say.
    """
    classes = np.arange(3)
    held = np.where(given[:, None] == classes, 0.98, 0.01)
    toxic, junk = (votes[:, TOXIC_VOTES] == BAD).any(axis=1), (votes == BAD).any(axis=1)
    start = np.where(toxic, TOXIC, np.where(junk, JUNK, CLEAN))
    posterior = np.where((given != UNKNOWN)[:, None], held, np.where(start[:, None] == classes, 0.9, 0.05))
    chance, share = np.zeros((votes.shape[1], 3, 3)), np.full(3, 1 / 3)
    for _ in range(rounds):
        weight = (posterior * count[:, None]).T
        for k in range(3):
            chance[:, :, k] = (weight @ (votes == k) + 0.5).T
        chance /= chance.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (count.sum() + 3)
        log = np.log(share) + sum(np.log(chance[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        new = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
        new = np.where((given != UNKNOWN)[:, None], held, new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300))
        done = not len(new) or np.abs(new - posterior).max() < 1e-6
        posterior = new
        if done:
            break
    return posterior, share, chance


class Scorer:
    def __init__(self, marks: np.ndarray, weights: np.ndarray, bias: float, accuracies: pd.DataFrame):
        self.marks, self.weights, self.bias, self.accuracies = marks, weights, bias, accuracies

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The chance that each text is bad."""
        f = Features(texts, self.marks)
        words = f.words.per_doc(self.weights[f.word_columns()].sum(axis=1)) / f.n_words
        return 1 / (1 + np.exp(-np.clip(self.weights[f.vote_columns()].sum(axis=1) + words + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", sample: int = SAMPLE, labelled: int = LABELLED, cells: int = CELLS) -> Scorer:
    given = labels.where(F.col(id).isNotNull()).groupBy(id).agg(F.min(quality).alias("quality"), F.max(toxic).alias("toxic"))
    rows = docs.select(id, text)
    marks = toxic_marks(rows, labelled_sample(given, id, labelled), text, id)

    # Votes of every document, next to its label.
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({id: batch.column(0), "row": batch.column(2), "pattern": pa.array(Features(batch.column(1), marks).patterns())})

    row = F.xxhash64(id, text)
    cast = map_chunks(rows.withColumn("row", row), text, work, f"`{id}` {docs.schema[id].dataType.simpleString()}, row long, pattern long", CHUNK)
    label = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, JUNK).when((F.col("quality") == 1) | (F.col("toxic") == 0), CLEAN).otherwise(UNKNOWN).alias("given")
    voted = written(cast.join(given, id, "left").select("row", "pattern", label), "votes")
    table = voted.groupBy("pattern", "given").agg(F.count("*").alias("n")).orderBy("pattern", "given").toPandas()
    votes = (table["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(LABELLERS)) % 3) if len(table) else np.empty((0, len(LABELLERS)), dtype=int)
    posterior, share, chance = em(votes, table["n"].to_numpy(dtype=float), table["given"].to_numpy())
    names = ("clean", "junk", "toxic")
    accuracies = pd.DataFrame({"labeller": LABELLERS} | {f"{vote}_if_{name}": chance[:, c, v] for c, name in enumerate(names) for v, vote in ((BAD, "bad"), (GOOD, "good"))})
    bad = 1 - posterior[:, CLEAN]

    # The bounded sample, with the posterior of its pattern as its label.
    soft = {(p, g): x for p, g, x in zip(table["pattern"].tolist(), table["given"].tolist(), bad.tolist())}
    picked = voted.distinct().orderBy("row", "given").limit(sample).dropDuplicates(["row"])

    width, v = 3 * len(LABELLERS) + (1 << HASH_BITS), len(LABELLERS)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A vote counts 1; a text's words share a weight of 1.  Equal features of a text are added up."""
        f = Features(batch.column(0), marks)
        rows = np.concatenate([np.repeat(np.arange(f.n), v), np.repeat(f.words.doc, 2)])
        value = np.concatenate([np.ones(f.n * v), np.repeat(1.0 / f.n_words[f.words.doc], 2)])
        cell, inverse = np.unique(rows * width + np.concatenate([f.vote_columns().ravel(), f.word_columns().ravel()]), return_inverse=True)
        at = np.searchsorted(cell, np.arange(f.n + 1) * width).astype(np.int32)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(x, kind))
        y = [soft[x] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_pydict({"row": batch.column(3), "y": pa.array(y, pa.float64()), "size": pa.array(np.diff(at), pa.int32()), "column": lists(cell % width, pa.int32()), "value": lists(np.bincount(inverse, weights=value, minlength=len(cell)), pa.float64())})

    # The sample is bounded, and of rows that repeat an id and its text one is taken.
    chosen = rows.withColumn("row", row).join(F.broadcast(picked), "row").dropDuplicates(["row"]).select(text, "pattern", "given", "row")
    cells_of = written(map_chunks(chosen, text, features, "row long, y double, size int, column array<int>, value array<double>", CHUNK), "features")
    taken, total = [], 0
    for key, size in sorted((r.row, r["size"]) for r in cells_of.select("row", "size").collect()):  # at most `sample` rows
        if total + size <= cells or not taken:
            taken.append((key,))
            total += size
    found = cells_of.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "row long")), "row").toArrow() if taken else cells_of.toArrow()
    dropped(cells_of)
    dropped(voted)
    weights, bias = np.zeros(width), 0.0
    if found.num_rows:
        y = found["y"].to_numpy()
        lists = found["column"].combine_chunks()
        column, value = lists.flatten().to_numpy(), found["value"].combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(pc.list_value_length(lists)))
        used, column = np.unique(column, return_inverse=True)
        own, pace = np.zeros(len(used)), np.full(len(used), 1e-8)
        bias_pace = 1e-8
        for _ in range(STEPS):  # full gradient, steps scaled by feature
            error = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * own[column], minlength=len(y)) + bias, -30, 30))) - y
            slope = np.bincount(column, weights=value * error[row], minlength=len(used)) / len(y) + DECAY * own
            pace, bias_pace = pace + slope**2, bias_pace + error.mean() ** 2
            own, bias = own - RATE * slope / np.sqrt(pace), bias - RATE * error.mean() / np.sqrt(bias_pace)
        weights[used] = own
    return Scorer(marks, weights, bias, accuracies)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, bad_score, kept) of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bad = scorer.scores(batch.column(1))
        return pa.RecordBatch.from_pydict({id: batch.column(0), "bad_score": pa.array(bad), "kept": bad < threshold})

    return map_chunks(docs.select(id, text), text, work, f"`{id}` {docs.schema[id].dataType.simpleString()}, bad_score double, kept boolean", CHUNK)


def keep(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the scorer doesn't call bad, with all their columns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer.scores(batch.column(text)) < threshold))

    return map_chunks(docs, text, work, docs.schema, CHUNK)
