"""Language identification by interpolated Kneser-Ney character models.

Texts are read as letters: lower case, every run of letters (and of the marks on them; marks alone are no word) between two boundary marks is a
word.  Letters are UTF-16 units: one beyond U+FFFF is a pair of them, so no two letters are taken for one.  A model per language
gives each letter's probability after up to three characters of its word.  Spark counts the 4-grams of all training
documents; the lower orders take continuation counts, i.e. the number of different characters before them, as
Kneser-Ney asks for.  All levels are interpolated with discounts estimated from the counts of counts.  Counts of counts,
discounts, context totals, probabilities and back-off weights are computed in Spark, over all grams: nothing is cut.

The model is a table of keys, a gram or a context of some order, each with its languages' values.  The most frequent
keys, as many as `stored` values allow, are broadcast as sorted 64-bit hash arrays that are searched by bisection.  The
rest stays a table: grams of a text that need a key which is not among the stored ones are joined to the whole table and
their part is added, so that results do not depend on `stored`.  A text's language is that of least cross-entropy per
letter.  A prediction is `rejected` if its cross-entropy is above the threshold of its language, a quantile of those that all
training documents of that language have in it; it is exact, from their order in sorted ranges.  All documents are scored once, for the
thresholds and for the predictions.

Defined cases: a null text or one without letters is `und` with score 0; null languages are not learned; without any
training document everything is `und`, and an empty table stays empty; ties go to the language that sorts first; repeated
rows each get a row; other columns, whatever their names, are not read.  A very long text is worked on alone.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_chunks, mixed, written
from .importance import ranked

ORDER, STORED = 4, 1 << 22
QUANTILE = 0.01
UNKNOWN = "und"
_BITS, _MARK = 16, 32
#: Cells of a table of grams by languages that a task works on at a time.
_CELLS = 1 << 22
_kinds: tuple[np.ndarray, np.ndarray] | None = None


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or marks on letters, and which are letters."""
    global _kinds
    if _kinds is None:
        kinds = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
        _kinds = np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])
    return _kinds


class Words:
    """The distinct words of some texts: symbols with a mark at either end, and how often each stands in each text."""

    def __init__(self, texts: pa.Array):
        values = [(x or "").lower() for x in texts.to_pylist()]
        self.n = len(values)
        encoded = [x.encode("utf-16-le", "replace") for x in values]
        units = np.frombuffer(b"\n\0".join([*encoded, b""]), dtype="<u2")
        first = np.concatenate([[0], np.cumsum([len(x) // 2 + 1 for x in encoded])])
        points = units.astype(np.uint32)
        high = np.flatnonzero((units & 0xFC00) == 0xD800)  # either unit of a pair stands for the pair's letter
        points[high] = points[high + 1] = 0x10000 + ((points[high] & 0x3FF) << 10) + (points[high + 1] & 0x3FF)
        inside, letter = (kind[points] for kind in letters())
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        before = np.concatenate([[0], np.cumsum(letter)])
        real = before[end] > before[start]
        start, end = start[real], end[real]
        text = np.searchsorted(first, start, "right") - 1
        size = end - start
        symbols = units.astype(np.uint64)
        # Equal words: by a hash of their symbols, summed over their places.
        power = np.cumprod(np.full(int(size.max()) if len(size) else 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
        offset = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(offset, size)
        value = (symbols[np.repeat(start, size) + place] + np.uint64(1)) * power[place]
        code = mixed(np.add.reduceat(value, offset)) if len(size) else np.empty(0, dtype=np.uint64)
        _, one, self.word = np.unique(code, return_index=True, return_inverse=True)
        self.text, self.size = text, size[one]
        length = self.size + 2
        self.first = np.cumsum(length) - length
        self.symbols = np.full(int(length.sum()), _MARK, dtype=np.uint64)
        own = np.arange(int(self.size.sum())) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.symbols[np.repeat(self.first + 1, self.size) + own] = symbols[np.repeat(start[one], self.size) + own]
        self.owner = np.repeat(np.arange(len(one)), length)

    def grams(self, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """(gram, word): at every place but the first mark, the `order` symbols that end there; before a word stand marks."""
        n = len(self.symbols)
        out, place = np.zeros(n, dtype=np.uint64), np.arange(n) - np.repeat(self.first, self.size + 2)
        for k in range(order - 1, -1, -1):
            shifted = np.full(n, _MARK, dtype=np.uint64)
            if k < n:
                shifted[k:] = self.symbols[: n - k]
            out = (out << np.uint64(_BITS)) | np.where(place >= k, shifted, np.uint64(_MARK))
        keep = place > 0
        return out[keep], self.owner[keep]


def training_rows(docs: DataFrame, id: str, lang: str, text: str, held_out) -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out).select(id, lang, text)


def gram_counts(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all training documents; a gram is four 16-bit symbols in a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        names = batch.column(0).dictionary_encode()
        label, names = np.asarray(names.indices), names.dictionary
        words = Words(batch.column(1))
        if not len(words.text):
            return None
        gram, owner = words.grams()
        pair, count = np.unique(label[words.text].astype(np.int64) * len(words.size) + words.word, return_counts=True)
        langs, found, total = [], [], []
        each = np.bincount(owner, minlength=len(words.size))
        begin = np.cumsum(each) - each
        for k in range(len(names)):
            own = (pair >= k * len(words.size)) & (pair < (k + 1) * len(words.size))
            word, times = pair[own] - k * len(words.size), count[own]
            at = np.repeat(begin[word] - (np.cumsum(each[word]) - each[word]), each[word]) + np.arange(int(each[word].sum()))
            keys, inverse = np.unique(gram[at], return_inverse=True)
            langs += [k] * len(keys)
            found.append(keys)
            total.append(np.bincount(inverse, weights=np.repeat(times, each[word]), minlength=len(keys)))
        return pa.RecordBatch.from_pydict({"lang": names.take(pa.array(langs, pa.int32())), "gram": pa.array(np.concatenate(found).view(np.int64)), "n": pa.array(np.concatenate(total).astype(np.int64))})

    return map_chunks(train.select(lang, text), text, work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model_table(train: DataFrame, text: str, lang: str) -> tuple[DataFrame, list[str], int]:
    """(table, languages, alphabet).  The table has a row a key: its level, gram, weight (how often it stands), langs (numbers) and values.

    Level 2 * order has the logarithms of the discounted shares of grams, level 2 * order + 1 those of the weight of the
    next lower order after contexts of order - 1 symbols.
    """
    level = written(gram_counts(train, text, lang), "grams")
    languages = sorted(r[0] for r in level.select("lang").distinct().collect())
    number = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)]), F.col("lang")) if languages else F.lit(0)
    parts, alphabet = [], 1
    for order in range(ORDER, 0, -1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = level.groupBy("lang").agg(F.when(once > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / (once + 2 * twice)))).otherwise(0.1).alias("discount"))
        own = level.select("lang", "gram", "n", F.shiftrightunsigned("gram", _BITS).alias("context"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discount), "lang")  # a row a language
        contexts = written(contexts, "contexts")
        shares = own.join(contexts, ["lang", "context"]).select(F.lit(2 * order).alias("level"), "gram", "n", number.alias("lang"), F.log(F.greatest(F.col("n") - F.col("discount"), F.lit(1e-9)) / F.col("total")).alias("value"))
        weights = contexts.select(F.lit(2 * order + 1).alias("level"), F.col("context").alias("gram"), F.col("total").alias("n"), number.alias("lang"), F.log(F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))
        parts += [shares, weights]
        if order == 1:
            alphabet = max(1, level.select("gram").distinct().count())
        else:
            mask = (1 << (_BITS * (order - 1))) - 1
            level = written(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n")), "grams")
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    pairs = F.sort_array(F.collect_list(F.struct("lang", F.col("value").cast("float").alias("value")))).alias("pairs")  # at most one a language
    table = written(rows.groupBy("level", "gram").agg(F.sum("n").alias("weight"), pairs).select("level", "gram", "weight", F.col("pairs.lang").alias("langs"), F.col("pairs.value").alias("values")), "model")
    return table, languages, alphabet


def hashed(gram: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    level = np.asarray(level, dtype=np.uint64)
    return mixed(gram * (np.uint64(2) * level + np.uint64(1)) + level)


class Arrays:
    """Keys as sorted hashes; key i's languages and values are in [first[i], first[i + 1])."""

    def __init__(self, rows: pa.Table):
        key = hashed(rows["gram"].to_numpy().view(np.uint64), rows["level"].to_numpy())
        sort = np.argsort(key)
        langs, values = (rows[c].combine_chunks().take(pa.array(sort)) if rows.num_rows else pa.array([], pa.list_(t)) for c, t in (("langs", pa.int32()), ("values", pa.float32())))
        self.key = key[sort]
        self.first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(langs), dtype=np.int64))])
        self.lang, self.value = langs.flatten().to_numpy().astype(np.int32), values.flatten().to_numpy().astype(np.float32)

    def looked_up(self, gram: np.ndarray, level: int, languages: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """(a row a gram and a column a language, which grams are known)."""
        out = np.full((len(gram), languages), missing)
        if not len(self.key):
            return out, np.zeros(len(gram), dtype=bool)
        wanted = hashed(gram, level)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        known = self.key[at] == wanted
        row, at = np.flatnonzero(known), at[known]
        count = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        out[np.repeat(row, count), self.lang[place]] = self.value[place]
        return out, known


class Model:
    """The table, its stored part as a broadcast, and whether there is more than that."""

    def __init__(self, train: DataFrame, text: str = "text", lang: str = "lang", stored: int = STORED):
        spark = train.sparkSession
        self.table, self.languages, self.alphabet = model_table(train, text, lang)
        # Keys by the logarithm of their weight: the frequent ones are stored, whole steps at a time.
        step = F.floor(F.log2("weight") * 8).cast("int")
        steps = self.table.groupBy(step.alias("step")).agg(F.sum(F.size("langs")).alias("n"), F.count("*").alias("keys")).orderBy(F.desc("step")).collect()
        least, total = None, 0
        for r in steps:
            if total + r.n > stored:
                break
            least, total = r.step, total + r.n
        self.whole = total == sum(r.n for r in steps)
        rows = self.table.where(step >= least) if least is not None else self.table.limit(0)
        self.arrays = spark.sparkContext.broadcast(Arrays(rows.select("level", "gram", "langs", "values").toArrow()))
        self.accept = np.full(len(self.languages), np.inf)


def log_probabilities(gram: np.ndarray, arrays: Arrays, languages: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(of the last symbol of each gram after the others, a column a language; whether all keys were known)."""
    out, whole = np.full((len(gram), languages), -np.log(alphabet + 1.0)), np.ones(len(gram), dtype=bool)
    for order in range(1, ORDER + 1):
        part = gram & np.uint64((1 << (_BITS * order)) - 1) if order < ORDER else gram
        weight, a = arrays.looked_up(part >> np.uint64(_BITS), 2 * order + 1, languages, 0.0)
        share, b = arrays.looked_up(part, 2 * order, languages, -np.inf)
        out = np.logaddexp(share, weight + out)
        whole &= a & b
    return out, whole


def totals(docs: DataFrame, model: Model, text: str, carried: list[str]) -> DataFrame:
    """The carried columns, size (symbols) and total (log-probability of the text, by language)."""
    languages, alphabet, whole, arrays = len(model.languages), model.alphabet, model.whole, model.arrays

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(len(carried)))
        size, total = np.zeros(words.n), np.zeros((words.n, languages))
        open_rows, open_grams, open_counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        if len(words.text):
            gram, owner = words.grams()
            length = np.bincount(owner)
            size = np.bincount(words.text, weights=length[words.word], minlength=words.n)
            begin = np.cumsum(length) - length
            grams, inverse = np.unique(gram, return_inverse=True)
            values = np.empty((len(grams), languages))
            known = np.ones(len(grams), dtype=bool)
            for i in range(0, len(grams), max(1, _CELLS // languages)):
                part = slice(i, i + max(1, _CELLS // languages))
                values[part], known[part] = log_probabilities(grams[part], arrays.value, languages, alphabet)
            if not whole:
                values[~known] = 0.0
                pair, times = np.unique(words.text.astype(np.int64) * len(length) + words.word, return_counts=True)
                doc, word = pair // len(length), pair % len(length)
                at = np.repeat(begin[word] - (np.cumsum(length[word]) - length[word]), length[word]) + np.arange(int(length[word].sum()))
                doc, times, at = np.repeat(doc, length[word]), np.repeat(times, length[word]), inverse[at]
                rest = ~known[at]
                cell, which = np.unique(doc[rest] * len(grams) + at[rest], return_inverse=True)
                open_rows.append(cell // len(grams))
                open_grams.append(grams[cell % len(grams)])
                open_counts.append(np.bincount(which, weights=times[rest], minlength=len(cell)).astype(np.int64))
            for k in range(languages):
                word = np.bincount(owner, weights=values[inverse, k])
                total[:, k] = np.bincount(words.text, weights=word[words.word], minlength=words.n)
        out = {name: batch.column(i) for i, name in enumerate(carried)} | {"size": pa.array(size), "total": pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), languages).cast(pa.list_(pa.float64()))}
        first = pa.array(np.searchsorted(np.concatenate(open_rows), np.arange(words.n + 1)).astype(np.int32))
        lists = {"grams": pa.array(np.concatenate(open_grams).view(np.int64)), "counts": pa.array(np.concatenate(open_counts))}
        return pa.RecordBatch.from_pydict(out | ({} if whole else {c: pa.ListArray.from_arrays(first, x) for c, x in lists.items()}))

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"{fields}, size double, total array<double>" + ", grams array<long>, counts array<long>" * (not whole)
    found = map_chunks(docs.select(*carried, text), text, work, schema)
    return found if whole else with_rest(found, model, carried)


def with_rest(found: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """Adds what the open grams of each row (grams, counts) have, by joins with the whole table."""
    languages, alphabet = len(model.languages), model.alphabet
    found = written(found.withColumn("_row", F.uuid()), "totals")
    rows = found.select("_row", F.explode(F.arrays_zip("grams", "counts")).alias("x")).select("_row", F.col("x.grams").alias("gram"), F.col("x.counts").alias("n"))
    open_grams = rows.select("gram").distinct()
    parts = []
    for order in range(1, ORDER + 1):
        part = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * order)) - 1)) if order < ORDER else F.col("gram")
        parts += [F.struct(F.lit(2 * order).alias("level"), part.alias("key")), F.struct(F.lit(2 * order + 1).alias("level"), F.shiftrightunsigned(part, _BITS).alias("key"))]
    keys = open_grams.select("gram", F.explode(F.array(*parts)).alias("k")).select("gram", "k.*")
    table = model.table.select("level", F.col("gram").alias("key"), "langs", "values")
    joined = keys.join(table, ["level", "key"]).groupBy("gram").agg(F.collect_list(F.struct("level", "key", "langs", "values")).alias("found"))  # at most eight a gram
    joined = open_grams.join(joined, "gram", "left")

    def value(batches):
        for batch in batches:
            lists, grams = batch.column(1), np.asarray(batch.column(0)).view(np.uint64)
            each = lists.flatten()
            known = Arrays(pa.table({"gram": pc.struct_field(each, "key"), "level": pc.struct_field(each, "level"), "langs": pc.struct_field(each, "langs"), "values": pc.struct_field(each, "values")}).filter(one_of_each(each)))
            out, _ = log_probabilities(grams, known, languages, alphabet)
            yield pa.RecordBatch.from_pydict({"gram": batch.column(0), "values": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), languages).cast(pa.list_(pa.float64()))})

    priced = written(joined.mapInArrow(value, "gram long, values array<double>"), "priced")
    more = rows.join(priced, "gram").groupBy("_row").agg(*[F.sum(F.col("n") * F.get("values", F.lit(k))).alias(f"_{k}") for k in range(languages)])
    total = F.array(*[F.get("total", F.lit(k)) + F.coalesce(f"_{k}", F.lit(0.0)) for k in range(languages)])
    return found.join(more, "_row", "left").select(*carried, "size", total.alias("total"))


def one_of_each(keys: pa.StructArray) -> pa.Array:
    """Which rows are the first with their level and key."""
    pair = np.stack([np.asarray(pc.struct_field(keys, "level")).astype(np.int64), np.asarray(pc.struct_field(keys, "key"))], axis=1)
    first = np.zeros(len(pair), dtype=bool)
    if len(pair):
        first[np.unique(pair, axis=0, return_index=True)[1]] = True
    return pa.array(first)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", stored: int = STORED) -> Model | None:
    """The model of all training rows; None if they have no letter."""
    model = Model(train, text, lang, stored)
    return model if model.languages else None


def calibrate(model: Model, found: DataFrame, lang: str = "lang", quantile: float = QUANTILE) -> None:
    """model.accept: the cross-entropy, per language, that `quantile` of all its training documents (lang, own) exceed."""
    # The last column tells equal values apart, so that a range can end between them.
    rows = found.where("own IS NOT NULL").select(F.col(lang).alias("lang"), "own", F.monotonically_increasing_id().alias("row"))
    placed = written(ranked(rows, ["lang", "own", "row"], "number").select("lang", "own", "number"), "own")
    wanted = {}
    for name, first, n in placed.groupBy("lang").agg(F.min("number"), F.count("*")).collect():  # a row a language
        at = (n - 1) * (1 - quantile)
        wanted[name] = (first + int(at), first + min(int(at) + 1, n - 1), at - int(at))
    table = placed.sparkSession.createDataFrame(sorted({(x,) for low, high, _ in wanted.values() for x in (low, high)}), "number long")
    value = {r.number: r.own for r in placed.join(F.broadcast(table), "number").collect()}  # two a language at most
    dropped(placed)
    for name, (low, high, share) in wanted.items():
        model.accept[model.languages.index(name)] = value[low] + (value[high] - value[low]) * share


def scored(docs: DataFrame, model: Model, text: str, carried: list[str], lang: str | None = None) -> DataFrame:
    """The carried columns, lang_pred, score and entropy, and own: the cross-entropy in the row's own language, if `lang` (a carried column) has one."""
    names = model.languages

    def choose(batches):
        number = {name: k for k, name in enumerate(names)}
        for batch in batches:
            size = np.asarray(batch.column(len(carried)))
            value = -batch.column(len(carried) + 1).flatten().to_numpy().reshape(len(size), -1) / np.maximum(size, 1)[:, None]
            best, none = value.argmin(axis=1), size == 0
            least = value[np.arange(len(best)), best]
            score = 1 / np.exp((least[:, None] - value) * np.minimum(size, 32)[:, None]).sum(axis=1)
            out = {name: batch.column(i) for i, name in enumerate(carried)}
            out |= {"lang_pred": pa.array([UNKNOWN if z else names[k] for k, z in zip(best.tolist(), none.tolist())], pa.string()), "score": pa.array(np.where(none, 0.0, score)), "entropy": pa.array(least, mask=none)}
            if lang is not None:
                own = np.array([number.get(x, -1) for x in batch.column(carried.index(lang)).to_pylist()], dtype=np.int64)
                out["own"] = pa.array(value[np.arange(len(own)), own], mask=none | (own < 0))
            yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return totals(docs, model, text, carried).mapInArrow(choose, f"{fields}, lang_pred string, score double, entropy double" + ", own double" * (lang is not None))


def judged(found: DataFrame, model: Model) -> DataFrame:
    """Adds rejected: no letter, or an entropy above the threshold of the predicted language."""
    table = found.sparkSession.createDataFrame([(k, float(x)) for k, x in zip(model.languages, model.accept)], "lang_pred string, accept double")
    rejected = (F.col("entropy").isNull() | F.coalesce(F.col("entropy") > F.col("accept"), F.lit(False))).alias("rejected")
    return found.join(F.broadcast(table), "lang_pred", "left").select(*[F.col(f"`{c}`") for c in found.columns], rejected)  # a row a language


def predict(docs: DataFrame, model: Model | None, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score (the probability of the language among those learned, at 32 letters at most), entropy and rejected."""
    if model is None:
        return docs.select(*carried, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    return judged(scored(docs, model, text, list(carried)), model)


def identify(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text", lang: str = "lang", stored: int = STORED) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all."""
    rows = docs.select(id, text, F.when(~held_out, F.col(lang)).alias(lang), held_out.alias("held_out"))  # held-out rows' languages are not read
    model = fit(training_rows(rows, id, lang, text, F.col("held_out")), text, lang, stored)
    if model is None:
        return predict(rows, None, text, (id, "held_out"))
    found = written(scored(rows, model, text, [id, "held_out", lang], lang), "scored")
    calibrate(model, found, lang)
    return judged(found.drop(lang, "own"), model)
