"""Main text of web pages: structure and nearest-URL page differencing.

A page is cut into lines, the texts of its blocks.  A line's place is known from the elements around it:
 - boilerplate: menus, headers and footers, sidebars, notices, adverts, forms, scripts, comments, hidden elements;
 - content: inside an article or main element, and none of the former inside it;
 - open: anything else.
No form hides an article or main below it, and a class, id or role word above one hides it only if the page has content elsewhere.
A form that holds most of the page's text, and prose, is a wrapper and its lines are open.
Class words mark boilerplate as a whole, or if all their parts do or are words of layout ("cookie-banner", not "cookie-recipe").

Pages of a host are sorted by URL path; each is aligned with the nearest page before and the nearest after it by the longest
common subsequence (LCS) of their lines, and lines that a pair shares are deleted: a template, not this page's text.  This is
done for every page.  A page's core is its content lines, or its open lines if it has none, or else all.  Pages in a row with the same
core count as one, and a neighbour that leaves a page no line of its core is a copy, not a template; the next one on its side is
taken, as far as the host goes.  If the two sides together leave no line of it, only the side that shares fewer of them counts (of equal
ones that with the earlier lines): the other is nearly a copy.  A page without content lines is aligned with the others' lines outside content.

The marks then check what differencing left, as menus, adverts and footers are often drawn per page and articles quote one another:
 - without content lines, the open lines left are the text;
 - else lines outside content go, and deleted lines of an article come back if it has a line of its own; an article that
   neighbours share as a whole stays deleted if the page has another one of its own (a teaser), and so do deleted lines that are in
   main but in no article of a page that has an article.  If no article has a line of its own, all come back.

Pages are read twice, for the hashes of their lines and for their texts, and must be the same either time; a page is parsed in time that grows
with its size.  Pages exchange hashes of lines alone.  The sort is on keys and dealt by range, so a host that holds a third of all pages is
spread over many tasks; a task aligns the pages of an Arrow batch, and those that met only copies there ask for pages further on, by consecutive
numbers.  The alignment keeps two rows of the LCS table at a time, as bits.

Defined cases: null html is empty, an empty page has an empty text; a page without a host forms a host of its own
(empty) with others like it; equal URLs are ordered by a hash of id, URL and html; repeated rows get a row each and are
one page to their neighbours; a host whose pages are all copies keeps their content or open lines; an empty table stays empty; other columns are not read; a very long page is worked on alone.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as digest

from .common import dropped, map_chunks, written

#: Neighbours on either side that a page asks for at a time.
NEAR = 3
#: A form with at least this share of a page's text, and a line of so many words, is a wrapper.
WRAPPER_SHARE, PROSE_WORDS = 0.5, 10
# Elements of HTML by role.
_RAW = {*"script style noscript template textarea svg math iframe object canvas select title xmp".split()}
_BOILERPLATE = {*"nav footer aside form button menu dialog head header".split()}
_CONTENT = {"article", "main"}
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
_BLOCK = {*"address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()}
# What a start tag closes if it is open, and the elements that bound that, by HTML's rules for optional end tags.
_CLOSES_P = _BLOCK - {*"body caption head html legend option tbody td tfoot th thead title tr".split()}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
}
_BOUNDS_P = {*"button table td th caption html".split()}
# Words in class, id or role attributes that mark boilerplate; words of layout that may stand beside them in a compound; and those that mark it as a whole alone.
_MARKS = {
    *"ad ads adbox advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer header"
    " masthead menu modal nav navbar navigation newsletter pagination pager popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
}
_LAYOUT = {
    *"area article aside bar bars block body bottom box button buttons col column container content desktop entry fixed form global group icons inner item items left left link links list main mobile outer page panel"
    " post posts primary right row secondary section site sticky thread top unit widget widgets wrap wrapper slot".split()
}
_WHOLE = {*"side-bar form notice notices skip search complementary contentinfo".split()}
#: Elements on which an id is a place in the text (a heading's anchor), not a box.
_ANCHORED = {*"a h1 h2 h3 h4 h5 h6 p span b i em strong li dt section figure table td th tr code pre blockquote".split()}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_STEP = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PLAIN = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Roles of lines; while a page is read also: in an article below a marked element (or a line that only such a mark hides), and in a form.
BOILERPLATE, OPEN, CONTENT, SHADOW, FORM = 0, 1, 2, 3, 4


def is_mark(word: str) -> bool:
    if word in _MARKS or word in _WHOLE:
        return True
    parts = [x for x in re.split(r"[-_]+", word) if x and not x.isdigit()]
    return len(parts) > 1 and not _MARKS.isdisjoint(parts) and all(x in _MARKS or x in _LAYOUT for x in parts)


def marked(name: str, attributes: str, inside: bool) -> str:
    """"hidden" for an element that is not shown, "mark" if class, id or role has a word that marks boilerplate, else ""; inside content, a header is the text's own."""
    if not _PLAIN.search(attributes):
        return ""
    found = ""
    for attribute, a, b, c in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), html_lib.unescape(a or b or c).lower()
        if attribute == "hidden" or attribute == "aria-hidden" and value.strip() == "true" or attribute == "style" and _UNSEEN.search(value):
            return "hidden"
        if attribute in ("class", "role") or attribute == "id" and name not in _ANCHORED:
            if any(is_mark(word) and not (inside and "header" in re.split(r"[-_]+", word)) for word in value.split()):
                found = "mark"
    return found


class _Ends:
    """Where tags end: at the first > that no quoted value holds; a value opens only right after an equals sign."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
        self.plain = False  # once a tag has no such end, tags end at the next > there is

    def after(self, at: int) -> int:
        """The place after the tag whose name ends at `at`; -1 if no > follows."""
        if at > self.last:
            return -1
        k = at
        while not self.plain:
            step = _TAG_STEP.search(self.page, k)
            if step is None:
                self.plain = True
            elif not step[1]:
                return step.end()
            else:
                k = step.end() if self.quotes[step[1]] < step.end() else self.page.index(step[1], step.end()) + 1
        return self.page.index(">", at) + 1


class _Stack:
    """Open elements and, by name, their places."""

    def __init__(self):
        self.items: list[tuple[str, tuple]] = []
        self.places: dict[str, list[int]] = {}

    def top(self, names) -> int:
        """The innermost place of any of these elements, or -1."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def push(self, name: str, state: tuple) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        self.items.append((name, state))

    def cut(self, at: int) -> tuple:
        """Closes all elements from this place on; what held before the outermost of them."""
        state = self.items[at][1]
        for name, _ in self.items[at:]:
            self.places[name].pop()
        del self.items[at:]
        return state


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of each block of a page that has text, in page order."""
    return [(min(kind, CONTENT), x) for kind, x in kinds_of(page)]


def kinds_of(page: str | None) -> list[tuple[int, str]]:
    """As lines_of, but a line of content in the page's k-th article is of kind CONTENT + k (in main alone: CONTENT)."""
    page = page or ""
    out: list[tuple[int, int, int, str]] = []  # role, numbers of the form and the article, text
    stack, ends, pieces, blocks = _Stack(), _Ends(page), [], []
    state = (OPEN, "", 0, 0)  # role of lines here; what made it boilerplate ("mark", "form", or "" for good); the form; the outermost article
    at, forms, articles = 0, 0, 0

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append((state[0], state[2], state[3], text))

    def close(place: int) -> None:
        nonlocal state
        state = stack.cut(place)
        while blocks and blocks[-1] >= place:
            blocks.pop()

    while (i := page.find("<", at)) >= 0:
        tag = _TAG.match(page, i)
        if not tag:
            end = -1
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                end = end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?", "</"), i):
                end = page.find(">", i)
                end = end + 1 if end >= 0 else len(page)
            pieces.append(page[at : i if end >= 0 else i + 1])
            at = end if end >= 0 else i + 1
            continue
        end = ends.after(tag.end())
        if end < 0:  # no tag can end any more: the rest is text
            break
        pieces.append(page[at:i])
        at, name = end, tag[1].lower()
        closing, attributes = page[i + 1] == "/", page[tag.end() : end - 1]
        if name in _RAW:
            pieces.append(" ")
            if not closing and not (name in ("svg", "math") and attributes.endswith("/")):
                over = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I | re.A).search(page, at)
                at = over.end() if over else len(page)
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            pieces.append(" ")
        if closing:
            place = stack.top((name,))
            if place >= 0 and (name in _BLOCK or not blocks or place > blocks[-1]):  # an inline end tag closes no block
                close(place)
            continue
        if name in _CLOSES_P and (place := stack.top(("p",))) > stack.top(_BOUNDS_P):
            close(place)
        if name in _CLOSES and (place := stack.top(_CLOSES[name][0])) > stack.top(_CLOSES[name][1]):
            close(place)
        if name in _VOID:
            continue
        if name in _BLOCK:
            blocks.append(len(stack.items))
        stack.push(name, state)
        role, cause, form, article = state
        inside = role in (CONTENT, SHADOW)
        if name in ("html", "body"):
            continue
        mark = marked(name, attributes, inside)
        if name in _CONTENT and mark != "hidden":
            if role in (OPEN, FORM):
                role = CONTENT
            elif cause == "mark":
                role, cause = SHADOW, ""
            elif cause == "form":
                role, cause = CONTENT, ""
            if name == "article" and not article:
                article = articles = articles + 1
        elif mark == "hidden":
            role, cause = BOILERPLATE, ""
        elif role != BOILERPLATE:
            if name == "form":
                role, cause, forms = (BOILERPLATE, "", forms) if inside else (FORM, "form", forms + 1)
                form = forms if role == FORM else form
            elif mark:
                role, cause = BOILERPLATE, "" if inside else "mark"
            elif name in _BOILERPLATE and not (name == "header" and inside):
                role, cause = BOILERPLATE, ""
        state = (role, cause, form, article)
    pieces.append(page[at:])
    flush()
    has = {r for r, _, _, _ in out}
    weight, prose = {}, set()
    for r, f, _, x in out:
        if r == FORM:
            weight[f] = weight.get(f, 0) + len(x)
            if x.count(" ") + 1 >= PROSE_WORDS:
                prose.add(f)
    total = sum(len(x) for r, _, _, x in out if r in (OPEN, FORM))
    wrappers = {f for f in prose if weight[f] >= WRAPPER_SHARE * total}
    final = {SHADOW: BOILERPLATE if CONTENT in has else CONTENT}
    roles = (final.get(r, r) if r != FORM else OPEN if f in wrappers else BOILERPLATE for r, f, _, _ in out)
    return [(CONTENT + a if r == CONTENT else r, x) for r, (_, _, a, x) in zip(roles, out)]


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of an LCS of a with each beginning of b: a row of the table as bits, of which a zero is a step up."""
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        same = row & int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little")
        row = ((row + same) | (row - same)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), dtype=np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)]).astype(np.int32)


def aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's lines an LCS of a and b has: halves of a are aligned with the parts of b where their lengths add up best."""
    out, todo = np.zeros(len(a), dtype=bool), [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out[i] = True
            i, j = i + 1, j + 1
        while m > i and n > j and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out[m] = True
        if m - i == 1:
            out[i] = bool((b[j:n] == a[i]).any())
        elif m > i and n > j:
            half = (i + m) // 2
            cut = j + int(np.argmax(lengths(a[i:half], b[j:n]) + lengths(a[half:m][::-1], b[j:n][::-1])[::-1]))
            todo += [(i, half, j, cut), (half, m, cut, n)]
    return out


def shared(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of a page's lines an LCS with the other page's lines has.  Only lines that both have can match."""
    out = np.zeros(len(own), dtype=bool)
    both = np.isin(own, other)
    if both.any():
        out[both] = aligned(own[both], other[np.isin(other, own)])
    return out


def core(kinds: np.ndarray) -> np.ndarray:
    """Which lines a page stands on: its content, or else its open lines, or else all."""
    for of in (kinds >= CONTENT, kinds == OPEN):
        if of.any():
            return of
    return np.ones(len(kinds), dtype=bool)


class Page:
    """Kinds and hashes of a page's lines."""

    def __init__(self, kinds, hashes):
        self.kinds, self.hashes = np.asarray(kinds, dtype=np.int32), np.asarray(hashes, dtype=np.int64)
        self.core = core(self.kinds)

    def template(self, other: "Page") -> np.ndarray | None:
        """The lines that the other page shares; None if it is a copy: no line of the core is left.  A page without lines asks no further."""
        content = bool((self.kinds >= CONTENT).any())
        both = shared(self.hashes, other.hashes if content else other.hashes[other.kinds < CONTENT])
        return both if not len(both) or (self.core & ~both).any() else None


def kept(kinds: np.ndarray, deleted: np.ndarray) -> np.ndarray:
    """Which lines are the text, once differencing has deleted some: the check by marks."""
    content = kinds >= CONTENT
    if not content.any():
        return (kinds == OPEN) & ~deleted
    article = kinds > CONTENT
    if not article.any():
        return content
    own = np.unique(kinds[article & ~deleted])  # articles with a line of their own
    return (np.isin(kinds, own) if len(own) else article) | (kinds == CONTENT) & ~deleted


def hashed(lines: list[str]) -> list[int]:
    return [digest(x) - (1 << 63) for x in lines]


def outcome(kinds: np.ndarray, masks: list[np.ndarray]) -> tuple[list[bool], int, int]:
    """(which lines are kept, how many differencing deleted, how many of these the marks gave back)."""
    deleted, of = np.zeros(len(kinds), dtype=bool), core(kinds)
    for x in masks:
        deleted |= x
    if len(masks) > 1 and not (of & ~deleted).any():  # one of them is nearly a copy: the other's lines go
        deleted = min(masks, key=lambda x: (int((x & of).sum()), (~(x & of)).tobytes(), (~x).tobytes()))
    keep = kept(kinds, deleted)
    return keep.tolist(), int(deleted.sum()), int((deleted & keep).sum())


_LISTS = "kinds array<int>, hashes array<long>"
_OUTCOME = "keep array<boolean>, n_shared long, n_restored long"


def outcome_arrays(found: list) -> dict[str, pa.Array]:
    some = [x or (None, None, None) for x in found]
    return {"keep": pa.array([x[0] for x in some], pa.list_(pa.bool_())), "n_shared": pa.array([x[1] for x in some], pa.int64()), "n_restored": pa.array([x[2] for x in some], pa.int64())}


def compared(parsed: DataFrame) -> DataFrame:
    """The pages in the order of host and path, a row a page, each aligned with the others of its Arrow batch.

    place: number in its partition, the same for pages in a row with the same core; first, last: whether it is the run's.
    Either side has a mask, or no page to ask (done), or is asked at `edge`, the place of the batch's last run on that side.
    Pages with both sides done have their outcome.
    """

    def work(batches):
        count, seen = 0, None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            new = [k for k, x in enumerate(rows) if x != (rows[k - 1] if k else seen)]  # repeated rows follow one another
            if not new:
                continue
            seen, rows = rows[-1], [rows[k] for k in new]
            batch = batch.take(pa.array(new))
            hosts = [(x or "").partition("\x01")[0] for x in batch.column(1).to_pylist()]
            pages = [Page(k.values, h.values) for k, h in zip(batch.column(2), batch.column(3))]
            keys = [(host, x.hashes[x.core].tobytes()) for host, x in zip(hosts, pages)]
            first = [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]
            last = [*first[1:], True]
            starts = [k for k, x in enumerate(first) if x]
            ends = [k for k, x in enumerate(last) if x]
            run = np.cumsum(first) - 1
            out = {"place": (run + count + 1).tolist(), "first": first, "last": last, "done": [], "edge": [], "masks": [], "outcome": []}
            for k, page in enumerate(pages):
                masks, done = [], []
                for side, of in ((-1, ends), (1, starts)):
                    at, mask = int(run[k]) + side, None
                    while 0 <= at < len(of) and hosts[of[at]] == hosts[k] and mask is None:
                        mask = page.template(pages[of[at]])
                        at += side
                    masks.append(mask)
                    done.append(mask is not None or 0 <= at < len(of))  # or the host ends inside the batch
                whole = all(done)
                out["done"].append(done)
                out["edge"].append([count + 1, count + len(starts)])
                out["masks"].append([None if whole or x is None else x.tolist() for x in masks])
                out["outcome"].append(outcome(page.kinds, [x for x in masks if x is not None]) if whole else None)
            count += len(starts)
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column(0), "host": pa.array(hosts, pa.string()), "kinds": batch.column(2), "hashes": batch.column(3)}
                | {k: pa.array(out[k], t) for k, t in (("place", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("done", pa.list_(pa.bool_())), ("edge", pa.list_(pa.int64())), ("masks", pa.list_(pa.list_(pa.bool_()))))}
                | outcome_arrays(out["outcome"])
            )

    schema = f"row long, host string, {_LISTS}, place long, first boolean, last boolean, done array<boolean>, edge array<long>, masks array<array<boolean>>, {_OUTCOME}"
    return parsed.repartitionByRange("path", "row").sortWithinPartitions("path", "row").mapInArrow(work, schema).withColumn("part", F.spark_partition_id())


def differenced(parsed: DataFrame, near: int = NEAR) -> DataFrame:
    """(row, keep, n_shared, n_restored) of each page of (row, path, kinds, hashes): which of its lines are the text."""
    spark = parsed.sparkSession
    placed = written(compared(parsed), "places")
    before, total = [], 0
    for k, n in sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.max("place")).collect()):  # a row a range
        before.append((k, total))
        total += n
    table = spark.createDataFrame(before, "part int, before long")
    numbered = placed.join(F.broadcast(table), "part")
    left = numbered.where("keep IS NULL").select("row", "host", "before", "edge", "done", "masks", *("kinds", "hashes"))
    done = placed.where("keep IS NOT NULL").select("row", "keep", "n_shared", "n_restored")

    # Pages that met only copies up to an edge of their batch ask for the lines of pages further on, a few at a time.
    number = F.col("before") + F.col("place")
    lenders = reduce(DataFrame.union, [numbered.where(end).select("host", F.lit(side).alias("side"), number.alias("at"), "kinds", "hashes") for end, side in (("last", -1), ("first", 1))])
    sides = [F.struct(F.lit(s).alias("side"), (F.col("before") + F.get("edge", F.lit(k)) + s).alias("at"), F.get("done", F.lit(k)).alias("done")) for k, s in ((0, -1), (1, 1))]
    asking = left.select("row", "host", F.explode(F.array(*sides)).alias("x")).where("not x.done").select("row", "host", "x.side", "x.at")
    asker = left.select("row", "kinds", "hashes")
    answers, many = [], near

    def ask(batches):
        for batch in batches:
            out = []
            for kinds, hashes, others in zip(batch.column(4), batch.column(5), batch.column(6).to_pylist()):
                page = Page(kinds.values, hashes.values)
                found = next((x for x in (page.template(Page(o["kinds"], o["hashes"])) for o in others) if x is not None), None)
                out.append((len(others), None if found is None else found.tolist()))
            yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(("row", "host", "side", "at"))} | {"got": pa.array([x[0] for x in out], pa.int32()), "shared": pa.array([x[1] for x in out], pa.list_(pa.bool_()))})

    while True:
        steps = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("far")
        asked = asking.select("row", "host", "side", F.col("at").alias("begin"), steps).withColumn("at", F.col("begin") + F.col("side") * F.col("far"))
        others = asked.join(lenders, ["host", "side", "at"]).groupBy("row", "host", "side", "begin").agg(F.sort_array(F.collect_list(F.struct("far", "kinds", "hashes"))).alias("others"))
        found = others.join(asker, "row").select("row", "host", "side", "begin", "kinds", "hashes", "others")
        found = written(found.mapInArrow(ask, "row long, host string, side int, at long, got int, shared array<boolean>"), "masks")
        answers.append(found)
        asking = found.where(f"shared IS NULL AND got = {many}").select("row", "host", "side", (F.col("at") + F.col("side") * many).alias("at"))
        if asking.isEmpty():
            break
        many = min(2 * many, 16)

    def close(batches):
        for batch in batches:
            found = []
            for kinds, masks, more in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found.append(outcome(np.asarray(kinds.values, dtype=np.int32), [np.array(x, dtype=bool) for x in [*masks, *(more or [])] if x is not None]))
            yield pa.RecordBatch.from_pydict({"row": batch.column(0)} | outcome_arrays(found))

    answered = reduce(DataFrame.union, answers).where("shared IS NOT NULL").groupBy("row").agg(F.collect_list("shared").alias("more"))  # two a page at most
    rest = left.select("row", "kinds", "masks").join(answered, "row", "left").select("row", "kinds", "masks", "more")
    return done.union(rest.mapInArrow(close, f"row long, {_OUTCOME}"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", id: str = "page_id", near: int = NEAR) -> DataFrame:
    """(id, url, text, n_lines, n_deleted, n_shared, n_restored): the main text, the number of the page's lines and of those
    that are not in the text, of those that differencing deleted, and of those among them that the marks gave back."""
    kind = pages.schema[id].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    row = F.xxhash64(id, url, html).alias("row")

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [kinds_of(page) for page in batch.column(2).to_pylist()]
        kinds, hashes = [[k for k, _ in x] for x in found], [hashed([t for _, t in x]) for x in found]
        return pa.RecordBatch.from_pydict({"row": batch.column(0), "path": batch.column(1), "kinds": pa.array(kinds, pa.list_(pa.int32())), "hashes": pa.array(hashes, pa.list_(pa.int64()))})

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The lines that may be the text; the others are null."""
        lines = []
        for page in batch.column(3).to_pylist():
            found = kinds_of(page)
            may = core(np.array([k for k, _ in found], dtype=np.int32)) & np.array([k != BOILERPLATE for k, _ in found], dtype=bool)
            lines.append([x if m else None for (_, x), m in zip(found, may.tolist())])
        return pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(("row", "id", "url"))} | {"lines": pa.array(lines, pa.list_(pa.string()))})

    parsed = written(map_chunks(pages.select(row, F.concat_ws("\x01", host, path).alias("path"), F.col(html).alias("html")), "html", parse, f"row long, path string, {_LISTS}"), "lines")
    decided = differenced(parsed, near)
    dropped(parsed)
    whole = map_chunks(pages.select(row, F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")), "html", texts, f"row long, id {kind}, url string, lines array<string>")
    # array_join passes nulls over.
    text = F.array_join(F.transform("lines", lambda x, i: F.when(F.get("keep", i), x)), " ").alias("text")
    n_kept = F.size(F.filter("keep", lambda x: x))
    n_lines = F.size("keep")
    numbers = [n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_deleted"), "n_shared", "n_restored"]
    return whole.join(decided, "row").select(F.col("id").alias(id), F.col("url").alias(url), text, *numbers)
