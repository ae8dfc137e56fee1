"""HTML extraction: structure first, and the suffixes of each host's token streams for the rest.

A page is read into blocks. Scripts, styles, menus, headers, footers, asides, forms,
adverts, notices and comments are told by element, role or class name; headings,
paragraphs, list items and the like inside an article are its text. What structure
leaves open (loose text in ``div``s, pages without an article) is decided by the host:
the token streams of all its pages, prose and dropped blocks included, are named by prefix
doubling, so that two suffixes have the same name when they begin with the same ``DEPTH``
tokens, or, at the start of a shorter block outside prose, with the same whole block. Names
are sorted, and stand in for the order of the suffixes, as only equality decides. A name that
occurs in two distinct bodies is a repeated substring; overlapping ones join to maximal ones.
Open text they cover is boilerplate and goes, unique runs stay. The streams of every host and
every page are built, whether its structure leaves anything open or not, and each page is
returned with the places of its stream that its host repeats.

A body is what a page holds outside dropped blocks, so a page under two addresses
is one body and no evidence against itself. Open text that repeats another page's prose is a teaser
and goes where the page has prose of its own; where it has none, the open text may be the
article itself, and only repeats outside prose count. Prose in an article is never cut,
however often it is copied: there the repeats are counted, no more.

Names are exchanged as sorted runs by ranges of their values, in ``TURNS`` turns. Pages of
one html and host are one in a run, and a name that a run alone shows to repeat leaves it with
at most four places, so neither a host with a third of all pages nor a line in all of them is
much heavier for any task. Answers go back to the runs they came from.

Defined cases: null html is an empty page with empty text; a null or odd address
belongs to the host ``''``; repeated rows are one page to the suffixes and each
returned; ties cannot arise; an empty table gives no rows; only page_id, url and html
are read, so further columns cannot clash.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import Prefix, mix64, slices, stored

#: Tokens (block ends count as one) from which a repeated substring is boilerplate; shorter
#: blocks count if they repeat whole.
DEPTH = 12
#: Names are exchanged in so many turns, a share of their values in each, so that disk holds one share at a time.
TURNS = 2
#: Bytes of html whose names a worker sorts at once.
RUN = 1 << 23
_U64 = np.uint64
_STEP, _BLOCK_END = _U64(0x9E3779B97F4A7C15), _U64(0xD1B54A32D192ED03)
SENT = pa.schema(
    [("range", pa.int32()), ("run", pa.int64()), *[(c, pa.binary()) for c in ("names", "at", "size", "first", "clear", "bodies", "uids")]]
)
FOUND = pa.schema([("run", pa.int64()), *[(c, pa.binary()) for c in ("at", "size", "first", "uids")]])
SENT_DDL = "range int, run bigint, names binary, at binary, size binary, first binary, clear binary, bodies binary, uids binary"
FOUND_DDL = "run bigint, at binary, size binary, first binary, uids binary"

# Element names and words of class names by their role in a page.
RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|object|canvas|audio|video|select|button"
BOILER = frozenset("nav footer aside form header dialog menu menuitem fieldset search".split())
MAIN = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption article main summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLASS_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts banner promo "
    "promotion sponsor sponsored cookie cookies consent notice alert gdpr newsletter subscribe subscription share "
    "sharing social comment comments disqus replies related recommended breadcrumb breadcrumbs widget popup modal "
    "overlay login signup signin form search pagination pager toolbar copyright legal disclaimer skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar note".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>script|style|title|textarea)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<dead>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=dead)\s*>)?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")
ROLE_MAIN = re.compile(r"role\s*=\s*[\"']?main\b")
HIDEABLE = frozenset("span a label small".split())
#: What an opening element closes, and where the search for it ends.
CLOSED = {
    **{name: frozenset([name]) for name in ("li", "tr", "td", "th")}, **{name: frozenset(["dd", "dt"]) for name in ("dd", "dt")},
    **{name: frozenset(["p"]) for name in CLOSES_P},
}
KEPT_OPEN = frozenset("ul ol dl table div article main section body nav aside footer header form blockquote".split())

CLEAR, OPEN, DROPPED = 0, 1, 2


# --- structure -----------------------------------------------------------------------


def _boilerplate(name: str, attrs: str) -> bool:
    if name in BOILER:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and not CLASS_WORDS.isdisjoint(WORDS.findall(value)):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, state) of each block in page order; state is CLEAR, OPEN or DROPPED."""
    out: list[tuple[str, bool, bool, bool]] = []
    # element name, inside boilerplate, inside an article, inside an article's own header
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    buffer: list[str] = []
    state = (False, False, False)
    has_main = False

    def flush() -> None:
        text = "".join(buffer)
        buffer.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            out.append((text, *state))

    def begin(text: str) -> None:
        nonlocal state
        for e in reversed(stack):
            if e[0] not in INLINE:
                break
        _, dropped, inside, head = stack[-1]
        state = (dropped and not (head and e[0] in HEADINGS), inside, e[0] in PROSE)
        buffer.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        start, stop = m.span()
        if start > at:
            text = page[at:start]
            if buffer:
                buffer.append(text)
            elif not text.isspace():
                begin(text)
        at = stop
        name, end, attrs = m.group("name", "end", "attrs")
        if not name:
            continue
        name = name.lower()
        if name == "br":
            if buffer:
                buffer.append(" ")
            continue
        if name in INLINE:
            if not end and name not in VOID:
                hidden = name in HIDEABLE and _boilerplate(name, attrs)
                _, dropped, inside, head = stack[-1]
                stack.append((name, dropped or hidden, inside, head))
                if hidden and buffer:
                    flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if buffer and stack[k][1] != stack[k - 1][1]:
                            flush()
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            continue
        if buffer:
            flush()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        ends = CLOSED.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in KEPT_OPEN:
                    break
        _, dropped, inside, head = stack[-1]
        own = _boilerplate(name, attrs)
        main = (name in MAIN and not own and not dropped) or bool(attrs and ROLE_MAIN.search(attrs.lower()))
        has_main |= main
        if main:
            dropped = False
        stack.append((name, dropped or own, inside or main, head or (name == "header" and inside and not dropped)))
    if at < len(page):
        text = page[at:]
        if buffer:
            buffer.append(text)
        elif not text.isspace():
            begin(text)
    if buffer:
        flush()
    result = []
    for text, dropped, inside, prose in out:
        if dropped or (has_main and not inside):
            result.append((text, DROPPED))
        else:
            result.append((text, CLEAR if inside and prose else OPEN))
    return result


HOST = r"[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str | None) -> str:
    m = re.match(HOST, (url or "").strip().lower())
    return m.group(1) if m else ""


def host(url: Column) -> Column:
    """``host_of`` of a column."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*" + HOST, 1), F.lit(""))


# --- host streams --------------------------------------------------------------------


def in_stream(page: list[tuple[str, int]]) -> list[int]:
    """The blocks of a page in the order of its stream: clear prose comes last."""
    return sorted(range(len(page)), key=lambda k: page[k][1] == CLEAR)


def stream(page: list[tuple[str, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens of all blocks, block ends included, and (block, token) of each place."""
    tokens, places = [], []
    for k in in_stream(page):
        for j, token in enumerate([*page[k][0].split(), "\n"]):
            tokens.append(token)
            places.append((k, j))
    return tokens, places


def body_of(page: list[tuple[str, int]]) -> int:
    """Fingerprint of what a page holds outside dropped blocks."""
    import xxhash

    return xxhash.xxh64_intdigest("\n".join(t for t, state in page if state != DROPPED).encode("utf-8", "surrogatepass")) - (1 << 63)


def suffix_names(tokens: list[str] | np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Names of the suffixes at depth ``depth``, doubled from single tokens or from their names."""
    name = tokens if isinstance(tokens, np.ndarray) else token_names(tokens)[0][::2]
    length = 1
    with np.errstate(over="ignore"):
        while length < depth:
            step = min(length, depth - length)
            if len(name) <= step:
                return np.zeros(0, _U64)
            name = mix64(name[: len(name) - step] * _STEP + name[step:])
            length += step
    return name


def token_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens of some blocks, block ends included, and the place after each block's end."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    stop = np.flatnonzero((data == 0x20) | (data == 0x0A))  # words of a block are parted by one space
    start = np.concatenate([[0], stop[:-1] + 1])
    ends = np.flatnonzero(data[stop] == 0x0A) + 1
    ends += np.arange(1, len(ends) + 1)
    names = np.empty(len(stop) + len(ends), _U64)
    names[ends - 1] = _BLOCK_END
    word = np.ones(len(names), dtype=bool)
    word[ends - 1] = False
    cuts = np.searchsorted(start, np.arange(1 << 20, len(data), 1 << 20)).tolist()
    names[word] = np.concatenate(
        [Prefix(data[start[lo] : stop[hi - 1]]).of(start[lo:hi] - start[lo], stop[lo:hi] - start[lo]) for lo, hi in zip([0, *cuts], [*cuts, len(start)]) if hi > lo]
    )
    return names, ends


def repeatable(names: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, name) of every substring that would be boilerplate if it repeats.

    A substring stays inside its block, so what follows a block never decides about it.
    Short blocks count as a whole, outside clear prose.
    """
    sizes = np.diff(ends, prepend=0)
    left = np.repeat(ends, sizes) - np.arange(len(names))
    long = np.flatnonzero(left >= DEPTH)
    starts, lengths, found = [long], [np.full(len(long), DEPTH)], [suffix_names(names)[long]]
    with np.errstate(over="ignore"):
        for size in range(2, DEPTH):
            at = (ends - size)[(sizes == size) & (states != CLEAR)]
            if len(at):
                name = suffix_names(names[at[:, None] + np.arange(size)].ravel(), size)[::size]
                starts.append(at)
                lengths.append(np.full(len(at), size))
                found.append(mix64(name + _U64(size)))
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)


def packed(values: np.ndarray) -> bytes:
    """Words in the least number of bytes that holds all of them, which comes first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype(_U64).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return out.view(_U64).ravel()


def _repeated(name: np.ndarray, body: np.ndarray, inside: np.ndarray, any_prose: np.ndarray) -> np.ndarray:
    """Which of some sorted names repeat: in two bodies, or outside clear prose where the page has none."""
    group = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    span = np.diff(group, append=len(name))
    least, most = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    anywhere = np.minimum.reduceat(body, group) < np.maximum.reduceat(body, group)
    outside = np.minimum.reduceat(np.where(inside, least, body), group) < np.maximum.reduceat(np.where(inside, most, body), group)
    return np.where(any_prose, np.repeat(anywhere, span), np.repeat(outside, span))


def _needed(name: np.ndarray, body: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Of sorted names the places that show each one's least and greatest body, in prose and outside."""
    same = name[1:] == name[:-1]
    alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    rest = np.flatnonzero(~alone)
    rest = rest[np.lexsort((body[rest], inside[rest], name[rest]))]
    new = (name[rest[1:]] != name[rest[:-1]]) | (inside[rest[1:]] != inside[rest[:-1]])
    alone[rest[np.concatenate([[True], new])[: len(rest)] | np.concatenate([new, [True]])[: len(rest)]]] = True
    return alone


def _answer(run: int, at: np.ndarray, size: np.ndarray, slot: np.ndarray, first: np.ndarray, uids: np.ndarray) -> dict:
    """A row of ``FOUND``: places of a run, and where the streams of their pages begin."""
    order, some = np.argsort(at), np.unique(slot)
    gaps = np.diff(at[order].astype(np.int64), prepend=0)
    return {"run": run, "at": packed(gaps), "size": packed(size[order]), "first": packed(first[some]), "uids": uids[some].tobytes()}


def _send(turn: int, ranges: int):
    """Sorted names of one turn's share of all values, for each range of them and each run of pages.

    ``at`` are their places in the run, ``size`` their lengths; ``first`` is the place of each
    page's stream, ``clear`` one more than that of its clear prose, or 0. What a run alone shows to
    repeat is answered there: of such a name no more than four places are sent, however many pages hold it.
    """
    edges = np.array([(k << 64) // (TURNS * ranges) for k in range(turn * ranges, min((turn + 1) * ranges + 1, TURNS * ranges))], dtype=_U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "html", RUN)):
            uids, seen = batch.column("uid").to_numpy(), set()
            texts, states, owner, bodies = [], [], [], np.zeros(batch.num_rows, np.int64)
            for i, (uid, html) in enumerate(zip(uids.tolist(), batch.column("html").to_pylist())):
                if uid in seen:
                    continue
                seen.add(uid)
                page = blocks(html or "")
                bodies[i] = body_of(page)
                for k in in_stream(page):
                    texts.append(page[k][0])
                    states.append(page[k][1])
                    owner.append(i)
            if not texts:
                continue
            tokens, ends = token_names(texts)
            states, owner = np.array(states), np.array(owner)
            at, size, name = repeatable(tokens, ends, states)
            page = np.repeat(owner, np.diff(ends, prepend=0))[at]
            with np.errstate(over="ignore"):
                name = mix64(name + mix64(batch.column("host").to_numpy().view(_U64))[page])
            starts = np.concatenate([[0], ends[:-1]])
            first, clear = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held, head = np.unique(owner, return_index=True)
            first[held] = starts[head]
            prose = np.flatnonzero(states == CLEAR)
            held, head = np.unique(owner[prose], return_index=True)
            clear[held] = starts[prose[head]] + 1
            own = np.flatnonzero((name >= edges[0]) & (name < edges[-1]) if turn < TURNS - 1 else name >= edges[0])
            if not len(own):
                continue
            own = own[np.argsort(name[own])]
            at, size, name, page = at[own], size[own], name[own], page[own]
            body, any_prose = bodies[page], clear[page] > 0
            inside = any_prose & (at + 1 >= clear[page])
            twice = _repeated(name, body, inside, any_prose)
            mark, rows = task << 32 | number, []
            if twice.any():
                known = _answer(mark, at[twice], size[twice], page[twice], first, uids)
                rows.append(known | {"range": number % ranges, "names": b"", "clear": b"", "bodies": b""})
            ask = _needed(name, body, inside) | ~twice
            at, size, name, page = at[ask], size[ask], name[ask], page[ask]
            cuts = np.searchsorted(name, edges[1:ranges]).tolist()
            for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(name)])):
                if hi > lo:
                    some = np.unique(page[lo:hi])
                    rows.append(
                        {"range": k, "run": mark, "names": packed(np.diff(name[lo:hi], prepend=edges[k])), "at": packed(at[lo:hi]), "size": packed(size[lo:hi]),
                         "first": packed(first[some]), "clear": packed(clear[some]), "bodies": bodies[some].tobytes(), "uids": uids[some].tobytes()}
                    )
            yield pa.RecordBatch.from_pylist(rows, SENT)

    return run


def _count(turn: int, ranges: int):
    """Of the names of a range those that repeat, back to their runs."""

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        out = [{c: r[c] for c in FOUND.names} for r in rows if not r["names"]]
        rows = [r for r in rows if r["names"]]
        names, bodies, inside, any_prose = [], [], [], []
        for r in rows:
            base = _U64(((turn * ranges + r["range"]) << 64) // (TURNS * ranges))
            with np.errstate(over="ignore"):
                names.append(np.cumsum(unpacked(r["names"]), dtype=_U64) + base)
            r["at"], r["first"] = unpacked(r["at"]).astype(np.int64), unpacked(r["first"]).astype(np.int64)
            r["slot"] = np.searchsorted(r["first"], r["at"], side="right") - 1
            clear = unpacked(r["clear"]).astype(np.int64)[r["slot"]]
            bodies.append(np.frombuffer(r["bodies"], np.int64)[r["slot"]])
            any_prose.append(clear > 0)
            inside.append((clear > 0) & (r["at"] + 1 >= clear))
        if rows:
            name, body, inside, any_prose = (np.concatenate(x) for x in (names, bodies, inside, any_prose))
            order = np.argsort(name)
            twice = np.zeros(len(name), dtype=bool)
            twice[order] = _repeated(name[order], body[order], inside[order], any_prose[order])
            for r, hit in zip(rows, np.split(twice, np.cumsum([len(x) for x in names])[:-1])):
                if hit.any():
                    uids = np.frombuffer(r["uids"], np.int64)
                    out.append(_answer(r["run"], r["at"][hit], unpacked(r["size"])[hit], r["slot"][hit], r["first"], uids))
        return pa.Table.from_pylist(out, FOUND)

    return run


def _join_up(part: pa.Table) -> pa.Table:
    """(uid, starts, sizes): overlapping substrings of a run's pages joined to maximal ones."""
    rows = part.to_pylist()
    at = np.concatenate([np.cumsum(unpacked(r["at"]), dtype=_U64) for r in rows]).astype(np.int64)
    end = at + np.concatenate([unpacked(r["size"]) for r in rows]).astype(np.int64)
    first, which = np.unique(np.concatenate([unpacked(r["first"]) for r in rows]).astype(np.int64), return_index=True)
    uid = np.concatenate([np.frombuffer(r["uids"], np.int64) for r in rows])[which]
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], at[1:] >= end[:-1]]))
    start, end = at[new], end[np.append(new[1:], len(at)) - 1]
    slot = np.searchsorted(first, start, side="right") - 1
    page, bounds = np.unique(slot, return_index=True)
    bounds = pa.array(np.append(bounds, len(slot)).astype(np.int32))
    return pa.table(
        {
            "uid": pa.array(uid[page]), "starts": pa.ListArray.from_arrays(bounds, pa.array((start - first[slot]).astype(np.int32))),
            "sizes": pa.ListArray.from_arrays(bounds, pa.array((end - start).astype(np.int32))),
        }
    )


def _turn(pages: DataFrame, turn: int, ranges: int) -> DataFrame:
    """The repeats of one turn. What it exchanged is collected once its frames are gone, so the driver is asked again."""
    out = stored(
        pages.select("uid", "host", "html").mapInArrow(_send(turn, ranges), SENT_DDL)
        .groupBy("range").applyInArrow(_count(turn, ranges), FOUND_DDL)
        .groupBy("run").applyInArrow(_join_up, "uid bigint, starts array<int>, sizes array<int>"),
        "repeats",
    )
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def repeated_places(pages: DataFrame) -> DataFrame:
    """(uid, starts, sizes): the substrings of every page's stream that its host repeats; they may overlap."""
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = functools.reduce(DataFrame.unionByName, [_turn(pages, turn, ranges) for turn in range(TURNS)])
    return found.groupBy("uid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes")])


def unique_text(page: list[tuple[str, int]], repeats: list[tuple[int, int]]) -> str:
    """Clear blocks, and the runs of open blocks that no repeated substring covers."""
    tokens, places = stream(page)
    covered = np.zeros(len(tokens), dtype=bool)
    for start, size in repeats:
        covered[start : start + size] = True
    gone = {place for place, c in zip(places, covered) if c}
    out = []
    for k, (text, state) in enumerate(page):
        if state == CLEAR:
            out.append(text)
        elif state == OPEN:
            left = " ".join(t for j, t in enumerate(text.split()) if (k, j) not in gone)
            if left:
                out.append(left)
    return "\n".join(out)


# --- operator ------------------------------------------------------------------------


def covered(repeats: list[tuple[int, int]]) -> int:
    """How many places some runs cover."""
    total = end = 0
    for start, size in sorted(repeats):
        total += max(0, start + size - max(start, end))
        end = max(end, start + size)
    return total


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_repeated) of every page.

    ``n_repeated`` counts the places of a page's stream that lie in what its host repeats;
    where such places are open text, ``text`` goes without them.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = pages.withColumn("host", F.xxhash64(host(F.col("url")))).withColumn("uid", F.xxhash64("host", "html"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Text of the pages without open text, html of the others."""
        for batch in slices(batches, "html"):
            texts, rest = [], []
            for html in batch.column("html").to_pylist():
                found = blocks(html or "")
                undecided = any(state == OPEN for _, state in found)
                texts.append(None if undecided else "\n".join(text for text, state in found if state == CLEAR))
                rest.append(html if undecided else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "uid")), pa.array(texts, pa.string()), pa.array(rest, pa.string())],
                names=["page_id", "url", "uid", "text", "html"],
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text"), "html"):
            texts, counts = [], []
            for text, html, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("text", "html", "starts", "sizes"))):
                repeats = list(zip(starts or [], sizes or []))
                texts.append(text if html is None else unique_text(blocks(html), repeats))
                counts.append(covered(repeats))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                names=["page_id", "url", "text", "n_repeated"],
            )

    repeats = repeated_places(keyed)
    whole = keyed.select("page_id", "url", "uid", "html").mapInArrow(read, f"page_id {kind}, url string, uid bigint, text string, html string")
    return whole.join(repeats, "uid", "left").drop("uid").mapInArrow(settle, f"page_id {kind}, url string, text string, n_repeated bigint")


def query(spark, folder: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_repeated")
