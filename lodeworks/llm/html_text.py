"""Main text of web pages: tags where they speak, repeats over a host's pages where they don't.

A page is cut into blocks. Blocks in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments go, as their tags, roles and class names say; blocks in <article> or <main> stay, and if a page has such an
element, nothing else does. Class names count as a whole, and an element that they or <form> mark is a mere wrapper if it
holds <main>, the page's only articles, or, with an article or as a form, most of the page's words. What is not marked is
decided by repetition: runs of MIN_RUN words that occur on LEAST_PAGES or more distinct pages of a host, and on a SHARE of
them, are boilerplate, and stretches of LONG words or more made of such runs are cut. Inside a marked article sentences
may recur and be prose all the same: there a stretch goes only if it begins or ends the article and its runs are on
MAIN_SHARE of the host's articles. Marked articles are compared with marked articles, other words with all other words,
those that tags drop among them. Repetition alone can't decide the rest: adverts needn't repeat.

Each page is parsed once; the blocks that its text may have, and hashes of the words outside articles, are kept in a scratch
table. An article's runs are counted wherever they stand in it; its words are hashed again from its blocks when they are dealt.

Copied articles repeat, so equal and near-equal pages of a host count as one. The words that tags would keep have a
sketch of 64 minima over their runs; pages that agree on one of its BANDS parts, directly or through others, are copies,
and the one with the smallest id stands for them. Copies are found for 99 in 100 of the pairs that share 0.9 of their
runs, 3 in 100 of those that share half.

Repeats come from suffix arrays. The distinct pages of a host are dealt into groups of bounded size by a hash of the id;
in each group the token streams are concatenated, with page ends that match nothing, and sorted by prefix doubling.
Suffixes that agree on MIN_RUN words form runs. A run that is on enough of the host's pages is on as large a share of one
group's at least; those leave their groups as hashes and are counted again over all pages, so no host meets in a task.
Groups get 16 bits of each word's hash, which saves half of the shuffle: what is equal in full is equal in part, so no run
is missed, and the count over all pages, which decides, is by the full hashes.

Cases: null or empty html has no text; null and hostless urls are one host; rows that share an id, and rows with a null id,
are extracted each; a host of fewer than LEAST_PAGES distinct pages has no repeats; unclosed and stray tags are tolerated;
very long pages take time in proportion to their length and the depth of their elements; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, checkpoint
from lodeworks.llm.near_dedup import components

MIN_RUN = 5
#: Pages in a group that one suffix array holds, on average.
GROUP = 300
DROPPED, OPEN, MAIN = 0, 1, 2
#: What stands before a host where its MAIN words are compared.
_MAIN_OF = "\n"
#: How an element is marked to go: for good; unless it turns out to wrap the article; the same for comments and adverts.
HARD, SOFT, TALK = 3, 1, 2
#: Distinct pages that have a run, at least, and their share of the host's, for it to be boilerplate; words of a stretch to be cut.
LEAST_PAGES, SHARE, LONG = 3, 0.1, 8
#: The share of a host's marked articles that have a run, for it to be boilerplate at the head or tail of one.
MAIN_SHARE = 0.5
#: Words at each end of an article that are held against the repeated runs first, and then twice as many while what goes may reach further.
FRAME = 64
#: Bytes of text whose words are hashed together.
BYTES = 1 << 18
#: Parts of a page's sketch; pages that agree on one are copies.
BANDS = 8
#: Repeated runs, hosts and copies that are sent to every task at most.
MOST_SENT = 1_000_000

# Elements and names by what they hold.
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe noembed noframes xmp select".split())
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in _RAW}
_AWAY = set("aside button dialog footer form head menu nav".split())
_AWAY_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_AWAY_NAMES = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_TALK = set("ad ads advert advertisement adverts advertising comment comments disqus promo promotion related sponsor sponsored".split())
# What compounds of these names may begin and end with: site-footer, share-buttons; not search-page, has-sidebar.
_FIRST = set("site page main top bottom global post entry".split())
_LAST = set("area bar block box button buttons form icons item items links list posts section slot text".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
# A whole tag whose quotes are all closed.
_WHOLE = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Without one of these no attribute says anything.
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_NAME = re.compile(r"[a-z0-9]+")
# Numbers for bytes, and the base of their polynomials with its inverse.
_BYTE = np.random.default_rng(6).integers(1, 1 << 63, 256, np.uint64)
_BASE, _BACK = np.uint64(0x9FB21C651E98DF25), np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _named(value: str) -> set[str]:
    """What of a class or id speaks for an element that goes: whole names, and compounds of nothing else."""
    out = set()
    for token in value.split():
        parts = _NAME.findall(token)
        if token in _AWAY_NAMES or parts and all(p in _AWAY_NAMES or p in (_LAST if i else _FIRST) for i, p in enumerate(parts)):
            out |= _AWAY_NAMES.intersection(parts)
    return out


def _away(name: str, attributes: str, in_main: bool) -> int:
    """0, HARD, SOFT or TALK."""
    if name == "form":
        return SOFT
    if name in _AWAY or (name == "header" and not in_main):
        return HARD
    out = 0
    if not _TELLING.search(attributes):
        return out
    for key, *value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(value).lower()
        if key in ("class", "id") and name not in ("html", "body", "main"):
            own = _named(value)
            if name == "article":
                own &= _TALK
            if own:
                out = max(out, SOFT if _TALK.isdisjoint(own) else TALK)
        if key == "role" and value in ("form", "search"):
            out = max(out, SOFT)
        elif key == "role" and value in _AWAY_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return HARD
    return out


def marks_of(page: str):
    """The markup of a page, in order: (start, end, closing, name, attributes); name is None for comments and declarations.

    Each character is looked at a bounded number of times. A quote that nothing closes is a character like others, and so
    are all quotes once no tag ends outside them; a tag that never ends is text.
    """
    at, size, quotes, odd = 0, len(page), {'"', "'"}, False
    while (start := page.find("<", at)) >= 0:
        if not odd and (tag := _WHOLE.match(page, start)):
            at, (closing, name, attributes) = tag.end(), tag.groups()
            name = name.lower()
            yield start, at, closing, name, attributes
            if name in _RAW and not closing:
                close = _RAW_END[name].search(page, at)
                if not close:
                    yield at, size, "", None, ""
                    return
                if close.start() > at:
                    yield at, close.start(), "", None, ""
                at = close.start()
            continue
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = size if end < 0 else end + 3
            yield start, at, "", None, ""
        elif page.startswith("![CDATA[", at):
            end = page.find("]]>", at)
            at = size if end < 0 else end + 3
            yield start, at, "", None, ""
        elif page.startswith(("!", "?"), at):
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", None, ""
        elif tag := _TAG.match(page, at):
            end, i = -1, tag.end()
            while stop := _STOP.search(page, i):
                i = stop.end()
                if stop[0] == ">":
                    end = i
                    break
                if stop[0] in quotes:
                    close = page.find(stop[0], i)
                    if close < 0:
                        quotes.discard(stop[0])
                    else:
                        i = close + 1
            if end < 0:
                quotes.clear()
                odd = True
                end = page.find(">", tag.end()) + 1
                if not end:
                    return
            at = end
            yield start, at, tag[1], tag[2].lower(), page[tag.end() : at - 1]
            if tag[2].lower() in _RAW and not tag[1]:
                # What a raw element holds isn't markup.
                close = _RAW_END[tag[2].lower()].search(page, at)
                if not close:
                    yield at, size, "", None, ""
                    return
                if close.start() > at:
                    yield at, close.start(), "", None, ""
                at = close.start()


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page with text, in order, each DROPPED, OPEN or MAIN."""
    found, parts, stack, at, page = [], [], [], 0, page or ""
    hard = main = 0
    opened: dict[str, int] = defaultdict(int)
    # Of each element marked SOFT or TALK: its mark, whether it is a form, whether it holds <article>, <main>.
    marks: list[list] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append((text, hard, main, [e[3] for e in stack if e[3] is not None] if marks else []))
        parts.clear()

    def pop(n: int) -> None:
        nonlocal hard, main
        for name, a, m, _ in stack[n:]:
            hard -= a
            main -= m
            opened[name] -= 1
        del stack[n:]

    for start, end, closing, name, attributes in marks_of(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if name is None:
            continue
        block = name in _BLOCK
        if block:
            close()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if name in _RAW:
            continue
        if closing:
            if opened[name]:
                pop(max(n for n, e in enumerate(stack) if e[0] == name) if stack[-1][0] != name else len(stack) - 1)
            continue
        if name in _VOID:
            continue
        if name in _CLOSES and any(opened[x] for x in _CLOSES[name]):
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] in _CLOSES[name]:
                    pop(n)
                if n < len(stack) and stack[n][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
        elif name not in _CLOSES and block and opened["p"]:
            pop(next(n for n, e in enumerate(stack) if e[0] == "p"))
        mark, number = _away(name, attributes, main > 0), None
        if name in ("article", "main") and not mark and not hard:
            for e in stack:
                if e[3] is not None:
                    marks[e[3]][2 if name == "article" else 3] = True
        if mark in (SOFT, TALK):
            number = len(marks)
            marks.append([mark, name == "form", False, False])
        stack.append((name, int(mark == HARD), int(name in ("article", "main")), number))
        opened[name] += 1
        hard += stack[-1][1]
        main += stack[-1][2]
    parts.append(page[at:])
    close()
    # A marked element that holds the page's article, or a form that holds most of the page, is a wrapper only.
    words, total, marked = [0] * len(marks), 0, True
    for text, h, m, own in found:
        if marks and not h:
            n = text.count(" ") + 1
            total += n
            for i in own:
                words[i] += n
            marked = marked and not (m and not own)
    goes = []
    for (mark, form, article, holds_main), n in zip(marks, words, strict=True):
        most = 2 * n > total
        goes.append(not (holds_main or form and most or article and (most if mark == TALK else most or marked) and (marked or mark == SOFT)))
    return [(text, DROPPED if h or any(goes[i] for i in own) else MAIN if m else OPEN) for text, h, m, own in found]


def _hashes(text: str) -> np.ndarray:
    """A hash of each word of a text in which single spaces stand between words, all words side by side.

    A word is a polynomial of its bytes modulo 2 ** 64: the difference of two prefix sums, taken back to the word's start.
    """
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, [np.empty(0, np.int32)]
    power = back = np.empty(0, np.uint64)
    while at < len(data):
        end = data.find(b" ", at + BYTES)
        own = np.frombuffer(data, np.uint8, (end if end >= 0 else len(data)) - at, at)
        gaps, n = np.flatnonzero(own == 32), len(own)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, n)
        if len(power) < n:
            power, back = (np.cumprod(np.full(n + n // 8 + 1, x)) for x in (_BASE, _BACK))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[own] * power[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * back[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
        at += n + 1
    return np.concatenate(out)


def _hashed(words: list[str]) -> np.ndarray:
    return _hashes(" ".join(words))


def _each(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, and how many words each has."""
    return _hashes(" ".join(filter(None, texts))), np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists side by side, and the lists' sizes."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _seed(host: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(host))


def _mixed(columns, seed) -> np.ndarray:
    """A hash of each row of some columns of words."""
    out = seed
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def run_hashes(words: np.ndarray, depth: int, host: str) -> np.ndarray:
    """A hash of each run of depth words, different for each host."""
    n = max(0, len(words) - depth + 1)
    return _mixed((words[i : i + n] for i in range(depth)), np.full(n, _seed(host))).view(np.int64)


def _page_runs(words: np.ndarray, sizes: np.ndarray, depth: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the runs of pages side by side, and the page of each; no run spans two pages."""
    n = max(0, len(words) - depth + 1)
    page = np.repeat(np.arange(len(sizes)), sizes)[:n]
    found = _mixed((words[i : i + n] for i in range(depth)), seeds[page])
    whole = np.arange(n) + depth <= np.cumsum(sizes)[page]
    return found[whole].view(np.int64), page[whole]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def covered(words: np.ndarray, host: str, runs: np.ndarray, depth: int = MIN_RUN) -> np.ndarray:
    """Which words lie in stretches of LONG words or more that are made of repeated runs."""
    starts = np.flatnonzero(_among(run_hashes(words, depth, host), runs))
    mark = np.zeros(len(words) + 1, int)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + depth, -1)
    edge = np.diff((np.cumsum(mark) > 0).astype(int), prepend=0)
    out = np.zeros(len(words), bool)
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out[lo:hi] = hi - lo >= LONG
    return out


def main_text(page: str | None, host: str = "", runs: np.ndarray | None = None) -> str:
    """The text of a page; runs: hashes of the runs that are boilerplate by repetition, sorted."""
    return _chosen(blocks(page), None, host, runs)


def _stretch(gone: np.ndarray) -> int:
    """How many words are covered from the start on."""
    return len(gone) if gone.all() else int(gone.argmin())


def _ends(words: list[str], host: str, runs: np.ndarray) -> tuple[int, int]:
    """How many words are covered from the start on, and how many up to the end: (all, 0) if all are.

    Whether a word is covered hangs on the MIN_RUN - 1 words next to it, so a stretch that ends before those of a frame is whole.
    """
    frame = FRAME
    while 2 * frame < len(words):
        first = _stretch(covered(_hashed(words[:frame]), host, runs))
        last = _stretch(covered(_hashed(words[-frame:]), host, runs)[::-1])
        if max(first, last) <= frame - MIN_RUN:
            return first, last
        frame *= 2
    gone = covered(_hashed(words), host, runs)
    first = _stretch(gone)
    return first, 0 if first == len(gone) else _stretch(gone[::-1])


def _chosen(own: list[tuple[str, int]], hashed: np.ndarray | None, host: str, runs: np.ndarray | None) -> str:
    """The text of a page by its blocks; hashed: the words of all of them, of a page without MAIN blocks, if they are known."""
    marked = any(k == MAIN for _, k in own)
    want = MAIN if marked else OPEN
    text = [t for t, k in own if k == want]
    if runs is not None and len(runs):
        # MAIN words are held against other pages' MAIN words, others against all that aren't.
        if marked:
            blocked = [t.split() for t in text]
            words = [w for x in blocked for w in x]
            first, last = _ends(words, _MAIN_OF + host, runs)
            if first or last:
                stop, at, text = len(words) - last, 0, []
                for x in blocked:
                    text.append(" ".join(x[max(0, first - at) : max(0, stop - at)]))
                    at += len(x)
            return "\n".join(t for t in text if t)
        gone = covered(_hashed([w for t, _ in own for w in t.split()]) if hashed is None else hashed, host, runs)
        if gone.any():
            text, at = [], 0
            for t, k in own:
                x = t.split()
                if k == want:
                    text.append(" ".join(w for w, c in zip(x, gone[at : at + len(x)], strict=True) if not c))
                at += len(x)
    return "\n".join(t for t in text if t)


def _ranked(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, without those that fewer than least share, and the class of each in that order."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order[:1]] - 1) != 0
    kind = np.cumsum(new) - 1
    enough = np.bincount(kind)[kind] >= least
    return order[enough], kind[enough]


def suffix_array(tokens: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first depth tokens (or more), and the rank classes of that order, by prefix doubling.

    Suffixes whose first tokens fewer than least suffixes share are left out, as soon as that is known; their class is -1.
    """
    n, k = len(tokens), 1
    order, kind = _ranked(tokens, least)
    while True:
        rank = np.full(n, -1)
        rank[order] = kind
        if k >= depth:
            return order, rank
        step = min(k, depth - k)
        # What follows a suffix that many share is shared by as many; past the end there is nothing.
        other = np.full(len(order), -1)
        inside = order + step < n
        other[inside] = rank[order[inside] + step]
        if least > 1:
            order, kind, other = order[other >= 0], kind[other >= 0], other[other >= 0]
        at, kind = _ranked(kind * (n + 2) + other + 1, least)
        order = order[at]
        k += step


_RUN = "host string, run bigint, need bigint"
_RUN_SCHEMA = pa.schema([("host", pa.string()), ("run", pa.int64()), ("need", pa.int64())])


def _runs(depth: int):
    """The runs of a group that may be on enough pages of the host.

    A run on need of all pages is, in one group at least, on as large a share of that group's.
    """
    def find(key, table):
        host = key[0].as_py().split("\n", 1)[1]
        need, total = (table.column(c)[0].as_py() for c in ("need", "pages"))
        streams = [np.asarray(x.values, np.int64) for x in table.column("words")]
        n, sizes = len(streams), np.array([len(x) + 1 for x in streams])
        # A page ends in a token of its own, which no other suffix has.
        tokens = np.concatenate([np.append(x, -(1 << 40) - i) for i, x in enumerate(streams)])
        page = np.repeat(np.arange(n), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(tokens))
        order, rank = suffix_array(tokens, depth, max(1, -(-need * n // total)))
        order = order[left[order] >= depth]
        kind = rank[order]
        kinds, pages = np.unique(np.unique(kind * n + page[order]) // n, return_counts=True)
        first = order[np.searchsorted(kind, kinds[pages * total >= need * n])]
        found = _mixed((tokens[first + i] for i in range(depth)), np.full(len(first), _seed(host))).view(np.int64)
        return pa.table([pa.array(c, t.type) for c, t in zip(([host] * len(found), found, [need] * len(found)), _RUN_SCHEMA, strict=True)], schema=_RUN_SCHEMA)
    return find


def bands(words: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Keys that near-equal pages share: BANDS of a sketch with one minimum in each of 64 ranges of run hashes.

    words: of pages of those sizes, side by side; pages without words have no keys.
    """
    out = np.zeros((len(sizes), BANDS), np.int64)
    none = np.iinfo(np.uint64).max
    for depth in range(1, MIN_RUN + 1):
        # A page of few words has one run.
        own = sizes == depth if depth < MIN_RUN else sizes >= depth
        if not own.any():
            continue
        h, page = _page_runs(words[np.repeat(own, sizes)], sizes[own], depth, np.full(own.sum(), _seed("")))
        h, least = h.view(np.uint64), np.full(64 * own.sum(), none)
        np.minimum.at(least, page * 64 + (h >> np.uint64(58)).astype(int), h)
        least = least.reshape(-1, 64)
        # An empty range borrows from the next one that isn't.
        held = np.where(least != none, np.arange(64), 128)
        held = np.minimum.accumulate(np.concatenate((held, held + 64), axis=1)[:, ::-1], axis=1)[:, ::-1][:, :64] % 64
        least = np.take_along_axis(least, held, axis=1).reshape(-1, BANDS, 64 // BANDS)
        out[own] = _mixed((least[:, :, i] for i in range(64 // BANDS)), np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))).view(np.int64)
    return _lists(out[sizes > 0].ravel(), BANDS * (sizes > 0))


_PARSED = "page_id bigint, url string, host string, kinds array<tinyint>, texts array<string>, marked boolean, other array<int>, bands array<bigint>"


def _parsed(batches):
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for whole in batches:
        for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
            kinds, texts, marked, other, shown = [], [], [], [], []
            for page in batch.column("html").to_pylist():
                own = blocks(page)
                main = [x for x in own if x[1] == MAIN]
                # Of a page with MAIN blocks no other one is ever in its text.
                kept = main or own
                kinds.append([k for _, k in kept])
                texts.append([t for t, _ in kept])
                marked.append(bool(main))
                other.append(" ".join([t for t, k in own if k != MAIN]))
                shown.append(" ".join(texts[-1] if main else [t for t, k in own if k == OPEN]))
            made = [pa.array(kinds, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string())), pa.array(marked, pa.bool_()), _lists(*_each(other)), bands(*_each(shown))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + made, names=names)


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, host, html) as the blocks that their text may have, whether these are MAIN blocks, the words of other blocks, and the bands of those that tags would keep."""
    return pages.select("page_id", "url", "host", "html").mapInArrow(_parsed, _PARSED)


def _worded(short: bool):
    """Pages' words, hashed from their texts if they come as such; short: the last 16 bits of each."""
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                if "texts" in batch.schema.names:
                    words, sizes = _each(pc.binary_join(batch.column("texts"), " ").to_pylist())
                else:
                    words, sizes = _listed(batch.column("words"))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), _lists(words.astype(np.int16 if short else np.int32), sizes)], names=["page_id", "host", "words"])
    return run


def copies(streams: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id and rep of the pages that share a band with another page of their host: the smallest id of those linked."""
    keys = streams.select("page_id", F.explode("bands").alias("band"), "host").select("page_id", F.xxhash64("host", "band").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    links = scratch.keep(keys.join(shared, "bucket").filter("page_id <> first").select(F.col("page_id").alias("a"), F.col("first").alias("b")).distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("page_id"), F.col("b").alias("rep"))
    return components(links).select(F.col("node").alias("page_id"), F.col("root").alias("rep"))


def _sent(rows: DataFrame, runs: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """rows with those runs of their hosts; few runs are sent to every task instead."""
    if runs.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.withColumn("runs", F.lit(None).cast("array<bigint>")), np.sort(np.array([r.run for r in runs.select("run").collect()], np.int64))
    return rows.join(runs.groupBy("host").agg(F.sort_array(F.collect_set("run")).alias("runs")), "host", "left"), None


def _known(batch, sent, found: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the runs found on the rows of a batch are among those sent, or their row's own."""
    if sent is not None:
        return _among(found, sent)
    out, cuts = np.zeros(len(found), bool), np.searchsorted(row, np.arange(batch.num_rows + 1))
    for i, runs in enumerate(batch.column("runs")):
        if runs.is_valid:
            out[cuts[i] : cuts[i + 1]] = _among(found[cuts[i] : cuts[i + 1]], np.asarray(runs.values, np.int64))
    return out


def _counted(depth: int, sent):
    """Of the runs whose short words make a key among those sent: key, run and how many pages have it."""
    def run(batches):
        for batch in batches:
            words, sizes = _listed(batch.column("words"))
            seeds = np.array([_seed(host) for host in batch.column("host").to_pylist()], np.uint64)
            key, row = _page_runs(words.astype(np.int16), sizes, depth, seeds)
            known = _known(batch, sent, key, row)
            found = _page_runs(words, sizes, depth, seeds)[0][known] if known.any() else np.empty(0, np.int64)
            key, row = key[known], row[known]
            # Each page counts once.
            order = np.lexsort((found, row))
            key, found, row = key[order], found[order], row[order]
            once = np.ones(len(found), bool)
            once[1:] = (np.diff(row) != 0) | (found[1:] != found[:-1])
            found, first, n = np.unique(found[once], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key[once][first], found, n)], names=["key", "run", "n"])
    return run


def repeated_runs(pages: DataFrame, scratch: Scratch, min_run: int = MIN_RUN, main_share: float = SHARE) -> DataFrame:
    """host and run: the runs that enough distinct pages of a host have. Copies count as one page."""
    return _repeated(scratch.keep(parsed(pages), "parsed"), scratch, min_run, main_share)


def _repeated(blocked: DataFrame, scratch: Scratch, min_run: int, main_share: float) -> DataFrame:
    """repeated_runs() of pages as parsed() gives them; main_share: SHARE for the words of marked articles."""
    main_of = F.concat(F.lit(_MAIN_OF), F.coalesce("host", F.lit(""))).alias("host")
    main = blocked.filter("marked").select("page_id", main_of, "bands")
    other = blocked.filter("not marked").select("page_id", "host", "bands")
    share = F.when(F.col("host").startswith(_MAIN_OF), main_share).otherwise(SHARE)
    again = scratch.keep(copies(other.unionByName(main), scratch).filter("rep <> page_id").select("page_id"), "again")
    again = F.broadcast(again) if again.count() <= MOST_SENT else again
    left = blocked.join(again, "page_id", "left_anti")
    sizes = left.select("host").unionByName(left.filter("marked").select(main_of)).groupBy("host").agg(F.count("*").alias("pages"))
    sizes = sizes.withColumns({"need": F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * share)).cast("long"), "parts": F.ceil(F.col("pages") / GROUP)})
    sizes = scratch.keep(sizes.filter("pages >= need"), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_SENT else sizes

    def single(short: bool) -> DataFrame:
        made = f"page_id bigint, host string, words array<{'smallint' if short else 'int'}>"
        main = left.filter("marked").select("page_id", main_of, "texts").mapInArrow(_worded(short), made)
        other = left.select("page_id", "host", F.col("other").alias("words")).filter(F.size("words") >= min_run)
        return (other.mapInArrow(_worded(short), made) if short else other).unionByName(main.filter(F.size("words") >= min_run))

    # Grouped by one string, since rows that a join has dealt by host would not be dealt again by host and part.
    dealt = single(True).join(sizes, "host").withColumn("deal", F.concat_ws("\n", F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("string"), "host"))
    some = scratch.keep(dealt.select("deal", "words", "need", "pages").groupBy("deal").applyInArrow(_runs(min_run), _RUN), "runs").distinct()
    rows, sent = _sent(single(False).select("host", "words"), some)
    counts = rows.mapInArrow(_counted(min_run, sent), "key bigint, run bigint, n bigint").groupBy("key", "run").agg(F.sum("n").alias("n"))
    return some.withColumnRenamed("run", "key").join(counts, "key").filter("n >= need").select("host", "run")


def _texts(sent):
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                made, marked = pc.binary_join(batch.column("texts"), "\n").to_pylist(), batch.column("marked").to_pylist()
                hosts = [host or "" for host in batch.column("host").to_pylist()]
                # The first and the last run of each article: it loses nothing if neither is boilerplate.
                ends = [(i, own) for i, text in enumerate(made) if marked[i] and len(own := text.split(None, MIN_RUN)) >= MIN_RUN]
                words = _hashed([w for i, own in ends for w in own[:MIN_RUN] + made[i].rsplit(None, MIN_RUN)[-MIN_RUN:]]).reshape(-1, MIN_RUN)
                row = np.repeat(np.array([i for i, _ in ends], np.int64), 2)
                found = _mixed(words.T, np.array([_seed(_MAIN_OF + hosts[i]) for i in row], np.uint64)).view(np.int64)
                for i in {*row[_known(batch, sent, found, row)].tolist(), *(i for i, x in enumerate(marked) if not x)}:
                    runs = sent if sent is not None else np.asarray(batch.column("runs")[i].values if batch.column("runs")[i].is_valid else [], np.int64)
                    own = list(zip(batch.column("texts")[i].as_py(), batch.column("kinds")[i].as_py(), strict=True))
                    made[i] = _chosen(own, np.asarray(batch.column("other")[i].values, np.int32), hosts[i], runs)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page's page_id, url, text and n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    hosted = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    scratch = Scratch(pages.sparkSession)  # its tables are read when the result is, and deleted at the end of the session
    blocked = scratch.keep(parsed(hosted), "parsed", compression="zstd")
    with Scratch(pages.sparkSession) as own:
        runs = checkpoint(_repeated(blocked, own, MIN_RUN, MAIN_SHARE)).withColumn("host", F.regexp_replace("host", _MAIN_OF, ""))
    told, sent = _sent(blocked, runs)
    return told.select("page_id", "url", "host", "kinds", "texts", "marked", "other", "runs").mapInArrow(_texts(sent), "page_id bigint, url string, text string, n_chars bigint")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
