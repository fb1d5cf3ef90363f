"""Main text of web pages: block structure, then a suffix array over the pages of a host.

A page is cut into blocks at block-level tags. What is marked as a menu,
header, footer, sidebar, notice, advert, form, script, style or reader comment,
by its tag, role, class or id, is left out, unless it is marked by a class or id
only and holds the text. The container that the page names (``article`` and
``main``, else a class or id such as ``content``) says where its text is, if it
holds a quarter of it. Inside ``article`` or ``main`` that decides, and an
article stays whole, also if other pages repeat it; only what half of the host's
different pages have, and makes up less than half of this one, is a template's.

Pages that name no such container are decided by repetition. The token streams
of the pages of a host are concatenated, their suffixes are sorted by their
first ``run`` tokens (prefix doubling, so equal ranks are common prefixes of at
least that length), and a stretch that ``pages`` or more different pages have
is boilerplate: it is removed, and unique runs stay, also inside a block. (Common
prefixes of ``run`` tokens are all that this needs of a suffix array: a token is in
a repeated stretch of that length or more exactly if it is in one of that length.)
A large host is dealt out in parts of about ``GROUP`` pages, each with a
suffix array. The parts' counts of pages for each distinct run of tokens are
added up over the whole host, dealt by a 48-bit hash of the run, and the parts
get back which of their runs are repeated, so the parts decide nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.url_filter import host_of

GROUP = 512
_CODEC = "zstd"
#: Hosts above GROUP pages that may be broadcast; with more of them the join is by shuffle.
MOST_BROADCAST = 100_000
#: Streams that a task remembers, to deal out their copies.
MOST_MET = 1_000_000
#: A span of keys is what this many parts hold.
PARTS_OF_SPAN = 8
#: A part with fewer different pages gives all its keys.
FEW_PAGES = 64

#: Tags and marks.
_BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW_TAGS = set("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
_LEFT_OUT_TAGS = set("head nav aside footer form button select datalist dialog menu object audio video canvas search".split())
_LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_LEFT_OUT_MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget toolbar pagination pager skip".split()
)
#: Longer marks of the same kinds, such as ``commentlist`` or ``topnav``.
_LEFT_OUT_FORMS = re.compile(r"comments?(?:list|form|thread|section|area|box)|(?:side|cookie|advert|breadcrumb|newsletter|subscri|sponsor)(?:bar|s|ed|ement|ing|be|ption|box)\w*|ad(?:box|slot|unit|sense|block)|\w+(?:nav|menu|navbar|sidebar|footer|comments)")
_CONTAINER_MARKS = set("article content entry post story main maincontent articlebody".split())
#: Tags that end an open paragraph.
_ENDS_P = _BLOCK_TAGS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "optgroup", "option", "legend"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</\Z|</[^>a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKS = re.compile(r"[a-z0-9]+")

PLAIN, MARKED, MAIN, ARTICLE = range(4)
KEPT, OUT, BY_MARK, BY_SUBJECT = range(4)
#: A container with less than one part in SMALL of the text isn't where the text is.
SMALL = 4
#: Names that say what else there is or isn't, such as ``no-sidebar`` or ``nav-open``.
_NO_MARK = re.compile(r"(?<![a-z0-9_-])(?:no|has|with|without)[-_][a-z0-9_-]+|(?<![a-z0-9])[a-z0-9]+[-_](?:open|opened|closed|collapsed|expanded|enabled|disabled)(?![a-z0-9_-])")
#: Marks of what may well be longer than the text.
_SUBJECT = re.compile(r"(?:\w*comment|disqus|repl|respond|related|recommend|cookie|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri|signup|login|ad(?:s|box|slot|unit|sense|block|vert\w*)?$|sponsor|promo)")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


def _role(tag: str, attributes: dict[str, str], inside: int) -> tuple[int, int]:
    """Is the element left out (OUT), or by its marks (BY_MARK, BY_SUBJECT), and which container does it open (at least ``inside``)."""
    role = attributes.get("role", "").lower()
    names = _NO_MARK.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    marks = set(_MARKS.findall(names))
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    named = {m for m in marks if m in _LEFT_OUT_MARKS or _LEFT_OUT_FORMS.fullmatch(m)} if tag not in ("body", "html", "article", "main") else set()
    if tag == "article":
        named = marks & {"comment", "comments", "reply", "ad", "related", "promo"}
    out = tag in _LEFT_OUT_TAGS - {"form"} or role in _LEFT_OUT_ROLES or hidden
    if inside < MAIN:  # an article may have a header of its own
        out |= tag == "header"
        if tag not in ("body", "html", "article", "main"):
            named |= marks & {"header", "masthead"}
    level = ARTICLE if tag == "article" or role == "article" else MAIN if tag == "main" or role == "main" else MARKED if tag in ("div", "section", "td") and marks & _CONTAINER_MARKS else PLAIN
    kind = OUT if out else BY_SUBJECT if any(map(_SUBJECT.match, named)) else BY_MARK if named or tag == "form" else KEPT
    return kind, max(inside, level)


def blocks(page: str) -> list[tuple[int, str]]:
    """(container, text) of each block that isn't left out, in page order, with white space folded."""
    found: list[tuple[int, list[tuple[str, int, bool]]]] = []
    # Tag, is it left out for good, the element around that marks leave out, container.
    stack: list[tuple[str, bool, int, int]] = []
    text: list[tuple[str, int, bool]] = []
    # Elements that marks leave out: the one around, the container around, do they name a subject.
    marked: list[tuple[int, int, bool]] = []
    mains: list[int] = []
    left_out, around, inside = False, -1, PLAIN
    opened: Counter[str] = Counter()  # of the stack's tags

    def end() -> None:
        if text:
            found.append((inside, text.copy()))
            text.clear()

    def close(tag: str) -> None:
        nonlocal left_out, around, inside
        if opened[tag]:
            last = ""
            while last != tag:
                last = stack.pop()[0]
                opened[last] -= 1
            left_out, around, inside = stack[-1][1:] if stack else (False, -1, PLAIN)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not left_out:
            piece = page[at : m.start()] if m else page[at:]
            if piece:
                text.append((html.unescape(piece) if "&" in piece else piece, around, any(e[0] == "a" for e in stack[-4:])))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK_TAGS:
            end()
        elif tag == "br" and not left_out:
            text.append((" ", around, False))
        if m[1] or m[4]:
            close(tag)
            continue
        if tag in _ENDS_P and opened["p"]:
            close("p")
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
            close(tag)
        raw = m[3] if m[2] else m[6]
        if tag in _RAW_TAGS:
            if raw.endswith("/") and tag in ("svg", "math"):
                continue
            stop = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in _VOID_TAGS:
            continue
        kind, level = _role(tag, _attributes(raw), inside)
        left_out = left_out or kind == OUT
        if kind >= BY_MARK and not left_out:
            marked.append((around, inside, kind == BY_SUBJECT))
            around = len(marked) - 1
        if level == MAIN > inside and not left_out:
            mains.append(around)
        inside = level
        stack.append((tag, left_out, around, inside))
        opened[tag] += 1
    end()
    stay = _held(found, marked, mains) if marked else [True]
    out = []
    for container, pieces in found:
        whole = " ".join("".join(p for p, k, _ in pieces if stay[k]).split())
        if whole:
            out.append((container, whole))
    # A container is where the text is unless it holds a small part of it.
    total = sum(len(t) for _, t in out)
    for region in (MAIN, MARKED):
        held = [b for b in out if b[0] >= region]
        if held and SMALL * sum(len(t) for _, t in held) >= total:
            return held
    return out


def _held(found: list[tuple[int, list[tuple[str, int, bool]]]], marked: list[tuple[int, int, bool]], mains: list[int]) -> list[bool]:
    """Of the elements that marks leave out those that stay, because they hold the text: a ``main``,
    or all articles and more than half of what articles and mains hold (of all text, if there are none).
    Links don't count as text, and what names its subject stays only for a ``main``."""
    k = len(marked)
    sums = np.zeros((k + 1, 3), np.int64)  # of all text, of that in MAIN and ARTICLE, of that in ARTICLE; last row: of the page
    for container, pieces in found:
        for piece, around, linked in pieces:
            if not linked:
                sums[around] += len("".join(piece.split())) * np.array([1, container >= MAIN, container >= ARTICLE])
    holds_main = np.zeros(k + 1, bool)
    holds_main[mains] = True
    for i in range(k - 1, -1, -1):
        parent, _, subject = marked[i]
        holds_main[parent] |= holds_main[i]
        if not subject:
            sums[parent] += sums[i]
    stay: list[bool] = []
    for i, (parent, level, subject) in enumerate(marked):
        all_text, named, articles = map(int, sums[i])
        share = 2 * named > sums[k, 1] and SMALL * named >= sums[k, 0] if sums[k, 1] else 2 * all_text > sums[k, 0]
        own = holds_main[i] or not subject and share and (level >= ARTICLE or articles == sums[k, 2])
        stay.append(bool(own) and (parent < 0 or stay[parent]))
    return [*stay, True]


class Suffixes:
    """The suffixes of some token streams, sorted by their first ``run`` tokens (those that are as long)."""

    def __init__(self, streams: list[list[str]], run: int) -> None:
        self.run, self.sizes = run, np.array([len(s) for s in streams], np.int64)
        self.ids: dict[str, int] = {}
        ids = self.ids
        self.flat = np.fromiter((ids.setdefault(t, len(ids)) for s in streams for t in s), np.int64, int(self.sizes.sum()))
        # Equal streams are one page: a copy is no evidence.
        kinds: dict[tuple[str, ...], int] = {}
        self.kind = np.array([kinds.setdefault(tuple(s), len(kinds)) for s in streams], np.int64)
        self.n_kinds, self.n_full = len(kinds), sum(map(bool, kinds))
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        n = self.flat.size
        alive = np.arange(n)  # suffixes that are as long as the sorted length
        rank, length = self.flat, 1
        while length < run and alive.size:
            step = min(length, run - length)
            alive = alive[alive + length + step <= ends[alive]]
            if not alive.size:
                break
            pair = rank[alive] * (n + 1) + rank[alive + step]
            _, dense = np.unique(pair, return_inverse=True)
            rank = np.full(n, -1, np.int64)
            rank[alive] = dense
            length += step
        #: Where the suffixes start, and their ranks: equal ranks are equal in the first ``run`` tokens.
        self.start = alive if length >= run else alive[:0]
        self.rank = rank[self.start]

    def holders(self, counted: np.ndarray | None = None) -> np.ndarray:
        """How many different streams (of those that are counted) have each rank."""
        of = np.repeat(self.kind, self.sizes)[self.start]
        pairs = self.rank * (self.n_kinds + 1) + of
        if counted is not None:
            pairs = pairs[counted[of]]
        return np.bincount(np.unique(pairs) // (self.n_kinds + 1), minlength=int(self.rank.max(initial=-1)) + 1)

    def keys(self) -> np.ndarray:
        """For each rank a number of 48 bits, the same in every process: a multilinear hash of its tokens."""
        of_id = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little") for t in self.ids], np.uint64)
        at = np.zeros(int(self.rank.max(initial=-1)) + 1, np.int64)
        at[self.rank] = self.start
        found = np.zeros(at.size, np.uint64)
        factors = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, self.run, np.uint64) | np.uint64(1)
        for j in range(self.run):
            found += of_id[self.flat[at + j]] * factors[j]
        found ^= found >> np.uint64(32)
        return (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)

    def cover(self, ranks: np.ndarray) -> list[np.ndarray]:
        """Which tokens of each stream lie in a stretch that begins with one of these ranks (a mask)."""
        cover = np.zeros(self.flat.size + 1, np.int64)
        if ranks.size:
            start = self.start[ranks[self.rank]]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + self.run, -1)
        inside = np.cumsum(cover[:-1]) > 0
        return np.split(inside, np.cumsum(self.sizes)[:-1]) if self.sizes.size else []


def covered(streams: list[list[str]], run: int, pages: int) -> list[np.ndarray]:
    """Which tokens of each stream lie in a stretch of ``run`` tokens or more that ``pages`` different streams have."""
    found = Suffixes(streams, run)
    return found.cover(found.holders() >= pages)


def _streams(pages_of_host: list[list[tuple[int, str]]]) -> list[list[str]]:
    return [[w for _, t in page for w in t.split(" ")] for page in pages_of_host]


def _packed(values: np.ndarray, dtype: type) -> bytes:
    """Sorted keys as differences, byte planes apart, or counts, compressed."""
    planes = np.ascontiguousarray(values.astype(dtype).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), _CODEC, asbytes=True)


def _unpacked(raw: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw[4:], n * width, _CODEC, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _most(n: int, pages: int) -> int:
    """On how many of a host's ``n`` different pages the template's text stands at least."""
    return max(pages, -(-n // 2))


def _unique_runs(words: list[str], gone: np.ndarray, run: int) -> str:
    """A block without the stretches of ``run`` tokens or more that are gone. What is shorter only goes on from the block before."""
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    keep = np.ones(gone.size, bool)
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        keep[i:j] = j - i < run
    return " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def main_texts(pages_of_host: list[list[tuple[int, str]]], marks: list[np.ndarray], most: list[np.ndarray], run: int) -> list[str]:
    """The main text of each page, given which of its tokens are in repeated stretches, and in those of most pages: its
    tokens without these stretches, unique runs inside a block staying."""
    out = []
    for page, often, template in zip(pages_of_host, marks, most, strict=True):
        ends = np.cumsum([text.count(" ") + 1 for _, text in page]).tolist()
        kept: list[str] = []
        # What is mostly made of repeated stretches is a copied article, not one with a template around it.
        named, cut = 0, 0
        for (c, t), e in zip(page, ends, strict=True):
            if c >= MAIN:
                named += t.count(" ") + 1
                cut += int(template[e - t.count(" ") - 1 : e].sum())
        copied = 2 * cut >= named
        for (c, t), e in zip(page, ends, strict=True):
            gone = (template if c >= MAIN else often)[e - t.count(" ") - 1 : e]
            if c >= MAIN and copied or not gone.any():
                kept.append(t)
            elif not gone.all():
                kept.append(_unique_runs(t.split(" "), gone, run))
        out.append("\n".join(kept))
    return out


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", run: int = 8, repeated: int = 3) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none) and n_chars, its code points.

    Pages with a null url are a host of their own, as are those without a host; a null page is
    empty. Repeated rows are rows of their own, and no evidence of repetition for each other.
    Other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("host"))
    large = rows.groupBy("host").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("host", F.ceil(F.col("k") / GROUP).cast("int").alias("parts"))
    # At most one host for each GROUP pages; its size is looked at before it is broadcast.
    few = large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(large) if few else large, "host", "left")
    rows = rows.select("host", F.coalesce("parts", F.lit(1)).alias("parts"), "page_id", "url", "html")
    names = [("part", T.IntegerType()), ("evidence", T.BooleanType()), ("containers", T.BinaryType()), ("blocks", T.BinaryType()), ("size", T.IntegerType())]
    cut_schema = T.StructType([*[f for f in rows.schema.fields if f.name != "html"], *[T.StructField(*n) for n in names]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            new: list[list] = [[] for _ in names]
            for host, parts, value in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("host", "parts", "html")), strict=True):
                found = blocks(value.as_py() or "")
                raw = "\n".join(t for _, t in found).encode("utf-8", "replace")
                # Equal streams meet in one part and are counted once there. Only the first that a task
                # has goes there: its other copies are dealt out and aren't counted.
                part, first = 0, True
                if (parts := parts.as_py()) > 1:
                    key = hashlib.blake2b((host.as_py() or "").encode("utf-8", "replace") + b"\n\n" + raw.replace(b"\n", b" "), digest_size=16).digest()
                    first = key not in met
                    part = int.from_bytes(key[:8], "little") % parts if first else hash((len(met), len(new[0]))) % parts
                    if len(met) >= MOST_MET:
                        met.clear()
                    met.add(key)
                for column, x in zip(new, (part, first, bytes(c for c, _ in found), pa.compress(raw, _CODEC, asbytes=True), len(raw)), strict=True):
                    column.append(x)
            kept = [batch.column(batch.schema.get_field_index(f)) for f in cut_schema.fieldNames()[: -len(names)]]
            types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, new, types)], cut_schema.fieldNames())

    def pages_of(table: pa.Table) -> list[list[tuple[int, str]]]:
        whole = zip(*(table.column(c).to_pylist() for c in ("containers", "blocks", "size")), strict=True)
        return [list(zip(c, pa.decompress(t, n, _CODEC, asbytes=True).decode().split("\n"), strict=True)) if c else [] for c, t, n in whole]

    counts_schema = T.StructType([rows.schema["host"], *[T.StructField(n, T.IntegerType(), False) for n in ("part", "span")], T.StructField("pages", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    counts_schema_arrow = pa.schema(zip(counts_schema.fieldNames(), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True))

    def count(table: pa.Table) -> pa.Table:
        """What a part has of each span of keys, with its number of different counted pages for each."""
        parts, undecided = table.column("parts")[0].as_py(), table.column("undecided")[0].as_py()
        if parts == 1:
            return counts_schema_arrow.empty_table()
        found = Suffixes(_streams(pages_of(table)), run)
        counted = np.zeros(found.n_kinds, bool)
        counted[found.kind[table.column("evidence").to_numpy()]] = True
        keys, holders = found.keys(), found.holders(counted)
        order = np.argsort(keys)
        if not undecided and (own := int(counted.sum())) >= FEW_PAGES:
            # Only what most pages have is asked for; the parts are dealt by a hash, so each has its share of it.
            order = order[8 * holders[order] >= own]
        keys, holders = keys[order], holders[order]
        spans = -(-parts // PARTS_OF_SPAN)
        cuts = np.searchsorted(keys, [(i << 48) // spans for i in range(spans + 1)])
        out = [(i, _packed(np.diff(keys[x:y], prepend=np.uint64(0)), np.uint64), _packed(holders[x:y], np.uint32)) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
        whole = [[table.column(c)[0].as_py()] * len(out) for c in ("host", "part")] + [[o[0] for o in out], [table.column("pages")[0].as_py()] * len(out)] + [[o[i] for o in out] for i in (1, 2)]
        return pa.Table.from_arrays(list(map(pa.array, whole, counts_schema_arrow.types)), counts_schema.fieldNames())

    marks_schema = T.StructType([f for f in counts_schema.fields if f.name in ("host", "part", "keys", "counts")])

    def merge(table: pa.Table) -> pa.Table:
        """Of each part's keys those that enough pages of the whole host have."""
        each = [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(place, np.concatenate([_unpacked(c, np.uint32) for c in table.column("counts").to_pylist()]), keys.size)
        level = (total >= repeated) + (total >= _most(table.column("pages")[0].as_py(), repeated)).astype(np.uint32)
        levels = np.split(level[place], np.cumsum([k.size for k in each])[:-1])
        out = [(h, p, _packed(np.diff(k[v > 0], prepend=np.uint64(0)), np.uint64), _packed(v[v > 0], np.uint32)) for h, p, k, v in zip(table.column("host").to_pylist(), table.column("part").to_pylist(), each, levels, strict=True) if v.any()]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], marks_schema.fieldNames())

    out_schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def decide(table: pa.Table, marks: pa.Table) -> pa.Table:
        group = pages_of(table)
        found = Suffixes(_streams(group), run)
        if table.num_rows and table.column("parts")[0].as_py() > 1:
            keys = found.keys()
            each = [(np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64), _unpacked(c, np.uint32)) for k, c in zip(marks.column("keys").to_pylist(), marks.column("counts").to_pylist(), strict=True)]
            often, most = (np.isin(keys, np.concatenate([k[c >= v] for k, c in each])) if each else np.zeros(keys.size, bool) for v in (1, 2))
        else:
            holders = found.holders()
            often, most = holders >= repeated, holders >= _most(found.n_full, repeated)
        return pa.Table.from_arrays([table.column("page_id").combine_chunks(), table.column("url").combine_chunks(), pa.array(main_texts(group, found.cover(often), found.cover(most), run), pa.string())], out_schema.fieldNames())

    # The uses of the pieces are one exchange, as long as nothing is filtered between.
    pieces = rows.mapInArrow(cut, cut_schema).repartition("host", "part")
    sums_schema = T.StructType([rows.schema["host"], T.StructField("pages", T.LongType()), T.StructField("undecided", T.BooleanType())])

    def sums(table: pa.Table) -> pa.Table:
        """Of a part of a large host the number of different pages, and whether a block is in no article or main."""
        many = int(table.column("parts")[0].as_py() > 1)
        streams = {pa.decompress(t, n, _CODEC, asbytes=True).replace(b"\n", b" ") for t, n, e in zip(*(table.column(c).to_pylist() for c in ("blocks", "size", "evidence")), strict=True) if many and n and e}
        found = any(min(c, default=MAIN) < MAIN for c in table.column("containers").to_pylist())
        return pa.Table.from_arrays([table.column("host").slice(0, many).combine_chunks(), pa.array([len(streams)] * many, pa.int64()), pa.array([found] * many, pa.bool_())], sums_schema.fieldNames())

    hosts = pieces.groupBy("host", "part").applyInArrow(sums, sums_schema).groupBy("host").agg(F.sum("pages").alias("pages"), F.max("undecided").alias("undecided"))
    counts = pieces.join(F.broadcast(hosts) if few else hosts, "host", "left").groupBy("host", "part").applyInArrow(count, counts_schema)
    marks = counts.groupBy("host", "span").applyInArrow(merge, marks_schema)
    found = pieces.groupBy("host", "part").cogroup(marks.groupBy("host", "part")).applyInArrow(decide, out_schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))
