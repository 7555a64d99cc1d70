"""Main text of web pages: structure proposes the main area, a suffix array over the pages of each host removes what repeats.

A page is cut into blocks, each with a level: boilerplate by its tags or names (menus, headers, footers, notices, ...), loose,
or inside a named content area, <main>, or <article>. The highest level that holds enough of the words is the main area, with
the headline before it; a page that marks none has its loose blocks. The token streams of these areas, of all pages of a host,
are then concatenated and their suffixes sorted by prefix doubling, to the depth of REPEAT tokens: equal substrings of that
length lie side by side, so the pages that hold each are counted along the order. A longer repeat is a union of such
substrings, so all of it is covered and no more. A shorter block repeats as a whole.

A repeat goes where it stands on a share of the host's pages (SHARE) and on LEAST pages at least, more for a short block,
which may be a subheading, and in main areas, which are mostly prose: there a block must be a repeat for the most part. Pages of which frequent repeats make more than COPY of
the words give no evidence: copies of one article don't make its text boilerplate, whatever their number.

A large host is dealt in chunks of about CHUNK pages. What stands on a share of all its pages stands on that share of the pages of
one batch of chunks at least, so each batch's suffix array gives candidates, and only these are counted over the whole host:
one row per batch and candidate. Neither a large host nor a line on all its pages meets in one task, and texts are dealt once.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, staged
from quadrille.llm.words import WordTable, long_column, mixed, text_runs, windows

#: Tokens of a repeat, at least.
REPEAT = 12
#: The pages of a host that a repeat stands on: their least number, and share; and those of a whole block of fewer tokens.
LEAST, SHARE = 2, 0.2
SHORT_LEAST, SHORT_SHARE = 3, 0.5
#: In a main area every repeat must stand on as many pages as a short block, in a block of so many tokens at least, of which
#: repeats make this share: a phrase in the middle of prose is no boilerplate.
AREA_TOKENS, AREA_SHARE = 5, 0.8
#: A page with a larger share of frequent words is taken for a copy.
COPY = 0.5
#: Pages and characters of a chunk of a large host, about; and the characters whose suffixes are sorted together.
CHUNK, CHUNK_CHARS, BATCH_CHARS = 32, 4 << 20, 8 << 20
#: Pages that share one copy of a large host's repeats, where these are too many to send to every task (SENT numbers).
PAGES_PER_COPY, SENT = 256, 4_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</?([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)/?>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
COMMENT = re.compile(r"<!--.*()()()()\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
QUOTED = re.compile("\"[^\"]*\"|'[^']*'")
#: Names of elements, as the HTML standard has them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HIDDEN = frozenset("head noscript template svg math object canvas audio video select datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words in class and id that mark boilerplate, or a content area.
BAD_NAMES = frozenset("ad ads advert advertisement advertising adsense banner cookie cookies consent notice gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus share sharing social related promo sponsored sponsor newsletter subscribe popup modal overlay widget toolbar pagination pager skip login signup".split())
HEAD_NAMES = frozenset("header topbar siteheader".split())
#: Words beside a bad one with which a name is still nothing but boilerplate, as in comment-list or site-footer.
FRAME_NAMES = frozenset("article author avatar bar block body bottom box btn button buttons card col column container count entry form global group holder icon icons info inner item items left link links list lists main meta outer page panel post posts primary reply right row secondary section site slot stories text thread title top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD_NAMES = frozenset("article content post entry story main maincontent articlebody".split())
#: Words that make a name a state of its element, as in has-sidebar or comments-open.
STATES = frozenset("has have no not with without is open closed enabled disabled allow allowed".split())
LOOSE, AREA, MAIN, ARTICLE = range(4)
#: SOFT is boilerplate by a name with other words in it: an article or main inside is none. DOUBT is such by a part of a name only.
BAD, GONE, SOFT, DOUBT = -1, -2, -3, -4
#: What a part of a name marks is prose all the same from so many words on, if no more than this share of its characters are links.
PROSE_WORDS, PROSE_LINKS = 60, 0.25
#: The least share of a page's words (boilerplate aside) that a main area holds, by its level.
BULK = {AREA: 0.5, MAIN: 0.25, ARTICLE: 0.25}


def level_of(tag: str, attributes: str, now: int) -> int:
    """The level inside an element that opens at level ``now``."""
    if now == GONE or tag in HIDDEN:
        return GONE
    names: set[str] = set()
    whole: set[str] = set()
    framed: set[str] = set()
    role = ""
    if attributes and "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            # The id of a heading is its title.
            if name.lower() == "class" or name.lower() == "id" and tag not in HEADINGS:
                for name_ in value.split():
                    parts = set(re.split(r"[^a-z0-9]+", name_))
                    if not (parts & STATES and parts & BAD_NAMES):
                        names |= parts
                        whole.add(name_)
                        if parts & BAD_NAMES and all(p in BAD_NAMES or p in FRAME_NAMES or not p or p.isdigit() for p in parts):
                            framed |= parts
            elif name.lower() == "role":
                role = value
            elif name.lower() == "style" and "display:none" in value.replace(" ", ""):
                return GONE
    if "hidden" in (attributes or "") and re.search(r"(?:^|\s)hidden(?:\s|=|$)", QUOTED.sub("", attributes)):
        return GONE
    area = tag in ("article", "main") or role == "main"
    root = tag in ("body", "html")
    head = tag == "header" or names & HEAD_NAMES and not area and tag not in HEADINGS
    if now == BAD or tag in BOILERPLATE or role in ROLES or (whole & BAD_NAMES and not root) or head and now < AREA:
        return BAD
    if framed and not root and (now >= AREA and not area or area and framed & {"comment", "comments"}):
        return BAD
    if not area:
        if now == SOFT or framed and not root:
            return SOFT
        # In an article a part of a name says nothing: related-work, social-impact, share-price.
        if now == DOUBT or now < AREA and names & BAD_NAMES and not (root or tag in HEADINGS or tag in INLINE or tag == "p"):
            return DOUBT
    found = ARTICLE if tag == "article" else MAIN if tag == "main" or role == "main" else AREA if names & GOOD_NAMES and tag not in ("body", "html") else LOOSE
    return max(now, found)


def blocks(page: str) -> list[tuple[int, str]]:
    """(level, text) of each block with text, in page order; references decoded, white space as one space."""
    return [(level, text) for level, text, _ in marked_blocks(page)]


def marked_blocks(page: str) -> list[tuple[int, str, bool]]:
    """The blocks, and whether each is a headline (in <h1>)."""
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int]] = []
    level, pieces, at, end = LOOSE, [], 0, len(page)
    doubts: list[list[int]] = []  # of each element in doubt: words, characters, those in links, and its blocks
    linked = 0
    opened: Counter = Counter()
    last = page.rfind(">")  # no tag ends behind it

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                if level == DOUBT:
                    doubt = doubts[-1]
                    doubt[:3] = doubt[0] + len(text.split()), doubt[1] + sum(map(len, pieces)), doubt[2] + linked
                    doubt.append(len(out))
                out.append((BAD if level in (SOFT, DOUBT) else level, text, any(t == "h1" for t, _ in stack[-8:])))
            pieces.clear()
        linked = 0

    while at < end:
        m = TOKEN.search(page, at) if at <= last else COMMENT.search(page, at)
        if level != GONE:
            pieces.append(page[at : m.start() if m else end])
            if opened["a"]:
                linked += len(pieces[-1])
        if not m:
            break
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            continue
        closes = m[0][1] == "/"
        if tag in RAW and not closes:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = page.find(">", close.start()) + 1 if close else end
            at = at or end
            continue
        if closes:
            if tag not in INLINE:
                flush()
            while opened[tag]:  # else nothing to close; what is walked over is gone, so the walk is short
                name, before = stack.pop()
                opened[name] -= 1
                if name == tag:
                    if before != level:
                        flush()
                    level = before
                    break
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        inside = level_of(tag, m[2] or m[4] or "", level)
        if inside != level:
            flush()
            if inside == DOUBT:
                doubts.append([0, 0, 0])
        stack.append((tag, level))
        opened[tag] += 1
        level = inside
    flush()
    for n, chars, links, *places in doubts:
        if n >= PROSE_WORDS and links <= PROSE_LINKS * chars:
            for i in places:
                out[i] = (LOOSE, *out[i][1:])
    return out


def main_area(found: list[tuple[int, str, bool]]) -> tuple[int, list[int]]:
    """The level of a page's main area, and the places of its blocks: the highest level that holds its BULK of the words that are no boilerplate. An area without headline gets the last one before it."""
    sizes = [len(text.split()) for _, text, _ in found]
    of = lambda least: sum(n for n, (level, *_) in zip(sizes, found, strict=True) if level >= least)
    best = next((x for x in (ARTICLE, MAIN, AREA) if of(x) and of(x) >= BULK[x] * of(LOOSE)), LOOSE)
    at = [i for i, (level, *_) in enumerate(found) if level >= best]
    if best > LOOSE and not any(found[i][2] for i in at):
        before = [i for i in range(at[0]) if found[i][2] and found[i][0] >= LOOSE]
        at = before[-1:] + at
    return best, at


class Streams:
    """The token streams of pages, one after the other: a number per token (its host's own), and the block and page of each."""

    def __init__(self, table: WordTable, pages: list[list[str]], hosts: np.ndarray):
        words = [t.encode("utf-8", "surrogatepass").split() for texts in pages for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.block_page = np.repeat(np.arange(len(pages)), [len(texts) for texts in pages])
        index = table.indexes([w for ws in words for w in ws])
        self.block = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.page = self.block_page[self.block]
        salt = mixed(np.asarray(hosts, np.int64).view(np.uint64))
        self.tokens = mixed(table.hashes[index] + salt[self.page]) if len(index) else np.empty(0, np.uint64)
        table.trim()

    def suffix_ranks(self) -> np.ndarray:
        """For each place, where the suffixes that share its first REPEAT tokens begin in the suffix order.

        Prefixes are doubled from one token on. A suffix that no other shares its prefix with has its place already and is left alone.
        """
        n = len(self.tokens)
        order = np.argsort(self.tokens)
        rank, depth = np.empty(n, np.int64), 1
        rank[order] = _first_equal(self.tokens[order])
        while depth < REPEAT and n:
            step = min(depth, REPEAT - depth)
            live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(live):
                break
            behind = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
            key = rank[live] * (n + 1) + behind
            order = np.argsort(key)
            moved, before = live[order], rank[live[order]]
            after = rank.copy()
            after[moved] = before + _first_equal(key[order]) - _first_equal(before)
            rank, depth = after, depth + step
        return rank


def _first_equal(ordered: np.ndarray) -> np.ndarray:
    """For each entry of an ordered array, the place of the first equal one."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0)) if len(ordered) else np.empty(0, np.int64)


@dataclass(frozen=True)
class Runs:
    """The runs of REPEAT tokens of some streams and their whole shorter blocks: first token, length, page, group of equal ones, and the number that says the same everywhere (its last bit: a short block)."""

    start: np.ndarray
    length: np.ndarray
    page: np.ndarray
    group: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(s: Streams, order: bool = True) -> Runs:
        """With ``order``, equal runs are told by the suffix order; else groups are left out and only numbers count."""
        start = np.arange(max(0, len(s.tokens) - REPEAT + 1))
        start = start[start + REPEAT <= (s.starts + s.sizes)[s.block[start]]]
        number = windows(s.tokens, REPEAT)[start].view(np.int64) & ~1
        group = s.suffix_ranks()[start] if order and len(start) else np.empty(0, np.int64)
        parts = [(start, np.full(len(start), REPEAT), number)]
        for k in range(1, REPEAT):
            first = s.starts[s.sizes == k]
            if len(first):
                parts.append((first, np.full(len(first), k), windows(s.tokens[first[:, None] + np.arange(k)].T, k)[0].view(np.int64) | 1))
        start, length, number = (np.concatenate(x) for x in zip(*parts, strict=True))
        if order:
            short = np.unique(number[len(group) :], return_inverse=True)[1]
            group = np.concatenate([group, short + (group.max() + 1 if len(group) else 0)])
        return Runs(start, length, s.page[start] if len(start) else np.empty(0, np.int64), group, number)

    def pages(self, key: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each run, how many distinct pages (by their key) hold its group, of the runs in ``which``."""
        if not len(self.group):
            return np.empty(0, np.int64)
        n, size = int(key.max()) + 1, int(self.group.max()) + 1
        shared = np.bincount(self.group, minlength=size)[self.group] > 1
        some = which & shared
        pairs = np.unique(self.group[some] * n + key[self.page[some]])
        return np.where(shared, np.bincount(pairs // n, minlength=size)[self.group], which.astype(np.int64))

    def covers(self, which: np.ndarray, n: int) -> np.ndarray:
        """Which of the n tokens lie in a run of ``which``."""
        at, to = self.start[which], self.start[which] + self.length[which]
        return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(to, minlength=n + 1))[:n] > 0


def least_pages(pages, least: int, share: float):
    """The least number of pages that a repeat must stand on."""
    return np.maximum(least, np.ceil(np.asarray(pages) * share))


def enough(runs: Runs, n: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run on n of its host's pages: whether these are enough, and whether they are enough in main areas."""
    of = pages[runs.page]
    wide = n >= least_pages(of, SHORT_LEAST, SHORT_SHARE)
    return np.where(runs.number & 1 == 1, wide, n >= least_pages(of, LEAST, SHARE)), wide


def originals(s: Streams, runs: Runs, common: np.ndarray, n_pages: int) -> np.ndarray:
    """Which pages are no copies: common runs leave enough of them."""
    gone = np.bincount(s.page, runs.covers(common, len(s.tokens)), n_pages)
    return gone <= COPY * np.bincount(s.page, minlength=n_pages)


def remains(s: Streams, runs: Runs, sure: np.ndarray, wide: np.ndarray, pages: list[list[str]], area: np.ndarray) -> list[str]:
    """The text of each page without its repeats: in main areas only wide ones, and only from blocks of AREA_TOKENS or more that are repeats for the most part."""
    in_area = area[runs.page] if len(runs.page) else np.empty(0, bool)
    gone = runs.covers(sure & (wide | ~in_area), len(s.tokens))
    if len(gone):
        share = np.bincount(s.block, gone, len(s.sizes)) / np.maximum(s.sizes, 1)
        gone &= ~area[s.page] | ((s.sizes >= AREA_TOKENS) & (share >= AREA_SHARE))[s.block]
    hit = np.zeros(len(s.sizes), bool)
    hit[s.block[gone]] = True
    out, at = [], 0
    for texts in pages:
        kept = []
        for t in texts:
            if hit[at]:
                first = s.starts[at]
                t = " ".join([w for w, g in zip(t.split(), gone[first : first + s.sizes[at]].tolist(), strict=True) if not g])
            at += 1
            if t:
                kept.append(t)
        out.append(" ".join(kept))
    return out


def dealt(pages: DataFrame) -> DataFrame:
    """The pages with their host and chunk, and for hosts of more than one chunk their number of pages; equal chunks lie together, in order."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", F.xxhash64(F.coalesce(F.col("page_id").cast("string"), "url")).alias("page_key"), F.xxhash64(host).alias("host"))
    narrow = rows.select("host", "page_key", F.coalesce(F.length("html"), F.lit(0)).alias("chars"))
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("chars") / CHUNK_CHARS)).cast("long").alias("chunks")
    # Not known to be few, so the planner picks the join; a host of one chunk has no row.
    large = staged(narrow.groupBy("host").agg(F.countDistinct("page_key").alias("pages"), chunks).filter("chunks > 1"), "op1-hosts")
    return rows.join(large, "host", "left").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("page_key"), F.col("chunks"))).otherwise(0))


#: What a batch says: a page that is done, a page of a large host, or the candidates of a large host.
DONE, OPEN, CANDIDATES = range(3)
KINDS = "kind int, page_id long, url string, host long, page_key long, pages long, area boolean, first boolean, blocks array<string>, text string, numbers array<long>"


def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The main blocks of each page in place of its html (lines, deflated: all of them are dealt once), and whether they are a marked area."""
    for part in text_runs(batches, "html"):
        rows = []
        for page in part["html"].where(part["html"].notna(), ""):
            found = marked_blocks(page)
            best, at = main_area(found)
            rows.append((best > LOOSE, zlib.compress("\n".join(found[i][1] for i in at).encode("utf-8", "surrogatepass"), 3)))
        yield pd.DataFrame({"page_id": long_column(part["page_id"]), "url": part["url"], "host": part["host"], "page_key": part["page_key"], "pages": part["pages"], "chunk": part["chunk"], "area": [a for a, _ in rows], "blocks": [b for _, b in rows]})


def whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of about BATCH_CHARS that end where a chunk ends, so that no batch has a handful of a large host's pages. ``first``: the page's first row.

    Only a chunk that is longer than a batch by itself is cut, as where one page's rows repeat very often.
    """
    held: list[pd.DataFrame] = []
    size, chunk, seen = 0, None, set()
    for part in batches:
        first = []
        for h, c, key in zip(part["host"], part["chunk"], part["page_key"], strict=True):
            if (h, c) != chunk:
                chunk, seen = (h, c), set()
            first.append(key not in seen)
            seen.add(key)
        part = part.assign(first=first, blocks=[[t for t in zlib.decompress(b).decode("utf-8", "surrogatepass").split("\n") if t] for b in part["blocks"]])
        held.append(part)
        size += sum(len(t) for texts in part["blocks"] for t in texts)
        if size >= BATCH_CHARS:
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            cut = len(whole) - int(((whole["host"] == last["host"]) & (whole["chunk"] == last["chunk"])).sum()) or len(whole)
            yield whole.iloc[:cut]
            held = [whole.iloc[cut:]] if cut < len(whole) else []
            size = sum(len(t) for texts in whole["blocks"].iloc[cut:] for t in texts)
    if held and len(whole := pd.concat(held, ignore_index=True)):
        yield whole


def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sort the suffixes of each batch: pages of small hosts lose their repeats, large hosts get candidates."""
    words = WordTable()
    for part in whole_chunks(batches):
        texts, area = [list(t) for t in part["blocks"]], part["area"].to_numpy(bool)
        s = Streams(words, texts, part["host"].to_numpy())
        runs = Runs.of(s)
        key = np.unique(part["page_key"], return_inverse=True)[1]
        host, of_host = np.unique(part["host"], return_inverse=True)
        here = np.bincount(np.unique(of_host * (int(key.max()) + 1) + key) // (int(key.max()) + 1), minlength=len(host))[of_host]
        everywhere = np.ones(len(runs.start), bool)
        common, _ = enough(runs, n := runs.pages(key, everywhere), here)
        large = part["pages"].notna().to_numpy()
        told = originals(s, runs, common, len(texts))
        sure, wide = enough(runs, runs.pages(key, told[runs.page] if len(runs.page) else everywhere), here)
        out = part[["page_id", "url", "host", "page_key", "pages", "area", "first"]].assign(kind=np.where(large, OPEN, DONE), page_id=long_column(part["page_id"]), pages=long_column(part["pages"]))
        yield out.assign(blocks=[t if x else None for t, x in zip(texts, large, strict=True)], text=[None if x else t for t, x in zip(remains(s, runs, sure, wide, texts, area), large, strict=True)], numbers=None)
        # A share of the host's pages is that share of the pages of one batch at least; LEAST says nothing about a part of the pages.
        # A page whose rows repeat counts in the batch of its first row.
        firsts = part["first"].to_numpy(bool)
        n_here = np.bincount(of_host[firsts], minlength=len(host))[of_host]
        n, n_here = (runs.pages(key, firsts[runs.page]), n_here[runs.page]) if len(runs.page) else (n, n)
        maybe = (n > 0) & (n >= np.where(runs.number & 1 == 1, SHORT_SHARE, SHARE) * n_here) & (large[runs.page] if len(runs.page) else everywhere)
        if maybe.any():
            rows = pd.DataFrame({"host": part["host"].to_numpy()[runs.page[maybe]], "number": runs.number[maybe], "pages": part["pages"].to_numpy()[runs.page[maybe]]}).drop_duplicates(["host", "number"])
            found = rows.groupby("host").agg(numbers=("number", list), pages=("pages", "first")).reset_index()
            yield pd.DataFrame({"host": found["host"], "kind": CANDIDATES, "pages": long_column(found["pages"]), "numbers": found["numbers"]}).reindex(columns=[x.split()[0] for x in KINDS.split(", ")]).astype(object).where(lambda d: d.notna(), None)


def with_numbers(pages: DataFrame, numbers: DataFrame, how: str = "inner") -> DataFrame:
    """Join each page of a large host with its host's ``numbers`` (and ``wide``): sent to all tasks where they are few, else dealt by host and a part of its pages."""
    columns = [c for c in numbers.columns if c not in ("host", "pages")]
    total = numbers.agg(F.sum(F.size("numbers"))).first()[0] or 0
    if total <= SENT:
        return pages.join(F.broadcast(numbers.drop("pages")), "host", how)
    copies = F.ceil(F.col("pages") / PAGES_PER_COPY)
    each = numbers.select("host", *columns, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("part"))
    return pages.withColumn("part", F.pmod(F.xxhash64("page_key", F.lit(1)), copies)).join(each, ["host", "part"], how).drop("part")


def counted(pages: DataFrame, evidence: bool) -> DataFrame:
    """(host, numbers, wide) of the candidates in ``numbers`` that enough pages of their host hold; with ``evidence`` only pages that are no copies count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordTable()
        for part in text_runs(batches, "joined"):
            s = Streams(words, [list(t) for t in part["blocks"]], part["host"].to_numpy())
            runs = Runs.of(s, order=False)
            known = np.unique(np.concatenate([np.asarray(x, np.int64) for x in part.drop_duplicates("host")["numbers"]]))
            hit = np.isin(runs.number, known)
            counts = part["first"].to_numpy(bool)
            if evidence:
                counts = counts & originals(s, runs, hit, len(part))
            at = np.flatnonzero(hit & counts[runs.page]) if len(runs.page) else np.empty(0, np.int64)
            rows = pd.DataFrame({"page": runs.page[at], "number": runs.number[at]}).drop_duplicates()
            rows["host"], rows["pages"] = part["host"].to_numpy()[rows["page"]], part["pages"].to_numpy()[rows["page"]]
            yield rows.groupby(["host", "pages", "number"]).size().rename("n").reset_index()

    seen = pages.withColumn("joined", F.array_join("blocks", " ")).mapInPandas(run, "host long, pages long, number long, n long").groupBy("host", "pages", "number").agg(F.sum("n").alias("n"))
    least = lambda n, share: F.greatest(F.lit(n), F.ceil(F.col("pages") * share))
    wide, short = F.col("n") >= least(SHORT_LEAST, SHORT_SHARE), F.col("number").bitwiseAND(F.lit(1)) == 1
    kept = seen.filter(F.when(short, wide).otherwise(F.col("n") >= least(LEAST, SHARE)))
    return kept.groupBy("host", "pages").agg(F.collect_list("number").alias("numbers"), F.collect_list(F.when(wide, F.col("number"))).alias("wide"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty pages give an empty text; repeated rows repeat and are no distinct pages."""
    bound_batches(pages.sparkSession)
    rows = dealt(pages).mapInPandas(parsed, "page_id long, url string, host long, page_key long, pages long, chunk long, area boolean, blocks binary")
    found = staged(rows.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "page_key").mapInPandas(searched, KINDS), "op1-searched")
    open_ = found.filter(F.col("kind") == OPEN).select("page_id", "url", "host", "page_key", "pages", "area", "first", "blocks")
    numbers = found.filter(F.col("kind") == CANDIDATES).select("host", "pages", F.explode("numbers").alias("number")).distinct().groupBy("host", "pages").agg(F.collect_list("number").alias("numbers"))
    numbers = staged(numbers, "op1-candidates")
    for name in ("common", "sure"):  # the second count leaves copies out
        if not numbers.isEmpty():
            numbers = staged(counted(with_numbers(open_, numbers), evidence=name == "sure"), f"op1-{name}")
    if "wide" not in numbers.columns or numbers.isEmpty():
        text = open_.select("page_id", "url", F.array_join("blocks", " ").alias("text"))
    else:

        @F.pandas_udf("string")
        def cut(blocks_: pd.Series, host: pd.Series, area: pd.Series, sure: pd.Series, wide: pd.Series) -> pd.Series:
            words, out = WordTable(), []
            for i, texts in enumerate(blocks_):
                s = Streams(words, [list(texts)], host.iloc[i : i + 1].to_numpy())
                runs = Runs.of(s, order=False)
                out += remains(s, runs, np.isin(runs.number, sure.iloc[i]), np.isin(runs.number, wide.iloc[i]), [list(texts)], area.iloc[i : i + 1].to_numpy(bool))
            return pd.Series(out, dtype=object)

        all_ = with_numbers(open_, numbers, "left")
        text = all_.select("page_id", "url", F.when(F.col("numbers").isNull(), F.array_join("blocks", " ")).otherwise(cut("blocks", "host", "area", "numbers", "wide")).alias("text"))
    both = found.filter(F.col("kind") == DONE).select("page_id", "url", "text").union(text)
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
