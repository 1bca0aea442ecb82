"""Main text of web pages, with boilerplate found by a suffix array of each host.

A page is read into blocks (text between block tags) with the kind of region its
markup gives them: main (article, main), boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, hidden parts) or open.  The
pages of a host meet in one group; their token streams are concatenated, a page's
end being a token of its own, and a suffix array ordered to ``run`` tokens is
built by prefix doubling.  Neighbours in it that agree to that depth are
substrings of ``run`` or more tokens.  One that pages of distinct contents hold is a
repeated run, and the tokens it covers are marked.

Pages of one content (their words outside marked boilerplate are equal) are one
page to the runs.  Near copies are told from boilerplate by what they share: of every
run the least and the greatest content that hold it are known.  The content that is so
for most of a page's runs is taken as a copy of the page, not as a page with the same
boilerplate, if these runs cover COPY_NUM of COPY_DEN parts of what the page's other
runs leave.  Of two pages of one size that is a similarity of 0.75, where near copies
begin: a page of more boilerplate than that is a near copy of another one like it,
and keeps its text; any page of less loses its boilerplate.

Open blocks that repeated runs cover for the greater part are boilerplate; the
unique ones are kept.  The markup then has the last word where it speaks: blocks
of an article stay though another page copies them, marked regions go, and open
blocks go where the page has an article.

A host of more than ``group_pages`` pages or ``group_bytes`` is dealt by a hash of the row into
groups of about that size, so no task holds a hot host.  Runs that groups of it
share are found in two shuffles and handed back, and the result does not depend on
the groups: of every window of ``run`` tokens the least hash of the n-grams of half
that size in it is exchanged first (about a fifth as many as windows), and windows
whose least n-gram two groups share are exchanged with their least and greatest
content.  Hashes have 64 bits.  Texts move packed and move once: those of hot hosts are
checkpointed where their groups lie, so that both rounds and the choice find them there;
those of other hosts are chosen where they meet and are not stored.

Nulls and edges: a null or empty html has empty text; pages of a null url are one
host; unclosed and stray tags are tolerated; repeated rows give repeated results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosepath.llm.common import release, ship
from dosepath.plans.staging import placed, stage

ship(__name__)

OPEN, MAIN, BOILER = 0, 1, 2
MOST_BROADCAST = 100_000
NO_ROWS = pa.table({"data": pa.array([], pa.binary())})
PACK_BYTES = 8 << 20  # of html that is packed at once
GROUPS_A_TASK = 8  # of hot hosts, taken one after the other
SENT_AT_ONCE = 4_000_000  # hashes that a task holds before it sends them
COPY_NUM, COPY_DEN = 6, 7  # shared parts s of two equal sizes are alike by s / (2 - s): 0.75 at 6/7
MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An open tag of the left closes an open one of the right.
CLOSES = {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
MAIN_TAGS = {"article", "main"}
BOILER_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "comment comments disqus reply replies pagination pager toolbar widget widgets login signup search copyright skip".split()
)
SMALL_ARTICLES = set("comment comments reply replies teaser teasers".split())  # an article element of such a name is no article
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


def region(tag: str, attributes: str, inside: int) -> int | None:
    """The kind of region a tag opens, or None."""
    if tag in MAIN_TAGS:
        kind = MAIN
    elif tag in BOILER_TAGS:
        kind = None if tag == "header" and inside == MAIN else BOILER  # an article's own header holds its title
    else:
        kind = None
    if not attributes or tag in ("html", "body"):
        return kind
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            if value in BOILER_ROLES:
                return BOILER
            if value in ("main", "article"):
                return MAIN
        elif name in ("class", "id"):
            names = set(re.split(r"[^a-z0-9]+", value))
            if (kind != MAIN and BOILER_NAMES & names) or (tag == "article" and SMALL_ARTICLES & names):
                return BOILER
        elif (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true"):
            return BOILER
    if re.search(r"(?<![\w-])hidden(?![\w=-])", ATTRIBUTE.sub("", attributes)):
        return BOILER
    return kind


def blocks(page: str) -> list[tuple[int, list[str]]]:
    """(region, words) of the blocks of a page, in order."""
    out: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = []  # tag and the region inside it
    text: list[str] = []
    kind, at = OPEN, 0

    def flush() -> None:
        words = "".join(text).split()
        text.clear()
        if words:
            out.append((kind, words))

    for m in MARK.finditer(page):
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag not in INLINE:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                new = stack[-1][1] if stack else OPEN
                if new != kind:
                    flush()
                kind = new
        elif tag not in VOID:
            shut = CLOSES.get(tag, ())
            while stack and stack[-1][0] in shut:
                stack.pop()
            inside = stack[-1][1] if stack else OPEN
            own = region(tag, m.group(4), inside)
            new = inside if own is None else own
            if new != kind:
                flush()
            kind = new
            stack.append((tag, kind))
    text.append(html.unescape(page[at:]))
    flush()
    return out


def run_classes(tokens: np.ndarray, run: int) -> np.ndarray:
    """For each suffix the rank of its first ``run`` tokens: equal ranks, equal substrings."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    depth = 1
    while depth < run:  # prefix doubling, to ``run`` tokens
        step = min(depth, run - depth)
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + after, return_inverse=True)
        depth += step
    return rank


def holders(classes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and the greatest of ``of`` (a number for each) in its class."""
    suffixes = np.argsort(classes, kind="stable")
    ordered = classes[suffixes]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.diff(np.r_[first, len(classes)])
    out = []
    for reduce in (np.minimum.reduceat, np.maximum.reduceat):
        found = np.empty(len(classes), of.dtype)
        found[suffixes] = np.repeat(reduce(of[suffixes], first), times)
        out.append(found)
    return out[0], out[1]


def covered_by(starts: np.ndarray, run: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens runs from ``starts`` cover."""
    edge = np.zeros(n + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return edge.cumsum()[:n] > 0


def repeated_runs(tokens: np.ndarray, pages: np.ndarray, run: int) -> np.ndarray:
    """Which tokens a substring of ``run`` tokens covers that occurs on two distinct pages.

    ``pages`` numbers the page of each token; page ends are unique negative tokens.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    low, high = holders(run_classes(tokens, run), pages)
    return covered_by(np.flatnonzero(low != high), run, n)


def shared_with_others(content: int, low: np.ndarray, high: np.ndarray, run: int) -> np.ndarray:
    """Which windows of a page of this content occur on pages that are no copies of it.

    low, high: the least and the greatest content that hold the window at each token.
    """
    found, n = np.zeros(len(low), bool), len(low)
    for side in (low, high):
        other = np.flatnonzero(side != content)
        if len(other):
            names, at, times = np.unique(side[other], return_inverse=True, return_counts=True)
            most = at == times.argmax()
            ours, all_ = (int(covered_by(x, run, n).sum()) for x in (other[most], other))
            copy = ours * COPY_DEN >= (n - (all_ - ours)) * COPY_NUM
            found[other[~most] if copy else other] = True
    return found


def numbered(words: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each page's words as numbers, and the hash of each number's word."""
    ids: dict[str, int] = {}
    pages = [np.fromiter([ids.setdefault(w, len(ids)) for w in page], np.int64, len(page)) for page in words]
    return pages, np.frombuffer(b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in ids]), np.uint64)


def window_hashes(pages: list[np.ndarray], own: np.ndarray, run: int) -> list[np.ndarray]:
    """For each page the hashes of its windows of ``run`` words, in order."""
    out = []
    for page in pages:
        n, each = max(0, len(page) - run + 1), own[page] if len(page) else np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(run if n else 0):
            total = total * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
        out.append(total.view(np.int64))
    return out


def least_hashes(pages: list[np.ndarray], own: np.ndarray, run: int) -> list[np.ndarray]:
    """For each page's windows of ``run`` words the least hash of the n-grams of half that size in it."""
    size = max(1, run // 2)
    out = []
    for h in window_hashes(pages, own, size):
        n = max(0, len(h) - (run - size))
        least = h[:n]
        for j in range(1, run - size + 1 if n else 0):
            least = np.minimum(least, h[j : j + n])
        out.append(least)
    return out


def content_of(kinds: list[int], texts: list[str]) -> int:
    """The hash of a page's words outside marked boilerplate, or of all where there are none."""
    own = [t for k, t in zip(kinds, texts, strict=True) if k != BOILER] or texts
    return int.from_bytes(hashlib.blake2b("\x00".join(own).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def words_of(page: list[str]) -> list[str]:
    return [w for block in page for w in block.split("\x00")]


def packed(rows: dict) -> bytes:
    """Pages (page_id, url, kinds, blocks) as one compressed Arrow stream."""
    table = pa.table({"page_id": pa.array(rows["page_id"], pa.int64()), "url": pa.array(rows["url"], pa.string()), "kinds": pa.array(rows["kinds"], pa.list_(pa.int8())), "blocks": pa.array(rows["blocks"], pa.list_(pa.string()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"))).read_all()


def unpacked(group: pa.Table) -> pa.Table:
    """Pages of packed rows, in an order that does not depend on the rows'."""
    pages = pa.concat_tables([opened(x.as_py()) for x in group.column("pages")])
    return pages.sort_by([("page_id", "ascending"), ("url", "ascending")])


def salt_of(host: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.int64)


def by_bucket(host: str, part: int, rows: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, host, part, bytes) of rows whose first column is a hash."""
    of = (rows[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(of) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(of)], strict=True):
        yield int(of[order[lo]]), host, part, rows[order[lo:hi]].tobytes()


SENT = "bucket long, host string, part long, data binary"


def sent(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "host", "part", "data"), cols, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)})


def met(group: pa.Table, width: int) -> pa.Table:
    """Of a bucket's rows (hash, least, greatest ... of ``width`` numbers) those whose hash two groups hold, for each of these groups."""
    names: dict[tuple, int] = {}
    at, rows = [], []
    for r in group.to_pylist():
        own = np.frombuffer(r["data"], np.int64).reshape(-1, width)
        at.append(np.full(len(own), names.setdefault((r["host"], r["part"]), len(names))))
        rows.append(own)
    g, x = np.concatenate(at), np.concatenate(rows)
    order = np.lexsort((g, x[:, 0]))
    g, x = g[order], x[order]
    first = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
    times = np.diff(np.r_[first, len(x)])
    several = np.repeat(np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first), times)
    if width > 1:
        x = np.stack([x[:, 0], np.repeat(np.minimum.reduceat(x[:, 1], first), times), np.repeat(np.maximum.reduceat(x[:, 2], first), times)], axis=1)
    new = np.r_[True, (x[1:, 0] != x[:-1, 0]) | (g[1:] != g[:-1])] & several
    g, x = g[new], x[new]
    order = np.argsort(g, kind="stable")
    edges = np.searchsorted(g[order], np.arange(len(names) + 1))
    out = [(0, host, part, x[order[edges[k] : edges[k + 1]]].tobytes()) for (host, part), k in names.items() if edges[k] < edges[k + 1]]
    release()
    return sent(out)


PACKED = "host string, part long, pages binary"
OUT = "page_id long, url string, text string, n_chars long, n_tokens long, n_repeated long, n_decided long"


def extracted(pages: DataFrame, *, run: int = 16, share: float = 0.5, group_pages: int = 20_000, group_bytes: int = 16 << 20) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    ``run``: tokens of a repeated run; ``share``: part of an open block that runs
    must cover to make it boilerplate; ``group_pages``, ``group_bytes``: pages and
    characters of html of a group of a host.  Returns page_id, url, text, n_chars,
    n_tokens (of visible blocks), n_repeated (of them in repeated runs), n_decided
    (open blocks about which the runs decided).
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    slim = slim.withColumn("host", host)
    parts = F.ceil(F.greatest(F.count("*") / group_pages, F.sum(F.coalesce(F.length("html"), F.lit(0))) / group_bytes))
    hot = stage(slim.groupBy("host").agg(parts.alias("parts"), F.count("*").alias("n")).where("parts > 1"), "hosts")
    hosts, hot_pages, hot_groups = hot.agg(F.count("*"), F.sum("n"), F.sum("parts")).collect()[0]
    buckets = max(32, (hot_pages or 0) // 5000)
    if hosts <= MOST_BROADCAST:  # names of hosts, some MB at most; more are joined by a shuffle
        hot = F.broadcast(hot)
    hot = hot.drop("n")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[str, list]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(*key, packed(x)) for key, x in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["host", "part", "pages"])

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for r in b.slice(lo, 64).to_pylist():
                    found = blocks(r["html"] or "")
                    own = held.setdefault((r["host"], r["part"]), {"page_id": [], "url": [], "kinds": [], "blocks": []})
                    for c, v in zip(own.values(), (r["page_id"], r["url"], [k for k, _ in found], ["\x00".join(w) for _, w in found]), strict=True):
                        c.append(v)
                    size += len(r["html"] or "")
                if size > PACK_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()
        release()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least n-gram hashes of a task's pages, each once a group, by bucket."""
        held: dict[tuple, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [x for (host, part), some in held.items() for x in by_bucket(host, part, np.unique(np.concatenate(some) ^ salt_of(host))[:, None], buckets)]
            held.clear()
            yield from sent(rows).to_batches()

        for b in batches:
            for r in b.to_pylist():
                page_words = [words_of(x) for x in opened(r["pages"]).column("blocks").to_pylist()]
                own = held.setdefault((r["host"], r["part"]), [np.zeros(0, np.int64)])
                own.append(np.unique(np.concatenate([np.zeros(0, np.int64), *least_hashes(*numbered(page_words), run)])))
                size += len(own[-1])
                if size > SENT_AT_ONCE:
                    yield from out()
                    size = 0
        yield from out()
        release()

    def candidates(key: tuple, group: pa.Table, others: pa.Table) -> pa.Table:
        """Windows of a group whose least n-gram another group has, with their least and greatest content."""
        if not group.num_rows or not others.num_rows:
            return sent([])
        name, part = key[0].as_py(), key[1].as_py()
        salt, far = salt_of(name), np.unique(np.frombuffer(b"".join(others.column("data").to_pylist()), np.int64))
        own = unpacked(group)
        kinds, texts = own.column("kinds").to_pylist(), own.column("blocks").to_pylist()
        words = numbered([words_of(x) for x in texts])
        hashes, contents = [], []
        for kind, text, window, small in zip(kinds, texts, window_hashes(*words, run), least_hashes(*words, run), strict=True):
            small = small ^ salt
            keep = far[np.minimum(np.searchsorted(far, small), len(far) - 1)] == small
            hashes.append(window[keep] ^ salt)
            contents.append(np.full(int(keep.sum()), content_of(kind, text)))
        h, c = np.concatenate(hashes), np.concatenate(contents)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        rows = np.stack([h[first], np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)], axis=1) if len(h) else np.zeros((0, 3), np.int64)
        found = sent(list(by_bucket(name, part, rows, buckets)))
        release()
        return found

    def chosen(key: tuple, group: pa.Table, others: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in OUT.split(", ")]
        if not group.num_rows:
            return pa.table({n: pa.array([], pa.string() if n in ("url", "text") else pa.int64()) for n in names})
        group = unpacked(group)
        kinds, texts = group.column("kinds").to_pylist(), group.column("blocks").to_pylist()
        words, own_hash = numbered([words_of(x) for x in texts])
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.r_[0, sizes.cumsum()]
        tokens = np.empty(ends[-1], np.int64)
        content = np.array([content_of(k, t) for k, t in zip(kinds, texts, strict=True)], np.int64)
        for p, w in enumerate(words):
            tokens[ends[p] : ends[p + 1] - 1] = w
            tokens[ends[p + 1] - 1] = -1 - p
        low, high = holders(run_classes(tokens, run), np.repeat(content, sizes))
        if others.num_rows:
            far = np.frombuffer(b"".join(others.column("data").to_pylist()), np.int64).reshape(-1, 3)
            far = far[np.argsort(far[:, 0], kind="stable")]
            salt = salt_of(key[0].as_py())
            for begin, own in zip(ends, window_hashes(words, own_hash, run), strict=False):
                own = own ^ salt
                at = np.minimum(np.searchsorted(far[:, 0], own), len(far) - 1)
                hit = np.flatnonzero(far[at, 0] == own)
                low[begin + hit] = np.minimum(low[begin + hit], far[at[hit], 1])
                high[begin + hit] = np.maximum(high[begin + hit], far[at[hit], 2])
        out: list[list] = [[], [], [], [], []]
        for p, (kind, page) in enumerate(zip(kinds, texts, strict=True)):
            n, open_page, keep, at, decided = len(words[p]), MAIN not in kind, [], 0, 0
            mine = slice(ends[p], ends[p] + n)
            marks = np.r_[0, covered_by(np.flatnonzero(shared_with_others(content[p], low[mine], high[mine], run)), run, n).cumsum()]
            for k, block in zip(kind, page, strict=True):
                size = block.count("\x00") + 1
                repeated = marks[at + size] - marks[at] >= share * size
                at += size
                decided += k == OPEN and open_page
                if k == MAIN or (k == OPEN and open_page and not repeated):
                    keep.append(block.replace("\x00", " "))
            text = " ".join(keep)
            for o, x in zip(out, (text, len(text), n, int(marks[-1]), decided), strict=True):
                o.append(x)
        release()
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(out[0], pa.string()), **{n: pa.array(o, pa.int64()) for n, o in zip(names[3:], out[1:], strict=True)}})

    lone = slim.join(hot, "host", "left_anti").withColumn("part", F.lit(0).cast("long"))
    lone = lone.mapInArrow(parsed, PACKED).groupBy("host", "part").applyInArrow(lambda key, group: chosen(key, group, NO_ROWS), OUT)
    if not hosts:
        return lone
    # rows are numbered as they are read, before the join, so that a task run again deals them alike
    several = slim.withColumn("at", F.monotonically_increasing_id()).join(hot, "host")
    several = several.withColumn("part", F.pmod(F.xxhash64("page_id", "url", "at"), F.col("parts"))).drop("at", "parts")
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hot_groups // GROUPS_A_TASK))
    groups = placed(several.mapInArrow(parsed, PACKED), tasks, "host", "part")
    grams = groups.mapInArrow(least, SENT).repartition("bucket").groupBy("bucket").applyInArrow(lambda key, group: met(group, 1), SENT)
    windows = groups.groupBy("host", "part").cogroup(grams.groupBy("host", "part")).applyInArrow(candidates, SENT)
    windows = stage(windows.repartition("bucket").groupBy("bucket").applyInArrow(lambda key, group: met(group, 3), SENT), "runs")
    return lone.unionByName(groups.groupBy("host", "part").cogroup(windows.groupBy("host", "part")).applyInArrow(chosen, OUT))
