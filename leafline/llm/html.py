"""Main text of web pages: structure, and a host-wide suffix array over what structure cannot settle.

A page is cut into blocks, each in a zone: ``main`` (inside an article or main element),
``furniture`` (menus, headers, footers, sidebars, notices, adverts, forms, comments), ``suspect``
(a compound class such as ``news-footer`` hints at furniture) or ``open`` (anything else).
Furniture goes by structure. The rest is judged by what repeats on distinct pages of its host:

* The tokens of a page's open and suspect blocks are concatenated, and the suffixes of all pages of
  a host are sorted. Neighbours' longest common prefixes give, for each suffix, the longest run that
  another page shares; runs of ``run`` tokens or more cover what they span. Blocks of which half or
  more is covered are boilerplate, what is unique stays. Equal suffixes are one entry of the array,
  so the commonest is reduced before it is shuffled; the array is dealt over the cluster by
  host and the first ``run`` tokens, as no shorter run counts, so that no host is one task. Suffixes
  are cut at ``depth`` tokens: a longer run is covered by the suffixes that follow.
* The tokens of articles have an array of their own, in which a run counts where ``share`` of the
  host's pages, three at least, have it: what a site sets into its articles. Neighbours' common
  prefixes give the pages of each run of ``run`` to ``depth`` tokens, and a block shorter than
  that is a run with the marks of its two ends. Blocks of which half or more is covered go; but a
  page half or more of whose article would go is a copy, and is kept whole. A run can stand on so
  many pages only if each of its tokens does, so the tokens of each host are counted first, and
  suffixes that begin with ``run`` such tokens are sorted, up to the first that is none: no run is
  lost. Counts of tokens are bounds from above, as rare ones are left out in each task by a
  stated number that is added again.

Exact copies of a page count as one page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import like, maybe_broadcast, released, staged
from .urls import host_of

#: Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noframes noembed".split())
#: Elements that are never part of an article.
FURNITURE = frozenset("nav footer aside form noscript template iframe object svg canvas button select dialog menu head".split())
#: Class, id and role values that mark what is not the article.
MARKS = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie
    cookies complementary disqus footer header login masthead menu modal nav navbar navigation newsletter notice
    pagination popup promo related respond search share sharing sidebar social sponsor sponsored subscribe toolbar
    widget""".split()
)
#: Marks of readers' comments, the only ones that take an article out of another.
REPLIES = frozenset("comment comments respond disqus".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Tokens of hosts that a task counts before it hands its counts on, so that its memory has a bound.
HELD = 500_000
MASK = (1 << 64) - 1

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: From a tag's name to its end, with signs in quotes passed over.
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")


def marks_of(attributes: str) -> tuple[set[str], bool]:
    """Class, id and role values that are marks, and whether a compound one holds a mark."""
    whole: set[str] = set()
    part = False
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            for value in (m[1] or m[2] or m[3] or "").lower().split():
                if value in MARKS:
                    whole.add(value)
                elif any(p in MARKS for p in PART.findall(value)):
                    part = True
    return whole, part


def tags(html: str):
    """(text before, name, is an end tag, attributes, where it ends) of each tag, in one pass; at last a name of None.

    A ``<`` that begins no finished tag or comment is text. Once a quote turns out never to end,
    quotes no longer hide a tag's end, so no part of a page is read again and again.
    """
    at = start = 0
    last, quoted = html.rfind(">"), True
    while (lt := html.find("<", at)) >= 0 and (lt < last or html.startswith("<!--", lt)):
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            stop = len(html) if stop < 0 else stop + 3
            yield html[start:lt], "", False, "", stop
            start = at = stop
            continue
        end = html.startswith("</", lt)
        name = NAME.match(html, lt + 1 + end)
        if name is None:
            if html.startswith(("<!", "<?"), lt):
                stop = html.find(">", lt) + 1
                yield html[start:lt], "", False, "", stop
                start = at = stop
            else:
                at = lt + 1
            continue
        rest = REST.match(html, name.end()) if quoted else None
        if rest is None:
            quoted = False
        stop = rest.end() if rest else html.find(">", name.end()) + 1
        jump = yield html[start:lt], name[0].lower(), end, html[name.end() : stop - 1], stop
        start = at = jump or stop
    yield html[start:], None, False, "", len(html)


def parse(html: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page, in order; empty blocks are left out. Time is linear in the page."""
    html = html or ""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and the zone around each
    opened: Counter = Counter()
    zone, parts = "open", []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                out.append((zone, text))

    found, jump = tags(html), None
    while True:
        text, name, end, attributes, stop = found.send(jump)
        jump = None
        if text:
            parts.append(text)
        if name is None:
            break
        if not name:
            continue
        if end:
            if name in BLOCKS:
                flush()
            if opened[name]:  # an unknown end tag ends nothing
                while True:
                    top, around = stack.pop()
                    opened[top] -= 1
                    if top == name:
                        break
                if around != zone:
                    flush()
                    zone = around
            continue
        if name in RAW:
            close = CLOSE[name].search(html, stop)
            jump = close.end() if close else len(html)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        # A paragraph or list item ends where the next block begins; only zones matter here.
        inside = zone
        if zone != "furniture":
            whole, part = marks_of(attributes)
            if name in ("article", "main"):
                reply = name == "article" and (opened["article"] or (opened["main"] and whole & REPLIES))
                inside = "furniture" if reply else "main"
            elif name in FURNITURE or name == "header" and zone != "main":
                inside = "furniture"
            elif name not in ("body", "html") and (name in BLOCKS or name == "span"):
                inside = "furniture" if whole else "suspect" if part else zone
        if inside != zone:
            flush()
        if inside != zone or name in ("article", "main", "div", "section") or name in FURNITURE or stack and stack[-1][0] == name:
            stack.append((name, zone))  # the last two keep end tags of nested elements of one name apart
            opened[name] += 1
            zone = inside
    flush()
    return out


def stream_of(blocks: list[tuple[str, str]]) -> list[str]:
    """Tokens of the blocks that the suffix array judges."""
    return [w for zone, text in blocks if zone in ("open", "suspect") for w in text.split(" ")]


def shared_lengths(entries):
    """Each of the sorted suffixes (host, tokens, least and largest page that has them) with the tokens that a suffix of another page shares.

    The nearest neighbour of another page shares most. Backwards, the last two pages met are
    enough, each with the least common prefix since then. Forwards, an entry waits until another
    page comes, so only neighbours of one page ever wait.
    """
    seen: dict[int, int] = {}
    waiting: list[list] = []  # entry, its longest, and what it shares with the entry before
    before = None

    def settle(low: int):
        for w in reversed(waiting):
            w[1] = max(w[1], low)
            low = min(low, w[2])
        out = [(w[0], w[1]) for w in waiting]
        waiting.clear()
        return out

    for entry in entries:
        host, tokens, a, b = entry
        n = 0
        if before is not None and before[0] == host:
            for p, q in zip(tokens, before[1]):
                if p != q:
                    break
                n += 1
        seen = {page: min(n, m) for page, m in seen.items()} if n else {}
        if waiting and (n == 0 or a != b or waiting[-1][0][2:] != (a, b)):
            yield from settle(n)
        own = len(tokens) if a != b else 0
        waiting.append([entry, max([own, *(m for page, m in seen.items() if page != a or a != b)]), n])
        for page in (a, b):
            seen.pop(page, None)
            seen[page] = len(tokens)
        while len(seen) > 2:
            seen.pop(next(iter(seen)))
        before = entry
    yield from settle(0)


def covered_blocks(blocks: list[tuple[str, str]], runs: list[tuple[int, int]], covered: float, zones=("open", "suspect")) -> list[bool]:
    """For each block of the zones, whether runs (first token, tokens) cover that share of it."""
    n = sum(text.count(" ") + 1 for zone, text in blocks if zone in zones)
    step = [0] * (n + 1)
    for at, size in runs:
        step[at] += 1
        step[min(n, at + size)] -= 1
    total, held = [0], 0
    for x in step[:n]:
        held += x
        total.append(total[-1] + (held > 0))
    out, at = [], 0
    for zone, text in blocks:
        if zone in zones:
            size = text.count(" ") + 1
            out.append(total[at + size] - total[at] >= covered * size)
            at += size
    return out


def _suffix_array(batches, run: int):
    """Sorted rows (host, tokens, a, b) to those of which another page shares ``run`` tokens or more, with how many."""
    import pyarrow as pa

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def table(keep):
        cols = list(zip(*keep)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int32())], names=["host", "head", "n"])

    keep = []
    for (host, tokens, _, _), n in shared_lengths(rows()):
        if n >= run:
            keep.append((host, tokens, n))
            if len(keep) == 1000:
                yield table(keep)
                keep = []
    yield table(keep)


def run_lengths(head, run: int):
    """Lengths at which a suffix of an article counts as a run; one that begins with a mark is a whole short block."""
    return (len(head),) if head[0] == "" else range(run, len(head) + 1)


def article_suffixes(text: str, known: set[str], run: int, depth: int):
    """(first token, least length at which this page has not had it before, head) of the suffixes of an article that can count.

    text: blocks, one a line. known: at least those tokens that stand on enough pages of the host.
    """
    if not known:
        return
    tokens = text.split()
    flags = bytes(map(known.__contains__, tokens))
    seen: set[tuple] = set()

    def entry(at: int, head: tuple):
        lengths = run_lengths(head, run)
        fresh = next((n for n in lengths if head[:n] not in seen), len(head) + 1)
        seen.update(head[:n] for n in lengths if n >= fresh)
        return at, fresh, head

    for m in re.finditer(rb"\x01{%d,}" % run, flags):
        for at in range(m.start(), m.end() - run + 1):
            yield entry(at, tuple(tokens[at : min(at + depth, m.end())]))
    at = 0
    for block in text.split("\n"):
        size = block.count(" ") + 1
        if size < run and all(flags[at : at + size]):
            yield entry(at, ("", *tokens[at : at + size], ""))
        at += size


def common_runs(entries, run: int):
    """(host, run) of the runs that enough pages have, from sorted suffixes (host, head, fresh, pages, pages asked for).

    A run is a prefix that neighbours have in common; its pages are known when a neighbour comes
    that does not have it. A page is counted once for each length, by its first suffix of it.
    """
    pages: dict[int, int] = {}
    before, needed = None, 0

    def closed(keep: int):
        for n in [n for n in pages if n > keep]:
            if pages.pop(n) >= needed:
                yield before[0], before[1][:n]

    for host, head, fresh, n, need in entries:
        same = 0
        if before is not None and before[0] == host:
            for p, q in zip(head, before[1]):
                if p != q:
                    break
                same += 1
        yield from closed(same)
        before, needed = (host, head), need
        for size in run_lengths(head, run):
            if fresh <= size:
                pages[size] = pages.get(size, 0) + n
    yield from closed(0)


def _article_array(batches, run: int):
    """Rows (host, run) of ``common_runs``."""
    import pyarrow as pa

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    found = common_runs(rows(), run)
    while part := list(islice(found, 1000)):
        hosts, runs = zip(*part)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(runs, pa.list_(pa.string()))], names=["host", "head"])


def _token_counts(batches, share: float):
    """Rows (host, key, pages over the slack, false) of tokens, and (host, key of no token, slack, true): a token that is left out is on so many pages at most."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest as hashed

    count: dict[int, Counter] = {}
    pages: Counter = Counter()
    held = 0

    def tables():
        rows = []
        for host, c in count.items():
            c[""] = 2 * (slack := int(share * pages[host] / 2))
            for w, n in c.items():
                if n > slack or not w:
                    key = hashed(w, host & MASK)
                    rows.append((host, key - (1 << 64) if key >> 63 else key, n - slack, not w))
        count.clear()
        pages.clear()
        for at in range(0, len(rows), 10_000):
            cols = zip(zip(*rows[at : at + 10_000]), [pa.int64()] * 3 + [pa.bool_()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["host", "key", "n", "none"])

    seen: set[tuple[int, int]] = set()
    for b in batches:
        for host, stream, text in zip(*(c.to_pylist() for c in b.columns)):
            if (host, stream) in seen:
                continue
            seen.add((host, stream))
            c = count.setdefault(host, Counter())
            held -= len(c)
            c.update(set(text.split()))
            pages[host] += 1
            held += len(c)
            if held > HELD:
                yield from tables()
                held = 0
    yield from tables()
    released()


def _merged(batches):
    """Rows (row, runs) with runs that touch made one, so that a copy's are few."""
    import pyarrow as pa

    for b in batches:
        out = []
        for runs in b.column(1):
            spans: list[dict] = []
            for x in runs.as_py():
                if spans and x["i"] <= (end := spans[-1]["i"] + spans[-1]["n"]):
                    spans[-1]["n"] = max(end, x["i"] + x["n"]) - spans[-1]["i"]
                else:
                    spans.append(x)
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.column(1).type)], names=["row", "inner"])


def _bits(keys: DataFrame) -> bytes:
    """A table of bits of the column key; it grows with the rows up to 8 MB, and fuller ones only let more through."""
    import numpy as np

    size = 1 << min(26, max(16, (16 * keys.count()).bit_length()))
    at = F.col("key").bitwiseAND(size - 1)
    words = keys.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(key & {size - 1} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, "<i8")
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    *, run: int = 5, depth: int = 8, covered: float = 0.5, share: float = 0.5,
) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    Beside an article, open and suspect blocks stay only where the host has other pages to tell
    that they are unique; on the only page of a host the article alone is the text.

    Defined cases: null or empty html has empty text; pages without article or main element give
    their open blocks; a null URL belongs to the host of empty name; elements that never end
    reach to the end of the page; repeated rows repeat; other columns are not read; an empty table
    gives no rows.
    """

    def read(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest as hashed

        kind = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                rows = [[(z, t) for z, t in parse(html.as_py()) if z != "furniture"] for html in part.column(4)]
                streams = [hashed("\n".join(t for _, t in r).encode("utf-8", "surrogatepass")) for r in rows]
                cols = [
                    pa.array([x - (1 << 64) if x >> 63 else x for x in streams], pa.int64()),
                    pa.array([any(z == "main" for z, _ in r) for r in rows], pa.bool_()),
                    pa.array([any(z != "main" for z, _ in r) for r in rows], pa.bool_()),
                    pa.array([[{"zone": z, "text": t} for z, t in r] for r in rows], kind),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *cols], names=["row", "page_id", "url", "host", "stream", "has_main", "has_open", "blocks"])
        released()

    def suffixes(batches):
        import pyarrow as pa

        for b in batches:
            for host, row, stream, blocks in zip(*(b.column(i) for i in range(4))):
                tokens = stream_of([(x["zone"], x["text"]) for x in blocks.as_py()])
                for at in range(0, max(0, len(tokens) - run + 1), 2000):
                    starts = range(at, min(at + 2000, len(tokens) - run + 1))
                    n, heads = len(starts), [tokens[i : i + depth] for i in starts]
                    cols = [pa.array([v.as_py()] * n, pa.int64()) for v in (host, row, stream)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(starts, pa.int64()), pa.array(heads, pa.list_(pa.string()))], names=["host", "row", "stream", "i", "head"])

    def article(batches, bits):
        import pyarrow as pa
        from xxhash import xxh64_intdigest as hashed

        mask = 8 * len(bits) - 1
        kind = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.string())]

        def rows():
            for b in batches:
                for host, row, stream, text in zip(*(c.to_pylist() for c in b.columns)):
                    seed, tokens = host & MASK, {"", *text.split()}
                    known = {w for w in tokens if bits[(k := hashed(w, seed) & mask) >> 3] >> (k & 7) & 1}
                    if "" in known:
                        known = tokens
                    for i, fresh, head in article_suffixes(text, known, run, depth):
                        yield host, row, stream, i, fresh, head

        found = rows()
        while part := list(islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kind)], names=["host", "row", "stream", "i", "fresh", "head"])
        released()

    def compose(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for r in b.select(["has_main", "blocks", "runs", "inner", "n_pages"]).to_pylist():
                blocks = [(x["zone"], x["text"]) for x in r["blocks"]]
                gone = iter(covered_blocks(blocks, [(x["i"], x["n"]) for x in r["runs"] or []], covered))
                lines = covered_blocks(blocks, [(x["i"], x["n"]) for x in r["inner"] or []], covered, ("main",))
                size = [t.count(" ") + 1 for z, t in blocks if z == "main"]
                if 2 * sum(n for n, x in zip(size, lines) if x) >= sum(size):
                    lines = [False] * len(size)  # a copy of an article
                lines = iter(lines)
                alone = r["has_main"] and (r["n_pages"] or 1) < 2
                kept = [t for z, t in blocks if not (next(lines) if z == "main" else next(gone) or alone)]
                texts.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([*b.select(["page_id", "url"]).columns, pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    picked = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).cast("string").alias("html"),
    )
    kind = picked.schema["page_id"].dataType.simpleString()
    schema = f"row long, page_id {kind}, url string, host long, stream long, has_main boolean, has_open boolean, blocks array<struct<zone:string,text:string>>"
    n = pages.count()
    cut = staged(picked.mapInArrow(read, schema), like(pages))

    # What a site sets into its articles: pages are counted by content, in two steps, so that copies are one and no run is hot.
    text = F.transform(F.filter("blocks", lambda x: x["zone"] == "main"), lambda x: x["text"])
    mains = cut.where("has_main").select("host", "row", "stream", F.array_join(text, "\n").alias("text"))
    count = lambda d, *keys: d.groupBy(*keys, "stream").agg(F.lit(1).alias("x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hosts = staged(count(cut, "host").withColumnRenamed("n", "n_pages"), n)
    need = F.greatest(F.lit(3.0), share * F.col("n_pages"))
    tokens = mains.select("host", "stream", "text").mapInArrow(lambda b: _token_counts(b, share), "host long, key long, n long, none boolean")
    tokens = staged(tokens.groupBy("host", "key", "none").agg(F.sum("n").alias("n")), 60 * n)
    slack = tokens.where("none").select("host", F.col("key").alias("none_key"), F.col("n").alias("slack"))
    least = staged(hosts.where("n_pages >= 3").join(slack, "host").select("host", "none_key", (need - F.col("slack")).alias("least")), n)
    often = tokens.where("not none").join(maybe_broadcast(least), "host").where("n >= least").select("key")
    often = often.union(least.where("least <= 0").select("none_key"))  # copies in many tasks: all tokens of the host
    bits = _bits(staged(often, 60 * n))
    inner = staged(mains.mapInArrow(lambda b: article(b, bits), "host long, row long, stream long, i long, fresh int, head array<string>"))
    array = count(inner, "host", "head", "fresh").join(maybe_broadcast(hosts), "host").select("host", "head", "fresh", "n", need.alias("need"))
    dealt = array.repartition("host", F.slice("head", 1, run)).sortWithinPartitions("host", "head", "fresh")
    common = staged(dealt.mapInArrow(lambda b: _article_array(b, run), "host long, head array<string>"))
    # A longer run is covered by the shortest ones that begin in it.
    size = F.when(F.col("head")[0] == "", F.size("head")).otherwise(F.lit(run))
    begun = inner.select("host", "row", "i", F.slice("head", F.lit(1), size).alias("head"))
    common = common.where(F.size("head") == size)
    n_tokens = F.size("head") - F.when(F.col("head")[0] == "", 2).otherwise(0)
    begun = begun.join(maybe_broadcast(common), ["host", "head"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", n_tokens.cast("long").alias("n")))).alias("inner"))
    inner = staged(begun.mapInArrow(_merged, begun.schema), n)

    every = cut.where("has_open").select("host", "row", "stream", "blocks").mapInArrow(suffixes, "host long, row long, stream long, i long, head array<string>")
    every = staged(every)
    array = every.groupBy("host", "head").agg(F.min("stream").alias("a"), F.max("stream").alias("b"))
    dealt = array.repartition("host", F.slice("head", 1, run)).sortWithinPartitions("host", "head")
    shared = staged(dealt.mapInArrow(lambda b: _suffix_array(b, run), "host long, head array<string>, n int"))
    runs = every.join(maybe_broadcast(shared), ["host", "head"]).groupBy("row").agg(F.collect_list(F.struct("i", "n")).alias("runs"))

    asked = cut.where("has_open").join(inner, "row", "left").unionByName(cut.where("not has_open").join(maybe_broadcast(inner), "row"))
    wide = asked.join(runs, "row", "left").join(maybe_broadcast(hosts), "host", "left")
    judged = wide.select("page_id", "url", "has_main", "blocks", "runs", "inner", "n_pages").mapInArrow(compose, f"page_id {kind}, url string, text string")
    plain = cut.where("not has_open").join(maybe_broadcast(inner.select("row")), "row", "left_anti").select("page_id", "url", F.array_join(text, "\n\n").alias("text"))
    done = judged.unionByName(plain)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
