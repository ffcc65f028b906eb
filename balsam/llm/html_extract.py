"""Main text of web pages by template deduction from equivalence classes.

1. Every page is read into tokens: tags with the path of tags above them, and whole text nodes
   with their path. A token's occurrence vector over the pages of its host is kept as a 64-bit
   fold of (page, count), so the vectors of all pages are compared by one aggregation that
   combines before the shuffle; a host with a third of all pages is a key like any other.
2. Pages of a host with the same html count as one. Tokens of a host with equal vectors form an
   equivalence class. Classes whose tokens occur in at least ``support`` of the host's pages, three
   pages or more, and that have at least ``least`` tokens are kept. (A token can be in at most 1 / ``support`` times
   as many template places as a page has tokens, which bounds the template.)
3. A class must be ordered: on every page its tokens follow each other as on its first page, once in each
   repeat of the class. Tokens that do not are put into smaller classes that are ordered.
4. Classes must be nested: an occurrence of a class lies between two tokens of the class around it, or outside
   all of it. Of two classes that cross, the one on fewer pages is broken there.
5. A token in no class gets a role of its own at each place of the class that encloses it, named by the
   template token before it, and classes are sought again (2 to 4) with the roles as tokens, until no more
   tokens are found, ``MAX_ROUNDS`` times at most. A role that is in a class stays in one.
6. Each page is read again beside its host's nested classes. What is no member of a class is in a slot, which is data.
   Elements with a whole class or id name of
   a list (menus, sidebars, notices, adverts, comments) are no content where they are themselves in
   the template, and hosts without a template go by the name alone; headers, footers, forms and
   scripts are none by their tags. The text of an article or main element is the page's; without
   one, it is the text of all slots that are left.

Text in an article is never dropped for being frequent: a line that repeats on many pages is still
that page's text.

Cases: a null or empty html gives an empty text; hosts with fewer than three different pages and rows without a
host have no template and go by the roles alone; malformed and cut-off tags end where the text ends; repeated
rows and equal keys are rows of their own.
"""

from __future__ import annotations

import html
import itertools
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.session import scratch_path

#: Elements without content; elements that end a block of text; elements that hold no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split())
RAW = "script style noscript template iframe svg object textarea"
#: Elements and names (of class or id) that are no content.
NO_CONTENT = frozenset("head nav footer aside form button select dialog menu".split())
NO_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion menu nav navbar "
    "navigation navigations sidebar side footer masthead cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription related recommended share sharing social comment comments commentlist "
    "disqus respond reply replies breadcrumb breadcrumbs pagination pager widget popup modal toolbar topbar "
    "skip signup login search "
    # names of more words are matched as a whole, like the others
    "ad-container ad-slot advert-box side-bar left-sidebar right-sidebar widget-area site-nav main-nav main-menu "
    "nav-menu site-footer page-footer cookie-banner cookie-notice cookie-consent newsletter-signup related-posts "
    "related-articles share-buttons social-share comment-list comment-form comments-area skip-link "
    "search-form".split())
MAIN_NAMES = frozenset("main main-content main_content maincontent".split())
#: Elements whose names never tell that they are no content.
ALWAYS = frozenset("html body main article".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW.replace(" ", "|") + r")(?=[\s/>])[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _names(attributes: str) -> tuple[str, ...]:
    found = " ".join(a or b or c for a, b, c in _NAME.findall(attributes)).lower()
    return tuple(found.split())


def nodes(page: str | None) -> Iterator[tuple[str, tuple, str]]:
    """("tag", path, tag) at each start tag, ("name", path, element) at one with a name of
    ``NO_NAMES`` and ("text", path, text) for each run of text, with the character references
    decoded. A path holds (tag, names) from the outermost element inwards."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    at = 0

    def close(kinds: set[str], stop: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", tuple(stack), html.unescape(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(1):
                yield "tag", tuple(stack), "#raw"
            continue
        if m.group(2):
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            yield "tag", tuple(stack), f"/{tag}"
            continue
        if tag in BLOCK:
            close({"p"}, BLOCK - {"p", "br"})
        if tag in ENDS:
            close(ENDS[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
        names = _names(m.group(4)) if m.group(4) else ()
        yield "tag", tuple(stack), tag
        if not NO_NAMES.isdisjoint(names):
            yield "name", tuple(stack), path_text(((tag, names),))
        if tag not in VOID and not m.group(4).endswith("/"):
            stack.append((tag, names))
    if at < len(page):
        yield "text", tuple(stack), html.unescape(page[at:])


def path_text(path: tuple) -> str:
    return "/".join(f"{t}.{'.'.join(n)}" if n else t for t, n in path)


def _hash(s: str) -> int:
    import xxhash
    return (xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))) - (1 << 63)


def _token(kind: str, path: tuple, value: str) -> int | None:
    """The token of a node: start tags, named elements and text nodes, each with the path above it."""
    if kind == "tag" and value[:1] == "/":
        return None
    value = " ".join(value.split()) if kind == "text" else value
    return _hash(f"{kind} {path_text(path)} {value}") if value else None


def sequence(page: str | None) -> list[int]:
    """The tokens of a page in their order."""
    return [t for t in (_token(*node) for node in nodes(page)) if t is not None]


def tokens(page: str | None) -> dict[int, int]:
    """How often each token occurs."""
    return dict(Counter(sequence(page)))


def _split_role(role: int, anchor: int) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(struct.pack("<qq", role, anchor)) - (1 << 63) if anchor else role


class Level:
    """Ordered classes of one round."""

    def __init__(self, classes: list[list[int]]):
        self.classes = classes
        self.at = {r: (c, i) for c, roles in enumerate(classes) for i, r in enumerate(roles)}

    def walk(self, seq: list[int]) -> tuple[list[int], set[tuple[int, int]]]:
        """Of each place, the class token that it follows inside the innermost open class (0: outside all);
        and the crossings: the last tokens of two classes of which neither encloses the other."""
        open_: list[list[int]] = []  # class, its last token
        inside: set[int] = set()
        before, crossings = [], set()
        for role in seq:
            c, i = self.at.get(role, (-1, 0))
            if i and c in inside:
                while open_[-1][0] != c:
                    other, last = open_.pop()
                    inside.discard(other)
                    crossings.add((last, next(b for a, b in open_ if a == c)))
                open_[-1][1] = role
            before.append(open_[-1][1] if open_ else 0)
            if c < 0:
                continue
            if i == len(self.classes[c]) - 1:
                if c in inside:
                    open_.pop()
                    inside.discard(c)
            elif not i and c not in inside:
                open_.append([c, role])
                inside.add(c)
        return before, crossings

    def split(self, seq: list[int]) -> list[int]:
        """Roles: a token that is in no class is told apart by the class token before it."""
        return [r if r in self.at else _split_role(r, b) for r, b in zip(seq, self.walk(seq)[0])]

    def conflicts(self, seq: list[int]) -> set[tuple[int, int]]:
        """Pairs of tokens of a class that do not take turns on a page in the order of the class."""
        places: dict[int, dict[int, list[int]]] = {}
        due: dict[int, int] = {}
        bad = set()
        for n, role in enumerate(seq):
            if role in self.at:
                c, i = self.at[role]
                places.setdefault(c, {}).setdefault(role, []).append(n)
                if i != due.get(c, 0):
                    bad.add(c)
                due[c] = (i + 1) % len(self.classes[c])
        out = set()
        for c in bad:
            roles = self.classes[c]
            p = np.array([places[c][r] for r in roles])
            for i in range(len(roles) - 1):
                turns = (p[i] < p[i + 1:]).all(axis=1) & (p[i + 1:, :-1] < p[i, 1:]).all(axis=1)
                out.update((roles[i], roles[i + 1 + j]) for j in np.flatnonzero(~turns))
        return out


class Template:
    """The nested classes of a host: those of each round tell the roles of the next apart."""

    def __init__(self, levels: list[list[list[int]]]):
        self.levels = [Level(classes) for classes in levels]

    def roles(self, seq: list[int]) -> list[int]:
        for level in self.levels[:-1]:
            seq = level.split(seq)
        return seq

    def members(self, seq: list[int]) -> list[bool]:
        """Which places are template; the others are in slots."""
        return [r in self.levels[-1].at for r in self.roles(seq)]


def ordered(classes: list[list[int]], conflicts: set[tuple[int, int]]) -> list[list[int]]:
    """Classes in pieces without conflicts: each token goes into the first piece that it fits."""
    out = []
    for roles in classes:
        pieces: list[list[int]] = []
        for r in roles:
            piece = next((p for p in pieces if not any((q, r) in conflicts for q in p)), None) if conflicts else pieces and pieces[0]
            if piece:
                piece.append(r)
            else:
                pieces.append([r])
        out += pieces
    return out


def uncrossed(classes: list[list[int]], pages: dict[int, int], crossings: set[tuple[int, int]], single: bool) -> list[list[int]]:
    """Classes of which the one on fewer pages is broken behind the token where it crosses another; with
    ``single``, both fall into single tokens."""
    of = {r: c for c, roles in enumerate(classes) for r in roles}
    cut: dict[int, set[int]] = {}
    for pair in crossings:
        weak = min(pair, key=lambda r: (pages[r], len(classes[of[r]]), classes[of[r]][0]))
        for r in pair if single else (weak,):
            cut.setdefault(of[r], set()).update(classes[of[r]] if single else (r,))
    out = []
    for c, roles in enumerate(classes):
        piece: list[int] = []
        for r in roles:
            piece.append(r)
            if r in cut.get(c, ()):
                out.append(piece)
                piece = []
        if piece:
            out.append(piece)
    return out


def _role(tag: str, names: tuple[str, ...], inside: bool, supported: Callable[[], bool]) -> bool:
    """Whether an element is content. A name counts only for an element that is in the template."""
    if tag in ALWAYS:
        return True
    if tag in NO_CONTENT or not NO_NAMES.isdisjoint(names) and supported():
        return False
    return tag != "header" or inside


def extract(page: str | None, template: Template | frozenset) -> str:
    """The text of the content slots of a page; an empty set is no template."""
    runs: list[tuple[bool, bool, str]] = []  # in an article, template text, text
    has_article = False
    known: dict[tuple, bool] = {}
    found = list(nodes(page))
    seq = [_token(*node) for node in found] if template else []
    member = iter(template.members([t for t in seq if t is not None]) if template else ())
    fixed = [t is not None and next(member) for t in seq] if template else [False] * len(found)

    def in_template(at: tuple) -> bool:
        """Whether the named element at the end of a path is in the template, if the host has one."""
        return not template or known[at[:-1], path_text(at[-1:])]

    for (kind, path, value), is_fixed in zip(found, fixed):
        if kind == "name":
            known[path, value] = is_fixed  # of elements with the same path only the last is open
            continue
        if kind == "tag":
            if value.lstrip("/") in BLOCK:
                runs.append((True, False, "\n"))
            continue
        content, inside = True, False
        for depth, (tag, names) in enumerate(path, 1):
            content = content and _role(tag, names, inside, lambda: in_template(path[:depth]))
            inside = inside or tag in ("article", "main") or tag not in ALWAYS and not MAIN_NAMES.isdisjoint(names)
        if not content:
            continue
        has_article = has_article or inside and not value.isspace()
        runs.append((inside, not inside and is_fixed, value))
    text = "".join(t if t == "\n" or (inside if has_article else not frequent) else "\n"
                   for inside, frequent, t in runs)
    return " ".join(text.split())


#: On fewer different pages a token is not part of a template: two alike pages may be two versions.
LEAST_PAGES = 3
#: Up to so many pages that repeat are broadcast instead of joined.
MAX_REPEATED = 1_000_000


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, uid, html): one row for each different html of a host; ``uid`` is its hash. Only pages
    whose hash repeats are moved, once merged inside each task."""
    rows = pages.select("host", F.xxhash64("html").alias("uid"), "html")
    path = scratch_path(pages.sparkSession, "html-repeated")
    rows.groupBy("host", "uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("host", "uid").write.parquet(path)
    repeated = pages.sparkSession.read.parquet(path)
    if repeated.count() <= MAX_REPEATED:
        repeated = F.broadcast(repeated)
    once = rows.join(repeated, ["host", "uid"], "left_anti")
    merged = rows.join(repeated, ["host", "uid"], "left_semi").groupBy("host", "uid").agg(F.min("html").alias("html"))
    return once.select("host", "uid", "html").unionByName(merged)


#: Rounds in which roles are told apart and classes sought.
MAX_ROUNDS = 4
#: Up to so many template tokens of all hosts go to all executors instead of shuffling the pages.
MAX_BROADCAST = 2_000_000
_LEVELS = "array<array<array<long>>>"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _beside(rows: DataFrame, levels: DataFrame, how: str) -> DataFrame:
    """Rows with the ``levels`` of their host."""
    size = F.aggregate(F.flatten("levels"), F.lit(0).cast("long"), lambda n, c: n + F.size(c))
    if (levels.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST:
        levels = F.broadcast(levels)
    return rows.join(levels, "host", how)


class _Templates:
    """Templates by host, each read once."""

    def __init__(self):
        self.known: dict[str, Template] = {}

    def of(self, host: str, levels: pa.Scalar) -> Template | None:
        if host not in self.known:
            if len(self.known) > 1_000:
                self.known.clear()
            self.known[host] = Template(levels.as_py()) if levels.is_valid else None
        return self.known[host]


def _on_pages(pages: DataFrame, schema: str, what: Callable) -> DataFrame:
    """The rows ``what(template, uid, sequence)`` of pages (host, uid, seq, levels), the same ones
    of a slice of pages once, behind their host."""
    types = [f.dataType.simpleString() for f in pages.sparkSession.createDataFrame([], schema).schema.fields]
    types = [pa.string() if t == "string" else pa.int32() if t == "int" else pa.int64() for t in types]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _Templates()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = {(h, *row): None for i, (h, uid, seq) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3))))
                        for row in what(templates.of(h, part.column(3)[i]), uid, seq)}
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return pages.select("host", "uid", "seq", "levels").mapInArrow(run, schema)


def _role_counts(template: Template | None, uid: int, seq: list[int]) -> list[tuple]:
    if template:
        seq = template.levels[-1].split(template.roles(seq))
    counts, first = Counter(seq), {}
    for i, role in enumerate(seq):
        first.setdefault(role, i)
    return [(uid, role, n, first[role]) for role, n in counts.items()]


def _mend(classes: DataFrame, pairs: DataFrame, mend: Callable) -> DataFrame:
    """(host, pages, classes) with the classes of each host after ``mend(classes, pages of tokens, pairs)``."""
    pairs = pairs.distinct().groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages, cl = [], [], []
            for h, n, c, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                of = {r: x for x, roles in zip(n, c) for r in roles}
                got = mend(c, of, {(x["a"], x["b"]) for x in p or ()})
                hosts.append(h)
                pages.append([of[roles[0]] for roles in got])
                cl.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.list_(pa.int64())),
                                              pa.array(cl, pa.list_(pa.list_(pa.int64())))], names=["host", "pages", "classes"])

    return classes.join(pairs, "host", "left").select("host", "pages", "classes", "pairs") \
        .mapInArrow(run, "host string, pages array<long>, classes array<array<long>>")


def _level(seqs: DataFrame, total: DataFrame, levels: DataFrame, support: float, least: int) -> DataFrame:
    """(host, levels): one more level of ordered and nested classes."""
    counts = _on_pages(_beside(seqs, levels, "left"), "host string, uid long, token long, n int, first int", _role_counts)
    vectors = counts.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("uid", "n")).alias("vector"),
        F.min(F.struct("uid", "first")).alias("place"))
    frequent = vectors.filter(F.col("pages") >= LEAST_PAGES).join(total, "host").filter(F.col("pages") >= support * F.col("total"))
    # tokens with equal vectors have the same first page, so their places there order them
    equal = frequent.groupBy("host", "vector", "pages").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("t")) \
        .filter(F.size("t") >= least)
    classes = _written(equal.groupBy("host").agg(F.collect_list(F.struct("pages", F.col("t.token").alias("roles"))).alias("c"))
                       .select("host", F.col("c.pages").alias("pages"), F.col("c.roles").alias("classes")), "html-classes")

    def with_last(classes: DataFrame) -> DataFrame:
        return classes.join(levels, "host", "left").select("host", F.concat(
            F.coalesce("levels", F.array().cast(_LEVELS)), F.array("classes")).alias("levels"))

    def pairs(classes: DataFrame, what: Callable) -> DataFrame:
        return _written(_on_pages(_beside(seqs, with_last(classes), "inner"), "host string, a long, b long", what), "html-pairs")

    conflicts = pairs(classes, lambda t, _, seq: t.levels[-1].conflicts(t.roles(seq)))
    if not conflicts.isEmpty():
        classes = _written(_mend(classes, conflicts, lambda c, _, p: ordered(c, p)), "html-classes")
    for n in itertools.count():
        crossings = pairs(classes, lambda t, _, seq: t.levels[-1].walk(t.roles(seq))[1])
        if crossings.isEmpty():  # each time classes fall into more pieces, and single tokens cross nothing
            return _written(with_last(classes), "html-levels")
        single = n >= MAX_ROUNDS
        classes = _written(_mend(classes, crossings, lambda c, of, p: uncrossed(c, of, p, single)), "html-classes")


def templates(pages: DataFrame, support: float = 0.5, least: int = 2) -> DataFrame:
    """(host, classes, template, levels) from rows (host, html): the number of classes and all their
    tokens as told apart by their paths alone; and the ordered classes of each round, of roles.
    Pages with the same html are one page here, so a text is not part of a template because
    its page repeats."""
    pages = distinct_pages(pages)
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                seqs = [sequence(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(seqs, pa.list_(pa.int64()))],
                                                 names=["host", "uid", "seq"])

    seqs = _written(pages.select("host", "uid", "html").mapInArrow(run, "host string, uid long, seq array<long>"), "html-tokens")
    total = seqs.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    levels, known = spark.createDataFrame([], f"host string, levels {_LEVELS}"), 0
    for _ in range(MAX_ROUNDS):
        more = _level(seqs, total, levels, support, least)
        last = F.element_at("levels", -1)
        size = more.agg(F.sum(F.size(F.flatten(last)))).first()[0] or 0
        if size <= known:
            break
        levels, known = more, size
    return levels.select("host", F.size(F.col("levels")[0]).cast("long").alias("classes"),
                         F.flatten(F.col("levels")[0]).alias("template"), "levels")


def extract_text(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html",
                 support: float = 0.5, least: int = 2) -> DataFrame:
    """A row per row: key, url, text (empty if there is none)."""
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")))
    base = pages.select(F.col(key).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host.alias("host"))
    found = templates(base.filter("host <> ''"), support, least).select("host", "levels")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [extract(page, known.of(h, part.column(4)[i]) or frozenset())
                       for i, (h, page) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3))))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())],
                                                 names=["key", "url", "text"])

    return _beside(base, found, "left").select("key", "url", "host", "html", "levels") \
        .mapInArrow(run, f"key {kind}, url string, text string").withColumnRenamed("key", key)
