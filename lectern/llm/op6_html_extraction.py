"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

1. A page becomes a stream of tokens: block tags with their class or id, and text
   slots. Siblings that repeat are folded into a repeated group.
2. The streams of a host are aligned one after another with the wrapper so far. Where
   they differ, what only one of them has becomes optional; what repeats what stands
   before it becomes a repeated group; texts that differ become a slot, texts that
   never do stay template text. The result needs no alternatives (it is union-free).
   Each task folds its own pages; the wrappers of a host then meet in a tree: salted
   first, whole last. Equal streams are aligned once, so a host with a third of all
   pages costs a few alignments a task.
3. In the finished wrapper every slot gets a tier by its path. Slots under menus, headers,
   footers, sidebars, forms, notices, adverts and comments are left out by the words of the
   names on their path: one such word is enough (comment-content), unless another tells of a layout
   only (with-sidebar). The tiers are: slots in the article; slots under names of main text;
   slots that vary or stand on one page only and aren't linked; all others that aren't linked.
4. Every page is matched with its host's wrapper: its tokens are aligned with the expression's, and
   each of its texts gets the tier of the slot that it falls into (a text that falls into
   none that of its path). The page's main text is the first of the first three tiers that holds
   half of their words on that page or more, or the first two or three together where none does
   alone; the last tier only where these are empty. So a host's pages may have many
   templates, and a teaser marked as article doesn't hide the story.

Nothing is cut. Pages that are null or empty give an empty text. A url without a host
(or null) forms one group of its own, salted like any other. Repeated rows are kept, and
ties (equal pages, equal wrappers) change nothing. An empty table gives an empty result.
Kept columns may have any names but ``text``.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, dropped, staged

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

# Elements of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "title"} | RAW
# words of names of what is no main text
NOT_MAIN = set(
    "ad ads advert adverts advertisement advertisements advertising banner banners promo promos promotion promotions sponsor sponsors sponsored cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended recommendation recommendations share sharing social comment comments disqus respond "
    "replies newsletter subscribe login signup search pagination pager complementary contentinfo teaser teasers".split()
)
# words of names that only say how a page is laid out, whatever else they hold
LAYOUT = set("with without has have no not is hide hidden show layout wide grid theme template".split())
# main text by a whole word of a name
MAIN_NAMES = set("article articlebody main content post entry story body".split())


def parse(page: str | None) -> Iterator[tuple]:
    """('open', key), ('close', key), ('text', text, path, linked): blocks and their texts, inline markup dissolved."""
    stack: list[tuple[str, str]] = []
    paths: list[str] = [""]
    parts: list[str] = []
    linked = links = at = 0

    def flush():
        nonlocal links
        text = " ".join("".join(parts).split())
        out = ("text", text, paths[-1], links * 2 > len(text)) if text else None
        parts.clear()
        links = 0
        return out

    def pop(n: int):
        for _ in range(n):
            paths.pop()
            yield "close", stack.pop()[1]

    page = page or ""
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"] or m["cdata"]) is not None:
            if m["cdata"] is None:
                text = entities.unescape(text)
            parts.append(text)
            links += len(text.strip()) if linked else 0
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                linked = 0 if m["end"] else 1
            continue
        if found := flush():
            yield found
        if m["end"]:
            for depth, (open_name, _) in enumerate(reversed(stack), 1):
                if open_name == name:
                    yield from pop(depth)
                    break
            linked = 0 if name not in ("p", "br") else linked
            continue
        if name in VOID:
            continue
        if name in RAW and not m["rest"].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        while stack and (stack[-1][0] in CLOSES.get(name, ()) or (stack[-1][0] == "p" and name in BREAKS_P)):
            yield from pop(1)
        given = " ".join(sorted(" ".join(filter(None, x.groups()[1:])).lower() for x in NAMED.finditer(m["rest"]))) if "=" in m["rest"] else ""
        # numbers in names are no part of a template
        key = name + ("." + ".".join(sorted(set(re.sub(r"\d+", "", given).split()))) if given else "")
        stack.append((name, key))
        paths.append(f"{paths[-1]}/{key}")
        yield "open", key
    if found := flush():
        yield found
    yield from pop(len(stack))


def stream(page: str | None, order: bool = False) -> list:
    """Tokens of a page: [kind, key, text, words, linked words, page]; siblings that repeat are folded.

    With ``order``, each has also the numbers of the texts that are folded into it.
    """
    out: list = []
    own, count = xxhash.xxh64_intdigest(page or ""), 0
    for event in parse(page):
        more = [[]] if order else []
        if event[0] == "text":
            n = len(event[1].split())
            out.append(["#", event[2], event[1], 0 if event[3] else n, n if event[3] else 0, own, *([[count]] if order else [])])
            count += 1
        else:
            out.append([event[0][0], event[1], "", 0, 0, own, *more])
            if event[0] == "close":
                out = folded(out)
    return out


def same(a: list, b: list) -> bool:
    return a[0] == b[0] and a[1] == b[1]


def together(a: list, b: list) -> list:
    """One token for two: equal texts stay template text, others become a slot (None). So with pages: one, or None for several."""
    more = [a[6] + b[6]] if len(a) > 6 and isinstance(a[6], list) else a[6:]
    return [a[0], a[1], a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None, *more]


def folded(tokens: list) -> list:
    """Folds the element that just ended into its elder sibling if both have the same shape."""

    def begins(end: int) -> int:
        depth, k = 0, end
        while k >= 0:
            depth += {"c": 1, "o": -1}.get(tokens[k][0], 0)
            if depth == 0:
                return k
            k -= 1
        return -1

    start = begins(len(tokens) - 1)
    if start > 0 and tokens[start - 1][0] == "c":
        elder = begins(start - 1)
        if elder >= 0 and start - elder == len(tokens) - start and all(same(a, b) for a, b in zip(tokens[elder:start], tokens[start:], strict=True)):
            tokens[elder:] = [together(a, b) for a, b in zip(tokens[elder:start], tokens[start:], strict=True)]
    return tokens


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal tokens, in order in both.

    Equal beginnings and ends are matched; between them the k-th use of a token in one meets
    its k-th use in the other, and the longest chain of such meetings in order is kept. The
    cost is near linear, for short and long streams alike.
    """
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(head, m - tail):
        where.setdefault(b[j], []).append(j)
    used: dict[str, int] = {}
    meet = []
    for i in range(head, n - tail):
        k = used.get(a[i], 0)
        if k < len(where.get(a[i], ())):
            meet.append((i, where[a[i]][k]))
            used[a[i]] = k + 1
    # longest rising chain of the second places
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(meet)
    for q, (_, j) in enumerate(meet):
        at = bisect_left(ends, j)
        back[q] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [q]
    chain, q = [], last[-1] if last else -1
    while q >= 0:
        chain.append(meet[q])
        q = back[q]
    return [(i, i) for i in range(head)] + chain[::-1] + [(n - tail + i, m - tail + i) for i in range(tail)]


class Wrapper:
    """A union-free expression: tokens [kind, path or key, text or None, words, linked words, page or None, optional]."""

    def __init__(self, tokens: list | None = None, pages: int = 0):
        self.tokens, self.pages = tokens or [], pages

    @classmethod
    def of(cls, tokens: list) -> Wrapper:
        return cls([[*t, False] for t in tokens], 1)

    def merged(self, other: Wrapper) -> Wrapper:
        """Align two wrappers; what only one has becomes optional."""
        if not self.pages or not other.pages:
            return self if self.pages else other
        a, b = self.tokens, other.tokens
        names_a, names_b = [f"{t[0]}{t[1]}" for t in a], [f"{t[0]}{t[1]}" for t in b]
        out: list = []
        i = j = 0
        for x, y in [*aligned(names_a, names_b), (len(a), len(b))]:
            out += [[*t[:6], True] for t in a[i:x]] + [[*t[:6], True] for t in b[j:y]]
            if x < len(a):
                out.append([*together(a[x], b[y])[:6], a[x][6] or b[y][6]])
            i, j = x + 1, y + 1
        return Wrapper(repeats(out), self.pages + other.pages)

    def to_json(self) -> str:
        return json.dumps([self.pages, self.tokens], ensure_ascii=False)

    @classmethod
    def from_json(cls, s: str) -> Wrapper:
        pages, tokens = json.loads(s)
        return cls(tokens, pages)

    def slots(self) -> list[int]:
        """The tier of each token that is a slot of main text (0 to 3), -1 for all other tokens."""
        by: dict[str, list] = {}
        for kind, path, text, n, linked, page, _ in self.tokens:
            if kind == "#":
                s = by.setdefault(path, [0, 0, False])
                s[0] += n
                s[1] += linked
                s[2] |= text is None or page is not None
        tiers = {p: self._tier(p, *s) for p, s in by.items()}
        return [tiers[t[1]] if t[0] == "#" else -1 for t in self.tokens]

    @staticmethod
    def _tier(path: str, unlinked: int, linked: int, varies: bool) -> int:
        """In the article; named as main text; texts that vary or stand on one page only; anything else that isn't linked."""
        keys = path.split("/")[1:]
        if any(_left_out(k) for k in keys):
            return -1
        if any(k.partition(".")[0] in ("article", "main") for k in keys):
            return 0
        if any(MAIN_NAMES & set(w) for k in keys for w in _names(k)):
            return 1
        return -1 if unlinked <= linked else 2 if varies else 3


def matched(page: str | None, names: list[int], tiers: list[int]) -> str:
    """The main text of a page by its host's wrapper: the hashes of the expression's tokens and their tiers."""
    texts = [e for e in parse(page) if e[0] == "text"]
    tokens = stream(page, True)
    slot = dict(aligned([_hash(t) for t in tokens], names))
    by_path = {n: t for n, t in zip(names, tiers, strict=True)}
    tier = [-1] * len(texts)
    for i, t in enumerate(tokens):
        for k in t[6]:
            tier[k] = tiers[slot[i]] if i in slot else by_path.get(_hash(t), -1)
    words = [0] * 3
    for e, t in zip(texts, tier, strict=True):
        if 0 <= t < 3:
            words[t] += 0 if e[3] else len(e[1].split())
    whole = sum(words)
    best = next((t for t in range(3) if words[t] and 2 * words[t] >= whole), None)
    if best is not None:
        take = {best}
    elif whole:
        take = {0, 1} if 2 * (words[0] + words[1]) >= whole else {0, 1, 2}
    else:
        take = {min((t for t in tier if t >= 0), default=-2)}
    return " ".join(e[1] for e, t in zip(texts, tier, strict=True) if t in take)


def _hash(token: list) -> int:
    return xxhash.xxh64_intdigest(f"{token[0]}{token[1]}") >> 1


def repeats(tokens: list) -> list:
    """Squares of optional elements become repeated groups: an optional element folds into an equal elder sibling."""
    out: list = []
    for t in tokens:
        out.append(t)
        if t[0] == "c" and t[6]:
            out = folded(out)
    return out


def _names(key: str) -> list[list[str]]:
    """The words of each class, id and role of an element's key."""
    given = key.partition(".")[2]
    return [w for x in given.split(".") if not LAYOUT & set(w := re.split(r"[-_:]+", x))] if given else []


@lru_cache(100_000)
def _left_out(key: str) -> bool:
    name = key.partition(".")[0]
    if name in LEFT_OUT:
        return True
    # names of the page's own frame (html, body, main) tell of its layout; an article is left out as a teaser only
    if name in ("html", "body", "main"):
        return False
    return any(NOT_MAIN & set(w) and (name != "article" or {"teaser", "teasers", "related", "comment", "comments", "ad", "ads", "sponsored"} & set(w)) for w in _names(key))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(host, pages, wrapper): the wrapper of all pages of each host, as JSON."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, Wrapper] = {}
        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have[h] = have.get(h, Wrapper()).merged(Wrapper.of(stream(page.as_py())))
                if len(have) > 5000:
                    yield out(have)
                    have = {}
        if have:
            yield out(have)

    def merge(t: pa.Table) -> pa.Table:
        w = Wrapper()
        for x in sorted(t["wrapper"].to_pylist()):
            w = w.merged(Wrapper.from_json(x))
        return pa.table({"host": t["host"].slice(0, 1), "pages": pa.array([w.pages], pa.int64()), "wrapper": pa.array([w.to_json()])})

    def out(have: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array([w.pages for w in have.values()], pa.int64()), pa.array([w.to_json() for w in have.values()], pa.string())], ["host", "pages", "wrapper"])

    kind = "host string, pages long, wrapper string"
    part = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(fold, kind)
    some = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInArrow(merge, kind)
    return staged(some.groupBy("host").applyInArrow(merge, kind))


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """Adds ``text`` (main text, '' if none) to the columns ``keep`` of every row of ``pages`` (page_id, url, html)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Wrapper.from_json(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[_hash(t) for t in w.tokens] for w in found], pa.list_(pa.int64())), pa.array([w.slots() for w in found], pa.list_(pa.int8()))], ["host", "names", "tiers"])

    made = wrappers(pages)
    table = staged(made.select("host", "wrapper").mapInArrow(slots, "host string, names array<long>, tiers array<tinyint>"))
    dropped(made)
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host(F.col("url")).alias("host"), F.col("html").alias("h"), F.xxhash64("html").alias("salt"))
    rows = attach(rows, table, "host", "salt").select(*[f"k{i}" for i in range(len(keep))], "h", "names", "tiers")
    n = len(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [matched(page.as_py(), names.as_py(), tiers.as_py()) for page, names, tiers in zip(*b.columns[n:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], [*b.schema.names[:n], "text"])

    schema = rows.drop("h", "names", "tiers").schema.add("text", "string")
    return rows.mapInArrow(read, schema).toDF(*keep, "text")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    return out.withColumn("n_chars", F.length("text").cast("long"))
