"""Main text of web pages by template deduction over equivalence classes of tokens.

Pages of a host come from templates.  Every page is read as tokens: its tags, each with the path of
tags around it, and its runs of text.  Tokens of a host that occur equally often on every page, that
is with the same occurrence vector, form an equivalence class.  Classes that occur on enough pages,
once per page, and hold more than one token are valid; a token that does not stand in the order of its
class on every page leaves the class.  The class on most pages cuts the host's pages into slots.  By
its slot a token gets another role: in the next round roles are counted in place of tokens, so that
classes are found within the slots, and so on until no slot holds another one.  So on every page classes
lie beside each other or one in a slot of the other, and nest into the host's template.  What lies between a template's
tokens are its slots.  A slot's text that is a template token itself, the same run of text at the same
place on the host's pages, is boilerplate.  Pages with the same runs of text count as one, and where
most text at a path differs between pages, the path is a varying slot: text there is boilerplate only
if it is on most pages.

An occurrence vector is never gathered: a sum over pages of a hash of page and count stands for it,
which adds up in any order before the shuffle, so a host with a third of all pages is no hot key.
The template of a host is bounded by the size of its pages; pages are joined with it by host, where
a host's pages may be split over tasks.  Rounds after the first look only at the tokens that are on
enough pages, and only at hosts that still got a class in the round before.

Slots are then told apart by the roles of their paths: slots below menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like are left out, and if the page marks its
article or main part, only slots below it are taken.  A host with few pages has no template; its
pages are judged by the roles alone.  Character references are decoded, white space inside a block
is one space, blocks are joined by an empty line in page order.

Null and empty pages give an empty text.  Broken markup is read as far as it goes: unclosed tags end
with the tag around them.  Repeated pages each get their own result; null urls form one host.  Pages of any
length are read whole, in memory of some ten times the page; an empty table gives an empty one.  No
result depends on an order of pages, so there are no ties.  Columns other than page_id, url and html are
never read, so their names cannot clash.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalmill.llm.common import over_batches, stored

#: A class is valid if its tokens occur on this share of the host's pages, and on so many pages.
SHARE, PAGES = 0.3, 5
#: Pages of a host that a task joins with its template at a time follow from AQE's skew handling.

# Roles of tags and of words in class, id and role attributes.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "math")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
     "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
     "img", "label")
)
DROPPED = frozenset(("nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "canvas", "audio", "video"))
CLOSED_BY = {"p": 1, "li": 1, "dt": 1, "dd": 1, "tr": 1, "td": 1, "th": 1, "option": 1}
BLOCKS_END_P = frozenset(
    ("p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "header",
     "footer", "nav", "aside", "main", "pre", "blockquote", "form", "dl", "hr", "figure", "address")
)
OFF_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|"
    r"promotion|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|aside|footer|footnav|"
    r"masthead|topbar|toolbar|comment|comments|commentlist|respond|replies|reply|disqus|cookie|cookies|consent|"
    r"gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|"
    r"social|related|recommended|recommendations|widget|pagination|pager|search|skip|complementary|contentinfo|"
    r"feedback|disclaimer|copyright|legal)(?=$|[\s_-])",
    re.IGNORECASE,
)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|head)(?=$|[\s_-])", re.IGNORECASE)
MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|article-body|post-content|entry-content|main|main-content|story|"
    r"post-body|article-content)(?=$|[\s_-])",
    re.IGNORECASE,
)
MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
WHITE = re.compile(r"\s+")


def blocks(html: str | None) -> list[tuple[str, str, bool, bool]]:
    """(path, text, off, main) of every block of a page in order.

    ``path`` is the tags around the block with their classes; ``off`` says that one of them is
    boilerplate by its role, ``main`` that one is the page's main part.
    """
    page = html or ""
    out: list[tuple[str, str, bool, bool]] = []
    # An open tag: name, label, off and main of itself and all around it.
    stack: list[tuple[str, str, bool, bool]] = []
    text: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            joined = WHITE.sub(" ", references.unescape("".join(text))).strip()
            text.clear()
            if joined:
                path = "/".join(label for _, label, _, _ in stack if label)
                out.append((path, joined, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))

    while at < n:
        found = MARKUP.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                text.append(found[0][9:-3].replace("&", "&amp;"))
            continue
        if name == "br":
            text.append(" ")
            continue
        inline = name in INLINE
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if not inline or stack[depth][2] != (depth > 0 and stack[depth - 1][2]):
                        flush()
                    del stack[depth:]
                    break
                if inline and stack[depth][0] not in INLINE:
                    break
            else:
                if not inline:
                    flush()
            continue
        if name in RAW:
            # The end is looked for from here; without one, the rest of the page belongs to it.
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if not found[3].rstrip().endswith("/"):
                at = end.end() if end else n
            continue
        if not inline:
            flush()
        if name in VOID:
            continue
        if not inline:
            if name in BLOCKS_END_P:
                # A block ends an open paragraph, with the inline tags left open in it.
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        del stack[depth:]
                        break
                    if stack[depth][0] not in INLINE:
                        break
            if name in CLOSED_BY and stack and stack[-1][0] == name:
                stack.pop()
        off, main = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        marks = ""
        if found[3]:
            values = [a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(found[3])]
            marks = ".".join(values)
            # The parts a page is made of keep their text whatever words their classes use.
            if name not in ("html", "body", "article", "main"):
                off = off or any(OFF_WORDS.search(v) or (HEADER_WORDS.search(v) and not main) for v in values)
            off = off or bool(HIDDEN.search(found[3]))
            main = main or (not off and any(MAIN_WORDS.search(v) for v in values))
        off = off or name in DROPPED or (name == "header" and not main)
        main = main or (not off and name in ("article", "main"))
        if inline and off and not (stack and stack[-1][2]):
            flush()
        label = "" if inline else f"{name}.{marks}" if marks else name
        stack.append((name, label, off, main))
    flush()
    return out


def _token(path: str, text: str) -> int:
    """The 64-bit mark of a token: a tag path alone, or a run of text at a path."""
    data = f"{path}\0{text}".encode("utf-8", "replace")
    return (zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)) - (1 << 63)


def _within(context: int, token: int) -> int:
    """The role of a token in a context, or the context below another; the root's (0) is the token itself."""
    if not context:
        return token
    mixed = ((context * 0x9E3779B97F4A7C15 + token) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return (mixed ^ mixed >> 29) - (1 << 63)


def page_tokens(found: list[tuple[str, str, bool, bool]]) -> list[tuple[int, int]]:
    """The tokens of every block in page order: its path's mark and that of its text there."""
    return [(_token(path, ""), _token(path, text)) for path, text, _, _ in found]


def page_roles(
    tokens: list[tuple[int, int]], steps: list[dict[int, tuple[int, int, bool]]], known: frozenset[int] | None = None
) -> tuple[list[tuple[int, int, int, int, int]], set[int]]:
    """(place, token, role, context, class around it) of a page's tokens, and roles out of order.

    ``steps`` holds the classes found so far, outermost first, as role to class, rank and whether the
    class is about its whole context.  A context whose class is on the page is cut into slots by the
    class's tokens; the other tokens there get the slot as their context, where a class is not about
    the whole context only those between its first and last token.  Tokens of classes have no context
    any more (-1).  Only the tokens in ``known`` are looked at, if given.
    """
    flat = [t for pair in tokens for t in pair]
    places = [i for i, t in enumerate(flat) if known is None or t in known]
    context, inside, out, wrong = [0] * len(places), [0] * len(places), [], set()
    role = [flat[i] for i in places]
    left = range(len(places))
    for step in steps:
        present = {context[k]: (step[role[k]], k) for k in left if role[k] in step}
        seen: dict[int, int] = {}
        rest = []
        for k in left:
            at = context[k]
            if at not in present:
                rest.append(k)
                continue
            (group, _, whole), last = present[at]
            if role[k] in step:
                rank = step[role[k]][1]
                if rank < seen.get(at, 0):
                    wrong.add(role[k])
                else:
                    seen[at] = rank
                out.append((places[k], flat[places[k]], role[k], -1, group))
            else:
                if whole or (at in seen and k < last):
                    inside[k] = group
                    context[k] = _within(_within(at or 1, group), seen.get(at, 0))
                    role[k] = _within(context[k], flat[places[k]])
                rest.append(k)
        left = rest
    out += [(places[k], flat[places[k]], role[k], context[k], inside[k]) for k in left]
    return out, wrong


def main_text(
    found: list[tuple[str, str, bool, bool]], template: frozenset[int], steps: list[dict[int, tuple[int, int, bool]]] = ()
) -> list[str]:
    """The texts of the slots that hold the page's main text; ``template`` has roles of boilerplate."""
    if any(main and not off for _, _, off, main in found):
        # Inside the article nothing is left out for being repeated: a common line may be its own.
        return [text for _, text, off, main in found if main and not off]
    roles, _ = page_roles(page_tokens(found), steps) if template else ((), ())
    fixed = {place // 2 for place, token, role, _, _ in roles if place % 2 and (role in template or token in template)}
    return [text for k, (_, text, off, _) in enumerate(found) if not off and k not in fixed]


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


MARK = "array<struct<level:int,role:bigint,class:bigint,rank:int,whole:boolean,mostly:boolean,bound:boolean>>"
ROLE = (
    "host string, page bigint, role bigint, token bigint, context bigint, inside bigint, tag boolean, "
    "path bigint, count int, at bigint, wrong boolean"
)


def _steps(marks: list[dict] | None) -> list[dict[int, tuple[int, int, bool]]]:
    """The classes of a host by level, as :func:`page_roles` takes them."""
    levels: dict[int, dict[int, tuple[int, int, bool]]] = {}
    for m in marks or ():
        levels.setdefault(m["level"], {})[m["role"]] = (m["class"], m["rank"], m["whole"])
    return [levels[k] for k in sorted(levels)]


def _count_roles(batch: pa.RecordBatch) -> dict:
    """A row per page and role that is in no class yet, and one per role that is out of order."""
    out: list[tuple] = []
    own: dict[str, tuple] = {}
    hosts, pages, tokens = (batch.column(c).to_pylist() for c in ("host", "page", "tokens"))
    for i, (name, page, found) in enumerate(zip(hosts, pages, tokens)):
        if name not in own:
            known = batch.column("known")[i].as_py()
            own[name] = _steps(batch.column("marks")[i].as_py()), None if known is None else frozenset(known)
        pairs = [(t["path"], t["text"]) for t in found]
        roles, wrong = page_roles(pairs, *own[name])
        counts: dict[int, list] = {}
        for place, token, role, context, inside in roles:
            if context == -1:
                continue
            if role in counts:
                counts[role][8] += 1
            else:
                counts[role] = [name, page, role, token, context, inside, not place % 2, pairs[place // 2][0], 1, place, False]
        out += counts.values()
        out += [(name, page, role, 0, 0, 0, False, 0, 0, 0, True) for role in wrong]
    names = [field.split()[0] for field in ROLE.split(", ")]
    return dict(zip(names, map(list, zip(*out)))) if out else {name: [] for name in names}


def _next_classes(found: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Per host the next classes of its contexts (``added``) or the roles out of order (``wrong``)."""
    frequent = found.where("not wrong")
    # A path is on all pages that its texts are on, so it is among the frequent tokens as well.
    slots = frequent.groupBy("host", "context", "path").agg(
        F.sum(F.when(~F.col("tag"), F.col("total"))).alias("same"), F.sum(F.when(F.col("tag"), F.col("total"))).alias("all")
    )
    fixed = slots.where(F.col("same") * 2 > F.col("all")).select("host", "context", "path", F.lit(True).alias("fixed"))
    once = frequent.where("most = 1").join(fixed, ["host", "context", "path"], "left")
    paths = state.select("host", "fixed_paths")
    if level == 0:
        paths = fixed.groupBy("host").agg(F.collect_set("path").alias("fixed_paths"))
    # Boilerplate is a text on most pages, or one of a slot that is fixed both here and on the host.
    mostly = ~F.col("tag") & (F.col("support") * 2 > F.col("n_pages"))
    bound = ~F.col("tag") & F.coalesce(F.col("fixed") & F.array_contains("fixed_paths", F.col("path")), F.lit(False))
    mark = F.struct("at", "role", mostly.alias("mostly"), bound.alias("bound"))
    classes = once.join(paths, "host", "left").groupBy("host", "context", "inside", F.xxhash64("vector").alias("class")).agg(
        F.count("*").alias("size"), F.max("support").alias("support"), F.sort_array(F.collect_list(mark)).alias("marks")
    )
    # One token alone is no class, but one with the vector of the class around it belongs to that.
    valid = classes.where("size > 1 or class = inside")
    # The host's outermost class is about whole pages, as is a class about all of a slot that it is always in.
    whole = F.lit(level == 0) | (F.col("class") == F.col("inside"))
    best = valid.groupBy("host", "context").agg(
        F.max_by(F.struct("class", "marks", whole.alias("whole")), F.struct("support", "size", "class")).alias("best")
    )
    ranked = F.transform(
        "best.marks",
        lambda m, i: F.struct(
            F.lit(level).alias("level"), m["role"].alias("role"), F.col("best.class").alias("class"),
            (i + 1).cast("int").alias("rank"), F.col("best.whole").alias("whole"), m["mostly"].alias("mostly"), m["bound"].alias("bound"),
        ),
    )
    added = best.groupBy("host").agg(F.flatten(F.collect_list(ranked)).cast(MARK).alias("added"))
    wrong = found.where("wrong").groupBy("host").agg(F.collect_set("role").alias("wrong"))
    result = state.join(added, "host", "left").join(wrong, "host", "left")
    if level == 0:
        texts = F.collect_list(F.when(mostly & (F.col("most") == 1), F.col("token")))
        first = frequent.groupBy("host").agg(F.collect_list("token").alias("known"), texts.alias("everywhere"))
        result = result.drop("known", "everywhere", "fixed_paths").join(first, "host", "left").join(paths, "host", "left")
    return result


def templates(sequences: DataFrame, hosts: DataFrame, share: float = SHARE, pages: int = PAGES) -> DataFrame:
    """Per host its template: ``marks``, the tokens of its valid classes, and ``everywhere``, texts on most pages.

    ``sequences`` (host, page, tokens in page order), each distinct page once, and ``hosts`` (host,
    n_pages).  Each round counts the roles of tokens by page.  A class is the tokens of a context with
    one occurrence vector, once per page; the class on most pages of a context cuts it into slots, by
    which the roles of the other tokens differ in the next round.  Tokens that are not in the order of
    their class on every page leave it.  It ends when no host has another class.
    """
    enough = F.greatest(F.lit(pages), F.ceil(F.col("n_pages") * share))
    vector = F.sum(F.xxhash64("page", "count").cast("decimal(20,0)"))
    state = hosts.where(F.col("n_pages") >= pages).select(
        "host", "n_pages", F.expr(f"cast(array() as {MARK})").alias("marks"), F.lit(True).alias("open"),
        *[F.expr("cast(null as array<bigint>)").alias(c) for c in ("known", "everywhere", "fixed_paths")],
    )
    level = 0
    while True:
        working = state.where("open")
        rows = sequences.join(working.select("host", "marks", "known"), "host")
        counted = over_batches(rows, _count_roles, StructType.fromDDL(ROLE), rows=128)
        roles = counted.groupBy("host", "role", "token", "context", "inside", "tag", "path", "wrong").agg(
            vector.alias("vector"), F.count("*").alias("support"), F.max("count").alias("most"),
            F.sum("count").alias("total"), F.sum("at").alias("at"),
        )
        found = stored(
            roles.join(working.select("host", "n_pages"), "host").where(F.col("wrong") | (F.col("support") >= enough)),
            "frequent-tokens",
        )
        # A host whose last classes were out of order is counted again without those tokens.
        kept = F.filter("marks", lambda m: ~F.array_contains("wrong", m["role"]))
        marks = F.when(F.col("wrong").isNotNull(), kept).otherwise(F.concat("marks", F.coalesce("added", F.expr(f"cast(array() as {MARK})"))))
        is_open = F.col("wrong").isNotNull() | F.col("added").isNotNull()
        state = stored(
            _next_classes(found, state, level).select(
                "host", "n_pages", marks.alias("marks"), is_open.alias("open"), "known", "everywhere", "fixed_paths"
            ),
            "templates",
        )
        if state.where("open").isEmpty():
            return state.select("host", "marks", "everywhere")
        level += 1


def boilerplate(marks: list[dict] | None, everywhere: list[int] | None) -> frozenset[int]:
    """Roles of boilerplate: texts on most pages, and bound texts of a class that holds other tokens."""
    sizes = Counter(m["class"] for m in marks or ())
    own = [m["role"] for m in marks or () if m["mostly"] or (m["bound"] and sizes[m["class"]] > 1)]
    return frozenset(own).union(everywhere or ())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text and blocks (path and text of every block taken) of every page."""
    source = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    block = "array<struct<path:string,text:string,off:boolean,main:boolean>>"
    read_schema = StructType([*source.schema.fields[:3], *StructType.fromDDL(f"blocks {block}, tokens array<struct<path:bigint,text:bigint>>")])

    def read(batch: pa.RecordBatch) -> dict:
        found = [blocks(h) for h in batch.column(3).to_pylist()]
        keys = ("path", "text", "off", "main")
        return {
            "page_id": batch.column(0),
            "url": batch.column(1),
            "host": batch.column(2),
            "blocks": [[dict(zip(keys, b)) for b in f] for f in found],
            "tokens": [[{"path": p, "text": t} for p, t in page_tokens(f)] for f in found],
        }

    parsed = stored(over_batches(source, read, read_schema, rows=128).withColumn("row_id", F.monotonically_increasing_id()), "page-blocks")
    # Of pages with the same runs of text the first stands for all; only pages that have copies are looked up.
    known = parsed.select("host", F.xxhash64("blocks.text").alias("page"), "row_id")
    distinct = stored(known.groupBy("host", "page").agg(F.count("*").alias("n"), F.min("row_id").alias("first")), "distinct-pages")
    copied = distinct.where("n > 1").select("host", "page", "first")
    marked = parsed.select("host", F.xxhash64("blocks.text").alias("page"), "row_id", "tokens")
    single = marked.join(copied, ["host", "page"], "left").where("first is null or first = row_id")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n_pages"))
    # Hosts with fewer pages have no template.
    sequences = stored(single.join(hosts.where(F.col("n_pages") >= PAGES), "host", "left_semi").select("host", "page", "tokens"), "page-tokens")
    template = templates(sequences, hosts)
    joined = parsed.select("page_id", "url", "host", "blocks").join(template, "host", "left")

    def take(batch: pa.RecordBatch) -> dict:
        texts = []
        own: dict[str, tuple] = {}
        for i, (name, found) in enumerate(zip(batch.column("host").to_pylist(), batch.column("blocks").to_pylist())):
            if name not in own:
                marks, everywhere = batch.column("marks")[i].as_py(), batch.column("everywhere")[i].as_py()
                own[name] = boilerplate(marks, everywhere), _steps(marks)
            taken = main_text([(b["path"], b["text"], b["off"], b["main"]) for b in found], *own[name])
            texts.append("\n\n".join(taken))
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "host": batch.column("host"),
            "text": texts,
        }

    schema = StructType([*[source.schema[c] for c in ("page_id", "url", "host")], *StructType.fromDDL("text string")])
    return over_batches(joined, take, schema, rows=128)


def op7_html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
