"""HTML main text through wrappers: union-free regular expressions inferred from the token streams of a host's pages."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import batch, columns, rows, small_batches
from quillon.session import materialize

TAG = r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|title|template|svg|select|button)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<[!?/]?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<[!?/]?[a-zA-Z][^<>]*+>"""
TOKEN = re.compile(TAG, re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head nav header footer aside form script style noscript textarea title template svg select button iframe object menu dialog".split())
ARTICLE = frozenset("article main".split())
#: Words of class, id and role that mark what is not the article, and what is.
CHROME_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe share social related comment comments reply replies disqus respond search login signup pagination toolbar complementary contentinfo".split())
ARTICLE_WORDS = frozenset("article post entry story main content".split())
#: First words of a class that say what an element does not have or only frames: ``no-sidebar``, ``with-banner``.
FRAMES = frozenset("no with without has is not js".split())
#: Elements whose contents are never text; they stand inside a line of text without ending it.
PASSED = frozenset("script style noscript template svg textarea title select button".split())
SLOT = "#"
#: Distinct pages that have the same text in the same place of a wrapper, at least, for it to be the template's, not the page's.
TEMPLATE_PAGES = 3
SKELETONS = pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("texts", pa.string()), ("seen", pa.list_(pa.int64()))])
SKELETONS_DDL = "host string, skeleton string, texts string, seen array<long>"


def hints(raw: str, tag: str) -> list[str]:
    """The words of a tag's class, id and role that mark chrome or an article; none of those that only frame the page."""
    if tag in ("html", "body"):
        return []
    found = set()
    for h in HINTS.findall(raw):
        for name in " ".join(h).lower().split():
            parts = re.findall(r"[a-z]+", name)
            if parts and parts[0] not in FRAMES:
                found.update(parts)
    return sorted(found & (CHROME_WORDS | ARTICLE_WORDS))


def tokens(page: str) -> list[tuple[str, str]]:
    """(label, text) of a page: text as the label ``#``, a tag as ``name``, ``name.hints`` or ``/name``. Comments, declarations
    and elements that hold no text (``PASSED``) are left out."""
    out, last = [], 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            out.append((SLOT, page[last : m.start()]))
        last = m.end()
        raw = m[0]
        name = NAME.match(raw)
        if not name or (tag := name[1].lower()) in PASSED:
            continue
        out.append(("/" + tag, "") if raw[1] == "/" else (".".join([tag, *hints(raw, tag)]), ""))
    if last < len(page):
        out.append((SLOT, page[last:]))
    return out


def _structural(label: str) -> bool:
    """False for inline tags, which do not shape a page."""
    return label.lstrip("/").split(".")[0] not in INLINE


def stream(page: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(label, from, to) of the tokens that shape the page; neighbouring text becomes one slot over tokens [from, to)."""
    out: list[tuple[str, int, int]] = []
    for k, (label, text) in enumerate(page):
        if label == SLOT:
            if not text.strip():
                continue
        elif not _structural(label):
            continue
        if label == SLOT and out and out[-1][0] == SLOT:
            out[-1] = (SLOT, out[-1][1], k + 1)
        else:
            out.append((label, k, k + 1))
    return out


def literal(page: list[tuple[str, str]], a: int, b: int) -> int:
    """What a text token of the stream says, as a number: of its decoded words, whatever the white space and inline tags."""
    return crc32(" ".join(html_lib.unescape("".join(x for label, x in page[a:b] if label == SLOT)).split()).encode())


def literals(page: list[tuple[str, str]], shaped: list[tuple[str, int, int]]) -> list[int | None]:
    """For each token of the stream its literal text, None for a tag."""
    return [literal(page, a, b) if label == SLOT else None for label, a, b in shaped]


def same(a: object, b: object) -> object:
    """Literal text where both have the same, else None, a slot; item by item in groups."""
    return list(map(same, a, b)) if isinstance(a, list) and isinstance(b, list) else a if a == b else None


def collapsed(labels: list, texts: list) -> list[tuple[object, int, object]]:
    """(item, tokens covered, literal text): runs of a repeated group become ``["+", group]``, shorter groups first, nested.

    Text that differs between the runs of a group is a slot in it.
    """
    items = [(x, 1, t) for x, t in zip(labels, texts, strict=True)]
    keys = [json.dumps(x) for x in labels]
    while True:
        seen: dict[str, int] = {}
        sizes = set()
        for k, key in enumerate(keys):
            if key in seen:
                sizes.add(k - seen[key])
            seen[key] = k
        for size in sorted(sizes):
            out, out_keys, k = [], [], 0
            while k < len(items):
                end = k + size
                if end < len(items) and keys[k] == keys[end]:
                    group = keys[k:end]
                    while keys[end : end + size] == group:
                        end += size
                if end > k + size:
                    item = ["+", [x for x, _, _ in items[k : k + size]]]
                    texts_of = [t for _, _, t in items[k : k + size]]
                    for at in range(k + size, end, size):
                        texts_of = same(texts_of, [t for _, _, t in items[at : at + size]])
                    out.append((item, sum(n for _, n, _ in items[k:end]), texts_of))
                    out_keys.append(json.dumps(item))
                    k = end
                else:
                    out.append(items[k])
                    out_keys.append(keys[k])
                    k += 1
            if len(out) < len(items):
                items, keys = out, out_keys
                break
        else:
            return items


def aligned(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Index pairs of equal items in order, by longest matching blocks; what has no partner stands alone, in order. Memory
    follows the lengths, not their product."""
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for x, y, n in SequenceMatcher(None, list(map(json.dumps, a)), list(map(json.dumps, b)), autojunk=False).get_matching_blocks():
        out += [(k, None) for k in range(i, x)] + [(None, k) for k in range(j, y)] + [(x + k, y + k) for k in range(n)]
        i, j = x + n, y + n
    return out


def _groups(items: list) -> list:
    return sorted((x for x in items if isinstance(x, list)), key=lambda g: -len(g[1]))


def _unified(own: list, groups: list) -> list[tuple[int, int, list | None]]:
    """(from, to, group or None) over the items ``own``: one occurrence of a group that repeats elsewhere becomes that group."""
    out, k = [], 0
    while k < len(own):
        g = next((g for g in groups if own[k : k + len(g[1])] == g[1]), None)
        out.append((k, k + len(g[1]) if g else k + 1, g))
        k = out[-1][1]
    return out


def entries(skeleton: list, texts: list, seen: list[int]) -> list[list]:
    """A page, or pages of one skeleton, as a wrapper: (item, optional, literal text, some of the pages that have it)."""
    return [[x, False, t, seen] for x, t in zip(skeleton, texts, strict=True)]


def merged(wrapper: list[list], other: list[list]) -> list[list]:
    """One wrapper for the pages of both: tags without a partner become optional items, one occurrence of a group that repeats
    elsewhere becomes that group, and text that differs becomes a slot. Of the pages that have an item the least
    ``TEMPLATE_PAGES`` numbers are kept, enough to tell whether as many have it."""
    groups = _groups([e[0] for e in [*wrapper, *other]])

    def unified(own: list[list]) -> list[list]:
        out = []
        for a, b, g in _unified([e[0] for e in own], groups):
            some = own[a:b]
            out.append([g, all(e[1] for e in some), [e[2] for e in some], some[0][3]] if g else some[0])
        return out

    a, b = unified(wrapper), unified(other)
    out = []
    for i, j in aligned([e[0] for e in a], [e[0] for e in b]):
        if i is None or j is None:
            item, _, text, seen = a[i] if j is None else b[j]
            out.append([item, True, text, seen])
        else:
            out.append([a[i][0], a[i][1] or b[j][1], same(a[i][2], b[j][2]), sorted({*a[i][3], *b[j][3]})[:TEMPLATE_PAGES]])
    return out


def pattern(wrapper: list[list]) -> str:
    """The wrapper as a regular expression over tags, slots (``#``) and literal text (``=``)."""
    def one(item: object, text: object) -> str:
        if isinstance(item, list):
            return "(" + "".join(map(one, item[1], text)) + ")+"
        return f"<{item}>" if item != SLOT else SLOT if text is None else "="

    return "".join(f"({one(x, t)})?" if o else one(x, t) for x, o, t, _ in wrapper)


def _inside(label: str, outer: tuple[str, int], at: int) -> tuple[str, int]:
    """(region, opener) inside an element that stands in ``outer``: ``out`` and the number of the chrome element that holds the place, else ``article`` or ``body``."""
    if outer[0] == "out":
        return outer
    name, *words = label.split(".")
    chrome = CHROME_WORDS.intersection(words)
    if name in DROPPED or chrome and not (outer[0] == "body" and ARTICLE_WORDS.intersection(words) and name in ARTICLE):
        return "out", at
    return ("article", -1) if name in ARTICLE or ARTICLE_WORDS.intersection(words) else outer


def regions(items: list) -> list:
    """The region of each item (for a group: the regions of its body) by a walk with the open elements: ``article``, ``body``,
    ``out``, or ``?`` inside a chrome element that is never closed. Unmatched ends are passed over, unclosed elements end
    with what holds them."""
    stack: list[tuple[str, tuple[str, int], int]] = [("", ("body", -1), -1)]
    names: Counter = Counter()

    def walk(item: object) -> object:
        if isinstance(item, list):
            return [walk(x) for x in item[1]]
        if item.startswith("/") and names[item[1:]]:
            name = ""
            while name != item[1:]:
                name = stack.pop()[0]
                names[name] -= 1
        elif item != SLOT and not item.startswith("/") and (name := item.split(".")[0]) not in VOID:
            at = len(openers)
            openers.append(item)
            stack.append((name, _inside(item, stack[-1][1], at), at))
            names[name] += 1
        return stack[-1][1]

    def settle(region: object) -> object:
        if isinstance(region, list):
            return [settle(x) for x in region]
        return "?" if region[1] in unclosed else region[0]

    openers: list[str] = []
    found = [walk(x) for x in items]
    unclosed = {at for _, _, at in stack[1:]}
    return [settle(r) for r in found]


def _settled(own: str, known: str) -> str:
    """A token's region from the page's own tags and from the wrapper: the page's, unless a chrome element is left open there
    or the page lacks the tags of the article, where the wrapper knows better."""
    if own in ("article", "out"):
        return own
    if own == "?":
        return known if known in ("article", "body") else "out"
    return "article" if known == "article" else "body"


def _spread(item: object, value: object, count: int, unknown: object) -> list:
    """One value for each of the ``count`` tokens that a (repeated) item covers; ``unknown`` where groups nest and differ."""
    if not isinstance(item, list):
        return [value] * count
    if not isinstance(value, list):
        return [unknown] * count
    if any(isinstance(x, list) for x in item[1]):
        flat = [value]
        while any(isinstance(x, list) for x in flat):
            flat = [y for x in flat for y in (x if isinstance(x, list) else [x])]
        return [flat[0] if len(set(flat)) == 1 else unknown] * count
    return [value[k % len(value)] for k in range(count)]


@lru_cache(2000)
def _labels(wrapper_json: str | None, labels: tuple[str, ...]) -> tuple[bool, tuple[str, ...], tuple]:
    """(is there an article, region of each token of the stream, template text in its place) by aligning the stream with the
    wrapper. Template text is known where enough distinct pages have the same, and only if the wrapper's article has a slot:
    else all its pages say the same, and nothing tells what is theirs. What the page's own tags place in the article is
    the article's, whatever other pages say."""
    own = regions(list(labels))
    wrapper = json.loads(wrapper_json) if wrapper_json else []
    if not wrapper:
        return "article" in own, tuple(_settled(r, "") for r in own), (None,) * len(labels)
    cover = collapsed(list(labels), [None] * len(labels))
    items = [x for x, _, _ in cover]
    known, has = regions([e[0] for e in wrapper]), False
    has = "article" in json.dumps(known) or "article" in own
    template = [e[2] if len(e[3]) >= TEMPLATE_PAGES else None for e in wrapper]

    def varies(item: object, region: object, text: object) -> bool:
        if isinstance(item, list):
            return any(map(varies, item[1], region, text if isinstance(text, list) else [None] * len(item[1])))
        return item == SLOT and text is None and region == ("article" if has else "body")

    if not any(varies(e[0], r, e[2]) for e, r in zip(wrapper, known, strict=True)):
        template = [None] * len(wrapper)
    spans = _unified(items, _groups([*(e[0] for e in wrapper), *items]))
    whole = [g or items[a] for a, _, g in spans]
    at = {j: i for i, j in aligned([e[0] for e in wrapper], whole) if i is not None and j is not None}
    flat: list[str] = []
    texts: list = []
    for j, (a, b, _) in enumerate(spans):
        count = sum(n for _, n, _ in cover[a:b])
        flat += _spread(whole[j], known[at[j]], count, "") if j in at else [""] * count
        texts += _spread(whole[j], template[at[j]], count, None) if j in at else [None] * count
    return has, tuple(map(_settled, own, flat)), tuple(None if r == "article" else t for r, t in zip(own, texts, strict=True))


def main_text(page: str | None, wrapper_json: str | None) -> str:
    """The article's blocks, joined by a newline, as the host's wrapper places them on this page.

    All text in an element that the page itself marks as the article counts, also what other pages have alike. Where a page
    lacks such tags, slots in the wrapper's article region count, text of the template does not. Where the host has no
    article element, all outside of chrome is the region, less the blocks that are mostly links. Block tags and line breaks
    end a block; inline tags, scripts and the like do not. A block of nothing but an inline advert or the like is left out. References are decoded, white space becomes one space.
    """
    if not page:
        return ""
    toks = tokens(page)
    shaped = stream(toks)
    has_article, labels, template = _labels(wrapper_json, tuple(x for x, _, _ in shaped))
    wanted = "article" if has_article else "body"
    blocks: list[str] = []
    text: list[str] = []
    linked = aside = total = 0

    def close() -> None:
        nonlocal linked, aside, total
        block = " ".join("".join(text).split())
        if block and aside < total and (has_article or 2 * linked <= total):
            blocks.append(block)
        text.clear()
        linked = aside = total = 0

    marked: list[tuple[str, bool]] = []  # open inline elements, and whether they are marked as chrome
    k = 0
    for (label, a, b), region, fixed in zip(shaped, labels, template, strict=True):
        kept = label == SLOT and region == wanted and (fixed is None or literal(toks, a, b) != fixed)
        for at in range(k, b):
            own, raw = toks[at]
            name = own.lstrip("/").split(".")[0]
            if own == SLOT and kept and at >= a:
                decoded = html_lib.unescape(raw)
                size = len("".join(decoded.split()))
                text.append(decoded)
                total += size
                linked += size if any(n == "a" for n, _ in marked) else 0
                aside += size if any(m for _, m in marked) else 0
            elif own == SLOT:
                text.append(" ")
            elif name in INLINE and name not in VOID:
                if own[0] != "/":
                    marked.append((name, bool(CHROME_WORDS.intersection(own.split(".")[1:]))))
                elif any(n == name for n, _ in marked):
                    del marked[max(i for i, (n, _) in enumerate(marked) if n == name)]
        k = b
        if label != SLOT:
            close()
    close()
    return "\n".join(blocks)


def host(url) -> object:
    """The url's host, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"\A[^:]*://([^/?#]*)", 1)), F.lit(""))


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, skeleton, texts, seen): the distinct collapsed token streams of each host as JSON, with the literal text that all
    their pages share and the least numbers of some of these; summed up where the pages are read, then by host and skeleton."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[list, list[int]]] = {}
        for b in batches:
            for h, page in rows([b]):
                toks = tokens(page)
                shaped = stream(toks)
                items = collapsed([x for x, _, _ in shaped], literals(toks, shaped))
                texts = [t for _, _, t in items]
                add(held, (h, json.dumps([x for x, _, _ in items])), texts, [crc32(json.dumps(texts).encode())])
            if len(held) > 20_000:
                yield out(held)
                held = {}
        yield out(held)

    def merge(t: pa.Table) -> pa.Table:
        held: dict = {}
        for h, s, texts, seen in zip(*(t.column(c).to_pylist() for c in SKELETONS.names), strict=True):
            add(held, (h, s), json.loads(texts), seen)
        return pa.Table.from_batches([out(held)], SKELETONS)

    def add(held: dict, key: tuple[str, str], texts: list, seen: list[int]) -> None:
        before = held.get(key)
        held[key] = (texts, seen) if before is None else (same(before[0], texts), sorted({*before[1], *seen})[:TEMPLATE_PAGES])

    def out(held: dict) -> pa.RecordBatch:
        return batch(SKELETONS, [(h, s, json.dumps(texts), seen) for (h, s), (texts, seen) in held.items()])

    made = pages.where("html is not null").select("host", "html").mapInArrow(run, SKELETONS_DDL)
    return made.groupBy("host", "skeleton").applyInArrow(merge, SKELETONS_DDL)


def infer(pages: DataFrame, at_once: int = 64) -> DataFrame:
    """(host, wrapper): every page's token stream took part in its host's wrapper.

    Streams of one skeleton first become one, then those of a host are aligned one after another, in the order of the
    skeletons, in groups of about ``at_once``; the groups' wrappers are aligned in turn, level by level, so no task holds
    more than a group of a host, however many pages it has.
    """
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def begin(t: pa.Table) -> pa.Table:
        every = zip(*(t.column(c).to_pylist() for c in SKELETONS.names[1:]), strict=True)
        return joined(t, [entries(json.loads(s), json.loads(texts), seen) for s, texts, seen in sorted(every)])

    def merge(t: pa.Table) -> pa.Table:
        return joined(t, [json.loads(w) for w in sorted(t.column("wrapper").to_pylist())])

    def joined(t: pa.Table, every: list) -> pa.Table:
        wrapper = every[0]
        for one in every[1:]:
            wrapper = merged(wrapper, one)
        return pa.Table.from_batches([batch(schema, [(t.column("host")[0].as_py(), json.dumps(wrapper))])], schema)

    def level(now: DataFrame, by: str, f) -> DataFrame:
        sizes = now.groupBy("host").agg(F.ceil(F.count("*") / at_once).alias("parts"))
        dealt = now.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")))
        return materialize(dealt.drop("parts").groupBy("host", "part").applyInArrow(f, "host string, wrapper string"), "wrappers")

    now = level(materialize(skeletons(pages), "skeletons"), "skeleton", begin)
    while not now.groupBy("host").count().where("count > 1").isEmpty():
        now = level(now, "wrapper", merge)
    return now


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars of the page's main text.

    Pages without a host share the host "". A null html is empty, a page without an article text gets "", repeated rows
    are extracted each, an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    p = columns(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host(F.col("url")))
    wrappers = infer(p).withColumnRenamed("host", "of_host")

    @F.arrow_udf("string")
    def text(htmls: pa.Array, wrapper: pa.Array) -> pa.Array:
        return pa.array([main_text(h, w) for h, w in zip(htmls.to_pylist(), wrapper.to_pylist(), strict=True)], pa.string())

    both = p.join(wrappers, F.col("host") == F.col("of_host"), "left").select("page_id", "url", text("html", "wrapper").alias("text"))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
