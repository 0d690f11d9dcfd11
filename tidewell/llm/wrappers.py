"""Main text of web pages by union-free wrapper inference (operator 10).

A page is a stream of tokens: tags (with the part of class, id and role that tells boilerplate) and texts. Pages of a
host share a wrapper, a regular expression over tokens without unions: tags, text slots, repeated groups (..)+ and
optional groups (..)?. Inference folds each stream's tandem repeats into repeated groups, then aligns the streams one
by one with the wrapper so far; what only one side has becomes an optional group, and equal neighbours fold again.
Slots inside the article and outside menus, headers, footers, sidebars, notices, adverts, forms and comments are main
slots, and a page's main text is what it has in them.

On pages that name no article (no article, main or role=main) the wrapper tells template from data: a text that every
such page of the host with that slot has there is template, no data, and goes; a slot must occur on `MIN_PAGES`
different pages (told apart by 64 buckets of their hashes, so never too early). Pages that name their article keep all
of it, also what the host's pages share: an article may be printed again.

Only distinct folded streams take part (most pages of a host share a few), dealt to groups of at most `FAN` whose
wrappers are aligned with each other level by level, so no host is one task however many pages it has.

Blocks end at block-level tags; <br> is white space. Null and empty html give an empty text. Pages that name no
article have the whole body as theirs, less the template. Broken markup is read as far as it goes. A url without a host
belongs to the host "". Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

FAN, MAX_UNIT, MIN_PAGES = 64, 24, 4
_SCOPE = r"<(?:article|main)\b|role\s*=\s*[\"']?main\b"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|title|svg|object|canvas|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[/!?]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[/!?]?[a-zA-Z][^<>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements that hold no main text, words in class, id or role that say so, elements that end a block.
_DROP = frozenset("nav footer aside form head menu dialog button select fieldset".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus"
    " footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies responses"
    " share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets alert complementary contentinfo search".split()
)
_ASIDE = frozenset("ad ads advert comment comments promo related replies responses sponsored".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _scoped(page: str) -> bool:
    """Whether a page names its article."""
    return re.search(_SCOPE, page, re.I) is not None


def tokens(page: str) -> tuple[list[str], list[str], list[bool]]:
    """Skeleton (tags, `#` for main text, `%` for other text), the texts of its slots, and which tokens end a block."""
    skeleton, texts, ends = [], [], []
    open_, scoped = [], _scoped(page)
    dropped = inside = 0
    for m in _TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or len(t) == 1:
            if not t.strip():
                if skeleton and skeleton[-1] in "#%":
                    texts[-1] += t
                    continue
                if not skeleton:
                    continue
            kind = "#" if not dropped and (inside or not scoped) else "%"
            if skeleton and skeleton[-1] == kind:
                texts[-1] += t
            else:
                skeleton.append(kind)
                texts.append(t)
                ends.append(False)
            continue
        name = _NAME.match(t)
        if m[1] or not name:
            continue
        tag = name[2].lower()
        if name[1]:
            skeleton.append("/" + tag)
            ends.append(tag in _BLOCK)
            if any(x[0] == tag for x in open_):
                while open_:
                    was, drop, scope = open_.pop()
                    dropped -= drop
                    inside -= scope
                    if was == tag:
                        break
            continue
        marks = {w for _, v in _ATTRIBUTE.findall(t) for w in re.split(r"[^a-z]+", v.lower())} if "=" in t else set()
        bad = sorted(marks & _WORDS)
        scope = tag in ("article", "main") or "main" in marks and re.search(r"role\s*=\s*[\"']?main\b", t, re.I) is not None
        drop = tag in _DROP or tag == "header" and not inside or bool(marks & _ASIDE if scope else bad) and tag not in ("html", "body")
        skeleton.append(tag + "." + bad[0] if bad else tag)
        ends.append(tag in _BLOCK)
        if tag == "br":
            if texts:
                texts.append(" ")
                skeleton.append("#" if not dropped and (inside or not scoped) else "%")
                ends.append(False)
        elif tag not in _VOID and not t.endswith("/>"):
            open_.append((tag, int(drop), int(scope)))
            dropped += drop
            inside += scope
    return skeleton, texts, ends


# A wrapper is a list of nodes: a token, ["+", nodes] or ["?", nodes].


def fold(nodes: list) -> list:
    """Tandem repeats of up to MAX_UNIT nodes as repeated groups, shorter units first."""
    for size in range(1, MAX_UNIT + 1):
        out, i, changed = [], 0, False
        while i < len(nodes):
            unit = nodes[i : i + size]
            if out and size == 1 and isinstance(out[-1], list) and out[-1][0] == "+" and (out[-1][1] == unit or out[-1] == unit[0]):
                i, changed = i + 1, True
                continue
            n = 1
            while nodes[i + n * size : i + (n + 1) * size] == unit and len(unit) == size and not (size == 1 and isinstance(unit[0], list)):
                n += 1
            if n > 1:
                out.append(["+", unit])
                i, changed = i + n * size, True
            else:
                out.append(nodes[i])
                i += 1
        if changed:
            nodes = _absorb(out)
    return nodes


def _absorb(nodes: list) -> list:
    """Join a repeated group with single copies of its unit beside it, and optional copies of it."""
    out: list = []
    for x in nodes:
        out.append(x)
        while True:
            last = out[-1]
            if len(out) > 1 and isinstance(last, list) and isinstance(out[-2], list) and out[-2][0] == "+" and (last == out[-2] or last[0] == "?" and last[1] in (out[-2][1], [out[-2]])):
                out.pop()
                continue
            group = next((g for g in (out[-k] for k in range(2, min(len(out), MAX_UNIT + 1) + 1)) if isinstance(g, list) and g[0] == "+"), None)
            if group is not None and len(out) > len(group[1]) and out[-len(group[1]) - 1] is group and out[-len(group[1]) :] == group[1]:
                del out[-len(group[1]) :]
                continue
            if isinstance(last, list) and last[0] == "+" and len(out) > len(last[1]) and out[-len(last[1]) - 1 : -1] == last[1]:
                del out[-len(last[1]) - 1 : -1]
                continue
            break
    return out


def _key(node) -> str:
    """What makes two nodes alignable: an optional node is like the node itself."""
    if isinstance(node, list) and node[0] == "?":
        return _key(node[1][0])
    return node if isinstance(node, str) else "(" + " ".join(_key(x) for x in node[1]) + ")"


def _core(node):
    return node[1][0] if isinstance(node, list) and node[0] == "?" else node


def align(a: list, b: list) -> tuple[list, list[int]]:
    """The wrapper that covers both, and for each node of b its place in it."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    lo = 0
    while lo < min(len(a), len(b)) and ka[lo] == kb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    n, m = len(a) - lo - hi, len(b) - lo - hi
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], ka[lo + i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == kb[lo + j] else max(below[j], row[j + 1])
    out: list = []
    place = [0] * len(b)

    def both(i: int, j: int):
        x, y = a[i], b[j]
        place[j] = len(out)
        maybe = any(isinstance(z, list) and z[0] == "?" for z in (x, y))
        out.append(["?", [_core(x)]] if maybe else x)

    def optional(x):
        return x if isinstance(x, list) and x[0] == "?" else ["?", [x]]

    for k in range(lo):
        both(k, k)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[lo + i] == kb[lo + j]:
            both(lo + i, lo + j)
            i, j = i + 1, j + 1
        elif j < m and (i == n or best[i][j + 1] >= best[i + 1][j]):
            place[lo + j] = len(out)
            out.append(optional(b[lo + j]))
            j += 1
        else:
            out.append(optional(a[lo + i]))
            i += 1
    for k in range(hi):
        both(len(a) - hi + k, len(b) - hi + k)
    return out, place


def infer(streams: list[list]) -> list:
    """A wrapper for folded streams or wrappers, in the order given."""
    wrapper = streams[0]
    for s in streams[1:]:
        if s != wrapper:
            wrapper = align(wrapper, s)[0]
    return wrapper


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tokens."""
    return " ".join(x if isinstance(x, str) else f"({expression(x[1])}){x[0]}" for x in wrapper)


def placed(wrapper: list, folded: list) -> tuple[list, list[int]]:
    """A folded stream's nodes as the wrapper has them, and their places in it."""
    out, place = align(wrapper, folded)
    return [_core(out[p]) for p in place], place


def aligned(wrapper: list, folded: list) -> list:
    """A folded stream's nodes as the wrapper has them."""
    return placed(wrapper, folded)[0]


def _fits(nodes: list, skeleton: list[str], at: int, slots: list, path: tuple = ()) -> int:
    """Where the tokens that nodes match from `at` on end (-1: they don't); of each of their slots, its token and path."""
    for k, node in enumerate(nodes):
        if isinstance(node, str):
            if at >= len(skeleton) or skeleton[at] != node:
                return -1
            if node in "#%":
                slots.append((node, (*path, k)))
            at += 1
            continue
        found = 0
        while True:
            n = len(slots)
            nxt = _fits(node[1], skeleton, at, slots, (*path, k))
            if nxt <= at:
                del slots[n:]
                break
            at, found = nxt, found + 1
        if not found and node[0] == "+":
            return -1
    return at


def main_slots(nodes: list, skeleton: list[str]) -> list[bool]:
    """Whether each text of a page is in a main slot of its wrapper; by the page alone where its groups don't line up."""
    slots: list = []
    if _fits(nodes, skeleton, 0, slots) == len(skeleton):
        return [t == "#" for t, _ in slots]
    return [t == "#" for t in skeleton if t in "#%"]


def _names(nodes: list, place: list[int], skeleton: list[str], texts: list[str]) -> list[tuple[int, int] | None]:
    """Of each text its slot of the wrapper and its content, hashed; None where it is blank or the groups don't line up."""
    slots: list = []
    if _fits(nodes, skeleton, 0, slots) != len(skeleton):
        return [None] * len(texts)
    out: list = []
    for (kind, (top, *rest)), text in zip(slots, texts):
        flat = " ".join(_html.unescape(text).split())
        slot = xxhash.xxh3_64_intdigest(repr((kind, place[top], rest)).encode()) >> 1
        out.append((slot, xxhash.xxh3_64_intdigest(flat.encode("utf-8", "surrogatepass")) >> 1) if flat else None)
    return out


def main_text(skeleton: list[str], texts: list[str], ends: list[bool], slots: list[bool]) -> str:
    """Texts of the main slots of a page, by blocks."""
    blocks, now, k = [], [], 0
    for t, end in zip(skeleton, ends):
        if end:
            blocks.append("".join(now))
            now = []
        elif t in "#%":
            if slots[k]:
                now.append(texts[k])
            k += 1
    blocks.append("".join(now))
    flat = (" ".join(_html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in flat if b)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n_pages, n_streams): one wrapper per host, as JSON."""
    rows = pages.select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                folded = [json.dumps(fold(tokens(x)[0])) for x in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(folded)], ["host", "stream"])

    seen = rows.mapInArrow(run, "host string, stream string").groupBy("host", "stream").agg(F.count("*").alias("n"))
    level = materialize(seen.select("host", F.col("stream").alias("wrapper"), F.col("n").alias("n_pages"), F.lit(1).cast("long").alias("n_streams")), "streams")

    def join(group):
        import pandas as pd

        order = group.sort_values(["n_pages", "wrapper"], ascending=[False, True])
        made = infer([json.loads(w) for w in order["wrapper"]])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(made)], "n_pages": [int(group["n_pages"].sum())], "n_streams": [int(group["n_streams"].sum())]})

    turn = 0
    while True:
        many = level.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count("*") / FAN).alias("_g"))
        dealt = level.join(many, F.col("host") == F.col("h")).withColumn("_b", F.pmod(F.xxhash64("wrapper", F.lit(turn)), F.col("_g")))
        last = many.where("_g > 1").isEmpty()
        level = materialize(dealt.select("host", "wrapper", "n_pages", "n_streams", "_b").groupBy("host", "_b").applyInPandas(join, level.schema), f"wrappers{turn}")
        if last:
            return level
        turn += 1


class _Aligner:
    """Places of folded streams in their wrappers, each pair aligned once."""

    def __init__(self, most: int = 5000):
        self.known, self.most = {}, most

    def __call__(self, wrapper: str, skeleton: list[str]) -> tuple[list, list[int]]:
        folded = fold(skeleton)
        at = (wrapper, json.dumps(folded))
        if at not in self.known:
            if len(self.known) > self.most:
                self.known.clear()
            self.known[at] = placed(json.loads(wrapper), folded)
        return self.known[at]


def template(rows: DataFrame) -> DataFrame:
    """(host, template): texts by slot that all pages with the slot share, for pages (host, html, wrapper) without a named article."""

    def run(batches):
        place = _Aligner()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                hosts, slots, texts, pages = [], [], [], []
                for host, page, wrapper in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    skeleton, parts, _ = tokens(page)
                    found = {x for x in _names(*place(wrapper, skeleton), skeleton, parts) if x}
                    found |= {(slot, None) for slot, _ in found}  # counts the pages that have the slot
                    bucket = 1 << xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) % 64
                    for slot, text in found:
                        hosts.append(host)
                        slots.append(slot)
                        texts.append(text)
                        pages.append(bucket - (1 << 64) if bucket >> 63 else bucket)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (slots, texts, pages))], ["host", "slot", "text", "pages"])

    each = rows.select("host", "html", "wrapper").mapInArrow(run, "host string, slot long, text long, pages long")
    counts = materialize(each.groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.bit_or("pages").alias("pages")).where(F.bit_count("pages") >= MIN_PAGES), "texts")
    slots = counts.where("text IS NULL").select(F.col("host").alias("h"), F.col("slot").alias("s"), F.col("n").alias("all"))
    same = counts.where("text IS NOT NULL").join(slots, (F.col("host") == F.col("h")) & (F.col("slot") == F.col("s")) & (F.col("n") == F.col("all")))
    # every one of these is on each page that has its slot, so a host has no more than its wrapper's slots hold
    return same.groupBy("host").agg(F.collect_set(F.struct("slot", "text")).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, through its host's wrapper."""
    found = wrappers(pages).select(F.col("host").alias("h"), "wrapper")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    free = rows.where(~F.col("html").rlike("(?i)" + _SCOPE)).join(found, F.col("host") == F.col("h"))
    shared = materialize(template(free), "template")
    # a table of its own, whose size the planner knows: a row per host
    found = materialize(found.join(shared.withColumnRenamed("host", "_h"), F.col("h") == F.col("_h"), "left").select("h", "wrapper", "template"), "found")
    rows = rows.join(found, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "wrapper", "template")

    def run(batches):
        place = _Aligner()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                texts = []
                for page, wrapper, shared in zip(*(s.column(k).to_pylist() for k in (2, 3, 4))):
                    skeleton, parts, ends = tokens(page)
                    nodes, places = place(wrapper, skeleton)
                    slots = main_slots(nodes, skeleton)
                    if shared and not _scoped(page):
                        constant = {(x["slot"], x["text"]) for x in shared}
                        slots = [k and name not in constant for k, name in zip(slots, _names(nodes, places, skeleton, parts))]
                    texts.append(main_text(skeleton, parts, ends, slots))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
