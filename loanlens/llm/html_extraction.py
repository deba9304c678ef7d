"""HTML extraction by equivalence classes of tokens.

Tokens (tags in their path, texts in their path) that occur equally often on every page of a host have the same
occurrence vector and form an equivalence class; classes that most pages of the host have are its template, and so
are those of fewer pages (a layout).  A text is in it only together with the tag around it: exactly the pages that have
the tag there have the text.  A passage that some articles share stands in a tag that other pages have too, and stays:
their tokens are markup and boilerplate, and what lies between them are slots.  Pages of a host whose articles have
the same texts are one page to the vectors, so copies do not vote their article into the template, and a repeated
row changes nothing.  A vector is never collected: its fingerprint is the exclusive or of one hash per (article,
count), which Spark aggregates in part on every task, so a hot host costs one row per token and task.

On a page a class counts if its tokens come in the class's order, once or several times over, and if it nests:
each repetition lies in one slot of the classes taken before it, or holds them in its own.  Slots outside menus,
headers, footers, sidebars, notices, adverts, forms and comments (told by tag names and words in class, id and role)
are the text: those in an article or main element, or, on a page that marks none, all that are not mostly links."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loanlens.llm import html_tokens as H
from loanlens.llm.common import Scratch, python_stage, table

TAG, OTHER, TEXT = 0, 1, 2  # kinds of tokens: tags, texts that are not of the article, texts that may be
LEAST_PAGES = 3  # of a host, with articles of their own, from which on a text of at least half of them may be boilerplate
LAYOUT_PAGES = 4  # with articles of their own, from which on the texts of fewer than half may be
ARTICLE_CHARS = 500  # a class of as many characters that makes up most of its pages' text is an article with copies
HEADING = re.compile(r"/h[1-6](\.[^/]*)?$")
_TOKENS = pa.list_(pa.struct([("key", pa.int64()), *((x, pa.int32()) for x in ("n", "place", "kind", "chars")),
                             ("parent", pa.int64())]))
_PATHS = pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int32())]))


def host_of(url: Column) -> Column:
    """Host of a url in lower case; empty for null and for what has none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _said(found: list[H.Token]) -> list[int]:
    """Places of the texts of a page's article: those in an article element, or else all running texts."""
    shown = [i for i, t in enumerate(found) if t.text.strip() and not t.junk]
    return ([i for i in shown if found[i].main] or [i for i in shown if not found[i].link] or shown)


def _page(html: str) -> tuple:
    """One page: hash of its article's texts in order, hash of the page, its distinct tokens (key, times, first place,
    kind, characters, tag around), characters of the article, and its paths with their running text."""
    found = H.tokens(html)
    said = _said(found)
    texts = [" ".join(found[i].text.split()) for i in said]
    inside, count, first, path_chars, around = set(said), Counter(), {}, Counter(), {}
    for i, t in enumerate(found):
        if t.key:
            count[t.key] += 1
            kind = (TEXT if i in inside else OTHER) if t.text else TAG
            place, known = first.get(t.key, (i, kind))
            first[t.key] = place, max(known, kind)
            around.setdefault(t.key, t.parent)
        if t.text and not t.junk and not t.link:
            path_chars[t.path] += len(t.text.strip())
    chars = Counter()
    for i, x in zip(said, texts):
        chars[found[i].key] += len(x)
    tokens = [(_signed(k), n, *first[k], chars[k], _signed(around[k])) for k, n in count.items()]
    return (_signed(xxhash.xxh3_64_intdigest("\0".join(texts))), _signed(xxhash.xxh3_64_intdigest(html)), tokens,
            sum(map(len, texts)), list(path_chars.items()))


def _ordered(places: list[tuple[int, int]], size: int) -> bool:
    """Whether (place, rank) pairs in page order run through the ranks 0..size-1 again and again."""
    return len(places) % size == 0 and all(r == i % size for i, (_, r) in enumerate(places))


def template_tokens(found: list[H.Token], classes: list[list[int]]) -> set[int]:
    """Places on the page that belong to its template: tokens of the classes that are in order and nest."""
    where = defaultdict(list)
    for i, t in enumerate(found):
        where[t.key].append(i)
    taken: list[tuple[int, int]] = []  # (first, last) place of each repetition of the classes so far
    edges: set[int] = set()
    for keys in classes:
        places = sorted((i, rank) for rank, key in enumerate(keys) for i in where.get(key, ()))
        if not places or not _ordered(places, len(keys)):
            continue
        spans = [(places[k][0], places[k + len(keys) - 1][0]) for k in range(0, len(places), len(keys))]
        inner = [i for i, _ in places]

        def crosses(lo, hi):
            return any(a < lo < b < hi or lo < a < hi < b for a, b in taken)

        if any(crosses(lo, hi) for lo, hi in spans):
            continue
        taken.extend(spans)
        edges.update(inner)
    return edges


def running_slots(found: list[H.Token], template: set[int]) -> set[int]:
    """Places of the texts in slots that are no boilerplate.  A slot is what one container holds between two others;
    one that is more links than text is left out, but headings that are links count if running text follows them."""
    kept, heads = set(), set()
    for path, run in groupby(enumerate(found), key=lambda x: x[1].path):
        at = [i for i, t in run if t.text.strip() and not t.junk and i not in template]
        linked = sum(len(found[i].text.strip()) for i in at if found[i].link)
        if 2 * linked <= sum(len(found[i].text.strip()) for i in at):
            kept.update(at)
        elif HEADING.search(path):
            heads.update(at)
    last = max(kept, default=-1)
    return kept | {i for i in heads if i < last}


def main_text(html: str, classes: list[list[int]], texts: set[int], main_path: str | None) -> str:
    """The article of one page, given its host's classes, which of their keys are texts, and the path that holds
    most running text on the host.  Pages that mark no article have the texts of all their slots that are not
    boilerplate, and link lists only in the container of that path (or the page's fullest)."""
    found = H.tokens(html)
    if not any(t.text and not t.junk for t in found):
        return ""
    template = {i for i in template_tokens(found, classes) if found[i].key in texts}
    if any(t.main and not t.junk and t.text.strip() for t in found):
        inside = lambda i, t: t.main
    else:
        here = Counter()
        for t in found:
            if t.text and not t.junk and not t.link:
                here[t.path] += len(t.text.strip())
        path = main_path if main_path in here else max(here, key=lambda p: (here[p], p), default="")
        slots = running_slots(found, template)
        inside = lambda i, t: not t.text.strip() or i in slots or t.path == path or t.path.startswith(path + "/")
    kept = [None if t.junk or not inside(i, t) or i in template else t for i, t in enumerate(found)]
    return H.blocks(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (id, url, ``text``, ``n_chars``), one row per input row.

    Null or empty html gives an empty text.  Pages of a host learn from each other; a host with a single page, or a
    null or broken url (host ""), has what its pages show.  Texts count as boilerplate of a host only from
    ``LEAST_PAGES`` pages of different articles on when at least half of them have the text, else from ``LAYOUT_PAGES``, and
    only where the same pages have the tag around it; a text that recurs in a tag of other pages too is an article's
    (lines and passages that articles share).  Copies of an article
    count once; a class of ``ARTICLE_CHARS`` characters a page and three quarters of its pages' text is no boilerplate
    (near copies).  Each row has its own result; null ids stay null; an empty table gives an empty result; other columns are not read.  Whole pages are
    read, whatever their length.

    Classes of a host are bounded by what its template and layouts hold, not by its pages; pages meet
    them in a join on the host in which one side has one row per host, so AQE splits a hot host."""
    spark = pages.sparkSession
    python_stage(spark)
    scratch = Scratch(spark)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))

    def learn(batches):
        for b in batches:
            pages = [_page(h) for h in b.column("html").to_pylist()]
            cols = list(zip(*pages)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], _TOKENS),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], _PATHS)], ["host", "content", "page", "tokens", "around", "paths"])

    part = rows.select("host", "html").mapInArrow(learn, (
        "host string, content long, page long, tokens array<struct<key: long, n: int, place: int, kind: int, chars: int, parent: long>>, "
        "around long, paths array<struct<path: string, chars: int>>"))
    # copies of an article speak once: by the page of the smallest hash
    distinct = scratch.write(part.groupBy("host", "content").agg(F.min(F.struct("page", "tokens", "around", "paths")).alias("p"))
                             .select("host", "content", "p.tokens", "p.around", "p.paths"), "contents")
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    seen = (distinct.select("host", "content", "around", F.inline("tokens")).groupBy("host", "key").agg(
        F.bit_xor(F.xxhash64("content", "n")).alias("vec"), F.bit_xor(F.xxhash64("content")).alias("on"),
        F.count(F.lit(1)).alias("pages"), F.max("kind").alias("kind"), F.min("parent").alias("parent"),
        F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.sum("around").alias("around")))
    common = (seen.where(F.col("pages") >= LEAST_PAGES).join(hosts, "host").withColumn("most", F.expr("2 * pages >= n"))
              .where(F.col("most") | (F.col("pages") >= LAYOUT_PAGES)))
    # a text belongs to the template with the tag around it: the same pages have both
    tags = common.where(F.col("kind") == TAG).select("host", F.col("key").alias("parent"), "on", F.lit(True).alias("with_tag"))
    common = common.join(tags, ["host", "parent", "on"], "left")
    held = (F.col("kind") == TEXT) & F.coalesce("with_tag", F.lit(False))
    classes = (common.groupBy("host", "vec").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("t"),
                                                 F.max("pages").alias("pages"), F.sum("chars").alias("chars"), F.max("around").alias("around"),
                                                 F.max(F.col("most") & (F.col("kind") == TAG) | held).alias("holds"),
                                                 F.collect_list(F.when(held, F.col("key"))).alias("texts")).where("holds")
               .withColumn("copied", (4 * F.col("chars") > 3 * F.col("around")) & (F.col("chars") >= ARTICLE_CHARS * F.col("pages")))
               .groupBy("host").agg(
                   # classes of more pages and tokens first: the outer ones
                   F.sort_array(F.collect_list(F.struct("pages", F.size("t").alias("size"), "vec", F.col("t.key").alias("keys"))),
                                asc=False).alias("c"),
                   F.flatten(F.collect_list(F.when(~F.col("copied"), F.col("texts")))).alias("texts"))
               .select("host", F.col("c.keys").alias("classes"), "texts"))
    main = (distinct.select("host", F.inline("paths")).groupBy("host", "path").agg(F.sum("chars").alias("chars"))
            .groupBy("host").agg(F.max(F.struct("chars", "path")).alias("m")).select("host", F.col("m.path").alias("main_path")))
    known = scratch.write(hosts.join(classes, "host", "left").join(main, "host", "left").drop("n"), "templates")

    met = rows.join(known, "host", "left")

    def cut(batches):
        for b in batches:
            out, made = [], {}
            for i, (h, host) in enumerate(zip(b.column("html").to_pylist(), b.column("host").to_pylist())):
                if host not in made:
                    classes, texts, path = (b.column(c)[i].as_py() for c in ("classes", "texts", "main_path"))
                    made[host] = ([[k % (1 << 64) for k in c] for c in classes or []], {k % (1 << 64) for k in texts or []}, path)
                out.append(main_text(h, *made[host]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    return (met.select("id", "url", "html", "host", "classes", "texts", "main_path")
            .mapInArrow(cut, "id long, url string, text string, n_chars long")
            .withColumnsRenamed({"id": id_col, "url": url_col}))


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
