"""Web corpus: page parse, metadata, link rules, linked-page joins (S7-S9,
X2-X13, J1, J2).

The crawl is a table (``pages``: page_id, url, html).  Each page is parsed
once by ``parse_html``; everything after the parse is native.  Linked pages
are found by an equi-join of link URLs with page URLs (both without
fragment), never by fetching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import parse_html
from ..functions.text import col_of, empty_placeholder, py_strip, squash_lines
from .chunking import CHUNK_SIZE, PARAGRAPH_SEP, chunk_text
from .partitioning import materialize, spread

# Link rules, link caps, block formats.
EXCLUDED_PATHS = ["/login", "/signup", "/register", "/contact", "/about", "/terms", "/privacy"]
EXCLUDED_LINK_TEXT = ["sign in", "log in", "register", "contact", "about us"]
SKIPPED_HREF_PREFIXES = ["#", "javascript:", "mailto:"]
MAX_LINKS_SINGLE = 5
MAX_LINKS_BATCH = 3
LINKED_MARK = "\n\n--- LINKED CONTENT ---\n\n"
UNTITLED = "Untitled"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def url_netloc(url) -> Column:
    """Network location as ``urlparse(url).netloc`` (keeps userinfo and
    port, case kept); empty when the URL has no ``//`` authority."""
    return F.regexp_extract(col_of(url), _SCHEME + r"//([^/?#]*)", 1)


def url_path(url) -> Column:
    """``urlparse(url).path``: path without query, fragment or last-segment
    ``;params``."""
    u = col_of(url)
    with_auth = F.regexp_extract(u, _SCHEME + r"//[^/?#]*([^?#]*)", 1)
    without = F.regexp_extract(u, _SCHEME + r"([^?#]*)", 1)
    p = F.when(u.rlike(_SCHEME + "//"), with_auth).otherwise(without)
    return F.regexp_replace(p, r";[^/]*$", "")


def url_without_fragment(url) -> Column:
    return F.regexp_replace(col_of(url), "#.*$", "")


def content_kind(content_type) -> Column:
    """``pdf`` when the lower-cased content type names a PDF, else
    ``html`` (also when the type is missing)."""
    ct = F.lower(F.coalesce(col_of(content_type), F.lit("")))
    return F.when(F.contains(ct, F.lit("application/pdf")), F.lit("pdf")).otherwise(F.lit("html"))


def is_html_type(content_type) -> Column:
    """Linked pages are used only when their type is ``text/html`` (a missing
    type counts as HTML: the crawl table stores HTML pages)."""
    ct = F.lower(F.coalesce(col_of(content_type), F.lit("text/html")))
    return F.contains(ct, F.lit("text/html"))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Parse each page once; add domain, title (``Untitled`` fallback), clean
    text and the raw anchor list.  An optional ``content_type`` column is
    kept; PDF rows are left to a registered extractor (no text here)."""
    ct = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    p = spread(pages).withColumn("content_type", ct)
    p = p.withColumn("_p", F.when(content_kind(F.col("content_type")) == "html",
                                  parse_html(F.col("html"), F.col("url"))))
    return p.select(
        "page_id", "url", "content_type",
        url_netloc(F.col("url")).alias("domain"),
        F.coalesce(F.col("_p.title"), F.lit(UNTITLED)).alias("title"),
        squash_lines(F.col("_p.text")).alias("text"),
        F.col("_p.links").alias("raw_links"),
        F.col("_p.error").alias("parse_error"),
    )


def _keep_link(domain: Column):
    def keep(link):
        href = link["href"]
        skipped = href.isNull() | (href == "")
        for pre in SKIPPED_HREF_PREFIXES:
            skipped = skipped | href.startswith(pre)
        path = F.lower(url_path(link["abs_url"]))
        bad_path = F.lit(False)
        for ex in EXCLUDED_PATHS:
            bad_path = bad_path | F.contains(path, F.lit(ex))
        text = F.lower(py_strip(link["text"]))
        bad_text = F.lit(False)
        for ex in EXCLUDED_LINK_TEXT:
            bad_text = bad_text | F.contains(text, F.lit(ex))
        return (~skipped & (url_netloc(link["abs_url"]) == domain) & ~bad_path
                & (F.length(text) > 5) & ~bad_text)
    return keep


def important_links(parsed: DataFrame, max_links: int | None = None) -> DataFrame:
    """Kept, de-duplicated (first occurrence, order kept) link URLs
    per page as ARRAY<STRING>; ``max_links`` keeps the first n."""
    kept = F.filter(F.col("raw_links"), _keep_link(F.col("domain")))
    urls = F.array_distinct(F.transform(kept, lambda l: l["abs_url"]))
    if max_links is not None:
        urls = F.slice(urls, 1, max_links)
    return parsed.withColumn("links", urls)


def page_links(parsed: DataFrame, max_links: int | None = None) -> DataFrame:
    """(page_id, pos, url) with pos from 0 in link order."""
    return (important_links(parsed, max_links)
            .select("page_id", F.posexplode("links").alias("pos", "url"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def page_metadata(parsed: DataFrame, caller: dict | None = None) -> DataFrame:
    """Content metadata overlaid by caller metadata, then ``source``
    and ``source_type`` forced; ``document_name`` = caller name, else title,
    else domain."""
    caller = dict(caller or {})
    content = F.create_map(
        F.lit("source"), F.col("url"), F.lit("domain"), F.col("domain"),
        F.lit("title"), F.col("title"), F.lit("content_type"), content_kind(F.col("content_type")),
        F.lit("source_type"), F.lit("web"))
    if caller:
        given = F.create_map(*[x for k, v in caller.items() for x in (F.lit(k), F.lit(str(v)))])
        merged = F.map_zip_with(content, given, lambda k, a, b: F.coalesce(b, a))
    else:
        merged = content
    merged = F.map_zip_with(merged, F.create_map(F.lit("source"), F.col("url"),
                                                 F.lit("source_type"), F.lit("web")),
                            lambda k, a, b: F.coalesce(b, a))
    doc_name = F.coalesce(F.element_at(merged, F.lit("document_name")), F.col("title"),
                          F.col("domain"))
    return parsed.select(
        "page_id",
        doc_name.alias("document_name"),
        F.element_at(merged, F.lit("source")).alias("source"),
        F.element_at(merged, F.lit("domain")).alias("domain"),
        F.element_at(merged, F.lit("title")).alias("title"),
        F.element_at(merged, F.lit("content_type")).alias("content_type"),
        F.element_at(merged, F.lit("source_type")).alias("source_type"),
        merged.alias("metadata"),
    )


def one_page_per_url(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``_key``, the URL without its fragment; of several crawled pages with one key the
    lowest page_id stands for it."""
    keyed = parsed.withColumn("_key", url_without_fragment(F.col("url")))
    first = keyed.groupBy("_key").agg(F.min("page_id").alias("page_id"))
    return keyed.join(first, ["_key", "page_id"], "left_semi")


def first_crawl(parsed: DataFrame) -> DataFrame:
    """One page per URL, fragment included: of several crawls the lowest page_id."""
    first = parsed.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return parsed.join(first, ["url", "page_id"], "left_semi")


def linked_content(parsed: DataFrame, max_links: int | None = None,
                   links: DataFrame | None = None, materialized: bool = False) -> DataFrame:
    """For each kept link (the first ``max_links`` when given), the linked page's
    block ``--- Content from TITLE (URL) ---\\n\\nTEXT\\n\\n``.  Links whose
    target is not in the crawl or failed to parse are skipped (they still used up the cap).
    ``links`` (page_id, pos, url) replaces the links found in the pages."""
    if links is None and not materialized:
        parsed = materialize(parsed)  # read by both sides of the join
    if links is None:
        links = page_links(parsed, max_links)
    elif max_links is not None:
        links = links.where(F.col("pos") < max_links)
    links = links.withColumn("_key", url_without_fragment(F.col("url")))
    # link and page meet by number first, as in ``one_page_per_url``; texts are shuffled once
    pages = parsed.where(is_html_type(F.col("content_type")) & F.col("parse_error").isNull()).select(
        url_without_fragment(F.col("url")).alias("_key"), F.col("page_id").alias("_target"),
        F.col("title").alias("_t_title"), F.col("text").alias("_t_text"))
    first = pages.groupBy("_key").agg(F.min("_target").alias("_target"))
    joined = links.join(first, "_key").join(pages, ["_key", "_target"])
    block = F.concat(F.lit("--- Content from "), F.col("_t_title"), F.lit(" ("), F.col("url"),
                     F.lit(") ---\n\n"), F.col("_t_text"), F.lit("\n\n"))
    return joined.select("page_id", "pos", "url", block.alias("block"))


def pages_with_links(parsed: DataFrame, max_links: int | None = None,
                     follow_links: bool = True, materialized: bool = False,
                     links: DataFrame | None = None) -> DataFrame:
    """Page text plus ``--- LINKED CONTENT ---`` and the linked blocks
    joined by a newline in link order; ``linked_pages_count`` counts pages.
    A page's row holds the blocks of its own links; ``linked_content`` has
    them as rows."""
    if not follow_links:
        return parsed.select("page_id", "url", "domain", "title", "text",
                             F.lit(False).alias("includes_linked_content"),
                             F.lit(0).cast("bigint").alias("linked_pages_count"))
    if not materialized:
        parsed = materialize(parsed)
    blocks = (linked_content(parsed, max_links, links, materialized=True).groupBy("page_id")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("_b")))
    j = parsed.join(blocks, "page_id", "left")
    has = F.col("_b").isNotNull() & (F.size("_b") > 0)
    joined_blocks = F.array_join(F.transform("_b", lambda s: s["block"]), "\n")
    return j.select(
        "page_id", "url", "domain", "title",
        F.when(has, F.concat(F.col("text"), F.lit(LINKED_MARK), joined_blocks))
        .otherwise(F.col("text")).alias("text"),
        has.alias("includes_linked_content"),
        F.when(has, F.size("_b")).otherwise(F.lit(0)).cast("bigint").alias("linked_pages_count"),
    )


def url_batch(urls: DataFrame, parsed: DataFrame, collection: str = "default",
              max_links: int | None = None, follow_links: bool = True,
              chunk_size: int = CHUNK_SIZE, sep: str = PARAGRAPH_SEP,
              materialized: bool = False) -> DataFrame:
    """S9 + K3: one receipt per requested URL.  URLs found in the crawl are
    extracted, placeholder-filled and chunked (success rows with the md5
    document id and chunk count); the rest become error rows."""
    if not materialized:
        parsed = materialize(parsed)
    html_pages = parsed.where(content_kind(F.col("content_type")) == "html")
    content = pages_with_links(html_pages.where("parse_error IS NULL"), max_links, follow_links, materialized=True)
    text = empty_placeholder(F.col("text"), F.col("url"), kind="url")
    ok = one_page_per_url(content).select("_key", F.size(chunk_text(text, chunk_size, sep)).cast("bigint").alias("_n"))
    failed = (html_pages.where("parse_error IS NOT NULL")
              .groupBy(url_without_fragment(F.col("url")).alias("_key")).agg(F.min("parse_error").alias("parse_error")))
    pdf_urls = parsed.where(content_kind(F.col("content_type")) == "pdf").select(
        url_without_fragment(F.col("url")).alias("_key"), F.lit(True).alias("_pdf")).distinct()
    j = (urls.select("url").withColumn("_key", url_without_fragment(F.col("url")))
         .join(ok, "_key", "left").join(failed, "_key", "left").join(pdf_urls, "_key", "left"))
    found = F.col("_n").isNotNull()
    broken = F.concat(F.lit("Failed to process content from "), F.col("url"), F.lit(": "), F.col("parse_error"))
    missing = F.concat(F.lit("Failed to fetch content from "), F.col("url"), F.lit(": not in the crawl table"))
    no_pdf = F.concat(F.lit("Failed to process PDF content from "), F.col("url"),
                      F.lit(": no PDF extractor is available"))
    return j.select(
        "url",
        F.when(found, F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.when(found, F.md5(F.col("url"))).alias("document_id"),
        F.when(found, F.lit("html")).alias("content_type"),
        F.when(found, F.lit(collection)).alias("collection"),
        F.when(found, F.col("_n")).alias("chunks"),
        F.when(~found, F.when(F.col("parse_error").isNotNull(), broken).when(F.col("_pdf"), no_pdf)
               .otherwise(missing)).alias("error"),
    )


def host_successor_links(pages: DataFrame, max_links: int = MAX_LINKS_SINGLE) -> DataFrame:
    """A derived edge list (page_id, pos, url): each page links to the next
    ``max_links`` pages of the same host in page_id order.  Pages are ranked
    per host with the distributed row number (a host holding most pages is
    spread over many tasks) and each edge is an equi-join on (host, rank +
    offset), so no window or group ever holds a whole host."""
    from .ranking import distributed_row_number

    hosts = pages.select("page_id", "url", url_netloc(F.col("url")).alias("host"))
    ranked = distributed_row_number(hosts, ["host"], [F.col("page_id").asc()], out="host_rank")
    offsets = F.explode(F.sequence(F.lit(1), F.lit(max_links))).alias("off")
    src = ranked.select("page_id", "host", "host_rank", offsets)
    dst = ranked.select("host", F.col("host_rank").alias("_dst_rank"), F.col("url"))
    edges = src.join(dst, (src.host == dst.host) & (dst._dst_rank == src.host_rank + src.off))
    return edges.select("page_id", (F.col("off") - 1).cast("bigint").alias("pos"), "url")


# Names used by SURVEY §2 for the same operations.
url_domain = url_netloc
extract_links = page_links
