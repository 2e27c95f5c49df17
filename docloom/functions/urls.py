"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are no pages; path segments of pages that are no documentation, and those of
# generated pages that a crawl leaves out besides.
ASSETS = "png jpg jpeg gif svg ico css js mjs json xml zip tar gz bz2 whl pdf woff woff2 ttf eot mp4 webm inv txt".split()
NOISE = "changelog changelogs releases release-notes updates news history whats-new what-is-new".split()
CRAWL_NOISE = NOISE + "genindex py-modindex modindex search _modules _sources _static _downloads _images".split()
HTML_TYPES = ["text/html", "application/xhtml+xml"]


def canonical_url(url: Column) -> Column:
    """Without query and fragment, scheme and host in lower case, ``/index.html`` folded; null if not http(s)."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.lower(F.regexp_extract(bare, r"^(?i)(https?://[^/]+)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?i)https?://[^/]+(.*)$", 1), r"/index\.html?$", "/")
    return F.when(head != "", F.concat(head, F.when(path == "", "/").otherwise(path)))


def resolved(base: Column, href: Column) -> Column:
    """``href`` against the page's URL: absolute, host-relative, or relative with leading dots; else null."""
    root = F.regexp_extract(base, r"^(?i)(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    up = F.regexp_replace(folder, r"[^/]+/$", "")
    return (
        F.when(href.rlike(r"^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(?i)(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (href == ""), F.lit(None).cast("string"))
        .when(href.startswith("../"), F.concat(F.when(F.length(up) > F.length(root), up).otherwise(folder), F.substring(href, F.lit(4), F.length(href))))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^\./", "")))
    )


def links(html: Column) -> Column:
    """Targets of the anchors, in order, repeated ones included."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def dedup_key(url: Column) -> Column:
    return F.regexp_replace(canonical_url(url), "/+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^(?i)https?://[^/]+(/.*)$", 1)


def scope_of(url: Column) -> Column:
    """The folder a crawl that starts here stays in."""
    path = path_of(url)
    last = F.substring_index(path, "/", -1)
    return F.when(path == "", "/").when(path.endswith("/"), path).when(last.contains("."), F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.concat(path, F.lit("/")))


def in_scope(url: Column, start: Column) -> Column:
    same = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#]+)", 1)) == F.lower(F.regexp_extract(start, r"^(?i)https?://([^/?#]+)", 1))
    return same & F.startswith(path_of(canonical_url(url)), scope_of(start))


def label_of(url: Column) -> Column:
    """Path without leading slash and last suffix; the URL itself where nothing is left."""
    bare = F.regexp_replace(F.btrim(path_of(url), F.lit("/")), r"(?<=[^/])\.[^./]+$", "")
    return F.when(bare == "", url).otherwise(bare)


def is_noise(url: Column, names: list[str] = CRAWL_NOISE) -> Column:
    """Whether a path segment, or one without its suffix, names something that is no documentation."""
    segments = F.split(F.lower(path_of(url)), "/")
    stems = F.transform(segments, lambda s: F.regexp_replace(s, r"(?<=.)\.[^.]+$", ""))
    return F.arrays_overlap(F.concat(segments, stems), F.array(*[F.lit(x) for x in names]))


def is_asset(url: Column) -> Column:
    last = F.lower(F.substring_index(path_of(url), "/", -1))
    return F.regexp_extract(last, r"\.([^.]+)$", 1).isin(ASSETS) | (last == "objects.inv")
