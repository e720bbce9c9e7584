"""Text functions as Column expressions: cleaning, parsing, naming, redaction, formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line beginnings of boilerplate, in lower case.
BOILERPLATE = [
    "skip to main content",
    "skip to content",
    "on this page",
    "jump to section",
    "table of contents",
    "back to top",
    "cookie preferences",
    "we use cookies",
    "accept all cookies",
    "© [0-9]{4} red hat",
    "all rights reserved",
    "privacy statement",
    "terms of use",
    "print this",
    "was this helpful",
    "edit this page",
]
MIN_BODY_CHARS = 200
# Names of secrets, the form of a token, the mark that takes their place.
SECRET_NAMES = ["client_secret", "password", "secret", "authorization"]
TOKEN = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
SENSITIVE_FIELDS = ["client_secret", "access_token", "refresh_token", "authorization", "password", "secret", "sub"]
REDACTED = "[REDACTED]"
# Passage types of headings and captions, document-type prefixes.
HEADING_TYPES = ["title_1", "title_2", "abstract_title_1"]
CAPTIONS = {"table_caption": "Table:", "fig_caption": "Figure:"}
DOC_TYPES = ["SB", "SL", "SSL", "VSP", "CIL"]


def strip_boilerplate(text: Column) -> Column:
    """Blank every line that begins like boilerplate; one pass for all patterns."""
    return F.regexp_replace(text, f"(?im)^({'|'.join(BOILERPLATE)}).*$", "")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_blank(text: Column) -> Column:
    """At most one blank line in a row, none at either end."""
    return trim_all(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalized(text: Column) -> Column:
    """Cleaned body; null where fewer than ``MIN_BODY_CHARS`` characters are left."""
    clean = collapse_blank(strip_boilerplate(F.coalesce(text, F.lit(""))))
    return F.when(F.length(clean) >= MIN_BODY_CHARS, clean)


def tokens(text: Column) -> Column:
    """Words between ASCII white space: the default tokenizer."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+"), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def title_of(markdown: Column, fallback: Column) -> Column:
    """First heading of level 1, else the first heading, else ``fallback``."""
    first = lambda pattern: F.nullif(F.regexp_extract(markdown, pattern, 1), F.lit(""))
    return F.coalesce(first(r"(?m)^#[ \t]+(\S.*?)[ \t]*$"), first(r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t]*$"), fallback)


def sections_of(markdown: Column) -> Column:
    """Headings as array<struct<heading, level, char_offset>>: a fold over the lines carries the offset."""
    zero = F.expr("named_struct('at', 0, 'out', CAST(array() AS array<struct<heading: string, level: int, char_offset: int>>))")

    def step(acc: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
        heading = F.regexp_extract(line, r"^#{1,6}\s+(.+?)\s*$", 1)
        item = F.struct(heading.alias("heading"), level.alias("level"), acc["at"].alias("char_offset"))
        out = F.when(level > 0, F.concat(acc["out"], F.array(item))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), out.alias("out"))

    return F.aggregate(F.split(markdown, "\n"), zero, step, lambda acc: acc["out"])


def section_at(sections: Column, offset: Column) -> Column:
    """The last heading at or before an offset; null before the first."""
    return F.try_element_at(F.filter(sections, lambda s: s["char_offset"] <= offset), F.lit(-1))["heading"]


def chunk_offset(text: Column, chunk: Column) -> Column:
    """First place of the chunk's first 32 characters, else 0."""
    return F.greatest(F.instr(text, F.substring(chunk, 1, 32)) - 1, F.lit(0))


def content_kind(content_type: Column) -> Column:
    """Parser for a content type; markdown where nothing else fits."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(F.contains(t, F.lit("html")), "html").when(F.contains(t, F.lit("pdf")), "pdf").when(F.contains(t, F.lit("markdown")), "markdown").when(F.contains(t, F.lit("plain")), "plain").otherwise("markdown")


def html_title(html: Column) -> Column:
    return html_unescape(trim_all(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_unescape(text: Column) -> Column:
    """The entities that markup needs; ``&amp;`` last, so that nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


# Slips of extraction in titles, and the phrase of a title that is right as it stands.
TITLE_SLIPS = [("VA/DOD", "VA/DoD"), ("DIAGNOSI S", "DIAGNOSIS")]
GUIDELINE = r"(?i)CLINICAL PRACTICE GUIDELINE(?!S)\b"


def guideline_title(title: Column, headings: Column) -> Column:
    """A title without slips; the first heading that names a guideline where the title doesn't; capitals where one does."""

    def mended(t: Column) -> Column:
        t = html_unescape(t)
        for slip, right in TITLE_SLIPS:
            t = F.replace(t, F.lit(slip), F.lit(right))
        return t

    named = F.get(F.filter(F.transform(headings, mended), lambda h: F.rlike(h, F.lit(GUIDELINE))), F.lit(0))
    own = mended(title)
    chosen = F.when(F.rlike(own, F.lit(GUIDELINE)), own).otherwise(F.coalesce(named, own))
    slip, right = TITLE_SLIPS[0]
    return F.when(F.rlike(chosen, F.lit(GUIDELINE)), F.replace(F.upper(chosen), F.lit(slip), F.lit(right))).otherwise(chosen)


def chunker_label(params: Column) -> Column:
    """``method-size-overlap`` of a chunker's parameters, written as a literal with single or double quotes; null if one is missing."""
    value = lambda name: F.nullif(F.regexp_extract(params, rf"""['"]{name}['"]\s*:\s*['"]?([^'",}}\s]+)""", 1), F.lit(""))
    parts = [value(name) for name in ("chunk_method", "chunk_size", "chunk_overlap")]
    return F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])


def html_to_markdown(html: Column) -> Column:
    """Main text of a page: no scripts or styles, ``main`` before ``article`` before ``body``, headings as ``#``."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    part = lambda tag: F.nullif(F.regexp_extract(bare, rf"(?is)<{tag}[^>]*>(.*)</{tag}>", 1), F.lit(""))
    text = F.coalesce(part("main"), part("article"), part("body"), bare)
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    text = F.regexp_replace(text, r"(?i)<(p|div|li|tr|br)[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    return collapse_blank(F.regexp_replace(html_unescape(text), r"[ \t]*\n[ \t]*", "\n"))


def redact(text: Column) -> Column:
    """Tokens and ``name=value`` secrets give way to a mark; the name stays."""
    plain = F.regexp_replace(text, TOKEN, REDACTED)
    return F.regexp_replace(plain, rf"(?i)({'|'.join(SECRET_NAMES)})\s*[=:]\s*\S+", f"$1={REDACTED}")


def doc_type(name: Column) -> Column:
    found = F.regexp_extract(name, rf"(?i)^({'|'.join(DOC_TYPES)})[_ ]", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "OTHER").otherwise(F.upper(found))


def slug_error(slug: Column) -> Column:
    """Why a slug is not valid; null if it is."""
    s = F.coalesce(slug, F.lit(""))
    return (
        F.when(s == "", "slug is empty")
        .when(F.contains(s, F.lit("--")), "slug holds a double hyphen")
        .when(~s.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"), "slug must be lower-case letters, digits and inner hyphens")
    )


def table_name(slug: Column) -> Column:
    return F.concat(F.lit("idx_"), F.translate(slug, "-", "_"), F.lit("_v1"))


def repo_of_remote(url: Column) -> Column:
    """owner/repo of an https or ssh remote; null for anything else."""
    take = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(take(r"^https?://github\.com/([^/]+/[^/]+?)(?:\.git)?$"), take(r"^git@github\.com:([^/]+/[^/]+?)(?:\.git)?$"))


def doc_id_of_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def stem_title(stem: Column) -> Column:
    """Words of a file stem, each with a capital."""
    return F.initcap(F.translate(stem, "-", " "))


def first_sentence(text: Column) -> Column:
    head = F.get(F.split(text, r"\. ", 2), F.lit(0))
    return F.when(F.endswith(head, F.lit(".")), head).otherwise(F.concat(head, F.lit(".")))


def like_escape(pattern: str) -> str:
    """A literal for LIKE with ``!`` as escape."""
    return pattern.replace("!", "!!").replace("%", "!%").replace("_", "!_")


def passage_text(text: Column, kind: Column) -> Column:
    """A passage with the prefix of its type."""
    t = F.trim(F.coalesce(text, F.lit("")))
    out = F.when(t == "", "").when(kind.isin(HEADING_TYPES), F.concat(F.lit("# "), t, F.lit("\n")))
    for name, prefix in CAPTIONS.items():
        out = out.when(kind == name, F.concat(F.lit(f"{prefix} "), t))
    return out.otherwise(t)


def authors_of(infons: Column) -> Column:
    """Names of ``name_0``, ``name_1`` … up to the first gap, given name first."""
    keys = F.transform(F.sequence(F.lit(0), F.size(infons)), lambda i: F.concat(F.lit("name_"), i.cast("string")))
    raw = F.transform(keys, lambda k: F.try_element_at(infons, k))
    gap = F.coalesce(F.array_position(F.transform(raw, lambda x: x.isNull()), F.lit(True)), F.lit(0))
    upto = F.slice(raw, F.lit(1), F.greatest(gap - 1, F.lit(0)).cast("int"))

    def name(value: Column) -> Column:
        part = lambda key: F.regexp_extract(value, rf"(?:^|;){key}:([^;]*)", 1)
        return F.trim(F.concat(part("given-names"), F.lit(" "), part("surname")))

    return F.filter(F.transform(upto, name), lambda x: x != "")


def keywords_of(raw: Column) -> Column:
    return F.filter(F.split(F.coalesce(raw, F.lit("")), r"\s+"), lambda x: x != "")


def canonical_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def fingerprint(*parts: Column) -> Column:
    """16 digits over the 12-digit hashes of the parts of a configuration."""
    inner = [F.substring(F.sha2(p, 256), 1, 12) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *inner), 256), 1, 16)


def base_url(url: Column) -> Column:
    return F.regexp_replace(url, r"(/v1)?(/chat/completions|/embeddings)?/*$", "")


def chunker_summary(size: Column, overlap: Column) -> Column:
    return F.concat(size.cast("string"), F.lit(" tok / "), overlap.cast("string"), F.lit(" overlap"))


def signed(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", value)


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(f"{name} ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).when(s < 2592000, unit(86400, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))
