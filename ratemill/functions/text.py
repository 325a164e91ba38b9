"""Text: aliases, HTML, links, fingerprints, languages. All are expressions over columns; nothing here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _aliases(table: str) -> dict[str, tuple[str, ...]]:
    """name: other names, ... ; the name itself is one too."""
    rows = (x.split(":") for x in table.split(";"))
    return {n.strip(): (n.strip().lower(), *[a.strip() for a in more.split(",")]) for n, more in rows}


CURRENCIES = _aliases("AED: dirham, درهم; EUR: euro, یورو; GBP: pound, پوند; TRY: lira, لیر; USD: us dollar, دلار")
CITIES = _aliases(
    "Ahvaz: اهواز; Dubai: دبی, دوبی; Frankfurt: فرانکفورت; Hamburg: هامبورگ; Herat: هرات; Isfahan: اصفهان; Istanbul: استانبول; Karaj: کرج; Kerman: کرمان; "
    "London: لندن; Mashhad: مشهد; Qom: قم; Rasht: رشت; Shiraz: شیراز; Tabriz: تبریز; Tehran: تهران"
)


def contains_any(text: Column, words: tuple[str, ...], lowered: bool = False) -> Column:
    """Whether a word occurs, in whatever case; lowered: the text is in lower case already."""
    low = text if lowered else F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return hit


def alias_hits(text: Column, aliases: dict[str, tuple[str, ...]], lowered: bool = False) -> Column:
    """Sorted names of which an alias occurs in the text."""
    low = text if lowered else F.lower(text)
    return F.array_compact(F.array(*[F.when(contains_any(low, aliases[name], True), F.lit(name)) for name in sorted(aliases)]))


def alias_counts(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """An array of (n, ordinal, name): how often the aliases of each name occur."""
    low = F.lower(text)
    parts = []
    for k, (name, words) in enumerate(aliases.items()):
        n = F.lit(0)
        for w in words:
            n = n + F.regexp_count(low, F.lit(rf"\Q{w.lower()}\E"))
        parts.append(F.struct(n.alias("n"), F.lit(-k).alias("ordinal"), F.lit(name).alias("name")))
    return F.array(*parts)


def best_alias(text: Column, aliases: dict[str, tuple[str, ...]], other: str = "unknown") -> Column:
    """The name whose aliases occur most, the first of equals."""
    # a one-element array, so that the counts are written down once
    return F.transform(F.array(F.array_max(alias_counts(text, aliases))), lambda top: F.when(top["n"] > 0, top["name"]).otherwise(other))[0]


def clean_html(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags, the common entities resolved, blanks folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def title_of(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)), F.lit(""))


def meta_of(html: Column, name: str) -> Column:
    """The content of a meta tag by its property or name."""
    return F.nullif(F.regexp_extract(html, rf"""(?is)<meta\b[^>]*?\b(?:name|property)=["']{name}["'][^>]+content=["']([^"']*)["']""", 1), F.lit(""))


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))


def domain_of(url: Column) -> Column:
    """Host in lower case without www. and port."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def website(url: Column) -> Column:
    """Scheme, host and path without query, fragment and final slash; NULL unless http or https."""
    u = F.trim(url)
    return F.nullif(F.concat(F.lower(F.regexp_extract(u, r"^(https?)://", 1)), F.when(u.rlike("^https?://"), "://"), F.coalesce(domain_of(u), F.lit("")), F.regexp_replace(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")), F.lit(""))


def fingerprint(text: Column, length: int = 140) -> Column:
    """The form of a message: digits become 0, blanks are folded."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+", " ")), 1, length)


def language(text: Column) -> Column:
    """By script, then by marker words."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return (
        F.when(text.rlike(r"[\x{0600}-\x{06FF}]"), "fa").when(text.rlike(r"[\x{0400}-\x{04FF}]"), "ru").when(low.rlike(r"[ßäöü]| der | und | das "), "de")
        .when(low.rlike(r"[ñ]| los | del | una "), "es").when(low.rlike(r"[èêç]| les | des | une "), "fr").when(low.rlike(r" the | and | of "), "en").otherwise("unknown")
    )


def normal_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def symbol_token(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    """Distinct trimmed parts of a list joined by bars or commas."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[|,]"), lambda x: F.trim(x)), lambda x: x != ""))


def source_key(platform: Column, handle: Column, url: Column) -> Column:
    """platform:handle for channels, else the platform and the bare URL."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(F.nullif(handle, F.lit("")), url))), r"^(https?://)?(www\.)?(t\.me/(s/)?)?@?|/+$", "")
    return F.when(bare != "", F.concat(F.lower(platform), F.lit(":"), bare))
