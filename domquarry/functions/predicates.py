"""Text and node predicates as Column expressions.

All are built from ``length`` / ``rlike`` / ``contains`` / ``CASE`` and run
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that disqualify a person name.
NAME_STOP_WORDS = ["click", "here", "more", "view", "contact", "email", "phone", "representative", "experience"]
# Words that mark a job position.
POSITION_WORDS = ["partner", "associate", "counsel", "director", "manager", "senior", "junior", "lead", "head",
                  "chief"]
# Page-furniture phrases.
JUNK_PHRASES = ["your privacy choices", "cookies", "always active", "global search", "follow us",
                "connect with us", "scroll to top", "click here", "read more", "view more", "load more",
                "show more", "copyright", "all rights reserved"]
# Generic class names (E23), recorder variant.
GENERIC_CLASSES = ["container", "wrapper", "content", "main", "section", "row", "col", "column", "grid", "flex",
                   "block", "inline", "left", "right", "center", "top", "bottom", "middle", "small", "medium",
                   "large", "big", "tiny", "primary", "secondary", "tertiary", "default", "active", "inactive",
                   "disabled", "enabled", "visible", "hidden", "show", "hide", "red", "blue", "green", "yellow",
                   "black", "white", "margin", "padding", "border", "background", "text", "font", "bold", "italic",
                   "underline"]
# Path fragments of profile links.
PROFILE_PATH_PATTERNS = ["/profile/", "/person/", "/member/", "/staff/", "/team/", "/bio/", "/lawyer/",
                         "/attorney/"]
# Words that are not names in a directory.
COMMON_DIRECTORY_WORDS = ["click", "here", "more", "view", "read", "contact", "email", "phone", "address",
                          "location"]
# Job-title patterns.
JOB_TITLE_PATTERNS = [
    r"(?i)\b(manager|director|president|vice|senior|junior|lead|head|chief|officer)\b",
    r"(?i)\b(consultant|specialist|analyst|coordinator|assistant|associate)\b",
    r"(?i)\b(founder|partner|counsel|attorney|advisor)\b",
]
# URL words of a directory site.
DIRECTORY_URL_WORDS = ["people", "team", "staff", "directory", "members", "professionals"]
# Attributes that carry a link target.
LINK_TARGET_ATTRS = ["data-url", "data-href", "data-link"]


def _contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def is_valid_name(text: Column) -> Column:
    """3..60 chars, a space, upper-case first letter, no stop word."""
    first = F.substring(text, 1, 1)
    return ((F.length(text) >= 3) & (F.length(text) <= 60) & text.contains(" ")
            & (first == F.upper(first)) & (first != F.lower(first)) & ~_contains_any(text, NAME_STOP_WORDS))


def is_common_junk(text: Column) -> Column:
    return _contains_any(text, JUNK_PHRASES)


def is_valid_position(text: Column) -> Column:
    """3..100 chars, and a position word or no junk phrase."""
    return ((F.length(text) >= 3) & (F.length(text) <= 100)
            & (_contains_any(text, POSITION_WORDS) | ~is_common_junk(text)))


def candidate_is_valid(label: str, element_type: str, text: Column, href: Column) -> Column:
    """E16 per-candidate check, by label and element type."""
    lab = (label or "").lower()
    if element_type == "text":
        ok = F.length(text) >= 2
        if "name" in lab:
            return ok & is_valid_name(text)
        if "position" in lab or "title" in lab:
            return ok & is_valid_position(text)
        if "email" in lab:
            return ok & text.contains("@") & text.contains(".")
        return ok & ~is_common_junk(text)
    if element_type == "link":
        h = F.coalesce(href, F.lit(""))
        return h.startswith("http") | h.startswith("mailto:") | h.startswith("tel:")
    return F.lit(True)


def is_generic_class(name: Column) -> Column:
    """Generic word, shorter than 3, or a spacing / grid utility class."""
    low = F.lower(name)
    return (low.isin(GENERIC_CLASSES) | (F.length(name) < 3)
            | name.rlike(r"^(m|p|pt|pb|pl|pr|mt|mb|ml|mr)-?\d+$") | name.rlike(r"^col-\d+")
            | name.rlike(r"^(xs|sm|md|lg|xl)-"))


def is_profile_link(href: Column) -> Column:
    h = F.coalesce(href, F.lit(""))
    out = F.lit(False)
    for p in PROFILE_PATH_PATTERNS:
        out = out | h.contains(p)
    return out


def is_person_name(text: Column) -> Column:
    return (text.rlike(r"^[A-Z][a-z]+ [A-Z]") & (F.length(text) > 5) & (F.length(text) < 60)
            & ~_contains_any(text, COMMON_DIRECTORY_WORDS))


def is_job_title(text: Column) -> Column:
    out = F.lit(False)
    for p in JOB_TITLE_PATTERNS:
        out = out | F.coalesce(text, F.lit("")).rlike(p)
    return out


def node_role(tag: Column, href: Column, text: Column) -> Column:
    """profile_link / person_name / email / phone / job_title / NULL, in
    that order of precedence."""
    h = F.coalesce(href, F.lit(""))
    return (F.when((tag == "a") & (h != "") & is_profile_link(h), F.lit("profile_link"))
            .when(is_person_name(text), F.lit("person_name"))
            .when(h.startswith("mailto:"), F.lit("email"))
            .when(h.startswith("tel:"), F.lit("phone"))
            .when(is_job_title(text), F.lit("job_title")))


def profile_link_selector(href: Column) -> Column:
    """``a[href*='<first matching path pattern>']`` else ``a[href]``."""
    out = F.lit("a[href]")
    for p in reversed(PROFILE_PATH_PATTERNS):
        out = F.when(F.coalesce(href, F.lit("")).contains(p), F.lit(f"a[href*='{p}']")).otherwise(out)
    return out


def element_type_of(tag: Column, text: Column) -> Column:
    """E25 (recorder): a -> link, img -> image, input/textarea/select ->
    input, numeric text -> number, else text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.when(tag == "a", F.lit("link")).when(tag == "img", F.lit("image"))
            .when(tag.isin("input", "textarea", "select"), F.lit("input"))
            .when(t.rlike(r"^\$?[\d,]+\.?\d*$"), F.lit("number")).otherwise(F.lit("text")))


def template_element_type_of(tag: Column) -> Column:
    """E25 (selector generator): a -> link, img/input/textarea -> attribute."""
    return (F.when(tag == "a", F.lit("link")).when(tag.isin("img", "input", "textarea"), F.lit("attribute"))
            .otherwise(F.lit("text")))


def attribute_name_of(tag: Column) -> Column:
    """The attribute an ``attribute`` element reads."""
    return F.when(tag == "img", F.lit("src")).when(tag.isin("input", "textarea"), F.lit("value"))


def is_directory_url(url: Column) -> Column:
    """E26, URL part: the page URL names a directory."""
    return _contains_any(F.coalesce(url, F.lit("")), DIRECTORY_URL_WORDS)


def link_target(tag: Column, attrs: Column) -> Column:
    """Href of an anchor, else data-url / data-href / data-link."""
    return F.coalesce(F.when(tag == "a", F.nullif(attrs["href"], F.lit(""))),
                      *[F.nullif(attrs[a], F.lit("")) for a in LINK_TARGET_ATTRS])
