"""Text expressions: composed text, token counts, names in URLs, pattern rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import as_col

# Blanks that end a token, what a missing field reads as.
BLANKS = " \\t\\n\\r\\f"
MISSING_TEXT = "undefined"


def compose_text(fields: Sequence[str | Column], missing: str = MISSING_TEXT) -> Column:
    """The chosen fields in the given order, one space after each."""
    return F.concat(
        *[F.concat(F.coalesce(as_col(f).cast("string"), F.lit(missing)), F.lit(" ")) for f in fields]
    )


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(as_col(text), f"[{BLANKS}]+"), lambda t: t != "")


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def sanitize_id(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c).cast("string"), "[^a-zA-Z0-9_-]", "")


def url_filename(url: Column | str) -> Column:
    """Last path part of a URL, without query and fragment."""
    path = F.regexp_extract(as_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.element_at(F.split(path, "/"), -1)


def model_key(url: Column | str, host: str = r"huggingface\.co") -> Column:
    """``owner/model`` after the host; an empty text when there is none."""
    return F.regexp_extract(as_col(url), host + r"/([^/]+/[^/]+)", 1)


@dataclass(frozen=True)
class Rule:
    """Rows whose ``attr`` matches ``pattern`` get ``tag``."""

    attr: str
    pattern: str
    tag: str


def parse_pattern(text: str) -> str | None:
    """``/pattern/flags`` or plain text to a regular expression; None if invalid.

    Plain text is trimmed and still read as a pattern. Only the flags i, m and
    s change whether a text matches; g, u and y do not.
    """
    slashed = re.fullmatch(r"/(.*)/([gimsuy]*)", text)
    body, flags = (slashed[1], slashed[2]) if slashed else (text.strip(), "")
    if len(set(flags)) != len(flags):
        return None
    kept = "".join(f for f in "ims" if f in flags)
    pattern = f"(?{kept}){body}" if kept else body
    return pattern if _compiles(pattern) else None


def _compiles(pattern: str) -> bool:
    """Whether the Java engine, which will run the pattern, accepts it."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def matches(attr: Column | str, text: str, literal: bool = False) -> Column:
    """True where the attribute, read as text, matches; NULL never matches."""
    value = as_col(attr).cast("string")
    if literal:
        return F.coalesce(F.contains(value, F.lit(text.strip())), F.lit(False))
    pattern = parse_pattern(text)
    if pattern is None:
        return F.lit(False)
    return F.coalesce(value.rlike(pattern), F.lit(False))


def rule_tags(rules: Sequence[Rule], default: str = "#a9a9a9") -> Column:
    """The tag of the last rule that matches, else ``default``."""
    tag = F.lit(default)
    for rule in rules:
        tag = F.when(matches(rule.attr, rule.pattern), F.lit(rule.tag)).otherwise(tag)
    return tag
