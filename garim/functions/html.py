"""Plain text of markup as a chain of regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character references that are turned back, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Scripts and styles go whole, other tags become blanks; blanks are collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for name, character in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))
