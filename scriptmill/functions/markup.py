"""Markup to plain text."""

from pyspark.sql import Column, functions as F

from scriptmill.functions.chars import WS, column, strip

# Named entities that are decoded; the ampersand comes last so nothing is decoded twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
            "&amp;": "&"}


def plain_text(markup) -> Column:
    """Tags become spaces, common entities are decoded, white space is collapsed."""
    out = F.regexp_replace(column(markup), r"<[^>]*>", " ")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(out, rf"[{WS}]+", " "))


def page_text(html) -> Column:
    """`plain_text` of a page without its scripts, styles and comments."""
    out = F.regexp_replace(column(html), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script>", " ")
    return plain_text(F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style>", " "))
