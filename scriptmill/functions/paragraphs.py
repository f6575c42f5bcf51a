"""Paragraph form of a text for a model request, and back."""

from pyspark.sql import Column, DataFrame, functions as F

from scriptmill import fixed
from scriptmill.functions.chars import WS, column, is_blank, let, lines_of
from scriptmill.functions.markup import page_text, plain_text

# White space that stays on its line.
GAP = rf"{WS}&&[^\n]"


def join_paragraphs(text) -> Column:
    """Consecutive non-blank lines on one line, the line ends shown by a marker."""
    text = column(text)
    searched = F.regexp_replace(text, rf"(?<=[^{WS}])([{GAP}]*)\n(?=[{GAP}]*[^{WS}])", "$1" + fixed.LINE_MARKER)
    # Without a blank line each line end is one between two lines of a paragraph.
    return F.when(F.exists(lines_of(text), is_blank), searched).otherwise(
        F.replace(text, F.lit("\n"), F.lit(fixed.LINE_MARKER)))


def paragraph_sizes(text) -> Column:
    """Lines per paragraph of the joined text, 0 for a blank line."""
    lines = lines_of(text)
    # A marker per line: n for a blank line, y for others; runs of y are paragraphs.
    shape = F.array_join(F.transform(lines, lambda ln: F.when(is_blank(ln), "n").otherwise("y")), "")
    runs = F.regexp_extract_all(shape, F.lit("y+|n"), F.lit(0))
    return F.transform(runs, lambda r: F.when(r == "n", 0).otherwise(F.length(r)))


def split_paragraphs(text, sizes) -> Column:
    """Lines of a joined text again. A paragraph with another line count stays one line."""
    def restored(s):
        def restore(paragraph, i):
            size = F.get(s["sizes"], i)

            def kept(parts):
                return (F.when(size.isNull(), F.array(paragraph))
                        .when(size == 0, F.array(F.lit("")))
                        .when(F.size(parts) == size, parts)
                        .otherwise(F.array(paragraph)))

            return let(F.split(paragraph, r" \|\|\| ", -1), kept)

        return F.array_join(F.flatten(F.transform(s["lines"], restore)), "\n")

    # Sizes are made once a text, not once a paragraph.
    return let(F.struct(lines_of(text).alias("lines"), column(sizes).alias("sizes")), restored)


def with_top_snippets(df: DataFrame, html: str, out: str, count: int = 5,
                      width: int = 500) -> DataFrame:
    """Adds `out`: texts of a page's first paragraphs, or pieces of the text of a page without."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    texts = F.filter(F.transform(blocks, plain_text), lambda t: t != "")
    none = F.array().cast("array<string>")
    # Staged columns: each is evaluated once, and the whole text only where it is needed.
    staged = df.withColumn("__texts", F.slice(texts, 1, count)).withColumn(
        "__whole", F.when(F.size("__texts") == 0, page_text(html)))
    whole = F.col("__whole")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.length(whole) - 1) / width), F.lit(0))),
        lambda i: F.substring(whole, (i * width + 1).cast("int"), F.lit(width)))
    return staged.withColumn(out, F.when(F.size("__texts") > 0, F.col("__texts")).when(
        whole == "", none).otherwise(F.slice(pieces, 1, count))).drop("__texts", "__whole")
