"""Lines and scripts as an engine reads them."""

from scriptmill.plans import narration

LINES = "book_id string, line_no long, line string"
SCRIPT = "book_id string, item_no long, speaker string, line string"


def test_tagged_books_are_their_tagged_lines(spark):
    lines = spark.createDataFrame([("a", 0, "Title"), ("a", 1, "It was 3:30 PM when he came"), ("a", 2, ""), ("a", 3, None),
                                   ("b", 0, "One"), ("b", 1, "it went on and on")], LINES)
    tagged = spark.createDataFrame([("b", 0, "it went <sigh> on and on"), ("c", 0, "no such book: kept")], LINES)
    def got(*args):
        return {(r["book_id"], r["line_no"]): r["line"] for r in narration.prepared_lines(lines, *args).collect()}
    own = {("a", 0): "Title.", ("a", 1): "It was 3.30 PM when he came.", ("a", 2): "", ("a", 3): None}
    assert got("orpheus", tagged) == {
        **own, ("b", 0): "it went <sigh> on and on", ("c", 0): "no such book: kept"}
    assert got("orpheus") == {**own, ("b", 0): "One.", ("b", 1): "it went on and on."}
    assert got("kokoro") == {(r["book_id"], r["line_no"]): r["line"] for r in lines.collect()}
    assert got("orpheus", tagged.limit(0)) == got("orpheus")


def test_scripts_take_tags_or_lose_them(spark):
    script = spark.createDataFrame([("a", 0, "mia", '"Oh <laugh> no"'), ("a", 1, None, "and so on and so forth"),
                                    ("b", 0, "sam", "well <sigh>"), ("b", 1, "sam", "")], SCRIPT)
    tagged = spark.createDataFrame([("a", 0, '"Oh no <gasp>!"'), ("a", 1, "and so on and so forth"), ("b", 0, "x")], LINES)
    def got(*args):
        return {(r["book_id"], r["item_no"]): (r["speaker"], r["line"])
                for r in narration.prepared_script(script, *args).collect()}
    assert got("kokoro") == {("a", 0): ("mia", '"Oh no"'), ("a", 1): (None, "and so on and so forth"),
                             ("b", 0): ("sam", "well "), ("b", 1): ("sam", "")}
    assert got("kokoro", tagged) == {("a", 0): ("mia", '"Oh no <gasp>!"'), ("a", 1): (None, "and so on and so forth"),
                                     ("b", 0): ("sam", "well <sigh>"), ("b", 1): ("sam", "")}
    assert got("orpheus", tagged)["a", 1] == (None, "and so on and so forth.")
    assert got("orpheus", tagged)["b", 1] == ("sam", "")
