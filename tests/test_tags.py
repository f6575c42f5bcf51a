"""Validation and repair of tagged text."""

import pytest

from scriptmill.functions import tagging
from scriptmill.operators import tags

LINES = 'Sam came in.\n"Hi there." he said and laughed\n...\nThey all went home after that.'


@pytest.mark.parametrize("enhanced, reason", [
    (LINES, None),
    ("`" + LINES.replace('there.', 'there <laugh>.') + "`", None),
    (LINES + " <smile>", "Invalid emotion tags found: <smile>"),
    ("<text>" + LINES + "<b>", "Structural markup leaked from prompt: <text>"),
    (LINES + " more", "Text content was modified beyond adding tags."),
    (LINES.replace("\n", " "), "Line structure changed (4 -> 1 lines)"),
    (LINES.replace("came", "ca<sigh>me"), "Emotion tags breaking words detected"),
    ("<sigh> " + LINES + " <laugh>", "Excessive emotion tags detected (2 tags for 16 words)"),
    (LINES + " <sigh> <sigh>", "Consecutive emotion tags detected"),
    (None, "No response"),
])
def test_reasons(spark, enhanced, reason):
    df = spark.createDataFrame([(enhanced, LINES)], "enhanced string, original string")
    row = tags.validate_chunks(df).first()
    assert (row["reason"], row["success"], row["reverted"]) == (reason, reason is None, reason is not None)
    assert reason is None or row["text"] == LINES
    assert df.select(tagging.validate_tagged("enhanced", "original").alias("v")).first()["v"]["text"] == row["text"]


@pytest.mark.parametrize("text, original, reason", [
    ("a > b", "a > b", "Malformed emotion tags found"), ("a < b", "a < b", "Malformed emotion tags found"),
    ("a &lt; b", "a &lt; b", "HTML entities found in emotion tags")])
def test_reasons_from_the_original(apply, text, original, reason):
    assert apply(tagging.reject_reason, [(text, original)], "x string, y string") == [reason]


def test_move_tag(apply):
    cases = {'"Hi."': '"Hi <laugh>."', '"Hi"': '"Hi <laugh>."', '"a" x "a" "b"': '"a <laugh>." x "a <laugh>." "b"',
             "none": "none", '""': '" <laugh>."', '"': '"', '"so," he': '"so <laugh>," he'}
    got = apply(tagging.move_tag_to_dialogue, [(k, "<laugh>") for k in cases], "x string, y string")
    assert got == list(cases.values())


def test_fix_tag_punctuation(apply):
    cases = {'"a <sigh>"': '"a <sigh>."', '"a <sigh>!"': '"a <sigh>!"', '"a <sigh> b"': '"a <sigh> b"',
             '"x <sigh>." y <yawn>"': '"x <sigh>." y <yawn>"', '"a" <sigh>"b"': '"a" <sigh>."b"', "<sigh>": "<sigh>"}
    assert apply(tagging.fix_tag_punctuation, list(cases)) == list(cases.values())


def test_repair_orphans(apply):
    cases = [
        (('"Hi." he said\n<laugh> ok', '"Hi." he said\nok'), '"Hi <laugh>." he said\nok'),
        (("plain\n<laugh>", "plain\nback"), "plain\nback"),
        (("<laugh>\nplain long enough", "first\nplain"), "first\nplain long enough"),
        (('"a"\n"b <sigh>"\n<yawn>', '"a"\n"b"\nc'), '"a <sigh>."\n"b  <yawn>."\nc'),
        (('a long enough line <sigh>', "x"), "a long enough line <sigh>"),
    ]
    assert apply(tagging.repair_orphans, [c[0] for c in cases], "x string, y string") == [c[1] for c in cases]


def sequential_repair(text, original):
    """The repair as a walk over the lines that changes the line before."""
    import re
    tag = "<(?:laugh|chuckle|sigh|cough|sniffle|groan|yawn|gasp)>"
    out = []
    for i, line in enumerate(text.split("\n")):
        found = re.findall(tag, line)
        bare = re.sub(tag + r"\s*", "", line).strip()
        kept = line
        if found and len(bare) < 10:
            if out and '"' in out[-1]:
                hit = re.search('"([^"]*)"', out[-1])
                if hit:
                    said = hit.group(1)
                    new = (f"{said[:-1]} {found[0]}{said[-1]}" if said and said[-1] in ".!?,:;"
                           else f"{said} {found[0]}.")
                    out[-1] = out[-1].replace(f'"{said}"', f'"{new}"')
            originals = original.split("\n")
            kept = bare or (originals[i] if i < len(originals) else "")
        if '"' in kept and re.search(tag, kept):
            kept = re.sub(f'"([^"]*{tag}[^"]*)"', lambda m: m.group(0) if re.search(
                tag + r"\s*[.!?]", m.group(1)) or not m.group(1).endswith(">") else f'"{m.group(1)}."', kept)
        out.append(kept)
    return "\n".join(out)


def test_repair_matches_a_walk(apply):
    import random
    rng = random.Random(8)
    bits = ['"hi."', '"so"', "<sigh>", "<yawn>", "words here now", '"', "ok", "!"]
    cases = [("\n".join(" ".join(rng.choices(bits, k=rng.randint(0, 3))) for _ in range(rng.randint(1, 5))),
              "\n".join(rng.choice(["x", '"y <laugh>"', ""]) for _ in range(rng.randint(1, 5)))) for _ in range(600)]
    got = apply(tagging.repair_orphans, cases, "x string, y string")
    assert got == [sequential_repair(*c) for c in cases]


def test_fallback_and_reassembly(spark):
    lines = [("b", i, t) for i, t in enumerate(LINES.split("\n") + ["last line"])]
    book = spark.createDataFrame(lines, "book_id string, line_no long, line string")
    enhanced = LINES.replace("came", "came <gasp>").replace("home", "h<sigh>ome")
    chunks = spark.createDataFrame([("b", 0, 4, LINES, enhanced), ("b", 4, 6, "last line", "last line")],
                                   "book_id string, start_line long, end_line long, original string, enhanced string")
    checked = tags.fallback_by_line(tags.validate_chunks(chunks))
    rows = tags.reassemble(book, checked).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == [LINES.split("\n")[0].replace("came", "came <gasp>"),
                                         *LINES.split("\n")[1:], "last line"]
    assert [r["replaced"] for r in rows] == [True] * 4 + [False]


def test_flag_orphans(spark):
    df = spark.createDataFrame([(0, "<sigh> ok"), (1, "ok"), (2, "a line of words <sigh>")], "line_no long, line string")
    assert [r["line_no"] for r in tags.flag_orphans(df).collect()] == [0]


def test_overlapping_chunks_leave_the_book_alone(spark):
    book = spark.createDataFrame([(b, i, f"l{i}") for b in "bc" for i in range(3)], "book_id string, line_no long, line string")
    chunks = spark.createDataFrame([("b", 0, 2, "A\nB"), ("b", 1, 3, "C\nD"), ("c", 1, 3, "E\nF")],
                                   "book_id string, start_line long, end_line long, text string")
    rows = [tuple(r) for r in tags.reassemble(book, chunks).orderBy("book_id", "line_no").collect()]
    assert rows == [("b", i, f"l{i}", False, tags.OVERLAP) for i in range(3)] + [
        ("c", 0, "l0", False, None), ("c", 1, "E", True, None), ("c", 2, "F", True, None)]
