"""Column functions on edge cases."""

import pytest
from pyspark.sql import functions as F

from scriptmill.functions import clean, paragraphs, segment, speech, tokens
from scriptmill.functions.chars import WS_CHARS, is_blank, strip, words_of
from scriptmill.functions.markup import page_text
from scriptmill.operators.registry import gender_score
from scriptmill.plans import narration


def pairs(apply, fn, cases):
    assert apply(fn, list(cases)) == list(cases.values())


def test_strip_and_blank_follow_unicode(apply):
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert sorted(every) == sorted(WS_CHARS)
    assert apply(strip, [every + "a b" + every, every, ""]) == ["a b", "", ""]
    assert apply(is_blank, [every, "​", "x"]) == [True, False, False]
    assert apply(words_of, [f" a{every}b ", " "]) == [["a", "b"], []]


def test_ascii_punct(apply):
    pairs(apply, clean.ascii_punct, {"“a” ‘b’ — – …": "\"a\" 'b' - - ..."})


def test_normalize_line_breaks(apply):
    pairs(apply, clean.normalize_line_breaks, {
        " a \r\n\r\n b\x0bc  \x85d ": "a\nb\nc\nd", "": "", "\n \n": ""})


def test_close_quotes(apply):
    pairs(apply, clean.close_quotes, {
        'a" b "c"': 'a" "b "c"', '"': '""', '""a"': '"""a"', 'ab"': '"ab"', '"ab': '"ab"',
        '"x"': '"x"', "": "", '" a"b"': '"" a"b"'})


def quoted_by_search(line):
    """The rule as a search for the place farthest from the last quote."""
    if line.count('"') % 2 == 0:
        return line
    if not line.endswith('"'):
        return line + '"'
    free = [i for i, c in enumerate(line) if c != '"' and line[i - 1:i] != '"'
            and line[i + 1:i + 2] != '"']
    spot = max(free, key=lambda i: (len(line) - 1 - i), default=0)
    return line[:spot] + '"' + line[spot:]


def test_close_quotes_random(apply):
    import random
    rng = random.Random(1)
    lines = ["".join(rng.choice('ab" ') for _ in range(rng.randint(0, 12))) for _ in range(800)]
    assert apply(clean.close_quotes, lines) == [quoted_by_search(x) for x in lines]


def test_fix_unterminated_quotes(apply):
    pairs(apply, clean.fix_unterminated_quotes, {'"a\r\n \nb"c': '"a"\nb"c"', "": ""})


def test_extract_main_content(apply):
    long = "word " * 30
    pairs(apply, clean.extract_main_content, {
        f"x PROLOGUE PROLOGUE\nThe Book\n{long}\nend\nmy PARTY ABOUT THE AUTHOR z": f"{long}\nend",
        "PROLOGUE short ABOUT THE AUTHOR": "PROLOGUE short ABOUT THE AUTHOR",
        f"prologue {long} ABOUT THE AUTHOR": f"prologue {long} ABOUT THE AUTHOR",
        "PROLOGUE " + "part\n" * 40 + "ABOUT THE AUTHOR": ""})


def test_is_only_punctuation(apply):
    pairs(apply, clean.is_only_punctuation, {
        "": True, " 　": True, '?! "—…': True, "…a": False, "“": False, "[x]": False, "^_`": True})


def test_strip_thinking(apply):
    pairs(apply, clean.strip_thinking, {
        "<think>x\ny</think>ok": "ok", "junk</think>ok": "ok", " a<think>b": "ab", "": ""})


def test_emotion_tags(apply):
    pairs(apply, clean.strip_emotion_tags, {"a <sigh>  b<laugh>": "a b", "<smile>": "<smile>"})
    pairs(apply, clean.has_emotion_tag, {"x<yawn>": True, "<Yawn>": False})


def test_metadata_values(apply):
    assert apply(clean.escape_metadata, ['a "b" $<é>;', None, ""]) == ['a \\"b\\" é;', "", ""]
    pairs(apply, clean.sanitize_title, {
        "Chapter 1: It's \"A/B\" & C.d": "Chapter 1 Its A B and C d", "é*?": "", " a  b ": "a b"})


def test_speakable_text(apply):
    assert apply(clean.speakable_text, [' "a\\b" ', "...", ""]) == ["ab", None, None]


def test_is_safe_path(apply):
    assert apply(clean.is_safe_path, [
        "a/b c.txt", "a/", "a", "a/../b.txt", "a;b.txt", "", None, "it's, v1.2.epub", "a.b/c"]) == [
        True, True, False, False, False, False, False, True, False]


def test_parse_key_values(apply):
    assert apply(clean.parse_key_values, ["A : 1\nno\nB: x: y\nA: 2\nC: ", "none"]) == [
        {"A": "2", "B": "x: y", "C": ""}, {}]


def test_parse_probe_json(apply):
    good = '{"streams":[{"codec_type":"video"},{"codec_type":"audio","sample_rate":"8000","channels":2}]%s}'
    values = apply(clean.parse_probe_json, [
        good % ',"format":{"duration":"1.5"}', good % "", good % ',"format":{"duration":"x"}', "no",
        '{"streams":[{"codec_type":"audio"}]}', '{"streams":[]}',
        '{"streams":[{"index":0},{"codec_type":"audio","sample_rate":"8000","channels":1}]}'])
    fallback = (44100, 1, "mono", 0.0)
    assert [tuple(v) for v in values] == [
        (8000, 2, "stereo", 1.5), (8000, 2, "stereo", 0.0), *[fallback] * 5]


def test_parse_progress_time(apply):
    assert apply(clean.parse_progress_time, [
        "x time=01:02:03.45 time=9:9:9", "time=N/A", "time=0:0:1.2.3"]) == [3723450, None, None]


def test_split_dialogue(apply):
    def flat(line):
        return F.transform(segment.split_dialogue(line), lambda p: F.concat(p["type"], F.lit("|"), p["text"]))
    pairs(apply, flat, {
        'He said, "Hi," and left.': ["narration|He said, ", 'dialogue|"Hi,"', "narration| and left."],
        '"': ['dialogue|"'], 'a "" b': ['narration|a "" b'], "": [],
        '"a""b"': ['dialogue|"a"', 'dialogue|"b"']})


def test_split_dialogue_keeps_every_character(apply):
    import random
    rng = random.Random(2)
    lines = ["".join(rng.choice('ab" ') for _ in range(rng.randint(0, 14))) for _ in range(300)]
    joined = apply(lambda c: F.array_join(F.transform(
        segment.split_dialogue(c), lambda p: p["text"]), ""), lines)
    assert joined == lines


def test_line_items(apply):
    def flat(line):
        return F.transform(segment.line_items(line), lambda p: F.concat(p["type"], F.lit("|"), p["content"]))
    pairs(apply, flat, {
        ' x "a"  "b" ': ["narrator|x", 'dialogue|"a"', 'dialogue|"b"'], " x ": ["narrator| x "],
        "": ["narrator|"]})


def test_is_chapter_heading(apply):
    pairs(apply, segment.is_chapter_heading, {
        "Chapter 1: X": True, "PART Twenty-One": True, "Part of the way": False, "Chapter IV": False,
        "Chapter1": False, " Chapter 1": False, "part one-off": True, "chapter thousand-thousand": False,
        "chapter one-thousand-million": False, "": False})


def test_emotion_keywords(apply):
    pairs(apply, segment.has_emotion_keyword, {
        "sighing": True, "He Chuckles.": True, "laughed": True, "chuckled": False, "sniffled": False,
        "laughter": False, "élaugh": False, "gasp_": False, "a-yawn!": True})


def test_resolve_colons(apply):
    pairs(apply, speech.resolve_colons, {
        "at 3:30 PM": "at 3.30 PM", "won 5:3": "won 5 to 3", "Note: x": "Note - x",
        "3:30, ok": "3.30 , ok", "100:200:3": "100 to 200 -3", "a  b": "a b", "é3:30": "é3 -30"})


def test_small_speech_rules(apply):
    pairs(apply, speech.needs_no_stop, {
        "ab": True, "see Mr.": True, "See PROF.": True, "vol.": True, "xMr.": False, "volt.": False})
    pairs(apply, speech.move_punctuation_inside, {'"a". dogs\'.': '"a." dogs.\''})
    pairs(apply, speech.ends_with_punctuated_dialogue, {
        'x "a!"': True, "'a.' \"": False, '"a".': True, '"Hi," Sam said to me.': True, '"a"': False})


@pytest.mark.parametrize("index, cases", [
    (0, {"A title": "A title.", " ok, ": "ok,.", "": "", "ab": "ab", '"Hi"': '"Hi."',
         "He is here!": "He is here!", "Dr.": "Dr.", "see 3:30": "see 3.30."}),
    (5, {"one two three four five six seven,": "one two three four five six seven,",
         "Gordon,": "Gordon,", "Hello,": "Hello,.", "Chapter 2": "Chapter 2.", "ends here": "ends here."}),
])
def test_prepare_for_tts(spark, index, cases):
    df = spark.createDataFrame([(i, t, index) for i, t in enumerate(cases)], "i int, t string, at int")
    rows = speech.prepare_for_tts(df, "t", "out", None if index == 0 else "at").orderBy("i").collect()
    assert [r["out"] for r in rows] == list(cases.values())


def test_token_count(apply):
    pairs(apply, tokens.token_count, {"Hi, you!": 4, "": 0, " ": 0, "é_1 …": 2})


def paragraphs_by_loop(text):
    out, sizes, run = [], [], []
    for line in [*text.split("\n"), None]:
        if line is not None and line.strip():
            run.append(line)
            continue
        if run:
            out.append(" ||| ".join(run))
            sizes.append(len(run))
            run = []
        if line is not None:
            out.append("")
            sizes.append(0)
    return "\n".join(out), sizes


def test_paragraphs_round_trip(apply):
    import random
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", " b ", "", "c\td", "e"]) for _ in range(rng.randint(1, 8)))
             for _ in range(200)]
    joined = apply(paragraphs.join_paragraphs, texts)
    sizes = apply(paragraphs.paragraph_sizes, texts)
    assert list(zip(joined, sizes)) == [paragraphs_by_loop(t) for t in texts]
    back = apply(paragraphs.split_paragraphs, list(zip(joined, sizes)), "x string, y array<int>")
    assert back == texts


def test_split_paragraphs_keeps_what_does_not_fit(apply):
    assert apply(paragraphs.split_paragraphs, [("a ||| b\n\nc\nx ||| y", [3, 0, 1])],
                 "x string, y array<int>") == ["a ||| b\n\nc\nx ||| y"]


def test_page_text(apply):
    pairs(apply, page_text, {
        "<p>a&nbsp;&amp;lt;<!-- x --><script>if(1<2)</script>b</p><STYLE>p{}</STYLE>": "a &lt; b"})


def test_top_snippets(spark):
    df = spark.createDataFrame([
        (1, "<p>a</p><p></p><P class=x>b <i>c</i></P><pre>no</pre>" + "<p>d</p>" * 9),
        (2, "<div>" + "x" * 1201 + "</div>"), (3, "<br>")], "i int, html string")
    rows = {r[0]: r[1] for r in paragraphs.with_top_snippets(df, "html", "s").select("i", "s").collect()}
    assert rows == {1: ["a", "b c", "d", "d", "d"], 2: ["x" * 500, "x" * 500, "x" * 201], 3: []}


def test_gender_scores(spark):
    df = spark.createDataFrame([("b", f"n{i}", "adult", "female") for i in range(50)],
                               "book_id string, name string, age string, gender string")
    assert {r[0] for r in df.select(gender_score("age", "gender")).collect()} == {7, 8, 9}
    one = spark.createDataFrame([("child", "male"), ("elderly", "female"), ("adult", "unknown")],
                                "age string, gender string")
    assert [r[0] for r in one.select(gender_score("age", "gender", "min")).collect()] == [4, 6, 5]


def test_output_settings(apply, spark):
    assert apply(narration.book_title, [("", "/x/my.book.epub"), ("T: 1", "p"), (None, ".hidden"), ("", "a/b")],
                 "x string, y string") == ["my book", "T 1", "hidden", "b"]
    assert apply(narration.output_name, [("T", "MP3")], "x string, y string") == ["T.mp3"]
    profiles = apply(narration.encode_profile, [(10000, "opus"), (36001, "opus"), (44100, "mp3"),
                                                (8000, "mp3"), (8000, "m4a"), (8000, "wav")], "x int, y string")
    assert [tuple(p) for p in profiles] == [
        (8000, "64k"), (48000, "160k"), (44100, "192k"), (8000, "160k"), (8000, "256k"), (8000, None)]
    tags = apply(lambda x: narration.metadata_tags(clean.parse_key_values(x)),
                 ["Title: A \"b\"\nPublisher: \nAuthor(s): C"])
    assert tags == [{"title": 'A \\"b\\"', "album": 'A \\"b\\"', "artist": "C", "genre": "Audiobook"}]
