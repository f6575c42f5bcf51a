import random

import numpy as np

from scriptmill.llm import substrings as S


def plain_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(S.GEAR[b])) & 0xFFFF
        out.append(h)
    return out


def text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_gear_equals_the_plain_recursion():
    data = text(1, 200).encode()
    assert S.gear(np.frombuffer(data, np.uint8)).tolist() == plain_gear(data)


def test_cuts_cover_and_resist_shifts():
    for value in (text(2, 400), "a" * 5000, "é" * 3000, "x"):
        data = value.encode()
        ends = S.cuts(np.frombuffer(data, np.uint8)).tolist()
        pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(pieces) == data and all(p.decode() for p in pieces) and max(map(len, pieces)) <= S.MOST + 3
    a = text(3, 400)
    def chunks(t):
        data = t.encode()
        ends = S.cuts(np.frombuffer(data, np.uint8)).tolist()
        return {data[x:y] for x, y in zip([0, *ends], ends)}
    assert len(chunks(a) - chunks("inserted " + a[:700] + " more " + a[700:])) <= 4


def brute(rows, words):
    """Runs of chunks that other documents have, from sets of chunks."""
    own = {}
    for i, t in rows:
        data = (t or "").encode()
        ends = S.cuts(np.frombuffer(data, np.uint8)).tolist()
        own[i] = [(a, data[a:b]) for a, b in zip([0, *ends], ends)]
    docs = {}
    for i, cs in own.items():
        for _, c in cs:
            docs.setdefault(c, set()).add(i)
    out = []
    for i, cs in own.items():
        run = []
        for a, c in [*cs, (None, None)]:
            if c is not None and len(docs[c]) > 1:
                run.append((a, c))
                continue
            n = sum(sum(x in b" \t\n\r\x0b\x0c" for x in y) for _, y in run)
            if n >= words:
                out.append((i, run[0][0], sum(len(y) for _, y in run), n, min(min(docs[y]) for _, y in run)))
            run = []
    return sorted(out)


def test_equals_brute_force_and_finds_passages(docs, pairs):
    passage = text(9, 60)
    rows = [(i, f"{text(100 + i, 80)} {passage if i % 3 == 0 else ''} {text(200 + i, 40)}") for i in range(12)]
    rows += [(20, rows[1][1]), (21, ""), (22, None), (23, "z" * 40_000), (24, "z" * 40_000)]
    got = pairs(S.repeated_spans(docs(*rows)), "doc_id", "start", "size", "n_words", "first_doc")
    assert sorted(got) == brute(rows, S.WORDS) and {r[0] for r in got} == {0, 3, 6, 9, 1, 20}


def test_cut_texts_and_edge_rows(docs):
    passage = text(9, 80)
    df = docs((None, passage), (None, None), (1, None), (2, f"{text(1, 30)} {passage} {text(2, 30)}"),
              (3, f"{text(3, 30)} {passage} {text(4, 30)}"), (4, passage), (4, passage))
    out = S.drop_repeated_substrings(df)
    assert out.columns == df.columns and out.count() == 7
    left = sorted(((r.doc_id, r.text) for r in out.collect() if r.doc_id and r.text is not None), key=str)
    assert left[0][1].endswith(text(2, 30)) and passage in left[0][1]
    assert len(left[1][1]) < len(df.where("doc_id = 3").first().text) - len(passage) / 2 and left[1][1].startswith(text(3, 30)[:80])
    assert S.repeated_spans(df.where("false")).count() == 0


def test_other_spaces_and_scripts_short_copies_and_repetition(docs):
    r = random.Random(5)
    han, thai = ("".join(chr(r.randint(a, b)) for _ in range(200)) for a, b in ((0x4E00, 0x9FFF), (0x0E01, 0x0E2E)))
    wide, nbsp = text(31, 60).replace(" ", "\u3000"), text(32, 60).replace(" ", "\u00a0")
    passages = [han, thai, wide, nbsp, "foo " * 60, "repeated " * 60, "\u6f22\u5b57 " * 60, "one two three " * 20]
    rows = [(10 * k + d, f"{text(300 + 10 * k + d, 30 + 7 * d)} {p} {text(400 + 10 * k + d, 30)}")
            for k, p in enumerate(passages) for d in (0, 1)]
    rows += [(900, "a short copy"), (901, "a short copy"), (902, "another text"), (903, "word"), (904, "word")]
    got = {r.doc_id for r in S.repeated_spans(docs(*rows)).collect()}
    assert got == {10 * k + d for k in range(len(passages)) for d in (0, 1)} | {900, 901}


def test_first_copies_stay_where_passages_touch(docs):
    def ends(t):
        return S.cuts(np.frombuffer(t.encode(), np.uint8)).tolist()

    def until_cut(t):
        return t.encode()[:ends(t)[-2]].decode()

    p = until_cut(text(41, 80))
    q = next(q for q in (until_cut(text(k, 80)) for k in range(42, 400)) if set(ends(p + q)) == {*ends(p), *(len(p.encode()) + e for e in ends(q))})
    df = docs((1, p), (2, p + q), (3, q))
    out = {r.doc_id: r.text for r in S.drop_repeated_substrings(df).collect()}
    assert out == {1: p, 2: q, 3: ""}
    spans = S.repeated_spans(df).where("doc_id = 2").collect()
    assert [(r.start, r.size, r.n_removed) for r in spans] == [(0, len((p + q).encode()), len(p.encode()))]
