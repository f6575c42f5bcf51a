import hashlib
import random

from scriptmill.llm import line_dedup as D


def chunk_lines(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % D.MODULUS for x in lines]
    r = [((h[i - 1] if i else 0) * D.BASE + h[i]) % D.MODULUS for i in range(len(h))]
    n, out, begin = len(h), [], 0
    for i in range(n):
        if i == n - 1 or (1 <= i < n - 2 and r[i] < r[i - 1] and r[i] < r[i + 1]):
            out.append("\n".join(lines[begin:i + 1]))
            begin = i + 1
    return out


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda x: x[0]):
        keep = []
        for c in chunk_lines(text.split("\n")):
            if "\n" in c and c in seen:
                continue
            seen.add(c)
            keep.append(c)
        out.append((i, "\n".join(keep)))
    return out


def texts(seed, n=40):
    r = random.Random(seed)
    shared = [f"shared line {k}" for k in range(9)]
    rows = []
    for i in range(n):
        lines = [f"own {i} {k}" for k in range(r.randint(0, 6))]
        at = r.randint(0, len(lines))
        rows.append((i, "\n".join(lines[:at] + shared * r.randint(0, 2) + lines[at:])))
    return [*rows, (n, rows[3][1]), (n + 1, ""), (n + 2, "\n\n\n\n\n\n"), (n + 3, "x\n" * 3000)]


def test_equals_brute_force(docs, pairs):
    for seed in (1, 2):
        rows = texts(seed)
        assert pairs(D.drop_repeated_lines(docs(*rows)), "doc_id", "text") == sorted(brute(rows), key=repr)


def test_boundaries_resist_shifts(docs, spark):
    lines = [f"line {k}" for k in range(60)]
    a, b = chunk_lines(lines), chunk_lines([*lines[:20], "inserted", *lines[20:]])
    assert len(set(a) - set(b)) <= 2
    out = {r.doc_id: r.text for r in D.drop_repeated_lines(docs(
        (1, "\n".join(lines)), (2, "\n".join(["new", *lines])))).collect()}
    assert out[1] == "\n".join(lines) and len(out[2].split("\n")) < 12


def test_nulls_repeats_and_columns(docs, spark):
    same = "\n".join(f"l{k}" for k in range(12))
    df = docs((None, same), (None, None), (5, None), (5, same), (5, same), (7, same), (9, "one line"), (10, "one line"))
    out = D.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect() if r.text is not None)
    assert got == [("10", "one line"), ("5", same), ("5", same), ("7", ""), ("9", "one line"), ("None", same)]
    assert out.count() == 8 and D.drop_repeated_lines(df.where("false")).count() == 0
