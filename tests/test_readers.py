"""Files of any size are read by many tasks, with the lines of a whole-text reader."""

import random

import pytest

from scriptmill.sources import books


@pytest.fixture
def splits_of(spark, monkeypatch):
    """Sets how many bytes of a text file a task reads; what is staged is read as ever."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old, stage = {n: spark.conf.get(n) for n in names}, books.stage

    def restore():
        for n, v in old.items():
            spark.conf.set(n, v)

    def staged(df, label):
        df = df.coalesce(3)
        made = stage(df, label)
        restore()
        return made

    def cut(size):
        for n in names:
            spark.conf.set(n, str(size))
    monkeypatch.setattr(books, "stage", staged)
    yield cut
    restore()


def lines_by_text(spark, path):
    return sorted(tuple(r) for r in books.book_lines(books.read_books(spark, path)).collect())


def lines_by_split(spark, path):
    return sorted((r.book_id, r.line_no, r.line) for r in books.read_lines(spark, path).collect())


TEXTS = {
    "plain": "one\ntwo\n\nthree", "ended": "one\ntwo\n", "crlf": "one\r\ntwo\r\n\r\nthree\r\n", "cr": "a\rb\r\rc", "cr-end": "a\nb\r",
    "mixed": "a\r\nb\rc\n\rd\r\r\n\ne", "one": "x", "break": "\n", "two-breaks": "\r\n\n", "wide": "é😀 ü\nñ\r\n中文\r…\n",
}


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_split_edges(spark, tmp_path, splits_of, size):
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    want = lines_by_text(spark, f"{tmp_path}/*.txt")
    splits_of(size)
    assert lines_by_split(spark, f"{tmp_path}/*.txt") == want
    assert len({b for b, *_ in want}) == len(TEXTS)


@pytest.mark.parametrize("breaks", [["\n"], ["\r\n"], ["\n", "\r\n", "\r"]])
def test_one_file_of_many_splits(spark, tmp_path, splits_of, breaks):
    r = random.Random(len(breaks))
    text = "".join("w" * r.randrange(30) + r.choice(breaks) for _ in range(3000))
    (tmp_path / "book one.txt").write_bytes(text.encode())
    want = lines_by_text(spark, str(tmp_path))
    splits_of(len(text) // 3 + 1)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() == 3
    assert lines_by_split(spark, str(tmp_path)) == want
    splits_of(1999)
    assert lines_by_split(spark, str(tmp_path)) == want


def test_marks_of_utf8_are_no_text(spark, tmp_path):
    for name, text in {"a": "x\ny\n", "b": "x\ny"}.items():
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + text.encode())
    assert [line for _, _, line in lines_by_split(spark, str(tmp_path))] == ["x", "y", "", "x", "y"]


def test_no_file_is_read_as_one_row(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    assert "wholetext" not in books.read_lines(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_scripts_of_many_splits(spark, tmp_path, splits_of):
    rows = [f'{{"speaker": "s{i}", "line": "l{i} \\u00e9"}}' for i in range(200)]
    (tmp_path / "s.jsonl").write_text("\r\n\n".join(rows) + "\n  \n")
    splits_of(301)
    got = sorted(map(tuple, books.read_script(spark, str(tmp_path)).drop("book_id").collect()))
    assert got == [(i, f"s{i}", f"l{i} é") for i in range(200)]
