import pytest

from sparkloom.sources import discovery, embedders


def test_discover(spark, tmp_path):
    files = {
        ".gitignore": "*.log\nsecret.txt\n/top/\n", "main.go": "package main\n", "app.log": "x", "secret.txt": "x", "readme.txt": "hi", "a/.gitignore": "x.py\n", "a/x.py": "1", "b/x.py": "1", "top/y.go": "1",
        "b/top/y.go": "1", "node_modules/m.js": "1", ".hidden/h.py": "1", "empty.py": "", "big.py": "x" * 600_000, "pic.png": "1", "bin.dat": "\x00\x01", "keep.json": "{}",
    }
    for p, c in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    got = {r.rel_path: r for r in discovery.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {"main.go", "readme.txt", "b/x.py", "b/top/y.go", "keep.json"}
    assert got["main.go"].language == "go" and got["main.go"].size == 13


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.log", "a/b.log", True), ("/x", "a/x", False), ("/x", "x/y", True), ("d/", "d", False), ("d/", "a/d/e", True), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("**/q", "q", True), ("f?o", "foo", True), ("[ab]c", "bc", True), ("# c", "c", False), ("\\#c", "#c", True)],
)
def test_patterns(pattern, path, hit):
    assert discovery.ignored(path, (pattern,)) is hit


def test_negation_and_sniffing():
    assert not discovery.ignored("keep.log", ("*.log", "!keep.log"))
    assert discovery.is_text(b"# hi\n") and discovery.is_text(b"{}") and discovery.is_text(b"") and not discovery.is_text(b"\x89PNG\r\n\x1a\n") and not discovery.is_text(b"\x7fELF\x02") and not discovery.is_text(b"PK\x03\x04") and not discovery.is_text(b"a\x00b")


def test_embedder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.v for r in embedders.embed_column(df, "t", "v", lambda: embedders.byte_embedder(3)).collect()}
    assert got[2] is None and [round(x * 255) for x in got[1]] == [97, 98, 0] and got[3] == [0.0, 0.0, 0.0]
