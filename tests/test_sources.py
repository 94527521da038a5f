import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.operators import lines
from scanloom.sinks import reports as rep
from scanloom.sources import archives, records, trees


@pytest.fixture()
def tree(tmp_path):
    repo = tmp_path / "repo"
    files = {
        "file.txt": b"Hello World", "binary.bin": b"\x00\x01\x02", "large.txt": b"a" * (2 * 1024 * 1024 + 1), "limit.txt": b"a" * (2 * 1024 * 1024),
        "coverage/ignore.txt": b"x", ".env": b"K=1", ".github/workflows/ci.yml": b"on:", "pkg/__init__.py": b"", "a/dist": b"dropped",
        "bad.txt": b"a\xffb", "real.txt": "a\ufffd\ue000b1".encode() + b"\xff", "crlf.txt": b"one\r\ntwo\rthree\n", "late.bin": b"a" * 1024 + b"\x00", "pkg/Mod.PY": b"x = 1",
    }
    for name, data in files.items():
        path = repo / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return repo


def test_tree_load(spark, tree):
    files = trees.load_trees(trees.repositories_of(spark, {"r": str(tree) + "/"}))
    rows = {r.relative_path: r for r in files.collect()}
    assert sorted(rows) == [".env", ".github/workflows/ci.yml", "bad.txt", "crlf.txt", "file.txt", "late.bin", "limit.txt", "pkg/Mod.PY", "pkg/__init__.py", "real.txt"]
    assert rows["real.txt"].content == "a\ufffd\ue000b1"
    assert rows["bad.txt"].content == "ab" and rows["bad.txt"].valid_utf8 is False
    assert rows["crlf.txt"].content == "one\ntwo\nthree\n"
    assert rows["pkg/Mod.PY"].extension == ".py" and rows[".env"].extension == ""
    assert [r.file_seq for _, r in sorted(rows.items())] == list(range(1, 11))
    got = lines.explode_lines(files.where("relative_path = 'crlf.txt'"), ["relative_path"]).orderBy("line_number").collect()
    assert [(r.line_number, r.line) for r in got] == [(1, "one"), (2, "two"), (3, "three")]
    assert lines.explode_lines(files.where("size = 0"), ["relative_path"]).count() == 0


def test_missing_path_is_empty(spark, tmp_path):
    assert trees.load_trees(trees.repositories_of(spark, {"r": str(tmp_path / "none")})).count() == 0


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return str(path)


def test_archives(spark, tmp_path):
    paths = {
        "evil": _zip(tmp_path / "e.zip", {"ok.txt": "1", "../x": "2"}),
        "single": _zip(tmp_path / "s.zip", {"root/": "", "root/a.py": "x", "root/b/c.txt": "y"}),
        "double": _zip(tmp_path / "d.zip", {"p/a.py": "x", "q.txt": "y"}),
        "broken": str(tmp_path / "b.zip"),
    }
    (tmp_path / "b.zip").write_bytes(b"PK no archive")
    table = archives.archives_of(spark, paths)
    assert [(r.repository_name, r.member) for r in archives.unreadable_archives(table).collect()] == [("broken", None)]
    assert [r[0] for r in archives.refused_archives(archives.list_archives(table)).collect()] == ["evil"]
    got = sorted((r.repository_name, r.relative_path, r.content) for r in archives.load_archives(table).collect())
    assert got == [("double", "p/a.py", "x"), ("double", "q.txt", "y"), ("single", "a.py", "x"), ("single", "b/c.txt", "y")]


def test_records_tolerate_missing_and_broken(spark, tmp_path):
    assert records.read_history(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text('{"scan_id":"s1","score":5}\n{broken\n')
    assert [r.scan_id for r in records.read_history(spark, str(tmp_path / "h")).collect()] == ["s1"]
    assert [r.broken for r in records.broken_rows(spark, str(tmp_path / "h"), schemas.HISTORY).collect()] == ["{broken"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"scan_id":"a","status":"CLONING"}\n{"scan_id":"b","status":"COMPLETED","finished_at":3}\n')
    got = {r.scan_id: (r.status, r.finished_at) for r in records.read_states(spark, str(tmp_path / "s"), F.lit(9.0)).collect()}
    assert got == {"a": ("FAILED", 9.0), "b": ("COMPLETED", 3.0)}


def test_export_documents(spark, tmp_path):
    import json
    import pathlib

    rows = [("s1", i, f"id{i}", "T", "d", "HIGH", "LOW", "f.py", i or None, "x", "e\"q", "fix", "xss", None) for i in range(5)]
    found = spark.createDataFrame(rows, "scan_id string, finding_seq int, finding_id string, title string, description string, severity string, "
                                  "confidence string, file_path string, line_number int, code_snippet string, explanation string, "
                                  "fix_suggestion string, category string, patch string")
    heads = spark.createDataFrame([("s1", "r", 90, "ok"), ("s2", "r2", 100, "none")], "scan_id string, repository_name string, overall_score int, risk_summary string")
    rep.export(heads, found, "sarif", str(tmp_path / "sarif"))
    for scan, n in (("s1", 5), ("s2", 0)):
        parts = sorted(pathlib.Path(tmp_path / "sarif" / f"scan_id={scan}").glob("part-*"))
        doc = json.loads("".join(p.read_text() for p in parts))
        assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == n
    before = {p.name: p.read_text() for p in pathlib.Path(tmp_path / "sarif" / "scan_id=s1").glob("part-*")}
    rep.export(heads.where("scan_id = 's2'"), found.where("scan_id = 's2'"), "sarif", str(tmp_path / "sarif"))
    assert {p.name: p.read_text() for p in pathlib.Path(tmp_path / "sarif" / "scan_id=s1").glob("part-*")} == before
    for name in ("markdown", "md", "html", "fix_prompt_json", "fix_prompt_md", "fix_prompt_txt"):
        rep.export(heads, found, name, str(tmp_path / name))
        assert spark.read.text(str(tmp_path / name)).count() > 0
    rep.export(heads, found, "patch_diff", str(tmp_path / "patch"))
    with pytest.raises(ValueError):
        rep.export(heads, found, "docx", str(tmp_path / "x"))


def test_skipped_paths_have_reasons(spark, tree, monkeypatch):
    repositories = trees.repositories_of(spark, {"r": str(tree), "none": str(tree) + "-none"})
    scan = trees.read_trees(repositories)
    got = sorted((r.repository_name, r.relative_path, r.reason) for r in scan.skipped.collect())
    assert got == [("none", "", "not found"), ("r", "binary.bin", "binary"), ("r", "large.txt", "larger than the limit")]
    assert scan.counts == {"read": 10, "skipped": 1}
    plan = scan.files._jdf.queryExecution().executedPlan().toString()
    assert " Exchange " not in plan and "Sort" not in plan  # contents go nowhere
    real = trees._filesystem

    class Failing:
        def __init__(self, system, error):
            self.system, self.error = system, error

        def __getattr__(self, name):
            return getattr(self.system, name)

        def open_input_stream(self, path):
            if path.endswith("file.txt"):
                raise self.error
            return self.system.open_input_stream(path)

    def with_error(error):
        def filesystem(location):
            system, path = real(location)
            return Failing(system, error), path
        monkeypatch.setattr(trees, "_filesystem", filesystem)
        return trees.read_trees(trees.repositories_of(spark, {"r": str(tree)}))

    denied = with_error(PermissionError(13, "denied"))
    assert ("file.txt", "no permission") in {(r.relative_path, r.reason) for r in denied.skipped.collect()}
    assert sorted(r.file_seq for r in denied.files.collect()) == list(range(1, 10))
    with pytest.raises(Exception, match="broken disk"):  # a failing disk must not look like a missing file
        with_error(OSError(5, "broken disk"))


def test_numbers_go_on_over_parts(spark, tmp_path):
    for repo, n in (("a", 1), ("b", 90), ("c", 3), ("e", 40)):
        for i in range(n):
            (tmp_path / repo).mkdir(exist_ok=True)
            (tmp_path / repo / f"f{i:03}.txt").write_bytes(b"\x00" if i % 7 == 3 else b"x" * i)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        files = trees.load_trees(trees.repositories_of(spark, {r: str(tmp_path / r) for r in "abce"})).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for repo, n in (("a", 1), ("b", 90), ("c", 3), ("e", 40)):
        kept = sorted((r.relative_path, r.file_seq) for r in files if r.repository_name == repo)
        assert kept == [(f"f{i:03}.txt", k) for k, i in enumerate((i for i in range(n) if i % 7 != 3), 1)]


def test_damaged_members(spark, tmp_path):
    """Every kind of damage is a row with a reason; the other members of the archive are read."""
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, how in (("stored.txt", zipfile.ZIP_STORED), ("deflated.txt", zipfile.ZIP_DEFLATED), ("bzip2.txt", zipfile.ZIP_BZIP2), ("lzma.txt", zipfile.ZIP_LZMA),
                          ("checksum.txt", zipfile.ZIP_STORED), ("damaged.txt", zipfile.ZIP_DEFLATED), ("bomb.txt", zipfile.ZIP_DEFLATED), ("nul.bin", zipfile.ZIP_STORED)):
            z.writestr(name, b"\x00" if name == "nul.bin" else name.encode() * 100, how)
        info = {m.filename: m for m in z.infolist()}
        info["checksum.txt"].CRC ^= 1
        info["bomb.txt"].file_size = 5
    data = bytearray(path.read_bytes())
    at = info["damaged.txt"].header_offset + 30 + len("damaged.txt")
    data[at:at + 8] = b"\xff" * 8
    path.write_bytes(bytes(data))
    scan = archives.read_archives(archives.archives_of(spark, {"x": str(path), "gone": str(tmp_path / "gone.zip")}))
    assert {r.relative_path: r.content for r in scan.files.collect()} == {n: n * 100 for n in ("stored.txt", "deflated.txt", "bzip2.txt")}
    assert {(r.repository_name, r.relative_path): r.reason for r in scan.skipped.collect()} == {
        ("x", "lzma.txt"): "unknown packing 14", ("x", "checksum.txt"): "wrong checksum", ("x", "damaged.txt"): "damaged data", ("x", "bomb.txt"): "wrong checksum",
        ("x", "nul.bin"): "binary", ("gone", None): "not found"}
    assert scan.counts == {"read": 3, "skipped": 5}


def test_a_large_archive_is_read_by_many_tasks(spark, tmp_path):
    path = _zip(tmp_path / "l.zip", {f"m{i:04}.txt": str(i) * 50 for i in range(400)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        files = archives.load_archives(archives.archives_of(spark, {"l": path}))
        assert {r.content for r in files.collect()} == {str(i) * 50 for i in range(400)}
        assert files.select(F.input_file_name().alias("f")).distinct().count() >= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exports_are_stored_compressed(spark, tmp_path):
    """JSON findings always, CSV and documents if asked for; what is read back is the same, and parts in name order are one gzip document."""
    rows = [("s1", i, f"id{i}", "t", "d" * 500, "HIGH", "HIGH", "f", i, "c") for i in range(2000)]
    found = spark.createDataFrame(rows, "scan_id string, finding_seq int, finding_id string, title string, description string, severity string, "
                                  "confidence string, file_path string, line_number int, category string")
    heads = found.select("scan_id").distinct()
    rep.export(heads, found, "json", str(tmp_path / "json"))
    files = list((tmp_path / "json" / "findings").rglob("part-*"))
    assert files and sum(f.stat().st_size for f in files) < 100_000
    assert records.read_report_findings(spark, str(tmp_path / "json" / "findings")).count() == 2000
    rep.export(heads, found, "sarif", str(tmp_path / "plain"))
    rep.export(heads, found, "sarif", str(tmp_path / "packed"), "gzip")
    stored = {k: b"".join(p.read_bytes() for p in sorted((tmp_path / k / "scan_id=s1").glob("part-*"))) for k in ("plain", "packed")}
    assert gzip.decompress(stored["packed"]) == stored["plain"] and len(json.loads(stored["plain"])["runs"][0]["results"]) == 2000
