"""The whole scan of small trees, from files to stored reports."""

import hashlib
import json

from pyspark.sql import functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators import dependencies, findings as fnd, inventory, lines, review, rules
from scanloom.plans import audit as plan
from scanloom.session import cut_lineage
from scanloom.sinks import reports as rep
from scanloom.sources import records, trees
from scanloom.workloads import adapters
from scanloom.workloads.catalog import QUERIES

CODE = "import os\n\n\ndef login(password):\n" + "    # check the user and open a session for the whole site\n" * 8 + "    return os.system(password)\n"


def _score(system, prompt):
    assert system == review.SYSTEM_PROMPT
    if "tired.py" in prompt:
        raise review.RateLimited()
    if "broken.py" in prompt:
        raise ValueError("no answer")
    return json.dumps({"findings": [{"title": "Command injection", "severity": "HIGH", "line_number": 2, "category": "injection", "description": "d"}]})


def test_trees_to_reports(spark, tmp_path, monkeypatch):
    trees_of = {"good": {"app/main.py": CODE, "requirements.txt": "flask==0.1\n", "Dockerfile": "FROM python:latest\n", ".github/workflows/ci.yml": "on: push\n"},
                "limited": {"tired.py": CODE}, "failing": {"broken.py": CODE}, "plain": {"notes.txt": "nothing to see"}}
    for name, files in trees_of.items():
        for path, data in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_text(data)
    repositories = trees.repositories_of(spark, {n: str(tmp_path / n) for n in trees_of})
    files = cut_lineage(trees.load_trees(repositories))
    real = review.call_scorer
    monkeypatch.setattr(review, "call_scorer", lambda *a, **k: real(*a, wait=0.0, **k))
    run = plan.audit(files, scorer=_score, system=review.SYSTEM_PROMPT, pack_limit=2)
    scans = spark.createDataFrame([(n, n, None, None, 1.5) for n in trees_of], "scan_id string, repository_name string, repository_url string, timestamp timestamp, scan_duration_sec double")
    heads = plan.reports(run, scans)

    path = str(tmp_path / "out")
    for _ in range(2):  # a second export changes nothing
        rep.export(heads, run.findings, "json", path)
    read = {r.scan_id: r for r in records.read_reports(spark, f"{path}/reports").collect()}
    found = records.read_report_findings(spark, f"{path}/findings").groupBy("scan_id").agg(F.collect_list("title").alias("titles"))
    titles = {r.scan_id: r.titles for r in found.collect()}

    assert set(read) == set(trees_of)
    assert "Command injection" in titles["good"] and len(titles["good"]) == run.findings.where("scan_id = 'good'").count()
    assert read["good"].score.overall_score < 100 and read["plain"].score.overall_score == 100 and "plain" not in titles
    assert read["good"].total_files == 4 and [l.language for l in read["good"].languages] == sorted(l.language for l in read["good"].languages)
    assert read["good"].dependencies == ["flask==0.1"] and read["good"].frameworks == ["Flask"] and "GitHub Action: ci.yml" in read["good"].configs
    assert "Note:" in read["limited"].score.risk_summary and "Note:" not in read["failing"].score.risk_summary
    assert [(r.repository_name, r.error) for r in run.failed.collect()] == [("failing", "ValueError: no answer")]
    assert "Command injection" not in titles.get("limited", []) + titles.get("failing", [])


def test_whole_audit_query_agrees_with_its_parts(spark):
    """Heads of the registered whole scan against the tables that its parts give, each counted by itself in plain Python."""
    folder = "/root/testdata/sf0.001"
    heads = {r.scan_id: r for r in QUERIES["d3_whole_audit"](spark, folder).collect()}
    code, manifests = adapters.code_files(spark, folder), adapters.manifest_files(spark, folder)
    files = code.unionByName(manifests)
    sizes, deps, levels = {}, {}, {}
    for r in files.select("repository_name", "size").collect():
        sizes.setdefault(r.repository_name, []).append(r.size)
    for r in inventory.dependencies(inventory.manifest_entries(files)).collect():
        deps.setdefault(r.repository_name, set()).add(r.dependency)
    found = fnd.union_findings(rules.scan_files(files).select("*"), dependencies.dependency_findings(inventory.dependencies(inventory.manifest_entries(files)), files))
    for r in found.select("scan_id", "severity").collect():
        levels.setdefault(r.scan_id, []).append(r.severity)
    assert set(heads) == set(sizes)
    for name, head in heads.items():
        counts = {s: getattr(head, f"n_{s.lower()}") for s in fv.DEDUCTIONS}
        lost = sum(fv.DEDUCTIONS[s] * n for s, n in counts.items())
        assert head.overall_score == max(0, 100 - lost) and head.status == "completed"
        assert sum(counts.values()) <= head.findings
        assert (head.total_files, head.total_size) == (len(sizes[name]), sum(sizes[name]))
        assert head.dependencies == hashlib.md5("\n".join(sorted(deps.get(name, ()))).encode()).hexdigest()
        assert bool(head.findings) or not levels.get(name)


def test_heads_read_no_manifest_again(spark, monkeypatch):
    """Manifests are read once for findings, frameworks and heads; before, each of them read all again."""
    files = cut_lineage(adapters.manifest_files(spark, "/root/testdata/sf0.001"))
    real, calls = inventory.manifest_entries, []
    monkeypatch.setattr(inventory, "manifest_entries", lambda f: calls.append(1) or real(f))
    run = plan.audit(files)
    scans = files.select(F.col("repository_name").alias("scan_id"), "repository_name", F.lit(None).cast("string").alias("repository_url"),
                         F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0.0).alias("scan_duration_sec")).distinct()
    heads = plan.reports(run, scans)
    assert len(calls) == 1
    for table in (heads, run.dependencies, run.frameworks):  # their plans hold no reader of manifests
        assert "map_entries" not in table._jdf.queryExecution().optimizedPlan().toString()
    wanted = {}
    for r in real(files).collect():
        wanted.setdefault(r.repository_name, (set(), set()))
        wanted[r.repository_name][0].add(r.dependency)
        wanted[r.repository_name][1].update([r.framework] if r.framework else [])
    got = {r.repository_name: (set(r.dependencies), set(r.frameworks)) for r in heads.collect() if r.dependencies}
    assert got == {k: v for k, v in wanted.items() if v[0]}


def test_lines_split_once_and_screened_without_lambdas(spark):
    """A text is split once, and the screen of its lines is compiled with the split; the lines and hits stay the same."""
    files = spark.createDataFrame([("r", 1, "a.py", "a.py", "x\r\nDEBUG = True\n\npassword = 'hunter2hunter2'\n"), ("r", 2, "b.py", "b.py", ""), ("r", 3, "c.py", "c.py", None),
                                   ("r", 4, "d.py", "d.py", "DEBUG = True")], "repository_name string, file_seq long, name string, relative_path string, content string")
    lined = lines.explode_lines(files, ["file_seq"])
    assert sorted((r.file_seq, r.line_number, r.line) for r in lined.collect()) == [
        (1, 1, "x"), (1, 2, "DEBUG = True"), (1, 3, ""), (1, 4, "password = 'hunter2hunter2'"), (4, 1, "DEBUG = True")]
    assert lined._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    hits = rules.match_lines(lined.withColumn("rule_set", F.lit(rules.APP)), [rules.APP, rules.SECRET])
    assert "lambda" not in [l for l in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in l and "_lowered" in l][0]
    assert {(r.file_seq, r.line_number) for r in hits.collect()} == {(1, 2), (1, 4), (4, 1)}


def test_strip_trims_the_blank_class(spark):
    points = [i for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, f"{chr(i)}a{chr(i)}b{chr(i)}") for i in points], "i int, t string")
    old = F.regexp_replace("t", rf"^[{text.BLANK}]+|[{text.BLANK}]+\z", "")
    assert rows.where(~text.strip(F.col("t")).eqNullSafe(old)).count() == 0
    assert "regexp" not in rows.select(text.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
