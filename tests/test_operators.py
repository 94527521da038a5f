import json
import random

import pytest
from pyspark.sql import Window, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators import chunking, dependencies, findings, inventory, ordered, packing, progress, review, rules, scoring
from scanloom.streaming import states


def _files(spark, rows):
    return spark.createDataFrame(
        [("r", i, p.rsplit("/", 1)[-1], p, c) for i, (p, c) in enumerate(rows)],
        "repository_name string, file_seq bigint, name string, relative_path string, content string",
    ).withColumn("extension", text.suffix(F.col("name"))).withColumn("size", F.octet_length("content").cast("bigint"))


def _chunks(spark, path, content):
    rows = chunking.explode_chunks(chunking.chunk_arrays(_files(spark, [(path, content)])), ["relative_path"]).orderBy("start_line").collect()
    return [(r.chunk_type, r.name, r.chunk_id.split("#")[1], r.start_line, r.end_line) for r in rows]


# ------------------------------------------------------------------ ordered scans
def test_ordered_scans_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(9), i, rng.randrange(100) if rng.random() < 0.8 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    spread = ordered.spread_in_order(df, ["k"], ["i"], parts=7)
    got = ordered.running(spread, ["k"], s=("sum", F.col("v")), m=("max", F.col("v")))
    got = ordered.running(got, ["k"], earlier=True, e=("max", F.col("v")), t=("sum", F.lit(1)))
    got = ordered.previous(ordered.numbered(got, ["k"], "n"), ["k"], "p", F.col("v"))
    got = ordered.drop_stamps(got)
    w = Window.partitionBy("k").orderBy("i")
    inc, exc = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "i", "v", F.coalesce(F.sum("v").over(inc), F.lit(0)).alias("s"), F.max("v").over(inc).alias("m"),
                     F.max("v").over(exc).alias("e"), (F.row_number().over(w) - 1).alias("t"),
                     F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert spread.where("k = 0").select("_part").distinct().count() > 2  # the hot key is split


def test_spread_join_splits_hot_keys(spark):
    large = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left"):
        got = ordered.spread_join(large, small, ["k"], ["i"], how, hot_rows=50).select("k", "i", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, large.join(small, "k", how).select("k", "i", "v").collect()))


# ------------------------------------------------------------------ chunking
def test_config_sections(spark):
    assert [c[1] for c in _chunks(spark, "a.toml", "[x]\na=1\n[[y]]\n[z]\nb: c\nk:\nj: {\n")] == ["root", "z", "k", "j"]
    exact = "\n".join(["l"] * 150 + ["[s]"] + ["m"] * 299)
    assert [c[1:] for c in _chunks(spark, "a.ini", exact)] == [
        ("root", "config-root-1", 1, 150), ("section-151", "config-section-151-151", 151, 300), ("section-301", "config-section-301-301", 301, 450)]


def test_brace_blocks(spark):
    code = "function a() { return 1; }\nfunction b(x) {\n  if (x) {\n  }\n}\n}\nconst c = (x) => {\n"
    assert _chunks(spark, "a.js", code) == [
        ("function", "b", "function-b-1", 1, 5), ("module", "module_scope", "module-6", 6, 7)]  # the stray } leaves the count at 0
    assert [c[3:] for c in _chunks(spark, "a.java", "\n".join(["x"] * 130))] == [(1, 120), (121, 130)]
    assert _chunks(spark, "a.ts", "class K {\n  run() {\n") == [("class", "K", "module-1", 1, 2)]


def test_python_chunks(spark):
    code = "import os\n@d\ndef f():\n    def g():\n        pass\n\nclass C:\n    def m(self):\n        pass\nif 1:\n    async def h():\n        pass\n"
    assert _chunks(spark, "a.py", code) == [
        ("module", "module_scope", "module-1", 1, 2), ("function", "f", "fn-f-3", 3, 5), ("class", "C", "class-C-7", 7, 9),
        ("module", "module_scope", "module-10", 10, 10), ("function", "h", "fn-h-11", 11, 12)]
    assert _chunks(spark, "b.py", "def (:\n")[0][0] == "general"
    assert [c[3:] for c in _chunks(spark, "c.py", "x = 1\n" * 250)] == [(1, 100), (101, 200), (201, 250)]
    assert _chunks(spark, "d.py", " \n\t\n") == []


def test_chunks_cover_lines_once(spark):
    rng = random.Random(5)
    lines = ["function f() {", "}", "class A {", "[s]", "k:", "", "x = 1", "def f(): pass", "  y"]
    rows = [(f"f{i}{ext}", "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 500))))
            for i in range(12) for ext in (".py", ".js", ".yaml", ".txt")]
    files = _files(spark, rows)
    one = chunking.explode_chunks(chunking.chunk_arrays(files.coalesce(1)), ["relative_path"]).collect()
    many = chunking.explode_chunks(chunking.chunk_arrays(files.repartition(8)), ["relative_path"]).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    for path, content in rows:
        seen = [n for c in one if c.relative_path == path for n in range(c.start_line, c.end_line + 1)]
        assert len(seen) == len(set(seen))
        assert {i for i, l in enumerate(content.split("\n"), 1) if l.strip()} <= set(seen)


def test_packing(spark):
    def pack(sizes, cap):
        chunks = [(f"c{i}", "general", "n", "x" * n, i + 1, i + 1) for i, n in enumerate(sizes)]
        df = spark.createDataFrame([("r", 1, "p", chunks)], "repository_name string, file_seq bigint, relative_path string, chunks array<struct<"
                                   "chunk_id:string,chunk_type:string,name:string,content:string,start_line:int,end_line:int>>")
        return packing.pack_files(df, cap).orderBy("pack_seq").collect()

    assert [r.segments for r in pack([20, 5, 5, 1], 10)] == [1, 2, 1]
    assert [r.segments for r in pack([5, 5], 10)] == [2]
    assert pack([3], 10)[0].chunk_id == "c0"
    assert pack([1, 2], 10)[0].content == "// --- Code Segment 1 (Lines 1-1) ---\nx\n\n// --- Code Segment 2 (Lines 2-2) ---\nxx\n"
    rng = random.Random(3)
    sizes = [rng.randrange(1, 9) for _ in range(300)]
    want, run = [], None
    for n in sizes:
        if run is None or run + n > 12:
            want.append(0)
            run = 0
        want[-1] += 1
        run += n
    assert [r.segments for r in pack(sizes, 12)] == want


# ------------------------------------------------------------------ rules and manifests
def test_docker_and_unicode_rules(spark):
    got = rules.scan_files(_files(spark, [
        ("a/Dockerfile", "FROM x\nEXPOSE 5432\nEXPOSE 8080\n"), ("Dockerfile.dev", "FROM x:1\nuser root\nFROM y:latest"),
        ("s.py", "  DEBUG = True\néDEBUG = True\nDEBUG\u00a0=\u00a0True\nDEBUG = Trueish\napp.run(debug=True)"),
        (".github/workflows/a.yml", "pull_request_target:\nDEBUG = True")]), rules.KEY_WORDS.keys())
    ids = sorted(r.finding_id for r in got.collect())
    assert ids == sorted([
        "config-missing-user-a/Dockerfile", "config-docker_unsafe_base-a/Dockerfile-1", "config-docker_wildcard_expose-a/Dockerfile-2",
        "config-docker_run_as_root-Dockerfile.dev-2", "config-docker_unsafe_base-Dockerfile.dev-3",
        "config-django_debug_enabled-s.py-1", "config-django_debug_enabled-s.py-3", "config-django_debug_enabled-s.py-5",
        "config-flask_debug_enabled-s.py-5", "config-github_actions_pull_request_target-.github/workflows/a.yml-1"])


def test_rule_table_of_any_size(spark):
    lines = spark.createDataFrame([("app", i, f"debug={i}") for i in range(30)], "rule_set string, line_number int, line string")
    table = spark.createDataFrame([("app", 1, r, f"={r}$") for r in range(20)] + [("ci", 1, 99, "debug")], "rule_set string, scanner int, rule int, pattern string")
    want = [(r, r) for r in range(20)]
    for most in (1000, 3):
        got = rules.match_rule_table(lines, table, most)
        assert got.columns == [*lines.columns, "scanner", "rule"]
        assert sorted((x.line_number, x.rule) for x in got.collect()) == want


def test_plug_in_scanner_without_order(spark):
    plug = lambda text: lambda files: files.select(
        F.lit("s").alias("scan_id"), F.lit(text).alias("title"), F.lit("c").alias("category"), F.lit("LOW").alias("severity"),
        F.lit("LOW").alias("confidence"), F.lit("f").alias("file_path"), F.lit(1).alias("line_number"),
        F.lit("x").alias("explanation"), F.lit("y").alias("fix_suggestion"))
    rows = findings.run_scanners(spark.range(3), [plug("b"), plug("a")])
    assert rows.where("finding_seq is null").count() == 0
    assert [r.title for r in findings.deduplicate(rows).collect()] == ["b"]


def test_manifests_and_vulnerabilities(spark):
    files = _files(spark, [
        ("package.json", json.dumps({"dependencies": {"express": "4.17.1", "a": None}, "devDependencies": {"express": "^5.0"}})),
        ("x/package.json", '{"dependencies": 3, "devDependencies": {"vue": "1"}}'), ("y/package.json", "{broken"),
        ("requirements.txt", "django==3.2.5 # old\nurllib3==1.25.3\nurllib3==1.25\nfastapi>=0.1\n#x\n"),
        ("go.mod", "module m\ngo 1.20\nrequire (\n\tgithub.com/gin-gonic/gin v1\n)\nreplace a => b\nrequire c v2\n"),
        ("pom.xml", "<dependency><groupId>log4j</groupId><artifactId>log4j</artifactId><version>1.2.17</version></dependency>")])
    entries = inventory.manifest_entries(files)
    assert {r.dependency for r in entries.collect()} == {
        "express==^5.0", "a==None", "vue==1", "django==3.2.5", "urllib3==1.25.3", "urllib3==1.25", "fastapi>=0.1",
        "github.com/gin-gonic/gin==v1", "replace==a", "c==v2", "log4j:log4j==1.2.17"}
    assert {r.framework for r in inventory.frameworks(files, entries).collect()} == {"Express.js", "Vue.js", "Django", "FastAPI", "Gin (Go)"}
    found = {r.finding_id: r.file_path for r in dependencies.dependency_findings(inventory.dependencies(entries), files).collect()}
    assert found == {"dependency-django-3.2.5": "requirements.txt", "dependency-urllib3-1.25": "requirements.txt", "dependency-log4j-1.2.17": "pom.xml"}


def test_manifest_readers_evaluate_each_name_once(spark, capsys):
    pom = "<dependency>\n<groupId>org.springframework</groupId>\r<artifactId>spring-boot-x\u2028</artifactId></dependency><dependency>\x85</dependency>"
    files = _files(spark, [("pom.xml", pom)])
    entries = inventory.pom_xml(files)
    entries.explain()
    assert capsys.readouterr().out.count("<groupId>") == 1
    assert [(r.dependency, r.framework) for r in entries.collect()] == [("org.springframework:spring-boot-x==latest", "Spring Boot")]


def test_longest_literal():
    want = {r"password\s*=": "password", r"abc|abcdef": None, r"(abcdef)xyzw?v": None, r"key_?name": "name", r"AKIA[0-9A-Z]{16}": "akia", r"secret+ly": "secret",
            r"[abcd]efgh": "efgh", r"a{5}bcde": "bcde", r"\bvalue\b": "value", r"www\.example\.org": "www.example.org", r"(?i)PassWord": "password", r"ab.cd": None,
            r"\Qa.b\Ecdef": None, r"[]x]token": "token", r"[^]x]token": "token", r"(?<![a-z])word(?!s)": "word", r"(a|(b[)]c))tail": "tail", "": None, r"\d\d\d\d": None}
    assert {p: rules.longest_literal(p) for p in want} == want


def test_rule_table_by_grams_equals_trying_every_rule(spark):
    import re

    rng = random.Random(9)
    words = ["token", "secret", "pass", "Key", "value", "x", "é", "AKIA"]
    rows = [(i, rng.choice("ab"), rng.choice(["", " ", "=", "-"]).join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(300)] + [(300, "a", ""), (301, None, "token")]
    pieces = ["token", "secret", "(?:pass|Key)", "value?", "[kK]ey", "AKIA", "x+", r"\s*=\s*", ".", "^", "(?i)"]
    made = sorted({"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) for _ in range(120)})
    made = [p for p in made if "(?i)" not in p[1:]]
    lines = spark.createDataFrame(rows, "gram_id int, rule_set string, line string")
    table = spark.createDataFrame([(rng.choice("ab"), 1, i, p) for i, p in enumerate(made)], "rule_set string, scanner int, rule int, pattern string")
    few, many = (rules.match_rule_table(lines, table, most=most) for most in (1000, 5))
    got = sorted((r.gram_id, r.rule) for r in many.collect())
    sets = {r.rule: r.rule_set for r in table.collect()}
    assert got == sorted((r.gram_id, r.rule) for r in few.collect())
    assert got == sorted((i, k) for i, s, line in rows for k, p in enumerate(made) if s == sets[k] and re.search(p, line)) and len(got) > 500


def test_long_lines_meet_only_rules_whose_literal_they_hold(spark):
    rng = random.Random(3)
    parts = ["tion", "ment", "ther", "ance", "able"]
    words = sorted({"".join(rng.choice(parts) for _ in range(n)) for n in (3, 4, 6) for _ in range(40)})
    apart = [a + " " + b + a[2:] + b[:2] for a in parts for b in parts]  # every gram of the words, none of the words
    rows = [(0, "a", " ".join(apart)), (1, "a", " ".join(apart + [words[5].upper(), words[50]])), (2, "b", words[7]), (3, "a", None), (4, "a", "ſtion é" + words[9]), (5, "a", "")]
    lines = spark.createDataFrame(rows, "_id bigint, rule_set string, line string")
    table = spark.createDataFrame([("a", 1, w, f"(?i){w}") for w in words], "rule_set string, scanner int, rule string, pattern string")
    got = sorted((r.n, r.rule) for r in rules.match_rule_table(lines.withColumnRenamed("_id", "n"), table, most=5).collect())
    assert got == sorted((n, w) for n, s, line in rows if s == "a" and line for w in words if w in line.lower()) and len(got) >= 3
    keys = rules.rule_keys(lines, table)
    assert keys.count() == len(words) and rules._held_keys(lines, keys).where("_id = 0").isEmpty()
    assert rules.longest_literal("(?iu)tokens") is None


# ------------------------------------------------------------------ findings
def _merge_model(rows):
    """Sequential reading of the merge: a list of survivors, first match wins."""
    rank = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
    kept, seen = [], set()
    for row in rows:
        r = dict(row)
        key = (r["file_path"], r["line_number"], r["category"]) if r["line_number"] is not None else (r["file_path"], r["title"])
        if key not in seen:
            seen.add(key)
            kept.append(r)
            continue
        same = (lambda x: (x["file_path"], x["line_number"], x["category"]) == key) if r["line_number"] is not None else (
            lambda x: (x["file_path"], x["title"]) == key)
        target = next(x for x in kept if same(x))
        for f in ("explanation", "fix_suggestion"):
            target[f] = r[f] if len(r[f]) > len(target[f]) else target[f]
        for f in ("severity", "confidence"):
            target[f] = r[f] if rank.get(r[f], 0) > rank.get(target[f], 0) else target[f]
    return kept


def test_dedupe_equals_sequential_model(spark):
    rng = random.Random(11)
    fields = ("finding_seq", "file_path", "line_number", "category", "title", "severity", "confidence", "explanation", "fix_suggestion")
    rows = [dict(zip(fields, (i, f"f{rng.randrange(2)}", rng.choice([None, None, 1, 2]), f"c{rng.randrange(2)}", f"t{rng.randrange(3)}",
                              rng.choice(["CRITICAL", "HIGH", "LOW", "low"]), rng.choice(["HIGH", "LOW"]), "e" * rng.randrange(5) + str(i % 10),
                              "f" * rng.randrange(5) + str(i % 10)))) for i in range(60)]
    scans = {f"s{s}": rng.sample(rows, 25) for s in range(12)}
    data = [(s, *[r[f] for f in fields]) for s, rs in scans.items() for r in rs]
    df = spark.createDataFrame(data, "scan_id string, finding_seq int, file_path string, line_number int, category string, title string, "
                               "severity string, confidence string, explanation string, fix_suggestion string")
    once = findings.deduplicate(df)
    got = sorted(tuple(r) for r in once.collect())
    want = sorted((s, *[r[f] for f in fields]) for s, rs in scans.items() for r in _merge_model(sorted(rs, key=lambda r: r["finding_seq"])))
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_dedupe_of_missing_keys_and_hot_groups(spark):
    """NULL files, titles and categories are keys of their own; a hot group without lines whose first row is the best one."""
    rng = random.Random(5)
    fields = ("finding_seq", "file_path", "line_number", "category", "title", "severity", "confidence", "explanation", "fix_suggestion")
    rows = [dict(zip(fields, (i, rng.choice(["f", None]), rng.choice([None, None, 1]), rng.choice(["c", None]), rng.choice(["t", None, "n"]),
                              rng.choice(["HIGH", "LOW"]), "LOW", "e" * rng.randrange(4) + str(i % 10), "f"))) for i in range(1, 200)]
    rows += [dict(zip(fields, (i, "hot", 7 if i == 1000 else None, "c", "t", "LOW", "LOW", "x" * (500 - i % 100 if i > 1001 else 900) + str(i % 10), "f"))) for i in range(1000, 3000)]
    df = spark.createDataFrame([("s", *[r[f] for f in fields]) for r in rows], "scan_id string, finding_seq int, file_path string, line_number int, category string, title string, "
                               "severity string, confidence string, explanation string, fix_suggestion string").repartition(7)
    got = sorted(map(str, (tuple(r) for r in findings.deduplicate(df).collect())))
    assert got == sorted(str(("s", *[r[f] for f in fields])) for r in _merge_model(rows))
    plan = findings.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4 and "WindowGroupLimit" in plan and "rangepartitioning" not in plan


def test_dedupe_exchanges_plain_rows_once(spark):
    """Files of few findings merge by one exchange, beside files of many that are spread; NULL files and scans included."""
    rng = random.Random(8)
    fields = ("finding_seq", "file_path", "line_number", "category", "title", "severity", "confidence", "explanation", "fix_suggestion")
    make = lambda i: dict(zip(fields, (i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, None, 1, 2]), rng.choice(["c", None]), rng.choice(["t", None, "n"]),
                                       rng.choice(["HIGH", "LOW", "odd"]), rng.choice(["HIGH", "LOW"]), "e" * rng.randrange(4) + str(i % 10), "f" * rng.randrange(3) + str(i % 7))))
    scans = {s: [make(i) for i in range(n)] for s, n in (("s", 90), (None, 60), ("t", 12))}
    df = spark.createDataFrame([(s, *[r[f] for f in fields]) for s, rs in scans.items() for r in rs],
                               "scan_id string, finding_seq int, file_path string, line_number int, category string, title string, "
                               "severity string, confidence string, explanation string, fix_suggestion string").repartition(5)
    want = sorted(str((s, *[r[f] for f in fields])) for s, rs in scans.items() for r in _merge_model(rs))
    plans = {}
    for together in (1, 20, 100, 1000):  # each file spread, some of them, none, all because the table is small
        out = findings.deduplicate(df, together)
        plans[together] = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, map(tuple, out.collect()))) == want
    assert plans[100].count("Exchange hashpartitioning") == 1 and "Aggregate" not in plans[100]


def test_score_edges(spark):
    df = spark.createDataFrame([("a", "critical", "xss")] * 6 + [("b", "odd", "nothing")], "scan_id string, severity string, category string")
    scans = spark.createDataFrame([("a",), ("b",), ("c",)], "scan_id string")
    got = {r.scan_id: r for r in scoring.score_scans(df, scans).collect()}
    assert (got["a"].overall_score, got["b"].overall_score, got["c"].overall_score) == (0, 94, 100)
    assert got["a"].score_input_validation == 0 and got["b"].score_configuration == 94 and got["c"].risk_summary.startswith("No security")


def test_responses(spark):
    def one(doc, start=10):
        df = spark.createDataFrame([("s", 1, "c", "p", start, doc, None)], "repository_name string, chunk_rank int, chunk_id string, "
                                   "file_path string, start_line int, response string, note string")
        return [(r.finding_id, r.title, r.severity, r.line_number) for r in review.parse_responses(df).collect()]

    item = lambda **k: json.dumps({"findings": [k]})
    assert one(item(line_number="12")) == [("ai-None-p-12", "AI Vulnerability Finding", "MEDIUM", 12)]
    assert one(item(line_number="abc", category="xss", severity="high")) == [("ai-xss-p-10", "AI Vulnerability Finding", "HIGH", 10)]
    assert one(item(line_number=3.7))[0][3] == 12 and one(item(line_number=None))[0][3] == 10
    assert one(item(severity=None)) == [] and one(item(title=3)) == [] and one(item(line_number=[1])) == []
    assert one("{broken") == [] and one("[]") == [] and one('{"findings": []}') == []


# ------------------------------------------------------------------ states
def _fold(events):
    status, kept = "QUEUED", []
    for seq, new in events:
        if states.accepts(status, new):
            status = new
            kept.append(seq)
    return kept


def test_states_equal_fold(spark):
    rng = random.Random(7)
    names = ["QUEUED", "CLONING", "LOADING", "SCORING", "COMPLETED", "PAUSED", "FAILED"]
    weights = [5, 5, 5, 5, 1, 2, 1]
    rows = [(i, f"s{rng.randrange(40)}" if i % 3 else "hot", rng.choices(names, weights)[0] if i % 3 else rng.choices(names[:4])[0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq bigint, scan_id string, status string")
    got = sorted(r.seq for r in progress.accepted_events(df).collect())
    want = []
    for scan in {r[1] for r in rows}:
        want += _fold([(q, st) for q, s, st in rows if s == scan])
    assert got == sorted(want)


def _fed(events):
    """(accepted, sent) places of one scan's (seq, status, progress) events."""
    status, last, kept, sent = "QUEUED", None, [], []
    for seq, new, percent in events:
        if states.accepts(status, new):
            status = new
            kept.append(seq)
            if last != (new, percent):
                sent.append(seq)
            last = (new, percent)
    return kept, sent


def _events(rng, n, scans, hot):
    names = [*fv.PIPELINE_STATES, "FAILED", "CANCELLED", "PAUSED", "RESUMED", None]
    mild = [*fv.PIPELINE_STATES[:-1], "PAUSED", "RESUMED", None]
    return [(i, "hot" if rng.random() < hot else f"s{rng.randrange(scans)}", rng.choice(names if rng.random() < 0.02 else mild[:1 + rng.randrange(len(mild))]), rng.choice([0, 50, None]))
            for i in range(n)]


@pytest.mark.parametrize(("n", "scans", "hot"), [(0, 1, 0), (1, 1, 0), (400, 1, 0), (900, 4, 0.5), (900, 300, 0.1), (900, 2, 0.95)])
def test_change_feed_equals_fold_over_many_parts(spark, n, scans, hot):
    """A hot scan goes through many parts; every part is entered in whatever state the ones before left."""
    rows = _events(random.Random(n + scans), n, scans, hot)
    df = spark.createDataFrame(rows, "seq bigint, scan_id string, status string, progress int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        kept = sorted(r.seq for r in progress.accepted_events(df).collect())
        sent = sorted(r.seq for r in progress.change_feed(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [_fed([(q, st, p) for q, s, st, p in rows if s == scan]) for scan in {r[1] for r in rows}]
    assert kept == sorted(q for w in want for q in w[0]) and sent == sorted(q for w in want for q in w[1])


def test_parts_compose_like_the_whole():
    """Cutting events anywhere and carrying one composition a part gives the same marks as one part."""
    import pyarrow as pa
    from pyspark import TaskContext
    from unittest import mock

    rng = random.Random(3)
    for _ in range(40):
        rows = sorted(_events(rng, 60, 3, 0.6), key=lambda r: (r[1], r[0]))
        cuts = sorted({0, 60, *(rng.randrange(60) for _ in range(rng.randrange(6)))})
        ends, marks = [], []
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            batches = [pa.RecordBatch.from_pylist([dict(zip(("seq", "scan_id", "status", "progress"), r)) for r in rows[i:min(hi, i + 7)]], pa.schema(
                [("seq", pa.int64()), ("scan_id", pa.string()), ("status", pa.string()), ("progress", pa.int32())])) for i in range(lo, hi, 7)]
            with mock.patch.object(TaskContext, "get", lambda part=part: mock.Mock(partitionId=lambda: part)):
                out = [r for b in progress._mark(iter(batches)) for r in b.to_pylist()]
            marks += out
            ends += [r for r in out if r["_ends"]]
        entered = {e[0]: e for e in progress._entries(ends)}
        kept, sent = [], []
        for r in marks:
            _, state, was, status, percent = entered[r["_part"]]
            if r["_taken"] >> state & 1:
                kept.append(r["seq"])
                if (not was or (status, percent) != (r["status"], r["progress"])) if r["_opens"] >> state & 1 else r["_changes"] >> state & 1:
                    sent.append(r["seq"])
        want = [_fed([(q, st, p) for q, s, st, p in rows if s == scan]) for scan in {r[1] for r in rows}]
        assert sorted(kept) == sorted(q for w in want for q in w[0]) and sorted(sent) == sorted(q for w in want for q in w[1])


def test_change_feed_plan(spark):
    """Events are exchanged once and read by the range sampling and the marking only."""
    df = spark.createDataFrame(_events(random.Random(1), 50, 3, 0.3), "seq bigint, scan_id string, status string, progress int")
    plan = progress.change_feed(df)._jdf.queryExecution().executedPlan().toString()
    assert " Exchange " not in plan and plan.count("Scan parquet") == 1 and "BroadcastHashJoin" in plan


def test_expired_states(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", None), ("c", 1000.0), ("d", 999999.0)], "scan_id string, finished_at double")
    assert sorted(r[0] for r in progress.unexpired_states(df, F.lit(1000000.0)).select("scan_id").collect()) == ["a", "b", "d"]


def test_text_functions(spark):
    df = spark.createDataFrame([(0,), (1024,), (1536,), (5 * 1024 ** 3,)], "n bigint")
    assert [r[0] for r in df.select(text.human_size(F.col("n"))).collect()] == ["0 Bytes", "1 KB", "1.5 KB", "5 GB"]
    df = spark.createDataFrame([("invalid_url",), ("https://x.org/a/b.git/",)], "u string")
    assert [r[0] for r in df.select(text.repository_name_from_url(F.col("u"))).collect()] == [None, "b"]
    df = spark.createDataFrame([("a\x0bb\x0c\x1cc\u2028d\r\n",)], "t string")
    assert df.select(text.split_lines(F.col("t"))).first()[0] == "a\x0bb\x0c\x1cc\u2028d\r\n".splitlines()
