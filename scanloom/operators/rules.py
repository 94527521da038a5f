"""Line rules: configuration rules by file kind, and secret rules.

Rules are literals, so matching is a projection over the line (``array`` of guarded
structs, filtered and exploded), not a join. Two cheap screens come first: a file
without any of a rule set's key words is never split into lines, and a line without
them never meets a regular expression.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators.lines import explode_lines
from scanloom.session import cut_lineage

DOCKER, CI, APP, SECRET = "docker", "ci", "app", "secret"

# Own rules, written from public credential formats:
# (rule id, title, description, pattern, severity, confidence, explanation, fix, category)
SECRET_RULES = [
    ("private_key_block", "Private Key Material", "A PEM private key header is stored in the file.",
     r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "CRITICAL", "HIGH",
     "Anyone who can read the file can use the private key.", "Remove the key, rotate it and load it from a secret store.",
     "secret_exposure"),
    ("cloud_access_key", "Cloud Access Key Identifier", "A cloud access key identifier is stored in the file.",
     r"(?:^|[^A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?:[^A-Z0-9]|$)", "CRITICAL", "HIGH",
     "The identifier together with its secret grants access to the cloud account.", "Revoke the key and use short-lived roles.",
     "secret_exposure"),
    ("web_token", "JSON Web Token", "A signed web token is stored in the file.",
     r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "HIGH", "MEDIUM",
     "A stored token can be replayed until it expires.", "Remove the token and issue tokens at run time.",
     "secret_exposure"),
    ("quoted_credential", "Hardcoded Credential", "A credential is assigned as a text constant.",
     r"(?i)(?:password|passwd|secret|token|api_key|apikey)\s*[:=]\s*[\"'][^\"']{8,}[\"']", "HIGH", "MEDIUM",
     "Constants in source reach everyone with read access and every clone.", "Read the value from the environment or a secret store.",
     "hardcoded_credentials"),
]

# Lower-case words of which a matching line must contain at least one.
KEY_WORDS = {
    DOCKER: ["user", "expose", "from"],
    CI: ["pull_request_target"],
    APP: ["debug", "cors_origins", "allow_origin", "access-control-allow-origin"],
    SECRET: ["private key", "akia", "asia", "eyj", "password", "passwd", "secret", "token", "api_key", "apikey"],
}

_SECRET_SCANNER, _CONFIG_SCANNER = 0, 1


def rule_set(name: Column, path: Column) -> Column:
    """docker / ci / app by file name and path."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(F.contains(F.lower(name), F.lit("dockerfile")), DOCKER)
        .when(F.contains(forward, F.lit(".github/workflows")), CI)
        .otherwise(APP)
    )


def _catalog() -> list[tuple]:
    """(set, scanner, ordinal, rule id, title, description, pattern, severity, confidence, explanation, fix, category)"""
    rows = [(DOCKER, _CONFIG_SCANNER, -1, *fv.MISSING_USER_RULE, fv.DOCKER_CATEGORY)]
    for kind, rules, category in ((DOCKER, fv.DOCKER_RULES, fv.DOCKER_CATEGORY), (CI, fv.CI_RULES, fv.CI_CATEGORY),
                                  (APP, fv.APP_RULES, fv.APP_CATEGORY)):
        rows += [(kind, _CONFIG_SCANNER, i, *rule, category) for i, rule in enumerate(rules)]
    rows += [(SECRET, _SECRET_SCANNER, i, *rule) for i, rule in enumerate(SECRET_RULES)]
    return rows


def rule_table(spark: SparkSession) -> DataFrame:
    """The rule texts as a table (a fixed dozen rows, safe to broadcast)."""
    return spark.createDataFrame(
        _catalog(),
        "rule_set string, scanner int, rule int, rule_id string, title string, description string, pattern string, "
        "severity string, confidence string, explanation string, fix_suggestion string, category string")


def _matches(line: Column, kind: Column, kinds: list[str]) -> Column:
    """Array of (scanner, hit_set, rule) that hit the line, in rule order."""
    tests = [
        F.when((F.lit(True) if k == SECRET else kind == k) & line.rlike(text.portable(pattern)),
               F.struct(F.lit(scanner).alias("scanner"), F.lit(k).alias("hit_set"), F.lit(ordinal).alias("rule")))
        for k, scanner, ordinal, _, _, _, pattern, *_ in _catalog() if k in kinds and pattern is not None
    ]
    return F.filter(F.array(*tests), lambda m: m.isNotNull())


def _screen(col: Column, kind: Column, kinds: list[str]) -> Column:
    """Does the text hold a key word of its rule sets? The lambda makes ``lower`` run once per text."""
    return F.exists(F.array(F.lower(col)), lambda lowered: _holds_key_word(lowered, kind, kinds))


def _holds_key_word(lowered: Column, kind: Column, kinds: list[str]) -> Column:
    tests = []
    for k in kinds:
        hit = text.contains_any(lowered, KEY_WORDS[k])
        tests.append(hit if k == SECRET else (kind == k) & hit)
    return reduce(lambda a, b: a | b, tests)


def match_lines(lines: DataFrame, kinds: list[str]) -> DataFrame:
    """Lines (with ``rule_set``) to one row per (line, rule) hit.

    The lower-cased line is a column from a generator, which the optimizer doesn't inline into each test; without a lambda
    the screen of the lines is compiled together with their split.
    """
    lowered = lines.select("*", F.explode_outer(F.array(F.lower("line"))).alias("_lowered"))
    screened = lowered.where(_holds_key_word(F.col("_lowered"), F.col("rule_set"), kinds)).drop("_lowered")
    return text.explode_array(screened, lines.columns, _matches(F.col("line"), F.col("rule_set"), kinds), "_hit").select(
        *lines.columns, "_hit.scanner", "_hit.hit_set", "_hit.rule")


#: Rules up to which a user's table is broadcast and every rule tried.
MOST_BROADCAST_RULES = 10_000
#: Characters of the shortest and of the longest window that a rule of a larger table is sought by.
GRAM, LONGEST_WINDOW = 4, 16
#: The bit table of sought windows has 16 bits a window within these powers of two; with more windows it only lets more others pass.
LEAST_TABLE_BITS, MOST_TABLE_BITS = 20, 28
#: Bytes of lines that are searched at once.
SLICE_BYTES = 1 << 20
_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-/:=@#%&~ ,;!<>'\"`")
_HOLDERS = "\\([{.^$|?*+)"


def longest_literal(pattern: str) -> str | None:
    """Longest run of plain ASCII characters that every match holds, whatever the case; None if none is as long as a gram.

    Only characters outside groups and classes count that are there at least once. A pattern with alternatives outside
    groups, quoting, free spacing or case rules beyond ASCII has none, and whatever is not understood ends a run.
    """
    runs, run, at, depth = [], "", 0, 0
    if "\\Q" in pattern or re.search(r"\(\?[a-zA-Z-]*[xuUd-]", pattern):
        return None
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            known = pattern[at + 1:at + 2]
            c, at = (known if known in _HOLDERS + "]}-/" else ""), at + 2
        elif c == "[":
            at += 1 + pattern[at + 1:at + 2].count("^")
            at += 1 if pattern[at:at + 1] == "]" else 0
            nested = 1
            while at < len(pattern) and nested:
                step = pattern[at]
                nested += (step == "[") - (step == "]")
                at += 2 if step == "\\" else 1
            c = ""
        else:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                return None
            at += 1
            c = c if c in _PLAIN else ""
        follows = pattern[at:at + 1]
        if depth or not c or follows in ("?", "*", "{"):
            c = ""
        if c:
            run += c
        if not c or follows == "+":
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len)
    return best.lower() if len(best) >= GRAM else None


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _windows(texts: pa.Array, sizes: list[int]):
    """For each size the windows of that many bytes inside the texts, in ASCII lower case: (size, number of the text, hash)."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lengths = pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    owners = np.repeat(np.arange(len(lengths)), lengths)
    room = np.cumsum(lengths)[owners] - np.arange(len(owners))
    data = np.frombuffer("".join(lowered.to_pylist()).encode(), np.uint8).astype(np.uint64)
    total, power = np.zeros(len(data), np.uint64), 1
    for n in range(1, min(max(sizes, default=0), len(data)) + 1):
        total = total[:len(data) - n + 1] + data[n - 1:] * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
        if n in sizes:
            whole = np.flatnonzero(room[:len(total)] >= n)
            yield n, owners[whole], _mixed(total[whole] + np.uint64(n))


def _bit_table(keys: DataFrame) -> bytes:
    """Two bits for each ``_key``; the driver gets blocks of 8 KB, at most 2**MOST_TABLE_BITS bits in all."""
    bits = min(MOST_TABLE_BITS, max(LEAST_TABLE_BITS, (16 * keys.count()).bit_length()))
    both = F.array(F.col("_key"), F.shiftrightunsigned("_key", 32))
    slots = keys.select(F.explode(both).alias("x")).select(F.col("x").bitwiseAND((1 << bits) - 1).alias("slot"))

    def packed(held):
        out = np.zeros(1 << 16, bool)
        out[held] = True
        return np.packbits(out, bitorder="little").tobytes()

    blocks = slots.groupBy(F.shiftright("slot", 16).alias("block")).agg(F.collect_set(F.col("slot").bitwiseAND(0xFFFF).cast("int")).alias("held"))
    table = bytearray(1 << (bits - 3))
    for r in blocks.select("block", F.udf(packed, "binary")("held").alias("bits")).collect():
        table[r["block"] << 13:(r["block"] + 1) << 13] = r["bits"]
    return bytes(table)


def _held_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(``_id``, rule set, ``_key``): the windows of ``keys(_size, _key)`` that each line holds, and a few others that share their bits."""
    sizes = sorted(r["_size"] for r in keys.select("_size").distinct().collect())
    shared = lines.sparkSession.sparkContext.broadcast(_bit_table(keys.select("_key").distinct()))

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(len(table) * 8 - 1)

        def marked(h):
            slot = (h & mask).astype(np.int64)
            return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("line")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1, [len(ends)]]))
            for low, high in zip(cuts, cuts[1:]):
                part, found = batch.slice(low, high - low), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for _, owner, h in _windows(part.column("line"), sizes):
                    hit = np.flatnonzero(marked(h))
                    hit = hit[marked(h[hit] >> np.uint64(32))]
                    found.append((owner[hit], h[hit]))
                owner, h = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])[:len(h)])
                owner = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([part.column("_id").take(owner), part.column("rule_set").take(owner), pa.array(h[first].view(np.int64))],
                                                 ["_id", "rule_set", "_key"])

    return lines.select("_id", "rule_set", "line").mapInArrow(run, "_id bigint, rule_set string, _key bigint")


def _with_windows(rules: DataFrame) -> DataFrame:
    """``rules`` with the hashes of all windows (``_keys``, of ``_size`` characters) of their longest literals; NULL without a literal."""
    def run(batches):
        for batch in batches:
            literals = [longest_literal(p) for p in batch.column("pattern").to_pylist()]
            size = [min(len(l), LONGEST_WINDOW) if l else None for l in literals]
            keys = [None] * len(literals)
            for n in {x for x in size if x}:
                own = [i for i, x in enumerate(size) if x == n]
                for _, owner, h in _windows(pa.array([literals[i] for i in own]), [n]):
                    for i, group in zip(own, np.split(h.view(np.int64), np.flatnonzero(np.diff(owner)) + 1)):
                        keys[i] = np.unique(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "_size", "_keys"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema)
    return rules.mapInArrow(run, f"{fields}, _size int, _keys array<bigint>")


def rule_keys(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with ``_key``: a literal of at most ``LONGEST_WINDOW`` characters itself, of a longer one the window that the fewest lines hold."""
    known = cut_lineage(_with_windows(rules))
    several = known.where(F.size("_keys") > 1)
    one = known.where(F.coalesce(F.size("_keys"), F.lit(1)) <= 1).withColumn("_key", F.col("_keys")[0]).drop("_keys")
    if several.isEmpty():
        return one
    parts = several.withColumn("_key", F.explode("_keys")).drop("_keys")
    held = _held_keys(lines, parts).groupBy("_key").agg(F.count("*").alias("_held"))
    counted = parts.join(held, "_key", "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    return one.unionByName(counted.groupBy(*rules.columns, "_size").agg(F.min_by("_key", F.struct("_held", "_key")).alias("_key")))


def match_rule_table(lines: DataFrame, rules: DataFrame, most: int = MOST_BROADCAST_RULES) -> DataFrame:
    """Table form for user-supplied rules: ``rules(rule_set, scanner, rule, pattern)``, without repeated rows.

    Up to ``most`` rules are broadcast and tried on every line of their set. Of a larger table, a line meets only the
    rules whose literal (or its rarest window) it holds, by an equi-join of hashes and line numbers, and the pattern
    confirms. Rules without a literal are tried on all lines: their table is repeated once a bucket and the lines of a
    rule set are dealt over the buckets.
    """
    names = [f"`{c}`" for c in lines.columns]
    if rules.limit(most + 1).count() <= most:
        return lines.alias("l").join(F.broadcast(rules).alias("r"), (F.col("l.rule_set") == F.col("r.rule_set")) & F.expr("l.line rlike r.pattern")).select(
            "l.*", "r.scanner", "r.rule")
    lines = cut_lineage(lines.withColumn("_id", F.monotonically_increasing_id()))
    keyed = cut_lineage(rule_keys(lines, rules))
    by_key, bare = keyed.where(F.col("_key").isNotNull()), keyed.where(F.col("_key").isNull()).drop("_key", "_size")
    table = by_key.select("rule_set", "_key", F.struct("scanner", "rule", "pattern").alias("_r"))
    met = _held_keys(lines, by_key).join(table, ["rule_set", "_key"]).select("_id", "_r").join(lines, "_id").where(F.expr("line rlike _r.pattern"))
    out = met.select(*names, "_r.scanner", "_r.rule")
    if bare.isEmpty():
        return out
    n = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("_bucket", F.pmod("_id", F.lit(n)).cast("int")).alias("l")
    repeated = bare.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).alias("r")
    tried = dealt.join(repeated, (F.col("l.rule_set") == F.col("r.rule_set")) & (F.col("l._bucket") == F.col("r._bucket")) & F.expr("l.line rlike r.pattern"))
    return out.unionByName(tried.select(*[f"l.{c}" for c in names], "r.scanner", "r.rule"))


def missing_user(files: DataFrame) -> DataFrame:
    """Dockerfiles without any USER directive, decided inside the file's row."""
    docker = files.where(rule_set(F.col("name"), F.col("relative_path")) == DOCKER)
    lines = text.split_lines(F.col("content"))
    return docker.where(~F.exists(lines, lambda l: l.rlike(text.portable(fv.USER_DIRECTIVE)))).drop("content")


def _finding(hits: DataFrame) -> DataFrame:
    """Attach the rule texts and compose ids."""
    table = rule_table(hits.sparkSession).drop("scanner", "pattern").withColumnRenamed("rule_set", "hit_set")
    joined = hits.join(F.broadcast(table), ["hit_set", "rule"])
    prefix = F.when(F.col("scanner") == _SECRET_SCANNER, "secret").otherwise("config")
    whole = F.col("rule") < 0
    return joined.select(
        F.col("repository_name").alias("scan_id"),
        F.struct(F.lit(0).alias("phase"), F.col("file_seq").cast("bigint").alias("file_seq"), "scanner", "rule",
                 F.col("line_number").alias("line"), F.lit("").alias("tail")).alias("finding_seq"),
        F.when(whole, F.concat_ws("-", prefix, "rule_id", "relative_path"))
        .otherwise(F.concat_ws("-", prefix, "rule_id", "relative_path", F.col("line_number").cast("string"))).alias("finding_id"),
        "title", "description", "severity", "confidence", F.col("relative_path").alias("file_path"), "line_number",
        F.when(whole, F.lit(fv.WHOLE_FILE_SNIPPET)).otherwise(text.strip(F.col("line"))).alias("code_snippet"),
        "explanation", "fix_suggestion", "category",
    )


def scan_files(files: DataFrame, kinds: tuple[str, ...] = (DOCKER, CI, APP, SECRET)) -> DataFrame:
    """Secret and configuration findings of every file."""
    kinds = list(kinds)
    routed = files.withColumn("rule_set", rule_set(F.col("name"), F.col("relative_path")))
    keep = ["repository_name", "file_seq", "relative_path", "rule_set"]
    screened = routed.where(_screen(F.col("content"), F.col("rule_set"), kinds)).select(*keep, "content")
    hits = match_lines(explode_lines(screened, keep), kinds)
    out = _finding(hits)
    if DOCKER in kinds:
        absent = missing_user(files).select(
            "repository_name", "file_seq", "relative_path", F.lit(DOCKER).alias("hit_set"),
            F.lit(1).alias("line_number"), F.lit("").alias("line"), F.lit(_CONFIG_SCANNER).alias("scanner"),
            F.lit(-1).alias("rule"))
        out = out.unionByName(_finding(absent))
    return out
