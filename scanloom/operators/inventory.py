"""What a repository is made of: sizes, languages, config files, manifests, frameworks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text

REPO = "repository_name"


def repository_totals(files: DataFrame) -> DataFrame:
    return files.groupBy(REPO).agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size"))


def within_limits(files: DataFrame, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """Optional size guard: repositories over a limit are rejected as a whole."""
    totals = repository_totals(files)
    if max_bytes is not None:
        totals = totals.where(F.col("total_size") <= max_bytes)
    if max_files is not None:
        totals = totals.where(F.col("total_files") <= max_files)
    return totals


def language(extension: Column) -> Column:
    return text.lookup(F.lower(extension), fv.LANGUAGES, fv.UNKNOWN_LANGUAGE)


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy(REPO, language(F.col("extension")).alias("language")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size"))


def config_labels(name: Column) -> Column:
    """Labels of every config pattern that the lower-cased name starts with."""
    tests = [F.when(F.lower(name).rlike(f"^(?:{pattern})"), F.lit(label)) for pattern, label in fv.CONFIG_FILE_PATTERNS]
    return F.filter(F.array(*tests), lambda l: l.isNotNull())


def config_files(files: DataFrame) -> DataFrame:
    """(repository, file, label) rows."""
    return text.explode_array(files, [REPO, "relative_path"], config_labels(F.col("name")), "label").select(
        REPO, "relative_path", "label", F.format_string("%s (%s)", "label", "relative_path").alias("config"))


def workflows(listing: DataFrame) -> DataFrame:
    """CI workflow files, taken from the unfiltered listing."""
    return listing.where(F.col("relative_path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$")).select(
        REPO, "relative_path", F.concat(F.lit("GitHub Action: "), text.file_name(F.col("relative_path"))).alias("config"))


def configs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Distinct config entries per repository (rows; a report sorts them)."""
    return config_files(files).select(REPO, "config").union(workflows(listing).select(REPO, "config")).distinct()


def short_config_names(config_rows: DataFrame) -> DataFrame:
    """First word of every config entry, counted per repository.

    Entries of one word sort together, so (word, n) in word order is the whole listing.
    """
    return config_rows.groupBy(REPO, F.substring_index("config", " ", 1).alias("short_name")).agg(F.count("*").alias("n"))


def short_config_text(config_rows: DataFrame, repositories: DataFrame) -> DataFrame:
    """The listing as one text per repository of ``repositories``, as report heads show it.

    Equal words are counted before they meet, so what a task gathers is one row for each different word.
    """
    entry = F.concat(F.repeat(F.concat("short_name", F.lit(", ")), F.col("n").cast("int") - 1), "short_name")
    joined = short_config_names(config_rows).groupBy(REPO).agg(
        F.sort_array(F.collect_list(F.struct("short_name", entry.alias("entry")))).alias("_e"))
    return repositories.select(REPO).distinct().join(joined, REPO, "left").select(
        REPO, F.coalesce(F.array_join(F.col("_e.entry"), ", "), F.lit(fv.NO_CONFIGS)).alias("short_names"))


# ------------------------------------------------------------------ manifests
_KEYS = [REPO, "file_seq", "relative_path"]


def _first_framework(name: Column, table) -> Column:
    def first(known):
        out = F.lit(None).cast("string")
        for needle, label in reversed(list(table)):
            out = F.when(F.contains(known, F.lit(needle)), F.lit(label)).otherwise(out)
        return out

    return text.let(name, first)


# Each reader turns a manifest's text into an array of (dependency, framework), inside the file's row.
def _declared(dependency: Column, framework: Column) -> Column:
    return F.struct(dependency.alias("dependency"), framework.alias("framework"))


def _package_json(content: Column) -> Column:
    """``dependencies`` overlaid by ``devDependencies``; a repeated name keeps its last version."""
    parsed = F.from_json(content, "dependencies string, devDependencies string")

    def member(rank: int, name: str) -> Column:
        pairs = F.map_entries(F.from_json(parsed[name], "map<string,string>"))
        found = F.transform(pairs, lambda e, i: F.struct(
            e["key"].alias("name"), F.lit(rank).alias("member"), i.alias("at"), F.coalesce(e["value"], F.lit("None")).alias("version")))
        return F.coalesce(found, F.array().cast("array<struct<name:string,member:int,at:int,version:string>>"))

    # Sorted by name and place, the last one of a name stands before another name.
    last = text.let(F.array_sort(F.concat(member(0, "dependencies"), member(1, "devDependencies"))), lambda all_: F.filter(
        all_, lambda e, i: F.coalesce(F.get(all_, i + 1)["name"] != e["name"], F.lit(True))))
    return F.transform(last, lambda e: _declared(F.concat_ws("==", e["name"], e["version"]), text.lookup(e["name"], fv.NPM_FRAMEWORKS, None)))


def _requirements_txt(content: Column) -> Column:
    lines = F.transform(F.split(content, text.NEWLINE, -1), lambda l: text.strip(F.substring_index(l, "#", 1)))
    return F.transform(F.filter(lines, lambda l: l != ""), lambda l: _declared(l, _first_framework(F.lower(l), fv.PIP_FRAMEWORKS)))


def _unquote(col: Column) -> Column:
    """Blanks, then double quotes, then single quotes off both ends."""
    return F.trim(F.trim(text.strip(col), F.lit('"')), F.lit("'"))


def _pyproject_toml(content: Column) -> Column:
    """``key = value`` lines below a header that names dependencies or requires.

    The lines are cut into sections at every ``[`` line and only the wanted sections are kept.
    """
    def entry(line: Column) -> Column:
        version = lambda parts: _unquote(F.substring_index(parts[1], "#", 1))
        both = text.let(F.split(line, "=", -1), lambda parts: F.struct(_unquote(parts[0]).alias("name"), version(parts).alias("version")))
        return text.let(both, lambda b: _declared(F.concat(b["name"], F.lit("=="), b["version"]), _first_framework(F.lower(b["name"]), fv.POETRY_FRAMEWORKS)))

    def kept(lines: Column) -> Column:
        marks = F.transform(lines, lambda l, i: F.when(l.startswith("["), F.struct(
            i.alias("at"), (F.contains(l, F.lit("dependencies")) | F.contains(l, F.lit("requires"))).alias("wanted"))))
        return text.let(F.filter(marks, lambda h: h.isNotNull()), lambda heads: F.flatten(F.transform(
            F.filter(F.transform(heads, lambda h, j: F.struct(
                h["at"].alias("at"), h["wanted"].alias("wanted"), (F.coalesce(F.get(heads, j + 1)["at"], F.size(lines)) - h["at"] - 1).alias("length"))), lambda s: s["wanted"]),
            lambda s: F.slice(lines, s["at"] + 2, s["length"]))))

    lines = text.let(F.transform(text.split_lines(content), lambda l: text.strip(l)), kept)
    return F.transform(F.filter(lines, lambda l: F.contains(l, F.lit("=")) & ~l.startswith("#")), entry)


def _go_mod(content: Column) -> Column:
    lines = F.transform(F.split(content, text.NEWLINE, -1), lambda l: text.strip(l))

    def entry(line: Column) -> Column:
        at = F.when(line.startswith("require"), 1).otherwise(0)

        def declared(words):
            module, version = F.get(words, at), F.get(words, at + 1)
            return F.when(F.size(words) >= at + 2, _declared(F.concat(module, F.lit("=="), version), _first_framework(module, fv.GO_FRAMEWORKS)))

        return text.let(F.split(line, f"[{text.BLANK}]+", -1), declared)

    wanted = F.filter(lines, lambda l: l.startswith("require") | ~l.rlike(r"^(?:\)|module|go )"))
    return F.filter(F.transform(wanted, entry), lambda e: e.isNotNull())


def _pom_xml(content: Column) -> Column:
    def entry(block: Column) -> Column:
        tag = lambda t: text.strip(F.regexp_extract(block, f"<{t}>([^<]+)</{t}>", 1))
        version = F.when(block.rlike("<version>[^<]+</version>"), tag("version")).otherwise("latest")

        def declared(named):
            group, artifact = named["group"], named["artifact"]
            spring = F.contains(artifact, F.lit("spring-boot")) | F.contains(group, F.lit("spring-framework"))
            return F.when((group != "") & (artifact != ""), _declared(
                F.concat(group, F.lit(":"), artifact, F.lit("=="), version), F.when(spring, F.lit(fv.MAVEN_FRAMEWORK))))

        return text.let(F.struct(tag("groupId").alias("group"), tag("artifactId").alias("artifact")), declared)

    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)
    return F.filter(F.transform(blocks, entry), lambda e: e.isNotNull())


_READERS = {"package.json": _package_json, "requirements.txt": _requirements_txt, "pyproject.toml": _pyproject_toml, "go.mod": _go_mod, "pom.xml": _pom_xml}


def _read_manifests(files: DataFrame, names: list[str]) -> DataFrame:
    """One pass over the files: the kind of a manifest chooses its reader, the entries of all kinds are one array."""
    kind = F.lower("name")
    found = files.where(kind.isin(names))
    if "valid_utf8" in files.columns:  # text that was not UTF-8 is refused
        found = found.where(F.coalesce("valid_utf8", F.lit(True)))
    entries = reduce(lambda chosen, n: chosen.when(kind == n, _READERS[n](F.col("content"))), names[1:], F.when(kind == names[0], _READERS[names[0]](F.col("content"))))
    return text.explode_array(found, _KEYS, entries, "_e").select(*_KEYS, "_e.dependency", "_e.framework")


def package_json(files: DataFrame) -> DataFrame:
    return _read_manifests(files, ["package.json"])


def requirements_txt(files: DataFrame) -> DataFrame:
    return _read_manifests(files, ["requirements.txt"])


def pyproject_toml(files: DataFrame) -> DataFrame:
    return _read_manifests(files, ["pyproject.toml"])


def go_mod(files: DataFrame) -> DataFrame:
    return _read_manifests(files, ["go.mod"])


def pom_xml(files: DataFrame) -> DataFrame:
    return _read_manifests(files, ["pom.xml"])


def manifest_entries(files: DataFrame) -> DataFrame:
    """Every declared dependency of every manifest, the files read once."""
    return _read_manifests(files, list(_READERS))


def dependencies(entries: DataFrame) -> DataFrame:
    return entries.select(REPO, "dependency").distinct()


def frameworks(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct frameworks; a repository without any falls back on its file extensions. One aggregation: there are few frameworks."""
    none = F.lit(None)
    named = entries.where(F.col("framework").isNotNull()).select(REPO, "framework", none.cast("boolean").alias("py"), none.cast("boolean").alias("js"))
    present = files.select(REPO, none.cast("string").alias("framework"), (F.col("extension") == ".py").alias("py"), F.col("extension").isin(*fv.NODE_EXTENSIONS).alias("js"))
    seen = named.unionByName(present).groupBy(REPO).agg(F.collect_set("framework").alias("named"), F.bool_or("py").alias("py"), F.bool_or("js").alias("js"))
    fallback = F.filter(F.array(F.when(F.col("py"), fv.PYTHON_FALLBACK), F.when(F.col("js"), fv.NODE_FALLBACK)), lambda f: f.isNotNull())
    return text.explode_array(seen, [REPO], F.when(F.size("named") > 0, F.col("named")).otherwise(fallback), "framework").drop("_at")


def inventory_records(files: DataFrame, entries: DataFrame, config_rows: DataFrame) -> DataFrame:
    """What a report says of a repository, in one row: totals, languages, frameworks, dependencies and configs, each sorted.

    The arrays are as long as a repository's manifests make them; the rows they come from stay the tables to compute with.
    """
    languages = language_stats(files).groupBy(REPO).agg(F.sort_array(F.collect_list(F.struct("language", "files", "size"))).alias("languages"))
    named = frameworks(files, entries).withColumnsRenamed({"framework": "value"}).withColumn("kind", F.lit("frameworks")).unionByName(
        dependencies(entries).withColumnsRenamed({"dependency": "value"}).withColumn("kind", F.lit("dependencies"))).unionByName(
        config_rows.select(REPO, F.col("config").alias("value"), F.lit("configs").alias("kind")))
    kinds = ("frameworks", "dependencies", "configs")
    sets = named.groupBy(REPO).agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds])
    empty = F.array().cast("array<string>")
    return repository_totals(files).join(languages, REPO, "left").join(sets, REPO, "left").withColumns({k: F.coalesce(k, empty) for k in kinds})
