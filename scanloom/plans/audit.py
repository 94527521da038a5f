"""The whole scan over many repositories: files to findings, scores and history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.operators import chunking, dependencies, findings as fnd, history, inventory, packing, review, rules, scoring
from scanloom.session import cut_lineage


@dataclass
class Audit:
    """Tables of one run; every one is keyed by repository (= scan)."""

    files: DataFrame
    languages: DataFrame
    dependencies: DataFrame
    frameworks: DataFrame
    findings: DataFrame
    scores: DataFrame
    #: Calls in which the scorer failed; None if there was no scorer.
    failed: DataFrame | None = None
    #: Distinct (repository, dependency, framework) of all manifests; None: not stored, ``reports`` reads the manifests.
    entries: DataFrame | None = None


def review_packs(files: DataFrame, limit: int = fv.REVIEW_LIMIT) -> DataFrame:
    """The packs a model would be shown: chunk, pack, rank, drop the trivial ones, render prompts."""
    packs = packing.pack_files(chunking.chunk_arrays(packing.review_targets(files)))
    return review.with_prompt(review.reviewable(packing.top_packs(packs, limit)))


def audit(files: DataFrame, scanners: list[Callable[[DataFrame], DataFrame]] | None = None,
          scorer: Callable[..., str] | None = None, system: str | None = None, pack_limit: int = fv.REVIEW_LIMIT) -> Audit:
    """Run all scanners over ``files`` (a stored table: it is read once per branch).

    ``scorer`` reviews up to ``pack_limit`` packs a repository; with ``system`` it is called as ``scorer(system, prompt)``
    (``review.SYSTEM_PROMPT`` asks for the form that is understood).

    The distinct manifest entries and the correlated findings are cut from their lineage because everything after reads them.
    """
    entries = cut_lineage(inventory.manifest_entries(files).select("repository_name", "dependency", "framework").distinct())
    declared = inventory.dependencies(entries)
    parts = [fnd.in_order(scan(files), i) for i, scan in enumerate(scanners or [rules.scan_files])]
    parts.append(dependencies.dependency_findings(declared, files))
    notes = failed = None
    if scorer is not None:
        responses = cut_lineage(review.call_scorer(review_packs(files, pack_limit), scorer, system=system))
        parts.append(review.parse_responses(responses))
        notes, failed = review.skip_notes(responses), review.failed_calls(responses)
    correlated = cut_lineage(fnd.correlate(fnd.union_findings(*parts), files))
    scans = files.select(F.col("repository_name").alias("scan_id")).distinct()
    scores = scoring.score_scans(correlated, scans)
    if notes is not None:
        scores = scoring.add_notes(scores, notes)
    return Audit(files, inventory.language_stats(files), declared, inventory.frameworks(files, entries), correlated, scores, failed, entries)


def reports(run: Audit, scans: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Report heads. ``scans(scan_id, repository_name, repository_url, timestamp, scan_duration_sec)``.

    ``listing`` is the unfiltered listing of the trees, for the CI workflows; without it the files stand for it.
    """
    entries = inventory.manifest_entries(run.files) if run.entries is None else run.entries
    configs = inventory.configs(run.files, run.files if listing is None else listing)
    known = inventory.inventory_records(run.files, entries, configs).withColumnRenamed("repository_name", "scan_id")
    record = scoring.as_record(run.scores)
    return scans.join(record, "scan_id").join(known, "scan_id", "left").select(
        "scan_id", "repository_name", "repository_url", "timestamp", F.lit("completed").alias("status"),
        F.struct("overall_score", "severity_breakdown", "category_scores", "risk_summary").alias("score"),
        "total_files", "total_size", "scan_duration_sec", "languages", "frameworks", "dependencies", "configs")


def record_history(scans: DataFrame, run_findings: DataFrame) -> DataFrame:
    return history.history_entries(scans, run_findings)
