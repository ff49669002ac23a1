"""Rule-driven cleaning of dirty tables on Spark."""

from tidyloom.plans.clean import CleanResult, clean
from tidyloom.plans.files import export_file, export_with_stats, preview_file
from tidyloom.plans.preview import clip, preview, preview_document
from tidyloom.plans.stats import nothing_matched, shrink_rate
from tidyloom.rules import CleaningRules, default_document
from tidyloom.session import build_session, fit_shuffles, release_cuts
from tidyloom.sources.batch import Batch, by_source, clean_many, sources_in
from tidyloom.sources.generator import dirty_table
from tidyloom.sources.readers import load
from tidyloom.sources.records import record_account
from tidyloom.sources.writers import cleaned_name, write

__all__ = [
    "Batch",
    "CleanResult",
    "CleaningRules",
    "build_session",
    "by_source",
    "clean",
    "clean_many",
    "cleaned_name",
    "clip",
    "default_document",
    "dirty_table",
    "export_file",
    "export_with_stats",
    "fit_shuffles",
    "load",
    "nothing_matched",
    "preview",
    "preview_document",
    "preview_file",
    "record_account",
    "release_cuts",
    "shrink_rate",
    "sources_in",
    "write",
]
