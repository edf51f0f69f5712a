"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.sources.model import CATEGORIES, NOW


# What names a row's category where the sidecar has none.
NAMED_KIND = r"(?i)(?:^|\n)Category:[ \t\n\r\f\x0B]*([a-z_]+)"
DAY_FILE = r"^memory/\d{4}-\d{2}-\d{2}\.md$"
KIND_FOLDERS = {"memory/projects/": "project", "memory/dreaming/": "dreaming", "memory/episodes/": "episodic", "memory/generated-smart-add/": "generated", "memory/smart-add/": "raw_log"}
KINDS = [*CATEGORIES, "core_profile", "project", "daily_journal", "dreaming", "stats", "external"]


def rounded(x: Column, digits: int = 4) -> Column:
    """Half goes up, below zero too."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, rounded(part / whole)).otherwise(F.lit(0.0))


def tau(hits: Column, base: Column) -> Column:
    """The decay time in days: it grows with hits towards a year."""
    return F.when(base >= 365.0, base).otherwise(base + (365.0 - base) * (1 - F.exp(-0.3 * hits)))


def realtime_confidence(now: int = NOW) -> Column:
    """Confidence decayed to now; protected rows and rows without a time keep theirs."""
    c, at = F.col("confidence"), F.col("last_confidence_update")
    decayed = c * F.exp(-((F.lit(now) - at) / 86400.0) / tau(F.col("hit_count"), F.col("base_tau")))
    decayed = F.greatest(F.lit(0.0), decayed - F.when(F.col("conflict_flag") == 1, 0.5).otherwise(0.0))
    return F.when((F.col("is_protected") == 1) | F.coalesce(at, F.lit(0)).eqNullSafe(0), c).otherwise(decayed)


def scope_family(path: Column) -> Column:
    """The family of a path; the order of the tests matters."""
    return (
        F.when(path == "MEMORY.md", "curated_memory").when(path == "memory/stats-history.md", "stats_history").when(path.startswith("memory/generated-smart-add/"), "generated_smart_add")
        .when(path.startswith("memory/legacy-daily-mirrors/"), "quarantined_daily_mirror").when(path.startswith("memory/smart-add/"), "smart_add").when(path.startswith("memory/dreaming/"), "dreaming")
        .when(path.startswith("memory/episodes/"), "episode").when(path.startswith("memory/projects/"), "project").when(path.startswith("memory/raw_log/"), "raw_log")
        .when(path.rlike(r"^memory/\d{4}-\d{2}-\d{2}[^/]*\.md$"), "daily_memory").when(path.startswith("memory/"), "unknown").otherwise("non_memory")
    )


def kind_of(category: Column, path: Column, text: Column, external: Column) -> Column:
    """A row's category in lower case; without one, a known one that its text names on a line of its own, else that of its path.

    Paths that say nothing give external rows `external` and managed ones `raw_log`.
    """
    named = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), NAMED_KIND, 1))
    low = F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\.?/", ""))
    placed = F.when(low == "memory.md", "core_profile").when(low.rlike(DAY_FILE), "daily_journal").when(low == "memory/stats-history.md", "stats")
    for start, kind in KIND_FOLDERS.items():
        placed = placed.when(low.startswith(start), kind)
    return F.coalesce(F.when(category != "", F.lower(category)), F.when(named.isin(KINDS), named), placed, F.when(external, "external").otherwise("raw_log"))


def plain(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case: what duplicates are compared by."""
    # Single spaces, as most are, stay as they are.
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\x0B\f]{2,}|[\t\n\r\x0B\f]", " ")))


FAMILY_SQL = """CASE WHEN path = 'MEMORY.md' THEN 'curated_memory' WHEN path = 'memory/stats-history.md' THEN 'stats_history' WHEN starts_with(path, 'memory/generated-smart-add/') THEN 'generated_smart_add'
    WHEN starts_with(path, 'memory/legacy-daily-mirrors/') THEN 'quarantined_daily_mirror' WHEN starts_with(path, 'memory/smart-add/') THEN 'smart_add' WHEN starts_with(path, 'memory/dreaming/') THEN 'dreaming'
    WHEN starts_with(path, 'memory/episodes/') THEN 'episode' WHEN starts_with(path, 'memory/projects/') THEN 'project' WHEN starts_with(path, 'memory/raw_log/') THEN 'raw_log'
    WHEN regexp_matches(path, '^memory/\\d{4}-\\d{2}-\\d{2}[^/]*\\.md$') THEN 'daily_memory' WHEN starts_with(path, 'memory/') THEN 'unknown' ELSE 'non_memory' END"""
TAU_SQL = "CASE WHEN base_tau >= 365 THEN base_tau ELSE base_tau + (365 - base_tau) * (1 - exp(-0.3::DOUBLE * hit_count)) END"
REALTIME_SQL = f"""CASE WHEN is_protected = 1 OR coalesce(last_confidence_update, 0) = 0 THEN confidence
    ELSE greatest(0, confidence * exp(-(({NOW} - last_confidence_update) / 86400.0::DOUBLE) / ({TAU_SQL})) - CASE WHEN conflict_flag = 1 THEN 0.5::DOUBLE ELSE 0 END) END"""
PLAIN_SQL = "lower(trim(regexp_replace({}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')))"


def rounded_sql(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


_LOW_SQL = "lower(regexp_replace(replace(path, '\\', '/'), '^\\.?/', ''))"
_FOLDERS_SQL = " ".join(f"WHEN starts_with({_LOW_SQL}, '{start}') THEN '{kind}'" for start, kind in KIND_FOLDERS.items())
_NAMED_SQL = f"lower(regexp_extract(coalesce(text, ''), '{NAMED_KIND}', 1))"
_KINDS_SQL = "', '".join(KINDS)
#: kind_of for DuckDB, over category, path, text and the sidecar c.
KIND_SQL = f"""coalesce(CASE WHEN category <> '' THEN lower(category) END, CASE WHEN {_NAMED_SQL} IN ('{_KINDS_SQL}') THEN {_NAMED_SQL} END,
    CASE WHEN {_LOW_SQL} = 'memory.md' THEN 'core_profile' WHEN regexp_matches({_LOW_SQL}, '{DAY_FILE}') THEN 'daily_journal' WHEN {_LOW_SQL} = 'memory/stats-history.md' THEN 'stats' {_FOLDERS_SQL} END,
    CASE WHEN c.chunk_id IS NULL THEN 'external' ELSE 'raw_log' END)"""
