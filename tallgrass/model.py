"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "repo string, path string, source string, commit_hash string"
CHANGES = "path string, status string, old_path string"
CHUNKS = (
    "repo string, file_path string, text string, start_line int, end_line int, chunk_index int, "
    "total_chunks int, language string, symbol_name string, symbol_type string, commit_hash string, "
    "kind string, memory_type string, memory_id string, title string, when_relevant string, "
    "evidence array<string>, last_verified string"
)
POINTS = "point_id string, " + CHUNKS + ", dense array<float>, sparse struct<indices:array<bigint>,values:array<double>>"
RANGES = "start_line int, end_line int, symbol_name string, symbol_type string"
REPO_STATE = "repo string, last_commit string, last_indexed timestamp, total_chunks bigint"
TELEMETRY = (
    "ts timestamp, collection string, repo string, query string, type string, via_id boolean, "
    "id_hits array<string>, hits array<struct<id:string,type:string,score:double>>"
)
HOOKS = "call_id string, phase string, tool string, command string, output string, ts timestamp"

CHUNK_COLUMNS = [part.strip().split(" ")[0] for part in CHUNKS.split(", ")]

#: Memory types that a search may ask for; ``note`` is stored but can't be asked for.
SEARCHABLE_MEMORY_TYPES = ("architecture", "convention", "pitfall", "decision", "workflow", "learning", "skill")


@dataclass(frozen=True)
class SearchFilters:
    """Equality filters and the exclusion of memory, applied inside each branch of a search."""

    repo: str | None = None
    kind: str | None = None
    memory_type: str | None = None
    exclude_memory: bool = False

    def condition(self) -> Column:
        """The conjunction as a column. The exclusion is null-safe: a missing kind means code."""
        parts = [F.col(c) == F.lit(v) for c, v in (("repo", self.repo), ("kind", self.kind), ("memory_type", self.memory_type)) if v]
        if self.exclude_memory:
            parts.append(~F.col("kind").eqNullSafe(F.lit("memory")))
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out


@dataclass
class RuntimeConfig:
    """Where the repositories are and what is left out."""

    workspace_root: str = "."
    collection_name: str = "code_chunks"
    repo_paths: dict[str, str] = field(default_factory=dict)
    exclude_patterns: list[str] = field(default_factory=list)
