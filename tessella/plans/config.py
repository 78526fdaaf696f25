"""Settings of the retrieval pipeline, with their defaults."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class RetrievalConfig:
    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 50
    embedding_dim: int = 384
    top_k: int = 5
    similarity_threshold: float = 0.25
    expansion_mode: str = "full"
    max_variants: int = 3
    reranking: bool = True
    fusion: str = "rrf"
    dense_weight: float = 0.7
    index: str = "flat"
    n_cells: int = 100
    n_probe: int = 10
    keep_sections: bool = True
    model: str = "hashing"
    cache: str = "none"
    cache_path: str = ""

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be between 1 and 50")
        if self.fusion not in ("rrf", "linear") or self.index not in ("flat", "ivf"):
            raise ValueError("unknown fusion or index")
        if self.cache != "none" and not self.cache_path:
            raise ValueError("a cache needs a cache_path")

    @classmethod
    def of(cls, settings: dict) -> RetrievalConfig:
        """From a flat dict; unknown names are errors."""
        if unknown := set(settings) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**settings)

    @classmethod
    def read(cls, path: str) -> RetrievalConfig:
        """From a file of settings as YAML writes them: names of this class, or sections of the names in NESTED; without the file, the defaults.

        In a section, names that mean nothing here (log formats, for example) are logged and left out; elsewhere an unknown name is an error."""
        if not os.path.exists(path):
            return cls()
        settings, left_out = {}, []
        with open(path, encoding="utf-8") as file:
            for section, name, value in _lines(file):
                field = NESTED.get((section, name), name if name in _KINDS else None)
                if field is None and section is None:
                    raise ValueError(f"unknown settings: ['{name}']")
                if field is None:
                    left_out.append(f"{section}.{name}")
                else:
                    settings[field] = _typed(field, value)
        if left_out:
            logging.getLogger(__name__).warning("settings without a meaning here: %s", ", ".join(left_out))
        home = settings.pop("home", "")
        if settings.get("cache", "none") != "none" and not settings.get("cache_path"):
            settings["cache_path"] = f"{home}/embeddings" if home else ""
            settings["cache"] = settings["cache"] if home else "none"
        return cls.of(settings)

    def summary(self) -> dict[str, object]:
        """All settings, as a report states them."""
        return asdict(self)


#: Settings by section and name; home is the folder for what is kept.
NESTED = {
    ("embedding", "model"): "model", ("embedding", "dimension"): "embedding_dim", ("embedding", "cache_backend"): "cache",
    ("retrieval", "semantic_threshold"): "similarity_threshold", ("vector_store", "index_type"): "index", ("vector_store", "persist_path"): "home",
    ("query_expansion", "expansion_type"): "expansion_mode", ("reranking", "enabled"): "reranking", ("hybrid_search", "method"): "fusion",
}
NESTED |= {(section, name): name for section, names in (("chunking", ("chunk_size", "chunk_overlap", "min_chunk_size")), ("retrieval", ("top_k",)), ("query_expansion", ("max_variants",)), ("hybrid_search", ("dense_weight",))) for name in names}
#: Names of indexes as settings files write them.
INDEXES = {"flat_ip": "flat", "flat_l2": "flat", "ivf_flat": "ivf"}
_KINDS = {f.name: f.type for f in fields(RetrievalConfig)}


def _lines(file) -> Iterator[tuple[str | None, str, str]]:
    """section, name, value of the lines "name: value"; a name without a value begins a section, which holds the deeper lines. Items of lists are skipped."""
    section, depth = None, 0
    for line in file:
        bare = line.split(" #")[0].rstrip()
        name, colon, value = bare.strip().partition(":")
        if not colon or name.startswith(("#", "-")):
            continue
        indent = len(bare) - len(bare.lstrip())
        value = value.strip().strip("\"'")
        if indent <= depth:
            section = None
        if not value:
            section, depth = (name, indent) if section is None else (section, depth)
        else:
            yield section if indent > depth else None, name, value


def _typed(field: str, value: str):
    value = INDEXES.get(value, value) if field == "index" else value
    return {"int": int, "float": float, "bool": lambda v: v.lower() in ("true", "yes", "on", "1")}.get(_KINDS.get(field, "str"), str)(value)
