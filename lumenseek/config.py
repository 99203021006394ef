"""Settings with their defaults, from TOML files."""

from __future__ import annotations

import shutil
import tomllib
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.skipping import SUPPORTED
from .operators.vector_index import index_kind


@dataclass(frozen=True)
class Settings:
    """Ingestion and retrieval settings. Names in a file are these in upper or lower case; tables of the file
    are flattened, later ones win."""

    # Names and defaults of the settings.
    embed_model: str = "hashing"
    batch_size: int = 16
    batch_size_retry_divisor: int = 4
    index_type: str = "flat"
    nlist: int = 1024
    nprobe: int = 16
    base_dpi: int = 150
    skip_files: tuple[str, ...] = ()
    extensions: tuple[str, ...] = SUPPORTED
    max_file_mb: float = 200.0
    max_pdf_pages: int = 200
    skip_form_pdfs: bool = True
    chunk_size: int = 1600
    chunk_overlap: int = 200
    enable_semantic_chunking: bool = True
    default_top_k: int = 7
    enable_query_expansion: bool = True
    query_expansion_count: int = 3
    enable_reranking: bool = True
    rerank_top_k: int = 20
    enable_hybrid_search: bool = True
    hybrid_alpha: float = 0.7
    request_timeout: int = 180
    temperature: float = 0.1
    top_p: float = 0.9
    max_tokens: int = 500
    expansion_timeout: int = 30
    expansion_temperature: float = 0.7
    expansion_top_p: float = 0.9
    expansion_max_tokens: int = 150
    model_calls: int = 4
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "index_type", index_kind(self.index_type))
        for name in ("batch_size", "nlist", "nprobe", "base_dpi", "default_top_k", "query_expansion_count", "rerank_top_k", "request_timeout", "max_tokens", "batch_size_retry_divisor", "expansion_timeout", "expansion_max_tokens", "model_calls"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name, most in (("hybrid_alpha", 1.0), ("top_p", 1.0), ("temperature", 2.0), ("expansion_top_p", 1.0), ("expansion_temperature", 2.0)):
            if not 0 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be between 0 and {most}")
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be positive and chunk_overlap not negative")

    def top_k(self, k: int | None) -> int:
        """0 and None mean the default."""
        return k or self.default_top_k


#: Other names that files use.
_ALIASES = {"semantic_chunk_max_size": "chunk_size", "semantic_chunk_overlap": "chunk_overlap"}


def load_settings(path: str | Path, sample: str | Path | None = None) -> Settings:
    """Settings of a TOML file. A missing file is first made from ``sample`` if that exists; else defaults hold."""
    path = Path(path)
    if not path.exists() and sample and Path(sample).exists():
        shutil.copyfile(sample, path)
    if not path.exists():
        if sample:
            warnings.warn(f"neither {path} nor {sample} exists; defaults hold", stacklevel=2)
        return Settings()
    flat: dict = {}
    for key, value in tomllib.loads(path.read_text(encoding="utf-8")).items():
        flat |= value if isinstance(value, dict) else {key: value}
    known = {f.name for f in fields(Settings)}
    given, extra = {}, {}
    for key, value in flat.items():
        name = _ALIASES.get(key.lower(), key.lower())
        (given if name in known else extra)[name] = tuple(value) if isinstance(value, list) else value
    return Settings(**given, extra=extra)


#: Suffixes of model files. Fixed values.
MODEL_SUFFIXES = (".bin", ".pt", ".onnx", ".gguf", ".json")


def looks_like_path(value: str) -> bool:
    """Whether a model's name is a local path."""
    drive = len(value) > 2 and value[0].isalpha() and value[1] == ":" and value[2] in "\\/"
    return drive or "\\" in value or value.startswith(("/", "~", "./", "../")) or Path(value).suffix.lower() in MODEL_SUFFIXES
