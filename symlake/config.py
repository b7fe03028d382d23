"""Settings of an index, from defaults, YAML or dicts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .functions.exprs import EXCLUDED_DIRS
from .operators.enrich import ModelSettings
from .sources.trees import INCLUDE


@dataclass(frozen=True)
class EmbeddingSettings:
    provider: str = "hash"
    model: str = ""
    dimensions: int = 384
    batch_size: int = 32


@dataclass(frozen=True)
class Settings:
    index_path: str = ".symlake/index"
    collection: str = "chunks"
    embeddings: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    llm: ModelSettings = field(default_factory=ModelSettings)
    include_globs: tuple[str, ...] = INCLUDE
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS
    on_error: str = "fail"
    vectors: bool = True

    @classmethod
    def of(cls, values: dict | None) -> Settings:
        """From a dict; older flat names of the embedding's settings are understood, unknown names are left out."""
        v = dict(values or {})
        emb = dict(v.pop("embeddings", None) or {})
        for old, new in (("embedding_dimension", "dimensions"), ("embedding_model", "model"), ("embedding_provider", "provider")):
            if old in v:
                emb.setdefault(new, v.pop(old))
        pick = lambda kind, d: {f.name: d[f.name] for f in fields(kind) if f.name in d}
        own = {k: tuple(x) if isinstance(x, list) else x for k, x in pick(cls, v).items() if k not in ("embeddings", "llm")}
        return cls(**own, embeddings=EmbeddingSettings(**pick(EmbeddingSettings, emb)), llm=ModelSettings(**pick(ModelSettings, dict(v.get("llm") or {}))))

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f) or {})

    def with_overrides(self, **changes) -> Settings:
        """Copies with values that aren't None in place; names with a dot reach into embeddings and llm."""
        out = self
        for k, x in changes.items():
            if x is None:
                continue
            head, _, tail = k.partition(".")
            out = replace(out, **{head: replace(getattr(out, head), **{tail: x}) if tail else x})
        return out

    def for_bug(self, bug: str) -> Settings:
        """Settings of one bug's index: a folder of its own, and a collection of its own where vectors are indexed."""
        return replace(self, index_path=f"{self.index_path}/{bug}", collection=f"{self.collection}_{bug}" if self.vectors else self.collection)
