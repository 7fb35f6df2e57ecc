"""Known embedding models and their files."""

from __future__ import annotations

import shutil
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodevec.errors import ModelNotFoundError, ValidationError


@dataclass(frozen=True)
class ModelInfo:
    id: str
    dimensions: int
    max_tokens: int
    description: str = ""
    size: str = ""
    prefixes: dict = field(default_factory=dict)


_PASSAGES = "Represent this sentence for searching relevant passages: "
REGISTRY: dict[str, ModelInfo] = {
    m.id: m
    for m in (
        ModelInfo("Xenova/all-MiniLM-L6-v2", 384, 256, "small, general English", "22M"),
        ModelInfo("Xenova/all-MiniLM-L12-v2", 384, 256, "general English", "33M"),
        ModelInfo("Xenova/bge-small-en-v1.5", 384, 512, "small, English retrieval", "33M", {"document": "", "query": _PASSAGES}),
        ModelInfo("Xenova/bge-base-en-v1.5", 768, 512, "middle-sized, English retrieval", "109M", {"document": "", "query": _PASSAGES}),
        ModelInfo("Xenova/all-mpnet-base-v2", 768, 384, "exact, general English", "109M"),
        ModelInfo("Xenova/multilingual-MiniLM-L12-v2", 384, 512, "over fifty languages", "33M"),
        ModelInfo("nomic-ai/nomic-embed-text-v1.5", 768, 8192, "long texts, dimensions may be cut", "137M", {"document": "search_document: ", "query": "search_query: "}),
        ModelInfo("Xenova/distilroberta-base", 768, 512, "general, distilled", "82M"),
    )
}
_USES = {"speed": "Xenova/all-MiniLM-L6-v2", "balanced": "Xenova/all-mpnet-base-v2", "quality": "Xenova/all-mpnet-base-v2", "multilingual": "Xenova/multilingual-MiniLM-L12-v2"}


def model_info(model: str) -> ModelInfo:
    if model not in REGISTRY:
        raise ModelNotFoundError(f"unknown model {model!r}")
    return REGISTRY[model]


def register_model(info: ModelInfo, overwrite: bool = False) -> None:
    if not info.id or not info.id.strip():
        raise ValidationError("a model needs an id")
    if isinstance(info.dimensions, bool) or not isinstance(info.dimensions, int) or info.dimensions < 1:
        raise ValidationError("dimensions must be a positive integer")
    if info.id in REGISTRY and not overwrite:
        raise ValidationError(f"{info.id!r} is registered already")
    REGISTRY[info.id] = info


def recommended_model(use: str) -> ModelInfo:
    if use not in _USES:
        raise ValidationError(f"unknown use {use!r}; known are {', '.join(_USES)}")
    return REGISTRY[_USES[use]]


def tokenizer_info(model: str) -> dict | None:
    found = REGISTRY.get(model)
    return None if found is None else {"model_id": found.id, "max_tokens": found.max_tokens}


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as a table: id, dimensions, max_tokens, description, size, prefixes."""
    rows = [tuple(asdict(m).values()) for _, m in sorted(REGISTRY.items())]
    return spark.createDataFrame(rows, "id string, dimensions int, max_tokens int, description string, size string, prefixes map<string,string>")


_folder = Path.home() / ".cache" / "huggingface" / "hub"


def set_model_path(path: str | Path) -> None:
    global _folder
    _folder = Path(path)


def _place(model: str) -> Path:
    if ".." in model:
        raise ValidationError("a model's id can't lead out of the folder")
    return _folder / f"models--{model.replace('/', '--', 1)}"


def list_models() -> list[ModelInfo]:
    """The models with files; unknown ones have 0 dimensions."""
    if not _folder.is_dir():
        return []
    names = [p.name.removeprefix("models--").replace("--", "/", 1) for p in sorted(_folder.iterdir()) if p.is_dir() and p.name.startswith("models--")]
    return [REGISTRY.get(n, ModelInfo(n, 0, 0)) for n in names]


def delete_model(model: str) -> bool:
    if not (place := _place(model)).is_dir():
        return False
    shutil.rmtree(place)
    return True


def download_model(model: str, fetch) -> Path:
    """Has ``fetch(model, folder)`` bring a model's files; there is no network transport of its own here."""
    place = _place(model)
    place.mkdir(parents=True, exist_ok=True)
    fetch(model, place)
    return place
