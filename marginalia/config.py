"""Run settings, validated on the driver before any job starts."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re
from pathlib import Path

METHODS = ("uniform", "clip_topk", "aks", "evidence", "uniform_refine")


@dataclasses.dataclass(frozen=True)
class Config:
    """One run's settings; ``notes`` is no part of its identity. Defaults are fixed values of the protocol."""

    backend: str = "molmo2"
    dtype: str = "auto"
    model_id: str = "allenai/Molmo2-4B"
    revision: str = "042abfa7a38879a376cec03d949eff0aefaa0600"
    method: str = "uniform"
    frames: int = 16
    initial_frames: int = 8
    candidate_frames: int = 64
    margin_threshold: float = 0.15
    neighbor_seconds: float = 1.0
    relevance_weight: float = 0.25
    max_input_tokens: int = 12000
    max_image_pixels: int = 200704
    clip_id: str = "openai/clip-vit-base-patch32"
    clip_revision: str = "3d74acf9a28c67741b2f4f2ea7635f0aaf6f0268"
    clip_device: str = "cpu"
    clip_batch_size: int = 16
    seed: int = 18
    limit: int = 200
    aks_t1: float = 0.8
    aks_t2: float = -100.0
    aks_depth: int = 5
    prompt_version: str = "letter-score-v1"
    notes: str = dataclasses.field(default="", compare=False)

    def __post_init__(self) -> None:
        if broken := self.violations():
            raise ValueError("; ".join(broken))

    def violations(self) -> list[str]:
        """All broken rules, in words."""
        whole = {f: getattr(self, f) for f in ("frames", "initial_frames", "candidate_frames", "max_input_tokens", "max_image_pixels", "clip_batch_size", "aks_depth")}
        numbers = [v for v in dataclasses.asdict(self).values() if isinstance(v, float)]
        pinned = re.compile(r"[a-f0-9]{40}")
        rules = [
            (self.backend in ("molmo2", "qwen", "mock"), "unknown backend"),
            (self.dtype in ("auto", "bfloat16", "float16"), "unknown dtype"),
            (self.method in METHODS, "unknown method"),
            (self.clip_device in ("cpu", "cuda"), "unknown clip_device"),
            (self.prompt_version == "letter-score-v1", "unknown prompt_version"),
            (all(type(v) is int and v > 0 for v in whole.values()), "sizes must be positive whole numbers"),
            (all(math.isfinite(v) for v in numbers), "numbers must be finite"),
            (type(self.limit) is int and type(self.seed) is int and self.limit >= 0, "limit must be a whole number of 0 or more, seed a whole number"),
            (self.backend == "mock" or bool(pinned.fullmatch(self.revision)), "revision must be a full commit hash"),
            (bool(pinned.fullmatch(self.clip_revision)), "clip_revision must be a full commit hash"),
        ]
        if all(ok for ok, _ in rules):
            rules += [
                (self.initial_frames <= self.frames <= self.candidate_frames, "need initial_frames <= frames <= candidate_frames"),
                (0 <= self.margin_threshold <= 1, "margin_threshold must lie in [0, 1]"),
                (self.neighbor_seconds > 0, "neighbor_seconds must be positive"),
                (0 <= self.relevance_weight <= 1, "relevance_weight must lie in [0, 1]"),
            ]
        return [text for ok, text in rules if not ok]

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(**json.loads(Path(path).read_text(encoding="utf-8-sig")))

    def contract(self) -> dict:
        """The settings that identify a run."""
        return {k: v for k, v in dataclasses.asdict(self).items() if k != "notes"}


def preset(name: str) -> Config:
    """The protocol's standard points of method and budget."""
    points = {
        "mock": {"backend": "mock", "method": "evidence", "margin_threshold": 1.0, "limit": 0},
        "uniform8": {"frames": 8},
        "uniform16": {},
        "uniform32": {"frames": 32},
        "topk16": {"method": "clip_topk"},
        "segments16": {"method": "aks", "aks_depth": 4},
        "refine16": {"method": "uniform_refine"},
        "evidence16": {"method": "evidence"},
        "qwen16": {"backend": "qwen", "model_id": "Qwen/Qwen2.5-VL-7B-Instruct", "revision": "cc594898137f460bfe9f0759e9844b3ce807cfb5"},
    }
    return Config(**points[name])


def fingerprint() -> str:
    """Digest of the package's own modules, by relative path."""
    root = Path(__file__).resolve().parent
    total = hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        if "llm" not in path.relative_to(root).parts:
            total.update(f"{path.relative_to(root).as_posix()}\0{hashlib.sha256(path.read_bytes()).hexdigest()}\n".encode())
    return total.hexdigest()
