"""Settings of a run: arguments over environment over a file over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from skein.operators.gates import LIMITS, MAX_GROWTH
from skein.operators.splits import TRAIN, VAL


@dataclass(frozen=True)
class Settings:
    """Values of the driver; nothing here is data."""

    optimizer_model: str = "offline"
    eval_model: str = "offline"
    judge_model: str = "offline"
    api_base: str = ""
    api_key: str = ""
    iterations: int = 10
    max_skill_size: int = LIMITS["skill"]
    max_tool_desc_size: int = LIMITS["tool_description"]
    max_param_desc_size: int = LIMITS["param_description"]
    max_prompt_growth: float = MAX_GROWTH
    eval_dataset_size: int = 20
    train_ratio: float = TRAIN
    val_ratio: float = VAL

    @property
    def service(self) -> dict[str, str]:
        """Arguments of the model service; only what is set."""
        return {k: v for k, v in (("api_base", self.api_base), ("api_key", self.api_key)) if v}


def load_settings(path: str | None = None, **given) -> Settings:
    """Defaults, then the file's (`models:` with optimizer, eval, judge; api_base; api_key), then SKEIN_API_BASE,
    SKEIN_API_KEY and SKEIN_MODEL (all three models), then arguments (model: all three). Empty and zero values are passed over."""
    out = Settings()
    file = Path(path or "skein.yaml")
    if file.exists():
        import yaml  # only needed where a file is used

        data = yaml.safe_load(file.read_text()) or {}
        models = data.get("models") or {}
        out = _with(out, {f"{k}_model": models.get(k) for k in ("optimizer", "eval", "judge")} | {k: data.get(k) for k in ("api_base", "api_key")})
    out = _with(out, {k: os.getenv(f"SKEIN_{k.upper()}") for k in ("api_base", "api_key", "model")})
    return _with(out, given)


def _with(base: Settings, values: dict) -> Settings:
    if values.get("model"):
        values = {f"{k}_model": values["model"] for k in ("optimizer", "eval", "judge")} | values
    known = {f.name for f in fields(Settings)}
    return replace(base, **{k: v for k, v in values.items() if k in known and v})
