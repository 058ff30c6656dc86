"""The metadata record that a model file carries, and its JSON form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime

#: Key of the record among a model's metadata entries; readers may pass another one.
METADATA_KEY = "quillmere"
FORMAT = 1
TASKS = ("classification", "regression")
#: Spark schema of the record, for ``from_json`` over a folder of models.
JSON_SCHEMA = (
    "format INT, task STRING, features ARRAY<STRING>, target STRING, classes ARRAY<STRING>, extractorVersion STRING, "
    "trainer STRUCT<name: STRING, version: STRING, modelType: STRING>, trained STRING, "
    "data STRUCT<rows: INT, groups: INT, holdoutGroups: ARRAY<STRING>>, score MAP<STRING, DOUBLE>"
)


class InvalidModelData(ValueError):
    """A model file or its record that cannot be used."""


@dataclass(frozen=True)
class Trainer:
    name: str
    version: str | None = None
    model_type: str | None = None


@dataclass(frozen=True)
class DataInfo:
    rows: int
    groups: int
    holdout_groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class ModelMetadata:
    task: str
    features: tuple[str, ...]
    target: str
    classes: tuple[str, ...] = ()
    extractor_version: str | None = None
    trainer: Trainer | None = None
    trained: datetime | None = None
    data: DataInfo | None = None
    score: dict[str, float] = field(default_factory=dict)
    format: int = FORMAT

    def validate(self) -> ModelMetadata:
        """Refuse a record that contradicts itself; returns it otherwise."""

        def need(ok: bool, text: str) -> None:
            if not ok:
                raise InvalidModelData(text)

        need(self.format == FORMAT, f"record format {self.format} is not supported")
        need(self.task in TASKS, f"unknown task {self.task!r}")
        need(len(self.features) > 0, "a model needs at least one feature")
        need(all(f and f.strip() for f in self.features), "feature names must not be blank")
        need(len({f.casefold() for f in self.features}) == len(self.features), "feature names must differ, whatever their case")
        need(bool(self.target and self.target.strip()), "a model needs a target")
        if self.task == "classification":
            need(len(self.classes) >= 2, "a classifier needs at least two classes")
            need(len(set(self.classes)) == len(self.classes), "class names must differ")
        else:
            need(not self.classes, "a regressor has no classes")
        if self.data is not None:
            need(self.data.rows > 0 and self.data.groups > 0, "the record must count its rows and groups")
        return self

    def to_json(self) -> str:
        """Camel-case keys; absent values are left out."""
        out = {"format": self.format, "task": self.task, "features": list(self.features), "target": self.target}
        if self.classes:
            out["classes"] = list(self.classes)
        if self.extractor_version is not None:
            out["extractorVersion"] = self.extractor_version
        if self.trainer is not None:
            out["trainer"] = {k: v for k, v in (("name", self.trainer.name), ("version", self.trainer.version), ("modelType", self.trainer.model_type)) if v is not None}
        if self.trained is not None:
            out["trained"] = self.trained.isoformat()
        if self.data is not None:
            out["data"] = {"rows": self.data.rows, "groups": self.data.groups, "holdoutGroups": list(self.data.holdout_groups)}
        if self.score:
            out["score"] = dict(self.score)
        return json.dumps(out)

    @staticmethod
    def from_json(text: str) -> ModelMetadata:
        try:
            raw = json.loads(text)
            trainer, data = raw.get("trainer"), raw.get("data")
            return ModelMetadata(
                raw["task"], tuple(raw["features"]), raw["target"], tuple(raw.get("classes") or ()), raw.get("extractorVersion"),
                Trainer(trainer["name"], trainer.get("version"), trainer.get("modelType")) if trainer else None,
                datetime.fromisoformat(raw["trained"]) if raw.get("trained") else None,
                DataInfo(int(data["rows"]), int(data["groups"]), tuple(data.get("holdoutGroups") or ())) if data else None,
                {k: float(v) for k, v in (raw.get("score") or {}).items()}, int(raw["format"]),
            ).validate()
        except InvalidModelData:
            raise
        except (KeyError, TypeError, AttributeError, ValueError) as error:
            raise InvalidModelData(f"the model's record cannot be read: {error}") from error

    def describe(self) -> list[str]:
        """Report lines."""
        what = f"Classifies {self.target} into {', '.join(self.classes)}" if self.task == "classification" else f"Predicts {self.target}"
        lines = [what, f"Features ({len(self.features)}): {', '.join(self.features)}"]
        if self.trainer is not None:
            lines.append("Trained by " + " ".join(x for x in (self.trainer.name, self.trainer.version) if x) + (f" as {humanise(self.trainer.model_type)}" if self.trainer.model_type else ""))
        if self.trained is not None:
            lines.append(f"Trained on {self.trained:%Y-%m-%d}")
        if self.data is not None:
            lines.append(f"{self.data.rows} rows in {self.data.groups} group(s)" + (f", held out: {', '.join(self.data.holdout_groups)}" if self.data.holdout_groups else ""))
        return lines + [f"{humanise(k)}: {v:.4g}" for k, v in self.score.items()]


def humanise(name: str) -> str:
    """Camel-case words apart, in lower case."""
    return re.sub(r"(?<=[^A-Z\s])([A-Z])", r" \1", name).lower()
