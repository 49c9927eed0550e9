"""Run parameters, read from JSON files on the driver and checked."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field, fields
from pathlib import Path


class _FromJson:
    @classmethod
    def from_json(cls, path: str, **more):
        """Fields by name; what the class doesn't know goes to other_args."""
        with open(path) as f:
            found = json.load(f) | more
        names = {x.name for x in fields(cls)}
        other = {k: found.pop(k) for k in list(found) if k not in names}
        if other:
            found["other_args"] = found.get("other_args", {}) | other
        return cls(**found)


@dataclass(frozen=True)
class SplitParams(_FromJson):
    clean_data_location: str
    name: str
    random_seed: int
    valid_amount: int = 0
    id_test_amount: int = 0
    hard_limit_train: int = 0
    train_amount: int = 0
    od_test_amount: int = 0
    od_test_amount_docs: int = 0
    od_test_amount_authors: int = 0
    finetune_amount: int = 0
    other_args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TimeParams(_FromJson):
    clean_data_location: str
    name: str
    random_seed: int
    years_to_break: list[int]
    test_amount: int
    max_training_size: int
    max_val_size: int
    document_split: bool = True
    control_for_training_size: bool = False
    valid_proportion: float = 0.05
    leeway: int = 750
    other_args: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.valid_proportion <= 1:
            raise ValueError("valid_proportion must be from 0 to 1")


@dataclass(frozen=True)
class ClassSpec(_FromJson):
    name: str
    excluded_name_rxns: list[str]
    terms_to_check: list[list[str]] = field(default_factory=list)
    other_args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class BespokeParams(_FromJson):
    name: str
    namerxn_codes: list[str]
    clean_data_location: str
    terms_to_check: list[list[str]] = field(default_factory=list)
    reactions_jsonl_datasets_to_exclude: list[str] = field(default_factory=list)
    create_exclusion_ignored_set: bool = True
    random_seed: int = 0
    other_args: dict = field(default_factory=dict)


def class_specs(folder: str) -> list[ClassSpec]:
    """One specification for every JSON file of a folder, by name."""
    return [ClassSpec.from_json(str(p)) for p in sorted(Path(folder).glob("*.json"))]


def dataset_paths(ini: str) -> dict[str, str]:
    """All options of an INI file's sections as paths by name."""
    parser = configparser.ConfigParser()
    with open(ini) as f:
        parser.read_file(f)
    return {k: v for section in parser.sections() for k, v in parser.items(section)}
