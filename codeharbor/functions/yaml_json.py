"""YAML text to JSON text, Arrow-batched. Config files are small, so rows are too."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # the structural lint then fails with a clear message
    yaml = None


def to_json(text: str | None) -> str | None:
    """JSON of a YAML mapping; NULL when the text does not parse or is no mapping."""
    if yaml is None:
        raise RuntimeError("the structural config lint needs PyYAML")
    try:
        value = yaml.load(text or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        return json.dumps(value, default=str) if isinstance(value, dict) else None
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    return texts.map(to_json)


# Marked so that the optimizer never copies the call into a pushed-down filter.
yaml_to_json = yaml_to_json.asNondeterministic()
