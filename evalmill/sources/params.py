"""Parameter texts: YAML mappings as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # YAML texts are refused then; JSON needs no parser here
    yaml = None


@F.pandas_udf(T.StringType())
def _yaml_to_json(text: pd.Series) -> pd.Series:
    def convert(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            return json.dumps(yaml.safe_load(value), default=str)
        except (yaml.YAMLError, TypeError, ValueError):
            return value

    return text.map(convert)


def params_json(text: Column) -> Column:
    """JSON text of parameters written as JSON or YAML.

    JSON stays as it is and is not sent to Python; text that is neither stays as it is too, and
    fails the check for a JSON object later.
    """
    if yaml is None:
        raise RuntimeError("reading YAML parameters needs the yaml package")
    is_json = F.try_parse_json(text).isNotNull()
    return F.when(is_json, text).otherwise(_yaml_to_json(F.when(~is_json, text)))
