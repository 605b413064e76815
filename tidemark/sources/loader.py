"""Bulk loads: pipe-separated `.tbl` files and `.sql` scripts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import of_field, stored


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a pipe-separated file: short lines are left out, fields beyond the schema ignored, a pipe at the end allowed."""
    parts = F.split("value", r"\|")
    n = len(schema)
    whole = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= n)
    return whole.select(*(stored(F.trim(F.get("p", F.lit(i))) if of_field(f).numeric else F.get("p", F.lit(i)), of_field(f)).alias(f.name) for i, f in enumerate(schema.fields)))


def statements(text: str) -> Iterator[str]:
    """Statements of a script: each ends at a line that ends in `;`. Lines with `--`, lines that end in `#`, and lines from one that
    ends in `/*` to one that ends in `*/` are left out; a statement's lines are joined by blanks."""
    held: list[str] = []
    comment = False
    for line in text.splitlines():
        line = line.rstrip()
        if comment:
            comment = not line.endswith("*/")
        elif line.endswith("/*"):
            comment = True
        elif "--" not in line and not line.endswith("#") and line:
            held.append(line)
            if line.endswith(";"):
                yield " ".join(held)[:-1].strip()
                held = []


def table_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", os.path.basename(path))
