"""Whole files: text with its decoding, JSON that may be relaxed, and other formats as JSON.

A document is one row, so it has to fit a task; logs are read by lines instead.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Bytes that are searched for a zero byte, and the share of replaced characters above which a file isn't text.
HEAD, REPLACED = 8000, 0.3
_STRING = r'"(?:[^"\\]|\\.)*"'
_COMMENT = re.compile(rf"({_STRING})|//[^\n]*|/\*.*?\*/", re.S)
_TRAILING = re.compile(rf"({_STRING})|,(?=\s*[\]}}])", re.S)


def read_documents(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, size, mtime, sha256, text, binary, problem) of every file; text is null for binary ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    raw = files.withColumn("_text", F.make_valid_utf8(F.col("content").cast("string")))
    bare = F.regexp_replace("_text", "^\ufeff", "")
    replaced = F.char_length("_text") - F.char_length(F.translate("_text", "\ufffd", ""))
    binary = F.contains(F.substring("content", 1, HEAD).cast("string"), F.lit("\0")) | (replaced > REPLACED * F.char_length("_text"))
    found = raw.withColumns({"binary": binary, "_bare": bare})
    problem = F.when(F.col("binary"), "not a text file").when(F.contains("_bare", F.lit("\ufffd")), "some bytes are no UTF-8")
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.when(~F.col("binary"), F.col("_bare")).alias("text"), "binary", problem.alias("problem"))


def _plain(text: str) -> str | None:
    """JSON of relaxed JSON: comments are blanked and trailing commas dropped; null if that isn't enough."""
    keep = lambda m: m[1] or " "
    bare = _TRAILING.sub(keep, _COMMENT.sub(keep, text))
    try:
        json.loads(bare)
    except (ValueError, RecursionError):
        return None
    return bare


@pandas_udf(StringType())
def relaxed_json(texts: pd.Series) -> pd.Series:
    """Relaxed JSON as JSON. No option of the built-in parsers takes trailing commas."""
    return texts.map(_plain, na_action="ignore")


def _decoded(kind: str, text: str) -> str | None:
    try:
        if kind == "toml":
            import tomllib

            value = tomllib.loads(text)
        elif kind == "plist":
            import plistlib

            value = plistlib.loads(text.encode())
        else:
            import yaml

            several = list(yaml.safe_load_all(text))
            value = several[0] if len(several) == 1 else several
        return json.dumps(value, default=str, ensure_ascii=False)
    except Exception:  # noqa: BLE001  whatever a parser says, the document stays as text
        return None


def decoder(kind: str):
    """A pandas UDF that turns YAML, TOML or property lists into JSON; null for what isn't one."""
    if kind not in ("yaml", "toml", "plist"):
        raise ValueError(f"no decoder of {kind}")
    return pandas_udf(lambda texts: texts.map(lambda t: _decoded(kind, t), na_action="ignore"), StringType(), functionType=pandas_udf_type())


def pandas_udf_type():
    from pyspark.sql.functions import PandasUDFType

    return PandasUDFType.SCALAR


def json_documents(documents: DataFrame, kind: str = "json") -> DataFrame:
    """Documents with their JSON as a VARIANT `v`, `place` and `problem`, which also says when JSON was relaxed."""
    if kind != "json":
        made = documents.withColumn("_json", decoder(kind)("text"))
        problem = F.coalesce(F.col("problem"), F.when(F.col("_json").isNull(), F.lit(f"not {kind.upper()}")))
        return made.withColumns({"v": F.try_parse_json("_json"), "place": F.lit("document"), "problem": problem}).drop("_json")
    strict = F.try_parse_json("text")
    held = documents.withColumn("_strict", strict.isNotNull())
    # only what isn't JSON goes through Python
    held = held.withColumn("_relaxed", relaxed_json(F.when(~F.col("_strict"), F.col("text"))))
    note = F.when(F.col("_strict"), F.lit(None)).when(F.col("_relaxed").isNotNull(), "read as relaxed JSON").otherwise("not JSON")
    return held.withColumns({"v": F.coalesce(strict, F.try_parse_json("_relaxed")), "place": F.lit("document"), "problem": F.coalesce("problem", note)}).drop("_strict", "_relaxed")


def entries(documents: DataFrame) -> DataFrame:
    """(path, place, v, text, problem) of the items of documents that are JSON arrays; any other document is one row."""
    is_array = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.lit(False))
    rows = documents.withColumn("_array", is_array)
    items = rows.where("_array").select("path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v"))
    each = items.select("path", F.concat(F.lit("index:"), "i").alias("place"), "v", F.to_json("v").alias("text"), F.lit(None).cast("string").alias("problem"))
    whole = rows.where("NOT _array").select("path", "place", F.lit(None).cast("variant").alias("v"), "text", F.coalesce("problem", F.lit("not a JSON array")).alias("problem"))
    return each.unionByName(whole)
