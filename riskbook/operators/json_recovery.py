"""Recovery of JSON objects from text, as a batch job: as it stands, out of fences or prose, repaired, or none."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import parse_direct


def balanced(text: str) -> str | None:
    """From the first brace on: up to its partner, or to the end; None without a brace. Strings are respected."""
    begin = text.find("{")
    if begin < 0:
        return None
    depth, quoted, skip = 0, False, False
    for at in range(begin, len(text)):
        c = text[at]
        if quoted:
            skip, quoted = (c == "\\" and not skip), not (c == '"' and not skip)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : at + 1]
    return text[begin:]


def as_object(text: str) -> str | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return json.dumps(found) if isinstance(found, dict) else None


CLOSER = {"{": "}", "[": "]"}


def repair(text: str) -> str | None:
    """The object that a text means: commas before a closer go, single quotes become double, what is open at the end is
    closed in the order it was opened. None if that is no object either."""
    out: list[str] = []
    stack: list[str] = []

    def close(upto: str | None) -> None:
        while stack:
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if out and out[-1] == ":":
                out.append("null")
            out.append(CLOSER[opened := stack.pop()])
            if CLOSER[opened] == upto:
                return

    at = 0
    while at < len(text):
        c = text[at]
        at += 1
        if c in "\"'":
            inside = []
            while at < len(text) and text[at] != c:
                if text[at] == "\\" and at + 1 < len(text):
                    inside.append("'" if text[at + 1] == "'" else text[at : at + 2])
                    at += 2
                    continue
                inside.append('\\"' if text[at] == '"' else "\\n" if text[at] == "\n" else text[at])
                at += 1
            at += 1
            out.append(f'"{"".join(inside)}"')
        elif c in CLOSER:
            stack.append(c)
            out.append(c)
        elif c in "}]":
            if c in (CLOSER[x] for x in stack):
                close(c)
        else:
            out.append(c)
        if not stack and out and out[-1] in ("}", "]"):
            break
    close(None)
    return as_object("".join(out))


RECOVERED = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("value", T.StringType())])


@F.pandas_udf(RECOVERED)
def _recover(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        inner = balanced(re.sub(r"```(?:json)?", "", text or ""))
        found = as_object(inner) if inner else None
        fixed = repair(inner) if inner and not found else None
        out.append((3, found) if found else (4, fixed) if fixed else (None, None))
    return pd.DataFrame(out, columns=["layer", "value"])


def recover_json(df: DataFrame, column: str) -> DataFrame:
    """df with layer (2: as it stands, 3: cut out, 4: repaired, null: none), status and the object. What parses as it
    stands stays in the JVM; only the rest goes through Python."""
    direct = df.where(parse_direct(F.col(column))).select("*", F.lit(2).alias("layer"), F.col(column).alias("object"))
    rest = df.where(~F.coalesce(parse_direct(F.col(column)), F.lit(False))).withColumn("_r", _recover(column)).select(*df.columns, F.col("_r.layer").alias("layer"), F.col("_r.value").alias("object"))
    return direct.unionByName(rest).withColumn("status", F.when(F.col("layer").isNull(), "failed").when(F.col("layer") == 4, "repaired").otherwise("ok"))


RECORD = "pd double, pd_after double, drivers array<struct<feature string, weight double, direction string, code string>>"
DIRECTIONS = ["increases_risk", "decreases_risk"]


def validate_records(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Records against their contract: probabilities and weights in [0, 1], known directions, codes in capitals (unknown
    ones are OTHER). One that breaks it is degraded: it keeps its probability, if that is one, and loses its drivers.

    Added are pd, pd_after, drivers, valid and status.
    """
    r = F.from_json(column, RECORD, {"mode": "PERMISSIVE"})
    known = lambda x: F.when(F.upper(x["code"]).isin(codes), F.upper(x["code"])).otherwise("OTHER")
    share = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    out = df.withColumn("_r", r).withColumn("_d", F.coalesce("_r.drivers", F.array().cast("array<struct<feature string, weight double, direction string, code string>>")))
    sound = F.forall("_d", lambda x: share(x["weight"]) & F.coalesce(x["direction"].isin(DIRECTIONS), F.lit(False)) & x["feature"].isNotNull())
    out = out.withColumn("valid", share(F.col("_r.pd")) & (F.col("_r.pd_after").isNull() | share(F.col("_r.pd_after"))) & sound)
    drivers = F.transform("_d", lambda x: F.struct(x["feature"].alias("feature"), x["weight"].alias("weight"), x["direction"].alias("direction"), known(x).alias("code")))
    return out.select(
        *df.columns, F.when(share(F.col("_r.pd")), F.col("_r.pd")).alias("pd"), F.when(F.col("valid"), F.col("_r.pd_after")).alias("pd_after"),
        F.when(F.col("valid"), drivers).otherwise(F.slice(drivers, 1, 0)).alias("drivers"), "valid", F.when(F.col("valid"), "ok").otherwise("degraded").alias("status"),
    )
