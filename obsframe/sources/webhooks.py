"""Webhook bodies as logs and metrics.

Input rows carry `body` (JSON text), `ingest_ms` and `seq`; bodies that are not JSON
objects give nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from obsframe.functions.text import parse_once

# Texts of repository events and the source name of their logs.
REPO_SOURCE = "github-webhook"
PUSH = "[github:push] %s pushed to %s (%d commits)"
PULL_REQUEST = "[github:pr] %s PR#%d '%s' by %s"
ISSUE = "[github:issue] %s issue#%d '%s' by %s"
OTHER = "[github:%s] webhook received"
NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _parsed(rows: DataFrame) -> DataFrame:
    return (parse_once(rows, _v=F.try_parse_json("body"))
            .filter(F.col("_v").isNotNull() & F.startswith(F.ltrim("body"), F.lit("{"))))


def repository_events(rows: DataFrame) -> DataFrame:
    """push, pull_request, issues and other events as one info log each."""
    v = F.col("_v")
    text = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    num = lambda path: F.coalesce(F.try_variant_get(v, path, "bigint"), F.lit(0).cast("long"))
    event = F.coalesce(F.nullif(F.col("event"), F.lit("")), F.lit("unknown"))
    repo, action = text("$.repository.full_name"), text("$.action")
    commits = F.coalesce(F.size(F.try_variant_get(v, "$.commits", "array<variant>")), F.lit(0))
    of = lambda kind: (text(f"$.{kind}.title"), text(f"$.{kind}.user.login"))
    pr_title, pr_user = of("pull_request")
    is_title, is_user = of("issue")
    message = (F.when(event == "push", F.format_string(PUSH, text("$.pusher.name"), repo, commits))
               .when(event == "pull_request", F.format_string(PULL_REQUEST, action, num("$.number"), pr_title, pr_user))
               .when(event == "issues", F.format_string(ISSUE, action, num("$.issue.number"), is_title, is_user))
               .otherwise(F.format_string(OTHER, event)))
    base = [F.lit("event"), event]
    labels = (F.when(event == "push", F.create_map(*base, F.lit("repo"), repo, F.lit("ref"), text("$.ref")))
              .when(event.isin("pull_request", "issues"), F.create_map(*base, F.lit("action"), action, F.lit("repo"), repo))
              .otherwise(F.create_map(*base)))
    return _parsed(rows).select(F.col("ingest_ms").alias("ts_ms"), F.lit("info").alias("level"),
                                F.lit(REPO_SOURCE).alias("source"), message.alias("message"), labels.alias("labels"), "seq")


def is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(NUMERIC), F.lit(False))


def numeric_fields(rows: DataFrame, metric: str) -> DataFrame:
    """Each top-level numeric field as a point of one metric, labelled with the field name."""
    fields = F.from_json("body", "map<string,variant>")
    out = _parsed(rows).select("ingest_ms", "seq", F.explode(fields).alias("field", "x")).filter(is_number(F.col("x")))
    return out.select(F.lit(metric).alias("name"), F.create_map(F.lit("field"), F.col("field")).alias("labels"),
                      F.variant_get("x", "$", "double").alias("value"), F.col("ingest_ms").alias("ts_ms"), "seq")


@dataclass(frozen=True)
class ExtractRule:
    path: str
    metric: str
    labels: Mapping[str, str] = field(default_factory=dict)


def object_path(path: str) -> str:
    """`$.a.b` as quoted object steps, so no part of it is read as an array index."""
    path = path.removeprefix("$.").removeprefix("$")
    return "$" + "".join(f'["{p}"]' for p in path.split(".") if p)


def extract(rows: DataFrame, endpoints: Mapping[str, Sequence[ExtractRule]]) -> DataFrame:
    """Apply each endpoint's rules to its bodies.

    A missing or non-numeric path skips the rule, a missing label path leaves the label
    out. With their paths as literals each path is parsed once, and only the rules of a
    body's own endpoint are evaluated.
    """

    def rule(endpoint: str, r: ExtractRule) -> Column:
        at = lambda path, kind: F.try_variant_get("_v", object_path(path), kind)
        pairs = [F.struct(F.lit("webhook").alias("key"), F.lit(endpoint).alias("value"))]
        pairs += [F.struct(F.lit(k).alias("key"), at(p, "string").alias("value")) for k, p in r.labels.items()]
        return F.struct(F.lit(r.metric).alias("metric"), at(r.path, "variant").alias("x"), F.array(*pairs).alias("labels"))

    rules = F.when(F.lit(False), F.lit(None).cast("array<struct<metric:string,x:variant,labels:array<struct<key:string,value:string>>>>"))
    for name, list_ in endpoints.items():
        if list_:
            rules = rules.when(F.col("endpoint") == name, F.array(*[rule(name, r) for r in list_]))
    out = _parsed(rows).select("ingest_ms", "seq", F.explode(rules).alias("r"))
    out = out.select("ingest_ms", "seq", "r", F.col("r.x").alias("_x")).filter(F.col("_x").isNotNull() & is_number(F.col("_x")))
    labels = F.map_from_entries(F.filter("r.labels", lambda p: p["value"].isNotNull()))
    return out.select(F.col("r.metric").alias("name"), labels.alias("labels"),
                      F.variant_get("_x", "$", "double").alias("value"), F.col("ingest_ms").alias("ts_ms"), "seq")
