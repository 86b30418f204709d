"""Facts from a compiler about candidate functions, as an optional side table: batches, a pluggable provider, protocol checks, and their use on pairs.

A provider takes one request (a dict) and returns one response; stdio_provider() runs a command that speaks JSON over its
standard streams. Without a provider the table is empty and nothing else changes.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Protocol version, items of a batch, bytes of a reply, seconds that a reply may take.
PROTOCOL, BATCH, REPLY_BYTES, SECONDS = 1, 200, 8 * 1024 * 1024, 5.0
FACTS = "signature_id string, resolved boolean, ownership_ambiguous boolean, declaration_only boolean, overload_group_id string, return_type string, call_targets array<string>"

Provider = Callable[[dict], dict]


def worth_enriching(rel: DataFrame) -> DataFrame:
    """Members of relations that compiler facts could decide: typed-script functions in pairs that are no exact copies."""
    near = rel.filter(~F.col("body_match") & (F.col("l.language_family") == "ecmascript"))
    return near.select(F.explode(F.array("l", "r")).alias("m")).select("m.signature_id", "m.file", "m.symbol", "m.start_line", "m.end_line", "m.language").distinct()


def batches(members: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, items): requests of at most so many items of one folder. Rows are numbered inside a folder's hash shard, not over all."""
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    shard = F.pmod(F.xxhash64("signature_id"), F.lit(16))
    n = F.row_number().over(Window.partitionBy("folder", "shard").orderBy("file", "start_line", "signature_id")) - 1
    cut = members.withColumns({"folder": folder, "shard": shard}).withColumn("n", n)
    key = F.sha2(F.concat_ws("\x1f", "folder", "shard", F.floor(F.col("n") / size)), 256)
    item = F.struct("signature_id", F.col("file").alias("relative_path"), "start_line", "end_line", F.col("symbol").alias("symbol_hint"))
    return cut.groupBy(key.alias("batch"), "folder").agg(F.array_sort(F.collect_list(item)).alias("items"))


def mismatch(request: dict, response: dict) -> str:
    """Why a response doesn't answer a request; empty if it does."""
    if response.get("protocol_version") != request["protocol_version"]:
        return "protocol version"
    if response.get("request_id") != request["request_id"]:
        return "request id"
    ids = [x.get("signature_id") for x in response.get("items", [])]
    if len(ids) != len(set(ids)) or not set(ids) <= {x["signature_id"] for x in request["items"]}:
        return "item ids"
    return ""


def stdio_provider(command: list[str], seconds: float = SECONDS) -> Provider:
    """A provider that starts a command for each request, which reads one JSON line and writes one."""

    def ask(request: dict) -> dict:
        run = subprocess.run(command, input=json.dumps(request) + "\n", capture_output=True, text=True, timeout=seconds, check=False)
        if run.returncode or len(run.stdout) > REPLY_BYTES:
            raise RuntimeError(f"worker ended with {run.returncode}, {len(run.stdout)} bytes")
        return json.loads(run.stdout.splitlines()[-1])

    return ask


def enrich(requests: DataFrame, provider: Provider | None) -> DataFrame:
    """Facts of all batches; a batch that fails, is late or doesn't fit the protocol gives none."""
    if provider is None:
        return requests.sparkSession.createDataFrame([], FACTS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in FACTS.split(", ")]
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                items = [dict(x) for x in r.items]
                for x in items:
                    x["start_line"], x["end_line"] = int(x["start_line"]), int(x["end_line"])
                request = {"protocol_version": PROTOCOL, "request_id": r.batch[:16], "project_cache_key": r.folder, "items": items}
                try:
                    response = provider(request)
                except (OSError, RuntimeError, ValueError, subprocess.TimeoutExpired):
                    continue
                if not mismatch(request, response):
                    rows += [{k: x.get(k) for k in names} for x in response.get("items", [])]
            yield pd.DataFrame(rows, columns=names)

    return requests.select("batch", "folder", "items").mapInPandas(run, FACTS)


def pair_evidence(rel: DataFrame, facts: DataFrame) -> DataFrame:
    """Per cluster: pairs that share a resolved call target or an overload group, or whose targets diverge, and members that are unresolved, ambiguous or declarations."""
    side = lambda s: facts.select(F.col("signature_id").alias(f"{s}_id"), F.struct(*[c.split(" ")[0] for c in FACTS.split(", ")]).alias(f"{s}_facts"))
    p = rel.select("cluster", F.col("l.signature_id").alias("l_id"), F.col("r.signature_id").alias("r_id")).join(side("l"), "l_id", "left").join(side("r"), "r_id", "left")
    known = F.col("l_facts.resolved") & F.col("r_facts.resolved")
    shared = F.arrays_overlap("l_facts.call_targets", "r_facts.call_targets")
    either = lambda c: F.coalesce(F.col(f"l_facts.{c}"), F.lit(False)) | F.coalesce(F.col(f"r_facts.{c}"), F.lit(False))
    return p.groupBy("cluster").agg(
        F.count_if(known & shared).alias("semantic_shared"), F.count_if(known & (F.col("l_facts.overload_group_id") == F.col("r_facts.overload_group_id"))).alias("semantic_overloads"),
        F.count_if(known & ~shared & (F.size("l_facts.call_targets") > 0) & (F.size("r_facts.call_targets") > 0)).alias("semantic_divergent"), F.bool_or(either("declaration_only")).cast("int").alias("semantic_declarations"),
        F.bool_or(~F.coalesce(F.col("l_facts.resolved"), F.lit(True)) | ~F.coalesce(F.col("r_facts.resolved"), F.lit(True))).cast("int").alias("semantic_unresolved"), F.bool_or(either("ownership_ambiguous")).cast("int").alias("semantic_ambiguous"),
    )
