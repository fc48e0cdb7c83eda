"""What is shown with a log: its summary, its parameters with their meanings, texts filled with its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syslumen.functions import parameters as P
from syslumen.functions import scalar as S
from syslumen.session import broadcast_if_small

# Names that parameters of one role go by, in the order in which roles are shown.
ROLES: dict[str, tuple[str, ...]] = {
    "reason": ("reason", "cause", "errorreason", "failreason", "offlinereason", "downreason"),
    "interface": ("interface", "ifname", "interfacename", "portname", "port", "mainifname"),
    "peer": ("peer", "peerip", "peeraddress", "neighbor", "neighboraddress", "remoteaddress", "nbraddr"),
    "ip": ("ip", "ipaddress", "ipaddr", "sourceip", "userip", "clientip"),
    "state": ("state", "status", "currentstate", "operstatus", "newstate"),
    "instance": ("instance", "vpninstance", "vrf", "processid"),
    "mac": ("mac", "macaddress", "usermac", "clientmac"),
    "trunk": ("trunk", "trunkname", "trunkid", "ethtrunk"),
}


def role(normal: Column, name: str) -> Column:
    """The first value that a map with normalised keys has under one of a role's names."""
    return F.coalesce(*(F.nullif(F.element_at(normal, F.lit(k)), F.lit("")) for k in ROLES[name]))


def context(parameters: Column, most: int = 3) -> Column:
    """Up to three of the roles' values, the reason cut at 30 characters, an address only without a peer."""
    names = list(ROLES)

    def listed(values: Column) -> Column:
        value = {k: F.get(values, F.lit(i)) for i, k in enumerate(names)}
        value["reason"] = F.when(F.length(value["reason"]) > 30, F.concat(F.substring(value["reason"], 1, 30), F.lit("..."))).otherwise(value["reason"])
        value["ip"] = F.when(value["peer"].isNull(), value["ip"])
        told = F.filter(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in value.items())), lambda x: x.isNotNull())
        return F.array_join(F.slice(told, 1, most), " | ")

    looked_up = lambda normal: S.let(F.array(*(role(normal, k) for k in names)), listed)
    # the map is normalised once a row, not for each name, and each role is looked up once; most maps have none of the names
    known = F.map_filter(S.normalized_map(parameters), lambda k, v: k.isin(*(n for own in ROLES.values() for n in own)))
    return S.let(known, lambda normal: F.when(F.size(normal) > 0, looked_up(normal)).otherwise(""))


def summary(logs: DataFrame) -> Column:
    """A line that tells an event: what knowledge says, filled with values, else the comment or the event's name and parameters."""
    title = S.clean_title(F.coalesce("description", F.lit("")))
    line = lambda x: F.when(x["title"] != "", F.concat(x["title"], F.when(x["about"] != "", F.concat(F.lit(" ("), x["about"], F.lit(")"))).otherwise("")))
    told = S.let(F.struct(title.alias("title"), context(F.col("parameters")).alias("about")), line)
    plain = F.concat(F.col("module"), F.lit("/"), F.col("brief"), F.when(F.size("parameters") > 0, F.concat(F.lit(": "), S.top_parameters(F.col("parameters"), 3))).otherwise(""))
    return F.concat(S.severity_prefix(F.col("severity")), F.when(F.col("module") == "COMMENT", F.substring("message_body", 1, 200)).otherwise(F.coalesce(told, plain)))


def with_knowledge(logs: DataFrame, knowledge: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Logs with their entry's texts, filled with the log's values, their summary and document; unmatched ones have none."""
    texts = ("message", "description", "cause", "action", "impact")
    known = knowledge.select(F.col("id").alias("knowledge_id"), *(F.col(t) for t in texts if t in knowledge.columns))
    out = logs.join(broadcast_if_small(known), "knowledge_id", "left")
    if "parameters" not in out.columns:
        out = out.withColumn("parameters", F.coalesce(F.from_json("parameters_json", "map<string,string>"), F.create_map().cast("map<string,string>")))
    out = out.withColumn("parameters", P.merged(F.col("parameters"), P.captured(F.col("message"), F.col("message_body"))))
    out = out.withColumn("event_summary", summary(out))
    out = out.withColumns({f"{t}_text": P.rendered(F.col(t), F.col("parameters")) for t in texts if t in known.columns})
    if documents is not None:
        names = documents.select(F.col("id").alias("matched_document_id"), F.col("name").alias("document_name"))
        out = out.join(broadcast_if_small(names), "matched_document_id", "left")
    return out


def described(logs: DataFrame, definitions: DataFrame) -> DataFrame:
    """``logs`` with ``described``: parameters with what their entry says of them (``knowledge_id, name, description``), sorted by name."""
    rows = logs.select("id", "knowledge_id", F.explode("parameters").alias("name", "value")).withColumn("plain", S.normalized_key(F.col("name")))
    known = definitions.groupBy("knowledge_id", S.normalized_key(F.col("name")).alias("plain")).agg(F.min("description").alias("description"))
    made = rows.join(known, ["knowledge_id", "plain"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "value", F.coalesce("description", F.lit("")).alias("description")))).alias("described"))
    return logs.join(made, "id", "left")
