"""The vault: raw values of tokens, kept apart from all else, with an audit of every look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token


def observations(events: DataFrame, key: str | None = None) -> DataFrame:
    """(namespace, token, raw_value, source_drop_id, ord) of identifiers and names in events made with raw values.

    An identifier's event field has its token beside it. Names are held under
    their own token and under the token of the identifier beside them.
    """
    p = F.col("payload")
    kind, code = F.col("event_type"), p["entity_identifier_code"]
    who = (
        F.when(kind.isin("ClaimReferencedPatient", "RemittanceClaimReferencedPatient"), "patient")
        .when(kind.isin("ClaimReferencedSubscriber", "RemittanceClaimReferencedSubscriber", "MemberReferenced"), "member")
        .when(kind == "RemittancePartyReferenced", F.when(code == "PE", "provider").when(code == "PR", "payer").otherwise("unknown"))
        .when(kind.endswith("PartyReferenced"), F.when(p["payer_id_token"].isNotNull(), "payer").when(p["provider_id_token"].isNotNull(), "provider").when(p["member_id_token"].isNotNull(), "member").otherwise("unknown"))
        .when(kind.startswith("ClaimReferenced"), "provider")
        .otherwise("member")
    )
    id_space = F.when(who == "unknown", "unknown").otherwise(F.concat(who, F.lit("_id")))
    fields = {"claim_id": F.lit("claim_id"), "payer_claim_control_number": F.lit("payer_claim_control_number"), "id_value": id_space, "date_of_birth": F.lit("member_dob"), "reference_identification": F.lit("reference_id"), "insured_group_or_policy_number": F.lit("reference_id")}
    one = lambda ns, t, raw: F.struct(ns.alias("namespace"), t.alias("token"), raw.alias("raw_value"))
    ids = [one(ns, p[f"{f}_token"], p[f]) for f, ns in fields.items()]
    person = F.concat_ws("|", F.when(p["last_name_or_org"] != "", p["last_name_or_org"]), F.when(p["first_name"] != "", p["first_name"]))
    name = F.when(p["name"].isNotNull(), p["name"]).otherwise(person)
    space = F.when(who == "unknown", "entity_name").otherwise(F.concat(who, F.lit("_name")))
    names = [one(space, token(space, name, key), name), one(F.concat(id_space, F.lit("_name")), p["id_value_token"], name)]
    rows = events.select("source_drop_id", F.struct("input_ordinal", "source_file", "seq").alias("ord"), F.explode(F.array(*ids, *names)).alias("x"))
    return rows.select("x.namespace", "x.token", "x.raw_value", "source_drop_id", "ord").where("token <> '' and raw_value <> ''")


def mappings(seen: DataFrame) -> DataFrame:
    """One row for each (namespace, token), with the first and last drop that showed it."""
    return seen.where("source_drop_id <> ''").groupBy("namespace", "token").agg(
        F.min_by("raw_value", "ord").alias("raw_value"), F.min_by("source_drop_id", "ord").alias("first_source_drop_id"), F.max_by("source_drop_id", "ord").alias("last_source_drop_id"), F.count_distinct("raw_value").alias("raw_values")
    )


def conflicts(seen: DataFrame) -> DataFrame:
    """Tokens with more than one raw value."""
    return mappings(seen).where("raw_values > 1").select("namespace", "token", "raw_values")


def put(vault: DataFrame | None, seen: DataFrame) -> DataFrame:
    """The vault with what was seen: known values move their last drop on; another value for a token is an error, as is no drop."""
    if not seen.where("source_drop_id is null or source_drop_id = ''").isEmpty():
        raise ValueError("INVALID_ARGUMENT: raw values need a source drop")
    fresh = mappings(seen)
    bad = fresh.where("raw_values > 1")
    fresh = fresh.drop("raw_values")
    if vault is None:
        if not bad.isEmpty():
            raise ValueError("CONFLICT: a token has two raw values")
        return fresh
    both = vault.alias("v").join(fresh.alias("f"), ["namespace", "token"], "full")
    if not bad.isEmpty() or not both.where("v.raw_value <> f.raw_value").isEmpty():
        raise ValueError("CONFLICT: a token has two raw values")
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return both.select(
        "namespace", "token", pick("v.raw_value", "f.raw_value").alias("raw_value"), pick("v.first_source_drop_id", "f.first_source_drop_id").alias("first_source_drop_id"), pick("f.last_source_drop_id", "v.last_source_drop_id").alias("last_source_drop_id")
    )


def resolve(vault: DataFrame, wanted: DataFrame, actor: str = "cli", purpose: str = "debug") -> tuple[DataFrame, DataFrame]:
    """Raw values ('' if unknown) of (namespace, token) rows, and the audit rows of having asked."""
    got = wanted.join(vault.select("namespace", "token", "raw_value"), ["namespace", "token"], "left")
    audit = got.select(F.lit("resolve").alias("action"), "namespace", "token", F.lit(actor).alias("actor"), F.lit(purpose).alias("purpose"), F.when(F.col("raw_value").isNull(), "not_found").otherwise("found").alias("result"))
    return got.withColumn("raw_value", F.coalesce("raw_value", F.lit(""))), audit
