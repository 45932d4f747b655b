"""Segments to domain events, for all five transaction types.

Carried context ("current claim", "current member") is a fill-forward window
over the document that resets at each ST and at the segments that end it. All
windows have the partitioning and order of the segments, so Spark sorts once.
Each segment then yields the numbers of its events, which are exploded: no
unions over the segments, no Python. An event's fields are columns chosen by
its number, so those that nobody reads are not made.

Context never leaks from one ST to the next. A field that a segment lacks is
the empty string, as opposed to a field an event doesn't have, which is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fx
from ..functions.tokens import token
from ..sources.x12 import place

class Phi:
    """How identifying values appear: as tokens, or raw with a token beside them."""

    def __init__(self, include: bool = False, key: str | None = None):
        self.include, self.key = include, key

    def token(self, name: str, namespace, value: Column, made: Column | None = None) -> list[tuple[str, Column]]:
        t = token(namespace, value, self.key) if made is None else made
        return [(name, value), (f"{name}_token", t)] if self.include else [(name, t)]

    def only(self, name: str, value: Column) -> list[tuple[str, Column]]:
        return [(name, value)] if self.include else []


def el(n: int, e: Column | None = None) -> Column:
    """Element n (from 1) or ''."""
    return F.coalesce(F.get(F.col("e") if e is None else e, F.lit(n - 1)), F.lit(""))


#: The events of the segments that begin a claim. No other event has a claim before.
OPENING = ("ClaimObserved", "RemittanceClaimPaymentObserved")


def event(kind: str | Column, when: Column, fields: list, arrays: list = (), at: dict | None = None) -> dict:
    """An event where the condition holds. at: the place (i, o) of the segment it stems from, if not this one."""
    return {"name": kind if isinstance(kind, str) else "", "kind": F.lit(kind) if isinstance(kind, str) else kind, "when": when, "fields": fields, "arrays": arrays, "at": at}


def _window(segs: DataFrame) -> tuple[W, W]:
    by = W.partitionBy(*place(segs)).orderBy("p" if "p" in segs.columns else "segment_index")
    return by, by.rowsBetween(W.unboundedPreceding, 0)


def carried(value: Column, over, start: Column) -> Column:
    """The last value that is not null so far; start at each ST, null before the first value."""
    return F.last(F.coalesce(value, F.when(F.col("tag") == "ST", start)), ignorenulls=True).over(over)


def filled(value: Column, over) -> Column:
    """The last value of the transaction that is not null so far, '' before the first."""
    return F.coalesce(carried(value, over, F.lit("")), F.lit(""))


def _chosen(options: list[tuple[int, Column]], kind: str) -> Column:
    """The column that belongs to the event's number; columns that several share are tested for together."""
    groups: dict[int, tuple[Column, list[int]]] = {}
    for n, c in options:
        groups.setdefault(id(c), (c, []))[1].append(n)
    out = None
    for c, of in groups.values():
        here = F.col("number").isin(*of)
        out = F.when(here, c.cast(kind)) if out is None else out.when(here, c.cast(kind))
    return out


def _emit(segs: DataFrame, events: list[dict], codes: Column | None = None, part: str | None = None) -> DataFrame:
    """A row for each event, numbered within its document. codes: how often the last of the events comes; its condition is not asked.

    Besides payload and arrays each field is a column f_name, each list l_name;
    o_segment and o_emitted have the order of seq, but need no pass over the document.
    """
    if part:
        events = [x for x in (events if codes is None else events[:-1]) if (x["name"] in OPENING if part == "opening" else not x["at"])]
        codes = None
    keys = [*place(segs), "input_ordinal", "segment_index", "isa13", "gs06", "st02"]
    by, _ = _window(segs)
    asked = events if codes is None else events[:-1]
    numbers = F.array_remove(F.array(*(F.when(x["when"], F.lit(n)).otherwise(F.lit(-1)) for n, x in enumerate(asked))), -1)
    if codes is not None:
        numbers = F.concat(numbers, F.array_repeat(F.lit(len(asked)), codes))
    rows = segs.withColumn("numbers", numbers)
    # With some events left out there are no numbers to tell.
    so_far = F.raise_error("events of a part are not numbered").cast("long") if part else F.coalesce(F.sum(F.size("numbers")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("so_far", so_far)
    # A segment's events come in the order of the list.
    rows = rows.where(F.size("numbers") > 0).select("*", F.posexplode("numbers").alias("emitted", "number"))
    place_of = lambda k, c: _chosen([(n, x["at"][k] if x["at"] else c) for n, x in enumerate(events)], "long")
    fields: dict[str, list] = {}
    lists: dict[str, list] = {}
    for n, x in enumerate(events):
        for name, value in x["fields"]:
            fields.setdefault(name, []).append((n, value))
        for name, value in x["arrays"]:
            lists.setdefault(name, []).append((n, value))

    def maps(part: str, of: str) -> Column:
        every = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{of}>"))
        out = None
        for n, x in enumerate(events):
            if x[part]:
                own = F.create_map(*(y for name, value in x[part] for y in (F.lit(name), value.cast(of))))
                out = (F if out is None else out).when(F.col("number") == n, own)
        return every if out is None else F.map_filter(out.otherwise(every), lambda k, v: v.isNotNull()) if part == "fields" else out.otherwise(every)

    return rows.select(
        *keys[:-4], F.col("segment_index").alias("o_segment"), F.col("emitted").alias("o_emitted"), *(c for c in ("o_envelope",) if c in segs.columns), (F.col("so_far") + F.col("emitted") + 1).cast("long").alias("seq"), "isa13", "gs06", "st02",
        _chosen([(n, x["kind"]) for n, x in enumerate(events)], "string").alias("event_type"),
        place_of("i", F.col("segment_index")).alias("source_segment_index"), place_of("o", F.col("byte_offset")).alias("source_byte_offset"),
        maps("fields", "string").alias("payload"), maps("arrays", "array<string>").alias("arrays"),
        *(_chosen(v, "string").alias(f"f_{k}") for k, v in fields.items()), *(_chosen(v, "array<string>").alias(f"l_{k}") for k, v in lists.items()),
    )


def ahead(key: str | None = None):
    """For x12.segments: what the mappers carry and the segments alone tell, made in the pass that makes the control numbers. Columns of other types than a document's cost nothing."""
    upto = lambda by: by.rowsBetween(W.unboundedPreceding, 0)
    # Within one envelope events are of one drop.
    envelope = lambda by: F.sum(F.col("tag").isin("ISA", "GS", "ST").cast("long")).over(upto(by)).alias("o_envelope")
    return lambda by: [envelope(by), *_ahead_835(by, key), *_ahead_837(by, key)]


def _with_ahead(segs: DataFrame, kind: str, make, by, key: str | None) -> DataFrame:
    """Segments with the columns made ahead for their type, now if not then, by their plain names."""
    s = segs if any(c.startswith(f"{kind}_") for c in segs.columns) else segs.select("*", *make(by, key))
    return s.select(*(F.col(f"`{c}`").alias(c.removeprefix(f"{kind}_")) for c in s.columns if c[:4] not in {"835_", "837_"} - {f"{kind}_"}))


def _raw() -> list[tuple[str, Column]]:
    return [("raw_elements", F.col("e"))]


def map_834(segs: DataFrame, phi: Phi) -> DataFrame:
    tag = F.col("tag")
    return _emit(
        segs,
        [
            event("MemberReferenced", (tag == "NM1") & (el(1) == "IL"), [("entity_type", el(2)), *phi.only("last_name_or_org", el(3)), *phi.only("first_name", el(4)), ("id_qualifier", el(8)), *phi.token("id_value", "member_id", el(9))]),
            event("MemberEnrollmentChanged", tag == "INS", [("relationship_code", el(2)), ("maintenance_type_code", el(3)), ("benefit_status_code", el(5))], _raw()),
            event("CoverageDateObserved", tag == "DTP", [("date_qualifier", el(1)), ("date_format", el(2)), ("date_value", el(3))]),
            event("HealthCoverageObserved", tag == "HD", [("maintenance_type_code", el(1)), ("insurance_line_code", el(3)), ("plan_coverage_description", el(4)), ("coverage_level_code", el(5))], _raw()),
        ],
    )


def map_27x(segs: DataFrame, phi: Phi, kind: str) -> DataFrame:
    prefix = "EligibilityInquiry" if kind == "270" else "EligibilityResponse"
    _, upto = _window(segs)
    tag, none = F.col("tag"), F.lit("")
    member = (tag == "NM1") & el(1).isin("IL", "QC")
    payer = (tag == "NM1") & (el(1) == "PR")
    provider = (tag == "NM1") & el(1).isin("1P", "VN")
    asks = (tag == "EQ") if kind == "270" else (tag == "EB")
    service = F.when((tag == "BHT") | (tag == "HL") | member, none).when(asks, el(1) if kind == "270" else el(3))
    s = segs.select(
        "*",
        filled(F.when(tag == "BHT", el(3)), upto).alias("eligibility_id"),
        filled(F.when(tag == "BHT", none).when(member, el(9)), upto).alias("member"),
        filled(F.when(tag == "BHT", none).when(payer, el(9)), upto).alias("payer"),
        filled(service, upto).alias("service"),
    )
    full = lambda c: F.when(c != "", c)  # noqa: E731  a field only if it has a value
    ctx = [*phi.token("payer_id", "payer_id", full(F.col("payer"))), *phi.token("member_id", "member_id", full(F.col("member")))]
    base = [("eligibility_id", F.col("eligibility_id"))]
    scope = F.when(F.col("service") != "", "benefit").when(F.col("member") != "", "member").otherwise("transaction")
    role = F.when(member, "member_id").when(payer, "payer_id").when(provider, "provider_id")
    known = role.isNotNull()
    shown = el(9)
    party = [*base, ("entity_identifier_code", el(1)), ("entity_type", el(2)), *phi.only("last_name_or_org", el(3)), *phi.only("first_name", el(4)), ("id_qualifier", el(8))]
    # An unknown role's id appears only with raw values allowed.
    if phi.include:
        party += [("id_value", shown), ("id_value_token", F.when(known, token(F.coalesce(role, F.lit("unknown")), shown, phi.key)))]
    else:
        party += [("id_value", F.when(known, token(F.coalesce(role, F.lit("unknown")), shown, phi.key)))]
    for name in ("member_id", "provider_id", "payer_id"):
        party += phi.token(name, name, F.when((role == name) & (shown != ""), shown))
    return _emit(
        s,
        [
            event(f"{prefix}Observed", tag == "BHT", [*base, ("transaction_set_purpose_code", el(2)), ("transaction_date", el(4)), ("transaction_time", el(5)), ("transaction_type_code", el(6))], _raw()),
            event(f"{prefix}PartyReferenced", tag == "NM1", party),
            event(f"{prefix}TraceRecorded", tag == "TRN", [*base, *ctx, ("trace_type_code", el(1)), ("trace_number", el(2)), ("originating_company_id", el(3))], _raw()),
            event(f"{prefix}DateRecorded", tag == "DTP", [*base, *ctx, ("date_scope", scope), ("service_type_code", full(F.col("service"))), ("date_qualifier", el(1)), ("date_format", el(2)), ("date_value", el(3))]),
            event(f"{prefix}DemographicsObserved", tag == "DMG", [*base, *ctx, ("date_format", el(1)), *phi.token("date_of_birth", "member_dob", el(2)), *phi.only("gender_code", el(3))]),
            event("EligibilityInquiryServiceTypeRequested", (tag == "EQ") & F.lit(kind == "270"), [*base, *ctx, ("service_type_code", el(1))], _raw()),
            event(
                "EligibilityBenefitObserved", (tag == "EB") & F.lit(kind == "271"),
                [*base, *ctx, *((n, el(k)) for k, n in enumerate((
                    "eligibility_or_benefit_information_code", "coverage_level_code", "service_type_code", "insurance_type_code", "plan_coverage_description", "time_period_qualifier",
                    "monetary_amount", "percent", "quantity_qualifier", "quantity", "authorization_or_certification_indicator", "in_plan_network_indicator"), 1))],
                _raw(),
            ),
        ],
    )


def _ahead_835(by, key: str | None) -> list[Column]:
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    tag, none = F.col("tag"), F.lit("")
    return [
        filled(F.when(tag == "TRN", el(2)), upto).alias("835_remittance"),
        filled(F.when(tag == "BPR", none).when(tag == "CLP", el(1)), upto).alias("835_claim"),
        # The token is made where the claim begins, and carried.
        filled(F.when(tag == "BPR", none).when(tag == "CLP", token("claim_id", el(1), key)), upto).alias("835_claim_token"),
        carried(F.when(tag == "BPR", F.col("e")), upto, F.col("e")).alias("835_bpr_e"),
        carried(F.when(tag == "BPR", True), upto, F.lit(False)).alias("835_bpr_seen"),
        F.sum((tag == "SVC").cast("long")).over(upto).alias("835_lines"),
    ]


def map_835(segs: DataFrame, phi: Phi, part: str | None = None) -> DataFrame:
    by, upto = _window(segs)
    tag, none, mark = F.col("tag"), F.lit(""), F.col("component")
    s = _with_ahead(segs, "835", _ahead_835, by, phi.key)
    s = s.withColumn("bpr", F.when(F.col("bpr_seen"), F.col("bpr_e")))
    # Service lines count from each claim on.
    s = s.withColumn("line", F.col("lines") - F.coalesce(carried(F.when(tag.isin("BPR", "CLP"), F.col("lines")), upto, F.col("lines")), F.lit(0)))
    number = F.when(F.col("line") > 0, F.col("line").cast("string")).otherwise(none)
    scope = F.when(F.col("line") > 0, "service_line").when(F.col("claim") != "", "claim").otherwise("transaction")
    remit = [("remittance_id", F.col("remittance"))]
    claim = phi.token("claim_id", "claim_id", F.col("claim"), F.col("claim_token"))
    b = lambda n: F.when(F.col("bpr").isNotNull(), F.coalesce(F.get("bpr", F.lit(n - 1)), none))
    org = F.when(el(1) == "PE", "provider_id").when(el(1) == "PR", "payer_id").otherwise("unknown")
    triples = F.when(F.size("e") > 1, F.sequence(F.lit(0), F.floor((F.size("e") - 2) / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    nth = lambda k: F.transform(triples, lambda i: F.coalesce(F.get("e", i * 3 + k), none))
    qualifier, code = fx.remitted_procedure(el(1), mark)
    ref = lambda ns: [*remit, *claim, ("entity_type", el(2)), *phi.only("last_name_or_org", el(3)), *phi.only("first_name", el(4)), ("id_qualifier", el(8)), *phi.token("id_value", ns, el(9))]
    names = ("claim_status_code", "total_charge_amount", "paid_amount", "patient_responsibility_amount", "claim_filing_indicator_code")
    return _emit(
        s,
        [
            event(
                "RemittanceAdviceObserved", tag == "TRN",
                [*remit, ("trace_number", el(2)), ("trace_type_code", el(1)), ("originating_company_id", el(3)), ("transaction_handling_code", b(1)), ("payment_amount", b(2)), ("credit_debit_flag", b(3)), ("payment_method_code", b(4)), ("payment_date", b(16))],
            ),
            event("RemittancePartyReferenced", tag == "N1", [*remit, ("entity_identifier_code", el(1)), *phi.only("name", el(2)), ("id_qualifier", el(3)), *phi.token("id_value", org, el(4))]),
            event(
                "RemittanceClaimPaymentObserved", tag == "CLP",
                [*claim, *remit, *((n, el(k)) for k, n in enumerate(names, 2)), *phi.token("payer_claim_control_number", "payer_claim_control_number", el(7)), ("facility_type_code", el(8)), ("claim_frequency_type_code", el(9))],
            ),
            event("RemittanceClaimReferencedPatient", (tag == "NM1") & (el(1) == "QC"), ref("patient_id")),
            event("RemittanceClaimReferencedSubscriber", (tag == "NM1") & (el(1) == "IL"), ref("member_id")),
            event(
                "RemittanceServiceLinePaymentObserved", tag == "SVC",
                [*claim, *remit, ("service_line_number", number), ("procedure_code_qualifier", qualifier), ("procedure_code_set", fx.code_set(qualifier)), ("procedure_code", code), ("line_charge_amount", el(2)), ("line_paid_amount", el(3)), ("paid_service_unit_count", el(5))],
            ),
            event("RemittanceAdjustmentObserved", tag == "CAS", [*claim, *remit, ("adjustment_scope", scope), ("service_line_number", number), ("adjustment_group_code", el(1))], [("reason_codes", nth(1)), ("amounts", nth(2)), ("quantities", nth(3))]),
            event("RemittanceDateRecorded", tag == "DTM", [*remit, *claim, ("date_scope", scope), ("service_line_number", number), ("date_qualifier", el(1)), ("date_value", el(2))]),
        ],
        part=part,
    )


def _resets_837() -> tuple:
    """(nm1, hl20, reset) of 837 segments: a test for an NM1's code, the billing loop's HL, and what ends a claim."""
    tag, q = F.col("tag"), el(1)
    nm1 = lambda *codes: (tag == "NM1") & q.isin(*codes)
    hl20 = (tag == "HL") & (el(3) == "20")
    return nm1, hl20, hl20 | nm1("IL", "QC", "85") | tag.isin("SBR", "PAT")


def _ahead_837(by, key: str | None) -> list[Column]:
    upto, before = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(W.unboundedPreceding, -1)
    tag, none, q = F.col("tag"), F.lit(""), el(1)
    nm1, hl20, reset = _resets_837()
    so_far = lambda when: F.sum(when.cast("long")).over(upto)
    return [
        # The token is made where the claim begins, and carried.
        *(filled(F.when(reset, none).when(tag == "CLM", c), upto).alias(f"837_{n}") for n, c in (("claim", el(1)), ("claim_token", token("claim_id", el(1), key)))),
        carried(F.when(nm1("85"), F.lit(True)).when(hl20, F.lit(False)), upto, F.lit(False)).alias("837_billed"), F.coalesce(F.lag("tag").over(by) == "CLM", F.lit(False)).alias("837_after_clm"),
        filled(F.when(reset | (tag == "CLM"), none).when(tag == "LX", el(1)), upto).alias("837_line"),
        F.coalesce(carried(F.when(reset | (tag == "CLM"), F.lit(False)).when(tag.isin("LX", "SV1", "SV2"), F.lit(True)), upto, F.lit(False)), F.lit(False)).alias("837_in_line"),
        # The party whose demographics come next; without one they are a subscriber's.
        filled(F.when(hl20 | nm1("85"), F.lit("none")).when(nm1("IL") | (tag == "SBR"), F.lit("subscriber")).when(nm1("QC") | (tag == "PAT"), F.lit("patient")), upto).alias("837_party"),
        # The provider a PRV speaks of: that of the last provider NM1, unless a party or loop came since.
        filled(F.when(reset & ~nm1("85"), none).when(tag == "NM1", fx.lookup(fx.NM1_CONTEXTS, q, None)), before).alias("837_nm1_provider"),
        # Billing loops so far, and these or billing providers.
        so_far(hl20 | (tag == "ST")).alias("837_loops"), so_far(hl20 | nm1("85") | (tag == "ST")).alias("837_gaps"),
    ]


def map_837(segs: DataFrame, phi: Phi, part: str | None = None) -> DataFrame:
    by, upto = _window(segs)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    tag, none, mark = F.col("tag"), F.lit(""), F.col("component")
    q = el(1)
    nm1, hl20, reset = _resets_837()

    def held(name: str, put: Column, clear: Column) -> list[Column]:
        """The last segment put and not cleared since, as columns name_i (below 0: none), name_o and name_e; a cleared one's elements are none, as every row carries them."""
        either = lambda c: F.when(put | clear, c)
        nothing = F.array().cast("array<string>")
        return [
            carried(F.when(put, F.col("segment_index")).when(clear, F.lit(-1)), upto, F.lit(-1)).alias(f"{name}_i"),
            carried(either(F.col("byte_offset")), upto, F.col("byte_offset")).alias(f"{name}_o"), carried(F.when(put, F.col("e")).when(clear, nothing), upto, nothing).alias(f"{name}_e"),
        ]

    # All that needs nothing but the segments is in one window; each further one copies every row.
    s = _with_ahead(segs, "837", _ahead_837, by, phi.key)
    provider = F.when(F.col("nm1_provider") != "", F.col("nm1_provider")).otherwise(fx.lookup(fx.PRV_CONTEXTS, q))
    s = s.withColumn("provider", F.when(tag == "PRV", provider))
    # Later PRVs follow an earlier one's context until the next provider or party.
    earlier = filled(F.when(reset & ~nm1("85"), none).when(tag == "NM1", fx.lookup(fx.NM1_CONTEXTS, q, None)).when((tag == "PRV") & ((F.col("provider") == "billing_provider") | (F.col("claim") == "")), F.col("provider")), before)
    s = s.withColumn("earlier", earlier).withColumn("provider", F.when(tag == "PRV", F.when(F.col("earlier") != "", F.col("earlier")).otherwise(F.col("provider"))))
    prv_billing = (tag == "PRV") & (F.col("provider") == "billing_provider")
    prv_rendering = (tag == "PRV") & (F.col("provider") == "rendering_provider") & (F.col("claim") == "")
    waits = prv_billing & (~F.coalesce(F.col("billed"), F.lit(False)) | (F.col("claim") != ""))
    demographic = (tag == "DMG") & (F.col("claim") == "")
    clear_both = hl20 | nm1("85")
    last = lambda when, c: F.last(F.when(when, F.col(c)), ignorenulls=True).over(upto)
    s = s.select(
        "*",
        *held("billing", nm1("85"), hl20),
        *(last(prv_billing, c).alias(f"tax_{n}") for n, c in (("i", "segment_index"), ("o", "byte_offset"), ("e", "e"), ("loops", "loops"), ("gaps", "gaps"))), last(waits, "gaps").alias("tax_waits"),
        *held("subscriber", nm1("IL"), clear_both),
        *held("patient", nm1("QC"), clear_both | nm1("IL")),
        *held("rendering", nm1("82") & (F.col("claim") == ""), reset | F.col("after_clm")),
        *held("rendering_tax", prv_rendering, reset | F.col("after_clm")),
        *held("sbr", tag == "SBR", clear_both),
        *held("sbr_dmg", demographic & (F.col("party") != "patient"), clear_both | (tag == "SBR")),
        *held("pat", tag == "PAT", clear_both | nm1("IL") | (tag == "SBR")),
        *held("pat_dmg", demographic & (F.col("party") == "patient"), clear_both | nm1("IL") | tag.isin("SBR", "PAT")),
    )
    # A taxonomy that waits for its provider's NM1, the next one in its loop, survives that NM1; any other one is dropped there.
    here = (F.col("gaps") == F.col("tax_gaps")) | (F.col("gaps") == F.col("tax_gaps") + 1) & (F.col("tax_waits") == F.col("tax_gaps"))
    s = s.withColumn("billing_tax_i", F.when(here & (F.col("loops") == F.col("tax_loops")), F.col("tax_i")).otherwise(F.lit(-1))).withColumnsRenamed({"tax_o": "billing_tax_o", "tax_e": "billing_tax_e"})
    clm = tag == "CLM"
    there = lambda c: clm & (F.coalesce(F.col(f"{c}_i"), F.lit(-1)) >= 0)
    scope = F.when(F.col("claim") == "", "transaction").when(F.col("in_line"), "service_line").otherwise("claim")
    claim = phi.token("claim_id", "claim_id", F.col("claim"), F.col("claim_token"))
    where = [("reference_scope", scope), ("service_line_number", F.col("line"))]

    def person(ns: str, e: Column) -> list:
        return [*claim, *where, ("entity_type", el(2, e)), *phi.only("last_name_or_org", el(3, e)), *phi.only("first_name", el(4, e)), ("id_qualifier", el(8, e)), *phi.token("id_value", ns, el(9, e))]

    def taxonomy(context, e: Column) -> list:
        return [*claim, *where, ("provider_context", F.lit(context) if isinstance(context, str) else context), ("provider_role_code", el(1, e)), ("reference_identification_qualifier", el(2, e)), ("provider_taxonomy_code", el(3, e))]

    def demographics(who, e: Column) -> list:
        return [*claim, ("party_scope", F.lit(who) if isinstance(who, str) else who), ("date_format", el(1, e)), *phi.token("date_of_birth", "member_dob", el(2, e)), ("gender_code", el(3, e))]

    def sbr(e: Column) -> list:
        return [*claim, ("party_scope", F.lit("subscriber")), ("payer_responsibility_sequence_number_code", el(1, e)), ("individual_relationship_code", el(2, e)), *phi.token("insured_group_or_policy_number", "reference_id", el(3, e)), ("claim_filing_indicator_code", el(9, e))]

    f5 = fx.components(el(5), mark)
    hi = F.filter(F.transform("e", lambda x: F.call_function("split", x, fx.quoted(mark), F.lit(-1))), lambda c: F.coalesce(F.get(c, F.lit(0)), none) != "")
    dx = lambda *qs: F.transform(F.filter(hi, lambda c: c[0].isin(*qs)), lambda c: fx.diagnosis(fx.part(c, 2)))
    principal = dx("ABK", "BK")
    shift = F.when(tag == "SV2", F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0)))).otherwise(F.col("e"))
    pq, pc, pm = fx.procedure(el(1, shift), mark)
    pointers = F.when(tag == "SV1", F.filter(F.slice(fx.components(el(7), mark), 1, 4), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    in_claim = F.col("claim") != ""
    codes = F.transform(
        hi,
        lambda c: F.struct(
            fx.lookup(fx.CODE_KINDS, c[0], "other").alias("kind"), c[0].alias("qualifier"),
            F.when(c[0].isin("ABK", "BK", "ABF", "BF"), fx.diagnosis(fx.part(c, 2))).otherwise(fx.part(c, 2)).alias("code"),
            fx.part(c, 3).alias("date_format"), fx.part(c, 4).alias("date_value"), fx.part(c, 5).alias("amount"), F.slice(c, 1, 8).alias("components"),
        ),
    )
    roles = {"DN": "Referring", "DQ": "Supervising", "77": "Facility", "71": "Attending", "72": "Operating", "ZZ": "Other"}
    others = fx.lookup({k: "ClaimReferenced" + (v if v == "Facility" else v + "Provider") for k, v in roles.items()}, q, None)
    S = F.col
    spot = lambda n: {"i": S(f"{n}_i"), "o": S(f"{n}_o")}
    s = s.withColumn("codes", F.when(tag == "HI", codes))
    # Codes follow their segment's diagnoses, the only other event of it, in the order of the elements.
    c = F.get("codes", S("emitted") - 1)
    coded = [*claim, ("healthcare_code_kind", c["kind"]), ("healthcare_code_qualifier", c["qualifier"]), ("healthcare_code", c["code"]), ("healthcare_code_date_format", c["date_format"]), ("healthcare_code_date_value", c["date_value"]), ("healthcare_code_amount", c["amount"])]
    return _emit(
        s,
        [
            event(
                "ClaimObserved", clm,
                [*claim, ("total_charge_amount", el(2)), ("facility_type_code", fx.part(f5, 1)), ("facility_code_qualifier", fx.part(f5, 2)), ("claim_frequency_type_code", fx.part(f5, 3)),
                 *((n, el(k)) for k, n in enumerate(("provider_signature_indicator", "assignment_or_plan_participation_code", "benefits_assignment_certification_indicator", "release_of_information_code", "patient_signature_source_code"), 6))],
            ),
            event("ClaimSubscriberInformationRecorded", there("sbr"), sbr(S("sbr_e")), at=spot("sbr")),
            event("ClaimDemographicsRecorded", there("sbr_dmg"), demographics("subscriber", S("sbr_dmg_e")), at=spot("sbr_dmg")),
            event("ClaimPatientInformationRecorded", there("pat"), [*claim, ("party_scope", F.lit("patient")), ("individual_relationship_code", el(1, S("pat_e")))], at=spot("pat")),
            event("ClaimDemographicsRecorded", there("pat_dmg"), demographics("patient", S("pat_dmg_e")), at=spot("pat_dmg")),
            event("ClaimReferencedBillingProvider", there("billing"), person("provider_id", S("billing_e")), at=spot("billing")),
            event("ClaimReferencedSubscriber", there("subscriber"), person("member_id", S("subscriber_e")), at=spot("subscriber")),
            event("ClaimReferencedPatient", there("patient"), person("patient_id", S("patient_e")), at=spot("patient")),
            event("ClaimReferencedRenderingProvider", there("rendering"), person("provider_id", S("rendering_e")), at=spot("rendering")),
            event("ClaimProviderTaxonomyRecorded", there("billing_tax"), taxonomy("billing_provider", S("billing_tax_e")), at=spot("billing_tax")),
            event("ClaimProviderTaxonomyRecorded", there("rendering_tax"), taxonomy("rendering_provider", S("rendering_tax_e")), at=spot("rendering_tax")),
            event("ClaimReferencedRenderingProvider", nm1("82") & in_claim, person("provider_id", S("e"))),
            event(others, nm1(*roles) & in_claim, person("provider_id", S("e"))),
            event("ClaimProviderTaxonomyRecorded", (tag == "PRV") & in_claim & (S("provider") != "billing_provider"), taxonomy(S("provider"), S("e"))),
            event("ClaimDemographicsRecorded", (tag == "DMG") & in_claim, demographics(F.when(S("party") == "patient", "patient").otherwise("subscriber"), S("e"))),
            event("ClaimReferenceRecorded", (tag == "REF") & in_claim, [*claim, *where, ("reference_qualifier", q), *phi.token("reference_identification", "reference_id", el(2))]),
            event("ClaimInstitutionalInformationRecorded", tag == "CL1", [*claim, ("admission_type_code", q), ("admission_source_code", el(2)), ("patient_status_code", el(3))], _raw()),
            event(F.when(S("in_line"), "ClaimLineDateRecorded").otherwise("ClaimDateRecorded"), tag == "DTP", [*claim, ("date_scope", scope), ("service_line_number", S("line")), ("date_qualifier", q), ("date_format", el(2)), ("date_value", el(3))]),
            event("ClaimDiagnosesRecorded", tag == "HI", [*claim, ("principal_diagnosis_code", F.coalesce(F.try_element_at(principal, F.lit(-1)), none))], [("other_diagnosis_codes", dx("ABF", "BF")), ("raw_diagnosis_elements", S("e"))]),
            event(
                "ClaimServiceLineRecorded", tag.isin("SV1", "SV2"),
                [*claim, ("line_type", tag), ("service_line_number", S("line")), ("revenue_code", F.when(tag == "SV2", el(1)).otherwise(none)), ("procedure_code_qualifier", pq), ("procedure_code_set", fx.code_set(pq)), ("procedure_code", pc),
                 ("charge_amount", el(2, shift)), ("unit_measure_code", el(3, shift)), ("unit_count", el(4, shift))],
                [("procedure_modifiers", pm), ("diagnosis_pointers", pointers), *_raw()],
            ),
            event("ClaimHealthcareCodeRecorded", tag == "HI", coded, [("healthcare_code_components", c["components"])]),
        ],
        F.when(tag == "HI", F.size("codes")).otherwise(0),
        part,
    )


def journal_rows(segs: DataFrame, include_phi: bool = False, key: str | None = None, run_id: str | None = None, kinds: tuple = ("270", "271", "834", "835", "837"), part: str | None = None) -> DataFrame:
    """The journal's rows with a column f_name or l_name beside the maps for each field and list, of which those not read cost nothing; and the documents' shard, if any.

    part: only the events that begin claims ("opening"), or only those of their own segment and with no more of their kind in it ("own": whatever
    is held for a claim comes with its opening, a code with its diagnoses, so none of claims, drops and envelopes is missed). They have no seq and no event_id.
    """
    phi, out = Phi(include_phi, key), None
    # The JVM never compiles methods of over 8000 bytes; stages with such ones are made of smaller ones instead.
    segs.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    known = ("270", "271", "834", "835", "837")
    # A segment of a type without a mapper is an error, not a silent gap.
    odd = F.concat(F.lit("unsupported transaction type "), F.col("source_transaction"))
    kind_of = F.when(F.col("source_transaction").isin(*known), F.col("source_transaction")).otherwise(F.raise_error(odd))
    for kind in kinds:
        own = segs.where(kind_of == kind)
        if part and kind not in ("835", "837"):
            raise ValueError(f"no part of type {kind}")
        got = map_834(own, phi) if kind == "834" else {"835": map_835, "837": map_837}[kind](own, phi, part) if kind[0] == "8" else map_27x(own, phi, kind)
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    drop = F.when((F.col("isa13") != "") & (F.col("gs06") != "") & (F.col("st02") != ""), F.concat_ws(":", "source_transaction", "isa13", "gs06", "st02"))
    out = out.withColumn("segment_id", F.concat_ws("/", "source_transaction", "source_file"))
    # 128 bits; the drop is part of it, as another file may come under a name that was there before.
    name = F.md5(F.concat_ws("|", "segment_id", F.col("seq").cast("string"), F.coalesce(drop, F.lit(""))).cast("binary"))
    return out.select(
        "segment_id", "seq", F.concat(F.lit("ev:"), name).alias("event_id"), "event_type", "source_file", "source_transaction", "input_ordinal",
        drop.alias("source_drop_id"), F.lit(run_id).cast("string").alias("run_id"), "source_segment_index", "source_byte_offset", "isa13", "gs06", "st02", "payload", "arrays",
        *(c for c in out.columns if c == "shard" or c.startswith(("f_", "l_", "o_"))),
    )


def journal_events(segs: DataFrame, include_phi: bool = False, key: str | None = None, run_id: str | None = None, kinds: tuple = ("270", "271", "834", "835", "837")) -> DataFrame:
    """The journal's rows for segments of any mix of types, numbered within each document."""
    rows = journal_rows(segs, include_phi, key, run_id, kinds)
    return rows.drop(*(c for c in rows.columns if c == "shard" or c.startswith(("f_", "l_", "o_"))))


def fields(journal: DataFrame):
    """How to read a field, or a list if asked, of the journal's rows: by its column if journal_rows made them, else from the maps."""
    there = set(journal.columns)
    wide = any(c.startswith("f_") for c in there)

    def read(name: str, listed: bool = False) -> Column:
        column = f"{'l' if listed else 'f'}_{name}"
        if column in there:
            return F.col(column)
        if wide:
            return F.lit(None).cast("array<string>" if listed else "string")
        return F.col("arrays" if listed else "payload")[name]

    return read
