"""Learning units and tasks: bundles, drafts, reviews, revisions, refresh plans, comparisons and closing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import has_machine_path
from lodeworks.operators.quality import ratio
from lodeworks.operators.ranking import budget_prefix, ranked


def topics(seeds: DataFrame, symbols: DataFrame, components: DataFrame, units: DataFrame, commit: str) -> DataFrame:
    """Seeds (id, title, names, priority) with their symbols and components by name, and whether a unit of the commit covers the title.

    Names are exploded and joined by equality.
    """
    named = seeds.select("id", F.explode("names").alias("_name"))
    ids = lambda df, out: named.join(df.select(F.col("name").alias("_name"), F.col("id").alias("_id")), "_name").groupBy("id").agg(F.array_sort(F.collect_set("_id")).alias(out))
    done = units.filter(F.col("commit") == commit).select("title").distinct().withColumn("covered", F.lit(True))
    out = seeds.join(ids(symbols, "symbol_ids"), "id", "left").join(ids(components, "component_ids"), "id", "left").join(done, "title", "left")
    none = F.array().cast("array<string>")
    out = out.select("id", "title", "priority", F.coalesce("symbol_ids", none).alias("symbol_ids"), F.coalesce("component_ids", none).alias("component_ids"), F.coalesce("covered", F.lit(False)).alias("covered"))
    return out.orderBy(F.col("priority").desc(), "id")


def bundle(snippets: DataFrame, group: str, order: list[Column], budget: int = 4000) -> DataFrame:
    """Each group's snippets (text) by order while their token estimates fit the budget; at least one stays."""
    return budget_prefix(snippets, [group], order, F.ceil(F.length("text") / 4), budget, separator=0)


def claim_faults(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(unit_id, fault, n) of claims (unit_id, id, text, evidence_ids): no evidence, evidence that isn't there, and repeated ids."""
    named = claims.select("unit_id", "id", F.explode("evidence_ids").alias("evidence_id"))
    label = lambda df, fault: df.groupBy("unit_id").agg(F.count("*").alias("n")).select("unit_id", F.lit(fault).alias("fault"), "n")
    none = claims.filter(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0)
    lost = named.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")
    twice = claims.groupBy("unit_id", "id").count().filter("count > 1")
    return label(none, "no-evidence").unionByName(label(lost, "unknown-evidence")).unionByName(label(twice, "repeated-id"))


#: The most bytes of a draft, and what an evidence id of a verified claim holds. Fixed values.
MOST_DRAFT_BYTES, VERIFIED_BY = 80 << 10, "run|task|E"


def draft_faults(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, code, n) of drafts as they came in; drafts without a row may be imported.

    drafts: draft_id, bundle_id, raw (text of one JSON object). evidence: bundle_id, id. The first of these is reported
    alone: OUTPUT_TOO_LARGE, INVALID_JSON (null and empty texts too), ABSOLUTE_PATH, SCHEMA_INVALID (no list of claims),
    BUNDLE_MISMATCH. Of drafts that pass these, all of: REPEATED_CLAIM, NO_EVIDENCE, UNKNOWN_EVIDENCE (evidence of another
    bundle doesn't count) and UNCHECKED (a verified claim without evidence of a run or a task), with their counts.
    """
    json = F.try_parse_json("raw")
    rows = drafts.withColumn("_claims", F.try_variant_get(json, "$.claims", "array<struct<id string, status string, evidenceIds array<string>>>"))
    fits = F.try_variant_get(json, "$.sourceBundleId", "string").eqNullSafe(F.col("bundle_id")) & F.col("bundle_id").isNotNull()
    code = (F.when(F.octet_length("raw") > MOST_DRAFT_BYTES, "OUTPUT_TOO_LARGE").when(json.isNull(), "INVALID_JSON").when(has_machine_path(F.col("raw")), "ABSOLUTE_PATH")
            .when(F.col("_claims").isNull(), "SCHEMA_INVALID").when(~fits, "BUNDLE_MISMATCH"))
    rows = rows.select("draft_id", "bundle_id", "_claims", code.alias("code"))
    refused = rows.filter("code is not null").select("draft_id", "code", F.lit(1).cast("long").alias("n"))
    claims = rows.filter("code is null").select("draft_id", "bundle_id", F.inline("_claims")).withColumn("evidenceIds", F.coalesce("evidenceIds", F.array().cast("array<string>")))
    named = claims.select("draft_id", "bundle_id", F.explode("evidenceIds").alias("id"))
    lost = named.join(evidence.select("bundle_id", "id"), ["bundle_id", "id"], "left_anti")
    label = lambda df, fault: df.groupBy("draft_id").agg(F.lit(fault).alias("code"), F.count("*").alias("n"))
    twice = claims.groupBy("draft_id", "id").count().filter("count > 1")
    unchecked = claims.filter((F.col("status") == "verified") & ~F.exists("evidenceIds", lambda x: F.coalesce(x.rlike(VERIFIED_BY), F.lit(False))))
    found = {"REPEATED_CLAIM": twice, "NO_EVIDENCE": claims.filter(F.size("evidenceIds") == 0), "UNKNOWN_EVIDENCE": lost, "UNCHECKED": unchecked}
    for fault, df in found.items():
        refused = refused.unionByName(label(df, fault))
    return refused


def publishable(claims: DataFrame, approvals: DataFrame) -> DataFrame:
    """(unit_id, publishable): no claim is inferred or rejected, and each is approved."""
    ok = approvals.select("unit_id", F.col("claim_id").alias("id")).distinct().withColumn("_ok", F.lit(True))
    rows = claims.join(ok, ["unit_id", "id"], "left")
    return rows.groupBy("unit_id").agg(F.bool_and(F.coalesce("_ok", F.lit(False)) & ~F.col("status").isin("inferred", "rejected")).alias("publishable"))


def revised(units: DataFrame, changes: DataFrame) -> DataFrame:
    """units (id, revision, status, commit) with appended revisions for changes (id, action, commit): supersede, retire, carry_forward.

    Rows are never updated: a change makes a new revision after the last one.
    """
    last = units.groupBy("id").agg(F.max("revision").alias("revision"), F.max_by("commit", "revision").alias("_was"))
    status = F.when(F.col("action") == "supersede", "superseded").when(F.col("action") == "retire", "retired").otherwise("published")
    new = changes.join(last, "id").select("id", (F.col("revision") + 1).alias("revision"), status.alias("status"), F.when(F.col("action") == "carry_forward", F.col("commit")).otherwise(F.col("_was")).alias("commit"))
    return units.select("id", "revision", "status", "commit").unionByName(new)


def current(units: DataFrame) -> DataFrame:
    """The last revision of each unit."""
    return units.groupBy("id").agg(F.max_by(F.struct("status", "commit"), "revision").alias("_u"), F.max("revision").alias("revision")).select("id", "revision", "_u.status", "_u.commit")


def may_carry_forward(claims: DataFrame) -> DataFrame:
    """Units without a verified claim: verified claims must be checked again instead."""
    return claims.groupBy("unit_id").agg((F.count_if(F.col("status") == "verified") == 0).alias("allowed"))


def refresh_plan(impacts: DataFrame) -> DataFrame:
    """Affected units (unit_id, state) in order, with priority 100 for the first and one less for each further one."""
    rows = impacts.filter(F.col("state").isin("stale", "partially_stale"))
    return ranked(rows, [F.col("state") != "stale", F.col("unit_id")], "_place").withColumn("priority", 101 - F.col("_place")).drop("_place")


def coverage(units: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, covered, total, ratio): how many keys of each dimension a unit's array column of the same name holds."""
    out = None
    for kind, (df, key) in dims.items():
        hit = units.select(F.explode(kind).alias(key)).distinct().withColumn("_hit", F.lit(1))
        row = df.select(key).distinct().join(hit, key, "left").agg(F.count("_hit").alias("covered"), F.count("*").alias("total"))
        row = row.select(F.lit(kind).alias("kind"), "covered", "total", ratio(F.col("covered"), F.col("total"), 0.0).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def bad_families(reviews: DataFrame, families: DataFrame) -> DataFrame:
    """Reviews (family_id, included) that include what isn't a member."""
    both = reviews.join(families.select("family_id", "members"), "family_id", "left")
    return both.withColumn("strangers", F.array_except("included", F.coalesce("members", F.array().cast("array<string>")))).filter(F.size("strangers") > 0)


def comparison(base: DataFrame, now: DataFrame) -> DataFrame:
    """One row for two sets of error fingerprints with blocking flags: new, resolved, unchanged and a conclusion."""
    a = base.groupBy("fingerprint").agg(F.bool_or("blocking").alias("_a"))
    b = now.groupBy("fingerprint").agg(F.bool_or("blocking").alias("_b"))
    s = a.join(b, "fingerprint", "full_outer").agg(F.count_if(F.col("_a").isNull()).alias("new"), F.count_if(F.col("_b").isNull()).alias("resolved"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("unchanged"), F.count_if(F.col("_a").isNull() & F.col("_b")).alias("new_blocking"))
    end = F.when(F.col("new_blocking") > 0, "regressed").when((F.col("resolved") > 0) & (F.col("new") == 0), "improved").when(F.col("new") > 0, "changed").otherwise("unchanged")
    return s.withColumn("conclusion", end)


def closable(criteria: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(task_id, accepted): each required automated criterion passed, and each manual one is confirmed."""
    ok = confirmed.select("task_id", "id").distinct().withColumn("_ok", F.lit(True))
    rows = criteria.join(ok, ["task_id", "id"], "left")
    fine = F.when(F.col("automated"), ~F.col("required") | (F.col("status") == "passed")).otherwise(F.coalesce("_ok", F.lit(False)))
    return rows.groupBy("task_id").agg(F.bool_and(fine).alias("accepted"))


def version_binding(catalogs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Catalog and symbol snapshots (id, commit, root_hash; the symbols' catalog_hash) of one commit, and whether they fit."""
    c = catalogs.select(F.col("id").alias("catalog_id"), "commit", F.col("root_hash").alias("_hash"))
    s = symbols.select(F.col("id").alias("symbol_id"), "commit", "catalog_hash")
    return c.join(s, "commit").select("commit", "catalog_id", "symbol_id", F.col("_hash").eqNullSafe(F.col("catalog_hash")).alias("consistent"))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, report: a Markdown table of a small result. Rows are numbered by order, so it is for reports and not for data."""
    cell = lambda c: F.coalesce(F.replace(F.regexp_replace(F.col(c).cast("string"), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    rows = df.select(F.struct(*order, line.alias("_line")).alias("_s"))
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["_line"]), "\n")).alias("report"))
