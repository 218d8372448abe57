"""The review status of a row: automatic fixes, final status, retries, approvals, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.copywriting import claims_warranty, is_boilerplate
from shelfmark.functions.names import identity_tokens, is_subset, plain_tokens
from shelfmark.functions.text import contains_any, filled, is_blank, strip, strip_brand_prefix
from shelfmark.operators.ranking import with_group_count
from shelfmark.operators.resolve import in_scope

CONTRADICTIONS = [
    "qualifier token mismatch", "capacity mismatch", "duplicate image asset", "image filename mismatch", "fatal bug",
    "corrupted image",
]
WRONG_PRODUCT = ["qualifier token mismatch", "capacity mismatch", "slug numeric token mismatch"]
COLLECTED = [f"{part}_{f}" for f in fixed.PROVENANCE_FIELDS for part in ("Raw", "Source", "Tier")]


def _any_flag(words: list[str], low: bool = True) -> Column:
    return F.exists("hard_flags", lambda f: contains_any(F.lower(f) if low else f, words))


def _nulls(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: F.lit(None).cast(df.schema[c].dataType) for c in columns}


# --- fixes --------------------------------------------------------------------------------------------


def which_fix() -> Column:
    """The one fix an attempt applies; the order matters."""
    return (
        F.when(_any_flag(["exceeds 60-character"], low=False), F.lit("long_bullets"))
        .when(_any_flag(["Boilerplate detected", "Disallowed warranty claim"], low=False), F.lit("bad_bullets"))
        .when(_any_flag(["mismatch"]), F.lit("mismatch"))
    )


def shortened_bullet(bullet: Column) -> Column:
    """At most 60 characters, cut back to the last space if there is one."""
    text = strip(bullet)
    return F.when(F.length(text) > 60, F.regexp_replace(F.substring(text, 1, 60), " [^ ]*$", "")).otherwise(bullet)


def apply_fix(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """One attempt's fix on validated rows: adds fix, needs_rematch and, for a wrong page, rejected_url and its reason."""
    df = df.withColumn("fix", which_fix())
    out: dict[str, Column] = {}
    for name in fixed.BULLETS:
        raw = F.col(f"Raw_{name}")
        text = strip(raw)
        bad = (F.col("fix") == "bad_bullets") & ~is_blank(raw) & (
            is_boilerplate(text) | claims_warranty(text, strict_reference))
        gone = F.coalesce(bad, F.lit(False))
        out[f"Raw_{name}"] = F.when(gone, F.lit(None)).when(F.col("fix") == "long_bullets", shortened_bullet(raw)).otherwise(raw)
        for part in ("Source", "Tier"):
            out[f"{part}_{name}"] = F.when(~gone, F.col(f"{part}_{name}"))
    wrong = F.filter("hard_flags", lambda f: contains_any(F.lower(f), WRONG_PRODUCT))
    rejects = (F.col("fix") == "mismatch") & (F.size(wrong) > 0) & F.col("Source_URL").startswith("http")
    out["needs_rematch"] = F.coalesce(F.col("fix") == "mismatch", F.lit(False))
    out["rejected_url"] = F.when(rejects, strip(F.col("Source_URL")))
    out["rejected_reason"] = F.when(rejects, F.concat(F.lit("review: "), F.substring(F.array_join(wrong, ", "), 1, 120)))
    return df.withColumns(out)


def is_contradiction() -> Column:
    """Wrong product rather than missing data?"""
    return _any_flag(CONTRADICTIONS)


def clear_collected(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Forget everything collected (overrides stay), on all rows or where the condition holds."""
    columns = COLLECTED + ["Source_URL", "Source_Audit", "Image_URL"]
    if when is None:
        return df.withColumns(_nulls(df, columns))
    return df.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def final_status(df: DataFrame) -> DataFrame:
    """Status and Flags after the last attempt; df is validated."""
    untouched = F.coalesce(F.col("Status").isin("Approved", "Skipped"), F.lit(False))
    deferred = F.coalesce(F.col("Status") == "Deferred", F.lit(False))
    failed = ~untouched & ~deferred & ~F.col("is_passed")
    listed = F.array_join("hard_flags", ", ")
    status = (
        F.when(untouched | deferred, F.col("Status")).when(F.col("is_passed"), F.lit("Ready_For_Review"))
        .when(is_contradiction(), F.lit("Blocked")).otherwise(F.lit("Skipped"))
    )
    flags = (
        F.when(untouched | deferred, F.col("Flags"))
        .when(F.col("is_passed"), F.nullif(F.array_join("warnings", "\n"), F.lit("")))
        .when(is_contradiction(), F.concat(F.lit("Hard Block: "), listed))
        .otherwise(F.concat(F.lit("Skipped: "), listed))
    )
    df = df.withColumns({"_status": status, "_flags": flags, "_failed": failed})
    df = clear_collected(df, F.col("_failed"))
    return df.withColumns({"Status": F.col("_status"), "Flags": F.col("_flags")}).drop("_status", "_flags", "_failed")


def review(df: DataFrame, validate, attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Up to three rounds of validate and fix, then the final status.

    validate adds hard_flags, warnings and is_passed to a catalogue with its facts attached; it is row-local, so the
    rounds add no shuffle. Rows that need another page end here as failed with needs_rematch set, and are matched anew
    by the caller.
    """
    settled = F.coalesce(F.col("Status").isin("Approved", "Skipped", "Deferred"), F.lit(False))
    df = df.withColumns({
        "Attempts": F.coalesce("Attempts", F.lit(0)), "_settled": settled, "_open": ~settled,
        "needs_rematch": F.lit(False), "rejected_url": F.lit(None).cast("string"),
        "rejected_reason": F.lit(None).cast("string"),
        "hard_flags": F.array(F.coalesce(filled(F.col("Flags")), F.lit("Initial validation required"))),
        "warnings": F.array().cast("array<string>"), "is_passed": F.lit(False),
    })
    kept = df.columns
    for _ in range(attempts):
        before = df.withColumnsRenamed({c: f"_was_{c}" for c in ("hard_flags", "warnings", "is_passed")})
        tried = F.col("_open") & (F.col("Attempts") < fixed.MAX_ATTEMPTS)
        df = validate(before.withColumn("_tried", tried))
        for c in ("hard_flags", "warnings", "is_passed"):
            df = df.withColumn(c, F.when(F.col("_tried"), F.col(c)).otherwise(F.col(f"_was_{c}")))
        fixing = F.col("_tried") & ~F.col("is_passed")
        fixed_rows = apply_fix(df.withColumnsRenamed({c: f"_was_{c}" for c in ("needs_rematch", "rejected_url", "rejected_reason")})
                               .withColumns({f"_old_{c}": F.col(c) for c in COLLECTED if "Bullet" in c}))
        updates = {c: F.when(fixing, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in COLLECTED if "Bullet" in c}
        for c in ("needs_rematch", "rejected_url", "rejected_reason"):
            updates[c] = F.when(fixing, F.col(c)).otherwise(F.col(f"_was_{c}"))
        updates["Attempts"] = F.when(F.col("_tried"), F.col("Attempts") + 1).otherwise(F.col("Attempts"))
        note = F.concat(F.lit("Attempt "), (F.col("Attempts") + 1).cast("string"), F.lit(": "), _fix_note())
        updates["Fix_Log"] = F.when(fixing, F.concat_ws("\n", filled(F.col("Fix_Log")), note)).otherwise(F.col("Fix_Log"))
        updates["_open"] = fixing & F.coalesce(F.col("fix").isin("long_bullets", "bad_bullets"), F.lit(False))
        df = fixed_rows.withColumns(updates).select(*kept)
    return final_status(df.drop("_settled", "_open"))


def _fix_note() -> Column:
    return (
        F.when(F.col("fix") == "long_bullets", F.lit("Truncated bullets to satisfy <=60 char limit"))
        .when(F.col("fix") == "bad_bullets", F.lit("Dropped invalid/warranty bullets (retaining verified bullets)"))
        .when(F.col("fix") == "mismatch", F.lit("Re-collection requested"))
        .otherwise(F.concat(F.lit("No automated fix available for flags: "), F.array_join("hard_flags", ", ")))
    )


# --- retries ------------------------------------------------------------------------------------------


def _reset_columns(df: DataFrame) -> dict[str, Column]:
    columns = COLLECTED + ["Source_URL", "Source_Audit", "Image_URL", "Image_Status", "Image_Source", "Image_Tier",
                           "Flags", "Fix_Log", "LLM_Provider"]
    lines = F.filter(F.split("Rejected_URLs", "\n"), lambda l: l.rlike(r"^\s*http.*? \| \s*(?:not_match|delisted)"))
    kept = F.nullif(F.array_join(F.transform(lines, strip), "\n"), F.lit(""))
    return {**_nulls(df, columns), "Attempts": F.lit(0), "Status": F.lit("Pending"), "Rejected_URLs": kept}


def reset_for_rerun(df: DataFrame) -> DataFrame:
    """Back to Pending with nothing collected; overrides stay, soft rejections are forgotten."""
    return df.withColumns(_reset_columns(df))


def select_retries(catalogue: DataFrame, brand: str | None = None, category: str | None = None,
                   product_ids: DataFrame | None = None) -> DataFrame:
    """The given products, else everything blocked, skipped or deferred."""
    rows = in_scope(catalogue, brand, category)
    if product_ids is None:
        return rows.where(F.col("Status").isin("Blocked", "Skipped", "Deferred"))
    wanted = product_ids.select(F.lower(strip("product_id")).alias("_id")).distinct()
    return rows.join(wanted, F.lower(F.col("Product_ID")) == F.col("_id"), "left_semi")


def select_collectable(catalogue: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """The given products, else all that are not yet approved or ready."""
    if product_ids is None:
        return catalogue.where(~F.coalesce(F.col("Status").isin("Approved", "Ready_For_Review"), F.lit(False)))
    wanted = product_ids.select(F.col("product_id").alias("_id")).distinct()
    return catalogue.join(wanted, F.col("Product_ID") == F.col("_id"), "left_semi")


# --- approval -----------------------------------------------------------------------------------------


def approve(rows: DataFrame, validate, brand: str | None = None, category: str | None = None,
            product_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changed, unchanged): approve the given products, else everything ready for review.

    Unresolved hard flags do not prevent approval, but are reported. rows is a catalogue with its facts attached and
    validate the rule set to report by.
    """
    rows = in_scope(rows, brand, category)
    pid = strip(F.coalesce("Product_ID", F.lit("")))
    current = strip(F.coalesce("Status", F.lit("Pending")))
    if product_ids is None:
        rows = rows.withColumn("_chosen", current == "Ready_For_Review")
        why = F.concat(F.lit("Current status is '"), current, F.lit("', not 'Ready_For_Review'"))
    else:
        wanted = product_ids.select(F.lower(strip("product_id")).alias("_id")).distinct()
        rows = rows.join(wanted, F.lower(pid) == F.col("_id"), "left").withColumn("_chosen", F.col("_id").isNotNull())
        why = F.lit("Product_ID not included in approve request list")
    chosen = rows.where("_chosen").withColumns({"from_status": current, "Status": F.lit("Approved")})
    changed = validate(chosen).select(
        pid.alias("product_id"), F.col("Model_Name").alias("model_name"), "from_status",
        F.col("Status").alias("to_status"), "hard_flags")
    unchanged = rows.where("not _chosen").select(
        pid.alias("product_id"), F.col("Model_Name").alias("model_name"), current.alias("status"), why.alias("reason"))
    return changed, unchanged


def set_status(catalogue: DataFrame, product_ids: DataFrame, status: str) -> DataFrame:
    """Set one status (Approved, Skipped) on the given products."""
    wanted = product_ids.select(F.lower(strip("product_id")).alias("_id")).distinct()
    joined = catalogue.join(wanted, F.lower(strip("Product_ID")) == F.col("_id"), "left")
    changed = F.when(F.col("_id").isNotNull(), F.lit(status)).otherwise(F.col("Status"))
    return joined.withColumn("Status", changed).drop("_id")


# --- reasons ------------------------------------------------------------------------------------------


def failure_reason() -> Column:
    """Why a row did not make it, in plain words; null for approved and ready rows. The order of the ladder matters."""
    status = strip(F.coalesce("Status", F.lit("")))
    raw = strip(F.coalesce("Flags", F.lit("")))
    low = F.lower(raw)
    both = F.concat_ws(" ", low, F.lower(strip(F.coalesce("Fix_Log", F.lit("")))))
    in_full = F.regexp_replace(raw, r"(?i)^(?:(?:Skipped|Blocked|Hard Block|Deferred)\s*:\s*)+", "")
    sentence = strip(F.substring_index(
        F.regexp_replace(raw, r"(?i)^(Skipped|Blocked|Hard Block|Deferred)\s*:\s*", ""), ".", 1))
    ladder = F.when(status.isin("Approved", "Ready_For_Review"), F.lit(None).cast("string")).when(
        contains_any(low, ["needs your pick", "verified as a different product"]), in_full)
    for words, text in (
        (["bot challenge", "403", "blocked by bot"], "Site blocked the request"),
        (["exceeded maximum retry", "attempts exhausted"], "Exceeded maximum retry attempts"),
        (["insufficient specs", "specs incomplete", "partial specs"], "Specs incomplete after all sources"),
        (["all spec tiers exhausted", "no verified technical specs"],
         "No technical specifications found across available sources"),
        (["no standalone listing", "bundled", "accessory"], "No standalone listing found"),
        (["delisted", "404", "not found"], "Product page delisted or not found"),
        (["duplicate"], "Duplicate product model"),
        (["image missing", "no image found"], "Product image not found after all tiers"),
    ):
        ladder = ladder.when(contains_any(both, words), F.lit(text))
    return (
        ladder.when(F.contains(F.lower(status), F.lit("deferred")) | F.contains(both, F.lit("manual review")),
                    F.lit("Deferred for manual verification"))
        .when(contains_any(both, ["semantic audit", "hallucination"]), F.lit("Failed automated semantic consistency check"))
        .when((raw != "") & ~low.isin("nan", "none", "clean", "-"),
              F.when(F.length(sentence) > 80, F.concat(F.substring(sentence, 1, 77), F.lit("..."))).otherwise(sentence))
        .otherwise(F.lit("Collection incomplete"))
    )


def enforce_display_names(sheet: DataFrame) -> DataFrame:
    """Short names must keep every identifying word and be distinct within a brand's sheet.

    sheet: brand_name, model_name, display_name.
    """
    plain = strip_brand_prefix(F.col("model_name"), F.col("brand_name"))
    shown = strip(F.coalesce("display_name", F.lit("")))
    keeps = is_subset(identity_tokens(F.col("model_name"), F.col("brand_name")), plain_tokens(shown))
    df = sheet.withColumn("display_name", F.when((shown != "") & keeps, shown).otherwise(plain))
    df = with_group_count(df.withColumn("_name", F.lower(strip("display_name"))), ["brand_name", "_name"], "_n")
    return df.withColumn("display_name", F.when(F.col("_n") > 1, plain).otherwise(F.col("display_name"))).drop("_name", "_n")


def post_run_review(catalogue: DataFrame, verdicts: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Act on supplied review verdicts (product_id, satisfied, contradictions, action) of ready rows.

    Up to two re-collections per row, counted from its log; then the row is blocked. It never approves. Adds rematch:
    True where the row has to be collected again. The strict variant counts only unnumbered log marks.
    """
    given = verdicts.select(F.col("product_id").alias("_pid"), "satisfied", "contradictions", "action")
    df = catalogue.join(given, F.col("Product_ID") == F.col("_pid"), "left")
    mark = r"\[Review Re-run\]" if strict_reference else r"\[Review Re-run(?: \d+)?\]"
    reruns = F.regexp_count(F.coalesce("Fix_Log", F.lit("")), F.lit(mark))
    unhappy = F.coalesce((F.col("Status") == "Ready_For_Review") & ~F.col("satisfied") & (
        F.coalesce("contradictions", F.lit("")) != ""), F.lit(False))
    df = df.withColumns({"_again": unhappy & (reruns < fixed.MAX_REVIEW_RERUNS),
                         "_stop": unhappy & (reruns >= fixed.MAX_REVIEW_RERUNS), "_reruns": reruns})
    page = strip(F.col("Source_URL"))
    entry = F.concat(page, F.lit(" | review: "), F.substring(F.col("contradictions"), 1, 120))
    remember = F.col("_again") & F.col("Source_URL").startswith("http") & (F.col("action") == "recollect")
    memory = F.when(F.coalesce(remember, F.lit(False)), F.concat_ws("\n", filled(F.col("Rejected_URLs")), entry)).otherwise(
        F.col("Rejected_URLs"))
    note = F.concat(F.lit("[Review Re-run "), (F.col("_reruns") + 1).cast("string"),
                    F.lit("]: Re-collected due to review critique: "), F.col("contradictions"))
    df = df.withColumns({
        "Rejected_URLs": memory,
        "Fix_Log": F.when(F.col("_again"), F.concat_ws("\n", filled(F.col("Fix_Log")), note)).otherwise(F.col("Fix_Log")),
        "Flags": F.when(F.col("_stop"), F.concat(F.lit("Blocked by Post-Run Review: "), F.col("contradictions")))
        .when(~F.col("_again"), F.col("Flags")),
        "Status": F.when(F.col("_again"), F.lit("Pending")).when(F.col("_stop"), F.lit("Blocked")).otherwise(F.col("Status")),
        "Image_Status": F.when(F.col("_again"), F.lit("missing")).otherwise(F.col("Image_Status")),
        "rematch": F.col("_again"),
    })
    df = clear_collected(df, F.col("_again"))
    return df.drop("_pid", "satisfied", "contradictions", "action", "_again", "_stop", "_reruns")


def apply_manual_source(catalogue: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, rejected): use addresses given by hand.

    resolved: product_id, url, success, direct_url, message. Only http(s) addresses are taken. A resolved one becomes
    Product_URL and the row starts over; an unresolved one leaves a note in Flags.
    """
    web = F.coalesce(strip("url").rlike(r"^https?://"), F.lit(False))
    rejected = resolved.where(~web).select(
        "product_id", "url", F.lit("Invalid URL. Must begin with http:// or https://").alias("reason"))
    given = resolved.where(web).select(
        F.lower(strip("product_id")).alias("_id"), F.col("success").alias("_ok"),
        F.coalesce("direct_url", strip("url")).alias("_direct"), F.col("message").alias("_message"))
    df = catalogue.join(given, F.lower(strip("Product_ID")) == F.col("_id"), "left")
    started = F.coalesce(F.col("_ok"), F.lit(False))
    fresh = {c: F.when(started, new).otherwise(F.col(c)) for c, new in _reset_columns(df).items()}
    out = df.withColumns({
        **fresh,
        "Product_URL": F.when(started, F.col("_direct")).otherwise(F.col("Product_URL")),
        "Flags": F.when(F.col("_ok").isNotNull() & ~started, F.concat(F.lit("Manual URL Resolution: "), F.col("_message")))
        .when(~started, F.col("Flags")),
    })
    return out.select(*catalogue.columns), rejected
