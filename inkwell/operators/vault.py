"""Vault filters and statistics: P1-P4, P6, P11, P12, A1, A2, W4, J11, J13, J15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Thresholds and status groups.
REVIEW_RISK = 30
FAILED = ["failed", "error"]
DEFAULT_OWNER = "00000000-0000-0000-0000-000000000001"
STORE_COMPLETED = ["success", "completed", "low_confidence", "warning"]
REPO_COMPLETED = ["processed", "completed", "valid", "verified"]
REPO_FAILED = ["failed", "error", "invalid"]
MEGABYTE = 1024 * 1024


def _opt(df: DataFrame, name: str, kind: str = "string") -> Column:
    """Column, or NULL where the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _low(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))


def with_status_category(df: DataFrame, flavour: str = "store", out: str = "status_category") -> DataFrame:
    """Mutually exclusive category; ``flavour`` is store or table."""
    status, verdict = _low(F.col("status")), _low(F.col("verification_status"))
    failed = status.isin(FAILED) | verdict.isin(FAILED if flavour == "store" else ["failed"])
    unsupported = (verdict == "unsupported") | ((F.col("doc_type") == "unknown") & (status == "low_confidence"))
    review = (
        (verdict == "review_required")
        | F.coalesce(_opt(df, "review_required", "boolean"), F.lit(False))
        | (status == "warning")
        | (F.coalesce(_opt(df, "risk_score", "double").cast("double"), F.lit(0.0)) >= REVIEW_RISK)
        | F.coalesce(~F.col("checksum_valid"), F.lit(False))
    )
    category = F.when(failed, "failed")
    if flavour == "table":
        category = category.when(status == "processing", "processing")
    category = category.when(F.coalesce(unsupported, F.lit(False)), "unsupported").when(review, "review_required")
    if flavour == "table":
        category = category.otherwise("verified")
    else:
        verified = (verdict == "verified") | status.isin("verified", "completed")
        category = category.when(verified, "verified").otherwise(status)
    return df.withColumn(out, category)


def vault_filter(vault: DataFrame, mode: str | None = None, doc_type: str | None = None, status: str | None = None,
                 ocr_required: bool | None = None, search: str | None = None) -> DataFrame:
    """AND of the given filters; ``all`` and ``None`` filter nothing."""

    def given(value: str | None) -> bool:
        return bool(value) and value.lower() != "all"

    out = vault
    has_ai = _opt(vault, "ai_analysis").isNotNull()
    if given(mode):
        is_ai = (_low(_opt(vault, "mode")) == "ai") | F.coalesce(F.col("doc_type") == "ai_analyzed", F.lit(False)) | has_ai
        if mode.lower() == "ai":
            out = out.filter(is_ai)
        elif mode.lower() == "offline":
            out = out.filter(~is_ai)
    if given(doc_type):
        wanted = doc_type.lower().strip()
        slug, title = _low(F.col("doc_type")), _low(_opt(vault, "document_type"))
        hit = (slug == wanted) | (title == wanted) | title.contains(wanted) | F.contains(F.lit(wanted), slug)
        out = out.filter(hit | has_ai if wanted == "ai_analyzed" else hit)
    if given(status):
        wanted = {"review": "review_required"}.get(status.lower().strip(), status.lower().strip())
        if wanted in ("verified", "review_required", "unsupported", "failed"):
            tagged = with_status_category(out, "store", "_cat")
            # the store's own "verified" text is not a category of its own
            out = tagged.filter(F.col("_cat") == wanted).drop("_cat")
        else:
            out = out.filter((_low(F.col("status")) == wanted) | (_low(F.col("verification_status")) == wanted))
    if ocr_required is not None:
        out = out.filter(F.col("ocr_required") == ocr_required)
    if search and search.strip():
        word = search.strip().lower()
        places = ["filename", "original_filename", "document_type", "doc_type", "extracted_text", "raw_text"]
        hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(word) for c in places if c in vault.columns]
        cond = hits[0]
        for h in hits[1:]:
            cond = cond | h
        out = out.filter(cond)
    return out


def repo_filter(documents: DataFrame, user_id, mode: str | None = None, doc_type: str | None = None,
                status: str | None = None, search: str | None = None) -> DataFrame:
    """Owner equality, exact values, file-name search."""
    out = documents.filter(F.col("user_id") == F.lit(user_id))
    if mode and mode.lower() != "all":
        out = out.filter(F.col("mode") == mode.lower())
    if doc_type and doc_type.lower() != "all":
        out = out.filter(F.col("doc_type") == doc_type.lower())
    if status and status.lower() != "all":
        wanted = status.lower()
        if wanted in ("review_required", "review"):
            flag = F.coalesce(_opt(documents, "review_required", "boolean"), F.lit(False))
            out = out.filter((F.col("verification_status") == "review_required") | flag)
        elif wanted in ("verified", "unsupported"):
            out = out.filter(F.col("verification_status") == wanted)
        elif wanted == "failed":
            out = out.filter(F.col("status").isin(FAILED))
        else:
            out = out.filter(F.col("status") == status)
    if search and search.strip():
        name = "original_filename" if "original_filename" in documents.columns else "filename"
        out = out.filter(F.col(name).ilike(f"%{search.strip()}%"))
    return out


def for_owner(df: DataFrame, user_id, default_owner=DEFAULT_OWNER) -> DataFrame:
    """The owner's rows; ownerless rows only for the default owner."""
    mine = F.col("user_id") == F.lit(user_id)
    if user_id == default_owner:
        mine = mine | F.col("user_id").isNull() | (F.col("user_id").cast("string") == "")
    return df.filter(mine)


def confidence_band(col: Column) -> Column:
    return F.when(col >= 0.85, "high").when(col >= 0.60, "medium").otherwise("low")


def canonical_analysis(vault: DataFrame) -> DataFrame:
    """One analysis per record; later maps win over earlier ones."""
    empty = F.expr("CAST(map() AS MAP<STRING,STRING>)")
    ai = (lambda f: F.col(f"ai_analysis.{f}")) if "ai_analysis" in vault.columns else (lambda f: F.lit(None).cast("string"))
    fields = empty
    layers = [_opt(vault, "fields", "map<string,string>"), _opt(vault, "extracted_fields", "map<string,string>")]
    if "ai_analysis" in vault.columns:
        layers.append(ai("extracted_fields"))
    for layer in layers:
        newer = F.coalesce(layer, empty)
        kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key(newer, k))
        fields = F.map_concat(kept, newer)
    strings = F.array().cast("array<string>")
    evidence = _opt(vault, "evidence", "array<string>")
    ai_evidence = ai("evidence") if "ai_analysis" in vault.columns else F.lit(None).cast("array<string>")
    conf = _opt(vault, "confidence", "double")
    return vault.select(
        F.coalesce(_opt(vault, "id"), F.col("document_id").cast("string")).alias("document_id"),
        F.coalesce(_opt(vault, "document_type"), F.col("doc_type"), F.lit("Unknown Document")).alias("document_type"),
        F.when(conf.isNull(), "high").otherwise(confidence_band(conf)).alias("confidence"),
        F.coalesce(_opt(vault, "extracted_text"), F.lit("")).alias("ocr_text"),
        F.coalesce(F.nullif(_opt(vault, "summary"), F.lit("")), ai("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.when(F.size(evidence) > 0, evidence), ai_evidence, strings).alias("evidence"),
        fields.alias("extracted_fields"),
        F.coalesce(F.nullif(F.col("verification_status"), F.lit("")), F.lit("verified")).alias("verification_status"),
        F.coalesce(_opt(vault, "risk_score", "double").cast("double"), F.lit(0.0)).alias("risk_score"),
        F.coalesce(_opt(vault, "suspicious_signals", "array<string>"), strings).alias("suspicious_signals"),
        _opt(vault, "human_review_reason").alias("human_review_reason"),
    )


def merge_field_layers(layers: DataFrame) -> DataFrame:
    """P6 in long form: per (document, field) the highest layer wins."""
    return layers.groupBy("document_id", "field").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def with_doc_status(docs: DataFrame, vault_mode: bool = True, threshold: float = 0.70) -> DataFrame:
    """P11."""
    bad, good = ("warning", "completed") if vault_mode else ("low_confidence", "success")
    return docs.withColumn(
        "doc_status",
        F.when(~F.coalesce("checksum_valid", F.lit(True)), bad)
        .when(F.col("average_confidence") >= threshold, good)
        .otherwise("low_confidence"),
    )


def ocr_gate(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Usable flag and reason per document."""
    counts = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    joined = docs.join(counts, "doc_id", "left")
    error = F.nullif(_opt(docs, "engine_error"), F.lit(""))
    blank = F.coalesce(F.trim(F.regexp_replace("full_text", r"\s+", " ")), F.lit("")) == ""
    failed = error.isNotNull() | blank | (F.coalesce("average_confidence", F.lit(0.0)) == 0) | (F.coalesce("n_lines", F.lit(0)) == 0)
    return joined.withColumn("usable", ~failed).withColumn(
        "reason", F.when(failed, "ocr_engine_returned_no_text")
    ).withColumn(
        "message", F.when(failed, F.coalesce(error, F.lit("OCR engine returned no text or zero confidence")))
    )


def vault_stats(vault: DataFrame) -> DataFrame:
    """A1: store flavour."""
    mode, ocr = F.nullif(_opt(vault, "mode"), F.lit("")), F.col("ocr_required")
    total_bytes = F.coalesce(F.sum("file_size"), F.lit(0))
    return vault.agg(
        F.count("*").alias("total_documents"),
        F.count_if(ocr).alias("ocr_processed"),
        F.count_if(~ocr).alias("ocr_not_required"),
        F.count_if(F.col("status").isin(STORE_COMPLETED)).alias("completed"),
        F.count_if(F.col("status").isin("error", "failed")).alias("failed"),
        F.count_if((mode == "offline") | (mode.isNull() & F.coalesce(ocr, F.lit(True)))).alias("offline_documents"),
        F.count_if(mode == "ai").alias("ai_documents"),
        total_bytes.alias("total_storage_bytes"),
        F.round(total_bytes / MEGABYTE, 2).alias("total_storage_mb"),
    )


def owner_stats(documents: DataFrame) -> DataFrame:
    """A2: repository flavour, one row per owner."""
    done = F.count_if(F.col("status").isin(REPO_COMPLETED))
    total_bytes = F.coalesce(F.sum("file_size"), F.lit(0))
    return documents.groupBy("user_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("mode") == "offline").alias("offline_documents"),
        F.count_if(F.col("mode") == "ai").alias("ai_documents"),
        done.alias("processed_documents"),
        F.count_if(F.col("status").isin(REPO_FAILED)).alias("failed_documents"),
        total_bytes.alias("total_storage_bytes"),
        F.round(total_bytes / MEGABYTE, 2).alias("total_storage_mb"),
        F.round(done * 100 / F.count("*"), 1).alias("success_rate"),
    )


def owner_stats_for(documents: DataFrame, owners: DataFrame) -> DataFrame:
    """A2 for listed owners; an owner without documents has a rate of 100."""
    stats = owners.select("user_id").distinct().join(owner_stats(documents), "user_id", "left")
    zero = {c: 0 for c in stats.columns if c not in ("user_id", "success_rate")}
    return stats.fillna({**zero, "success_rate": 100.0})


def docs_by_type(documents: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("doc_type"), F.lit("")), F.lit("unknown"))
    return documents.groupBy("user_id", kind.alias("doc_type")).agg(F.count("*").alias("documents"))


def page(df: DataFrame, page: int = 1, limit: int = 20, newest: str = "created_at", tie: str = "document_id") -> DataFrame:
    """One page, newest first, with the exact total in every row.

    The page is a bounded top-k (no global window over the table); the total
    is a scalar subquery.
    """
    offset = max(0, (page - 1) * limit)
    rows = df.orderBy(F.desc(newest), F.asc(tie)).offset(offset).limit(limit)
    pages = F.ceil(F.col("total") / limit) if limit > 0 else F.lit(1)
    return rows.withColumn("total", df.agg(F.count("*")).scalar()).withColumns({
        "page": F.lit(page), "page_size": F.lit(limit), "total_pages": pages.cast("bigint"),
    })


def _marks(df: DataFrame, column: str, size: int, ranges: int) -> list:
    """Values that cut the rows into about ``ranges`` equal parts, ascending; bounded by ``ranges``."""
    at = [i / ranges for i in range(1, ranges)]
    if isinstance(df.schema[column].dataType, (T.NumericType, T.TimestampType, T.DateType)):
        return sorted(set(df.agg(F.percentile_approx(column, at, 10_000)).first()[0] or []))
    some = df.select(column).where(F.col(column).isNotNull()).sample(min(1.0, 100 * ranges / size), seed=7).limit(200 * ranges)
    seen = sorted(r[0] for r in some.collect())
    return sorted({seen[int(q * len(seen))] for q in at}) if seen else []


def deep_page(df: DataFrame, page: int = 1, limit: int = 20, newest: str = "created_at", tie: str = "document_id",
              ranges: int = 64, small: int = 100_000) -> DataFrame:
    """W4 at any depth, by number: the rows of ``page`` without sorting the table.

    The order is cut into about equal ranges at approximate quantiles, the rows of each are counted, and only the ranges
    that the page reaches into are read again, and so on until ``small`` rows or fewer are left to sort.  Where many rows
    share one ``newest`` value the ranges go on by ``tie``.
    """

    def part(left: DataFrame, size: int, skip: int, wanted: int, column: str) -> DataFrame:
        plain = left.orderBy(F.desc(newest), F.asc(tie)).offset(skip).limit(wanted)
        if size <= small:
            return plain
        col, down = F.col(column), column == newest
        marks = _marks(left, column, size, ranges)
        marks = marks[::-1] if down else marks
        inside = F.lit(2 * len(marks))
        for i, mark in reversed([*enumerate(marks)]):  # rows of a mark itself are a range of their own
            before_it = col > F.lit(mark) if down else col < F.lit(mark)
            inside = F.when(before_it, 2 * i).when(col == F.lit(mark), 2 * i + 1).otherwise(inside)
        inside = F.when(col.isNull(), 2 * len(marks) + 1 if down else -1).otherwise(inside)
        counts = dict(left.groupBy(inside.alias("range")).count().collect())
        if len(counts) == 1:  # one value, or none at all
            return part(left, size, skip, wanted, tie) if down and tie != newest else plain
        out, before = None, 0
        for at in sorted(counts):
            low, high = max(skip - before, 0), min(skip + wanted - before, counts[at])
            before += counts[at]
            if low < high:
                rows = left.where(inside == at)
                rows = rows if high - low == counts[at] else part(rows, counts[at], low, high - low, column)
                out = rows if out is None else out.union(rows)
        return plain if out is None else out

    total = df.count()
    rows = part(df, total, max(0, (page - 1) * limit), limit, newest) if limit > 0 else df.limit(0)
    pages = -(-total // limit) if limit > 0 else 1
    rows = rows.orderBy(F.desc(newest), F.asc(tie)).limit(limit)
    return rows.withColumns({"total": F.lit(total), "page": F.lit(page), "page_size": F.lit(limit), "total_pages": F.lit(pages).cast("bigint")})


def page_after(df: DataFrame, after: tuple | None = None, limit: int = 20, newest: str = "created_at",
               tie: str = "document_id") -> DataFrame:
    """W4 at any depth: the ``limit`` rows that follow ``after``, the (newest, tie) values of the last row seen.

    The bound is a filter on the scan, so a deep page costs what the first one does.  Rows without a ``newest``
    value come last.
    """
    if after is not None:
        value, key = after
        later = F.col(tie) > F.lit(key)
        if value is None:
            df = df.filter(F.col(newest).isNull() & later)
        else:
            same = (F.col(newest) == F.lit(value)) & later
            df = df.filter((F.col(newest) < F.lit(value)) | same | F.col(newest).isNull())
    return df.orderBy(F.desc(newest), F.asc(tie)).limit(limit)


def first_child(child: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per parent; pre-aggregated, so a hot parent costs one row per task."""
    rest = [c for c in child.columns if c != key]
    picked = child.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, "_r.*")


def document_view(docs: DataFrame, ocr: DataFrame, fields: DataFrame, ai: DataFrame) -> DataFrame:
    """Documents with their first OCR, field and AI row, defaults filled."""
    out = docs
    for child in (ocr, fields, ai):
        out = out.join(first_child(child, "document_id", [c for c in ("created_at", "row_id") if c in child.columns]).drop(
            "created_at", "row_id"), "document_id", "left")
    return out.withColumns({
        "verification_status": F.coalesce("verification_status", F.lit("verified")),
        "risk_score": F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)),
    })


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame | None = None, owner=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove documents (listed, or all of an owner) from every table.

    Gives the kept rows of each table, and one row per table with the numbers
    deleted and kept, counted together in one pass over the table.
    """
    parent = tables["documents"]
    doomed = parent.join(ids.select("document_id").distinct(), "document_id", "left_semi") if ids is not None else parent
    if owner is not None:
        doomed = doomed.filter(F.col("user_id") == F.lit(owner))
    doomed = doomed.select("document_id").distinct()
    kept = {name: df.join(doomed, "document_id", "left_anti") for name, df in tables.items()}
    rows = None
    for name, df in tables.items():
        part = df.select("document_id", F.lit(name).alias("table_name"))
        rows = part if rows is None else rows.unionByName(part)
    marked = rows.join(doomed.withColumn("_gone", F.lit(True)), "document_id", "left")
    counts = marked.groupBy("table_name").agg(F.count("_gone").alias("deleted"), F.count_if(F.col("_gone").isNull()).alias("kept"))
    return kept, counts


def upsert_profiles(existing: DataFrame, incoming: DataFrame, admin_emails: list[str]) -> DataFrame:
    """E-mail replaced, name replaced unless empty, admins promoted."""
    new = incoming.select("id", F.col("email").alias("_e"), F.col("full_name").alias("_n"), F.col("role").alias("_r"), F.lit(True).alias("_new"))
    both = existing.join(new, "id", "full_outer")
    email = F.when(F.col("_new"), F.col("_e")).otherwise(F.col("email"))
    admins = [e.strip().lower() for e in admin_emails if e.strip()]
    role = F.coalesce("role", F.nullif(F.col("_r"), F.lit("")), F.lit("user"))
    return both.select(
        "id", email.alias("email"),
        F.coalesce(F.nullif(F.col("_n"), F.lit("")), F.col("full_name"), F.lit("")).alias("full_name"),
        F.when(F.lower(F.trim(email)).isin(admins), "admin").otherwise(role).alias("role"),
    )
