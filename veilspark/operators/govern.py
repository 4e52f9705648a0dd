"""Catalog, audit trail, integrity and role-limited views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

# Which role may see what; joined as a table so that it can be replaced.
POLICY = [
    ("admin", "vault"), ("admin", "reversal"), ("admin", "audit"), ("admin", "upload"),
    ("admin", "mask"), ("admin", "files"), ("admin", "report"), ("admin", "download"),
    ("admin", "stats"),
    ("user", "files"), ("user", "report"), ("user", "download"), ("user", "stats"),
]


# -- files ------------------------------------------------------------------------

def newest_first(table: DataFrame, tie: str = "id") -> DataFrame:
    return table.orderBy(F.col("created_at").desc(), F.col(tie).desc())


def list_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All files, newest first, and their number as a one-row table."""
    return newest_first(files), files.agg(F.count("*").alias("total"))


def by_id(table: DataFrame, value, column: str = "id") -> DataFrame:
    """Point look-up; an empty result means not found."""
    return table.where(F.col(column) == value)


def pending(files: DataFrame, completed_runs: DataFrame | None = None) -> DataFrame:
    """Files that may be processed: everything not completed, also failed and half-done
    ones. Completed runs known from elsewhere are left out too, so a batch can be repeated."""
    todo = files.where(F.col("status") != "completed")
    if completed_runs is None:
        return todo
    done = completed_runs.select(F.col("file_id").alias("id")).distinct()
    return todo.join(done, "id", "left_anti")


def outcome(files: DataFrame, rejects: DataFrame) -> DataFrame:
    """Status after a run: failed with a message for rejected files, completed for others."""
    reasons = rejects.groupBy("file_id").agg(F.min("reason").alias("message")).withColumnRenamed(
        "file_id", "id"
    )
    joined = files.drop("status").join(reasons, "id", "left")
    return joined.withColumn(
        "status", F.when(F.col("message").isNotNull(), "failed").otherwise("completed")
    ).withColumn("message", F.concat(F.lit("Processing failed: "), F.col("message")))


def integrity(
    files: DataFrame, current: DataFrame, path: str = "original_path", stored: str = "file_hash"
) -> DataFrame:
    """Compare stored fingerprints with fresh ones (`current`: path, hash).

    Verdicts: skipped (no stored fingerprint), missing, tampered, intact. Use it for the
    originals and, with the other pair of columns, for the sanitised files.
    """
    fresh = current.select(F.col("path").alias(path), F.col("hash").alias("current_hash"))
    verdict = (
        F.when(F.col(stored).isNull(), "skipped")
        .when(F.col("current_hash").isNull(), "missing")
        .when(F.col("current_hash") != F.col(stored), "tampered")
        .otherwise("intact")
    )
    return files.join(fresh, path, "left").withColumn("verdict", verdict)


def unavailable(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files whose sanitised output is not recorded or not there (`outputs`: path)."""
    listing = outputs.select(F.col("path").alias("sanitized_path")).distinct()
    return files.join(listing, "sanitized_path", "left_anti")


# -- audit --------------------------------------------------------------------------

def audit_rows(events: DataFrame, details: list[str]) -> DataFrame:
    """Audit entries from events; the named columns become the JSON details.

    Each entry gets a digest of all its fields, the time among them, so later changes show.
    """
    body = F.struct(*[F.col(c) for c in details]) if details else F.lit(None)
    text = F.to_json(body) if details else F.lit(None).cast("string")
    base = events.select(
        "id", "user_id", "action", "resource_type", "resource_id",
        text.alias("details"), "ip_address", "created_at",
    )
    return with_digest(base)


def with_digest(audit: DataFrame) -> DataFrame:
    fields = [
        F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in
        ("id", "user_id", "action", "resource_type", "resource_id", "details", "ip_address")
    ]
    time = F.unix_micros(F.col("created_at").cast("timestamp")).cast("string")
    fields.append(F.coalesce(time, F.lit("\x00")))
    return audit.withColumn("row_digest", F.sha2(F.concat_ws("\x1f", *fields), 256))


def latest_audit(audit: DataFrame, limit: int = C.AUDIT_PAGE_SIZE) -> DataFrame:
    """The newest entries: a top-k, so no full sort."""
    return newest_first(audit).limit(limit)


def with_user(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Audit entries with the user's e-mail, `unknown` if there is no such user.

    The join is left to Spark: it broadcasts a small user table by its known size.
    """
    known = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return audit.join(known, "user_id", "left").withColumn(
        "user_email", F.coalesce("user_email", F.lit("unknown"))
    )


def filter_audit(audit: DataFrame, action: str | None = None, query: str = "") -> DataFrame:
    """Entries of one action, or whose user's e-mail or action contains the query."""
    if action:
        audit = audit.where(F.col("action") == action)
    if query:
        audit = audit.where(matches_query(query))
    return audit


def matches_query(query: str) -> Column:
    q = query.lower()
    return (F.lower("action") == q) | F.lower("user_email").contains(q)


def audit_details(audit: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of the JSON details."""
    parsed = F.from_json("details", "map<string,string>")
    rows = audit.select(*keys, F.explode_outer(parsed).alias("detail", "detail_value"))
    return rows.where(F.col("detail").isNotNull())


def audit_count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("events"))


# -- roles ---------------------------------------------------------------------------

def may(role: Column, resource: str) -> Column:
    return role.isin([r for r, res in POLICY if res == resource])


def role_view(rows: DataFrame, role: str = "role", value: str = "value", token: str = "token") -> DataFrame:
    """Each row as its reader may see it: the value for roles allowed to reverse tokens, the
    token for all others."""
    seen = F.when(may(F.col(role), "reversal"), F.col(value)).otherwise(F.col(token))
    return rows.withColumn("visible", seen).drop(value)
