"""Catalog, audit trail, integrity and role-limited views."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.config import scratch_dir
from veilspark.operators import auditlog, govern, risk
from veilspark.operators.skew import written
from veilspark.sinks.writers import append_run

from .data import AUDIT, FILES, PEOPLE, USERS, ctes, derive
from .registry import check


@check("o101_file_list", ctes(f=FILES) + """
SELECT id, original_filename, status, created_at, count(*) OVER () AS total FROM f""")
def o101(spark, sf_dir):
    listing, total = govern.list_files(derive(spark, sf_dir, FILES))
    return listing.select("id", "original_filename", "status", "created_at", total.scalar().alias("total"))


@check("o102_point_lookup", ctes(f=FILES) + "SELECT id, original_filename, status FROM f WHERE id = 4711 OR id = 42")
def o102(spark, sf_dir):
    files = derive(spark, sf_dir, FILES)
    found = govern.by_id(files, 4711).unionByName(govern.by_id(files, 42)).unionByName(govern.by_id(files, -1))
    return found.select("id", "original_filename", "status")


_DONE = "SELECT DISTINCT o_orderkey AS file_id FROM orders WHERE o_orderkey % 6 = 0"


@check("o103_pending_files", ctes(f=FILES, d=_DONE) + """
SELECT id, status FROM f WHERE status <> 'completed' AND id NOT IN (SELECT file_id FROM d)""")
def o103(spark, sf_dir):
    todo = govern.pending(derive(spark, sf_dir, FILES), derive(spark, sf_dir, _DONE))
    return todo.select("id", "status")


_REJECTS = """
SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 'not valid JSON' ELSE 'Unsupported file type: xls' END AS reason
FROM orders WHERE o_orderkey % 9 = 0"""


@check("o104_failure_capture", ctes(f=FILES, r=_REJECTS) + """
SELECT id, CASE WHEN reason IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN reason IS NOT NULL THEN concat('Processing failed: ', reason) END AS message
FROM f LEFT JOIN r ON f.id = r.file_id""")
def o104(spark, sf_dir):
    out = govern.outcome(derive(spark, sf_dir, FILES), derive(spark, sf_dir, _REJECTS))
    return out.select("id", "status", "message")


# Fresh hashes: every seventh file has changed, every thirteenth is gone.
_CURRENT = """
SELECT concat('/data/in/', CAST(o_orderkey AS STRING)) AS path,
  CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE sha256(CAST(o_orderkey AS STRING)) END AS hash
FROM orders WHERE o_orderkey % 13 <> 0"""


@check("o105_integrity", ctes(f=FILES, c=_CURRENT) + """
SELECT id, CASE WHEN file_hash IS NULL THEN 'skipped' WHEN hash IS NULL THEN 'missing' WHEN hash <> file_hash THEN 'tampered'
  ELSE 'intact' END AS verdict FROM f LEFT JOIN c ON original_path = path""")
def o105(spark, sf_dir):
    out = govern.integrity(derive(spark, sf_dir, FILES), derive(spark, sf_dir, _CURRENT))
    return out.select("id", "verdict")


_OUTPUTS = "SELECT concat('/data/out/', CAST(o_orderkey AS STRING)) AS path FROM orders WHERE o_orderkey % 5 <> 0"


@check("o106_unavailable", ctes(f=FILES, o=_OUTPUTS) + """
SELECT id FROM f WHERE sanitized_path IS NULL OR sanitized_path NOT IN (SELECT path FROM o)""")
def o106(spark, sf_dir):
    return govern.unavailable(derive(spark, sf_dir, FILES), derive(spark, sf_dir, _OUTPUTS)).select("id")


_STORED = """
SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE
  concat('{"PAN":', CAST(o_orderkey % 4 AS STRING), ',"AADHAAR":', CAST(o_orderkey % 3 AS STRING), '}') END AS pii_breakdown
FROM orders"""


@check("o107_report_fetch", ctes(s=_STORED) + """
SELECT file_id, 'PAN' AS pii_type, file_id % 4 AS n FROM s WHERE pii_breakdown IS NOT NULL
UNION ALL SELECT file_id, 'AADHAAR', file_id % 3 FROM s WHERE pii_breakdown IS NOT NULL""")
def o107(spark, sf_dir):
    parsed = derive(spark, sf_dir, _STORED).withColumn(
        "pii_breakdown", risk.parse_breakdown(F.col("pii_breakdown")))
    return risk.list_breakdown(parsed)


_EVENTS = """
SELECT event_id AS id, user_id, event_type AS action, 'file' AS resource_type, CAST(event_id % 97 AS BIGINT) AS resource_id,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE '10.0.0.1' END AS ip_address, ts AS created_at,
  event_type AS status, CAST(event_id % 40 AS BIGINT) AS pii_found FROM events"""


@check("o108_audit_append", ctes(e=_EVENTS, a="""
SELECT *, concat('{"pii_found":', CAST(pii_found AS STRING), ',"status":"', status, '"}') AS details FROM e""") + """
SELECT id, user_id, action, resource_type, resource_id, details, ip_address,
  sha256(concat_ws(chr(31), CAST(id AS STRING), CAST(user_id AS STRING), action, resource_type, CAST(resource_id AS STRING), details,
    coalesce(ip_address, chr(0)), CAST(epoch_us(created_at) AS STRING))) AS row_digest FROM a""")
def o108(spark, sf_dir):
    return govern.audit_rows(derive(spark, sf_dir, _EVENTS), ["pii_found", "status"]).drop("created_at")


@check("o109_latest_audit", ctes(a=AUDIT) + "SELECT id, action, created_at FROM a ORDER BY created_at DESC, id DESC LIMIT 500")
def o109(spark, sf_dir):
    return govern.latest_audit(derive(spark, sf_dir, AUDIT)).select("id", "action", "created_at")


_JOINED = "SELECT a.*, coalesce(email, 'unknown') AS user_email FROM a LEFT JOIN u ON a.user_id = u.id"


@check("o110_audit_with_user", ctes(a=AUDIT, u=USERS) + f"SELECT id, action, user_email FROM ({_JOINED})")
def o110(spark, sf_dir):
    out = govern.with_user(derive(spark, sf_dir, AUDIT), derive(spark, sf_dir, USERS))
    return out.select("id", "action", "user_email")


@check("o111_audit_filter", ctes(a=AUDIT, u=USERS) + f"""
SELECT id, action, user_email FROM ({_JOINED}) WHERE lower(user_email) LIKE '%user1%'
UNION ALL SELECT id, action, user_email FROM ({_JOINED}) WHERE action = 'purchase'""")
def o111(spark, sf_dir):
    audit = govern.with_user(derive(spark, sf_dir, AUDIT), derive(spark, sf_dir, USERS))
    both = govern.filter_audit(audit, query="USER1").unionByName(govern.filter_audit(audit, action="purchase"))
    return both.select("id", "action", "user_email")


@check("o112_audit_details", ctes(a=AUDIT) + """
SELECT id, 'k' AS detail, json_extract_string(details, '$.k') AS detail_value FROM a WHERE json_extract_string(details, '$.k') IS NOT NULL""")
def o112(spark, sf_dir):
    return govern.audit_details(derive(spark, sf_dir, AUDIT), ["id"])


_READERS = f"""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'user' END AS role, mobile AS value,
  concat('PHONE_', CAST(c_custkey AS STRING)) AS token FROM ({PEOPLE}) p"""


@check("o113_role_view", ctes(r=_READERS) + """
SELECT c_custkey, role, token, CASE WHEN role = 'admin' THEN value ELSE token END AS visible FROM r""")
def o113(spark, sf_dir):
    return govern.role_view(derive(spark, sf_dir, _READERS))


@check("o108_tampering_named", ctes(a=AUDIT, n="""
SELECT CAST(id % 3 AS STRING) AS run_id, CAST(row_number() OVER (PARTITION BY id % 3 ORDER BY created_at, id) AS BIGINT) AS seq FROM a""") + """
SELECT run_id, seq, CASE WHEN seq % 500 = 0 THEN 'removed' ELSE 'changed' END AS change FROM n WHERE seq % 500 = 0 OR seq % 77 = 5""")
def o108_tampering(spark, sf_dir):
    """Three runs leave their entries; some are deleted and some edited afterwards, digest and all."""
    out = scratch_dir(spark, "audit")
    events = derive(spark, sf_dir, AUDIT)
    for k in range(3):
        run_id = str(k)
        rows = govern.audit_rows(events.where(F.col("id") % 3 == k), ["details"])
        entries = auditlog.append(rows, out, run_id)
        edited = entries.where("seq % 500 != 0").withColumn(
            "user_id", F.when(F.col("seq") % 77 == 5, F.col("user_id") + 1).otherwise(F.col("user_id")))
        edited = govern.with_digest(edited.drop("row_digest")).select(*entries.columns)
        append_run(written(edited, "edited"), f"{out}/audit_logs", run_id)
    return auditlog.verify(spark, out)
