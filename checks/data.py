"""Inputs of the checks, derived from the given tables by SQL that reads the same in Spark
and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.plans.batch import spread

PEOPLE = """
SELECT c_custkey, c_nationkey,
  split_part('Asha Rao,Vikram Nair,Meena Iyer,Rohit Das,Fatima Khan,Kiran Bose,Neha Gupta', ',', CAST(c_custkey % 7 + 1 AS INT)) AS full_name,
  CAST(6000000000 + (c_custkey * 7919) % 4000000000 AS STRING) AS mobile,
  concat('user', CAST(c_custkey AS STRING), '@mail.example.com') AS email,
  concat(CAST(2000 + c_custkey % 8000 AS STRING), ' ', CAST(1000 + (c_custkey * 13) % 9000 AS STRING), ' ', CAST(1000 + (c_custkey * 37) % 9000 AS STRING)) AS aadhaar,
  concat('ABC', split_part('P,C,H,F', ',', CAST(c_custkey % 4 + 1 AS INT)), 'K', CAST(1000 + (c_custkey * 11) % 9000 AS STRING), 'Z') AS pan,
  concat(CAST(1 + c_custkey % 99 AS STRING), ' MG Road, Ward ', CAST(c_nationkey AS STRING)) AS address,
  CAST(9876000000000000 + c_custkey AS STRING) AS bank_account,
  concat('HDFC0', lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0')) AS ifsc,
  concat('user', CAST(c_custkey AS STRING), '@okbank') AS upi_id,
  concat('MH/', lpad(CAST(c_nationkey AS STRING), 2, '0'), '/', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '/', lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0')) AS voter_id,
  concat('P', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0')) AS passport
FROM customer
"""

COLUMNS = [
    "full_name", "mobile", "email", "aadhaar", "pan", "address", "bank_account", "ifsc",
    "upi_id", "voter_id", "passport",
]

# One file holds a third of all rows.
FILE_ID = "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 20 END"

RENDERED = (
    "concat("
    + ", ' | ', ".join(f"'{c}: ', {c}" for c in COLUMNS)
    + ")"
)

ROWS = f"""
SELECT c_custkey AS unit_id, {FILE_ID} AS file_id, {RENDERED} AS text
FROM ({PEOPLE}) p
"""

# Free text in twelve forms; each exercises another rule.
NOTES = f"""
SELECT c_custkey AS unit_id, {FILE_ID} AS file_id, CASE c_custkey % 12
  WHEN 0 THEN concat('Mobile: ', mobile, ' | name: ', full_name)
  WHEN 1 THEN concat('Please call ', full_name, ' on ', mobile, ' about the bank loan')
  WHEN 2 THEN concat('Random ', mobile)
  WHEN 3 THEN concat('Name: ', full_name, ', Aadhaar: ', aadhaar, ', Phone: +91', mobile)
  WHEN 4 THEN concat('account: ', mobile, ' closed on request')
  WHEN 5 THEN concat('upi_id: ', mobile, '@ybl')
  WHEN 6 THEN concat('Contact: ', full_name, chr(10), 'Ref 1', mobile)
  WHEN 7 THEN concat('customer ', full_name, ' of Mumbai, phone +91', mobile, ' or email ', email, ' and +91 ', mobile)
  WHEN 8 THEN concat('login.password: ', mobile, ' | id: ', bank_account)
  WHEN 9 THEN concat('ifsc ', ifsc, ' acct ', bank_account, ' voter ', voter_id, ' passport ', passport, ' pan ', pan, ' vpa ', upi_id)
  WHEN 10 THEN concat('card ', aadhaar, ' ', substring(mobile, 1, 4), ' and +91', mobile, ' ', mobile, ' ', bank_account)
  ELSE concat('address: ', address, chr(10), 'full_name:  ', chr(10), 'city: Chennai | location.street.name: Anna Salai | patient: ', full_name, ' ')
END AS text
FROM ({PEOPLE}) p
"""

# Everything with text in it, as (src, unit_id, text).
CORPUS = f"""
SELECT 'row' AS src, unit_id, text FROM ({ROWS}) r
UNION ALL SELECT 'note' AS src, unit_id, text FROM ({NOTES}) n
UNION ALL SELECT 'doc' AS src, doc_id AS unit_id, text FROM documents
UNION ALL SELECT 'page' AS src, page_id AS unit_id, html AS text FROM pages
"""

LABELS = [
    "name.first", "full_name", "location.street.name", "login.password", "id", "upi_id",
    "id.name", "address", "permanent_address", "city", "code", "number", "phone", "cell",
    "dob.date", "Contact Person", "bank_account", "customer", "street", "ifsc_code", "title",
]
# Each customer row with one of the labels above and a value.
LABELLED = f"""
SELECT c_custkey AS unit_id,
  split_part('{','.join(LABELS)}', ',', CAST(c_custkey % {len(LABELS)} + 1 AS INT)) AS label,
  CASE c_custkey % 5 WHEN 0 THEN full_name WHEN 1 THEN mobile WHEN 2 THEN 'A' WHEN 3 THEN address ELSE 'Al 7' END AS value
FROM ({PEOPLE}) p
"""

FILES = """
SELECT o_orderkey AS id, concat('file_', CAST(o_orderkey AS STRING), '.csv') AS original_filename,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE sha256(CAST(o_orderkey AS STRING)) END AS file_hash,
  concat('/data/in/', CAST(o_orderkey AS STRING)) AS original_path,
  CASE WHEN o_orderstatus = 'F' THEN concat('/data/out/', CAST(o_orderkey AS STRING)) END AS sanitized_path,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
  o_custkey AS uploaded_by, o_orderdate AS created_at
FROM orders
"""

USERS = """
SELECT c_custkey AS id, concat('User', CAST(c_custkey AS STRING), '@Mail.example.com') AS email,
  c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'user' END AS role
FROM customer WHERE c_custkey % 5 <> 0
"""

AUDIT = """
SELECT event_id AS id, user_id, event_type AS action, 'file' AS resource_type,
  CAST(event_id % 97 AS BIGINT) AS resource_id, props AS details,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('10.0.0.', CAST(event_id % 256 AS STRING)) END AS ip_address,
  ts AS created_at
FROM events
"""

TABLES = ["customer", "orders", "events", "documents", "pages", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Texts to detect in, dealt out over all cores if they come from few files."""
    return spread(derive(spark, sf_dir, sql))


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above on the tables of a folder."""
    for name in TABLES:
        sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    # the one function with another name
    return spark.sql(sql.replace("sha256(", "sha2_256(").replace("sha2_256(CAST(o_orderkey AS STRING))",
                                                                 "sha2(CAST(o_orderkey AS STRING), 256)"))


def ctes(**parts: str) -> str:
    """WITH clause from named statements."""
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items()) + "\n"
