"""Masking, leak check, detokenisation, and the whole batch run."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.config import KEY_CONF, scratch_dir
from veilspark.operators import mask, vault
from veilspark.operators.detect import add_detections, explode_detections
from veilspark.plans import batch
from veilspark.sources import nested
from veilspark.streaming import arrivals

from . import oracle as O
from .data import COLUMNS, CORPUS, FILE_ID, PEOPLE, ROWS, ctes, derive, units
from .registry import KEY, check
from .tokens import DET, UNITS, VAULT, tokens

KEYS = ["file_id", "unit_id"]


def _staged(spark, sf_dir, source=UNITS):
    return batch.stage(add_detections(units(spark, sf_dir, source)), "check-detected")


def _vault(staged):
    found = explode_detections(staged, KEYS)
    return batch.stage(vault.assign_tokens(vault.distinct_values(found), KEY), "check-tokens")


def fold(text: str, entries: str) -> str:
    """SQL: replace the listed {value, token} entries one after the other."""
    return (f"list_reduce(list_prepend({{'value': {text}, 'token': ''}}, {entries}), "
            "lambda acc, x: {'value': replace(acc.value, x.value, x.token), 'token': ''}).value")


def file_dictionary(source: str = "vault") -> str:
    return (f"SELECT file_id, list({{'value': value, 'token': token}} ORDER BY -length(value), value) AS m "
            f"FROM {source} GROUP BY file_id")


# SQL: texts rebuilt from detections by position, last one first.
_SPLICED = """
SELECT t.unit_id, t.file_id, text, coalesce(list_reduce(list_prepend({'s': 0::BIGINT, 'e': 0::BIGINT, 'v': text}, l),
  lambda acc, d: {'s': 0::BIGINT, 'e': 0::BIGINT, 'v': concat(substr(acc.v, 1, d.s), d.v, substr(acc.v, d.e + 1))}).v, text) AS masked
FROM t LEFT JOIN (SELECT unit_id, file_id, list({'s': s, 'e': e, 'v': token} ORDER BY s DESC) AS l
  FROM det JOIN vault USING (file_id, value) GROUP BY ALL) USING (unit_id, file_id)"""

_BY_FILE = f"""
SELECT unit_id, file_id, text, coalesce({fold('text', 'm')}, text) AS masked FROM t LEFT JOIN ({file_dictionary()}) USING (file_id)"""


@check("o91_dictionary_replace", ctes(**VAULT) + f"SELECT unit_id, file_id, masked FROM ({_BY_FILE})")
def o91(spark, sf_dir):
    units = derive(spark, sf_dir, UNITS)
    return mask.mask_by_file(units, tokens(spark, sf_dir), KEYS).select("unit_id", "file_id", "masked")


_ROW_MAP = f"""
SELECT c_custkey, concat(full_name, ' / ', mobile, ' ', substring(mobile, 1, 4), ' ', full_name) AS text,
  full_name, mobile, substring(mobile, 1, 4) AS head FROM ({PEOPLE}) p"""


@check("o91_replace_longest_first", ctes(t=_ROW_MAP) + """
SELECT c_custkey, replace(replace(replace(text, CASE WHEN length(full_name) >= 10 THEN full_name ELSE mobile END,
  CASE WHEN length(full_name) >= 10 THEN 'PERSON_1' ELSE 'PHONE_2' END),
  CASE WHEN length(full_name) >= 10 THEN mobile ELSE full_name END,
  CASE WHEN length(full_name) >= 10 THEN 'PHONE_2' ELSE 'PERSON_1' END), head, 'HEAD_3') AS masked FROM t""")
def o91_order(spark, sf_dir):
    df = derive(spark, sf_dir, _ROW_MAP)
    mapping = F.array(*[
        F.struct(F.col(c).alias("value"), F.lit(t).alias("token"))
        for c, t in (("head", "HEAD_3"), ("mobile", "PHONE_2"), ("full_name", "PERSON_1"))])
    return df.select("c_custkey", mask.replace_all(F.col("text"), mapping).alias("masked"))


@check("o92_span_splice", ctes(**VAULT) + f"SELECT unit_id, file_id, masked FROM ({_SPLICED})")
def o92(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    spans = batch.stage(mask.unit_tokens(explode_detections(staged, KEYS), _vault(staged), KEYS), "check-spans")
    return mask.mask_texts(staged, spans, KEYS).select("unit_id", "file_id", "masked")


@check("o22_pass_through", ctes(**VAULT) + f"""
SELECT unit_id, file_id, masked FROM ({_SPLICED}) WHERE NOT EXISTS (SELECT 1 FROM det WHERE det.unit_id = unit_id_ AND det.file_id = file_id_)
""".replace("SELECT unit_id, file_id, masked FROM (", "SELECT unit_id, file_id, masked FROM (SELECT *, unit_id AS unit_id_, file_id AS file_id_ FROM (").replace(") WHERE NOT", ")) WHERE NOT"))
def o22(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    spans = batch.stage(mask.unit_tokens(explode_detections(staged, KEYS), _vault(staged), KEYS), "check-spans")
    out = mask.mask_texts(staged, spans, KEYS).where(F.size("detections") == 0)
    return out.select("unit_id", "file_id", "masked")


# Tables: rows are rendered, detected, and their cells masked with the row's own mapping.
_TABLE = f"SELECT c_custkey AS unit_id, {FILE_ID} AS file_id, {', '.join(COLUMNS)}, {O.quoted(['x'])[1:-1]} AS plain FROM ({PEOPLE}) p"
_TABLE_DET = {"t": ROWS, **O.detection_ctes("t", "unit_id, file_id", False), **O.vault_ctes(), "tab": _TABLE}
_ROW_DICTIONARY = """
SELECT unit_id, file_id, list({'value': value, 'token': token} ORDER BY -length(value), value) AS m
FROM (SELECT DISTINCT unit_id, file_id, value, token FROM det JOIN vault USING (file_id, value)) GROUP BY ALL"""


def _row_mappings(spark, sf_dir):
    staged = _staged(spark, sf_dir, ROWS)
    spans = batch.stage(mask.unit_tokens(explode_detections(staged, KEYS), _vault(staged), KEYS), "check-spans")
    return batch.row_mapping(spans, KEYS)


@check("o93_table_mask", ctes(**_TABLE_DET) + "SELECT unit_id, "
       + ", ".join(f"{fold(c, 'm')} AS {c}" for c in [*COLUMNS, "plain"])
       + f" FROM tab JOIN ({_ROW_DICTIONARY}) USING (unit_id, file_id)")
def o93(spark, sf_dir):
    table = derive(spark, sf_dir, _TABLE).join(_row_mappings(spark, sf_dir), KEYS)
    return mask.mask_columns(table, [*COLUMNS, "plain"], "mapping").drop("mapping", "file_id")


@check("o94_nested_mask", ctes(**_TABLE_DET) + f"""
SELECT unit_id, {fold('full_name', 'm')} AS name, {fold('mobile', 'm')} AS mobile, {fold('email', 'm')} AS mail0,
  {fold('upi_id', 'm')} AS mail1, CAST(unit_id + 1 AS VARCHAR) AS number, {fold('pan', 'm')} AS pan, CAST(NULL AS STRING) AS nothing
FROM tab JOIN ({_ROW_DICTIONARY}) USING (unit_id, file_id)""")
def o94(spark, sf_dir):
    table = derive(spark, sf_dir, _TABLE).join(_row_mappings(spark, sf_dir), KEYS)
    nested = table.selectExpr(
        "unit_id", "mapping",
        "struct(full_name AS name, struct(mobile, array(email, upi_id) AS mails) AS contact, "
        "unit_id + 1 AS number, map('pan', pan) AS ids, cast(null AS string) AS nothing) AS doc")
    masked = mask.mask_nested(F.col("doc"), nested.schema["doc"].dataType, F.col("mapping"))
    return nested.select("unit_id", masked.alias("d")).selectExpr(
        "unit_id", "d.name", "d.contact.mobile", "d.contact.mails[0] AS mail0",
        "d.contact.mails[1] AS mail1", "d.number", "d.ids['pan'] AS pan", "d.nothing")


# Bank accounts and phone numbers stored as numbers, next to numbers that nobody detected.
@check("o94_numbers_masked", ctes(**_TABLE_DET) + f"""
SELECT unit_id, {fold('mobile', 'm')} AS phone, {fold('bank_account', 'm')} AS account, CAST(unit_id AS VARCHAR) AS plain_number
FROM tab JOIN ({_ROW_DICTIONARY}) USING (unit_id, file_id)""")
def o94_numbers(spark, sf_dir):
    table = derive(spark, sf_dir, _TABLE).join(_row_mappings(spark, sf_dir), KEYS)
    nested = table.selectExpr(
        "unit_id", "mapping", "struct(cast(mobile AS bigint) AS phone, "
        "array(cast(bank_account AS decimal(20, 0))) AS accounts, unit_id AS plain_number) AS doc")
    masked = mask.mask_nested(F.col("doc"), nested.schema["doc"].dataType, F.col("mapping"))
    return nested.select("unit_id", masked.alias("d")).selectExpr(
        "unit_id", "d.phone", "d.accounts[0] AS account", "d.plain_number")


# Documents of two shapes, as VARIANT; a phone number as a number.
@check("o94_variant_mask", ctes(**_TABLE_DET) + f"""
SELECT unit_id, CASE WHEN unit_id % 2 = 0 THEN {fold('mobile', 'm')} END AS phone, CASE WHEN unit_id % 2 = 0 THEN {fold('pan', 'm')} END AS pan,
  CASE WHEN unit_id % 2 = 1 THEN {fold('full_name', 'm')} END AS name, CASE WHEN unit_id % 2 = 1 THEN {fold('email', 'm')} END AS mail
FROM tab JOIN ({_ROW_DICTIONARY}) USING (unit_id, file_id)""")
def o94_variant(spark, sf_dir):
    table = derive(spark, sf_dir, _TABLE).join(_row_mappings(spark, sf_dir), KEYS)
    text = F.expr("CASE WHEN unit_id % 2 = 0 THEN concat('{\"a\": {\"phone\": ', mobile, ', \"pan\": [\"', pan, '\"]}}') "
                  "ELSE concat('[', to_json(named_struct('name', full_name)), ', ', to_json(named_struct('mail', array(email))), ']') END")
    masked = nested.mask_variant(F.parse_json(text), F.col("mapping"))
    docs = table.select("unit_id", masked.alias("v"))
    paths = {"phone": "$.a.phone", "pan": "$.a.pan[0]", "name": "$[0].name", "mail": "$[1].mail[0]"}
    return docs.select("unit_id", *[F.try_variant_get("v", p, "string").alias(n) for n, p in paths.items()])


def _texts_check(name, sql_text):
    """Mask statement, paragraph or page texts of each row with the row's mapping."""
    sql = ctes(**_TABLE_DET) + (
        f"SELECT unit_id, {fold(sql_text, 'm')} AS masked FROM tab JOIN ({_ROW_DICTIONARY}) USING (unit_id, file_id)")

    @check(name, sql)
    def query(spark, sf_dir):
        table = derive(spark, sf_dir, _TABLE).join(_row_mappings(spark, sf_dir), KEYS)
        texts = table.select("unit_id", "mapping", F.expr(sql_text).alias("text"))
        return texts.select("unit_id", mask.replace_all(F.col("text"), F.col("mapping")).alias("masked"))


_texts_check("o95_statement_mask", "concat('INSERT INTO users VALUES (''', full_name, ''', ''', mobile, ''', ''', email, ''')')")
_texts_check("o96_paragraph_mask", "concat('Dear ', full_name, ', your account ', bank_account, ' and card ', pan, '.')")
_texts_check("o97_page_mask", "concat('Page one', chr(10), address, chr(10), aadhaar, chr(10), email)")


@check("o99_no_leak_after_masking", ctes(t=UNITS) + """
SELECT count(*) AS texts, CAST(0 AS BIGINT) AS leaks FROM t""")
def o99(spark, sf_dir):
    vault_table = tokens(spark, sf_dir)
    masked = batch.stage(mask.mask_by_file(derive(spark, sf_dir, UNITS), vault_table, KEYS), "check-masked")
    found = mask.leaks(masked, vault_table, KEYS).agg(F.count("*")).scalar()
    return masked.agg(F.count("*").alias("texts")).select("texts", found.alias("leaks"))


@check("o99_leaks_of_plain_text", ctes(**VAULT) + """
SELECT unit_id, file_id, value FROM t JOIN vault USING (file_id) WHERE contains(text, value)""")
def o99_plain(spark, sf_dir):
    units = derive(spark, sf_dir, UNITS)
    return mask.leaks(units, tokens(spark, sf_dir), KEYS, text="text").select("unit_id", "file_id", "value")


@check("o100_detokenise", ctes(t=UNITS) + "SELECT unit_id, file_id, text AS restored FROM t")
def o100(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    table = _vault(staged)
    spans = batch.stage(mask.unit_tokens(explode_detections(staged, KEYS), table, KEYS), "check-spans")
    masked = mask.mask_texts(staged, spans, KEYS).select(*KEYS, "masked")
    sealed = batch.stage(vault.encrypt_values(table, KEY), "check-vault")
    revealed = vault.reverse_tokens(sealed, KEY)
    return mask.detokenise(masked, revealed, KEYS).select("unit_id", "file_id", "restored")


def _run(spark, sf_dir, source, **options):
    """A run of the few small files of the checks, dealt out over all cores."""
    if not spark.conf.get(KEY_CONF, None):
        spark.conf.set(KEY_CONF, KEY)
    options.setdefault("partitions", spark.sparkContext.defaultParallelism)
    return batch.run(derive(spark, sf_dir, source), scratch_dir(spark, "check-run"), "run-1", **options)


@check("batch_run_masked", ctes(**VAULT) + f"SELECT unit_id, file_id, masked FROM ({_SPLICED})")
def batch_masked(spark, sf_dir):
    out = _run(spark, sf_dir, UNITS, scope="spans").masked
    return out.select("unit_id", F.col("file_id").cast("bigint"), "masked")


@check("batch_run_masked_file_scope", ctes(**VAULT) + f"SELECT unit_id, file_id, masked FROM ({_BY_FILE})")
def batch_masked_file(spark, sf_dir):
    out = _run(spark, sf_dir, UNITS).masked
    return out.select("unit_id", F.col("file_id").cast("bigint"), "masked")


@check("batch_run_report", ctes(**DET) + """
SELECT f.file_id, coalesce(n, 0) AS total_pii_found FROM (SELECT DISTINCT file_id FROM t) f
LEFT JOIN (SELECT file_id, count(*) AS n FROM det GROUP BY file_id) USING (file_id)""")
def batch_report(spark, sf_dir):
    return _run(spark, sf_dir, UNITS).report.select("file_id", "total_pii_found")


@check("batch_run_vault", ctes(**VAULT) + "SELECT file_id, token, value, pii_type FROM vault")
def batch_vault(spark, sf_dir):
    table = _run(spark, sf_dir, UNITS).vault
    values = vault.reverse_tokens(table, KEY)
    return values.join(table.select("file_id", "token", "pii_type"), ["file_id", "token"])


def _two_runs(spark, sf_dir, scope="spans"):
    """The units in two runs with one output: every file has a part in each."""
    if not spark.conf.get(KEY_CONF, None):
        spark.conf.set(KEY_CONF, KEY)
    out, whole = scratch_dir(spark, "check-runs"), derive(spark, sf_dir, UNITS)
    cores = spark.sparkContext.defaultParallelism
    parts = [batch.run(whole.where(f"unit_id div 7 % 2 = {k}"), out, f"run-{k}", scope=scope, partitions=cores)
             for k in (0, 1)]
    return parts, out


@check("o81_unique_across_runs", ctes(**{
    **VAULT, "firsts": VAULT["firsts"].replace("{'a'", "{'r': unit_id // 7 % 2, 'a'")}) + """
SELECT file_id, token, value, CAST(1 AS BIGINT) AS n_values FROM vault""")
def o81_runs(spark, sf_dir):
    """Values with their tokens after two runs: no token stands for two values, and a value
    keeps the token of the first run that found it."""
    _, out = _two_runs(spark, sf_dir)
    values = vault.reverse_tokens(arrivals.whole_vault(spark, out), KEY)
    return values.groupBy(F.col("file_id").cast("bigint").alias("file_id"), "token").agg(
        F.min("value").alias("value"), F.count_distinct("value").alias("n_values"))


@check("o73_report_over_two_runs", ctes(**DET) + """
SELECT f.file_id, coalesce(n, 0) AS total_pii_found, coalesce(k, 0) AS types FROM (SELECT DISTINCT file_id FROM t) f
LEFT JOIN (SELECT file_id, count(*) AS n, count(DISTINCT pii_type) AS k FROM det GROUP BY file_id) USING (file_id)""")
def o73_runs(spark, sf_dir):
    _, out = _two_runs(spark, sf_dir)
    return arrivals.all_reports(spark, out).select(
        F.col("file_id").cast("bigint").alias("file_id"), "total_pii_found",
        F.size("pii_breakdown").cast("bigint").alias("types"))


@check("o100_detokenise_file_scope", ctes(t=UNITS) + "SELECT unit_id, file_id, text AS restored FROM t")
def o100_file(spark, sf_dir):
    """Every occurrence of every value replaced, over two runs, and restored."""
    parts, out = _two_runs(spark, sf_dir, "file")
    masked = parts[0].masked.unionByName(parts[1].masked)
    revealed = vault.reverse_tokens(arrivals.whole_vault(spark, out), KEY)
    back = mask.detokenise(masked, revealed, KEYS)
    return back.select("unit_id", F.col("file_id").cast("bigint").alias("file_id"), "restored")


# Documents, pages and derived rows together: every source one file.
_ALL = f"SELECT src AS file_id, concat(src, '-', CAST(unit_id AS STRING)) AS unit_id, text FROM ({CORPUS}) c"


@check("batch_run_corpus_leaks", ctes(t=_ALL) + """
SELECT file_id, count(*) AS texts, CAST(0 AS BIGINT) AS leaks FROM t GROUP BY file_id""")
def batch_corpus(spark, sf_dir):
    """Texts per source after a run as it is by default, and how many values of the source's vault
    they still hold; every unit comes back exactly once."""
    return _leaks_by_file(_run(spark, sf_dir, _ALL))


def _leaks_by_file(result):
    masked = result.masked
    found = mask.leaks(masked, result.tokens, KEYS).groupBy("file_id").agg(F.count("*").alias("_leaks"))
    texts = masked.groupBy("file_id").agg(F.count("*").alias("texts"))
    return texts.join(found, "file_id", "left").select(
        "file_id", "texts", F.coalesce("_leaks", F.lit(0)).cast("bigint").alias("leaks"))


@check("o99_default_run_leaks", ctes(**VAULT) + """
SELECT file_id, texts, CAST(0 AS BIGINT) AS leaks, n_values, plain FROM (SELECT file_id, count(*) AS texts FROM t GROUP BY file_id)
JOIN (SELECT file_id, count(*) AS n_values FROM vault GROUP BY file_id) USING (file_id)
JOIN (SELECT file_id, count(*) AS plain FROM t JOIN vault USING (file_id) WHERE contains(text, value) GROUP BY file_id) USING (file_id)""")
def o99_default(spark, sf_dir):
    """Per file of a run as it is by default: texts, values in the vault, places (text, value) where
    they stood, and how many of them are left."""
    result = _run(spark, sf_dir, UNITS)
    stood = mask.leaks(derive(spark, sf_dir, UNITS), result.tokens, KEYS, text="text")
    plain = stood.groupBy("file_id").agg(F.count("*").alias("plain"))
    values = result.tokens.groupBy("file_id").agg(F.count("*").alias("n_values"))
    left = _leaks_by_file(result).withColumn("file_id", F.col("file_id").cast("bigint"))
    return left.join(values, "file_id").join(plain, "file_id")


@check("o99_leaks_of_span_run", ctes(**VAULT) + f"""
SELECT unit_id, file_id, value FROM ({_SPLICED}) m JOIN vault USING (file_id)
WHERE contains(regexp_replace(masked, '{mask.TOKEN_PATTERN}', chr(1), 'g'), value)""")
def o99_spans(spark, sf_dir):
    """What scope "spans" leaves: values at places where the context did not support them."""
    result = _run(spark, sf_dir, UNITS, scope="spans")
    masked = result.masked.withColumn("file_id", F.col("file_id").cast("bigint"))
    return mask.leaks(masked, result.tokens, KEYS).select("unit_id", "file_id", "value")
