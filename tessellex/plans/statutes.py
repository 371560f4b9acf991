"""Statute texts derived from ``part``, one document per row.

The given document table holds no statutory text, so the extraction operators
are checked on texts that both engines build from the integers and names of
``part`` with one SQL expression. The branches of ``k`` reach every rule: roman,
arabic and no chapter; years, months, fine in figures and in words, deportation,
cancellation, no penalty; a year before 1947; schedules; definitions in three
forms; contents pages; Devanagari pages; texts without any header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAMES = ("Citizenship", "Passports", "Emigration", "Foreigners Registration", "Visa Control", "Inland Waterways")
_NL = "chr(10)"


def _case(modulus: int, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE k % {modulus} {arms} ELSE {values[-1]} END"


def _text_sql() -> str:
    names = _case(6, *[f"'{n}'" for n in _NAMES])
    year = "CASE WHEN k % 10 = 3 THEN '1946' ELSE CAST(1950 + k % 70 AS STRING) END"
    act = (
        f"'The ' || {names} || ' (' || name || ') ' || "
        "CASE WHEN k % 5 = 4 THEN 'Rules' WHEN k % 11 = 5 THEN 'Act (Amendment)' ELSE 'Act' END"
        f" || ', ' || {year}"
    )
    contents = (
        "CASE WHEN k % 6 = 2 THEN 'ARRANGEMENT OF SECTIONS' || chr(10) || '1. Short title' || chr(10) || "
        "'2. Definitions' || chr(10) || '3. Penalty for entry' || chr(12) ELSE '' END"
    )
    devanagari = "CASE WHEN k % 9 = 8 THEN repeat('नागरिकता ', 12) || chr(12) ELSE '' END"
    head = (
        f"CASE WHEN k % 13 = 7 THEN '[ extract no. ' || ks || ' ]' || {_NL} ELSE {act} || {_NL} || "
        f"CASE WHEN k % 4 <> 1 THEN 'Act No. ' || CAST(k + 1 AS STRING) || ' of ' || {year} || {_NL} ELSE '' END END"
    )
    chapter_one = _case(
        3,
        "''",
        f"'CHAPTER I: PRELIMINARY' || {_NL}",
        f"'CHAPTER 1 - PRELIMINARY' || {_NL} || {_NL}",
    )
    title = (
        "'1. Short title and extent.— This Act may be called the ' || name || ' law of the Central Government.' || chr(10)"
    )
    definitions = (
        "'2. Definitions.— In this Act, unless the context otherwise requires,' || chr(10) || "
        "'“citizen of grade ' || name || '” means a person who holds a citizenship certificate; ' || chr(10) || "
        "CASE WHEN k % 2 = 0 THEN '\"alien\" - any foreign national without a residential permit; ' || chr(10) ELSE '' END || "
        "'(a) \"port of entry\" means any place notified by the State Government for arrival; ' || chr(10) || "
        "'(b) The Registrar-General and the registrar general shall keep the register.' || chr(10)"
    )
    penalty = _case(
        7,
        "'shall be punishable with imprisonment for a term which may extend to ' || CAST(k % 7 + 1 + k % 3 AS STRING) || "
        "' years, or with fine of Rs. ' || CAST(k % 90 + 10 AS STRING) || ',000, or with both.'",
        "'shall be liable to imprisonment which may extend to ' || CAST(k % 11 + 1 AS STRING) || ' months.'",
        "'shall be liable to a fine of INR ' || CAST(k * 100 AS STRING) || '.50 for each offence.'",
        "'shall be liable to be deported and deportation shall follow.'",
        "'is liable to have the certificate cancelled by the Passport Officer.'",
        "'shall inform the Immigration Officer at the port of entry.'",
        "'shall be punishable with fine which may extend to five thousand rupees.'",
    )
    offences = (
        f"CASE WHEN k % 3 = 0 THEN '' ELSE 'CHAPTER II - OFFENCES AND PENALTIES' || {_NL} END || "
        "'3. Penalty for entry and stay.— (1) Whoever contravenes section 2 of this Act, or section ' || "
        f"CAST(k % 19 + 4 AS STRING) || ', ' || {penalty} || {_NL} || "
        f"'(2) Nothing in sub-section (1) applies to a person named in the ' || "
        f"{_case(4, repr('First'), repr('Second'), repr('third'), repr('Twelfth'))} || ' Schedule.' || {_NL} || "
        "CASE WHEN k % 2 = 1 THEN 'Provided that nothing in this section shall apply to a minor;' || chr(10) || "
        "'Provided further that the High Court may direct otherwise.' || chr(10) ELSE '' END || "
        "CASE WHEN k % 4 = 2 THEN 'Explanation.— For the purposes of this section a visa on arrival is a visa.' || chr(10) || chr(10) ELSE '' END || "
        "CASE WHEN k % 5 = 1 THEN 'Illustration (a).— A enters with an emergency certificate.' || chr(10) || chr(10) ELSE '' END || "
        "CASE WHEN k % 6 = 4 THEN 'Exception 1.— A diplomatic passport holder is exempt.' || chr(10) || chr(10) ELSE '' END"
    )
    powers = (
        "'Section 4. Powers of authorities.— (1) The Central Government may, under section ' || CAST(k % 30 + 1 AS STRING) || "
        "' of the Passports Act, 1967, make an order. The central government may delegate it to the FRRO or to the Supreme Court.' || chr(10) || "
        "'(2) Rules under rule ' || CAST(k % 8 + 1 AS STRING) || ' of the Foreigners Registration Rules, 1992 shall apply to emigration clearance.' || chr(10) || "
        "CASE WHEN k % 8 = 5 THEN 'FORM I' || chr(10) || 'Declaration for section 3 and penalty for entry.' || chr(10) ELSE '' END || "
        "'Page ' || CAST(k % 40 + 1 AS STRING) || chr(10)"
    )
    plain = (
        "'notice ' || ks || ' on ' || name || ': applicants for a tourist visa or a work visa report to the "
        "immigration officer. no further conditions apply.'"
    )
    body = f"{devanagari} || {contents} || {head} || {chapter_one} || {title} || {definitions} || chr(12) || {offences} || {powers}"
    return f"CASE WHEN k % 17 = 16 THEN {plain} ELSE {body} END"


STATUTE_SQL = f"""
SELECT k AS doc_id,
       'corpus/' || replace(name, ' ', '_') || '_' || ks || CASE WHEN k % 3 = 0 THEN '.pdf' ELSE '.TXT' END AS source_file,
       {_text_sql()} AS text
FROM (SELECT p_partkey AS k, p_name AS name, CAST(p_partkey AS STRING) AS ks FROM part) AS p
"""


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source_file, text)``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(STATUTE_SQL.replace("FROM part)", "FROM {part})"), part=part)
