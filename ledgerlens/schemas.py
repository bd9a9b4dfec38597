"""Table schemas, and filling tables up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, StringType, StructType

_TYPES = {"string": StringType(), "double": DoubleType(), "date": DateType(), "int": IntegerType(), "boolean": BooleanType()}


def fields(text: str) -> StructType:
    """A schema from "name type, name type"; unlike DDL it needs no session."""
    out = StructType()
    for part in text.split(", "):
        name, kind = part.split(" ")
        out.add(name, _TYPES[kind])
    return out


NOTICES = fields("agency_name string, institute string, directorate string, notice_date date, date_added date, source_url string, raw_text_snippet string, grant_number string, org_name string, org_state string, award_amount double, is_active boolean")
AWARDS = fields("grant_number string, recipient_name string, recipient_uei string, agency_name string, sub_agency string, award_amount double, total_outlays double, action_date date, end_date date, last_modified_date date, description string, cfda_number string, def_codes string, generated_internal_id string")
TRANSACTIONS = fields("grant_number string, transaction_date date, obligation_amount double, transaction_desc string, action_type string, modification_number string")
SUBAWARDS = fields("subaward_id string, subawardee_name string, subaward_date date, subaward_amount double, prime_award_id string, prime_recipient string, agency_name string, sub_agency string")
SUBAWARD_IMPACT = fields("award_id string, subaward_count int, subaward_obligation double, award_generated_internal_id string")
FILE_C = fields("grant_number string, reporting_date date, reporting_year int, reporting_month int, outlay_amount double, obligated_amount double, federal_account string, account_title string")


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the schema's missing columns as typed nulls; what is there stays."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def require_columns(df: DataFrame, schema: StructType) -> None:
    """Raise unless df has every column of the schema with its type."""
    types = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in types]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    wrong = [f"{f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema if types[f.name] != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
