"""Loan corpora of different make brought into one shape: label, the corpus's own columns, the pooled vocabulary.

Each loader takes the corpus's table and gives a frame with its key, `label` (1: bad), own columns, the pooled columns
(catalog.POOLED, null where the corpus has none), protected attributes and, where there is one, `time_key`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import clean_numeric

from .corpora import label_filter


def number(name: str) -> Column:
    return clean_numeric(F.col(name))


def digits(name: str) -> Column:
    """The first run of digits in a text, as a number."""
    return F.regexp_extract(F.col(name).cast("string"), r"(\d+)", 1).try_cast("double")


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


#: A two-digit year from here on is of the last century.
PIVOT = 69
#: The forms of dates, by what they look like; two-digit years are written out before.
DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^[A-Za-z]{3}-\d{4}$", "MMM-yyyy"),
)


def mixed_date(name: str, pivot: int = PIVOT) -> Column:
    """A date from text in any of some common forms, each value by its own; two-digit years below `pivot` are of this century,
    the others of the last. What looks like no date is null."""
    text = F.trim(F.col(name).cast("string"))
    short = r"^(\d{1,2}-[A-Za-z]{3}-|\d{1,2}/\d{1,2}/|\d{1,2} [A-Za-z]{3} |[A-Za-z]{3}-)(\d{2})$"
    year = F.regexp_extract(text, short, 2)
    century = F.when(year.try_cast("int") >= pivot, "19").otherwise("20")
    full = F.when(year != "", F.concat(F.regexp_extract(text, short, 1), century, year)).otherwise(text)
    form = reduce(lambda other, x: F.when(full.rlike(x[0]), F.try_to_timestamp(F.substring_index(F.substring_index(full, "T", 1), " ", 1) if x[1] == "yyyy-M-d" else full, F.lit(x[1]))).otherwise(other), reversed(DATE_FORMS), F.lit(None).cast("timestamp"))
    return form.cast("date")


def shaped(df: DataFrame, key: str, own: dict[str, Column], pooled: dict[str, Column], protected: dict[str, Column] | None = None, time_key: Column | None = None) -> DataFrame:
    blank = {c: pooled.get(c, F.lit(None)).cast("string" if c == "can_sector" else "double") for c in C.POOLED}
    extra = {"time_key": time_key} if time_key is not None else {}
    return df.select(key, "label", *[c.alias(n) for n, c in (own | blank | (protected or {}) | extra).items()])


def sba(df: DataFrame, key: str) -> DataFrame:
    """Small-business loans."""
    gross, backed, term = number("GrAppv"), number("SBA_Appv"), number("Term")
    letter = lambda c: F.substring(F.upper(F.col(c).cast("string")), 1, 1)
    industry, year = F.substring(F.col("NAICS").cast("string"), 1, 2), F.year(mixed_date("ApprovalDate"))
    own = {
        "term": term, "no_emp": number("NoEmp"), "new_exist": number("NewExist"), "create_job": number("CreateJob"), "retained_job": number("RetainedJob"), "urban_rural": number("UrbanRural"), "franchise": (number("FranchiseCode") > 1).cast("int"),
        "rev_line_cr": letter("RevLineCr"), "low_doc": letter("LowDoc"), "disbursement": number("DisbursementGross"), "gr_appv": gross, "sba_appv": backed, "sba_portion": backed / nonzero(gross), "naics2": industry,
        "bank_state_same": (F.col("BankState") == F.col("State")).cast("int"), "approval_year": year,
    }
    pooled = {"can_loan_amount": gross, "can_term_months": term, "can_n_employees": own["no_emp"], "can_sector": industry, "can_emp_length": F.when(own["new_exist"] == 1, 5.0).otherwise(0.5), "can_installment": gross / nonzero(term)}
    return shaped(label_filter(df, "MIS_Status", ["P I F"], ["CHGOFF"]), key, own, pooled, {"region": F.col("State").cast("string")}, year)


def lending(df: DataFrame, key: str) -> DataFrame:
    """Consumer loans."""
    good, bad = C.LENDING_STATUS
    fico = (number("fico_range_low") + number("fico_range_high")) / 2
    numbers = ("loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies")
    texts = ("grade", "sub_grade", "home_ownership", "verification_status", "purpose", "application_type")
    own = {c: number(c) for c in numbers if c in df.columns} | {c: F.col(c).cast("string") for c in texts if c in df.columns} | {"term": digits("term"), "emp_length": digits("emp_length"), "fico": fico}
    pooled = {
        "can_loan_amount": number("loan_amnt"), "can_term_months": own["term"], "can_interest_rate": number("int_rate"), "can_income": number("annual_inc"), "can_dti": number("dti"), "can_credit_score_n": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (fico - 300) / 550)),
        "can_emp_length": own["emp_length"], "can_delinq_count": number("delinq_2yrs"), "can_open_accounts": number("open_acc"), "can_utilization": number("revol_util"), "can_installment": number("installment"), "can_sector": F.col("purpose").cast("string"),
        "can_loan_to_income": number("loan_amnt") / nonzero(number("annual_inc")),
    }
    pooled["can_credit_score_n"] = F.when(fico.isNotNull(), pooled["can_credit_score_n"])
    return shaped(label_filter(df, "loan_status", good, bad), key, own, pooled, {"region": F.col("addr_state").cast("string")}, F.year(mixed_date("issue_d")))


def delinquency(df: DataFrame, key: str) -> DataFrame:
    """A delinquency benchmark: all its columns but the label are its own."""
    late = [number(f"`{c}`") for c in C.LATE_COUNTERS]
    kept = df.where(F.col("SeriousDlqin2yrs").isNotNull()).withColumn("label", F.col("SeriousDlqin2yrs").cast("int"))
    own = {c: number(f"`{c}`") for c in df.columns if c not in (key, "SeriousDlqin2yrs") and not c.startswith("Unnamed")}
    pooled = {
        "can_age": number("age"), "can_income": number("MonthlyIncome") * 12, "can_dti": number("DebtRatio"), "can_utilization": number("RevolvingUtilizationOfUnsecuredLines") * 100,
        "can_open_accounts": number("NumberOfOpenCreditLinesAndLoans"), "can_delinq_count": late[0] + late[1] + late[2],
    }
    return shaped(kept, key, own, pooled)


def card_panel(df: DataFrame, key: str) -> DataFrame:
    """Card holders with six months of payment status, bills and payments in columns."""
    paid = [F.col(f"PAY_{k}").cast("double") for k in range(6)]
    limit, bill, payment = number("LIMIT_BAL"), number("BILL_AMT1"), number("PAY_AMT1")
    late = F.aggregate(F.array(*[F.coalesce((p > 0).cast("int"), F.lit(0)) for p in paid]), F.lit(0), lambda a, x: a + x)
    use = bill / nonzero(limit)
    own = {c: number(c) for c in df.columns if c not in (key, "SEX", "target")} | {"pay_max": F.greatest(*paid), "pay_sum_late": late, "util_ratio": use, "pay_ratio": payment / nonzero(bill)}
    clipped = F.when(use.isNotNull(), F.least(F.lit(500.0), F.greatest(F.lit(0.0), use * 100)))
    pooled = {"can_loan_amount": limit, "can_age": number("AGE"), "can_delinq_count": late, "can_utilization": clipped, "can_installment": payment}
    gender = F.when(F.col("SEX") == 1, "male").when(F.col("SEX") == 2, "female").otherwise("nan")
    return shaped(df.withColumn("label", F.col("target").cast("int")), key, own, pooled, {"gender": gender})


def positional(df: DataFrame, key: str) -> DataFrame:
    """A benchmark with columns Attribute1 to 20 and a class of 1 and 2 (2: bad), or of 0 and 1."""
    coded = df.agg((F.max("class") == 2).alias("_coded"))
    labelled = df.crossJoin(F.broadcast(coded)).withColumn("label", F.when(F.col("_coded"), (F.col("class") == 2).cast("int")).otherwise(F.col("class").cast("int")))  # one row
    own = {c: F.col(c) for c in df.columns if c.startswith("Attribute")}
    fields = {"can_term_months": 2, "can_loan_amount": 5, "can_installment": 8, "can_age": 13, "can_open_accounts": 16}
    return shaped(labelled, key, own, {name: number(f"Attribute{k}") for name, k in fields.items()})
