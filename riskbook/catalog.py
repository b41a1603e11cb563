"""Fixed vocabularies, stated once: fields, hints, words, levers and codes that results must agree on."""

# The vocabulary of loan fields and their roles.
FIELDS = {
    "loan_id": "id", "loan_amount": "feature", "term_months": "feature", "interest_rate": "feature", "income_or_turnover": "feature", "dscr": "feature", "credit_score": "feature", "sector": "feature",
    "collateral_value": "feature", "prior_delinquencies": "feature", "employment_length": "feature", "text_purpose": "text", "region": "protected", "gender": "protected", "community": "protected", "time_observed": "time", "target": "target",
}

# Words in column names that hint at a field.
HINTS = {
    "loan_id": ["loan_id", "id", "loanid", "account", "acct", "applicationid", "loannr", "loannumber"],
    "loan_amount": ["amount", "loan_amnt", "principal", "disbursed", "grossapproval", "sba_appv", "funded", "credit_amount"],
    "term_months": ["term", "tenure", "duration", "months", "maturity"],
    "interest_rate": ["int_rate", "interest", "rate", "apr"],
    "income_or_turnover": ["income", "turnover", "revenue", "salary", "annual_inc", "sales", "ebitda"],
    "dscr": ["dscr", "debt_service", "coverage", "dti"],
    "credit_score": ["credit_score", "fico", "cibil", "bureau", "score"],
    "sector": ["sector", "industry", "naics", "purpose_category", "business_type", "occupation"],
    "collateral_value": ["collateral", "security", "asset_value", "property", "guarantee"],
    "prior_delinquencies": ["delinq", "late", "default_count", "past_due", "overdue", "dpd"],
    "employment_length": ["emp_length", "employment", "job_years", "tenure_emp", "years_in_business"],
    "text_purpose": ["purpose", "description", "desc", "title", "memo", "notes", "remarks"],
    "region": ["state", "region", "district", "city", "zip", "location", "province"],
    "gender": ["gender", "sex"],
    "community": ["community", "caste", "religion", "ethnic", "race"],
    "time_observed": ["vintage", "observed", "age_months", "months_on_book", "tenure_obs", "issue_d"],
    "target": ["default", "target", "label", "charge_off", "chargeoff", "mis_status", "is_default", "credit_risk", "risk_flag", "default_flag", "outcome", "good_bad", "loan_status", "class", "bad"],
}

# Words of an outcome column, whole and as parts.
BAD_WORDS = ["default", "defaulted", "chgoff", "charge off", "charged off", "chargeoff", "bad", "yes", "y", "true", "1", "late", "delinquent", "npa", "overdue", "writeoff", "write off", "loss"]
GOOD_WORDS = ["paid", "p i f", "pif", "fully paid", "good", "no", "n", "false", "0", "current", "clp", "ontime", "on time", "closed", "settled"]
BAD_PARTS = ["chgoff", "charge", "default", "delinq", "npa", "writeoff", "loss"]
GOOD_PARTS = ["paid", "pif", "good", "current", "closed", "settled"]

# Terms of distress in a loan's purpose.
DISTRESS_TERMS = ["loss", "debt", "overdue", "default", "struggle", "struggling", "emergency", "urgent", "shortfall", "delay", "delayed", "cash crunch", "closure", "closed", "covid", "pandemic", "flood", "drought", "lawsuit", "dispute", "refinance", "consolidate", "consolidation", "medical", "repay debt", "pay off"]

# What a borrower can change: lever, steps, whether a step is a share of the value, direction.
LEVERS = {
    "term_months": ([3, 6, 12, 18, 24], False, 1),
    "collateral_value": ([0.1, 0.25, 0.5, 1.0], True, 1),
    "income_or_turnover": ([0.1, 0.2, 0.35], True, 1),
    "interest_rate": ([0.5, 1.0, 2.0], False, -1),
}

# The reason code of each field, and all codes.
REASONS = {
    "dscr": "LIQUIDITY_STRESS", "income_or_turnover": "REVENUE_DECLINE", "loan_amount": "LEVERAGE_HIGH", "interest_rate": "LEVERAGE_HIGH", "prior_delinquencies": "REPAYMENT_HISTORY_POOR", "credit_score": "REPAYMENT_HISTORY_POOR",
    "sector": "SECTOR_RISK", "collateral_value": "COLLATERAL_LOW", "employment_length": "BEHAVIOUR_ANOMALY", "term_months": "TENURE_RISK", "time_observed": "TENURE_RISK", "text_purpose": "TEXT_DISTRESS_SIGNAL",
}

BAND_HIGH, BAND_MEDIUM, ALERT_AT = 0.50, 0.20, 0.20
# The edges of ten calibration bins as binary floating point has them.
BIN_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
# Days between events, by bucket.
GAP_EDGES = [0, 1, 2, 3, 7, 14, 30, 60, 120, 365]

# The pooled vocabulary that all corpora are brought to, and the book's fields that map onto it.
POOLED = ["can_loan_amount", "can_term_months", "can_interest_rate", "can_income", "can_dti", "can_credit_score_n", "can_age", "can_emp_length", "can_delinq_count", "can_open_accounts", "can_utilization", "can_n_employees", "can_loan_to_income", "can_installment", "can_sector"]
TO_POOLED = {"loan_amount": "can_loan_amount", "term_months": "can_term_months", "interest_rate": "can_interest_rate", "income_or_turnover": "can_income", "credit_score": "can_credit_score_n", "sector": "can_sector", "prior_delinquencies": "can_delinq_count", "employment_length": "can_emp_length"}
# Fields that count as numbers at a lower share of numbers.
KNOWN_NUMERIC = ["loan_amount", "term_months", "interest_rate", "income_or_turnover", "dscr", "credit_score", "collateral_value", "prior_delinquencies", "employment_length", "time_observed"]
# Good and bad outcomes of consumer loans; counters of late payments.
LENDING_STATUS = (
    ["Fully Paid", "Does not meet the credit policy. Status:Fully Paid"],
    ["Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off", "Late (31-120 days)"],
)
LATE_COUNTERS = ["NumberOfTime30-59DaysPastDueNotWorse", "NumberOfTimes90DaysLate", "NumberOfTime60-89DaysPastDueNotWorse"]
# Words of which one makes a column of six values or fewer an outcome.
BINARY_WORDS = ["0", "1", "yes", "no", "y", "n", "true", "false", "default", "paid", "chargeoff", "charged off", "p i f", "pif", "clp", "good", "bad", "1.0", "0.0"]
# What a lever's step asks for.
ACTIONS = {
    "term_months": "Extend tenure by {step} months (to {value})",
    "collateral_value": "Add collateral by {percent}%",
    "income_or_turnover": "Add a working-capital line / lift turnover raising serviceable cashflow ~{percent}%",
    "interest_rate": "Restructure rate down {step} pts",
}
