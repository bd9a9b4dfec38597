"""Fixed values of the domain."""

# Thresholds and codes that results depend on.
FREEZE_RATIO = 0.10
UMBRELLA_AMOUNT = 1e9
AMOUNT_MISMATCH = 0.25
FUZZY_DISTANCE = 0.08
FUZZY_DAYS = 90
FUZZY_PER_NOTICE = 5
CLOSEOUT_DAYS = 120
MIN_POST_OUTLAY = 100.0
HIGH_GAP_DAYS = 180
MEDIUM_GAP_DAYS = 90
DEOBLIGATION_MIN_AMOUNT = 1000.0
DEOBLIGATION_MIN_EVENTS = 2
OVER_DISBURSED = 1.5

FROZEN_TYPES = ("possible_freeze", "possible_freeze_no_data")
FREEZE_RELATED_TYPES = ("possible_freeze", "possible_freeze_no_data", "active_despite_terminated")
EMERGENCY_CODES = ("Z", "L", "M", "3", "4", "5", "6", "7", "N")
TERMINATION_ACTIONS = ("E", "F")
ACTIVITY_ACTIONS = ("A", "B", "C", "G")
NON_RESEARCH_SUB_AGENCIES = (
    "Administration for Children and Families",
    "Centers for Medicare and Medicaid Services",
    "Health Resources and Services Administration",
    "Substance Abuse and Mental Health Services Administration",
    "Administration for Community Living",
    "Administration for Strategic Preparedness and Response",
)
ORG_STOPWORDS = (
    "UNIVERSITY", "OF", "THE", "COLLEGE", "INSTITUTE", "SCHOOL", "CENTER",
    "MEDICAL", "RESEARCH", "HEALTH", "STATE", "NATIONAL", "DEPARTMENT",
    "FOUNDATION", "HOSPITAL", "SCIENCES", "SCIENCE", "COMMUNITY", "SYSTEM",
    "AND", "FOR", "AT", "IN",
)
CFDA_AGENCY = {
    "93": "Department of Health and Human Services",
    "47": "National Science Foundation",
    "66": "Environmental Protection Agency",
}
AGENCY_CODES = {
    "Department of Health and Human Services": "075",
    "National Science Foundation": "049",
    "Environmental Protection Agency": "068",
}
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
    "DC", "PR", "GU", "VI", "AS", "MP",
)
CANADIAN_PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")
FROZEN_STATUSES = ("\U0001f9ca Frozen Funding", "\U0001f4a7 Possibly Unfrozen Funding", "\U0001f6b0 Unfrozen Funding")
