"""Vocabularies of claim histories. Fixed values."""

PAID_PARTS = ["paid_indemnity", "paid_medical", "paid_expense"]
RESERVE_PARTS = ["reserve_indemnity", "reserve_medical", "reserve_expense"]
TOTALS = ["paid_total", "reserve_total", "recovery_total", "incurred_total"]
MONEY_FIELDS = [*PAID_PARTS, "paid_total", *RESERVE_PARTS, "reserve_total", "recovery_total", "incurred_total"]
DATE_FIELDS = ["date_of_loss", "date_reported"]

MONEY = "decimal(28,6)"
TOLERANCE = "0.01"
OUTLIER_MULTIPLE = 100

#: Reasons of a null that a person should look at.
REVIEW_REASONS = ["DASH_PLACEHOLDER", "AMBIGUOUS_SEPARATOR", "AMBIGUOUS_DATE_ORDER", "UNPARSEABLE", "INVALID_DATE", "OUT_OF_RANGE"]

#: Texts that say no value applies.
NOT_APPLICABLE = ["N/A", "NA", "N.A.", "N/A.", "NIL", "NONE", "NULL", "N\\A", "NOT APPLICABLE"]

#: Currency signs and ISO codes.
CURRENCY_SIGNS = {"US$": "USD", "C$": "CAD", "A$": "AUD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₤": "GBP", "₹": "INR", "₽": "RUB"}
CURRENCY_CODES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF", "MXN", "NZD", "SEK", "NOK", "DKK"]

#: Printed statuses.
STATUSES = {
    "OPEN": ["o", "op", "opn", "open", "active", "pending"],
    "CLOSED": ["c", "cl", "cld", "clsd", "closed", "close", "final", "settled"],
    "REOPENED": ["r", "ro", "reop", "reopen", "reopened", "re open", "re opened"],
    "CLOSED_PAID": ["closed paid", "closed with payment", "closed pd", "cwp", "paid and closed"],
    "REPORT_ONLY": ["report only", "record only", "incident only", "notice only", "info only", "ro only"],
}
OPEN_STATUSES = ["OPEN", "REOPENED"]

#: Printed flags.
TRUE_TEXTS = ["y", "yes", "true", "t", "1", "lit", "litigated", "in suit", "suit"]
FALSE_TEXTS = ["n", "no", "false", "f", "0", "none", "not litigated"]
