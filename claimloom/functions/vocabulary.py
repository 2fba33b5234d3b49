"""What printed labels mean: fields of claims and documents, template labels, carriers. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, normalize_label

#: Normalised labels of claim columns, by field.
FIELD_LABELS = {
    "claim_number": "claim number, claim no, claim nbr, clm nbr, clm no, claim, claim id, file number, file no, claim num, claimno, occurrence number, claim ref, claim reference, clm ref, claim ref no, claim reference number, file ref",
    "date_of_loss": "date of loss, loss date, dol, loss dt, date of accident, accident date, occurrence date, doi, trigger date, date of occurrence, event date, date of injury, injury date",
    "date_reported": "date reported, reported, rptd, rpt dt, report date, reported date, notice date, date rptd",
    "claim_status": "status, stat, st, claim status, open closed, o c",
    "claimant_name": "claimant, claimant name, injured worker, employee, employee name, name",
    "loss_description": "description of loss, description, loss description, desc, accident description, description of accident",
    "cause_of_loss": "cause, cause of loss, loss cause, peril, cause desc, coverage",
    "paid_total": "paid, paid total, total paid, pd tot, paid to date, payment, payments, total payment, total payments",
    "reserve_total": "reserve, reserves, outstanding, rsv tot, rem reserve, remaining reserve, reserve remaining, outstanding reserve",
    "recovery_total": "recovery, recoveries, recov, subrogation, subro, salvage, deductible recoverable, deductible reimbursement",
    "paid_expense": "alae, lae, defense cost, defense costs, legal expense, defense",
    "incurred_total": "incurred, total incurred, net incurred, incurred total, total",
    "claimant_ref": "claimant ref, claimant id, claimant number, claimant no",
    "close_date": "close date, date closed, closed date, closed",
    "loss_state": "loss state, state, jurisdiction, state of loss",
    "body_part": "body part, part of body, injured body part",
    "nature_of_injury": "nature of injury, injury type, injury, nature",
    "ncci_class_code": "class code, ncci class, ncci code, ncci",
    "medical_only_flag": "medical only, med only",
    "litigation_flag": "suit, litigation, lit, in suit, litigated, attorney",
}
#: Labels that name their field only loosely, so a qualified one wins.
BARE = ["reserve", "reserves"]
#: Words of money groups and of their parts; the first group, and the first part, that a label has a word of.
GROUP_WORDS = {
    "paid": "paid, pd, pay, payment, payments",
    "reserve": "reserve, reserves, res, rsv, rsrv, outstanding",
    "recovery": "recovery, recoveries, recov, subro, subrogation, salvage",
    "incurred": "incurred, incur, inc",
}
PART_WORDS = {
    "indemnity": "indemnity, indem, indm, ind, bi, loss, losses",
    "medical": "medical, med",
    "expense": "expense, expenses, exp, alae, lae, alloc, allocated",
}
#: Labels of facts about a whole document.
DOCUMENT_LABELS = {
    "carrier": "carrier, company, company name, insurer, insurance company, underwriting company, writing company",
    "named_insured": "insured, insured name, named insured, policyholder, policy holder, client name, account name",
    "policy_number": "policy number, policy no, policy num, policy, policy id",
    "line_of_business": "line of business, lob, coverage, coverage line, product line, business line",
    "policy_period_start": "inception date, inception, effective date, policy effective date, policy inception, policy start date, term start",
    "policy_period_end": "expiry date, expiry, expiration date, policy expiration date, policy expiry, policy end date, term end",
    "currency": "currency, reporting currency, settlement currency, ccy",
}
#: Labels that a template prints above its table.
TEMPLATE_LABELS = (
    "named insured, insured, policy number, policy no, policy period, policy term, valuation date, valued as of, evaluation date, as of date, line of business, coverage, currency, loss run, "
    "claims listing, claim detail, report date, run date, producer, agent, branch, underwriter, total claims, number of claims"
)


def listed(text: str) -> list[str]:
    return text.split(", ")


def lookup(label: Column, groups: dict[str, str]) -> Column:
    """The name of the group that lists a label, or null."""
    table = F.create_map(*[F.lit(x) for name, text in groups.items() for label_ in listed(text) for x in (label_, name)])
    return F.try_element_at(table, label)


def guess_field(c: Column) -> Column:
    """(field, confidence, source) of a column's label: by the dictionary, else by its words, parts of money groups included; no field rather than a bad guess."""
    label = normalize_label(c)
    words = F.split(label, " ")
    has = lambda text: F.arrays_overlap(words, F.array(*map(F.lit, listed(text))))
    first = lambda groups: F.coalesce(*[F.when(has(text), F.lit(name)) for name, text in groups.items()])
    group, part = first(GROUP_WORDS), first(PART_WORDS)
    dated = has("date, dt") | has("dol, doi")
    rules = [
        (has("description, desc, narrative"), F.lit("loss_description"), 0.8), (has("cause, peril"), F.lit("cause_of_loss"), 0.8), (has("claimant, injured"), F.lit("claimant_name"), 0.8),
        (has("claim, clm, file") & has("number, no, nbr, num, id, ref, reference"), F.lit("claim_number"), 0.85), (has("status, stat"), F.lit("claim_status"), 0.8),
        (has("suit, litigation, litigated, attorney"), F.lit("litigation_flag"), 0.8), (dated & has("report, reported, rptd, rpt, notice"), F.lit("date_reported"), 0.85),
        (dated & has("loss, accident, occurrence, dol, doi"), F.lit("date_of_loss"), 0.85), (group == "recovery", F.lit("recovery_total"), 0.8), (group == "incurred", F.lit("incurred_total"), 0.8),
        (group.isNotNull() & part.isNotNull(), F.concat_ws("_", group, part), 0.85), (group.isNotNull(), F.concat_ws("_", group, F.lit("total")), 0.75),
    ]
    known = lookup(label, FIELD_LABELS)
    sure = F.when(label.isin(BARE), F.struct(known.alias("field"), F.lit(0.95).alias("confidence"), F.lit("synonym").alias("source"))).when(known.isNotNull(), F.struct(known.alias("field"), F.lit(1.0).alias("confidence"), F.lit("synonym").alias("source")))
    out = sure
    for test, name, confidence in rules:
        out = out.when(test, F.struct(name.alias("field"), F.lit(confidence).alias("confidence"), F.lit("heuristic").alias("source")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("field"), F.lit(0.0).alias("confidence"), F.lit("unmapped").alias("source")))


def guess_document_field(c: Column) -> Column:
    """The fact about a whole document that a column's label names exactly, or null."""
    return lookup(normalize_label(c), DOCUMENT_LABELS)


def header_score(cells: Column) -> Column:
    """How many cells of a line name a field. cells: an array of texts."""
    return F.size(F.filter(cells, lambda x: guess_field(x)["field"].isNotNull()))


def looks_like_header(cells: Column, least: int = 3) -> Column:
    return header_score(cells) >= least


def template_labels(top: Column) -> Column:
    """The known labels that a page's top prints, sorted."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(top, F.lit(""))), r"\s+", " "))
    return F.sort_array(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in listed(TEMPLATE_LABELS)])))


#: The part of a page's lines that is its top.
TOP = 0.2


def page_top(text: Column, part: float = TOP) -> Column:
    """The first lines of a page that aren't blank: that part of them, one at least."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    return F.array_join(F.slice(lines, 1, F.greatest(F.lit(1), F.floor(F.size(lines) * part).cast("int"))), "\n")


#: Last words of carriers' names; beginnings of lines that are no letterhead; words of search criteria; titles of reports; words of labels.
CARRIER_WORDS = (
    "insurance|insurances|assurance|assurances|casualty|indemnity|mutual|underwriters|company|companies|corp|corporation|group|marine|fire|specialty|speciality|exchange|reciprocal|syndicate|lloyds|reinsurance|"
    "fund|funds|pool|authority|trust|versicherung|versicherungen|limited|ins|co|ag|se|plc|ltd|llc|inc|nv|sa"
)
NO_CARRIER = r"(?i)^(loss\s*run|claims?\s*(?:listing|detail|report)|page\s+\d|confidential|report\s*date|run\s*date)"
CRITERIA = r"(?i)\b(?:where|between|is\s+(?:closed|open|greater|less|equal)|all\s+claims|selected\s+by|filtered|criteria)\b"
TITLE = r"(?i)\b(loss\s*run|loss\s*report|claims?\s*(?:listing|report|detail|summary|history|experience)|statement|report|listing|summary|experience)\b"
LABEL_WORDS = "printed, report, run, date, dated, valued, valuation, page, policy, insured, named, claim, claims, period, as, of, status, location, currency, number, no, for"
CARRIER_LABEL = r"(?i)^(?:carrier|insurer|underwriter|issuing\s+company)\s*[:\-]\s*(.+)"
PAGE_MARKER = r"(?i)\s*page\s+\d+\s*(?:of\s*\d+)?\s*$"
DATA = r"\b\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}\b|\d{1,3}(?:[,.]\d{3})+[.,]\d{2}\b"
#: Lines of a page that may be its letterhead, and the longest such line.
LETTERHEAD, LONGEST = 8, 120


def labels_named(line: Column, longest: int = 4) -> Column:
    """How many fields a line names as column labels: its cells, where gaps part three or more; else its words, from the left, the longest label first."""
    cells = F.filter(F.split(F.trim(line), r"\s{2,}"), lambda x: x != "")
    by_cell = F.size(F.array_compact(F.array_distinct(F.transform(cells, lambda x: guess_field(x)["field"]))))
    words = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    state = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("fields"))

    def step(s, i):
        label = lambda n: lookup(normalize_label(F.array_join(F.slice(words, i, n), " ")), FIELD_LABELS)
        found = F.coalesce(*[F.when((i + (n - 1) <= F.size(words)) & label(n).isNotNull(), F.struct(F.lit(n - 1).alias("skip"), F.array_union(s["fields"], F.array(label(n))).alias("fields"))) for n in range(longest, 0, -1)])
        return F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), s["fields"].alias("fields"))).otherwise(F.coalesce(found, F.struct(F.lit(0).alias("skip"), s["fields"].alias("fields"))))

    places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    by_word = F.size(F.aggregate(places, state, step, lambda s: s["fields"]))
    return F.when(F.size(cells) >= 3, by_cell).otherwise(by_word)


def without_title(line: Column) -> Column:
    """A line without report titles behind dashes at its end."""
    parts = F.split(line, r"\s+[-–—|]\s+")
    last = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), F.lit(1), lambda keep, i: F.when((i <= F.size(parts)) & ~F.coalesce(F.get(parts, i - 1).rlike(TITLE), F.lit(True)), i).otherwise(keep))
    return F.trim(F.array_join(F.slice(parts, 1, last), " - "))


def before_label(line: Column) -> Column:
    """The words ahead of a label and its colon."""
    words = F.filter(F.split(F.trim(F.substring_index(line, ":", 1)), r"\s+"), lambda x: x != "")
    own = F.transform(words, lambda w, i: F.when(F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", "")).isin(listed(LABEL_WORDS)), F.lit(0)).otherwise(i + 1))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, F.coalesce(F.array_max(own), F.lit(0))), " ")).otherwise("")


def detect_carrier(text: Column) -> Column:
    """The carrier of a page's first lines: what a label names, else the first line with a company's ending, else the first that is letterhead at all."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), 1, LETTERHEAD)
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    labelled = F.get(F.filter(lines, lambda x: F.trim(x).rlike(CARRIER_LABEL)), F.lit(0))
    told = squeeze(F.regexp_replace(F.regexp_extract(F.trim(labelled), CARRIER_LABEL, 1), PAGE_MARKER, ""))
    plain = F.transform(lines, lambda x: F.regexp_replace(F.trim(x), PAGE_MARKER, ""))
    plain = F.transform(plain, lambda x: F.when(F.contains(x, F.lit(":")), before_label(x)).otherwise(x))
    heads = F.filter(plain, lambda x: (x != "") & (F.length(x) <= LONGEST) & ~x.rlike(NO_CARRIER) & ~x.rlike(CRITERIA) & ~x.rlike(DATA) & (labels_named(x) < 3))
    heads = F.filter(F.transform(heads, without_title), lambda x: x != "")
    ending = rf"(?i)\b([A-Z][\w&.\-']*(?:\s+[\w&.\-']+){{0,5}}\s+(?:{CARRIER_WORDS})\b\.?)"
    company = F.get(F.filter(heads, lambda x: x.rlike(ending)), F.lit(0))
    return F.when(labelled.isNotNull(), told).when(company.isNotNull(), squeeze(F.regexp_extract(company, ending, 1))).otherwise(squeeze(F.get(heads, F.lit(0))))


def is_missing(c: Column) -> Column:
    """Whether a cell is blank."""
    return F.coalesce(clean_text(c) == "", F.lit(True))
