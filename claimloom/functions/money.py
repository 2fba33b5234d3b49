"""Printed amounts to exact decimals, with a reason for every null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, let
from claimloom.types import CURRENCY_CODES, CURRENCY_SIGNS, MONEY, NOT_APPLICABLE


def _grouped(c, sep: str):
    return F.regexp_replace(c, " ", "").rlike(rf"^\d{{1,3}}([{sep}]\d{{3}})+$")


def parse_money(c: Column, locale: Column | str | None = None, dash_is_zero: bool = False) -> Column:
    """A struct (value, reason, currency) of a printed amount.

    locale is "us", "eu" or null, where a lone separator before three digits stays ambiguous; or a column of these.
    """
    where = locale if isinstance(locale, Column) else F.lit(locale).cast("string")
    signs = r"US\$|C\$|A\$|[$€£¥₤₹₽]"
    codes = rf"(?<![A-Z])({'|'.join(CURRENCY_CODES)})(?![A-Z])"
    named = F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair])
    sub = lambda x, a, drop: F.trim(F.substr(x, F.lit(a), F.length(x) - drop))

    def marked(t):
        # A currency mark apart at the left: its dash is zero and its parentheses hold the amount.
        apart = r"^([$€£])\s*(.*)$"
        return let(F.struct(F.regexp_extract(t, apart, 1).alias("mark"), F.trim(F.regexp_extract(t, apart, 2)).alias("rest")), lambda m: credited(t, m))

    def credited(t, m):
        a = F.when((m["mark"] != "") & m["rest"].rlike(r"^\(.*\)$"), F.concat(F.lit("("), m["mark"], F.substr(m["rest"], F.lit(2)))).otherwise(t)
        cr = F.upper(F.regexp_extract(a, r"(?i)(?:^|\s)(CR|DR)(?:\s|$|\.)", 1))
        b = F.when(cr != "", F.trim(F.regexp_replace(a, r"(?i)(^|\s)(CR|DR)(?=\s|$|\.)", "$1"))).otherwise(a)
        return let(F.struct(cr.alias("cr"), b.alias("b")), lambda x: bracketed(t, m, x["cr"], x["b"]))

    def bracketed(t, m, cr, b):
        paren = b.rlike(r"^\(.*\)$")
        inner = F.when(paren, sub(b, 2, 2)).otherwise(b)
        return let(F.struct(paren.alias("paren"), inner.alias("b")), lambda x: signed(t, m, cr, b, x["paren"], x["b"]))

    def signed(t, m, cr, outer, paren, b):
        sign = F.regexp_extract(b, f"({signs})", 1)
        currency = F.coalesce(F.when(sign != "", F.try_element_at(named, sign)), F.nullif(F.regexp_extract(F.upper(b), codes, 1), F.lit("")))
        bare = F.trim(F.regexp_replace(F.regexp_replace(b, signs, ""), f"(?i){codes}", ""))
        tailed = lambda n: F.when(n.endswith("-"), sub(n, 1, 1)).otherwise(n)
        led = lambda n: F.when(n.rlike("^[-+]"), sub(n, 2, 1)).otherwise(n)
        odd = lambda n, k: (cr == "CR").cast("int") + paren.cast("int") + n.endswith("-").cast("int") + k.startswith("-").cast("int")
        return let(bare, lambda n: let(tailed(n), lambda k: let(F.struct(led(k).alias("n"), odd(n, k).alias("odd"), currency.alias("cur")), lambda x: valued(t, m, outer, paren, x["n"], x["odd"], x["cur"]))))

    def valued(t, m, outer, paren, n, odd, currency):
        facts = F.struct(
            F.regexp_count(n, F.lit(",")).alias("commas"), F.regexp_count(n, F.lit(r"\.")).alias("dots"), F.regexp_extract(n, r"([.,])[^.,]*$", 1).alias("sep"), F.regexp_extract(n, r"^(.*)[.,][^.,]*$", 1).alias("head"),
            F.regexp_replace(F.regexp_extract(n, r"[.,]([^.,]*)$", 1), r"[^0-9]", "").alias("after"),
        )
        return let(facts, lambda f: decided(t, m, outer, paren, n, odd, currency, f))

    def decided(t, m, outer, paren, n, odd, currency, f):
        both, total = (f["commas"] > 0) & (f["dots"] > 0), f["commas"] + f["dots"]
        many, lone = ~both & (total > 1), total == 1
        unclear = lone & (F.length(f["after"]) == 3) & F.length(F.regexp_replace(f["head"], r"\D", "")).between(1, 3)
        by_comma = f["sep"] == ","
        bad = F.when(both, ~F.when(by_comma, _grouped(f["head"], ".")).otherwise(_grouped(f["head"], ","))).when(many, ~F.when(by_comma, _grouped(n, ",")).otherwise(_grouped(n, "."))).otherwise(False)
        local = F.when(where == "us", F.lit(".")).when(where == "eu", F.lit(","))
        has_point = both | (lone & ~unclear) | F.coalesce(unclear & (f["sep"] == local), F.lit(False))
        plain = F.when(has_point, F.concat(F.regexp_replace(f["head"], r"[^0-9]", ""), F.lit("."), f["after"])).otherwise(F.regexp_replace(n, r"[^0-9]", ""))
        value = F.concat(F.lit("0"), plain).try_cast(MONEY)
        zero = t.rlike("^-0+-$") | ((m["mark"] != "") & m["rest"].rlike("^-+$"))
        if dash_is_zero:
            zero = zero | t.rlike("^-+$")
        reason = (
            F.when(t == "", "EMPTY").when(F.upper(t).isin(NOT_APPLICABLE), "NOT_APPLICABLE").when(zero, F.lit(None).cast("string")).when(t.rlike("^-+$"), "DASH_PLACEHOLDER")
            .when(~paren & outer.rlike("[()]"), "UNPARSEABLE").when(~n.rlike(r"^[0-9.,\s'’]+$") | ~n.rlike("[0-9]"), "UNPARSEABLE").when(bad, "UNPARSEABLE")
            .when(unclear & where.isNull(), "AMBIGUOUS_SEPARATOR").when(value.isNull(), "OUT_OF_RANGE")
        )
        amount = F.when(zero, F.lit(0).cast(MONEY)).when(reason.isNull(), F.when(odd % 2 == 1, -value).otherwise(value)).cast(MONEY)
        kind = F.when(zero & (m["mark"] != ""), F.try_element_at(named, m["mark"])).otherwise(currency)
        return F.struct(amount.alias("value"), reason.alias("reason"), kind.alias("currency"))

    return let(clean_text(c), marked)


def parse_amount(c: Column, locale: Column | str | None = None) -> Column:
    """parse_money, with the steps left out for texts that are read in one way: digits with two decimals behind a point, and dashes."""
    none = F.lit(None).cast("string")
    plain = F.struct(c.try_cast(MONEY).alias("value"), none.alias("reason"), none.alias("currency"))
    dash = F.struct(F.lit(None).cast(MONEY).alias("value"), F.lit("DASH_PLACEHOLDER").alias("reason"), none.alias("currency"))
    return F.when(c.rlike(r"^[0-9]{1,12}\.[0-9]{2}$"), plain).when(c.rlike(r"^-+$") & ~c.isin(NOT_APPLICABLE), dash).otherwise(parse_money(c, locale))
