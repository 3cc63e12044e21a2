"""Validators, fixes and text cleaning, over values made from keys of customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import validate as V
from . import add, made

K = "c_custkey"
MAKE = {
    "email": f"CASE {K} % 5 WHEN 0 THEN '  User.' || {K} || '@Gmial.com ' WHEN 1 THEN 'u' || {K} || '@example.org' WHEN 2 THEN 'no at sign ' || {K} WHEN 3 THEN NULL ELSE 'a+b_' || {K} || '@hotmai.com' END",
    "phone": f"CASE {K} % 6 WHEN 0 THEN '(555) 123-' || lpad(CAST({K} % 10000 AS VARCHAR(9)), 4, '0') WHEN 1 THEN '1-212-555-' || lpad(CAST({K} % 10000 AS VARCHAR(9)), 4, '0') WHEN 2 THEN '555.0' || {K} WHEN 3 THEN '+44 20 7946 0' || {K} WHEN 4 THEN NULL ELSE '2125550' || lpad(CAST({K} % 1000 AS VARCHAR(9)), 3, '0') END",
    "zip": f"CASE {K} % 4 WHEN 0 THEN lpad(CAST({K} AS VARCHAR(9)), 5, '0') WHEN 1 THEN ' ' || lpad(CAST({K} AS VARCHAR(9)), 5, '0') || '-1234' WHEN 2 THEN CAST({K} AS VARCHAR(9)) || 'x' ELSE '123456789' END",
    "postal": f"CASE {K} % 3 WHEN 0 THEN 'sw1a ' || ({K} % 10) || 'aa' WHEN 1 THEN 'K1A 0B' || ({K} % 10) ELSE 'x' || {K} END",
    "url": f"CASE {K} % 5 WHEN 0 THEN 'https://www.example.com/p?id=' || {K} WHEN 1 THEN 'HTTP://localhost:80' || ({K} % 10) WHEN 2 THEN 'example.net/' || {K} WHEN 3 THEN 'http://10.0.0.' || ({K} % 300) || '/x' ELSE 'https://a b/' || {K} END",
    "ip": f"CASE {K} % 3 WHEN 0 THEN '192.168.' || ({K} % 300) || '.1' WHEN 1 THEN ' 10.0.0.' || ({K} % 256) ELSE '1.2.3.' || {K} || '.4' END",
    "card": f"CASE {K} % 5 WHEN 0 THEN '4532-0151-1283-0366' WHEN 1 THEN '3782 822463 10005' WHEN 2 THEN '6011' || lpad(CAST({K} AS VARCHAR(9)), 12, '0') WHEN 3 THEN '55555555555' || lpad(CAST({K} % 100000 AS VARCHAR(9)), 5, '0') ELSE 'card ' || {K} END",
    "ssn": f"CASE {K} % 6 WHEN 0 THEN '123-45-' || lpad(CAST({K} % 10000 AS VARCHAR(9)), 4, '0') WHEN 1 THEN '000-12-3456' WHEN 2 THEN '666-12-' || lpad(CAST({K} % 10000 AS VARCHAR(9)), 4, '0') WHEN 3 THEN '12345' || lpad(CAST({K} % 10000 AS VARCHAR(9)), 4, '0') WHEN 4 THEN '9' || {K} ELSE '123-00-4567' END",
    "day": f"CASE {K} % 7 WHEN 0 THEN '2024-0' || (1 + {K} % 9) || '-1' || ({K} % 10) WHEN 1 THEN (1 + {K} % 12) || '/2' || ({K} % 9) || '/2023' WHEN 2 THEN '2' || ({K} % 9) || '/0' || (1 + {K} % 9) || '/2023' WHEN 3 THEN '2022/1' || ({K} % 3) || '/0' || (1 + {K} % 9) WHEN 4 THEN '03-2' || ({K} % 9) || '-2021' WHEN 5 THEN '31-1' || ({K} % 3) || '-2021' ELSE 'day ' || {K} END",
    "money": f"CASE {K} % 6 WHEN 0 THEN '$1,' || lpad(CAST({K} % 1000 AS VARCHAR(9)), 3, '0') || '.50' WHEN 1 THEN '(' || {K} || ')' WHEN 2 THEN '€ ' || {K} WHEN 3 THEN '-' || {K} || '.25' WHEN 4 THEN 'n/a' ELSE NULL END",
    "words": f"CASE {K} % 4 WHEN 0 THEN '  some   TEXT-with o''neil ' || {K} || '  ' WHEN 1 THEN 'What? An e-mail: a@b.c!' WHEN 2 THEN c_name ELSE 'x_y  (z) #' || {K} END",
    "amount": f"CASE {K} % 4 WHEN 0 THEN CAST({K} AS VARCHAR(9)) WHEN 1 THEN ' ' || {K} || '.5 ' WHEN 2 THEN 'abc' ELSE NULL END",
}


def source(*columns: str):
    """key and the made columns; and the same as SQL."""
    cols = [f"{K} AS k", *[f"{MAKE[c]} AS {c}" for c in columns]]
    spark = [c.replace("VARCHAR(9)", "STRING").replace("''", "\\'") for c in cols]
    return made("customer", *spark), f"(SELECT {', '.join(cols)} FROM customer)"


def rule(name: str, column: str, result, sql: str) -> None:
    """result: Column -> Column, or a dict of them by name; sql: the same select list over x."""
    read, inner = source(column)
    parts = result if isinstance(result, dict) else {"result": result}
    add(name, lambda spark, d: read(spark, d).select("k", *[f(F.col(column)).alias(n) for n, f in parts.items()]), f"SELECT k, {sql} FROM (SELECT k, {column} AS x, regexp_replace({column}, '^\\s+|\\s+$', '', 'g') AS s, regexp_replace({column}, '[^0-9]', '', 'g') AS d FROM {inner})")


def re_sql(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, '{pattern}'), false)"


FIX = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.EMAIL_DOMAIN_FIXES.items())
TEN = "CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END"


def phone_sql(form: str, tens: str = TEN, other: str = "x", test: str = "length(t) = 10") -> str:
    return f"(SELECT CASE WHEN {test} THEN {form} ELSE {other} END FROM (SELECT {tens} AS t))"


def parts(form: str) -> str:
    a, b, c, d = form.split("%s")
    return f"'{a}' || substr(t, 1, 3) || '{b}' || substr(t, 4, 3) || '{c}' || substr(t, 7, 4) || '{d}'"


rule("val_email", "email", V.valid_email, f"{re_sql('s', V.EMAIL)} AS result")
rule("fix_email", "email", V.fix_email, f"CASE WHEN split_part(lower(s), '@', 2) IN ({', '.join(repr(a) for a in V.EMAIL_DOMAIN_FIXES)}) THEN split_part(lower(s), '@', 1) || '@' || CASE split_part(lower(s), '@', 2) {FIX} END ELSE lower(s) END AS result")
rule("val_us_phone", "phone", V.valid_us_phone, f"{re_sql('s', V.US_PHONE)} AS result")
rule("std_us_phone", "phone", {s: (lambda c, s=s: V.format_us_phone(c, s)) for s in ("dash", "dot", "paren", "plain")}, ", ".join(f"{phone_sql(parts(f))} AS {n}" for n, f in (("dash", "%s-%s-%s"), ("dot", "%s.%s.%s"), ("paren", "(%s) %s-%s"), ("plain", "%s%s%s"))))
rule("val_intl_phone", "phone", V.valid_international_phone, "coalesce(regexp_matches(regexp_replace(x, '[-.\\s()]', '', 'g'), '^\\+[1-9]\\d{6,14}$'), false) AS result")
rule("phone_loose", "phone", {"valid": V.loose_phone, "pretty": text.format_phone}, "coalesce(length(d) >= 10, false) AS valid, CASE WHEN length(d) = 10 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7) WHEN length(d) = 11 AND d LIKE '1%' THEN '+1 (' || substr(d, 2, 3) || ') ' || substr(d, 5, 3) || '-' || substr(d, 8) ELSE d END AS pretty")
NANP = r"regexp_matches(t, '^[2-9]\d{2}[2-9]\d{6}$')"
rule("phone_e164", "phone", {"e164": text.phone_as, "national": lambda c: text.phone_as(c, "NATIONAL")}, f"{phone_sql(parts('+1%s%s%s'), TEN, 'NULL', NANP)} AS e164, {phone_sql(parts('(%s) %s-%s'), TEN, 'NULL', NANP)} AS national")
rule("val_zip", "zip", V.valid_us_zip, f"{re_sql('s', V.US_ZIP)} AS result")
rule("std_zip", "zip", {"five": V.format_us_zip, "nine": lambda c: V.format_us_zip(c, True)}, "CASE WHEN length(d) IN (5, 9) THEN substr(d, 1, 5) ELSE x END AS five, CASE WHEN length(d) = 5 THEN d WHEN length(d) = 9 THEN substr(d, 1, 5) || '-' || substr(d, 6) ELSE x END AS nine")
rule("val_postal", "postal", {c.lower(): (lambda x, c=c: V.valid_postal_code(x, c)) for c in V.POSTAL_CODES}, ", ".join(f"{re_sql('upper(s)', p)} AS {c.lower()}" for c, p in V.POSTAL_CODES.items()))
rule("val_url", "url", V.valid_url, f"{re_sql('s', '(?i)' + V.URL)} AS result")
rule("fix_url", "url", V.fix_url, "CASE WHEN regexp_matches(s, '^https?://') THEN s ELSE 'http://' || s END AS result")
rule("val_ipv4", "ip", V.valid_ipv4, f"{re_sql('s', V.IPV4)} AS result")
LUHN = "list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(c), i, 1) AS INT) WHEN CAST(substr(reverse(c), i, 1) AS INT) > 4 THEN CAST(substr(reverse(c), i, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse(c), i, 1) AS INT) * 2 END)) % 10 = 0"
rule("val_luhn", "card", V.valid_credit_card, f"(SELECT CASE WHEN regexp_matches(c, '^\\d{{13,19}}$') THEN {LUHN} ELSE false END FROM (SELECT regexp_replace(x, '[\\s-]', '', 'g') AS c)) AS result")
rule("card_type", "card", V.credit_card_type, "(SELECT CASE WHEN NOT regexp_matches(c, '^\\d+$') THEN NULL WHEN c LIKE '4%' THEN 'visa' WHEN regexp_matches(c, '^5[1-5]') THEN 'mastercard' WHEN regexp_matches(c, '^3[47]') THEN 'amex' WHEN regexp_matches(c, '^6(?:011|5)') THEN 'discover' END FROM (SELECT regexp_replace(s, '[\\s-]', '', 'g') AS c)) AS result")
rule("val_ssn", "ssn", V.valid_ssn, f"{re_sql('s', V.SSN)} AND substr(d, 1, 3) NOT IN ('000', '666') AND d NOT LIKE '9%' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000' AS result")
rule("mask_ssn", "ssn", V.mask_ssn, "CASE WHEN length(d) = 9 THEN 'XXX-XX-' || substr(d, 6) ELSE x END AS result")
rule("val_date", "day", {"iso": dates.valid_date, "us": lambda c: dates.valid_date(c, "%m/%d/%Y")}, "try_strptime(s, '%Y-%m-%d') IS NOT NULL AS iso, try_strptime(s, '%m/%d/%Y') IS NOT NULL AS us")
TRY = ", ".join(f"try_strptime(s, '{f}')" for f in dates.COMMON_FORMATS)
rule("std_date", "day", {n: (lambda c, n=n: dates.format_date(c, n)) for n in dates.TARGETS}, ", ".join(f"coalesce(strftime(coalesce({TRY}), '{f}'), x) AS {n}" for n, f in dates.TARGETS.items()))
rule("val_regex", "words", V.regex_rule("[a-z]+_|what", True), "coalesce(regexp_matches(x, '(?i)^(?:[a-z]+_|what)'), false) AS result")
rule("val_range", "amount", {"inside": V.range_rule(100, 900), "strict": V.range_rule(100, 900, False)}, "coalesce(TRY_CAST(x AS DOUBLE) >= 100 AND TRY_CAST(x AS DOUBLE) <= 900, false) AS inside, coalesce(TRY_CAST(x AS DOUBLE) > 100 AND TRY_CAST(x AS DOUBLE) < 900, false) AS strict")
rule("val_length", "words", V.length_rule(5, 20), "coalesce(length(x) BETWEEN 5 AND 20, false) AS result")
rule("val_enum", "amount", {"exact": V.enum_rule(["abc", "4"]), "loose": V.enum_rule(["ABC", "8"], False)}, "coalesce(x IN ('abc', '4'), false) AS exact, coalesce(lower(x) IN ('abc', '8'), false) AS loose")
rule("val_composite", "email", V.all_of(V.valid_email, V.length_rule(1, 14)), f"{re_sql('s', V.EMAIL)} AND coalesce(length(x) BETWEEN 1 AND 14, false) AS result")
rule("ws_trim", "words", lambda c: text.clean_space(c), "s AS result")
rule("ws_normalize", "words", lambda c: text.clean_space(c, "normalize"), "regexp_replace(s, '\\s+', ' ', 'g') AS result")
rule("case_change", "words", {n: (lambda c, n=n: text.change_case(c, n)) for n in ("lower", "upper", "sentence", "title")}, "lower(x) AS lower, upper(x) AS upper, upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS sentence, list_aggregate(list_transform(regexp_extract_all(x, '\\p{L}+|[^\\p{L}]+'), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), 'string_agg', '') AS title")
rule("special_chars", "words", {"bare": text.remove_special, "kept": lambda c: text.remove_special(c, "-@.", " ")}, "regexp_replace(x, '[^\\p{L}\\p{N}_\\s]', '', 'g') AS bare, regexp_replace(x, '[^\\p{L}\\p{N}_\\s\\-@.]', ' ', 'g') AS kept")
rule("normalize_text", "words", text.normalize_text, "regexp_replace(lower(regexp_replace(s, '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS result")
rule("currency", "money", text.parse_currency, "(SELECT CASE WHEN c LIKE '(%)' THEN -TRY_CAST(substr(c, 2, length(c) - 2) AS DOUBLE) ELSE TRY_CAST(c AS DOUBLE) END FROM (SELECT regexp_replace(x, '[$€£¥₹,\\s]', '', 'g') AS c)) AS result")
_emails, _sql = source("email")
add("rule_summary", lambda spark, d: V.summarise(_emails(spark, d), "email", V.valid_email), f"SELECT count(*) FILTER (v) AS valid, count(*) FILTER (NOT v) AS invalid, count(*) AS total, count(*) FILTER (v) * 100.0 / count(*) AS valid_pct FROM (SELECT coalesce(regexp_matches(trim(email), '{V.EMAIL}'), false) AS v FROM {_sql})")
add("rule_invalid_rows", lambda spark, d: V.invalid_rows(_emails(spark, d), "email", V.valid_email), f"SELECT * FROM {_sql} WHERE NOT coalesce(regexp_matches(trim(email), '{V.EMAIL}'), false)")
add("email_flag", lambda spark, d: V.with_flag(_emails(spark, d), "email", V.valid_email), f"SELECT *, coalesce(regexp_matches(trim(email), '{V.EMAIL}'), false) AS email_valid FROM {_sql}")
add("range_counts", lambda spark, d: V.out_of_range(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 1000, 400000), "SELECT count(*) FILTER (o_totalprice < 1000) AS below, count(*) FILTER (o_totalprice > 400000) AS above FROM orders")
