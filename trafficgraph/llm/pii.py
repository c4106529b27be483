"""Personal data in texts: patterns propose, checks confirm, context words adjust the score.

Four *base* kinds always stay when their check passes: ``email``, ``ip`` (parts
at most 255), ``card`` (16 to 19 digits that pass Luhn) and ``phone`` (``+``, 8 to
15 digits). Matches are leftmost and do not overlap within a kind; a match whose
check fails is dropped and its characters are not tried again. Three *added*
kinds count only from ``MIN_SCORE`` on: ``iban`` (length of the country, mod-97),
``ssn`` (valid area, group and serial) and ``card_short`` (13 to 15 digits that
pass Luhn). The first stands by its check, the others need a context word
within ``CONTEXT`` characters (up to the next match of the kind).

Only DataFrame functions are used, on whole texts, and no row meets another: one
pass over the table without a shuffle. Positions come from the texts between the
matches (``split`` by the same pattern) and running sums of their lengths.
The patterns never back up over long runs: quantifiers are possessive where
that changes nothing, and a run of characters is tried at its start only.

Defined cases: a null or empty text has no spans; a null id stays null; repeated
rows are judged each on its own; an empty table gives no rows; spans of different kinds
may overlap; all other columns are ignored, whatever their names. Positions
count code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "card_short")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT = 48                 # code points before and after a span that are searched
MIN_SCORE = 0.6              # added kinds stay from here on
CONTEXT_WEIGHT = 0.3
CHUNK = 256                  # running sums advance in chunks of so many matches

# --- fixed values: lengths of bank account numbers (IBAN) by country ---------------------
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22,
    "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
# ------------------------------------------------------------------------------------------


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    forms = "|".join(f"(?:{'|'.join(countries)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{length - 4}}}"
                     for length, countries in sorted(by_length.items()))
    return f"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Za-z0-9])(?:{forms})(?![A-Za-z0-9])"


# A run of the characters before an @ fails at all its places or at none, so
# it is tried at its start, or where the last match ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card_short": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
}
# Texts without this character hold no match of the kind.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4,
         "card_short": 0.4}
SUPPORT = {
    "email": "mail|e-mail|email|contact|write|kontakt|courriel|correo|contacto",
    "ip": "ip|address|host|server|login|client|adresse|dirección",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|cell|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
    "card_short": "card|visa|mastercard|amex|american express|diners|credit|debit|karte|carte|tarjeta",
}
AGAINST = {
    "email": "example|placeholder", "ip": "version|release|v|section|chapter",
    "card": "isbn|order|invoice|serial|tracking", "phone": "isbn|order|invoice|serial",
    "iban": "hash|checksum|token", "ssn": "order|invoice|serial|part",
    "card_short": "isbn|order|invoice|serial|tracking|imei",
}


# The expressions are SQL text: built from Column objects, the same plan takes seconds to put together.

def let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once, however often ``body`` uses ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running_sums(x: str, levels: int = 2) -> str:
    """Inclusive running sums of a non-empty array of bigints.

    A fold that appends to an array copies it at each step; chunks of ``CHUNK``
    elements and running sums over the chunks' sums keep the copies linear.
    """
    def fold(p: str) -> str:
        return (f"aggregate({p}, named_struct('sum', 0L, 'out', cast(array() AS array<bigint>)), "
                "(a, v) -> named_struct('sum', a.sum + v, 'out', concat(a.out, array(a.sum + v))), "
                "a -> a.out)")

    if levels == 0:
        return fold(x)
    xs, parts, before = f"xs{levels}", f"parts{levels}", f"before{levels}"
    chunks = f"transform(sequence(1, size({xs}), {CHUNK}), i -> {fold(f'slice({xs}, i, {CHUNK})')})"
    totals = f"transform({parts}, p -> element_at(p, -1))"
    moved = (f"flatten(transform({parts}, (p, c) -> if(c = 0, p, "
             f"transform(p, v -> v + get({before}, c - 1)))))")
    return let(xs, x, f"if(size({xs}) <= {CHUNK}, {fold(xs)}, "
               + let(parts, chunks, let(before, running_sums(totals, levels - 1), moved)) + ")")


def luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    d = f"cast(substr({digits}, i, 1) AS int)"
    return (f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + "
            f"CASE WHEN (length({digits}) - i) % 2 = 0 THEN {d} "
            f"WHEN {d} < 5 THEN 2 * {d} ELSE 2 * {d} - 9 END) % 10 = 0")


def mod97(account: str) -> str:
    """Whether an account number passes ISO 7064 mod 97 (letters count 10 to 35)."""
    c = "ascii(substr(turned, i, 1))"
    rest = (f"aggregate(sequence(1, length(turned)), 0, (a, i) -> if({c} < 65, "
            f"(a * 10 + {c} - 48) % 97, (a * 100 + {c} - 55) % 97))")
    return let("turned", f"concat(substr({account}, 5), left({account}, 4))", f"{rest} = 1")


def _luhn_of(match: str, least: int, most: int) -> str:
    # an over-long match is dropped by its length before any digit is looked at
    return let("digits", f"regexp_replace({match}, '[^0-9]', '')",
               f"if(length(digits) BETWEEN {least} AND {most}, {luhn('digits')}, false)")


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CHECKS: dict[str, Callable[[str], str]] = {
    "email": lambda m: "true",
    "ip": lambda m: rf"rlike({m}, r'^{_PART}(?:\.{_PART}){{3}}$')",
    "card": lambda m: _luhn_of(m, 16, 19),
    "phone": lambda m: f"length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 8 AND 15",
    "iban": lambda m: let("account", f"replace({m}, ' ')", mod97("account")),
    "ssn": lambda m: f"NOT rlike({m}, '^(?:000|666|9)|-00-|-0000$')",
    "card_short": lambda m: _luhn_of(m, 13, 15),
}
_SPAN = "struct<kind: string, start: bigint, end: bigint, score: double>"


def kind_spans(text: str, kind: str) -> str:
    """SQL of the array of ``(kind, start, end, score)`` of one kind in a text, by position."""
    none = f"cast(array() AS array<{_SPAN}>)"
    pattern = f"r'{PATTERNS[kind]}'"
    steps = ("transform(matches, (m, i) -> cast(length(get(between, i)) "
             "+ if(i = 0, 0, length(get(matches, i - 1))) AS bigint))")
    near = (f"concat(lower(right(get(between, i), {CONTEXT})), ' ', "
            f"lower(left(get(between, i + 1), {CONTEXT})))")
    score = (rf"{PRIOR[kind]}D + if(rlike(near, r'(?U)\b(?:{SUPPORT[kind]})\b'), {CONTEXT_WEIGHT}D, 0D) "
             rf"- if(rlike(near, r'(?U)\b(?:{AGAINST[kind]})\b'), {CONTEXT_WEIGHT}D, 0D)")
    span = (f"named_struct('kind', '{kind}', 'start', get(at, i), "
            f"'end', get(at, i) + length(get(matches, i)), 'score', {let('near', near, score)})")
    located = let("between", f"split({text}, {pattern}, -1)",
                  let("at", running_sums(steps), f"transform(confirmed, i -> {span})"))
    confirmed = (f"filter(if(size(matches) = 0, cast(array() AS array<int>), "
                 f"sequence(0, size(matches) - 1)), i -> {CHECKS[kind]('get(matches, i)')})")
    spans = let("matches", f"regexp_extract_all({text}, {pattern}, 0)",
                let("confirmed", confirmed, f"if(size(confirmed) = 0, {none}, {located})"))
    if kind in ADDED_KINDS:
        spans = f"filter({spans}, s -> s.score >= {MIN_SCORE - 1e-9}D)"
    return f"if(contains({text}, '{NEEDS[kind]}'), {spans}, {none})" if kind in NEEDS else spans


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: an array of ``(kind, start, end, score)`` by kind, then start."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    parts = ", ".join(kind_spans("_text", kind) for kind in KINDS)
    return whole.select("doc_id", F.expr(f"concat({parts})").alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as a string."""
    def base(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base_spans = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[base(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(_written(base_spans), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))
