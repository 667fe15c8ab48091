"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Numbers and dates are found by pattern and validated: card numbers by their check digit, addresses by their octets, social
security numbers by their ranges, dates by the calendar. A valid one is permuted by a keyed Feistel network over just the
values of its format (its digits; 2^32 addresses; the days of 1900 to 2099), walking on from values outside it, and written
back in the layout it had, with its check digit made anew. The permutation depends on the value alone, so equal values stay equal in all documents and
different ones different. Mail addresses and hexadecimal secrets have no such range; they get keyed digests in their format.

A text is cut at its matches and put together again in its row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import fresh

#: The patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![\p{L}\p{N}]|[./-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
}
KINDS = tuple(PATTERNS)
_OTHERS = "|".join(p for k, p in PATTERNS.items() if k != "card")
#: Groups of digits of any number, one or more of which may make a card number; it ends before a group that begins something else.
RUN = r"(?<![\p{L}\p{N}])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![\p{L}\p{N}])(?:[ -](?!" + _OTHERS + r")[0-9]++(?![\p{L}\p{N}]))*+"
PATTERN = _OTHERS + "|" + RUN
#: Digits of a card number, the least and the most.
CARD = (13, 19)
#: Rounds of the network; steps of a walk back into a format (each leaves it one time in nine at most).
ROUNDS, WALK = 10, 32
#: Days from 1900-01-01 to 2099-12-31, and the side of a square just above.
DAYS, SIDE = 73_049, 271


def _q(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(x: str, high: str, low: str, tweak: str, key: str) -> str:
    """SQL: a keyed permutation of 0 .. high * low - 1, halves of which are taken by ``low``; ``key`` names the column that has the key."""
    mix = f"cast(conv(substr(sha2(concat_ws('|', {key}, {_q(tweak)}, {low}, i, s.b), 256), 1, 15), 16, 10) AS bigint)"
    step = f"named_struct('a', s.b, 'b', pmod(s.a + {mix}, CASE WHEN i % 2 = 0 THEN {high} ELSE {low} END))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({x} AS bigint) div {low}, 'b', cast({x} AS bigint) % {low}), (s, j) -> {_let('j - 1', 'i', step)}, s -> s.a * {low} + s.b)"


def _walk(x: str, valid, high: str, low: str, tweak: str, key: str) -> str:
    """SQL: the permutation applied until the value is ``valid`` again."""
    step = _let(_feistel("w.x", high, low, tweak, key), "y", f"named_struct('x', y, 'ok', {valid('y')})")
    return f"aggregate(sequence(1, {WALK}), named_struct('x', cast({x} AS bigint), 'ok', false), (w, k) -> CASE WHEN w.ok THEN w ELSE {step} END, w -> w.x)"


def _luhn(d: str, doubled: int) -> str:
    """SQL: the check sum of digits, doubling those at odd (1) or even (0) places from the right."""
    v = f"cast(substr({d}, p, 1) AS int)"
    return f"aggregate(sequence(1, length({d})), 0, (t, p) -> t + CASE WHEN (length({d}) - p) % 2 = {doubled} THEN {v} * 2 - CASE WHEN {v} > 4 THEN 9 ELSE 0 END ELSE {v} END)"


def _in_layout(m: str, digits: str) -> str:
    """SQL: the match with its digits replaced in turn."""
    c = f"substr({m}, p, 1)"
    return f"aggregate(sequence(1, length({m})), named_struct('o', '', 'k', 1), (t, p) -> CASE WHEN {c} BETWEEN '0' AND '9' THEN named_struct('o', concat(t.o, substr({digits}, t.k, 1)), 'k', t.k + 1) ELSE named_struct('o', concat(t.o, {c}), 'k', t.k) END, t -> t.o)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


_TEN = "array(" + ", ".join(f"{10**k}L" for k in range(10)) + ")"
_DAY_FIRST = "concat(substr(m, 7, 4), '-', substr(m, 4, 2), '-', substr(m, 1, 2))"
_MONTH_FIRST = "concat(substr(m, 7, 4), '-', substr(m, 1, 2), '-', substr(m, 4, 2))"
#: Whether a date that is not ISO can only be read month first.
_US = f"(substr(m, 5, 1) <> '-' AND try_cast({_DAY_FIRST} AS date) IS NULL)"
_ISO = f"CASE WHEN substr(m, 5, 1) = '-' THEN m WHEN {_US} THEN {_MONTH_FIRST} ELSE {_DAY_FIRST} END"
_DAY = f"date_diff(try_cast({_ISO} AS date), date'1900-01-01')"


def _ssn_ok(x: str) -> str:
    """SQL: whether nine digits, as a number, are a social security number that may be given out."""
    return f"({x} div 1000000 BETWEEN 1 AND 899 AND {x} div 1000000 <> 666 AND {x} div 10000 % 100 > 0 AND {x} % 10000 > 0)"


def _cards() -> str:
    """SQL: a run ``m`` of digit groups in parts ``(m, kind)``: from the left, the longest card numbers of whole groups and what is between."""
    digit = lambda at: f"substr(m, {at}, 1) BETWEEN '0' AND '9'"
    least, most = CARD
    starts = f"filter(sequence(1, length(m)), i -> {digit('i')} AND (i = 1 OR NOT {digit('i - 1')}))"
    valid = _let(_digits("substr(m, s, e - s + 1)"), "d", f"CASE WHEN length(d) BETWEEN {least} AND {most} THEN {_luhn('d', 1)} % 10 = 0 ELSE false END")
    ends = f"filter(sequence(s + {least - 1}, least(s + {2 * most - 2}, length(m))), e -> CASE WHEN {digit('e')} AND NOT {digit('e + 1')} THEN {valid} ELSE false END)"
    longest = f"CASE WHEN s >= r.at AND s + {least - 1} <= length(m) THEN array_max({ends}) END"
    part = lambda text, kind: f"named_struct('m', {text}, 'kind', {kind})"
    none = "cast(NULL AS string)"
    two = f"array({part('substr(m, r.at, s - r.at)', none)}, {part('substr(m, s, z - s + 1)', _q('card'))})"
    step = _let(longest, "z", f"CASE WHEN z IS NULL THEN r ELSE named_struct('at', z + 1, 'parts', concat(r.parts, {two})) END")
    zero = "named_struct('at', 1, 'parts', cast(array() AS array<struct<m:string,kind:string>>))"
    return f"aggregate({starts}, {zero}, (r, s) -> {step}, r -> concat(r.parts, array({part('substr(m, r.at)', none)})))"


def _parts() -> str:
    """SQL: a match ``m`` in parts ``(m, kind)``; the kind is null for what is not valid."""
    valid = {
        "ip": "forall(split(m, '[.]'), o -> cast(o AS int) <= 255)",
        "date": f"coalesce({_DAY} BETWEEN 0 AND {DAYS - 1}, false)",
        "ssn": _let(f"cast({_digits('m')} AS bigint)", "x", _ssn_ok("x")),
    }
    one = lambda k: f"array(named_struct('m', m, 'kind', CASE WHEN {valid.get(k, 'true')} THEN '{k}' END))"
    return "CASE " + " ".join(f"WHEN m RLIKE {_q('^(?:' + p + ')$')} THEN {one(k)}" for k, p in PATTERNS.items() if k != "card") + f" ELSE {_cards()} END"


def _pseudonym(key: str) -> str:
    """SQL: what stands for the match ``m`` of the kind ``kind``."""
    digest = lambda tweak: f"sha2(concat_ws('|', {key}, {_q(tweak)}, m), 256)"
    email = f"concat('u', substr({digest('email')}, 1, 16), '@', substring_index(m, '@', -1))"
    secret = f"substr(concat({digest('secret1')}, {digest('secret2')}), 1, length(m))"
    number = "aggregate(split(m, '[.]'), 0L, (t, o) -> t * 256 + cast(o AS bigint))"
    ip = _let(_feistel(number, "65536L", "65536L", "ip", key), "x", "concat_ws('.', x div 16777216, x div 65536 % 256, x div 256 % 256, x % 256)")
    day = _walk(_DAY, lambda y: f"{y} < {DAYS}", f"{SIDE}L", f"{SIDE}L", "date", key)
    date = _let(
        f"date_format(date_add(date'1900-01-01', cast({day} AS int)), 'yyyyMMdd')",
        "d",
        _in_layout("m", f"CASE WHEN substr(m, 5, 1) = '-' THEN d WHEN {_US} THEN concat(substr(d, 5, 4), substr(d, 1, 4)) ELSE concat(substr(d, 7, 2), substr(d, 5, 2), substr(d, 1, 4)) END"),
    )
    ssn = _let(f"lpad({_walk(_digits('m'), _ssn_ok, '10000L', '100000L', 'ssn', key)}, 9, '0')", "d", _in_layout("m", "d"))
    last_ten = _feistel("right(d, 10)", "100000L", "100000L", "phone", key)
    phone = _let(_digits("m"), "d", _let(f"concat(left(d, length(d) - 10), lpad({last_ten}, 10, '0'))", "e", _in_layout("m", "e")))
    n = "length(d) - 1"
    payload = _feistel("left(d, length(d) - 1)", f"{_TEN}[({n}) div 2]", f"{_TEN}[{n} - ({n}) div 2]", "card", key)
    checked = _let(f"lpad({payload}, {n}, '0')", "e", f"concat(e, (10 - {_luhn('e', 0)} % 10) % 10)")
    card = _let(_digits("m"), "d", _let(checked, "f", _in_layout("m", "f")))
    each = {"email": email, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in each.items()) + " ELSE m END"


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced, and one count for each kind, ``n_email`` ... ``n_card``.

    Matches that are not valid (a number without the right check digit, a 13th month) stay as they are. A card number is found among
    other groups of digits: of those that begin at a group and end with one, the leftmost and then the longest valid one. A date with slashes or
    dots is read day first, and month first where only that is a date, and written in the order in which it was read. A null text stays null, with zero
    counts, and so does an empty one. Very long texts are cut in their row. Rows are independent, so repeated rows give equal results; an empty
    table gives none. Columns named like the counts are replaced; others, whatever their names, stay.

    The key comes from a table of one row, by a scalar subquery, so that plans, event logs and the user interface do not show it.
    """
    key_, found_, new_ = fresh(docs, "key_", "found_", "new_")
    secret = docs.sparkSession.createDataFrame([(key,)], "key string")
    text = f"`{text_col}`"
    found = F.expr(f"transform(CASE WHEN {text} RLIKE '[0-9@]' THEN regexp_extract_all({text}, {_q(PATTERN)}, 0) ELSE cast(array() AS array<string>) END, m -> {_parts()})")
    none = F.expr("cast(array() AS array<array<struct<m:string,kind:string>>>)")
    new = F.expr(f"transform({found_}, g -> array_join(transform(g, f -> {_let('f.m', 'm', _let('f.kind', 'kind', _pseudonym(key_)))}), ''))")
    pieces = f"zip_with(split({text}, {_q(PATTERN)}, -1), concat({new_}, array('')), (a, b) -> concat(a, b))"
    out = docs.withColumn(key_, secret.scalar()).withColumn(found_, F.coalesce(found, none)).withColumn(new_, new)
    out = out.withColumns({f"n_{k}": F.expr(f"cast(size(filter(flatten({found_}), f -> f.kind = '{k}')) AS bigint)") for k in KINDS})
    return out.withColumn(text_col, F.expr(f"CASE WHEN size({found_}) = 0 THEN {text} ELSE array_join({pieces}, '') END")).drop(key_, found_, new_)
