"""SQL spellings of the text projections, for the DuckDB side of a query.

Each helper takes a SQL expression and returns a SQL expression.
"""

from __future__ import annotations

from sparktally import constants as K

_ACCENTS = ("àâäáãåéèêëîïíìôöóòõûüúùçñÿ", "aaaaaaeeeeiiiiooooouuuucny")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(_literal(v) for v in values) + "]"


def normalize_label(x: str) -> str:
    x = f"lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"
    x = f"translate({x}, '{_ACCENTS[0]}', '{_ACCENTS[1]}')"
    for sign, spelling in (("œ", "oe"), ("ß", "ss"), ("æ", "ae"), ("€", "EUR")):
        x = f"replace({x}, '{sign}', '{spelling}')"
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def merchant_text(x: str) -> str:
    lowered = f"translate(lower(coalesce({x}, '')), '{_ACCENTS[0]}', '{_ACCENTS[1]}')"
    s = f"trim(regexp_replace({lowered}, '[^a-z0-9]+', ' ', 'g'))"
    kept = (
        f"array_to_string(list_filter(string_split({s}, ' '), "
        f"lambda w: NOT list_contains({words(K.PAYMENT_WORDS)}, w)), ' ')"
    )
    return f"coalesce(nullif({kept}, ''), {s})"


def mask(x: str) -> str:
    ibans_hidden = f"regexp_replace({x}, '(?i){K.IBAN_PATTERN}', '{K.IBAN_TOKEN}', 'g')"
    return f"regexp_replace({ibans_hidden}, '{K.RUM_PATTERN}', '{K.RUM_TOKEN}', 'g')"


def operation_type(label: str, channel: str) -> str:
    channel = f"upper(trim(coalesce({channel}, '')))"
    label = f"upper(trim(coalesce({label}, '')))"
    return (
        f"CASE WHEN {channel} = 'CB' THEN 'card' WHEN {channel} = 'PRLV' THEN 'direct_debit' "
        f"WHEN {channel} = 'VIR' THEN 'transfer' WHEN starts_with({label}, 'CB ') THEN 'card' "
        f"WHEN starts_with({label}, 'PRLV ') THEN 'direct_debit' "
        f"WHEN starts_with({label}, 'VIR ') THEN 'transfer' ELSE 'unknown' END"
    )


def model_text(masked: str, operation: str, mcc: str) -> str:
    return (
        f"concat({masked}, ' op:', {operation}, ' mcc:', "
        f"CASE WHEN {mcc} >= 0 THEN CAST({mcc} AS VARCHAR) ELSE 'none' END)"
    )


def keyword_reason(text: str) -> str:
    """The first contained keyword, or null."""
    whens = " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w, _ in K.KEYWORD_CATEGORIES)
    return f"CASE {whens} END"


def keyword_category(keyword: str) -> str:
    whens = " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in K.KEYWORD_CATEGORIES)
    return f"CASE {keyword} {whens} END"


def mcc_category(mcc: str) -> str:
    whens = " ".join(f"WHEN {m} THEN '{c}'" for m, c in K.MCC_CATEGORIES.items())
    return f"CASE {mcc} {whens} END"


def ngrams(x: str, low: int = 1, high: int = 5) -> str:
    """List of character runs of ``x`` (a plain column)."""
    lists = [
        f"list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))"
        for n in range(low, high + 1)
    ]
    return f"flatten([{', '.join(lists)}])"


# ------------------------------------------------------------- similarity

def bit_masks(text: str, pattern: str) -> str:
    """Per character of ``text``, the positions it has in ``pattern`` (up to 62 characters)."""
    return (
        f"list_transform(string_split({text}, ''), lambda ch: coalesce(list_sum(list_transform("
        f"range(1, length({pattern}) + 1), lambda i: CASE WHEN substr({pattern}, i, 1) = ch "
        f"THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END)), 0)::BIGINT)"
    )


def lcs_of_masks(masks: str, pattern: str) -> str:
    """Bit-parallel longest common subsequence from the masks of ``bit_masks``."""
    full = f"((1::BIGINT << length({pattern})::INT) - 1)"
    return (
        f"(length({pattern}) - bit_count(list_reduce({masks}, "
        f"lambda acc, hit: ((acc + (acc & hit)) | (acc - (acc & hit))) & {full}, {full})))"
    )


def indel(a: str, b: str) -> str:
    """Insertions plus deletions between two plain columns, ``b`` up to 62 characters."""
    return f"CAST(length({a}) + length({b}) - 2 * {lcs_of_masks(bit_masks(a, b), b)} AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"((1 - {indel(a, b)} / (length({a}) + length({b}))) * 100)"


def token_set_steps(source: str, a: str, b: str, keep: str, name: str = "token_set") -> str:
    """CTEs ending in ``name``: columns ``keep`` and the score of ``a`` against ``b``."""
    return f"""{name}_t AS (SELECT {keep}, list_distinct(string_split({a}, ' ')) AS ta, list_distinct(string_split({b}, ' ')) AS tb
  FROM {source} WHERE {a} <> '' AND {b} <> ''),
{name}_d AS (SELECT {keep}, array_to_string(list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))), ' ') AS da,
  array_to_string(list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))), ' ') AS db,
  array_to_string(list_sort(list_filter(ta, lambda t: list_contains(tb, t))), ' ') AS ii FROM {name}_t),
{name}_l AS (SELECT *, length(da) AS la, length(db) AS lb, length(ii) AS li, CASE WHEN ii <> '' THEN 1 ELSE 0 END AS sep FROM {name}_d),
{name} AS (SELECT {keep}, CASE
  WHEN li > 0 AND (la = 0 OR lb = 0) THEN 100::DOUBLE
  ELSE greatest(100::DOUBLE - 100::DOUBLE * {indel("da", "db")} / (2 * (li + sep) + la + lb),
    CASE WHEN li > 0 THEN greatest(100::DOUBLE - 100::DOUBLE * (sep + la) / (2 * li + sep + la),
                                   100::DOUBLE - 100::DOUBLE * (sep + lb) / (2 * li + sep + lb)) ELSE 0::DOUBLE END) END AS score
  FROM {name}_l)"""


def partial_steps(source: str, keep: str, x: str, y: str, name: str) -> str:
    """CTEs ending in ``name``: columns ``keep`` and the best window ratio of ``x`` and ``y``."""
    window = "greatest(p, 1) : least(p + length(s) - 1, length(l))"
    return f"""{name}_p AS (SELECT {keep}, {x} AS s, {y} AS l FROM {source} WHERE length({x}) <= length({y})
  UNION ALL SELECT {keep}, {y}, {x} FROM {source} WHERE length({y}) <= length({x})),
{name}_m AS (SELECT {keep}, s, l, {bit_masks("l", "s")} AS m FROM {name}_p WHERE s <> ''),
{name} AS (SELECT {keep}, max(list_max(list_transform(range(2 - length(s), length(l) + 1), lambda p: (1::DOUBLE -
  (length(s) + len(m[{window}]) - 2 * {lcs_of_masks(f"m[{window}]", "s")})::DOUBLE / (length(s) + len(m[{window}]))) * 100))) AS score
  FROM {name}_m GROUP BY ALL)"""
