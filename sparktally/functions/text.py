"""Text projections: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktally import constants as K


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Pattern of a run of blanks.
BLANKS_TO_ONE = f"{K.BLANK}+"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed_point(c: Column, digits: int) -> Column:
    """Non-negative number as text with ``digits`` decimals, rounded by its exact value.

    Spark rounds the shortest decimal form: 0.855 would give 0.86 although the
    double lies below the tie. Here the number is split into two halves whose
    products are exact, which tells the side of the tie; true ties go to even.
    """
    scale = 10 ** digits

    def decide(x: Column) -> Column:
        whole = F.floor(x * scale).cast("double")
        upper = x * 134217729.0 - (x * 134217729.0 - x)
        past_tie = (upper * (2.0 * scale) - (whole * 2.0 + 1.0)) + (x - upper) * (2.0 * scale)
        up = (past_tie > 0) | ((past_tie == 0) & (whole % 2 == 1))
        return F.format_string(f"%.{digits}f", (whole + F.when(up, 1.0).otherwise(0.0)) / scale)

    return F.when(c.isNotNull(), bind(c.cast("double"), decide))


# ----------------------------------------------------------------- folding

@lru_cache
def accent_table() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII letter plus marks.

    Built by rule over the Latin blocks, upper and lower case alike, so it can
    be handed to ``translate`` as two strings of equal length.
    """
    blocks = [range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF10, 0xFF5B)]
    letters, bases = [], []
    for code in (c for block in blocks for c in block):
        plain = "".join(
            ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch)
        )
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            letters.append(chr(code))
            bases.append(plain)
    return "".join(letters), "".join(bases)


@lru_cache
def spelling_tables() -> tuple[tuple[str, str], list[tuple[str, str]]]:
    """One-to-one spellings (for ``translate``) and the longer ones."""
    single = {k: v for k, v in K.ASCII_SPELLINGS.items() if len(v) == 1}
    longer = [(k, v) for k, v in K.ASCII_SPELLINGS.items() if len(v) > 1]
    return ("".join(single), "".join(single.values())), longer


def _when_not_ascii(c: Column, folded: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


def ascii_fold(c: Column | str) -> Column:
    """ASCII spelling of Latin text; plain ASCII rows skip the tables."""
    c = _column(c)
    letters, bases = accent_table()
    (signs, plain), longer = spelling_tables()
    out = F.translate(c, letters + signs, bases + plain)
    for sign, spelling in longer:
        out = F.replace(out, F.lit(sign), F.lit(spelling))
    return _when_not_ascii(c, F.regexp_replace(out, r"[\x{300}-\x{36f}]", ""))


def strip(c: Column | str) -> Column:
    """Drop blanks at both ends (``trim`` would only drop spaces)."""
    return F.regexp_replace(_column(c), f"^{K.BLANK}+|{K.BLANK}+$", "")


def normalize_label(c: Column | str) -> Column:
    """Null to empty, strip, lower, fold to ASCII, then one space per blank run."""
    lowered = F.lower(strip(F.coalesce(_column(c), F.lit(""))))
    return F.regexp_replace(ascii_fold(lowered), BLANKS_TO_ONE, " ")


def normalize_merchant_text(c: Column | str) -> Column:
    """Text for merchant matching: letters, digits and single spaces, without
    payment words unless nothing else is left."""
    text = F.coalesce(_column(c), F.lit(""))
    letters, bases = accent_table()
    bare = F.regexp_replace(F.translate(text, letters, bases), r"[\x{300}-\x{36f}]", "")
    for ch, expansion in K.COMPATIBILITY_SPELLINGS.items():
        bare = F.replace(bare, F.lit(ch), F.lit(expansion))
    s = F.regexp_replace(F.lower(_when_not_ascii(text, bare)), "[^a-z0-9]+", " ")

    def without_payment_words(s: Column) -> Column:
        kept = F.array_join(F.filter(F.split(s, " "), lambda t: ~t.isin(K.PAYMENT_WORDS)), " ")
        return F.coalesce(F.nullif(kept, F.lit("")), s)

    return bind(F.trim(s), without_payment_words)


# ----------------------------------------------------------------- masking

def pii_matches(c: Column | str) -> Column:
    """Struct of the IBAN (upper-cased) and mandate references found."""
    c = _column(c)
    return F.struct(
        F.regexp_extract_all(F.upper(c), F.lit(K.IBAN_PATTERN), 0).alias("iban"),
        F.regexp_extract_all(c, F.lit(K.RUM_PATTERN), 0).alias("rum"),
    )


def mask_pii(c: Column | str, iban_mask: str = "always") -> Column:
    """Replace IBAN and mandate references by neutral tokens.

    ``always`` hides an IBAN in any case. ``reference`` hides only those that
    stand in the text in upper case, so lower-cased text keeps them.
    """
    c = _column(c)
    if iban_mask == "always":
        ibans_hidden = F.regexp_replace(c, "(?i)" + K.IBAN_PATTERN, K.IBAN_TOKEN)
        return F.regexp_replace(ibans_hidden, K.RUM_PATTERN, K.RUM_TOKEN)
    if iban_mask != "reference":
        raise ValueError("iban_mask is 'always' or 'reference'")
    found = pii_matches(c)
    ibans_hidden = F.aggregate(
        F.array_distinct(found["iban"]), c, lambda text, m: F.replace(text, m, F.lit(K.IBAN_TOKEN))
    )
    return F.aggregate(
        F.array_distinct(found["rum"]), ibans_hidden,
        lambda text, m: F.replace(text, m, F.lit(K.RUM_TOKEN)),
    )


# --------------------------------------------------------- types and tokens

def operation_type(label: Column | str, channel: Column | str) -> Column:
    """From the channel if it is a known one, else from the label's prefix.

    The prefix is a code and a space in front of more text, in any case.
    """
    codes = list(K.OPERATION_TYPES)
    channel = F.upper(strip(F.coalesce(_column(channel), F.lit(""))))
    more_text = "(?=.*[^" + K.BLANK[1:] + ")"
    prefix = F.regexp_extract(
        F.coalesce(_column(label), F.lit("")), f"(?is)^{K.BLANK}*({'|'.join(codes)}) {more_text}", 1)
    code = F.when(channel.isin(codes), channel).otherwise(F.upper(prefix))
    kinds = F.create_map(*[F.lit(x) for pair in K.OPERATION_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, code), F.lit(K.UNKNOWN_OPERATION))


def tokenize(c: Column | str) -> Column:
    return F.regexp_extract_all(_column(c), F.lit("[a-z0-9]+"), 0)


def preprocess(df: DataFrame, label: str = "raw_label", channel: str = "channel",
               iban_mask: str = "always") -> DataFrame:
    """Add normalized, masked, tokens, has_iban, has_rum and operation_type.

    Channel and merchant code are optional: an absent column is added without values.
    """
    absent = {name: F.lit(None).cast(kind) for name, kind in ((channel, "string"), ("mcc", "int")) if name not in df.columns}
    return (
        df.withColumns(absent).withColumn("normalized", normalize_label(label))
        .withColumns({
            "masked": mask_pii("normalized", iban_mask),
            "has_iban": F.upper("normalized").rlike(K.IBAN_PATTERN),
            "has_rum": F.col("normalized").rlike(K.RUM_PATTERN),
            "operation_type": operation_type(label, channel),
        })
        .withColumn("tokens", tokenize("masked"))
    )


def model_text(masked: Column | str = "masked", operation: Column | str = "operation_type",
               mcc: Column | str = "mcc") -> Column:
    """Masked text with operation and merchant-code words appended."""
    mcc = _column(mcc).try_cast("int")
    return F.concat(
        _column(masked), F.lit(" op:"), F.coalesce(_column(operation), F.lit(K.UNKNOWN_OPERATION)),
        F.lit(" mcc:"), F.when(mcc >= 0, mcc.cast("string")).otherwise("none"),
    )


def char_ngrams(c: Column | str, low: int = 1, high: int = 5) -> Column:
    """Every run of ``low``..``high`` characters, blanks collapsed, in order of size."""

    def of_length(text: Column, n: int) -> Column:
        return F.when(
            F.length(text) >= n,
            F.transform(
                F.sequence(F.lit(1), F.length(text) - (n - 1)),
                lambda i: F.substring(text, i, F.lit(n)),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return bind(
        F.regexp_replace(_column(c), BLANKS_TO_ONE, " "),
        lambda text: F.concat(*[of_length(text, n) for n in range(low, high + 1)]),
    )


def one_per_row(df: DataFrame, keep: list[str], items: Column | str, name: str) -> DataFrame:
    """The kept columns and one row per non-null item.

    A plain explode makes Spark test the array for emptiness in a filter of its
    own, which computes costly arrays a second time. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def ngram_rows(df: DataFrame, keep: list[str], text: str, low: int = 1, high: int = 5,
               name: str = "gram", first: str | None = None) -> DataFrame:
    """One row per character n-gram occurrence, as ``char_ngrams`` lists them; ``first`` marks the first of a gram in its text.

    Positions are exploded before the pieces are cut, so that generation, cutting
    and a following partial aggregation compile into one loop.
    """
    collapsed = df.select(*keep, F.regexp_replace(text, BLANKS_TO_ONE, " ").alias("_t"))
    size = F.length("_t")
    starts = F.when(size >= low, F.sequence(F.lit(1), size - (low - 1)))
    placed = collapsed.select(*keep, "_t", F.explode_outer(starts).alias("_i"))
    pieces = F.array(*[
        F.when(F.col("_i") + (n - 1) <= size, F.substring("_t", F.col("_i"), F.lit(n))) for n in range(low, high + 1)
    ])
    if first is None:
        return one_per_row(placed, keep, pieces, name)
    return one_per_row(placed, [*keep, "_t", "_i"], pieces, name).select(
        *keep, name, (F.position(F.col(name), F.col("_t")) == F.col("_i")).alias(first))


# ------------------------------------------------------------ document words

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def clean_tokens(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-case words with ASCII punctuation and digits deleted, without stop
    words and one-letter words."""
    stop = stop_words or K.STOP_WORDS
    text = F.regexp_replace(F.lower(_column(c)), _PUNCTUATION + "|[0-9]", "")
    return F.filter(F.split(text, BLANKS_TO_ONE), lambda t: (F.length(t) > 1) & ~t.isin(stop))


def minimal_prep(c: Column | str) -> Column:
    """Lower-case, anything but word characters and blanks to a space, collapsed."""
    text = F.regexp_replace(F.lower(_column(c)), r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(text, BLANKS_TO_ONE, " "))


def word_tokens(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Words of two or more characters of the prepared text, without stop words."""
    stop = stop_words or K.STOP_WORDS
    return F.filter(F.split(minimal_prep(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(stop))
