"""Category rules: merchant code, ordered keywords, phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally.functions.text import _column, bind
from sparktally.session import cut_lineage

#: Keywords of one automaton; larger tables are searched in several passes.
MOST_KEYWORDS = 200_000
VERDICT_TYPE = "struct<category:string,reason:string>"


def _verdict(category, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(category.alias("category"), reason.alias("reason"))


def category_from_mcc(mcc: Column | str) -> Column:
    """Category of a known merchant code, else null. Six literals, no join."""
    mcc = _column(mcc).try_cast("int")
    (code, category), *rest = K.MCC_CATEGORIES.items()
    out = F.when(mcc == code, category)
    for code, category in rest:
        out = out.when(mcc == code, category)
    return out


def keyword_category(text: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    """First rule whose keyword is contained in the text, as a verdict or null.

    The text is bound to a variable first: a filter on the outcome that is pushed
    below the projection that made ``text`` then repeats it once, not per rule.
    """
    (word, category), *rest = rules or K.KEYWORD_CATEGORIES

    def first_hit(t: Column) -> Column:
        out = F.when(F.contains(t, F.lit(word)), _verdict(category, f"keyword:{word}"))
        for w, c in rest:
            out = out.when(F.contains(t, F.lit(w)), _verdict(c, f"keyword:{w}"))
        return out

    return bind(_column(text), first_hit)


def pattern_category(text: Column | str) -> Column:
    """Invoice of a known operator, salary or rent phrase, as a verdict or null."""
    text = _column(text)
    operator = text.rlike("|".join(K.INVOICE_OPERATORS))
    return (
        F.when(text.rlike(K.INVOICE_PATTERN) & operator, _verdict("Utilities", "pattern:facture+operator"))
        .when(text.rlike(K.SALARY_PATTERN), _verdict("Salary", "pattern:salaire"))
        .when(text.rlike(K.RENT_PATTERN), _verdict("Rent", "pattern:loyer"))
    )


def rule_outcome(text: Column | str, mcc: Column | str) -> Column:
    """Struct (hit, category, reason): merchant code, then keyword, then phrase."""
    mcc = _column(mcc).try_cast("int")
    by_mcc = category_from_mcc(mcc)
    verdict = F.coalesce(
        F.when(by_mcc.isNotNull(), _verdict(by_mcc, F.concat(F.lit("mcc:"), mcc.cast("string")))),
        bind(_column(text), lambda t: F.coalesce(keyword_category(t), pattern_category(t))),
    )
    return bind(
        verdict,
        lambda v: F.struct(
            v.isNotNull().alias("hit"),
            v["category"].alias("category"),
            F.coalesce(v["reason"], F.lit("")).alias("reason"),
        ),
    )


def apply_rules(df: DataFrame, text: str = "normalized", mcc: str = "mcc") -> DataFrame:
    """Add rule_hit, rule_category and rule_reason. A merchant code that is no number, or no such column, counts as none."""
    code = F.col(mcc) if mcc in df.columns else F.lit(None).cast("int")
    out = df.withColumn("_rule", rule_outcome(text, code))
    return out.withColumns({
        "rule_hit": F.col("_rule.hit"),
        "rule_category": F.col("_rule.category"),
        "rule_reason": F.col("_rule.reason"),
    }).drop("_rule")


def _keyword_pass(rules: list[tuple], spark):
    """Arrow function: text -> the rule of lowest priority whose keyword it holds."""
    shared = spark.sparkContext.broadcast(rules)

    @F.pandas_udf("struct<priority:bigint,keyword:string,category:string>")
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), None
        for rule in sorted(shared.value, key=lambda r: (r[0], r[1], r[2] or ""), reverse=True):  # of equal keywords the lowest priority stays
            if rule[1]:
                automaton.add_word(rule[1], rule)
            else:
                everywhere = rule
        if len(automaton):
            automaton.make_automaton()

        def best(text: str | None) -> tuple:
            if text is None:
                return (None, None, None)
            found = [rule for _, rule in automaton.iter(text)] if len(automaton) and text else []
            if everywhere is not None:
                found.append(everywhere)
            return min(found, key=lambda r: (r[0], r[1], r[2] or "")) if found else (None, None, None)

        for texts in parts:
            known = {t: best(t) for t in texts.unique()}
            out = pd.DataFrame([known[t] for t in texts], columns=["priority", "keyword", "category"], index=texts.index)
            yield out.astype({"priority": "Int64"})

    return search


def keyword_category_table(df: DataFrame, rules: DataFrame, text: str = "normalized", block: int = MOST_KEYWORDS) -> DataFrame:
    """Add kw_category and kw_reason of the rule (priority, keyword, category) of lowest priority whose keyword the text holds.

    Rules of equal priority go by keyword, then category; a rule without a keyword or priority is left out, an empty
    keyword is in every text. A null text and a text without a keyword get nulls. One automaton finds all keywords in one pass over
    a text, however many there are; tables beyond ``block`` rules take several passes, so a task holds one block.
    """
    named = rules.select(F.col("priority").cast("bigint").alias("priority"), F.col("keyword").cast("string").alias("keyword"),
                         F.col("category").cast("string").alias("category")).where("priority IS NOT NULL AND keyword IS NOT NULL").distinct()
    spark = df.sparkSession
    blocks = max(1, -(-named.count() // block))
    out = df.withColumn("_best", F.lit(None).cast("struct<priority:bigint,keyword:string,category:string>"))
    for number in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == number)
        search = _keyword_pass([(r["priority"], r["keyword"], r["category"]) for r in part.collect()], spark)
        hit = search(F.col(text))
        out = out.withColumn("_hit", hit).withColumn("_hit", F.when(F.col("_hit.priority").isNotNull(), F.col("_hit")))
        out = out.withColumn("_best", F.least("_best", "_hit")).drop("_hit")
        if number + 1 < blocks:
            out = cut_lineage(out, "keywords")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_best.category").alias("kw_category"),
                      F.when(F.col("_best").isNotNull(), F.concat(F.lit("keyword:"), F.col("_best.keyword"))).alias("kw_reason"))
