"""Merchant resolution: fuzzy matching of labels against a gazetteer.

A gazetteer has the columns alias_idx, alias, merchant_id, display_name;
``alias_idx`` is the order of the source file and decides ties.

Every threshold gives the same answer at every size. Three exact ways lead to it:

* up to ``MAX_SHIPPED`` aliases travel to the tasks with the scoring function, which
  scores only aliases whose best case, by letters and tokens in common, can still
  win. No row is shuffled, which also serves streams;
* beyond it, distinct labels and aliases meet in equi-joins on their rarest keys
  (``keyed_join``): tokens and contained pieces first, which finds every pair that scores 100. Labels that have
  as many of those as are asked for are done. From a floor of ``EDIT_FLOOR`` on the others meet
  aliases on trigram prefixes, and each pair that meets is tested once in the JVM before it is scored;
* below that floor any alias may be the best of what is left, so those labels
  meet the gazetteer in a grid: blocks of ``BLOCK`` aliases times slices of labels, dealt
  out by a shuffle, with the same best-case test in each cell. Nothing passes through the driver. Work then
  grows with labels times aliases.

A stream, whose rows cannot be made distinct, is held against blocks of aliases that travel with the functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktally.functions import similarity
from sparktally.functions.text import bind, fixed_point, normalize_merchant_text, strip
from sparktally.operators import keyed_join
from sparktally.operators.frequent import attach, text_counts
from sparktally.operators.keyed_join import EDIT_FLOOR
from sparktally.session import cut_lineage

MAX_SHIPPED = 2_000
#: Labels of a slice that meets a block of aliases in one cell of the grid.
SLICE = 50_000
#: Labels that one task scores against a shipped gazetteer.
TASK_LABELS = 20_000
#: Aliases per pass where the whole gazetteer has to be looked through.
BLOCK = 20_000
#: Aliases of highest best case that are scored first for every label.
FIRST_LOOK = 8
_LETTERS = 64
#: Label-alias pairs scored at once within a task.
PAIR_BLOCK = 200_000

_CANDIDATE = "struct<alias_idx:bigint,merchant_id:string,display_name:string,alias:string,score:double>"
_COLUMNS = ["alias_idx", "merchant_id", "display_name", "alias"]


def merchant_aliases(gaz: DataFrame) -> DataFrame:
    """Aliases in merchant-text form; those that come out empty are dropped."""
    return gaz.select(
        F.col("alias_idx").cast("bigint").alias("alias_idx"),
        F.col("merchant_id").cast("string").alias("merchant_id"),
        F.col("display_name").cast("string").alias("display_name"),
        normalize_merchant_text("alias").alias("alias"),
    ).where("alias <> ''")


def plain_aliases(gaz: DataFrame) -> DataFrame:
    """Aliases lower-cased and stripped, accents kept."""
    return gaz.select(
        F.col("alias_idx").cast("bigint").alias("alias_idx"),
        F.col("merchant_id").cast("string").alias("merchant_id"),
        F.col("display_name").cast("string").alias("display_name"),
        strip(F.lower("alias")).alias("alias"),
    )


def _in_file_order(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).sort_values("alias_idx", kind="stable", ignore_index=True)


def _shipped(aliases: DataFrame, max_shipped: int) -> pd.DataFrame | None:
    """The aliases in file order, or None if there are more than the bound."""
    rows = aliases.select(*_COLUMNS).limit(max_shipped + 1).collect()
    return None if len(rows) > max_shipped else _in_file_order(rows)


def _alias_blocks(aliases: DataFrame, size: int):
    """All aliases in blocks of about ``size``, each in file order."""
    named = aliases.select(*_COLUMNS)
    blocks = max(1, -(-named.count() // size))
    for block in range(blocks):
        yield _in_file_order(named.where(F.pmod(F.xxhash64("alias_idx", "alias"), F.lit(blocks)) == block).collect())


# --------------------------------------------------- aliases with the function

class _BestCase:
    """Upper bounds of a score between a label and every alias, from letters and tokens in common."""

    def __init__(self, names: list[str], weighted: bool):
        self.weighted = weighted
        profiles = [self.profile(x) for x in names]
        self.letters = np.array([p[0] for p in profiles], np.int16).reshape(len(names), _LETTERS)
        self.lengths = np.array([p[1:4] for p in profiles], float).reshape(len(names), 3)
        postings: dict[str, list[int]] = {}
        for i, p in enumerate(profiles):
            for token in p[4]:
                postings.setdefault(token, []).append(i)
        self.postings = {token: np.array(at) for token, at in postings.items()}

    @staticmethod
    def profile(text: str):
        """Counts by letter class, lengths as is, token-sorted and of distinct tokens, and the tokens."""
        tokens = text.split()
        distinct = set(tokens)
        joined = " ".join(sorted(tokens))
        counts = np.zeros((2, _LETTERS), np.int16)
        for row, t in enumerate((text, joined)):
            np.add.at(counts[row], np.frombuffer(t.encode("utf-32-le"), np.uint32) % _LETTERS, 1)
        return counts.max(axis=0), len(text), len(joined), len(" ".join(distinct)), distinct

    def of(self, label: str) -> np.ndarray:
        letters, raw, joined, distinct, tokens = self.profile(label)
        common = np.minimum(self.letters, letters).sum(axis=1).astype(float)
        shared, number = np.zeros(len(common)), np.zeros(len(common))
        for token in tokens:
            at = self.postings.get(token)
            if at is not None:
                shared[at] += len(token)
                number[at] += 1
        sharing = number > 0

        def total(a, b):
            return np.minimum(200.0 * common / np.maximum(a + b, 1), 100.0)

        def score(distance, size):
            return 100.0 - 100.0 * distance / np.maximum(size, 1)

        # the token set score itself, but for the letters that the own tokens of both sides have in common
        sep, li = sharing.astype(float), np.where(sharing, shared + number - 1, 0.0)
        la = np.maximum(distinct - li - sep, 0)
        lb = np.maximum(self.lengths[:, 2] - li - sep, 0)
        rest = np.minimum(np.maximum(common - shared, 0), np.minimum(la, lb))
        token_set = score(la + lb - 2 * rest, 2 * (li + sep) + la + lb)
        alone = np.maximum(score(sep + la, 2 * li + sep + la), score(sep + lb, 2 * li + sep + lb))
        token_set = np.where(sharing, np.maximum(token_set, np.where((la == 0) | (lb == 0), 100.0, alone)), token_set)
        if not self.weighted:
            return token_set
        whole = total(raw, self.lengths[:, 0])
        near = np.maximum(whole, 0.95 * np.maximum(total(joined, self.lengths[:, 1]), token_set))
        short = np.minimum(raw, self.lengths[:, 0])
        quotient = np.maximum(raw, self.lengths[:, 0]) / np.maximum(short, 1)

        def window(m):
            return np.minimum(200.0 * common / np.maximum(m + common, 1), 100.0)

        least = np.minimum(distinct, self.lengths[:, 2])
        scale = np.where(quotient <= 8, 0.9, 0.6)
        far = np.maximum(whole, scale * np.maximum(window(short), 0.95 * np.where(sharing, 100.0, window(least))))
        return np.where(short == 0, 0.0, np.where(quotient < 1.5, near, far))


class _Gazetteer:
    """Aliases in file order with all that scoring labels against them needs."""

    def __init__(self, aliases: pd.DataFrame, k: int, scorer, keep_below: float | None, weighted: bool):
        self.names = aliases["alias"].tolist()
        self.rows = list(aliases[_COLUMNS].itertuples(index=False, name=None))
        self.k, self.scorer, self.keep_below = k, scorer, keep_below
        self.bounds = _BestCase(self.names, weighted)

    def _scored(self, labels: list[str], picks: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        sizes = np.array([len(p) for p in picks])
        start = 0
        while start < len(labels):
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), PAIR_BLOCK, "right")))
            left = [x for x, p in zip(labels[start:stop], picks[start:stop]) for _ in p]
            right = [self.names[i] for p in picks[start:stop] for i in p]
            got = self.scorer(left, right) if left else np.zeros(0)
            out += np.split(got, np.cumsum(sizes[start:stop])[:-1])
            start = stop
        return out

    def best(self, labels: list[str]) -> dict[str, list[tuple]]:
        """label -> best ``k`` aliases, best score first, then file order.

        First the aliases of highest best case are scored, then only those whose best case
        still beats the k-th score found, or equals it and stands earlier in the file.
        """
        found: dict[str, list[tuple]] = {}
        step = max(1, 4 * PAIR_BLOCK // max(1, len(self.names)))
        for start in range(0, len(labels) if self.names else 0, step):
            found.update(self._best(labels[start:start + step]))
        return found

    def _best(self, labels: list[str]) -> dict[str, list[tuple]]:
        k, keep_below = self.k, self.keep_below
        floor = -1.0 if keep_below is None else keep_below
        best_case = [self.bounds.of(x) for x in labels]
        first = [np.argsort(-b, kind="stable")[:max(k, FIRST_LOOK)] for b in best_case]
        first = [p[b[p] >= floor - 1e-9] for p, b in zip(first, best_case)]
        known = self._scored(labels, first)
        rest = []
        for bound, picks, got in zip(best_case, first, known):
            least, last = floor, len(self.names)
            if len(got) >= k:
                at = np.lexsort((picks, -got))[k - 1]
                if got[at] >= floor:
                    least, last = got[at], picks[at]
            open_ = bound > least + 1e-9
            open_[:last] |= bound[:last] >= least - 1e-9
            open_[picks] = False
            rest.append(np.flatnonzero(open_))
        found = {}
        for label, picks, got, more, also in zip(labels, first, known, rest, self._scored(labels, rest)):
            at, score = np.concatenate([picks, more]), np.concatenate([got, also])
            order = np.lexsort((at, -score))[:k]
            found[label] = [(*self.rows[at[i]], float(score[i])) for i in order if keep_below is None or score[i] >= keep_below]
        return found


def _top_in_task(aliases: pd.DataFrame, k: int, scorer, keep_below: float | None, weighted: bool = False):
    """Arrow function: label -> best ``k`` aliases; the aliases travel with it."""

    @F.pandas_udf(f"array<{_CANDIDATE}>")
    def top(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gazetteer = _Gazetteer(aliases, k, scorer, keep_below, weighted)
        known: dict[str, list[tuple]] = {}
        for labels in parts:
            if len(known) > PAIR_BLOCK:
                known.clear()
            fresh = [x for x in labels.dropna().unique() if x not in known and (x != "" or keep_below is None)]
            known.update(gazetteer.best(fresh))
            yield labels.map(lambda x: known.get(x, []))

    return top


def _best_of_blocks(df: DataFrame, query: str, aliases: DataFrame, k: int, scorer, floor: float | None, weighted: bool,
                    block: int) -> DataFrame:
    """Add ``_top``: the best k aliases of the whole gazetteer, one pass per block of aliases."""

    def before(a: Column, b: Column) -> Column:
        better = (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["alias_idx"] < b["alias_idx"]))
        return F.when(better, -1).otherwise(1)

    out = df.withColumn("_top", F.array().cast(f"array<{_CANDIDATE}>"))
    for part in _alias_blocks(aliases, block):
        top = _top_in_task(part, k, scorer, floor, weighted)
        out = out.withColumn("_top", F.slice(F.array_sort(F.concat("_top", top(F.col(query))), before), 1, k))
    return out


# --------------------------------------------------------- joins on keys, grid

def _sorted_tokens(text: Column) -> Column:
    return F.array_sort(F.filter(F.split(text, " "), lambda t: t != ""))


def _token_set_may_reach(a: str, b: str, floor: float, by_edits: bool = True) -> Column:
    """False only if the token set score of two sorted token columns is below the floor, or reached by edits alone if those do not count."""
    a_tokens, b_tokens = F.array_distinct(a), F.array_distinct(b)
    shared = F.array_join(F.array_intersect(a_tokens, b_tokens), " ")
    only_a = F.array_join(F.array_except(a_tokens, b_tokens), " ")
    only_b = F.array_join(F.array_except(b_tokens, a_tokens), " ")
    share = (100.0 - floor) / 100.0 + 1e-9

    def decide(p: Column) -> Column:
        li, la, lb = F.length(p["i"]), F.length(p["a"]), F.length(p["b"])
        sep = F.when(li > 0, 1).otherwise(0)
        near = F.levenshtein(p["a"], p["b"]) <= share * (2 * (li + sep) + la + lb)
        # shared tokens alone against shared plus own tokens of either side
        covers = (li > 0) & ((sep + F.least(la, lb)) <= share * (2 * li + sep + F.least(la, lb)))
        subset = (li > 0) & ((la == 0) | (lb == 0))
        return subset | covers | near if by_edits else subset | covers

    return bind(F.struct(shared.alias("i"), only_a.alias("a"), only_b.alias("b")), decide)


def _weighted_may_reach(label: str, alias: str, label_tokens: str, alias_tokens: str, floor: float, by_edits: bool = True) -> Column:
    """False only if the weighted ratio of the two columns is below the floor (at least 90), or reached by edits alone if those do not count."""
    a, b = F.col(label), F.col(alias)
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    contained = (longer >= 1.5 * shorter) & (longer <= 8 * shorter) & (F.contains(a, b) | F.contains(b, a))
    share = (100.0 - floor) / 100.0 + 1e-9
    token_floor = floor / 0.95
    token_share = (100.0 - token_floor) / 100.0 + 1e-9
    sorted_a, sorted_b = F.array_join(label_tokens, " "), F.array_join(alias_tokens, " ")
    alike = _token_set_may_reach(label_tokens, alias_tokens, token_floor, by_edits) | (a == b)
    if by_edits:
        alike = alike | (F.levenshtein(a, b) <= share * (longer + shorter)) | (
            F.levenshtein(sorted_a, sorted_b) <= token_share * (F.length(sorted_a) + F.length(sorted_b)))
    return (shorter > 0) & (contained | ((longer < 1.5 * shorter) & alike))


def _keys(scorer: str, floor: float) -> keyed_join.Keys:
    if scorer == "token_set":
        return keyed_join.Keys(floor, {"d": floor}, False)
    return keyed_join.Keys(floor / 0.95, {"r": floor, "o": floor / 0.95, "d": floor / 0.95}, True)


#: Least floor of the join on tokens and pieces, where the asked one is lower.
_TOKEN_FLOOR = {"token_set": 80.0, "weighted_ratio": 90.0}


def _with_tokens(labels: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (labels.select("label", _sorted_tokens(F.col("label")).alias("label_tokens")),
            aliases.select(*_COLUMNS, _sorted_tokens(F.col("alias")).alias("alias_tokens")).where("alias <> ''"))


def _scored_pairs(pairs: DataFrame, scorer: str, floor: float) -> DataFrame:
    scored = similarity.score_pairs(pairs.select("label", *_COLUMNS).distinct(), "label", "alias", [scorer])
    return scored.withColumnRenamed(scorer, "score").where(F.col("score") >= floor - (1e-9 if floor < 100 else 0))


def _may_reach(scorer: str, floor: float, by_edits: bool) -> Column:
    if scorer == "token_set":
        return _token_set_may_reach("label_tokens", "alias_tokens", floor, by_edits)
    return _weighted_may_reach("label", "alias", "label_tokens", "alias_tokens", floor, by_edits)


def _token_join(labels: DataFrame, aliases: DataFrame, scorer: str, floor: float, keys: keyed_join.Keys) -> DataFrame:
    """Scored pairs of at least ``floor`` by what they share; of those that score 100, all."""
    left, right = _with_tokens(labels, aliases)
    pairs = keyed_join.token_pairs(left, right, "label", "alias", keys).where(_may_reach(scorer, floor, False))
    return _scored_pairs(pairs, scorer, floor)


def _edit_join(labels: DataFrame, aliases: DataFrame, scorer: str, floor: float, keys: keyed_join.Keys) -> DataFrame:
    """Scored pairs of at least ``floor`` by what edits leave of them."""
    left, right = _with_tokens(labels, aliases)
    pairs = keyed_join.edit_pairs(left, right, "label", "alias", keys).where(_may_reach(scorer, floor, True))
    return _scored_pairs(pairs, scorer, floor)


def _grid(labels: DataFrame, aliases: DataFrame, k: int, scorer, floor: float | None, weighted: bool) -> DataFrame:
    """(label, alias columns, score): the best k aliases of each label from each block, without a join on keys.

    Labels are copied to all blocks of aliases and aliases to all slices of labels; a cell holds one of each.
    """
    blocks, slices = max(1, -(-aliases.count() // BLOCK)), max(1, -(-labels.count() // SLICE))
    if blocks * slices == 1:  # one cell: slices let all cores take part
        slices = max(1, labels.sparkSession.sparkContext.defaultParallelism)
    left = labels.select("label", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                         F.pmod(F.xxhash64("label"), F.lit(slices)).cast("int").alias("slice"))
    right = aliases.select(*_COLUMNS, F.pmod(F.xxhash64("alias_idx", "alias"), F.lit(blocks)).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def cell(texts: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        names = part.sort_values(["alias_idx", "alias"], kind="stable", ignore_index=True)
        found = _Gazetteer(names, k, scorer, floor, weighted).best(texts["label"].tolist()) if len(texts) else {}
        rows = [(label, *row) for label, best in found.items() for row in best]
        return pd.DataFrame(rows, columns=["label", *_COLUMNS, "score"])

    schema = "label string, alias_idx bigint, merchant_id string, display_name string, alias string, score double"
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(cell, schema)


def blocked_scores(labels: DataFrame, aliases: DataFrame, scorer: str, floor: float) -> DataFrame:
    """label, alias columns and score for every pair that scores at least ``floor``, one of the two scorers by name.

    ``labels`` holds distinct texts in the column ``label``.
    """
    if floor < max(EDIT_FLOOR, _TOKEN_FLOOR[scorer] if scorer == "weighted_ratio" else 0.0):
        return _grid(labels, aliases, 1 << 40, similarity.SCORERS[scorer], floor, scorer == "weighted_ratio")
    keys = keyed_join.with_counts(_keys(scorer, floor), [labels.select(F.col("label").alias("text")), aliases.select(F.col("alias").alias("text"))])
    both = _token_join(labels, aliases, scorer, floor, keys).union(_edit_join(labels, aliases, scorer, floor, keys))
    return both.distinct()


def _top_of(scored: DataFrame, k: int) -> DataFrame:
    """label, ``_top``: the best k candidates, best score first, then file order."""
    if k == 1:
        pick = F.struct("alias_idx", "merchant_id", "display_name", "alias", "score")
        return scored.groupBy("label").agg(F.array(F.max_by(pick, F.struct("score", -F.col("alias_idx")))).alias("_top"))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "alias_idx")
    ranked = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    candidate = F.struct("_r", "alias_idx", "merchant_id", "display_name", "alias", "score")
    best = ranked.groupBy("label").agg(F.array_sort(F.collect_list(candidate)).alias("_top"))
    return best.withColumn("_top", F.transform("_top", lambda c: F.struct(
        c["alias_idx"].alias("alias_idx"), c["merchant_id"].alias("merchant_id"),
        c["display_name"].alias("display_name"), c["alias"].alias("alias"), c["score"].alias("score"))))


def _joined_top(labels: DataFrame, aliases: DataFrame, k: int, name: str, scorer, floor: float | None) -> DataFrame:
    """label, ``_top`` of all labels that have a candidate: tokens first, then what is left by edits or in the grid."""
    low = _TOKEN_FLOOR[name] if floor is None else max(floor, _TOKEN_FLOOR[name])
    texts = cut_lineage(labels, "labels")
    sides = [texts.select(F.col("label").alias("text")), aliases.select(F.col("alias").alias("text"))]
    keys = keyed_join.with_counts(_keys(name, low), sides)
    shared = cut_lineage(_token_join(texts.where("label <> ''"), aliases, name, low, keys), "shared")
    perfect = shared.where("score >= 100").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("label")
    done = cut_lineage(perfect, "done")
    left = cut_lineage(keyed_join.by_shuffle(texts, done, "label", "left_anti"), "left")
    if floor is not None and floor >= max(EDIT_FLOOR, low if name == "weighted_ratio" else 0.0):
        more = _edit_join(left.where("label <> ''"), aliases, name, floor, keys)
        return _top_of(shared.union(more).distinct(), k)
    rest = _grid(left, aliases, k, scorer, floor, name == "weighted_ratio")
    return _top_of(keyed_join.by_shuffle(shared, done, "label", "left_semi").union(rest), k)


def _attach(df: DataFrame, best: DataFrame, text: str) -> DataFrame:
    """Bring per-label results back to the rows; a label that many rows share comes by broadcast."""
    return attach(df, cut_lineage(best, "best").withColumnRenamed("label", text), text, cut_lineage(text_counts(df, text), "texts"))


# ------------------------------------------------------------------ operators

def _with_candidates(df: DataFrame, gaz: DataFrame, label: str, k: int, min_score: float, max_shipped: int) -> DataFrame:
    """Add ``_top``: up to k candidate structs by token set score."""
    aliases = merchant_aliases(gaz)
    listed = _shipped(aliases, max_shipped)
    queried = df.withColumn("_query", normalize_merchant_text(label))

    def scorer(a, b):
        return similarity.token_set_ratio(a, b, floor=min_score)

    if listed is not None:
        top = _top_in_task(listed, k, scorer, keep_below=min_score)
        return queried.withColumn("_top", top(F.col("_query"))).drop("_query")
    if df.isStreaming:
        return _best_of_blocks(queried, "_query", aliases, k, scorer, min_score, False, BLOCK).drop("_query")
    labels = queried.select(F.col("_query").alias("label")).where("label <> ''").distinct()
    return _attach(queried, _joined_top(labels, aliases, k, "token_set", scorer, min_score), "_query").drop("_query")


def merchant_candidates(df: DataFrame, gaz: DataFrame, k: int = 5, label: str = "raw_label",
                        min_score: float = 0.0, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """One row per candidate: rank, merchant_id, display_name, alias_norm, score (whole number).

    A ``min_score`` below ``EDIT_FLOOR`` makes any alias a candidate of labels that do not find ``k`` of score 100, whose work
    then grows with labels times aliases; the answer is the same for gazetteers of all sizes.
    """
    top = _with_candidates(df, gaz, label, k, min_score, max_shipped)
    rows = top.select(*df.columns, F.posexplode("_top").alias("_pos", "_c"))
    return rows.select(
        *df.columns, (F.col("_pos") + 1).cast("bigint").alias("rank"),
        "_c.merchant_id", "_c.display_name", F.col("_c.alias").alias("alias_norm"),
        F.col("_c.score").cast("bigint").alias("score"),
    )


def best_merchant(df: DataFrame, gaz: DataFrame, threshold: int = 86, label: str = "raw_label",
                  max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Add merchant_id, display_name, alias_norm, score of the best candidate, or nulls."""
    top = _with_candidates(df, gaz, label, 1, float(threshold), max_shipped)
    best = F.get("_top", F.lit(0))
    return top.withColumn("_b", best).select(
        *df.columns, "_b.merchant_id", "_b.display_name", F.col("_b.alias").alias("alias_norm"),
        F.col("_b.score").cast("bigint").alias("score"),
    )


def normalize_merchant(df: DataFrame, gaz: DataFrame, threshold: int = 86, label: str = "raw_label",
                       max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Add display_name, merchant_id and score, or nulls."""
    return best_merchant(df, gaz, threshold, label, max_shipped).drop("alias_norm")


def merchant_accuracy(pairs: DataFrame, gaz: DataFrame, threshold: int = 86, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Accuracy@1 of ``best_merchant`` over (raw_label, merchant_id) pairs, 0.0 if empty."""
    truth = pairs.select("raw_label", F.col("merchant_id").cast("string").alias("_truth"))
    right = F.count_if(F.coalesce(F.col("merchant_id") == F.col("_truth"), F.lit(False)))
    total = F.count(F.lit(1))
    return best_merchant(truth, gaz, threshold, max_shipped=max_shipped).agg(
        F.coalesce(right / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("accuracy"),
        right.alias("correct"), total.alias("total"),
    )


def resolve_merchant(df: DataFrame, gaz: DataFrame, cut: float = 0.90, text: str = "normalized",
                     explain_weak: bool = False, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """Add gaz_merchant_id, gaz_display, gaz_score (0..1) and gaz_reason of the best alias.

    Below the cut merchant and display are null. ``explain_weak`` also names
    the best alias of such rows; without it they carry no score. With it, or with a cut
    below 0.90, any alias may be the best, so work grows with labels times aliases. A
    null text gets nulls.
    """
    aliases = plain_aliases(gaz)
    listed = _shipped(aliases, max_shipped)
    query = df.withColumn("_query", F.lower(text))
    if listed is not None and listed.empty:
        return df.withColumns({
            "gaz_merchant_id": F.lit(None).cast("string"), "gaz_display": F.lit(None).cast("string"),
            "gaz_score": F.when(F.col(text).isNotNull(), F.lit(0.0)),
            "gaz_reason": F.when(F.col(text).isNotNull(), F.lit("gazetteer-empty")),
        })
    only_accepted = cut >= _TOKEN_FLOOR["weighted_ratio"] / 100 and not explain_weak
    scorer = similarity.accepted_weighted_ratio if only_accepted else similarity.weighted_ratio
    floor = None if explain_weak else 100.0 * cut - 1e-9
    labels = query.select(F.col("_query").alias("label")).where("label IS NOT NULL").distinct()
    if listed is not None:
        top = _top_in_task(listed, 1, scorer, floor, weighted=True)
        if only_accepted or df.isStreaming:
            found = query.withColumn("_best", F.get(top(F.col("_query")), F.lit(0)))
        else:  # without a high cut a label costs much more to score than to move: each distinct one is scored once
            counts = cut_lineage(text_counts(query, "_query"), "texts")
            tasks = max(query.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // TASK_LABELS))
            texts = counts.where("_text IS NOT NULL").select(F.col("_text").alias("_query")).repartition(tasks)
            best = cut_lineage(texts.select("_query", F.get(top(F.col("_query")), F.lit(0)).alias("_best")), "best")
            found = attach(query, best, "_query", counts)
    elif df.isStreaming:
        blocks = _best_of_blocks(query, "_query", aliases, 1, scorer, floor, True, BLOCK)
        found = blocks.withColumn("_best", F.get("_top", F.lit(0)))
    else:
        best = _joined_top(labels.where("label <> ''") if only_accepted else labels, aliases, 1, "weighted_ratio", scorer, floor)
        found = _attach(query, best.select("label", F.get("_top", F.lit(0)).alias("_best")), "_query")
    score = F.col("_best.score") / 100.0
    accepted = score >= cut
    shown = F.concat(F.col("_best.alias"), F.lit("|score:"), fixed_point(score, 2))
    return found.select(
        *df.columns,
        F.when(accepted, F.col("_best.merchant_id")).alias("gaz_merchant_id"),
        F.when(accepted, F.col("_best.display_name")).alias("gaz_display"),
        score.alias("gaz_score"),
        F.when(accepted, F.concat(F.lit("alias:"), shown))
        .when(F.col("_best").isNotNull(), F.concat(F.lit("weak-alias:"), shown)).alias("gaz_reason"),
    )
