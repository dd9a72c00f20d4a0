"""Keys by which texts that may be alike meet in an equi-join, as few as lose no pair.

All keys have one order: rare ones first, by counts over both sides. A side emits all keys of a kind, or a
prefix: just so many of its rarest keys that a partner that is alike enough must hold one of them.

* tokens: what a text lacks of a partner's tokens may only be so long if shared tokens are to decide the score,
  so the rarest tokens beyond that length are a prefix, which meets all tokens of the other side;
* trigrams: an Indel score s leaves a share of both lengths to edits, a missing letter breaks three trigrams and an
  added one two; of two sets that have to share that much, the prefixes meet;
* containment: the rarest piece of the shorter text is among all of the longer one's. Pieces have 16 letters, in short texts
  fewer, as a trigram would be in a fixed share of all texts and its pairs grow with their square.

Keys are 64-bit hashes; two keys of one hash only add a pair, which is scored like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktally.session import cut_lineage

#: A key in more texts than this has its count looked up; all others count as equally rare.
FREQUENT = 20
#: Frequent keys that travel with the functions: the most frequent ones.
MOST_FREQUENT = 50_000
#: Floor from which trigram prefixes leave out a good part of the trigrams.
EDIT_FLOOR = 85.0
_DEGENERATE = "x"
#: Lengths of the pieces by which a text is found inside longer ones.
PIECES = (3, 8, 16)


def _hash(key: str) -> int:
    value = xxhash.xxh64_intdigest(key)
    return value - (1 << 64) if value >> 63 else value


def tokens_of(text: str) -> list[str]:
    return sorted(set(t for t in text.split(" ") if t))


def grams_of(text: str, kind: str) -> tuple[list[str], int]:
    """(distinct trigrams, length that edits count on). Kinds: r raw text, o tokens in order, d distinct tokens in any order."""
    if kind == "d":
        tokens = tokens_of(text)
        return sorted({f" {t} "[i:i + 3] for t in tokens for i in range(len(t))}), sum(map(len, tokens)) + max(len(tokens) - 1, 0)
    if kind == "o":
        text = " ".join(sorted(t for t in text.split(" ") if t))
    padded = f"\x02\x02{text}\x03\x03"
    return sorted({padded[i:i + 3] for i in range(len(padded) - 2)}), len(text)


def pieces_of(text: str) -> tuple[list[str], list[str]]:
    """(own keys as the shorter text, of which the rarest will do; keys of all texts up to 8 times shorter that may lie in it).

    A text goes by pieces of one length, the longest of ``PIECES`` that it holds: the longer a piece, the fewer texts share it.
    """
    size, n = max((s for s in PIECES if s <= len(text)), default=0), len(text)
    own = [text[i:i + size] for i in range(n - size + 1)] if size else ["s" + text]
    held = []
    for s, longest in zip(PIECES, [*(x - 1 for x in PIECES[1:]), n]):  # of texts of s to ``longest`` letters
        if s <= n <= 8 * longest:
            held += [text[i:i + s] for i in range(n - s + 1)]
    if n <= 8 * (PIECES[0] - 1):
        held += ["s" + text[i:i + k] for k in range(1, PIECES[0]) for i in range(n - k + 1)]
    return own, held


class Keys:
    """Keys of texts for a floor; ``counts`` are those of the frequent keys."""

    def __init__(self, floor: float, grams: dict[str, float], contained: bool, counts: dict[int, int] | None = None, met: set[int] | None = None):
        self.share = (100.0 - floor) / 100.0 + 1e-9
        self.grams, self.contained, self.counts = grams, contained, counts or {}
        #: Frequent keys that some prefix holds; other frequent ones need not be emitted.
        self.met = met

    def _order(self, keys) -> list[int]:
        return sorted({_hash(k) for k in keys}, key=lambda h: (self.counts.get(h, 0), h))

    def all(self, text: str) -> list[int]:
        """Whole side: tokens, and the pieces that shorter texts may be."""
        keys = {_hash("t" + t) for t in tokens_of(text)}
        if self.contained:
            keys |= {_hash("c" + p) for p in pieces_of(text)[1]}
        return [k for k in keys if self.met is None or k not in self.counts or k in self.met]

    def prefix(self, text: str) -> list[int]:
        """Rarest tokens longer than what may be lacking, and the rarest piece."""
        tokens = {_hash("t" + t): len(t) for t in tokens_of(text)}
        out: list[int] = []
        whole = sum(tokens.values()) + len(tokens) - 1
        lacking, length = (self.share * (2 * whole - 1) - 1) / (1 + self.share), -1
        for key in sorted(tokens, key=lambda h: (self.counts.get(h, 0), h)):
            out.append(key)
            length += tokens[key] + 1
            if length > lacking + 1e-9:
                break
        if self.contained and text:
            out.append(self._order("c" + p for p in pieces_of(text)[0])[0])
        return out

    def edits(self, text: str) -> list[int]:
        """Trigram prefixes of all kinds; texts with too few trigrams emit all, and one key more."""
        out: set[int] = set()
        for kind, floor in self.grams.items():
            share = (100.0 - floor) / 100.0 + 1e-9
            grams, length = grams_of(text, kind)
            broken = max(6 * share / (1 + share), 4 * share / (1 - share)) * length + 1e-9
            keys = self._order(kind + g for g in grams)
            out.update(keys[:int(broken) + 1])
            if broken >= len(keys):
                out.add(_hash(_DEGENERATE + kind))
        return sorted(out)

    def every(self, text: str) -> list[int]:
        """All that may be emitted, for counting."""
        keys = {_hash("t" + t) for t in tokens_of(text)}
        if self.contained:
            keys |= {_hash("c" + p) for p in [*pieces_of(text)[0], *pieces_of(text)[1]]}
        return sorted(keys | {_hash(kind + g) for kind in self.grams for g in grams_of(text, kind)[0]})


def _listed(df: DataFrame, text: str, keys: Keys, what: str, name: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(keys)

    @F.pandas_udf("array<bigint>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = getattr(shared.value, what)
        for texts in parts:
            yield texts.map(lambda t: make(t or ""))

    return df.withColumn(name, of.asNondeterministic()(F.col(text)))


def with_counts(keys: Keys, sides: list[DataFrame], text: str = "text") -> Keys:
    """``keys`` in order of how many texts of both sides hold each."""
    each = None
    for side in sides:
        found = _listed(side.select(text), text, keys, "every", "_k").select(F.explode("_k").alias("key"))
        each = found if each is None else each.union(found)
    frequent = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT)
    # written first: collected as it is, every task would send its own MOST_FREQUENT rows to the driver
    rows = cut_lineage(frequent.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT), "frequent").collect()
    return Keys(100.0 - 100.0 * (keys.share - 1e-9), keys.grams, keys.contained, {r["key"]: r["n"] for r in rows})


def _exploded(df: DataFrame, text: str, keys: Keys, what: str) -> DataFrame:
    return _listed(df, text, keys, what, "_keys").withColumn("key", F.explode("_keys")).drop("_keys")


def by_shuffle(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input.

    Spark takes a side's size from its file, which knows neither of its compression nor of rows exploded since, so a
    whole side could be broadcast through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def token_pairs(left: DataFrame, right: DataFrame, left_text: str, right_text: str, keys: Keys) -> DataFrame:
    """All columns of both sides for pairs that a prefix of one and the keys of the other bring together; may repeat pairs.

    A key that most of one side holds meets the few rows of the other whose prefix it is; Spark splits it as it
    splits any skewed side of a join.
    """
    prefixes = [_exploded(left, left_text, keys, "prefix"), _exploded(right, right_text, keys, "prefix")]
    frequent = prefixes[0].select("key").union(prefixes[1].select("key")).distinct()
    spark = left.sparkSession
    shared = spark.sparkContext.broadcast(set(keys.counts))

    @F.pandas_udf("boolean")
    def is_frequent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.isin(shared.value)

    met = {r["key"] for r in frequent.where(is_frequent.asNondeterministic()(F.col("key"))).collect()}  # at most MOST_FREQUENT
    full = Keys(100.0 - 100.0 * (keys.share - 1e-9), keys.grams, keys.contained, keys.counts, met)
    one = by_shuffle(prefixes[0], _exploded(right, right_text, full, "all"), "key")
    two = by_shuffle(_exploded(left, left_text, full, "all"), prefixes[1], "key")
    columns = [c for c in one.columns if c != "key"]
    return one.select(columns).union(two.select(columns))


def edit_pairs(left: DataFrame, right: DataFrame, left_text: str, right_text: str, keys: Keys) -> DataFrame:
    """All columns of both sides for pairs whose trigram prefixes meet and whose lengths allow a score; each pair once.

    A pair meets at every key that it shares, and is kept at the smallest.
    """
    a = _listed(left, left_text, keys, "edits", "_a").withColumn("key", F.explode("_a"))
    b = _listed(right, right_text, keys, "edits", "_b").withColumn("key", F.explode("_b"))
    joined = by_shuffle(a, b, "key").where(F.col("key") == F.array_min(F.array_intersect("_a", "_b")))
    return joined.drop("key", "_a", "_b")
