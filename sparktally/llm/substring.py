"""Passages that repeat across documents: MinHash banding of paragraphs, then exact spans.

Passages can begin anywhere in a line, so a paragraph is not a line: it is the 20
words from an anchor, and anchors are chosen by content (the least three-word hash of
every 31 in a row). Two copies of a passage of 50 words or more choose the same anchor
inside it, whatever stands around them.

Paragraphs that share a MinHash band meet; each is paired with the first of them in
order of (document, word). That one may be an unlike or a shorter copy, so the runs of 50
words around paragraphs that have met others meet again by the hash of all their words:
equality is transitive, so the first of equal runs is partner enough, and every
shared run of 50 words is found whatever the bands' first members are. Equal paragraphs
between equal words are one class, which one member stands for.

Where a pair met, the texts are laid side by side at that distance: equal runs of five words and more are put
together over changed words as long as the exact Jaccard similarity of the five-word shingles of the whole
is high enough, and spans a few words apart become one if that is alike enough. So a changed, added or missing word
does not end a passage, and the paragraph in which it met need not be alike itself. Components of the confirmed
pairs are the clusters; the first place of a cluster stays. Every removed word thus lies in a span of
20 words and more that is equal or alike to one at a smaller place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktally.llm.arrow import discard, few, plain, schema_of, stored
from sparktally.llm.components import components
from sparktally.llm.words import SPACE, Words, mix, shingles, slices, text_bytes, words_of

PARAGRAPH = 20
WINDOW = 31
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 3, 2  # equal paragraphs share all; with one changed word (0.52) one with probability 0.61, and a passage has several
MIN_WORDS = 50
#: Words between two equal runs that may be one passage.
GAP = 12
#: Rows of lists (places or spans of a document) that may be broadcast.
MOST_LISTS = 500_000
RUN = WINDOW - 1 + PARAGRAPH  # words of a run that holds the anchor it chooses and all of its paragraph
_SALT = np.uint64(0xA0761D6478BD642F)


def _chosen(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers where windows begin, the word each chooses (least three-word hash of WINDOW, last of equals), row ends by word."""
    n = len(found.hashes)
    ends = np.repeat(found.first[1:], np.diff(found.first))  # of each word's row
    if n < WINDOW + 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), ends
    h = found.hashes
    grams = mix(h[:-2] * _SALT + mix(h[1:-1]) * np.uint64(3) + mix(h[2:] ^ _SALT))
    number = np.arange(n - 2, dtype=np.uint64)
    # the low bits tell the place, up to a multiple that the window knows
    least = (grams & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - (number & np.uint64(0xFFFFFF)))
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[:len(least) - (WINDOW - width)], least[WINDOW - width:])
    inside = np.arange(len(least)) + WINDOW + 2 <= ends[:len(least)]
    begin = np.flatnonzero(inside)
    place = (np.uint64(0xFFFFFF) - (least[begin] & np.uint64(0xFFFFFF))).astype(np.int64)
    return begin, begin + (place - begin & 0xFFFFFF), ends


def anchors(found: Words) -> np.ndarray:
    """Word numbers where paragraphs begin: what the windows choose, if a paragraph fits."""
    _, chosen, ends = _chosen(found)
    at = np.unique(chosen)
    return at[at + PARAGRAPH <= ends[at]]


def _wanted(found: Words, wanted: pa.Array) -> np.ndarray:
    """Word numbers of each row's ``wanted`` words, those where a paragraph fits."""
    row = np.repeat(np.arange(len(wanted)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
    place = found.first[row] + wanted.flatten().to_numpy(zero_copy_only=False)
    return np.unique(place[place + PARAGRAPH <= found.first[row + 1]])


def runs(found: Words, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all runs of RUN words whose anchor is one of the row's ``wanted`` words, and (runs, 1) keys of all their words."""
    begin, chosen, ends = _chosen(found)
    marked = np.zeros(len(found.hashes), bool)
    marked[_wanted(found, wanted)] = True
    at = begin[marked[chosen] & (begin + RUN <= ends[begin])]
    return at, _run_hashes(found.hashes, RUN)[at][:, None] if len(at) else np.zeros((0, 1), np.uint64)


def contexts(found: Words, at: np.ndarray) -> np.ndarray:
    """Hash of each paragraph with all words that a run of RUN words around it may have; where the row ends counts."""
    row = np.searchsorted(found.first, at, "right") - 1
    out = np.zeros(len(at), np.uint64)
    for j in range(PARAGRAPH - RUN, RUN):
        here = at + j
        inside = (here >= found.first[row]) & (here < found.first[row + 1])
        out = out * _SALT + np.where(inside, found.hashes[np.where(inside, here, at)], np.uint64(0))
    return mix(out)


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of n words in a row, put together from runs of 1, 2, 4, ... words."""
    out, done, piece, width = np.zeros(len(h) - n + 1, np.uint64), 0, h, 1
    while True:
        times = np.uint64(pow(int(_SALT), width, 2**64))
        if n & width:
            out = out * times + piece[done:done + len(out)]
            done += width
        if 2 * width > n:
            return mix(out)
        piece = piece[:-width] * times + piece[width:]
        width *= 2


def paragraph_bands(found: Words, at: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) band keys from the shingles inside each paragraph."""
    per = PARAGRAPH - SHINGLE + 1
    h = found.hashes
    rolled = h[:len(h) - SHINGLE + 1].copy()
    for j in range(1, SHINGLE):
        rolled = rolled * _SALT + h[j:len(h) - SHINGLE + 1 + j]
    inside = mix(rolled)[at[:, None] + np.arange(per)[None, :]]
    keys = np.empty((len(at), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, np.uint64)
        for row in range(ROWS):
            seed = mix(np.array([band * ROWS + row + 1], np.uint64))[0]
            key = mix(key ^ mix(inside ^ seed).min(axis=1))
        keys[:, band] = key
    return keys


def _paragraphs(part: pa.RecordBatch, found: Words) -> tuple[np.ndarray, np.ndarray]:
    at = anchors(found)
    return at, paragraph_bands(found, at) if len(at) else np.zeros((0, BANDS), np.uint64)


def _runs(part: pa.RecordBatch, found: Words) -> tuple[np.ndarray, np.ndarray]:
    return runs(found, part.column(2))


def _entries(docs: DataFrame, places: Callable[[pa.RecordBatch, Words], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(group, doc_id, words, head_id, head_word, shared) per place and key; the first columns are doc_id and text.

    ``shared`` is given for the first key alone: whether another document of the slice has it.

    Of equal keys in one slice only the first meets the other slices, under its key; those
    of other documents are linked to it at once and travel under a group of their own.
    Repeats inside the first's document share its row, in ``words``, and so its partner.
    However many copies a passage has, its key gets at most one row per slice.
    """
    id_type = docs.schema["doc_id"].dataType
    schema, arrow = schema_of(docs, "doc_id", words=T.ArrayType(T.IntegerType()), group=T.LongType(), head_id=id_type,
                              head_word=T.IntegerType(), shared=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if batch.num_rows:
                batch = batch.take(pc.sort_indices(batch.column(0)))
            for part in slices(batch, "text"):
                found = words_of(part.column(1), SPACE)
                at, keys = places(part, found)
                if not len(at):
                    continue
                ids = part.column(0)
                doc = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                row = np.searchsorted(found.first, at, "right") - 1
                word = (at - found.first[row]).astype(np.int32)
                flat = keys.T.reshape(-1)  # places in order, key by key
                paragraph = np.tile(np.arange(len(at)), keys.shape[1])
                _, first, back = np.unique(flat, return_index=True, return_inverse=True)
                head = first[back]
                same = doc[row[paragraph]] == doc[row[paragraph[head]]]
                owner = np.where(same, head, np.arange(len(flat)))  # the entry in whose row this one travels
                by_owner = np.argsort(owner, kind="stable")
                kept, begin = np.unique(owner[by_owner], return_index=True)
                mine, other, alone = paragraph[kept], paragraph[head[kept]], same[kept]
                shared = ~alone
                shared[np.searchsorted(kept, head[kept[shared]])] = True
                group = np.where(alone, flat[kept], mix(flat[kept] ^ mix(kept.astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row[mine])),
                    pa.ListArray.from_arrays(pa.array(np.append(begin, len(owner)).astype(np.int32)),
                                             pa.array(word[paragraph[by_owner]])),
                    pa.array(group.view(np.int64)),
                    ids.take(pa.array(row[other], mask=alone)), pa.array(word[other], mask=alone),
                    pa.array(shared, mask=kept >= len(at)),
                ], schema=arrow)

    return docs.mapInArrow(run, schema)


def _met(entries: DataFrame, name: str) -> DataFrame:
    """Entries whose group another document is in, with the group's first place, and ``shared`` set for the first key."""
    group = "OVER (PARTITION BY `group`)"
    both = entries.withColumn("least", F.expr(f"min(struct(doc_id, words[0] AS word)) {group}")).withColumn(
        "most", F.expr(f"max(doc_id) {group}"))
    many = F.expr("least.doc_id != most")
    return stored(both.where(many | F.col("head_id").isNotNull() | F.col("shared")).select(
        "doc_id", "words", "head_id", "head_word", "least", F.col("shared").isNotNull().alias("shared")), name)


def _links(met: DataFrame) -> DataFrame:
    """(doc_id, word, head_id, head_word): every place with the first of its group, if that is in another document."""
    return met.select(
        "doc_id", F.explode("words").alias("word"), F.coalesce("head_id", "least.doc_id").alias("head_id"),
        F.when(F.col("head_id").isNull(), F.col("least.word")).otherwise(F.col("head_word")).alias("head_word"),
    ).where("doc_id != head_id")


def _pairs(links: DataFrame) -> DataFrame:
    """(doc_id, head_id, places): both words of each link in one number, as many as the document has places at most."""
    both = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.col("head_word").cast("long"))
    return links.groupBy("doc_id", "head_id").agg(F.collect_list(both).alias("places"))


def _classes(docs: DataFrame) -> DataFrame:
    """(paragraph, context, doc_id, word) of the wanted places of ``docs`` (doc_id, text, wanted)."""
    schema, arrow = schema_of(docs, "doc_id", word=T.IntegerType(), paragraph=T.LongType(), context=T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words_of(part.column(1), SPACE)
                at = _wanted(found, part.column(2))
                if not len(at):
                    continue
                row = np.searchsorted(found.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row)), pa.array((at - found.first[row]).astype(np.int32)),
                    pa.array(_run_hashes(found.hashes, PARAGRAPH)[at].view(np.int64)),
                    pa.array(contexts(found, at).view(np.int64))], schema=arrow)

    return docs.mapInArrow(run, schema)


def _equal_runs(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (as of ``_links``) by which every run of RUN words around a wanted place meets the first equal one.

    A class (equal paragraphs, equal words around) is paired with its first place, and that with the
    paragraph's. This is all where a paragraph has two classes; of three or more, the first places'
    runs meet by the hash of all their words.
    """
    places = stored(_classes(texts.join(few(wanted, MOST_LISTS), "doc_id").select("doc_id", "text", "wanted")), "places")
    place = F.struct("doc_id", "word")
    classes = stored(places.groupBy("paragraph", "context").agg(F.min(place).alias("rep")), "classes")
    firsts = stored(classes.groupBy("paragraph").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    inside = places.join(classes, ["paragraph", "context"]).select("doc_id", "word", F.col("rep").alias("head"))
    across = classes.join(firsts, "paragraph").select("rep.doc_id", "rep.word", F.col("first").alias("head"))
    links = stored(inside.union(across).where("doc_id != head.doc_id").select(
        "doc_id", "word", F.col("head.doc_id").alias("head_id"), F.col("head.word").alias("head_word")), "links")
    several = stored(classes.join(firsts.where("n > 2"), "paragraph", "left_semi").groupBy(F.col("rep.doc_id").alias("doc_id")).agg(
        F.collect_set("rep.word").alias("wanted")), "several")
    discard(places, classes, firsts)
    around = texts.join(few(several, MOST_LISTS), "doc_id").select("doc_id", "text", "wanted")
    runs = _met(_entries(around, _runs), "runs")
    out = links.union(_links(runs))
    out.scratch = [*links.scratch, *several.scratch, *runs.scratch]
    return out


class Text:
    """Words of a text with the hashes of the SHINGLE words from each."""

    __slots__ = ("words", "grams")

    def __init__(self, words: np.ndarray, grams: np.ndarray | None = None):
        self.words = words
        self.grams = _run_hashes(words, SHINGLE) if grams is None and len(words) >= SHINGLE else words[:0] if grams is None else grams

    def back(self) -> "Text":
        """Backwards; the hashes are of the same words, found from their last."""
        return Text(self.words[::-1], self.grams[::-1])


def _in_common(a: Text, b: Text, span: tuple[int, int, int, int]) -> tuple[int, int]:
    """Distinct shingles that a's and b's part of the span share, and that either has."""
    s, e, t, f = span
    one, two = np.unique(a.grams[s:e - SHINGLE + 1]), np.unique(b.grams[t:f - SHINGLE + 1])
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both, len(one) + len(two) - both


def _alike(a: Text, b: Text, span: tuple[int, int, int, int], similarity: float) -> bool:
    """Whether the exact Jaccard similarity of the span's shingles is high enough."""
    both, either = _in_common(a, b, span)
    return both >= similarity * either


def _runs_around(a: np.ndarray, b: np.ndarray, seed: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends in a of the equal runs of SHINGLE words and more around ``seed``, no two further apart than GAP."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    reach = 256
    while True:
        lo, hi = max(low, seed - reach), min(high, seed + PARAGRAPH + reach)
        same = np.zeros(hi - lo + 2, np.int8)
        same[1:-1] = a[lo:hi] == b[lo - shift:hi - shift]
        edge = np.flatnonzero(np.diff(same))
        begins, ends = edge[::2] + lo, edge[1::2] + lo
        wide = ends - begins >= SHINGLE
        begins, ends = begins[wide], ends[wide]
        if not len(begins):
            return begins, ends
        part = np.concatenate([[0], np.cumsum(begins[1:] - ends[:-1] > GAP)])
        at = int(np.searchsorted(begins, seed, "right")) - 1
        if at < 0 or ends[at] <= seed:  # no equal run where the pair met
            at = min(at + 1, len(begins) - 1)
        mine = part == part[at]
        begins, ends = begins[mine], ends[mine]
        # more may follow where the runs come close to the edge of what was looked at
        if (lo == low or begins[0] - lo > GAP + SHINGLE) and (hi == high or hi - ends[-1] > GAP + SHINGLE):
            return begins, ends
        reach *= 4


def _regions(a: Text, b: Text, seed: int, shift: int, similarity: float) -> list[tuple[int, int]]:
    """Words of a around ``seed`` that are alike to b's at the same distance from ``seed - shift``.

    Equal runs are put together over changed words as long as the whole is alike enough; where it is not, it is
    parted at its widest gap.
    """
    begins, ends = _runs_around(a.words, b.words, seed, shift)
    shared = np.concatenate([[0], np.cumsum(ends - begins - SHINGLE + 1)])
    out, todo = [], [(0, len(begins))] if len(begins) else []
    while todo:
        x, y = todo.pop()
        s, e = int(begins[x]), int(ends[y - 1])
        both, whole = int(shared[y] - shared[x]), e - s - SHINGLE + 1
        if y - x == 1 or (both >= similarity * (2 * whole - both) and _alike(a, b, (s, e, s - shift, e - shift), similarity)):
            out.append((s, e))
        else:
            cut = x + 1 + int(np.argmax(begins[x + 1:y] - ends[x:y - 1]))
            todo += [(x, cut), (cut, y)]
    return sorted(out)


def _behind(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """Where two texts run together again: the nearest words of each that begin SHINGLE equal ones; from their shingles' hashes."""
    one, two = a[:GAP + 1], b[:GAP + 1]
    if not len(one) or not len(two):
        return None
    same = np.argwhere(one[:, None] == two[None, :])
    return tuple(same[same.sum(axis=1).argmin()].tolist()) if len(same) else None


def _carried_on(a: Text, b: Text, span: tuple[int, int, int, int], similarity: float) -> tuple[int, int, int, int]:
    """``span`` (start and end in a, start and end in b) carried on at its end over added or missing words."""
    s, e, t, f = span
    both = None
    while (place := _behind(a.grams[e:], b.grams[f:])) is not None:
        i, j = e + place[0], f + place[1]
        if i - j == e - f:  # changed words, which ``_regions`` has judged
            break
        begins, ends = _runs_around(a.words, b.words, i, i - j)
        end = int(ends[int(np.searchsorted(begins, i, "right")) - 1])  # of the equal run; the next round goes on behind it
        if both is None:
            both = _in_common(a, b, span)[0]
        more = both + end - i - SHINGLE + 1
        if more < similarity * (end - s + end - i + j - t - 2 * SHINGLE + 2 - more):
            break
        both, e, f = more, end, end - i + j
    # the count above takes repeated shingles for different ones
    return (s, e, t, f) if both is None or _alike(a, b, (s, e, t, f), similarity) else span


def align(a: Text, b: Text, pairs: list[tuple[int, int]], similarity: float) -> list[tuple[int, int, int, int]]:
    """(start, end, word, other word) of a's spans of PARAGRAPH words and more that are alike to b's.

    ``pairs`` are words of both where paragraphs met, the last two of the result the first such pair of the span.
    Words may be changed inside a span (``_regions``), added or missing, as long as the whole is alike enough.
    """
    out: list[tuple[int, int, int, int]] = []
    reach: dict[int, int] = {}  # end of what was looked at, by the distance of the two places
    done = 0  # end of the words that long spans cover from the last seed's on
    for i, j in sorted(pairs):
        shift = i - j
        if i + PARAGRAPH <= done or i >= len(a.words) or j >= len(b.words) or i < reach.get(shift, 0):
            continue  # the words have an equal or alike place already
        for s, e in _regions(a, b, i, shift, similarity):
            reach[shift] = max(reach.get(shift, 0), e)
            if e - s < PARAGRAPH:
                continue
            s, e, t, f = _carried_on(a, b, (s, e, s - shift, e - shift), similarity)
            n, m = len(a.words), len(b.words)
            back = _carried_on(a.back(), b.back(), (n - e, n - s, m - f, m - t), similarity)
            s = n - back[1]
            out.append((s, e, i, j))
            if s <= max(done, i) and e - s >= RUN:
                done = max(done, e)
    return out


def _spans(pairs: DataFrame, id_type: T.DataType, similarity: float) -> DataFrame:
    """Spans of each pair of documents, in words and code points."""
    fields = [T.StructField("doc_id", id_type), T.StructField("text_hash", T.LongType())]
    fields += [T.StructField(n, T.LongType()) for n in ("from_word", "to_word", "start", "end", "word")]
    fields += [T.StructField("head_id", id_type), T.StructField("head_word", T.LongType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                cols = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                mine, its = words_of(cols["text"]), words_of(cols["head_text"])
                grams, head_grams = (_run_hashes(w.hashes, SHINGLE) if len(w.hashes) >= SHINGLE else w.hashes[:0] for w in (mine, its))
                chars = np.concatenate([[0], np.cumsum((mine.data & 0xC0) != 0x80)])
                _, offsets = text_bytes(cols["text"])
                counts = pc.list_value_length(cols["places"]).to_numpy(zero_copy_only=False)
                both = cols["places"].flatten().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(counts)])
                found = []
                for r in range(part.num_rows):
                    met = np.unique(both[at[r]:at[r + 1]])
                    base, stop = mine.first[r], mine.first[r + 1]
                    first, last = its.first[r], its.first[r + 1]
                    one = Text(mine.hashes[base:stop], grams[base:max(base, stop - SHINGLE + 1)])
                    two = Text(its.hashes[first:last], head_grams[first:max(first, last - SHINGLE + 1)])
                    for a, b, i, j in align(one, two, list(zip((met >> 32).tolist(), (met & 0xFFFFFFFF).tolist())), similarity):
                        end = mine.starts[base + b] if base + b < stop else offsets[r + 1]
                        found.append((r, a, b, chars[mine.starts[base + a]] - chars[offsets[r]], chars[end] - chars[offsets[r]], i, j))
                r, a, b, start, end, i, j = (pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 7))
                yield pa.RecordBatch.from_arrays([
                    cols["doc_id"].take(r), cols["text_hash"].take(r), a, b, start, end, i, cols["head_id"].take(r), j], schema=arrow)

    return pairs.select("doc_id", "text_hash", "text", "head_id", "head_text", "places").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage to remove: doc_id, text_hash, start, end, n_words, kept_doc_id, kept_word.

    start and end are code points of the text, the white space behind the passage
    included; kept_doc_id and kept_word tell the first place of its cluster, which stays.
    Passages shorter than ``min_words`` and repeats inside one document are left alone.
    Null and empty texts have none. Rows with equal doc_id count as one document, so
    repeated rows are not removed for each other; text_hash tells which text a span is for.
    Rows without a doc_id are left alone. An empty table gives no rows; extra columns are
    ignored. Runs jobs and writes to the shared folder while it is being planned.
    """
    src = plain(docs, doc_id, text).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    id_type = src.schema["doc_id"].dataType
    met = _met(_entries(src, _paragraphs), "met")
    banded = stored(_links(met), "banded")
    named = few(stored(banded.select("doc_id").union(banded.select("head_id")).distinct(), "named"))
    texts = stored(src.join(named, "doc_id", "left_semi").withColumn("text_hash", F.xxhash64("text")), "texts")
    counts = texts.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if counts[0] > counts[1]:  # whole texts move to find equal rows only where an id repeats
        rows, texts = texts, stored(texts.distinct(), "texts")
        discard(rows)
    # equal paragraphs share all bands, so the first band shows all that equal others
    wanted = stored(met.where("shared").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("wanted")), "wanted")
    discard(met, named)
    equal = _equal_runs(texts, wanted)
    pairs = stored(_pairs(banded.union(equal)), "pairs")
    discard(banded, wanted, equal)
    # texts go only to the sides of the pairs that name them
    ids, head_ids = (stored(pairs.select(F.col(c).alias("doc_id")).distinct(), c) for c in ("doc_id", "head_id"))
    head_texts = texts.join(few(head_ids), "doc_id", "left_semi").select(F.col("doc_id").alias("head_id"), F.col("text").alias("head_text"))
    joined = pairs.join(texts.join(few(ids), "doc_id", "left_semi"), "doc_id").join(head_texts, "head_id")
    spans = stored(_spans(joined, id_type, similarity).withColumns({
        "a": F.xxhash64("doc_id", "word"), "b": F.xxhash64("head_id", "head_word")}), "spans")
    discard(pairs, texts, ids, head_ids)

    # places are linked by their hashes; the first place of a cluster is the other end of one of its links
    clusters = components(spans, "a", "b")
    marked = stored(spans.join(clusters, spans["a"] == clusters["node"]).drop("a", "b", "node"), "marked")
    discard(spans, clusters)
    first = marked.groupBy("component").agg(F.min(F.struct(F.col("head_id").alias("doc_id"), F.col("head_word").alias("word"))).alias("kept"))
    out = stored(_merged(marked.join(stored(first, "first"), "component"), min_words), "passages")
    discard(marked, first)
    return out


def _merged(spans: DataFrame, min_words: int) -> DataFrame:
    """Overlapping or touching spans of a document as one, if long enough."""
    touching = F.expr(
        "coalesce(max(to_word) OVER (PARTITION BY doc_id, text_hash ORDER BY from_word, to_word "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= from_word, false)")
    numbered = spans.withColumn("fresh", F.when(touching, 0).otherwise(1)).withColumn(
        "run", F.expr("sum(fresh) OVER (PARTITION BY doc_id, text_hash ORDER BY from_word, to_word "
                      "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    return (
        numbered.groupBy("doc_id", "text_hash", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"),
             (F.max("to_word") - F.min("from_word")).alias("n_words"), F.min("kept").alias("kept"))
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "text_hash", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"),
                F.col("kept.word").alias("kept_word"))
    )


def cut_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text",
              length: str | None = "n_chars") -> DataFrame:
    """``docs`` without the spans (doc_id, text_hash, start, end); same rows and columns.

    Column ``length``, if there is one, becomes the new number of code points where text was cut.
    """
    lists = stored(
        spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut")), "cuts")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(few(lists, MOST_LISTS), ["doc_id", "text_hash"], "left")
    # what stays: from each cut's end (or 0) to the next cut's start (or the end)
    kept = F.expr(
        "array_join(transform(sequence(0, size(cut)), i -> substring(text, IF(i = 0, 0, cut[i - 1].end) + 1, "
        "IF(i = size(cut), length(text), cut[i].start) - IF(i = 0, 0, cut[i - 1].end))), '')")
    whole = F.col("cut").isNull()
    out = joined.select("row", "cut", F.when(whole, F.col("text")).otherwise(kept).alias("fresh"))
    columns = []
    for name in docs.columns:
        old = F.col("row").getField(name)
        if name == text:
            old = F.col("fresh")
        elif name == length:
            old = F.when(whole, old).otherwise(F.length("fresh").cast(docs.schema[name].dataType))
        columns.append(old.alias(name))
    return out.select(*columns)
