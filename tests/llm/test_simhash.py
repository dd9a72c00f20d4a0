import hashlib
import random

import pyarrow as pa
import pytest

from sparktally.llm import simhash
from tests.llm.conftest import frame, words


def flip(print_, n, rng):
    return format(int(print_, 16) ^ sum(1 << b for b in rng.sample(range(256), n)), "064x")


def test_search_equals_brute_force(spark):
    rng = random.Random(1)
    base = [format(rng.getrandbits(256), "064x") for _ in range(6)]
    rows = [(i, flip(rng.choice(base), rng.choice([0, 1, 9, 15, 16, 20]), rng)) for i in range(150)] + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    asked = df.where("doc_id % 10 = 0")
    want = {(a, b, (int(x, 16) ^ int(y, 16)).bit_count()) for a, x in rows if a % 10 == 0 for b, y in rows[:-1]
            if (int(x, 16) ^ int(y, 16)).bit_count() <= 15}
    assert {tuple(r) for r in simhash.within_radius(asked, df).collect()} == want
    near = {r.query_id: r.n_near for r in simhash.count_within(asked, df).collect()}
    assert near == {a: sum(q == a for q, _, _ in want) for a, _ in rows if a % 10 == 0}
    assert simhash.within_radius(asked.limit(0), df).collect() == []
    with pytest.raises(ValueError):
        simhash.within_radius(asked, df, radius=16)


def test_votes_equal_a_plain_count():
    from sparktally.llm.words import SPACE, mix, shingles, words_of

    text = words(1, 40) + " " + words(1, 20)
    found = words_of(pa.array([text]), SPACE)
    terms, _ = shingles(found.hashes, found.first, 5)
    votes = [0] * 256
    for t in terms:
        raw = b"".join(int(mix((t ^ s).reshape(1))[0]).to_bytes(8, "little") for s in simhash._SEEDS)
        for bit in range(256):
            votes[bit] += 1 if raw[bit // 8] >> (7 - bit % 8) & 1 else -1
    assert simhash.fingerprints(pa.array([text])) == ["%064x" % int("".join("1" if v > 0 else "0" for v in votes), 2)]


@pytest.mark.parametrize("group_bytes", [1, 300, 1 << 20])
def test_neighbours_across_groups(spark, group_bytes):
    ids = [-7, 0, 1, 5, 6, 50, 51, 1000]
    rows = [(i, words(i + 10, 5 + abs(i) % 13)) for i in ids] + [(2, None), (3, "é")]
    got = {r.doc_id: r for r in simhash.edited_fingerprints(frame(spark, rows), group_bytes=group_bytes).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        assert got[i].edited == t[:len(t) - half] + nxt[:half] and got[i].n_chars == len(t)
        prints = simhash.fingerprints(pa.array([t, got[i].edited, nxt]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (prints[0], prints[1])
        assert got[i].near_edited == simhash.likeness(*prints[:2]) and got[i].near_next == simhash.likeness(prints[0], prints[2])


def test_likeness_follows_the_share_of_text(spark):
    base = words(1, 400).split()
    half = " ".join(base[:200]) + " " + words(2, 200)
    a, b, c = simhash.fingerprints(pa.array([" ".join(base), half, words(3, 400)]))
    assert simhash.likeness(a, a) == 1 and simhash.likeness(a, b) > 0.58 > simhash.likeness(a, c) > 0.4


def test_odd_rows(spark, odd, nothing):
    got = simhash.edited_fingerprints(odd).collect()
    assert len(got) == 17
    by = {r.doc_id: r for r in got}
    assert by[1].n_chars == 0 and by[1].fingerprint == "0" * 64 and by[4].fingerprint == by[5].fingerprint
    assert hashlib.sha256(by[4].edited.encode()).digest()
    assert len(simhash.simhash(odd).collect()) == 17
    one = simhash.edited_fingerprints(odd.where("doc_id = 6")).collect()
    assert one[0].edited == "ono"  # its own next row
    assert simhash.edited_fingerprints(nothing).collect() == [] and simhash.simhash(nothing).collect() == []
