"""Near-copy groups against exact similarity of all pairs."""

import random

import numpy as np
import pytest

from loomframe.llm import near_copies, simhash


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def brute(rows):
    """Smallest id of the group of each id, by five-word Jaccard similarity of all pairs."""
    sets = {i: five(t) for i, t in rows}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {k: x if v == y else v for k, v in group.items()}
    return group


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {x.id: x.component for x in near_copies.near_copy_groups(docs, **how).collect()}


@pytest.mark.parametrize("cell_size", [1500, near_copies.CELL_SIZE])
def test_groups_equal_brute_force(spark, cell_size, monkeypatch):
    """Whatever the size of cells, and however few links copy a node's set."""
    if cell_size == 1500:
        monkeypatch.setattr(near_copies, "LINKS_A_COPY", 3)
    r = random.Random(8)
    rows = []
    for _ in range(25):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([40, 150, 400]))]
        rows += [edited(r, words, e) for e in (0, 0, 1, len(words) // 80, len(words) // 20)]
        rows.append(" ".join(words[: len(words) * 9 // 10]).upper())
    # families of many variants around the limit, of which none is the middle
    for passage in (0, 1):
        words = [f"p{passage}w{k}" for k in range(150)]
        for _ in range(100):
            w = list(words)
            if passage:
                n = r.randrange(1, 12)
                at = r.randrange(len(w) - n)
                w[at : at + n] = [f"n{r.randrange(10**6)}" for _ in range(n)]
                rows.append(edited(r, w, r.randrange(3)))
            else:
                rows.append(edited(r, w, r.randrange(1, 8)))
    rows += [None, "", " \n", "one", "ONE ", "one two three", "one two four"]
    rows = list(enumerate(rows))
    assert found(spark, rows, cell_size=cell_size) == brute(rows)


def test_recall_by_length(spark):
    """Copies of 0.8 to 0.9 of texts of 60 to 5,000 words, edited here and there, appended to or replaced in one piece."""
    r = random.Random(22)
    rows, lengths = [], {}
    for size in (60, 200, 1000, 5000):
        made = 0
        while made < (40 if size < 5000 else 12):
            k = len(rows) // 2
            w = [f"t{k}w{j}" for j in range(size)]
            kind, share = made % 3, r.uniform(0.8, 0.87)
            if kind == 0:
                other = edited(r, w, max(1, int(size * (1 - share) / (1 + share) / 5))).split()
            elif kind == 1:
                other = w + [f"t{k}n{j}" for j in range(int((size - 4) / share) - (size - 4))]
            else:
                n = max(1, int((size - 4) * (1 - share) / (1 + share)) - 4)
                at = r.randrange(size - n)
                other = [*w[:at], *(f"t{k}n{j}" for j in range(n)), *w[at + n :]]
            a, b = " ".join(w), " ".join(other)
            if not 0.8 <= similarity(five(a), five(b)) <= 0.9:
                continue
            lengths.setdefault(size, []).append(len(rows))
            rows += [a, b]
            made += 1
    got = found(spark, list(enumerate(rows)))
    for size, pairs in lengths.items():
        assert sum(got[k] == got[k + 1] == k for k in pairs) / len(pairs) == 1, size


def test_bands_meet_at_the_rate_of_similarity():
    r = np.random.default_rng(1)
    met = same = 0
    for n in (20, 100, 1000) * 200:
        u = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = len(u) // 10
        equal = near_copies.bands(u[cut:]) == near_copies.bands(u[:-cut])
        same += equal.mean()
        met += equal.any()
    assert met == 600 and abs(same / 600 - 0.8**near_copies.ROWS) < 0.02


def test_cell_joins_what_is_similar(monkeypatch):
    """A cell's groups are those of all pairs, whatever it remembers and however few pairs it compares at once."""
    r = random.Random(5)
    for held, known in ((1 << 21, 1 << 20), (50, 7)):
        monkeypatch.setattr(near_copies, "HELD", held)
        monkeypatch.setattr(near_copies, "KNOWN_PAIRS", known)
        for two in (False, True):
            base = r.sample(range(10**6), 60)
            sets = [{*base[: r.randint(50, 60)], *r.sample(range(10**6), r.randint(0, 8))} for _ in range(60)]
            count = {x: sum(x in s for s in sets) for s in sets for x in s}
            order = [np.array(sorted(s, key=lambda x: (count[x], x)), np.int64) for s in sets]
            group = np.array([r.randrange(40) for _ in sets])
            side = np.array([r.randrange(2) if two else 0 for _ in sets])
            u, v = near_copies.cell_links(np.arange(60), group, order, side, 0.8)

            def joined(pairs, group=group):
                at = {k: int(group[k]) for k in range(60)}
                for a, b in pairs:
                    at = {k: at[a] if x == at[b] else x for k, x in at.items()}
                return at

            same = lambda x, a, b: x[a] == x[b]
            pairs = [(a, b) for a in range(60) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8 and (not two or side[a] != side[b])]
            want, got = joined(pairs), joined(zip(u.tolist(), v.tolist(), strict=True))
            assert all(same(want, a, b) == same(got, a, b) for a in range(60) for b in range(a))
            assert all(similarity(sets[a], sets[b]) >= 0.8 for a, b in zip(u.tolist(), v.tolist(), strict=True))


def test_words_and_shingles():
    for text in ["", " \n", "a", " A\tb  c\x0bd e\r\nf ", "É ü " * 9, "x" * 70000 + " y z w v u " + "q" * 150000 + " y z w v u", "a b c d e f a b c d e"]:
        w = (text.encode().translate(simhash.LOWER)).split()
        words = near_copies.Words(text)
        assert [bytes(words.bytes[a:z]) for a, z in zip(words.starts, words.ends, strict=True)] == w
        runs = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        assert len(words.shingles(5)) == len(runs)
        if len(w) >= 5:
            long = near_copies._mix(words._long(words.starts[: len(w) - 4], words.ends[4:]))
            assert (np.unique(long) == words.shingles(5)).all()
    # the hash is one of the words alone, wherever they stand
    one, two = near_copies.Words("p q r s t u").shingles(5), near_copies.Words("and then\np q  r s t").shingles(5)
    assert len(np.intersect1d(one, two)) == 1
    assert near_copies.Words(" P q\n").name() == near_copies.Words("p  Q").name()


def test_hub_with_many_links(spark, monkeypatch):
    """A node's set is copied when it has many links; no link is lost."""
    monkeypatch.setattr(near_copies, "LINKS_A_COPY", 3)
    r = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, edited(r, words, 1 if k else 0)) for k in range(60)] + [(100, "quite another text")]
    assert found(spark, rows) == {**dict.fromkeys(range(60), 0), 100: 100}


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "A  b"), (3, "x y z"), (4, "a b"), (4, "a b"), (5, "long " * 50000), (None, "q r"), (None, "Q r"), (None, "q r")]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, grp int")
    got = sorted((x.id or 0, x.component or 0) for x in near_copies.near_copy_groups(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (4, 3), (5, 5)]
    assert near_copies.near_copy_groups(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs, grouping=near_copies.near_copy_groups)
    # by row: (3, "x y z") is a group of its own; of the rows without id one of "q r"
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0, (x.text or "")[:6].lower()) for x in kept.collect()) == [(0, "q r"), (1, ""), (3, "a  b"), (3, "x y z"), (5, "long l")]
    assert simhash.keep_one(docs.limit(0), grouping=near_copies.near_copy_groups).count() == 0


def test_anchors_bring_candidates(spark, monkeypatch):
    """Without a bucket in common, copies within three bits still meet by the anchors; what they bring is checked."""
    monkeypatch.setattr(near_copies, "bands", lambda s: np.zeros(0, np.int64))
    r = random.Random(4)
    rows = []
    for k in range(30):
        w = [f"t{k}w{j}" for j in range(400)]
        rows += [" ".join(w), edited(r, w, 1)]
    # a phrase said over and over makes the fingerprint, the rest the set of runs
    rows += ["x y z " * 100 + " ".join(f"{e}{j}" for j in range(20)) for e in "uv"]
    bits = lambda k: (simhash.fingerprint(rows[k]) ^ simhash.fingerprint(rows[k + 1])).bit_count()
    near = [k for k in range(0, 60, 2) if bits(k) <= 3]
    got = found(spark, list(enumerate(rows)))
    assert len(near) > 10 and all(got[k] == got[k + 1] == k for k in near)
    assert bits(60) == 0 and got[60] == 60 and got[61] == 61
