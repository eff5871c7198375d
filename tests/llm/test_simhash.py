import hashlib
import itertools

import numpy as np

from sheaf.llm import simhash, words


def model(rows):
    """(doc_id, n_chars, sha of the edited text, prints and likenesses), by the definition."""
    order = sorted(((i, t or "", t is not None) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1].encode()), reverse=True)
    out = []
    prints = lambda t: simhash.fingerprint(words.block_of(t.encode()).hashes(lower=True))
    for (i, text, _), (_, then, _) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + then[:half]
        a, b, c = prints(text), prints(edited), prints(then)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)))
    return sorted(out, key=repr)


def test_edited_texts_against_the_definition(spark, odd, small):
    for docs in (odd, small, odd.where("doc_id = 5"), odd.where("doc_id = 4"), odd.where("doc_id is null")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted((tuple(r) for r in simhash.edited(docs).collect()), key=repr) == model(rows)


def test_empty_table(empty):
    assert simhash.edited(empty).count() == 0


def test_near_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(4)
    base = [rng.bytes(16) for _ in range(40)]
    prints = list(base)
    for b in base:
        for flips in (0, 1, 2, 3, 3, 4, 6):
            x = int.from_bytes(b)
            for bit in rng.choice(128, flips, replace=False):
                x ^= 1 << int(bit)
            prints.append(x.to_bytes(16))
    rows = [(i, p.hex()) for i, p in enumerate(prints)]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {r["doc_id"]: r["n_near"] for r in simhash.near(table.select("fingerprint"), table.where("doc_id % 3 = 0")).collect()}
    want = {i: sum((int.from_bytes(p) ^ int.from_bytes(q)).bit_count() <= simhash.RADIUS for q in prints) for i, p in enumerate(prints) if i % 3 == 0}
    assert got == want


def test_similar_texts_have_similar_fingerprints(small):
    rows = simhash.edited(small.where("n_chars > 400")).collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.1
    texts = [r["text"] for r in small.collect()][:30]
    a = [simhash.fingerprint(words.block_of(t.encode()).hashes(lower=True)) for t in texts]
    assert all(simhash.likeness(x, x) == 1 for x in a) and all(0 <= simhash.likeness(x, y) <= 1 for x, y in itertools.product(a, a))
    assert simhash.fingerprint(np.empty(0, np.uint64)) == bytes(16)


def _apart(a, b):
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def test_near_against_brute_force_up_to_and_beyond_the_radius(spark):
    rng = np.random.default_rng(8)
    prints = [rng.bytes(16) for _ in range(12)]
    for b in list(prints):
        for flips in (2, 5, 9, 12, 13, 14, 14, 15, 16, 18):
            x = int.from_bytes(b)
            for bit in rng.choice(128, flips, replace=False):
                x ^= 1 << int(bit)
            prints += [x.to_bytes(16)] * (1 + flips % 2)
    table = spark.createDataFrame([(i, p.hex()) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    for radius in (0, 3, 8, 14):
        got = {r["doc_id"]: r["n_near"] for r in simhash.near(table.select("fingerprint"), table.where("doc_id % 2 = 0"), radius).collect()}
        assert got == {i: sum(_apart(p, q) <= radius for q in prints) for i, p in enumerate(prints) if i % 2 == 0}


def test_near_finds_edited_texts(spark):
    """One word replaced in texts of 100 words, three in texts of 500."""
    rng = np.random.default_rng(9)
    rows = []
    for n, edits in ((100, 1), (500, 3)):
        for _ in range(50):
            text = rng.integers(1, 2 ** 63, n, dtype=np.uint64)
            other = text.copy()
            other[rng.choice(n, edits, replace=False)] = rng.integers(1, 2 ** 63, edits, dtype=np.uint64)
            rows += [(len(rows) + i, simhash.fingerprint(t).hex()) for i, t in enumerate((text, other))]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {r["doc_id"]: r["n_near"] for r in simhash.near(table.select("fingerprint"), table.where("doc_id % 2 = 0")).collect()}
    assert np.mean([got[i] == 2 for i in range(0, 100, 2)]) > 0.9 and np.mean([got[i] == 2 for i in range(100, 200, 2)]) > 0.85


def test_near_is_the_same_for_any_number_of_blocks(spark):
    rng = np.random.default_rng(10)
    prints = [rng.bytes(16) for _ in range(6)]
    for b in list(prints):
        for flips in (1, 4, 9, 13, 14, 14, 15, 17):
            x = int.from_bytes(b)
            for bit in rng.choice(128, flips, replace=False):
                x ^= 1 << int(bit)
            prints.append(x.to_bytes(16))
    prints += [bytes(16)] * 3 + [b"\xff" * 16]
    table = spark.createDataFrame([(i, p.hex()) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    asked = [*range(0, 6), len(prints) - 1, len(prints) - 2]
    want = {i: sum(_apart(prints[i], q) <= 14 for q in prints) for i in asked}
    for blocks in (4, 5, 6, 7, 8, 11, 15, 16):
        got = simhash.near(table.select("fingerprint"), table.where(table["doc_id"].isin(asked)), 14, blocks)
        assert {r["doc_id"]: r["n_near"] for r in got.collect()} == want, blocks
    one = simhash.near(table.select("fingerprint"), table.where("doc_id = 0"), 14, 3)
    assert {r["doc_id"]: r["n_near"] for r in one.collect()} == {0: want[0]}


def test_blocks_widen_with_the_rows():
    counts = [simhash.block_count(10 ** n) for n in range(1, 13)]
    assert counts == sorted(counts, reverse=True) and counts[0] > 8 and counts[-1] == simhash.MIN_BLOCKS
    for blocks in range(3, 17):
        cut = simhash.layout(blocks, 14)
        assert sum(flips + 1 for _, _, flips in cut) == 15  # one difference more than the radius would be needed to escape
    share = lambda blocks: sum(len(simhash._flips(bits, flips)) / 2 ** bits for _, bits, flips in simhash.layout(blocks, 14))
    assert share(8) > share(7) > share(6) > share(5) > share(4) > share(3) and share(4) < 5e-6 and share(3) < 1e-7
