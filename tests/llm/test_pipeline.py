from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from sheaf.llm import neardup, passages
from sheaf.llm.tables import keep
from tests.llm.helpers import SF, shingles, split
from tests.llm.test_neardup import expected
from tests.llm.test_passages import covered, exact


def stages(spark, docs):
    out = {}
    for name, f in pipeline.STAGES:
        docs = keep(f(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def test_stages_on_real_rows(spark, small):
    out = stages(spark, small)
    names = list(out)
    assert names == ["toxicity", "near_dedup", "passage_dedup", "mixing", "packing"]
    assert all(out[n].columns == small.columns for n in names[:-1])
    clean = {r["doc_id"]: r["text"] for r in out["toxicity"].collect()}
    assert set(clean) <= {r["doc_id"] for r in small.collect()} and len(clean) > 0.8 * small.count()
    # one document of each group stays
    want = expected(list(clean.items()), 80)
    one = {r["doc_id"]: r["text"] for r in out["near_dedup"].collect()}
    assert one == {i: t for i, t in clean.items() if want[i] == i}
    # no run of 50 words that an earlier document has is left, and nothing but such passages went
    cut = {r["doc_id"]: r["text"] for r in out["passage_dedup"].collect()}
    assert set(cut) == set(one) and not exact(cut, 50)
    gone = covered(passages.passages(out["near_dedup"]).collect())
    assert all(split(cut[i]) == [w for k, w in enumerate(split(t)) if k not in gone[i]] for i, t in one.items())
    # the mix takes whole rows, at most twice, but for one cut row a source
    mixed = defaultdict(list)
    for r in out["mixing"].collect():
        mixed[r["doc_id"]].append(split(r["text"]))
    assert all(len(v) <= 2 and all(x == split(cut[i])[:len(x)] for x in v) for i, v in mixed.items())
    assert sum(x != split(cut[i]) for i, v in mixed.items() for x in v) <= 21
    total = sum(len(x) for v in mixed.values() for x in v)
    assert abs(total - 1.5 * sum(len(split(t)) for t in cut.values())) <= 21
    # every row is packed once
    pieces = out["packing"].where("piece = 0").collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter({i: len(v) for i, v in mixed.items()})


def test_odd_rows_pass_every_stage(spark, odd, empty):
    out = stages(spark, odd)
    assert all(out[n].columns == odd.columns and out[n].dtypes == odd.dtypes for n in list(out)[:-1])
    ids = Counter(r["doc_id"] for r in out["near_dedup"].collect())
    assert ids[None] == 2 and ids[11] == 1 and ids[10] == 0 and ids[12] == 0
    assert stages(spark, empty)["packing"].count() == 0


def test_one_row_of_each_group_stays(spark, odd):
    rows = pipeline.near_dedup(spark, odd, SF).where("doc_id is not null").collect()
    texts = [shingles(r["text"]) for r in rows if r["doc_id"] != 5 and split(r["text"])]
    assert len(texts) == len(set(texts))
    assert neardup.Params(percent=80).least == 4


def test_run(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
